"""Tables in the folder that all executors share, to cut lineage between rounds."""

from __future__ import annotations

import contextlib
import pathlib
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, Observation, SparkSession

#: The temporary folder of each application that has none set.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, as in tests, a temporary folder, but only if all tasks run on this machine."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = spark.sparkContext.applicationId
        if own not in _OWN:
            _OWN[own] = "file://" + tempfile.mkdtemp(prefix="sluice-")
        path = _OWN[own]
    return path.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once a session."""
    context = spark.sparkContext
    if getattr(context, "_sluice_sent", None) is None:
        root = pathlib.Path(__file__).resolve().parents[1]
        archive = pathlib.Path(tempfile.mkdtemp(prefix="sluice-")) / f"{root.name}.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        context.addPyFile(str(archive))
        context._sluice_sent = True


class Scratch:
    """Written tables outlive lost executors, unlike cached blocks or local checkpoints."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/sluice/{name}-{uuid.uuid4().hex}"

    def path(self, label: str) -> str:
        return f"{self.root}/{label}"

    def table(self, df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
        """Write ``df`` and read it back."""
        df.write.mode("overwrite").option("compression", codec).parquet(self.path(label))
        return self.read(df.schema, label)

    def bucketed(self, df: DataFrame, label: str, key: str, distinct: bool = False) -> DataFrame:
        """``table`` dealt into buckets by ``key``: joins and aggregates on it leave these rows where they are."""
        dealt = Dealt(self, label, key)
        dealt.add(df, distinct)
        return dealt.close()

    def counted(self, df: DataFrame, label: str, **figures) -> tuple[DataFrame, dict]:
        """``table`` and aggregates over its rows, taken while they are written."""
        seen = Observation()
        out = self.table(df.observe(seen, *(c.alias(k) for k, c in figures.items())), label)
        return out, seen.get

    @contextlib.contextmanager
    def in_buckets(self):
        """Within, joins by a bucket key and further columns leave the buckets in place; the other side comes to them."""
        key = "spark.sql.requireAllClusterKeysForCoPartition"
        before = self.spark.conf.get(key)
        self.spark.conf.set(key, "false")
        try:
            yield
        finally:
            self.spark.conf.set(key, before)

    def read(self, schema, label: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.path(label))

    def drop(self, *labels: str) -> None:
        """Delete tables that no later step reads."""
        for label in labels:
            target = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(label))
            target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)


class Dealt:
    """A table in buckets by a key that grows by further rows, dealt alike. What it holds never moves again.

    Every bucket is one partition of a scan, with the files of all additions, so joins and aggregates by the key (or by
    more columns with it) exchange no row of this table.
    """

    def __init__(self, scratch: Scratch, label: str, key: str):
        self.scratch, self.label, self.key, self.name = scratch, label, key, f"sluice_{uuid.uuid4().hex}"
        self.buckets, self.begun = int(scratch.spark.conf.get("spark.sql.shuffle.partitions")), False

    def add(self, df: DataFrame, distinct: bool = False, in_place: bool = False) -> None:
        """Append rows. distinct: once each among these. in_place: they come from this key's buckets or an exchange by it already."""
        rows = df if in_place else df.repartition(self.buckets, self.key)
        if distinct:
            rows = rows.distinct()  # within the buckets: no further exchange
        writer = rows.write.format("parquet").bucketBy(self.buckets, self.key).sortBy(self.key).option("compression", "zstd")
        if self.begun:
            writer.mode("append").saveAsTable(self.name)
        else:
            writer.option("path", self.scratch.path(self.label)).saveAsTable(self.name)
        self.begun = True

    def counted(self, df: DataFrame, in_place: bool = False, **figures) -> dict:
        """``add`` rows and return aggregates over these, taken while they are written."""
        seen = Observation()
        self.add(df.observe(seen, *(c.alias(k) for k, c in figures.items())), in_place=in_place)
        return seen.get

    def read(self) -> DataFrame:
        """What it holds now; later additions are not in it."""
        return self.scratch.spark.read.table(self.name)

    def close(self, delete: bool = False) -> DataFrame | None:
        """Forget its name; its files stay unless ``delete``, and what was read keeps its buckets."""
        rows = None if delete else self.read()
        self.scratch.spark.sql(f"DROP TABLE {self.name}")
        if delete:
            self.scratch.drop(self.label)
        return rows
