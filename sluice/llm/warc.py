"""WARC writing with payload de-duplication, and reading by boundary chains.

Reading never trusts the record magic alone. Files are read in byte ranges, each by one task; every place where the
magic occurs is a candidate, and one that a header follows names the offset of its successor. Within a range the links
are followed by pointer jumping to the place where they leave it; ranges are joined by pointer jumping over those
exits, from the start of each file. Only candidates reached so are records, so magic inside a payload is never one,
and the chain must end exactly at the end of the file.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sluice.llm.common import PIECE_BYTES, Scratch, prepare, task

MAGIC = b"WARC/1.1\r\n"
GAP = b"\r\n\r\n"
#: Shorter payloads are always written in full.
LEAST_REVISIT = 100
#: Digests that repeat, or byte ranges, broadcast at a time: at most some 20 MB. More digests are joined by a shuffle, more ranges take further passes.
MOST_BROADCAST = 200_000
#: What is known of a candidate's payload: it differs from its digest, is verified, or goes on after the next magic.
WRONG, VERIFIED, OPEN = 0, 1, 2
SCAN = pa.schema([("file", pa.string()), ("size", pa.int64()), ("block", pa.int64()), ("at", pa.int64()), ("next", pa.int64()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("state", pa.int32()), ("total", pa.int64())])
SCAN_ROWS = "file string, size long, block long, at long, next long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, state int, total long"
FIELDS = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
MARKED = "file string, block long, at long, next long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, state int, base long"
PIECES = pa.schema([("file", pa.string()), ("start", pa.int64()), ("place", pa.int64()), ("body", pa.binary()), ("record_type", pa.string()), ("payload_digest", pa.string())])
LENGTH = re.compile(rb"\r\nContent-Length: *([0-9]{1,18})\r\n", re.I)


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", date: str = "1970-01-01T00:00:00Z", compression: str = "none") -> None:
    """A record for each row; of equal payloads of LEAST_REVISIT bytes or more, that with the smallest id holds the bytes.

    Null payloads count as empty. Rows that repeat the smallest id are responses too. A null id is written as an empty
    one, and revisits a row that has an id. A null address is left out. An empty table gives no record. Other columns
    play no part. compression: ``none``, or ``gzip``, whose files a reader can't share among tasks.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"))
    rows = rows.withColumns({"digest": F.sha2(F.col("body").cast("binary"), 256), "size": F.octet_length("body")})
    # Payloads that occur once need no join; so the bodies of all rows are shuffled only where very many repeat.
    again = rows.where(f"size >= {LEAST_REVISIT}").groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = Scratch(pages.sparkSession, "warc").table(again, "repeated")
    records = rows.join(F.broadcast(again) if again.count() <= MOST_BROADCAST else again, "digest", "left")
    records = records.withColumn("again", F.expr("first IS NOT NULL AND NOT (id <=> first)"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n"))
    records = records.withColumn("block", F.when(F.col("again"), http).otherwise(F.concat(http, F.col("body"))))
    head = F.concat(
        F.lit(MAGIC.decode()),
        line("WARC-Type", F.when(F.col("again"), "revisit").otherwise("response")),
        line("WARC-Record-ID", urn("id")),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x20\x7F]+", "%20")), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(F.col("again"), F.concat(line("WARC-Refers-To", urn("first")), F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"))).otherwise(""),
        F.lit("Content-Type: application/http;msgtype=response\r\n"),
        line("Content-Length", F.octet_length("block").cast("string")),
        F.lit("\r\n"),
    )
    written = records.select(F.concat(head, F.col("block")).alias("value"))
    written.write.option("lineSep", GAP.decode()).option("compression", compression).text(path)


def header(line: bytes) -> tuple[int, int, dict[bytes, bytes]] | None:
    """Length of a record's header, of its block, and its fields, from what follows the magic; None if that is no header."""
    close = line.find(GAP)
    size = LENGTH.search(b"\r\n" + line[: close + 2]) if close >= 0 else None
    if size is None:
        return None
    fields = dict(x.split(b":", 1) for x in line[:close].split(b"\r\n") if b":" in x)
    return close + 4, int(size[1]), {k.strip().lower(): v.strip() for k, v in fields.items()}


def number(name: bytes) -> int | None:
    """The page id of ``<urn:page:...>``."""
    digits = re.fullmatch(rb"<urn:page:(-?[0-9]{1,19})>", name)
    return int(digits[1]) if digits else None


def payload_state(block: bytes, kind: bytes, digest: str) -> tuple[int, int]:
    """Payload size that the block names, and whether its payload has that size and the digest."""
    close = block.find(GAP)
    size = LENGTH.search(block[: close + 2]) if close >= 0 else None
    if size is None:
        return 0, WRONG
    if kind == b"revisit":
        return int(size[1]), VERIFIED
    whole = len(block) - close - 4 == int(size[1]) and hashlib.sha256(memoryview(block)[close + 4 :]).hexdigest() == digest
    return int(size[1]), VERIFIED if whole else WRONG


def candidate(line: bytes, at: int) -> tuple | None:
    """Where the record's successor begins and its fields, for a candidate at ``at``; None if no header follows."""
    read = header(line)
    if read is None:
        return None
    head, size, fields = read
    stop, kind, digest = head + size, fields.get(b"warc-type", b""), fields.get(b"warc-payload-digest", b"")[7:].decode("ascii", "replace")
    if stop + 4 == len(line):  # nothing but this record until the next magic
        named, state = payload_state(line[head:stop], kind, digest) if line.endswith(GAP) else (0, WRONG)
    else:
        found = LENGTH.search(line[head : line.find(GAP, head) + 2])
        named, state = int(found[1]) if found else 0, OPEN
    return at + len(MAGIC) + stop + 4, number(fields.get(b"warc-record-id", b"")), named, digest, kind.decode("ascii", "replace"), number(fields.get(b"warc-refers-to", b"")), state


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """What stands between two magics, in the order of the file: file, size, block (start of the byte range), line."""
    lines = spark.read.option("lineSep", MAGIC.decode()).text(path)
    return lines.select(*(F.col(f"_metadata.{c}").alias(a) for c, a in (("file_path", "file"), ("file_size", "size"), ("file_block_start", "block"))), F.col("value").cast("binary").alias("line"))


def placed_lines(batches):
    """(file, size, block, at, line) of each line, and (file, size, block, total, None) after the last of a range.

    at: where the line's magic begins, counted from that of the range's first line. So a range's first magic stands at
    the bytes of the ranges before it, less the magic that a file's first line lacks.
    """
    key, at = None, 0
    for batch in batches:
        files, sizes, blocks = (batch.column(i).to_pylist() for i in range(3))
        for i, own in enumerate(zip(files, sizes, blocks)):
            if own != key:
                if key is not None:
                    yield (*key, at, None)
                key, at = own, 0
            line = batch.column(3)[i].as_py()
            yield (*own, at, line)
            at += len(MAGIC) + len(line)
    if key is not None:
        yield (*key, at, None)


@task
def _scan(batches):
    """The candidates of each byte range, and its total."""
    out: list[tuple] = []
    for file, size, block, at, line in placed_lines(batches):
        if line is None:
            out.append((file, size, block, *[None] * 8, at))
        elif (block or at) and (found := candidate(line, at)) is not None:  # no magic precedes the first line of a file
            out.append((file, size, block, at, *found, None))
        if len(out) >= 2000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), SCAN)], schema=SCAN)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), SCAN)], schema=SCAN)


def links(starts: np.ndarray, nexts: np.ndarray) -> np.ndarray:
    """Index of each ascending candidate's successor; its own where the link leaves the range or leads nowhere in it."""
    own = np.arange(len(starts))
    at = np.minimum(np.searchsorted(starts, nexts), max(len(starts) - 1, 0))
    return np.where(starts[at] == nexts, at, own) if len(starts) else own


def exits(starts: np.ndarray, nexts: np.ndarray) -> np.ndarray:
    """Where the chain from each candidate leaves the range, by pointer jumping: round k follows 2**k links."""
    jump = links(starts, nexts)
    while len(jump) and not np.array_equal(further := jump[jump], jump):
        jump = further
    return nexts[jump]


def reached(starts: np.ndarray, nexts: np.ndarray, entry: int) -> np.ndarray:
    """Which candidates are on the chain from ``entry``, by pointer jumping."""
    jump, marked = links(starts, nexts), starts == entry
    for _ in range(max(1, int(len(starts)).bit_length())):
        marked[jump[marked]] = True
        jump = jump[jump]
    return marked


def _exits(table: pa.Table) -> pa.Table:
    table = table.sort_by("at")
    leave = exits(np.asarray(table.column("at"), np.int64), np.asarray(table.column("next"), np.int64))
    return pa.table({"file": table.column("file"), "block": table.column("block"), "at": table.column("at"), "leave": pa.array(leave)})


def _mark(table: pa.Table) -> pa.Table:
    table = table.sort_by("at")
    starts, nexts = (np.asarray(table.column(c), np.int64) for c in ("at", "next"))
    return table.filter(pa.array(reached(starts, nexts, table.column("entry")[0].as_py()))).drop_columns(["entry"])


def chain_entries(begun: DataFrame, steps: DataFrame, turns: int, scratch: Scratch) -> DataFrame:
    """file, start of all places that the chains from the files' starts pass from range to range, the end included.

    Pointer jumping by joins: after round k a step spans 2**k ranges.
    """
    met, jump = begun, steps.select("file", "start", "leave")
    for turn in range(turns):
        met = scratch.table(met.unionByName(met.join(jump, ["file", "start"]).select("file", F.col("leave").alias("start"))).distinct(), f"met-{turn}")
        if turn + 1 < turns:
            other = jump.select("file", F.col("start").alias("leave"), F.col("leave").alias("further"))
            jump = scratch.table(jump.join(other, ["file", "leave"], "left").select("file", "start", F.coalesce("further", "leave").alias("leave")), f"jump-{turn}")
    return met


@task
def _gather(batches, ranges):
    """The bytes of the records that hold magic, in pieces of about PIECE_BYTES, from the ranges that hold any."""
    ranges, out, size = ranges.value, [], 0
    info = start = stop = None
    held: list[bytes] = []
    place, kind, digest = 0, None, None

    def drop(file: str) -> None:
        nonlocal held, size
        if held:
            out.append((file, start, place, b"".join(held), kind, digest))
            size += len(out[-1][3])
            held = []

    for file, _, block, at, line in placed_lines(batches):
        if at == 0 and line is not None:
            info, start, stop = ranges.get((file, block)), None, None
            if info is not None:
                start, stop, kind, digest = info["carried"], info["entry"], None, None
                place = info["base"]
        if info is None:
            continue
        if line is None:
            drop(file)
            if at != info["total"]:
                raise ValueError(f"the byte ranges of {file} changed while it was read")
        elif start is not None and (stop is None or info["base"] + at < stop):
            held += [MAGIC, line]
            if sum(map(len, held[-2:])) + len(held) * len(MAGIC) > PIECE_BYTES or len(held) > 20_000:
                drop(file)
                place, kind, digest = info["base"] + at + 1, None, None
        elif stop is not None and info["base"] + at >= stop:
            drop(file)
            here = info["base"] + at
            head, length, fields = header(line)
            start, stop, place = here, here + len(MAGIC) + head + length + len(GAP), here
            kind, digest = fields.get(b"warc-type", b"").decode("ascii", "replace"), fields.get(b"warc-payload-digest", b"")[7:].decode("ascii", "replace")
            if stop == here + len(MAGIC) + len(line):
                start = None  # verified in the first pass
            else:
                held = [line[head:]]
        if size > 8 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), PIECES)], schema=PIECES)
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), PIECES)], schema=PIECES)


@task
def _verify(batches):
    """file, start of each record whose pieces make up its payload; others raise."""
    key, held, kind, digest = None, [], "", ""

    def checked() -> tuple[str, int]:
        body = b"".join(held)
        if not body.endswith(GAP) or payload_state(body[: -len(GAP)], kind.encode(), digest)[1] != VERIFIED:
            raise ValueError(f"the payload of the record at {key[1]} of {key[0]} does not match its digest")
        return key

    for batch in batches:
        done = []
        for file, start, _, body, named, said in zip(*(batch.column(i).to_pylist() for i in range(6))):
            if (file, start) != key:
                done += [checked()] if key is not None else []
                key, held, kind, digest = (file, start), [], "", ""
            held.append(body)
            kind, digest = kind or named or "", digest or said or ""
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=["file", "start"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in checked()], names=["file", "start"])


def verify_open(spark: SparkSession, path: str, records: DataFrame, blocks: DataFrame, scratch: Scratch) -> None:
    """Read the records again whose payload holds magic, and check them; ValueError where one differs."""
    ends = records.groupBy("file", "block").agg(F.min("start").alias("entry"), F.max(F.struct("start", "next", "state")).alias("last"), F.max(F.when(F.col("state") == OPEN, True)).alias("open"))
    w = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)  # a file's byte ranges
    ranges = blocks.join(ends, ["file", "block"], "left").withColumn("before", F.last("last", ignorenulls=True).over(w))
    carried = F.when((F.col("before.state") == OPEN) & (F.col("before.next") > F.col("base")), F.col("before.start"))
    ranges = ranges.select("file", "block", "base", "total", "entry", carried.alias("carried"), "open").where("open OR carried IS NOT NULL")
    ranges, n = scratch.counted(ranges.drop("open"), "ranges", n=F.count(F.lit(1)))
    passes = -(-n["n"] // MOST_BROADCAST)
    schema, read = "file string, start long, place long, body binary, record_type string, payload_digest string", 0
    for k in range(passes):
        own = ranges.where(F.pmod(F.xxhash64("file", "block"), F.lit(passes)) == k).toLocalIterator()
        known = spark.sparkContext.broadcast({(r["file"], r["block"]): r.asDict() for r in own})
        found = scratch.table(read_lines(spark, path).mapInArrow(lambda batches, known=known: _gather(batches, known), schema), f"pieces-{k}")
        known.destroy()
        read = found if k == 0 else read.unionByName(found)
    checked = read.repartition("file", "start").sortWithinPartitions("file", "start", "place").mapInArrow(_verify, "file string, start long")
    if checked.count() != records.where(F.col("state") == OPEN).count():
        raise ValueError("a record that holds magic could not be read again")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record of the archives: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Files may be of any size, plain (read in byte ranges by many tasks) or gzip (a task each); payloads may hold
    anything. Empty files and archives without a record give no rows, records that repeat a row each, a record without
    a page id a null. Raises where a chain breaks off, does not begin at the start or end at the end of its file, or
    where a payload differs from its digest. A header that itself holds the magic counts as broken.
    """
    prepare(spark)
    scratch = Scratch(spark, "warc")
    scan = scratch.table(read_lines(spark, path).mapInArrow(_scan, SCAN_ROWS), "scan")
    totals = scan.where("total IS NOT NULL").select("file", "size", "block", "total")
    w = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)  # a file's byte ranges
    base = F.coalesce(F.sum("total").over(w), F.lit(0)) - len(MAGIC)
    blocks = scratch.table(totals.withColumn("base", base), "blocks")
    files = blocks.groupBy("file", "size").agg(F.count("*").alias("n"), F.max(F.col("base") + F.col("total")).alias("end"))
    files, most = scratch.counted(files, "files", n=F.max("n"))
    found = scan.where("total IS NULL")
    leave = found.select("file", "block", "at", "next").groupBy("file", "block").applyInArrow(lambda own: _exits(own), "file string, block long, at long, leave long")
    steps = leave.join(blocks.select("file", "block", "base"), ["file", "block"]).select("file", "block", (F.col("base") + F.col("at")).alias("start"), (F.col("base") + F.col("leave")).alias("leave"))
    steps = scratch.table(steps, "exits")
    asked = steps.select("file", F.col("leave").alias("start")).distinct().unionByName(files.select("file", F.lit(0).cast("long").alias("start"))).distinct()
    steps = scratch.table(steps.join(asked, ["file", "start"]), "steps")
    begun = files.where("end > 0").select("file", F.lit(0).cast("long").alias("start"))
    met = chain_entries(begun, steps, max(1, int(most["n"] or 1).bit_length()), scratch)
    # Each chain ends in one place that is no candidate: the end of its file, which is known for plain files.
    last = met.join(steps.select("file", "start"), ["file", "start"], "left_anti")
    whole = F.expr("start = end AND (end = size OR file LIKE '%.gz')")
    broken = files.where("end > 0 OR size > 0 AND file NOT LIKE '%.gz'").join(last, "file", "left").where(~F.coalesce(whole, F.lit(False))).select("file").limit(1).collect()
    if broken:
        raise ValueError(f"the chain of records breaks off in {broken[0]['file']}")
    entries = met.join(steps, ["file", "start"]).select("file", "block", F.col("start").alias("enter"))
    entries = entries.join(blocks.select("file", "block", "base"), ["file", "block"]).select("file", "block", "base", (F.col("enter") - F.col("base")).alias("entry"))
    marked = found.drop("size", "total").join(entries, ["file", "block"]).select("file", "block", "at", "next", *FIELDS, "state", "base", "entry")
    marked = marked.groupBy("file", "block").applyInArrow(lambda own: _mark(own), MARKED)
    records = marked.select("file", "block", (F.col("base") + F.col("at")).alias("start"), (F.col("base") + F.col("next")).alias("next"), *FIELDS, "state")
    records, seen = scratch.counted(records, "records", wrong=F.count_if(F.col("state") == WRONG), open=F.count_if(F.col("state") == OPEN))
    if seen["wrong"]:
        bad = records.where(F.col("state") == WRONG).first()
        raise ValueError(f"the payload of the record at {bad['start']} of {bad['file']} does not match its digest")
    if seen["open"]:
        verify_open(spark, path, records, blocks, scratch)
    return records.select(*FIELDS)
