"""Graph-flow analytics on PySpark DataFrames."""
