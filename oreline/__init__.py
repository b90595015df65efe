"""oreline: structure and redundancy analytics on PySpark DataFrames."""
