"""loam: a versioned key-value log on Parquet, queried as Spark DataFrames."""

__version__ = "0.1.0"
