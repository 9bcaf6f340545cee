"""The store: a versioned key-value log on Parquet files, with levels, snapshots and compaction."""
