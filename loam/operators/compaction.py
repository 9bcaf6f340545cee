"""Compaction: which files, and which versions stay.

Rules over files work on the file table (number, level, rows, file_size, smallest, largest), which is metadata; the drop
rules work on the versions themselves and keep every view as of the smallest live snapshot or later.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from loam.operators.ranges import held_by

# Defaults of the format.
LEVELS, LEVEL0_FILES, LEVEL_FACTOR, LEVEL_BASE = 7, 4, 10, 10 << 20


def with_base(inputs: DataFrame, deeper: DataFrame) -> DataFrame:
    """inputs with base: no range of a deeper file can hold the key. deeper: smallest, largest; disjoint levels.

    Keys meet only the ranges of their bin (ranges.held_by), whatever the number of files.
    """
    ranges = deeper.select("smallest", "largest").distinct()
    keys = inputs.select("user_key").distinct()
    held = held_by(keys, ranges, "left_semi").withColumn("_held", F.lit(True))
    return inputs.join(held, "user_key", "left").withColumn("base", F.col("_held").isNull()).drop("_held")


def compacted(inputs: DataFrame, smallest_snapshot: int, base=True) -> DataFrame:
    """The versions that stay. base: a boolean column (or literal) telling that no deeper file can hold the key.

    A version goes if the next newer input version of its key is at or below the smallest snapshot; a tombstone at or
    below it goes too where base holds. Only versions at or below the snapshot can go, and of these only the newest of a
    key can stay, so that an aggregation finds it (no window: a key with very many versions is no bottleneck).
    """
    base = F.lit(base) if isinstance(base, bool) else base
    new = inputs.where(F.col("seq") > smallest_snapshot)
    old = inputs.withColumn("_base", base).where(F.col("seq") <= smallest_snapshot)
    top = old.groupBy("user_key").agg(F.max("seq").alias("seq"), F.max_by("vtype", "seq").alias("vtype"), F.max_by("val", "seq").alias("val"), F.max_by("_base", "seq").alias("_base"))
    kept = top.where((F.col("vtype") == 1) | ~F.col("_base"))
    return new.select("user_key", "seq", "vtype", "val").unionByName(kept.select("user_key", "seq", "vtype", "val"))


def file_table(log: DataFrame) -> DataFrame:
    """log with level and number -> one row a file."""
    return log.groupBy("level", "number").agg(F.count("*").alias("rows"), (F.count("*") * 32).alias("file_size"), F.min("user_key").alias("smallest"), F.max("user_key").alias("largest"), F.min("seq").alias("smallest_seq"), F.max("seq").alias("largest_seq"))


def level_bytes(files: DataFrame) -> DataFrame:
    return files.groupBy("level").agg(F.count("*").alias("files"), F.sum("file_size").alias("bytes"))


def scores(files: DataFrame, base: int = LEVEL_BASE) -> DataFrame:
    """Level 0 by its number of files, deeper levels by bytes against their budget; the last level has none."""
    budget = F.lit(float(base)) * F.pow(F.lit(float(LEVEL_FACTOR)), F.col("level") - 1)
    score = F.when(F.col("level") == 0, F.col("files") / float(LEVEL0_FILES)).otherwise(F.col("bytes") / budget)
    return level_bytes(files).where(F.col("level") < LEVELS - 1).select("level", "files", "bytes", score.alias("score"))


def picked_level(files: DataFrame, base: int = LEVEL_BASE) -> DataFrame:
    """The level to compact: the highest score of 1 or more, ties to the deeper one."""
    return scores(files, base).where("score >= 1").orderBy(F.desc("score"), F.desc("level")).limit(1)


def next_file(files: DataFrame, level: int, cursor=None) -> DataFrame:
    """The file of a level after the cursor (its last compacted largest key), or the first."""
    own = files.where(F.col("level") == level)
    first = F.lit(0) if cursor is None else F.when(F.col("smallest") > F.lit(cursor), 0).otherwise(1)
    return own.orderBy(first, "smallest").limit(1)


def overlapping(files: DataFrame, smallest, largest) -> DataFrame:
    return files.where((F.col("smallest") <= F.lit(largest)) & (F.col("largest") >= F.lit(smallest)))


def inputs_below(files: DataFrame, level: int) -> DataFrame:
    """Files of the next level that overlap the key range of all of a level's files."""
    span = files.where(F.col("level") == level).agg(F.min("smallest").alias("lo"), F.max("largest").alias("hi"))
    below = files.where(F.col("level") == level + 1)
    return below.join(F.broadcast(span), (F.col("smallest") <= F.col("hi")) & (F.col("largest") >= F.col("lo"))).select(*files.columns)


def candidates(files: DataFrame, probes: DataFrame) -> DataFrame:
    """probes (user_key) -> the files that may hold each key, with the order in which they are asked."""
    hit = held_by(probes, files)
    order = F.row_number().over(Window.partitionBy("user_key").orderBy("level", F.desc("number")))
    return hit.select("user_key", "level", "number", order.cast("long").alias("asked"))


def overlap_violations(files: DataFrame) -> DataFrame:
    """Neighbours of a level below 0 that share a key; empty if the version is valid."""
    before = F.lag("largest").over(Window.partitionBy("level").orderBy("smallest", "number"))
    return files.where("level >= 1").withColumn("before", before).where(F.col("before") >= F.col("smallest")).select("level", "number", "smallest", "before")


def applied(files: DataFrame, deleted: DataFrame, added: DataFrame) -> DataFrame:
    """base - deleted + added."""
    return files.join(deleted, ["level", "number"], "left_anti").unionByName(added)


def shape(files: DataFrame) -> DataFrame:
    """Files a level as text, level 0 first, empty levels as 0 down to the deepest."""
    counts = files.groupBy("level").count()
    have = counts.agg(F.map_from_entries(F.collect_list(F.struct("level", "count"))).alias("m"), F.max("level").alias("top"))
    text = F.array_join(F.transform(F.sequence(F.lit(0), "top"), lambda i: F.coalesce(F.element_at("m", i), F.lit(0)).cast("string")), " / ")
    return have.select(text.alias("shape"))


def offset_of(files: DataFrame, key) -> DataFrame:
    """Bytes of files that lie wholly before a key."""
    return files.agg(F.coalesce(F.sum(F.when(F.col("largest") < F.lit(key), F.col("file_size"))), F.lit(0)).alias("offset"))
