"""Reads of the log: the user view as of a sequence, lookups, scans, seeks.

The log has user_key, seq, vtype (1: value, 0: tombstone) and val. Versions are visible up to and with the sequence
asked for; the newest visible one decides, and only then a tombstone hides its key. Newest-per-key is an aggregation
(partial before the shuffle), so that a key with very many versions is no bottleneck; bounds on the key reach the scan.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window, functions as F

from loam.operators.prefix import cuts_of, directions, part_of, parts_for

LOG_COLUMNS = ("user_key", "seq", "vtype", "val")
MAX_SEQUENCE = 2**56 - 1


def bounded(df: DataFrame, lower=None, upper=None) -> DataFrame:
    """Keys in [lower, upper)."""
    if lower is not None:
        df = df.where(F.col("user_key") >= F.lit(lower))
    return df if upper is None else df.where(F.col("user_key") < F.lit(upper))


def validated(log: DataFrame) -> DataFrame:
    """The log, failing on a row of unknown type or sequence out of range when it is read."""
    ok = F.col("vtype").isin(0, 1) & F.col("seq").between(0, MAX_SEQUENCE) & F.col("user_key").isNotNull()
    return log.where(F.when(F.coalesce(ok, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit("corruption: malformed log row")).cast("boolean")))


def newest(log: DataFrame, as_of: int | None = None, lower=None, upper=None) -> DataFrame:
    """One row a key: its newest visible version, tombstones included."""
    rows = bounded(log, lower, upper)
    if as_of is not None:
        rows = rows.where(F.col("seq") <= F.lit(as_of))
    return rows.groupBy("user_key").agg(F.max_by("vtype", "seq").alias("vtype"), F.max_by("val", "seq").alias("val"), F.max("seq").alias("seq")).select(*LOG_COLUMNS)


def visible(log: DataFrame, as_of: int | None = None, lower=None, upper=None) -> DataFrame:
    """The user view: user_key, seq, val of live keys."""
    return newest(log, as_of, lower, upper).where("vtype = 1").select("user_key", "seq", "val")


def keys(log: DataFrame, as_of: int | None = None) -> DataFrame:
    """Live keys; values are not read."""
    rows = log if as_of is None else log.where(F.col("seq") <= F.lit(as_of))
    return rows.groupBy("user_key").agg(F.max_by("vtype", "seq").alias("vtype")).where("vtype = 1").select("user_key")


def get(log: DataFrame, key, as_of: int | None = None) -> DataFrame:
    return visible(log.where(F.col("user_key") == F.lit(key)), as_of)


def multi_get(log: DataFrame, probes: DataFrame, parts: int | None = None) -> DataFrame:
    """probes (probe_id, user_key, as_of or null) -> probe_id, user_key, as_of, state, seq, val; one row a probe.

    state is Found, Deleted or NotPresent. Versions and probes go into one order by key and sequence, cut into parts of
    about equal size; inside a part each probe takes the last version before it, and a part's first probes take the last
    version of an earlier part. Linear in versions and probes, also for a key that holds most of them. Ids may be null
    or repeated: nothing is grouped by them. A null key is NotPresent.
    """
    version = F.struct(F.col("user_key").alias("k"), "seq", "vtype", "val")
    rows = log.select("user_key", F.col("seq").alias("_at"), F.lit(0).alias("_kind"), F.lit(0).alias("_tie"), version.alias("_v"))
    # equal probes are told apart by where they were read, so that very many of them are cut too
    asked = probes.select("user_key", F.coalesce("as_of", F.lit(MAX_SEQUENCE)).cast("long").alias("_at"), F.lit(1).alias("_kind"), F.spark_partition_id().alias("_tie"), F.struct("probe_id", "as_of").alias("_p"))
    both = rows.unionByName(asked, allowMissingColumns=True)
    order = [(c, True) for c in ("user_key", "_at", "_kind", "_tie")]
    cuts = cuts_of(both, order, parts_for(both, parts))
    placed = both.withColumn("_part", part_of(order, cuts))
    near = Window.partitionBy("_part").orderBy(*directions(order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    best = placed.withColumn("_v", F.last("_v", True).over(near)).where("_kind = 1")
    if cuts:
        # what a part's first probes may need: the last version, in the parts before, of the key at the cut
        next_keys = F.array(*(F.lit(cut.user_key) for cut in cuts))
        ends = rows.withColumn("_part", part_of(order, cuts)).where(F.col("user_key") == F.get(next_keys, F.col("_part")))
        ends = ends.groupBy("_part").agg(F.max_by("_v", "_at").alias("_end"))
        every = log.sparkSession.range(len(cuts) + 1).select(F.col("id").cast("int").alias("_part"))  # a row a part
        earlier = F.last("_end", True).over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
        borders = every.join(ends, "_part", "left").select("_part", earlier.alias("_earlier"))
        best = best.join(F.broadcast(borders), "_part").withColumn("_v", F.when(F.col("_v.k") == F.col("user_key"), F.col("_v")).otherwise(F.col("_earlier")))
    hit = F.when(F.col("_v.k") == F.col("user_key"), F.col("_v"))
    state = F.when(hit.isNull(), "NotPresent").when(hit["vtype"] == 0, "Deleted").otherwise("Found")
    found = hit["vtype"] == 1
    return best.select("_p.probe_id", "user_key", "_p.as_of", state.alias("state"), F.when(found, hit["seq"]).alias("seq"), F.when(found, hit["val"]).alias("val"))


def seek(log: DataFrame, target=None, n: int = 1, as_of: int | None = None, lower=None, upper=None, descending: bool = False, exclusive: bool = False) -> DataFrame:
    """The first n live rows at or after target (descending: at or before); a target outside the bounds is moved to them."""
    rows = bounded(log, lower, upper)
    if target is not None:
        k = F.col("user_key")
        rows = rows.where((k < F.lit(target) if exclusive else k <= F.lit(target)) if descending else (k > F.lit(target) if exclusive else k >= F.lit(target)))
    return visible(rows, as_of).orderBy(F.desc("user_key") if descending else F.asc("user_key")).limit(n)


def seek_many(log: DataFrame, probes: DataFrame, n: int, as_of: int | None = None) -> DataFrame:
    """probes (probe_id, target) -> probe_id, target, nth, user_key, seq, val: the first n live rows at or after each target.

    Live keys and targets go into one order, cut into parts of about equal size. With the counts of live keys in the parts
    before, a running count gives each key its rank and each target the number of live keys before it. Ranks are dealt to
    blocks of 2n, each half of which is in two blocks, so that one block has all n rows of a target: a target meets one row,
    and only then becomes n. Linear in keys, probes and rows returned, and no part of it is one task. A target past the
    last key, or null, has no rows.
    """
    live = visible(log, as_of).withColumns({"_kind": F.lit(1), "_tie": F.lit(0)})
    asked = probes.where("target is not null").select(F.col("target").alias("user_key"), "probe_id", F.lit(0).alias("_kind"), F.coalesce("probe_id", F.lit(0)).alias("_tie"))
    both = live.drop("seq", "val").unionByName(asked, allowMissingColumns=True)
    order = [(c, True) for c in ("user_key", "_kind", "_tie")]
    cuts = cuts_of(both, order, parts_for(both, None))
    part = part_of(order, cuts)
    sizes = dict(live.groupBy(part.alias("_part")).count().collect())
    earlier = accumulate((sizes.get(k, 0) for k in range(len(cuts))), initial=0)
    base = F.get(F.array(*(F.lit(x).cast("long") for x in earlier)), F.col("_part"))
    near = Window.partitionBy("_part").orderBy(*directions(order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = lambda df: df.withColumn("_part", part).withColumn("_rank", base + F.sum("_kind").over(near))
    block = F.expr(f"(_rank - 1) div {n}")
    rows = ranked(live).select("_rank", F.explode(F.array(block - 1, block)).alias("_block"), "user_key", "seq", "val").where("_block >= 0")
    by_rank = lambda a, b: (a["_rank"] - b["_rank"]).cast("int")
    blocks = rows.groupBy("_block").agg(F.array_sort(F.collect_list(F.struct("_rank", "user_key", "seq", "val")), by_rank).alias("_rows"))
    wanted = ranked(both).where((F.col("_kind") == 0) & (F.col("_rank") < sum(sizes.values()))).select("probe_id", F.col("user_key").alias("target"), F.expr(f"_rank div {n}").alias("_block"), (F.col("_rank") % n).cast("int").alias("_at"))
    # merged whatever Spark takes their sizes for: it would broadcast the targets where it takes them for few
    found = wanted.join(blocks.hint("merge"), "_block").select("probe_id", "target", F.posexplode(F.slice("_rows", F.col("_at") + 1, n)).alias("_nth", "_row"))
    return found.select("probe_id", "target", (F.col("_nth") + 1).alias("nth"), "_row.user_key", "_row.seq", "_row.val")


def page(log: DataFrame, after=None, n: int = 100, as_of: int | None = None, descending: bool = False) -> DataFrame:
    """The n live rows that follow a key: Next and Prev, many at once."""
    return seek(log, after, n, as_of, descending=descending, exclusive=after is not None)


def scan(log: DataFrame, lower=None, upper=None, as_of: int | None = None, descending: bool = False) -> DataFrame:
    return visible(log, as_of, lower, upper).orderBy(F.desc("user_key") if descending else F.asc("user_key"))


def merged(runs: list[DataFrame]) -> DataFrame:
    """All versions of several runs, in internal order (key ascending, sequence descending)."""
    out = runs[0]
    for r in runs[1:]:
        out = out.unionByName(r)
    return out.orderBy("user_key", F.desc("seq"))


def printable(c: Column) -> Column:
    """Bytes as text: printable ASCII but the backslash as it is, all else as \\xNN."""
    hexed = F.hex(c)
    pairs = F.regexp_extract_all(hexed, F.lit("(..)"), F.lit(1))
    one = lambda p: F.when(p.between("20", "7E") & (p != "5C"), F.decode(F.unhex(p), "US-ASCII")).otherwise(F.concat(F.lit("\\x"), F.lower(p)))
    return F.array_join(F.transform(pairs, one), "")


def dump(log: DataFrame) -> DataFrame:
    """One line of text a version."""
    head = F.concat(F.lit("'"), printable(F.col("user_key").cast("binary")), F.lit("' @ "), F.col("seq").cast("string"))
    line = F.concat(head, F.when(F.col("vtype") == 0, F.lit(" DEL")).otherwise(F.concat(F.lit(" PUT => '"), printable(F.col("val").cast("string").cast("binary")), F.lit("'"))))
    return log.select("user_key", "seq", line.alias("line"))
