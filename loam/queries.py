"""The operators as queries over the tables of a folder, each with the SQL that states it.

The log of versions is made from `events`: the key is user_id in 16 digits, the sequence is event_id + 1, and an event of
type `error` is a delete. The tree of files is made from the same log: the last two tenths of the sequences are in memory,
four tenths are files of level 0, two tenths each are levels 1 and 2, in four key ranges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loam.functions import codecs, workload
from loam.operators import compaction, stats, view
from loam.operators.prefix import positions, running

PERCENTS = [50.0, 90.0, 99.0, 99.9]
LOW, HIGH = "0000000000000010", "0000000000000040"
KEY, MISSING = "0000000000000007", "0000000000000007."


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = F.col("event_type") != "error"
    return _table(spark, sf_dir, "events").select(workload.key(F.col("user_id")).alias("user_key"), (F.col("event_id") + 1).alias("seq"), live.cast("int").alias("vtype"), F.when(live, F.col("value")).alias("val"))


def size(spark: SparkSession, sf_dir: str) -> int:
    return _table(spark, sf_dir, "events").count()


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log with level and number of each version's file; level -1 is memory."""
    events = _table(spark, sf_dir, "events")
    n, top = events.agg(F.count("*"), F.max("user_id") + 1).first()
    band = F.expr(f"((seq - 1) * 10) div {n}")
    part = F.expr(f"(cast(user_key as bigint) * 4) div {top}")
    out = log(spark, sf_dir).withColumn("band", band)
    level = F.when(F.col("band") >= 8, -1).when(F.col("band") >= 4, 0).when(F.col("band") >= 2, 1).otherwise(2)
    number = F.when(F.col("band") >= 8, 0).when(F.col("band") >= 4, F.col("band") - 3).otherwise(F.lit(10) * level + part)
    return out.select("user_key", "seq", "vtype", "val", level.alias("level"), number.cast("long").alias("number"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compaction.file_table(tree(spark, sf_dir).where("level >= 0"))


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys are spread over twice the range of users, so that about half of them are absent."""
    orders = _table(spark, sf_dir, "orders")
    n, twice = _table(spark, sf_dir, "events").agg(F.count("*"), 2 * (F.max("user_id") + 1)).first()
    return orders.select(F.col("o_orderkey").alias("probe_id"), workload.key(F.col("o_custkey") % twice).alias("user_key"), (F.col("o_orderkey") * 7919 % n).alias("as_of"))


_LOG = "L AS (SELECT lpad(user_id::VARCHAR, 16, '0') AS user_key, event_id + 1 AS seq, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS vtype, CASE WHEN event_type <> 'error' THEN value END AS val FROM events), C AS (SELECT count(*) AS n, max(user_id) + 1 AS top FROM events)"
_TREE = _LOG + ", B AS (SELECT L.*, ((seq - 1) * 10) // n AS band, (user_key::BIGINT * 4) // top AS part FROM L, C), T AS (SELECT user_key, seq, vtype, val, CASE WHEN band >= 8 THEN -1 WHEN band >= 4 THEN 0 WHEN band >= 2 THEN 1 ELSE 2 END AS level, CASE WHEN band >= 8 THEN 0 WHEN band >= 4 THEN band - 3 WHEN band >= 2 THEN 10 + part ELSE 20 + part END AS number FROM B), F AS (SELECT level, number, count(*) AS rows, count(*) * 32 AS file_size, min(user_key) AS smallest, max(user_key) AS largest, min(seq) AS smallest_seq, max(seq) AS largest_seq FROM T WHERE level >= 0 GROUP BY level, number)"


def _newest(where: str = "true", of: str = "L") -> str:
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_key ORDER BY seq DESC) AS rn FROM {of} WHERE {where}) WHERE rn = 1)"


def _view(where: str = "true", tail: str = "") -> str:
    return f"WITH {_LOG} SELECT user_key, seq, val FROM {_newest(where)} WHERE vtype = 1 {tail}"


_ENTRIES: dict[str, tuple] = {}


def query(sql: str | None):
    def add(f):
        _ENTRIES[f.__name__] = (f, sql)
        return f

    return add


@query(_view())
def latest_view(spark, d):
    return view.visible(log(spark, d))


@query(f"WITH {_LOG} SELECT user_key FROM {_newest()} WHERE vtype = 1")
def latest_keys(spark, d):
    return view.keys(log(spark, d))


@query(_view("seq <= (SELECT n // 2 FROM C)"))
def snapshot_view(spark, d):
    return view.visible(log(spark, d), size(spark, d) // 2)


@query(_view(f"user_key >= '{LOW}' AND user_key < '{HIGH}'"))
def bounded_scan(spark, d):
    return view.scan(log(spark, d), LOW, HIGH)


@query(_view(f"user_key = '{KEY}'"))
def point_get(spark, d):
    return view.get(log(spark, d), KEY)


@query(_view(f"user_key = '{MISSING}'"))
def point_get_missing(spark, d):
    return view.get(log(spark, d), MISSING)


@query(_view(f"user_key = '{KEY}' AND seq <= (SELECT n // 3 FROM C)"))
def point_get_as_of(spark, d):
    return view.get(log(spark, d), KEY, size(spark, d) // 3)


_PROBES = _LOG + ", P AS (SELECT o_orderkey AS probe_id, lpad((o_custkey % (2 * top))::VARCHAR, 16, '0') AS user_key, o_orderkey * 7919 % n AS as_of FROM orders, C), H AS (SELECT probe_id, L.seq, vtype, val, row_number() OVER (PARTITION BY probe_id ORDER BY L.seq DESC) AS rn FROM P JOIN L ON P.user_key = L.user_key AND seq <= as_of)"


@query(f"WITH {_PROBES} SELECT P.probe_id, user_key, as_of, CASE WHEN vtype IS NULL THEN 'NotPresent' WHEN vtype = 0 THEN 'Deleted' ELSE 'Found' END AS state, CASE WHEN vtype = 1 THEN seq END AS seq, CASE WHEN vtype = 1 THEN val END AS val FROM P LEFT JOIN (SELECT * FROM H WHERE rn = 1) h ON P.probe_id = h.probe_id")
def asof_multi_get(spark, d):
    return view.multi_get(log(spark, d), probes(spark, d))


@query(f"WITH {_LOG}, P AS (SELECT lpad(i::VARCHAR, 16, '0') AS user_key FROM range(0, (SELECT 2 * top FROM C)) r(i)) SELECT P.user_key, CASE WHEN vtype IS NULL THEN 'NotPresent' WHEN vtype = 0 THEN 'Deleted' ELSE 'Found' END AS state FROM P LEFT JOIN {_newest('seq <= (SELECT n // 2 FROM C)')} v ON P.user_key = v.user_key")
def lookup_state(spark, d):
    """Every user's key, and as many that no user has."""
    n, top = _table(spark, d, "events").agg(F.count("*"), F.max("user_id") + 1).first()
    p = spark.range(2 * top).select(F.col("id").alias("probe_id"), workload.key(F.col("id")).alias("user_key"), F.lit(n // 2).cast("long").alias("as_of"))
    return view.multi_get(log(spark, d), p).select("user_key", "state")


_HOT = _LOG.replace("lpad(user_id::VARCHAR, 16, '0') AS user_key", "CASE WHEN event_id % 3 = 0 THEN 'hot' ELSE lpad(user_id::VARCHAR, 16, '0') END AS user_key")


@query(f"WITH {_HOT}, P AS (SELECT CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 5 END AS probe_id, CASE o_orderkey % 3 WHEN 0 THEN 'hot' WHEN 1 THEN lpad((o_custkey % (2 * top))::VARCHAR, 16, '0') END AS user_key, CASE WHEN o_orderkey % 7 > 0 THEN o_orderkey * 7919 % n END AS as_of, row_number() OVER () AS r FROM orders, C), D AS (SELECT DISTINCT user_key AS k, as_of AS a FROM P), H AS (SELECT k, a, max(seq) AS s FROM D JOIN L ON k = user_key AND (a IS NULL OR seq <= a) GROUP BY k, a) SELECT probe_id, P.user_key, as_of, CASE WHEN vtype IS NULL THEN 'NotPresent' WHEN vtype = 0 THEN 'Deleted' ELSE 'Found' END AS state, CASE WHEN vtype = 1 THEN seq END AS seq, CASE WHEN vtype = 1 THEN val END AS val FROM P LEFT JOIN H ON P.user_key = k AND as_of IS NOT DISTINCT FROM a LEFT JOIN L ON L.user_key = k AND seq = s")
def asof_multi_get_hot(spark, d):
    """A key with a third of all versions and probes; ids, keys and sequences that are null or repeated."""
    n, top = _table(spark, d, "events").agg(F.count("*"), F.max("user_id") + 1).first()
    o = F.col("o_orderkey")
    hot = log(spark, d).withColumn("user_key", F.when(F.col("seq") % 3 == 1, "hot").otherwise(F.col("user_key")))
    asked = _table(spark, d, "orders").select(F.when(o % 4 > 0, o % 5).alias("probe_id"), F.when(o % 3 == 0, "hot").when(o % 3 == 1, workload.key(F.col("o_custkey") % (2 * top))).alias("user_key"), F.when(o % 7 > 0, o * 7919 % n).alias("as_of"))
    return view.multi_get(hot, asked)


@query(_view(f"user_key >= '{LOW}'", "ORDER BY user_key LIMIT 20"))
def seek_n(spark, d):
    return view.seek(log(spark, d), LOW, 20)


@query(_view(f"user_key <= '{HIGH}'", "ORDER BY user_key DESC LIMIT 20"))
def seek_last_n(spark, d):
    return view.seek(log(spark, d), HIGH, 20, descending=True)


@query(_view(f"user_key > '{LOW}'", "ORDER BY user_key LIMIT 10"))
def next_page(spark, d):
    return view.page(log(spark, d), LOW, 10)


@query(f"WITH {_LOG} SELECT user_key, seq, vtype, row_number() OVER (ORDER BY user_key, seq DESC) AS position FROM L")
def merged_log(spark, d):
    return positions(log(spark, d).select("user_key", "seq", "vtype"), [("user_key", True), ("seq", False)], "position")


_COMPACTED = "SELECT user_key, seq, vtype, val FROM (SELECT *, lag(seq) OVER (PARTITION BY user_key ORDER BY seq DESC) AS newer FROM {0}) WHERE NOT (coalesce(newer <= (SELECT n * 6 // 10 FROM C), false) OR (vtype = 0 AND seq <= (SELECT n * 6 // 10 FROM C) AND {1}))"


@query(f"WITH {_LOG} " + _COMPACTED.format("L", "true"))
def compacted_log(spark, d):
    return compaction.compacted(log(spark, d), size(spark, d) * 6 // 10)


@query(f"WITH {_TREE}, I AS (SELECT T.*, NOT EXISTS (SELECT 1 FROM F WHERE F.level = 2 AND T.user_key BETWEEN smallest AND largest) AS base FROM T WHERE level IN (0, 1)) " + _COMPACTED.format("I", "base"))
def compacted_log_with_deeper_levels(spark, d):
    t = tree(spark, d)
    deeper = compaction.file_table(t.where("level = 2"))
    return compaction.compacted(compaction.with_base(t.where("level in (0, 1)"), deeper), size(spark, d) * 6 // 10, F.col("base"))


@query(_view())
def view_after_compaction(spark, d):
    return view.visible(compaction.compacted(log(spark, d), size(spark, d) * 6 // 10))


@query(f"WITH {_LOG} SELECT user_key, count(*) AS versions, sum(CASE WHEN vtype = 0 THEN 1 ELSE 0 END)::BIGINT AS tombstones FROM L GROUP BY user_key")
def versions_per_key(spark, d):
    return log(spark, d).groupBy("user_key").agg(F.count("*").alias("versions"), F.sum((F.col("vtype") == 0).cast("long")).alias("tombstones"))


@query(f"WITH {_LOG}, v AS (SELECT count(*) AS live FROM {_newest()} WHERE vtype = 1), k AS (SELECT count(*) AS kept FROM (" + _COMPACTED.format("L", "true") + ")) SELECT n AS versions, live, kept, round(n / live, 6) AS before, round(kept / live, 6) AS after FROM C, v, k")
def space_amplification(spark, d):
    every = log(spark, d)
    n = size(spark, d)
    live = view.keys(every).agg(F.count("*").alias("live"))
    kept = compaction.compacted(every, n * 6 // 10).agg(F.count("*").alias("kept"))
    both = live.crossJoin(kept)
    return both.select(F.lit(n).cast("long").alias("versions"), "live", "kept", F.round(F.lit(n) / F.col("live"), 6).alias("before"), F.round(F.col("kept") / F.col("live"), 6).alias("after"))


@query(f"WITH {_TREE} SELECT * FROM F")
def file_metadata(spark, d):
    return files(spark, d)


@query(f"WITH {_TREE} SELECT level, count(*) AS files, sum(file_size)::BIGINT AS bytes FROM F GROUP BY level")
def level_bytes(spark, d):
    return compaction.level_bytes(files(spark, d))


@query(f"WITH {_TREE}, G AS (SELECT level, count(*) AS files, sum(file_size)::BIGINT AS bytes FROM F GROUP BY level) SELECT level, files, bytes, round(CASE WHEN level = 0 THEN files / 4.0 ELSE bytes / (20000.0 * pow(10, level - 1)) END, 6) AS score FROM G")
def compaction_score(spark, d):
    return compaction.scores(files(spark, d), 20000).withColumn("score", F.round("score", 6))


@query(f"WITH {_TREE}, G AS (SELECT level, count(*) AS files, sum(file_size) AS bytes FROM F GROUP BY level), S AS (SELECT level, CASE WHEN level = 0 THEN files / 4.0 ELSE bytes / (20000.0 * pow(10, level - 1)) END AS score FROM G) SELECT level, round(score, 6) AS score FROM S WHERE score >= 1 ORDER BY score DESC, level DESC LIMIT 1")
def compaction_pick(spark, d):
    return compaction.picked_level(files(spark, d), 20000).select("level", F.round("score", 6).alias("score"))


@query(f"WITH {_TREE} SELECT level, number FROM F WHERE level = 1 ORDER BY smallest > '{HIGH}' DESC, smallest LIMIT 1")
def compaction_next_file(spark, d):
    return compaction.next_file(files(spark, d), 1, HIGH).select("level", "number")


@query(f"WITH {_TREE}, P AS (SELECT DISTINCT lpad((o_custkey % (2 * top))::VARCHAR, 16, '0') AS user_key FROM orders, C) SELECT user_key, level, number, row_number() OVER (PARTITION BY user_key ORDER BY level, number DESC) AS asked FROM P JOIN F ON user_key BETWEEN smallest AND largest")
def lookup_candidates(spark, d):
    return compaction.candidates(files(spark, d), probes(spark, d).select("user_key").distinct())


@query(f"WITH {_TREE} SELECT level, number, smallest, before FROM (SELECT *, lag(largest) OVER (PARTITION BY level ORDER BY smallest, number) AS before FROM F WHERE level >= 1) WHERE before >= smallest")
def level_overlap_violations(spark, d):
    return compaction.overlap_violations(files(spark, d))


@query(f"WITH {_TREE}, D AS (SELECT level, number, smallest, CASE WHEN level = 1 AND number % 2 = 0 THEN smallest || 'x' WHEN level = 2 AND number % 2 = 1 THEN '{'9' * 16}' ELSE largest END AS largest FROM F) SELECT level, number, smallest, before FROM (SELECT *, lag(largest) OVER (PARTITION BY level ORDER BY smallest, number) AS before FROM D WHERE level >= 1) WHERE before >= smallest")
def level_overlap_violations_damaged(spark, d):
    """Every other file of level 2 reaches over its neighbours; files of level 1 only shrink, which is no violation."""
    level, odd = F.col("level"), F.col("number") % 2 == 1
    reach = F.when((level == 1) & ~odd, F.concat("smallest", F.lit("x"))).when((level == 2) & odd, "9" * 16).otherwise(F.col("largest"))
    return compaction.overlap_violations(files(spark, d).withColumn("largest", reach))


@query(f"WITH {_TREE} SELECT F.* FROM F, (SELECT min(smallest) AS lo, max(largest) AS hi FROM F WHERE level = 1) WHERE level = 2 AND smallest <= hi AND largest >= lo")
def compaction_inputs_below(spark, d):
    return compaction.inputs_below(files(spark, d), 1)


@query(f"WITH {_TREE} SELECT min(smallest) AS smallest, max(largest) AS largest FROM F WHERE level = 0")
def key_range(spark, d):
    return files(spark, d).where("level = 0").agg(F.min("smallest").alias("smallest"), F.max("largest").alias("largest"))


@query(f"WITH {_TREE} SELECT coalesce(sum(CASE WHEN largest < '{HIGH}' THEN file_size END), 0)::BIGINT AS \"offset\" FROM F")
def approximate_offset(spark, d):
    return compaction.offset_of(files(spark, d), HIGH)


@query(f"WITH {_TREE} SELECT string_agg(n::VARCHAR, ' / ' ORDER BY level) AS shape FROM (SELECT level, count(*) AS n FROM F GROUP BY level)")
def database_shape(spark, d):
    return compaction.shape(files(spark, d))


@query(f"WITH {_LOG} SELECT user_key, seq, vtype FROM L, C WHERE seq <= n * 7 // 10")
def replay_dedupe(spark, d):
    n = size(spark, d)
    every = log(spark, d).select("user_key", "seq", "vtype")
    done, replayed = every.where(F.col("seq") <= n * 5 // 10), every.where(F.col("seq").between(n * 3 // 10 + 1, n * 7 // 10))
    return done.unionByName(replayed.join(done.select("seq"), "seq", "left_anti"))


@query(f"WITH {_TREE} SELECT level, number, rows, smallest, largest FROM F WHERE level <> 0 UNION ALL SELECT 1, 99, rows, 'x' || smallest, 'x' || largest FROM F WHERE level = 0 AND number = 1")
def apply_edit(spark, d):
    f = files(spark, d).select("level", "number", "rows", "smallest", "largest")
    top = f.where("level = 0")
    added = top.where("number = 1").select(F.lit(1).alias("level"), F.lit(99).cast("long").alias("number"), "rows", F.concat(F.lit("x"), "smallest").alias("smallest"), F.concat(F.lit("x"), "largest").alias("largest"))
    return compaction.applied(f, top.select("level", "number"), added)


def _samples(spark, d):
    return _table(spark, d, "orders").select(F.floor("o_totalprice").cast("long").alias("value"))


_HIST = "V AS (SELECT floor(o_totalprice)::BIGINT AS value FROM orders), W AS (SELECT value, CASE WHEN value < 16 THEN value ELSE 16 * (length(bin(value)) - 5) + (value >> (length(bin(value)) - 5)) END AS bucket FROM V), N AS (SELECT bucket, count(*) AS n FROM W GROUP BY bucket), H AS (SELECT bucket, CASE WHEN bucket < 16 THEN bucket ELSE (bucket % 16 + 16) << (bucket // 16 - 1)::INT END AS low, CASE WHEN bucket + 1 < 16 THEN bucket + 1 ELSE ((bucket + 1) % 16 + 16) << ((bucket + 1) // 16 - 1)::INT END AS high, n FROM N)"


@query(f"WITH {_HIST} SELECT bucket::BIGINT AS bucket, low::BIGINT AS low, high::BIGINT AS high, n FROM H")
def histogram_buckets(spark, d):
    return stats.histogram(_samples(spark, d))


@query(f"WITH {_HIST} SELECT count(*) AS n, min(value) AS least, max(value) AS most, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS deviation FROM V")
def histogram_stats(spark, d):
    return stats.summary(_samples(spark, d)).select("n", "least", "most", F.round("mean", 4).alias("mean"), F.round("deviation", 4).alias("deviation"))


@query(f"WITH {_HIST}, U AS (SELECT *, sum(n) OVER (ORDER BY bucket) AS upto FROM H), S AS (SELECT count(*) AS total, min(value) AS least, max(value) AS most FROM V), Q AS (SELECT p::DOUBLE AS p FROM (VALUES (50.0), (90.0), (99.0), (99.9)) x(p)), R AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY bucket) AS rn FROM U, S, Q WHERE upto >= total * p / 100) SELECT p, round(greatest(least::DOUBLE, least(most::DOUBLE, low + (high - low) * ((total * p / 100 - (upto - n)) / n))), 6) AS value FROM R WHERE rn = 1")
def histogram_percentiles(spark, d):
    return stats.percentiles(_samples(spark, d), PERCENTS).select("p", F.round("value", 6).alias("value"))


@query("SELECT workload, n, round(median, 6) AS median, round(mean, 6) AS mean, least, most, round(cv, 6) AS cv, cv <= 0.05 AS stable, cv <= 0.05 AND n >= 5 AS publishable FROM (SELECT workload, count(*) AS n, median(value) AS median, avg(value) AS mean, min(value) AS least, max(value) AS most, CASE WHEN count(*) < 2 OR avg(value) = 0 THEN 0 ELSE stddev_samp(value) / abs(avg(value)) END AS cv FROM (SELECT l_returnflag AS workload, l_extendedprice AS value FROM lineitem UNION ALL SELECT 'steady', 100.0 + l_linenumber % 3 FROM lineitem) GROUP BY workload)")
def round_summary(spark, d):
    rows = _table(spark, d, "lineitem")
    measured = rows.select(F.col("l_returnflag").alias("workload"), F.col("l_extendedprice").alias("value")).union(rows.select(F.lit("steady"), (F.lit(100.0) + F.col("l_linenumber") % 3)))
    return stats.rounds(measured).select("workload", "n", *(F.round(c, 6).alias(c) for c in ("median", "mean")), "least", "most", F.round("cv", 6).alias("cv"), "stable", "publishable")


@query(f"WITH {_LOG} SELECT 1000 AS payload, n AS flushed, n * 3 AS compacted, round((n + n * 3) / 1000.0, 6) AS amplification FROM C")
def write_amplification(spark, d):
    n = size(spark, d)
    rows = _table(spark, d, "events").agg(F.lit(1000).alias("payload"), F.count("*").alias("flushed"), (F.count("*") * 3).alias("compacted"))
    return stats.write_amplification(rows).withColumn("amplification", F.round("amplification", 6))


SEED = 42
_U = workload.uniform_sql("event_id", SEED)
_ZETA = "Z AS (SELECT n, (SELECT sum(pow(r::DOUBLE, -0.99)) FROM range(1, n + 1) x(r)) AS z, 1 + pow(0.5, 0.99) AS z2 FROM C)"


def _drawn(spark, d):
    return _table(spark, d, "events").select("event_id", workload.uniform(F.col("event_id"), SEED).alias("u"))


@query(f"WITH {_LOG} SELECT event_id AS i, {_U} AS u, {workload.uniform_sql('event_id * 1000003', 7)} AS other FROM events")
def uniform_draws(spark, d):
    return _drawn(spark, d).select(F.col("event_id").alias("i"), "u", workload.uniform(F.col("event_id") * 1000003, 7).alias("other"))


@query(f"WITH {_LOG}, {_ZETA}, U AS (SELECT event_id AS i, {_U} AS u FROM events), R AS (SELECT i, n, CASE WHEN u * z < 1 THEN 0 WHEN u * z < 1 + pow(0.5, 0.99) THEN 1 ELSE least(floor(n * pow((1 - pow(2.0 / n, 0.01)) / (1 - z2 / z) * u - (1 - pow(2.0 / n, 0.01)) / (1 - z2 / z) + 1, 1 / (1 - 0.99::DOUBLE))), n - 1) END AS rank FROM U, Z) SELECT i, rank::BIGINT AS rank, ((rank::BIGINT + 1) * 4294967291) % n AS scrambled FROM R")
def zipf_scramble(spark, d):
    n = size(spark, d)
    rows = _drawn(spark, d).select(F.col("event_id").alias("i"), workload.zipf_rank(F.col("u"), n).alias("rank"))
    return rows.select("i", "rank", workload.scramble(F.col("rank"), n).alias("scrambled"))


def _arrivals(spark, d):
    rows = _drawn(spark, d).select(F.col("event_id").alias("i"), workload.gap_ns(F.col("u"), 1e5).alias("gap"), (F.lit(2000) + (F.col("event_id") * 2654435761) % 9000).alias("service"))
    return running(rows, "i", "gap", "scheduled")


_ARRIVALS = f"A AS (SELECT event_id AS i, floor(-ln(1 - {_U}) * 10000.0)::BIGINT AS gap, 2000 + (event_id * 2654435761) % 9000 AS service FROM events), S AS (SELECT *, (sum(gap) OVER (ORDER BY i))::BIGINT AS scheduled, (sum(service) OVER (ORDER BY i))::BIGINT AS busy FROM A)"


@query(f"WITH {_ARRIVALS} SELECT i, gap, scheduled FROM S")
def poisson_schedule(spark, d):
    return _arrivals(spark, d).select("i", "gap", "scheduled")


@query(f"WITH {_ARRIVALS}, E AS (SELECT *, max(scheduled - (busy - service)) OVER (ORDER BY i) + busy AS ended FROM S) SELECT i, scheduled, ended, ended - scheduled AS response, ended - service - scheduled AS waited FROM E")
def open_loop_latency(spark, d):
    # one worker: a job ends at busy time so far plus the latest "arrival minus busy time before it"
    rows = running(_arrivals(spark, d), "i", "service", "busy").withColumn("slack", F.col("scheduled") - (F.col("busy") - F.col("service")))
    rows = running(rows, "i", "slack", "latest", "max").withColumn("ended", F.col("latest") + F.col("busy"))
    return rows.select("i", "scheduled", "ended", (F.col("ended") - F.col("scheduled")).alias("response"), (F.col("ended") - F.col("service") - F.col("scheduled")).alias("waited"))


@query(f"WITH {_LOG} SELECT event_id AS i, CASE WHEN {_U} < 0.95 THEN 'read' ELSE 'write' END AS op, lpad(((event_id * 2654435761) % n)::VARCHAR, 16, '0') || CASE WHEN event_id % 10 = 0 THEN '.' ELSE '' END AS key FROM events, C")
def mixed_operations(spark, d):
    n = size(spark, d)
    at = F.pmod(F.col("event_id") * 2654435761, F.lit(n))
    return _drawn(spark, d).select(F.col("event_id").alias("i"), F.when(workload.is_read(F.col("u"), 0.95), "read").otherwise("write").alias("op"), F.when(F.col("event_id") % 10 == 0, workload.missing_key(at)).otherwise(workload.key(at)).alias("key"))


SEEK_ROWS = 10


@query(f"WITH {_PROBES}, R AS (SELECT user_key, seq, val, row_number() OVER (ORDER BY user_key) AS r FROM {_newest()} WHERE vtype = 1), S AS (SELECT P.probe_id, P.user_key AS target, coalesce(R.r, 0) AS b FROM P ASOF LEFT JOIN R ON P.user_key > R.user_key) SELECT probe_id, target, r - b AS nth, user_key, seq, val FROM S JOIN R ON r BETWEEN b + 1 AND b + {SEEK_ROWS}")
def seek_random(spark, d):
    return view.seek_many(log(spark, d), probes(spark, d).select("probe_id", F.col("user_key").alias("target")), SEEK_ROWS)


@query("SELECT o_orderkey AS probe_id, lpad(o_custkey::VARCHAR, 16, '0') || '.' AS user_key, 'NotPresent' AS state FROM orders")
def read_missing(spark, d):
    asked = _table(spark, d, "orders").select(F.col("o_orderkey").alias("probe_id"), workload.missing_key(F.col("o_custkey")).alias("user_key"), F.lit(None).cast("long").alias("as_of"))
    return view.multi_get(log(spark, d), asked).select("probe_id", "user_key", "state")


def _mixed_sql(share: float) -> str:
    ops = f"O AS (SELECT event_id AS i, {_U} < {share} AS reads, lpad(((event_id * 2654435761) % top)::VARCHAR, 16, '0') AS user_key FROM events, C), M AS (SELECT max(seq) AS m FROM L)"
    every = "W AS (SELECT * FROM L UNION ALL SELECT user_key, m + i + 1, 1, i % 1000 FROM O, M WHERE NOT reads), A AS (SELECT i, user_key, m + i AS a FROM O, M WHERE reads)"
    return f"WITH {_LOG}, {ops}, {every} SELECT i, A.user_key, CASE WHEN vtype IS NULL THEN 'NotPresent' WHEN vtype = 0 THEN 'Deleted' ELSE 'Found' END AS state, CASE WHEN vtype = 1 THEN seq END AS seq, CASE WHEN vtype = 1 THEN val END AS val FROM A ASOF LEFT JOIN W ON A.user_key = W.user_key AND a >= seq"


def _mixed(spark, d, share):
    """Reads and writes in one order against the loaded log: a read sees the writes before it."""
    last, top = _table(spark, d, "events").agg(F.max("event_id") + 1, F.max("user_id") + 1).first()
    loaded, i = log(spark, d), F.col("event_id")
    ops = _drawn(spark, d).select("event_id", workload.is_read(F.col("u"), share).alias("reads"), workload.key(F.pmod(i * 2654435761, F.lit(top))).alias("user_key"))
    written = ops.where("not reads").select("user_key", (i + last + 1).alias("seq"), F.lit(1).alias("vtype"), (i % 1000).cast(loaded.schema["val"].dataType).alias("val"))
    asked = ops.where("reads").select(i.alias("probe_id"), "user_key", (i + last).alias("as_of"))
    return view.multi_get(loaded.unionByName(written), asked).select(F.col("probe_id").alias("i"), "user_key", "state", "seq", "val")


@query(_mixed_sql(0.5))
def ycsb_a(spark, d):
    return _mixed(spark, d, 0.5)


@query(_mixed_sql(0.95))
def ycsb_b(spark, d):
    return _mixed(spark, d, 0.95)


@query(f"WITH {_LOG} SELECT user_key, seq, '''' || user_key || ''' @ ' || seq || CASE WHEN vtype = 0 THEN ' DEL' ELSE ' PUT => ''' || (val * 100)::BIGINT || '''' END AS line FROM L")
def sst_dump(spark, d):
    return view.dump(log(spark, d).withColumn("val", F.expr("cast(round(val * 100) as bigint)")))


@query("SELECT o_orderkey, 500 + row_number() OVER (ORDER BY o_orderkey) AS seq FROM orders")
def sequence_assignment(spark, d):
    return positions(_table(spark, d, "orders").select("o_orderkey"), [("o_orderkey", True)], "seq", start=501)


@query("SELECT key, value, seq FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM (SELECT o_custkey AS key, o_orderkey AS value, row_number() OVER (ORDER BY o_orderkey) AS seq, o_orderpriority LIKE '1%' AS gone FROM orders)) WHERE rn = 1 AND NOT gone")
def write_batch_last_wins(spark, d):
    ops = positions(_table(spark, d, "orders"), [("o_orderkey", True)], "seq")
    rows = ops.select(F.col("o_custkey").alias("user_key"), "seq", (~F.col("o_orderpriority").startswith("1")).cast("int").alias("vtype"), F.col("o_orderkey").alias("val"))
    return view.visible(rows).select(F.col("user_key").alias("key"), F.col("val").alias("value"), "seq")


@query(f"WITH {_LOG}, K AS (SELECT user_key, seq, seq * 256 + vtype AS tail FROM L) SELECT user_key, seq, hex(user_key) || string_agg(lpad(hex((tail >> (8 * b)::INT) & 255), 2, '0'), '' ORDER BY b) AS internal FROM K, range(0, 8) r(b) GROUP BY user_key, seq")
def internal_keys(spark, d):
    return log(spark, d).select("user_key", "seq", F.hex(codecs.internal_key_column(F.col("user_key"), F.col("seq"), F.col("vtype"))).alias("internal"))


_VARINT = "list_reduce(list_transform(range(0, (length(bin(seq)) + 6) // 7), lambda i: lpad(hex(((seq >> (7 * i)::INT) & 127) + CASE WHEN (seq >> (7 * (i + 1))::INT) > 0 THEN 128 ELSE 0 END), 2, '0')), lambda a, b: a || b)"
# a step a bit: list_reduce over the bytes of the key, each taken through eight shifts
_CRC_BITS = "list_reduce(list_prepend(c, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 2197175160) ELSE x >> 1 END)"
_CRC = f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(user_key, ''), lambda s: ascii(s)::BIGINT)), lambda x, b: list_transform([xor(x, b)], lambda c: {_CRC_BITS})[1]), 4294967295)"


@query(f"WITH {_LOG} SELECT user_key, seq, {_VARINT} AS varint, seq AS back, {_CRC} AS crc32c FROM L")
def codec_columns(spark, d):
    rows = log(spark, d).select("user_key", "seq", codecs.varint_column(F.col("seq")).alias("v"))
    return rows.select("user_key", "seq", F.hex("v").alias("varint"), codecs.varint_value(F.col("v")).alias("back"), codecs.crc32c_column(F.col("user_key").cast("binary")).alias("crc32c"))


QUERIES = {k: f for k, (f, _) in _ENTRIES.items()}
ORACLE_SQL = {k: sql for k, (_, sql) in _ENTRIES.items() if sql}
