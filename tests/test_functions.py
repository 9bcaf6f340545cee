import numpy as np
import pytest

from loam.functions import codecs, workload
from loam.operators import stats
from loam.operators.prefix import positions, running


def test_golden_bytes():
    assert [codecs.key_hash(k) for k in (b"", b"abc", b"\x00\xff")] == [0xF52A15E9A9B5E89B, 0x0DD490490804B508, 0xA70BEE94C6C8447B]
    assert codecs.bloom([b"abc"]) == bytes.fromhex("070001020408102040")
    crcs = [codecs.crc32c(x) for x in (b"123456789", bytes(32), b"\xff" * 32, bytes(range(32)), bytes(range(31, -1, -1)))]
    assert crcs == [0xE3069283, 0x8A9136AA, 0x62A8AB43, 0x46DD794E, 0x113FDB5C]
    assert codecs.separator(b"abcxyz", b"abezz") == b"abd"
    raw = codecs.encoded_batch(5, [(b"k", b"vv"), (b"d", None)])
    assert raw == bytes.fromhex("0500000000000000" "02000000" "01016b027676" "000164")
    assert codecs.decoded_batch(raw) == (5, [(b"k", b"vv"), (b"d", None)])
    assert codecs.crc32c(b"456789", codecs.crc32c(b"123")) == codecs.crc32c(b"123456789")
    assert all(codecs.unmasked(codecs.masked(c)) == c for c in crcs)


def test_damaged_batches_are_refused():
    raw = codecs.encoded_batch(5, [(b"k", b"vv"), (b"d", None)])
    for n in range(len(raw)):
        with pytest.raises(codecs.Corruption):
            codecs.decoded_batch(raw[:n])
    with pytest.raises(codecs.Corruption):
        codecs.decoded_batch(raw + b"\0")


@pytest.mark.parametrize("v", [0, 1, 127, 128, 300, 2**32 - 1, 2**56, 2**64 - 1])
def test_varints(v):
    raw = codecs.put_varint(v)
    assert codecs.get_varint(raw) == (v, len(raw))
    with pytest.raises(codecs.Corruption):
        codecs.get_varint(raw[:-1])
    if v >> 32:
        with pytest.raises(codecs.Corruption):
            codecs.get_varint(raw, bits=32)


def test_bloom_has_no_false_negatives():
    keys = [b"key%d" % i for i in range(2000)]
    f = codecs.bloom(keys)
    assert all(codecs.may_contain(f, k) for k in keys)
    assert sum(codecs.may_contain(f, b"no%d" % i) for i in range(5000)) < 150


def test_keys_between():
    rng = np.random.default_rng(1)
    for _ in range(300):
        a, b = sorted(bytes(rng.integers(0, 256, rng.integers(0, 6)).astype(np.uint8)) for _ in range(2))
        if a < b:
            assert a <= codecs.separator(a, b) < b
        assert codecs.successor(a) >= a
        assert codecs.parsed_key(codecs.internal_key(a, 7, 1)) == (a, 7, 1)


def test_histogram_golden(spark):
    df = spark.createDataFrame([(x,) for x in (2, 4, 4, 4, 5, 5, 7, 9)], "value long")
    r = stats.summary(df).first()
    assert (r.n, r.least, r.most, r.mean, r.deviation) == (8, 2, 9, 5.0, 2.0)
    big = spark.createDataFrame([(v,) for v in [0, 15, 16, 17, 31, 32, 33, 1000, 2**40 + 12345, 2**62]], "value long")
    for r in stats.histogram(big).collect():
        assert r.n >= 1 and r.low < r.high or r.high < 0
    rows = stats.rounds(spark.createDataFrame([("a", x) for x in (9.0, 10.0, 11.0)] + [("b", x) for x in (4.0, 1.0, 3.0, 2.0)] + [("c", 1.0)], "workload string, value double")).collect()
    by = {r.workload: r for r in rows}
    assert abs(by["a"].cv - 0.1) < 1e-12 and by["b"].median == 2.5 and by["c"].cv == 0.0 and not by["c"].publishable


def test_zipf(spark):
    from pyspark.sql import functions as F

    df = spark.range(20000).select(workload.zipf_rank(workload.uniform(F.col("id")), 1000).alias("r"))
    share = df.where("r = 0").count() / 20000
    assert abs(share - 1 / workload.zeta(1000, 0.99)) < 0.02
    assert abs(workload.zeta(3000, 0.99, exact=500) - workload.zeta(3000, 0.99)) < 1e-6


@pytest.mark.parametrize("seed", [0, 42, 20261011, 2**64 - 5])
def test_uniform_is_split_mix(spark, seed):
    from pyspark.sql import functions as F

    got = [r.u for r in spark.range(500).select("id", workload.uniform(F.col("id"), seed).alias("u")).orderBy("id").collect()]
    assert got == ((codecs.split_mix(seed, 500) >> np.uint64(11)) * 2.0**-53).tolist()
    plan = spark.range(9).select(workload.uniform(F.col("id"), seed).alias("u")).where("u > 0.5 and u < 0.9 and u <> 0.7")._jdf.queryExecution().executedPlan().toString()
    assert len(plan) < 200_000  # a filter that is pushed below the draw doesn't multiply it


def test_positions_and_running_are_distributed(spark):
    from pyspark.sql import functions as F

    df = spark.range(3000).select((F.col("id") * 7919 % 3001).alias("i"), F.lit("hot").alias("k"), (F.col("id") % 13).alias("v"))
    got = {r.i: r.p for r in positions(df, [("k", True), ("i", False)], "p", parts=7).collect()}
    assert [got[i] for i in sorted(got, reverse=True)] == list(range(1, 3001))
    rows = sorted(running(df, "i", "v", "s", run=100).collect(), key=lambda r: r.i)
    assert [r.s for r in rows] == np.cumsum([r.v for r in rows]).tolist()
    rows = sorted(running(df, "i", "v", "s", "max", run=100).collect(), key=lambda r: r.i)
    assert [r.s for r in rows] == np.maximum.accumulate([r.v for r in rows]).tolist()


def test_codec_columns_go_both_ways(spark):
    from pyspark.sql import functions as F

    numbers = [0, 1, 127, 128, 300, 2**32 - 1, 2**56, 2**62]
    made = spark.createDataFrame([(v,) for v in numbers] + [(None,)], "v long").select("v", codecs.varint_column(F.col("v")).alias("r"), codecs.fixed64_column(F.col("v")).alias("f"))
    rows = made.select("v", "r", codecs.varint_value(F.col("r")).alias("b"), codecs.fixed64_value(F.col("f")).alias("g")).collect()
    for r in rows:
        assert r.b == r.v and r.g == r.v and (r.v is None or bytes(r.r) == codecs.put_varint(r.v))
    bad = spark.createDataFrame([(b"",), (b"\x80",), (b"\x01\x01",)], "r binary").select(codecs.varint_value(F.col("r")).alias("b")).collect()
    assert [r.b for r in bad] == [None] * 3
    cells = [b"", b"123456789", bytes(32), b"\xff" * 32, b"a" * 1000]
    assert codecs.crc32c_batch(cells).tolist() == [codecs.crc32c(x) for x in cells] and not len(codecs.crc32c_batch([]))


def test_many_seeks_equal_single_ones(spark):
    """Ties, a target that is a key, one past the end, null and a table without live keys."""
    from loam.operators import view

    log = spark.createDataFrame([(f"k{i % 40:02d}", i + 1, int(i % 7 > 0), i) for i in range(200)], "user_key string, seq long, vtype int, val long")
    targets = [(1, "k00"), (2, "k07"), (3, "k07"), (4, "k075"), (5, "z"), (6, None), (7, ""), (8, "k39")]
    probes = spark.createDataFrame(targets, "probe_id long, target string")
    got = sorted(tuple(r) for r in view.seek_many(log, probes, 3).collect())
    want = [(p, t, k, *r) for p, t in targets if t is not None for k, r in enumerate(map(tuple, view.seek(log, t, 3).collect()), 1)]
    assert got == sorted(want) and len(got) > 12
    assert not view.seek_many(log.where("vtype = 0"), probes, 3).collect() and not view.seek_many(log, probes.limit(0), 3).collect()


@pytest.mark.parametrize("live, n", [(11, 10), (2000, 1), (2000, 7)])
def test_many_seeks_gather_nothing_on_the_driver(spark, live, n):
    """Every row against brute force, most targets one key; neither targets nor keys are broadcast, under the default limit for it."""
    from bisect import bisect_left

    from loam.operators import view

    names = [f"k{i * 3:06d}" for i in range(live)]
    log = spark.createDataFrame([(k, i + 1, int(i % 5 != 3), i) for i, k in enumerate(names)], "user_key string, seq long, vtype int, val long")
    targets = [(i, "k000009" if i % 4 else f"k{i * 7919 % (live * 4):06d}") for i in range(6000)]
    got = view.seek_many(log, spark.createDataFrame(targets, "probe_id long, target string"), n)
    rows = sorted(tuple(r) for r in got.collect())
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan and "Broadcast" not in plan and "NestedLoop" not in plan
    there = [(k, i + 1, i) for i, k in enumerate(names) if i % 5 != 3]
    keys = [k for k, *_ in there]
    assert rows == sorted((p, t, j, *r) for p, t in targets for j, r in enumerate(there[bisect_left(keys, t):][:n], 1))
    assert len(rows) <= 6000 * n and len({r[0] for r in rows}) > 1000
