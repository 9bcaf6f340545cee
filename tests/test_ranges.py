import random

import pytest

from loam.operators import compaction
from loam.operators.ranges import BINS, cut_points, held_by


def brute(keys, ranges):
    return sorted((k, *r) for k in keys if k is not None for r in ranges if None not in r[:2] and r[0] <= k <= r[1])


@pytest.mark.parametrize("n, bins", [(0, 4), (1, 4), (30, 4), (700, 16), (40, BINS)])
def test_held_by_equals_brute_force(spark, n, bins):
    rng = random.Random(n)
    key = lambda: bytes(rng.randrange(256) for _ in range(rng.randrange(3)))
    keys = [None, b"", *(key() for _ in range(200)), b"a", b"a"]
    ranges = [(*sorted((key(), key())), i) for i in range(n)]
    if n:
        ranges += [(b"", b"\xff\xff\xff", n), (b"z", b"a", n + 1), (None, b"a", n + 2), (b"a", None, n + 3)]
    left = spark.createDataFrame([(k,) for k in keys], "user_key binary")
    right = spark.createDataFrame(ranges, "smallest binary, largest binary, number long")
    assert len(cut_points(right, bins)) < bins
    got = held_by(left, right, bins=bins)
    assert got.columns == ["user_key", "smallest", "largest", "number"]
    assert sorted((bytes(r.user_key), bytes(r.smallest), bytes(r.largest), r.number) for r in got.collect()) == brute(keys, ranges)
    semi = held_by(left, right, "left_semi", bins)
    assert semi.columns == ["user_key"]
    want = [k for k in keys if brute([k], ranges)]
    assert sorted(bytes(r[0]) for r in semi.collect()) == sorted(want)


def test_held_by_has_no_nested_loop(spark):
    """Text keys; disjoint ranges make few rows; ranges too large to broadcast are shuffled by bin."""
    left = spark.range(2000).selectExpr("lpad(cast(id as string), 6, '0') AS user_key")
    right = spark.range(0, 2000, 4).selectExpr("lpad(cast(id as string), 6, '0') AS smallest", "lpad(cast(id + 2 as string), 6, '0') AS largest")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = held_by(left, right, bins=32)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert got.count() == 1500 and "NestedLoop" not in plan and "Cartesian" not in plan
        based = compaction.with_base(left.selectExpr("user_key", "1L AS seq"), right)
        plan = based._jdf.queryExecution().executedPlan().toString()
        assert based.where("base").count() == 500 and "NestedLoop" not in plan and "Cartesian" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
