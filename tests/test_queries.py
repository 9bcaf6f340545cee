import math

import duckdb
import numpy as np
import pytest

from loam.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.01"
TABLES = ("events", "orders", "lineitem")


def plain(rows):
    return sorted(repr(tuple(float(f"{x:.9g}") if isinstance(x, float) else x for x in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    cur = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in cur.description]
    df = QUERIES[name](spark, DATA)
    assert sorted(columns) == sorted(df.columns)
    got = df.select(*columns).collect()
    assert plain(got) == plain(cur.fetchall())
    if name not in ("point_get_missing", "level_overlap_violations"):
        assert got


def test_codec_columns(spark):
    from loam.functions.codecs import crc32c, get_varint

    for r in QUERIES["codec_columns"](spark, DATA).limit(200).collect():
        assert get_varint(bytes.fromhex(r.varint))[0] == r.seq and r.crc32c == crc32c(r.user_key.encode())


def test_zipf_scramble_returns_every_event(spark, tmp_path):
    """Ranks beyond 1000 too: all rows against NumPy, on events whose ids reach the whole of [0, 1)."""
    ids = np.arange(0, 60_000 * 37, 37, dtype=np.int64)
    spark.createDataFrame([(int(i),) for i in ids], "event_id long").write.parquet(f"{tmp_path}/events.parquet")
    n, theta = len(ids), 0.99
    with np.errstate(over="ignore"):
        z = np.uint64(42) + (ids + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    u = ((z ^ z >> np.uint64(31)) >> np.uint64(11)) * 2.0**-53
    zeta = (np.arange(1, n + 1, dtype=float) ** -theta).sum()
    eta = (1 - (2 / n) ** (1 - theta)) / (1 - (1 + 0.5**theta) / zeta)
    tail = np.minimum(n * (eta * u - eta + 1) ** (1 / (1 - theta)), n - 1)
    exact = np.where(u * zeta < 1, 0, np.where(u * zeta < 1 + 0.5**theta, 1, tail))
    got = {r.i: r for r in QUERIES["zipf_scramble"](spark, str(tmp_path)).collect()}
    assert sorted(got) == ids.tolist()
    ranks = np.array([got[i].rank for i in ids.tolist()])
    near = (exact > 1) & (np.abs(exact - np.round(exact)) < 1e-9 * exact)  # pow() may floor to either side here
    assert (ranks == np.floor(exact))[~near].all() and (np.abs(ranks - exact) <= 1.001)[near].all()
    assert [got[i].scrambled for i in ids.tolist()] == [(int(r) + 1) * 4294967291 % n for r in ranks]
    assert (ranks >= 1000).sum() > n / 4 and near.mean() < 0.001


def test_generators_are_random_and_whole_at_a_larger_scale(spark):
    """Mean, spread and serial correlation; the share of writes; and the SQL's rows at sf0.1."""
    data = DATA.replace("0.01", "0.1")
    rows = QUERIES["uniform_draws"](spark, data).orderBy("i").toPandas()
    for u in (rows.u.to_numpy(), rows.other.to_numpy()):
        assert abs(u.mean() - 0.5) < 0.005 and abs(u.std() - 12**-0.5) < 0.005 and abs(np.corrcoef(u[1:], u[:-1])[0, 1]) < 0.02
        assert abs(np.corrcoef(u, rows.i)[0, 1]) < 0.02 and 0 <= u.min() < 0.001 and 0.999 < u.max() < 1
    gaps = QUERIES["poisson_schedule"](spark, data).orderBy("i").toPandas().gap.to_numpy(float)
    assert abs(gaps.mean() / 1e4 - 1) < 0.02 and abs(gaps.std() / 1e4 - 1) < 0.03 and abs(np.corrcoef(gaps[1:], gaps[:-1])[0, 1]) < 0.02
    for d in (DATA, data):
        ops = QUERIES["mixed_operations"](spark, d).toPandas().op
        assert 0.04 < (ops == "write").mean() < 0.06
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{data}/events.parquet'")
    for name in ("uniform_draws", "zipf_scramble", "poisson_schedule", "open_loop_latency", "mixed_operations"):
        cur = con.execute(ORACLE_SQL[name])
        got = QUERIES[name](spark, data).select(*(c[0] for c in cur.description)).collect()
        assert len(got) == 100_000 and plain(got) == plain(cur.fetchall())
