import os
import random
import signal
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from loam.operators import compaction, view
from loam.plans import store as st


@pytest.fixture
def opened(spark, tmp_path):
    stores = []

    def open_(**options):
        for s in stores:
            s.close()
        stores[:] = [st.Store(spark, f"file://{tmp_path}/db", **options)]
        return stores[0]

    yield open_
    for s in stores:
        s.close()


def content(df):
    return {bytes(r.user_key): bytes(r.val) for r in df.collect()}


def test_batches_snapshots_and_reopening(opened, spark):
    s = opened()
    s.write(st.Batch().put(b"a", b"1").put(b"b", b"2").delete(b"a").put(b"c", b"3"))
    assert s.last_seq == 4 and content(s.scan()) == {b"b": b"2", b"c": b"3"}
    snap = s.take_snapshot()
    s.put(b"b", b"new")
    s.put(b"", b"\x00\x01\xff")
    assert content(s.scan(as_of=snap)) == {b"b": b"2", b"c": b"3"} and s.get(b"") == b"\x00\x01\xff"
    s.release_snapshot(snap)
    with pytest.raises(st.InvalidArgument):
        s.scan(as_of=snap)
    with pytest.raises(st.InvalidArgument):
        s.release_snapshot(snap)
    with pytest.raises(st.NotFound):
        s.get(b"a")
    with pytest.raises(st.StoreError):
        st.Store(spark, s.path)
    assert s.write(st.Batch()) == 6
    s = opened()
    assert s.last_seq == 6 and s.get(b"b") == b"new"
    s.flush()
    s = opened()
    assert content(s.scan(b"b", b"c")) == {b"b": b"new"} and s.shape() == "1"


def test_deleted_keys_stay_deleted_through_levels(opened):
    s = opened()
    s.put(b"doomed", b"old")
    s.flush()
    s.compact(0)
    s.compact(1)
    s.write(st.Batch().put(b"d", b"1").put(b"e", b"1"))
    s.flush()
    s.compact(0)
    s.delete(b"doomed")
    s.flush()
    for level in (0, 1):
        s.compact(level)
        with pytest.raises(st.NotFound):
            s.get(b"doomed")
    assert set(s.collect_garbage()) and content(s.scan()) == {b"d": b"1", b"e": b"1"}


def test_snapshot_pins_versions(opened):
    s = opened()
    s.put(b"key", b"old")
    snap = s.take_snapshot()
    s.put(b"key", b"new")
    s.flush()
    s.put(b"key", b"newer")
    s.flush()
    s.compact(0)
    assert content(s.scan(as_of=snap)) == {b"key": b"old"} and s.get(b"key") == b"newer"


def test_random_history_against_a_dictionary(opened, spark):
    rng, model, s = random.Random(42), {}, opened(level_base=2000, max_file_size=4000)
    for step in range(45):
        what = rng.random()
        batch = st.Batch()
        for _ in range(rng.randrange(1, 12)):
            k = b"k%d" % rng.randrange(40)
            if rng.random() < 0.3:
                batch.delete(k)
                model.pop(k, None)
            else:
                v = b"%d" % step * rng.randrange(4)
                batch.put(k, v)
                model[k] = v
        s.write(batch)
        if what < 0.2:
            s.flush()
        elif what < 0.3:
            s.maintain()
        elif what < 0.4:
            s = opened(level_base=2000, max_file_size=4000)
        if step % 9 == 8:
            assert content(s.scan()) == model
    s.maintain()
    assert content(s.scan()) == model
    rows = [r.user_key for r in s.scan(descending=True).collect()]
    assert rows == sorted(rows, reverse=True)


def test_bulk_load(opened, spark):
    s = opened()
    ops = spark.range(5000).select(F.col("id").alias("op_index"), F.format_string("%04d", F.col("id") % 3000).cast("binary").alias("key"), F.when(F.col("id") % 7 != 0, F.col("id").cast("string").cast("binary")).alias("value"))
    assert s.load(ops) == 5000
    model = {b"%04d" % (i % 3000): (str(i).encode() if i % 7 else None) for i in range(5000)}
    assert content(s.scan()) == {k: v for k, v in model.items() if v is not None}
    s.compact(0)
    assert content(s.scan()) == {k: v for k, v in model.items() if v is not None}


def test_damage_is_an_error(opened, tmp_path):
    s = opened()
    for i in range(3):
        s.put(b"k%d" % i, b"v")
    s.flush()
    s.put(b"tail", b"v")
    s.put(b"torn", b"v")
    s.close()
    segment = sorted((tmp_path / "db/log").glob("*.json"))[-1]
    whole = segment.read_bytes()
    for sidecar in (tmp_path / "db").rglob("*.crc"):
        sidecar.unlink()
    segment.write_bytes(whole[:-20])
    s = opened()  # nothing valid follows the damage: an interrupted write, of which nobody was told
    assert s.last_seq == 4 and s.recovered == {"segments": 1, "operations": 1, "dropped": 1, "edits": 2}
    s.put(b"torn", b"w")
    s = opened()
    assert s.last_seq == 5
    s.close()
    first = segment.with_name("0000000000000004.json")
    whole = first.read_bytes()
    for sidecar in (tmp_path / "db").rglob("*.crc"):
        sidecar.unlink()
    first.write_bytes(whole[:-20])
    with pytest.raises(st.Corruption):
        opened()
    first.write_bytes(whole)
    edit = sorted((tmp_path / "db/edits").glob("*.json"))[1]
    raw = edit.read_bytes()
    edit.write_bytes(raw.replace(b"flushed", b"flashed"))
    with pytest.raises(st.Corruption):
        opened()
    edit.write_bytes(raw)
    next((tmp_path / "db/data").rglob("*.parquet")).unlink()
    s = opened()
    with pytest.raises(st.Corruption):
        s.get(b"k0")


def test_failed_commit_stops_writes(opened, monkeypatch):
    s = opened()
    s.put(b"a", b"1")
    publish = s.files_on.publish
    monkeypatch.setattr(s.files_on, "publish", lambda name, *a, **k: publish(name, *a, **k) if name.startswith("log") else (_ for _ in ()).throw(OSError("no space")))
    with pytest.raises(st.StoreError):
        s.flush()
    with pytest.raises(st.StoreError):
        s.put(b"b", b"2")
    s = opened()
    assert content(s.scan()) == {b"a": b"1"}


def test_compaction_keeps_every_later_view(spark):
    rng = random.Random(7)
    for _ in range(3):
        rows = [(f"k{rng.randrange(12)}", i + 1, int(rng.random() > 0.25), i) for i in range(150)]
        rows = [(k, s, t, v if t else None) for k, s, t, v in rows]
        log = spark.createDataFrame(rows, "user_key string, seq long, vtype int, val long")
        kept = compaction.compacted(log, 90)
        assert kept.count() < len(rows)
        for s in (90, 91, 120, 150):
            model = {}
            for k, q, t, v in rows:
                if q <= s:
                    model[k] = v
            for df in (log, kept):
                assert {r.user_key: r.val for r in view.visible(df, s).collect()} == {k: v for k, v in model.items() if v is not None}


def test_plan_pushes_bounds_and_aggregates_before_the_shuffle(spark, tmp_path):
    path = str(tmp_path / "log")
    spark.createDataFrame([("a", 1, 1, 2.0)], "user_key string, seq long, vtype int, val double").write.parquet(path)
    df = view.visible(spark.read.parquet(path), 10, "a", "c")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(user_key,a)" in plan and "partial_max" in plan
    keys = view.keys(spark.read.parquet(path))._jdf.queryExecution().executedPlan().toString()
    assert "val" not in keys.split("ReadSchema")[1]


def test_malformed_rows_fail(spark):
    log = spark.createDataFrame([("a", 1, 2, 0.0)], "user_key string, seq long, vtype int, val double")
    with pytest.raises(Exception, match="corruption"):
        view.visible(view.validated(log)).collect()


def test_streaming_view(spark, tmp_path):
    from loam.streaming import live_view

    path, schema = str(tmp_path / "log"), "user_key string, seq long, vtype int, val long"
    for rows in ([("a", 1, 1, 1), ("b", 2, 1, 2)], [("a", 4, 0, None), ("b", 3, 1, 3)], [("b", 2, 1, 2), ("c", 5, 1, 5)]):
        df = spark.createDataFrame(rows, schema)
        df.coalesce(1).write.mode("append").parquet(path)
    run = lambda: live_view.run_available(live_view.log_stream(spark, path, df.schema, 1), str(tmp_path / "view"), str(tmp_path / "checkpoint"))
    assert sorted(tuple(r) for r in run().collect()) == [("b", 3, 3), ("c", 5, 5)]
    spark.createDataFrame([("c", 6, 0, None), ("d", 7, 1, 7)], schema).coalesce(1).write.mode("append").parquet(path)
    assert sorted(tuple(r) for r in run().collect()) == [("b", 3, 3), ("d", 7, 7)]  # what came since the last run


KILLED = """
import os, signal, sys
from pyspark.sql import SparkSession
from loam.plans.store import Batch, Store
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
s = Store(spark, sys.argv[1])
for i in range(40):
    mixed = i * 2654435761 % 2**32
    b = Batch()
    b.delete(b"key-%d" % (mixed % 64)) if (mixed >> 8) % 4 == 0 else b.put(b"key-%d" % (mixed % 64), b"v%d" % i)
    s.write(b)
    if i == 20:
        s.flush()
os.kill(os.getpid(), signal.SIGKILL)
"""


def test_a_killed_writers_store_opens_again(spark, tmp_path):
    path = f"file://{tmp_path}/db"
    env = os.environ | {"PYTHONPATH": os.path.dirname(os.path.dirname(os.path.abspath(__file__)))}
    done = subprocess.run([sys.executable, "-c", KILLED, path], env=env, capture_output=True, timeout=120)
    assert done.returncode == -signal.SIGKILL
    model = {}
    for i in range(40):
        mixed = i * 2654435761 % 2**32
        key = b"key-%d" % (mixed % 64)
        model.pop(key, None) if (mixed >> 8) % 4 == 0 else model.update({key: b"v%d" % i})
    with st.Store(spark, path) as s:
        assert s.last_seq == 40 and content(s.scan()) == model


def test_a_dropped_store_opens_again_and_a_slow_writer_is_fenced(spark, tmp_path):
    path = f"file://{tmp_path}/db"
    s = st.Store(spark, path)
    s.put(b"a", b"1")
    with pytest.raises(st.StoreError, match="locked"):
        st.Store(spark, path)
    del s
    a = st.Store(spark, path)
    claim = a.files_on.names("claims")[-1]
    raw = a.files_on.read(f"claims/{claim}").replace(b'"host": "', b'"host": "far-')
    a.files_on.replace(f"claims/{claim}", raw)
    with pytest.raises(st.StoreError, match="far-"):
        st.Store(spark, path)
    until = raw.index(b'"until": ')
    a.files_on.replace(f"claims/{claim}", raw[:until] + b'"until": 1.0}')
    with st.Store(spark, path) as b:
        b.put(b"b", b"2")
        with pytest.raises(st.StoreError, match="taken"):
            a.put(b"c", b"3")
        assert content(b.scan()) == {b"a": b"1", b"b": b"2"}


def test_views_that_were_compacted_away_are_errors(opened, spark):
    s = opened()
    s.put(b"key", b"old")
    s.flush()
    s.put(b"key", b"new")
    s.flush()
    assert content(s.scan(as_of=1)) == {b"key": b"old"}
    s.compact(0)
    probes = spark.createDataFrame([(1, b"key", 1)], "probe_id long, user_key binary, as_of long")
    for s in (s, opened()):
        for read in (lambda: s.scan(as_of=1), lambda: s.get(b"key", 1), lambda: s.multi_get(probes), lambda: s.seek(as_of=1)):
            with pytest.raises(st.InvalidArgument):
                read()
        assert content(s.scan(as_of=2)) == {b"key": b"new"} and s.cursors == {0: b"key"}
    assert [r.state for r in s.multi_get(probes.withColumn("as_of", F.lit(None).cast("long"))).collect()] == ["Found"]
    for level in (-1, 6, 7):
        with pytest.raises(st.InvalidArgument):
            s.compact(level)


def test_state_is_written_whole_now_and_then(opened, monkeypatch):
    monkeypatch.setattr(st, "STATE_EVERY", 4)
    s = opened()
    for i in range(5):
        s.put(b"k%d" % i, b"v")
        s.flush()
    s.compact(0)
    assert any(n.endswith(".state.json") for n in s.files_on.names("edits"))
    s.collect_garbage()
    s = opened()
    assert s.recovered["edits"] < 5 and s.shape() == "0 / 1" and s.last_seq == 5 and len(content(s.scan())) == 5
    edits = s.files_on.names("edits")
    s.close()
    s.files_on.delete(f"edits/{edits[-2]}" if len(edits) > 2 else f"edits/{edits[0]}")
    with pytest.raises(st.StoreError):
        opened()


def test_write_buffer_flushes_and_compacts(opened):
    s = opened(write_buffer_size=100, auto_compact=True)
    for i in range(12):
        s.put(b"k%02d" % i, b"x" * 30)
    assert s.counts["flushes"] == 4 and s.counts["compactions"] + s.counts["moves"] >= 1 and s.buffered == 0
    assert len(content(s.scan())) == 12


def test_seek_stops_at_the_files_that_it_needs(opened, spark):
    s = opened()
    for k in range(8):
        s.load(spark.createDataFrame([(i, b"k%d%02d" % (k, i), b"v") for i in range(20)], "op_index long, key binary, value binary").coalesce(1))
    s.counts["files_read"] = 0
    assert [bytes(r.user_key) for r in s.seek(b"k205", 3).collect()] == [b"k205", b"k206", b"k207"]
    near = s.counts["files_read"]
    assert near < len(s.files) / 2
    assert [bytes(r.user_key) for r in s.seek(b"k205", 3, descending=True).collect()] == [b"k205", b"k204", b"k203"]
    assert [bytes(r.user_key) for r in s.seek(b"k718", 5).collect()] == [b"k718", b"k719"]
    assert s.seek(n=200).count() == 160 and [bytes(r.user_key) for r in s.seek(descending=True, n=2).collect()] == [b"k719", b"k718"]


class Fault(OSError):
    pass


class Faulty:
    """The store's small files, failing at one publication: before it, or after half of it has reached its place."""

    def __init__(self, files, at, torn):
        self.files, self.left, self.torn = files, at, torn

    def __getattr__(self, name):
        return getattr(self.files, name)

    def publish(self, name, content, sync=True):
        self.left -= 1
        if self.left < 0:
            if self.torn and self.left == -1:
                self.files.publish(name, content[: len(content) // 2], sync)
            raise Fault("no space")
        self.files.publish(name, content, sync)


@pytest.mark.parametrize("seed", range(12))
def test_crash_matrix(spark, tmp_path, seed):
    """After a failure at any publication, what was acknowledged is there, and of the rest at most the last batch."""
    rng, path = random.Random(seed), f"file://{tmp_path}/db"
    s = st.Store(spark, path)
    s.files_on = s.lease.files = Faulty(s.files_on, rng.randrange(1, 22), seed % 2)
    model, last, failed = {}, {}, None
    try:
        for step in range(24):
            if step % 10 == 9:
                s.flush()
                continue
            last, batch = dict(model), st.Batch()
            for _ in range(rng.randrange(1, 4)):
                k = b"k%d" % rng.randrange(16)
                v = None if rng.random() < 0.25 else bytes([65 + step]) * rng.randrange(40, 160)
                batch.delete(k) if v is None else batch.put(k, v)
                last = {a: b for a, b in last.items() if a != k} | ({} if v is None else {k: v})
            s.write(batch)
            model = last
    except st.StoreError as e:
        failed = e
    if failed:
        with pytest.raises(st.StoreError):
            s.put(b"x", b"y")
    del s, failed
    try:
        with st.Store(spark, path) as s:
            assert content(s.scan()) in (model, last)
    except st.Corruption as e:
        assert seed % 2 and "edit" in str(e)  # half an edit can't come from an atomic rename: it is reported
