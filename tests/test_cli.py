import glob

import pytest

import loam
from loam.__main__ import main
from loam.plans.store import Store


@pytest.fixture
def call(spark, capsysbinary):
    def run(*argv):
        code = main(list(argv), spark)
        got = capsysbinary.readouterr()
        return code, got.out.decode("utf-8", "surrogateescape"), got.err.decode()

    return run


def test_values_outlive_the_process(call, tmp_path):
    db = f"file://{tmp_path}/db"
    assert call("put", db, "user:1", "first")[0] == 0
    assert call("put", db, "user:1", "second", "--sync")[0] == 0
    assert call("get", db, "user:1") == (0, "second\n", "")
    assert call("put", db, "raw", "\udcff")[0] == 0
    assert call("get", db, "raw")[1] == "\udcff\n"
    assert call("delete", db, "user:1")[0] == 0
    assert call("get", db, "user:1") == (1, "", "loam: not found\n")


@pytest.mark.parametrize("argv", [(), ("nosuch",), ("get", "db"), ("put", "db", "k"), ("get", "db", "k", "--sync"), ("dump-sst",)])
def test_usage_errors(call, argv):
    code, out, err = call(*argv)
    assert code == 2 and not out and "usage" in err


def test_version_and_help(call):
    assert call("version")[:2] == (0, loam.__version__ + "\n")
    assert all(call(x)[0] == 0 for x in ("help", "-h", "--help")) and "dump-sst" in call("help")[1]


def test_dump(call, spark, tmp_path):
    with Store(spark, f"file://{tmp_path}/db") as s:
        s.put(b"k\\\x01", b"v\xff")
        s.put(b"k\\\x01", b"w")
        s.delete(b"gone")
        s.flush()
    (path,) = glob.glob(f"{tmp_path}/db/data/*/*.parquet")
    assert call("dump-sst", f"file://{path}")[1].splitlines() == ["'gone' @ 3 DEL", r"'k\x5c\x01' @ 2 PUT => 'w'", r"'k\x5c\x01' @ 1 PUT => 'v\xff'", "3 entries"]


def test_other_failures(call, spark, tmp_path):
    assert call("dump-sst", f"file://{tmp_path}/nosuch.parquet")[0] == 3
    with Store(spark, f"file://{tmp_path}/db"):
        code, _, err = call("get", f"file://{tmp_path}/db", "k")
    assert code == 3 and "locked" in err
