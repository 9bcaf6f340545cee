"""Command line of a store: `python -m loam COMMAND`; exits with 0, 1 (no such key), 2 (usage) or 3 (any other failure).

Keys and values are taken and printed as bytes. An argument that begins with a dash goes after `--`.
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession, functions as F

import loam
from loam.operators import view
from loam.plans.store import LOG, NotFound, Store, StoreError

DONE, ABSENT, USAGE, FAILED = range(4)


def _put(spark: SparkSession, a: argparse.Namespace) -> None:
    with Store(spark, a.db) as s:
        s.put(os.fsencode(a.key), os.fsencode(a.value), a.sync)


def _get(spark: SparkSession, a: argparse.Namespace) -> None:
    with Store(spark, a.db) as s:
        sys.stdout.buffer.write(s.get(os.fsencode(a.key)) + b"\n")


def _delete(spark: SparkSession, a: argparse.Namespace) -> None:
    with Store(spark, a.db) as s:
        s.delete(os.fsencode(a.key), a.sync)


def _dump(spark: SparkSession, a: argparse.Namespace) -> None:
    """A data file's versions in order, a partition at a time."""
    entries = 0
    for r in view.dump(spark.read.schema(LOG).parquet(a.file)).orderBy("user_key", F.desc("seq")).toLocalIterator():
        print(r.line)
        entries += 1
    print(f"{entries} entries")


def arguments() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="loam", description="Reads and writes a store of versions.")
    commands = top.add_subparsers(dest="command", metavar="COMMAND", required=True)
    for name, run, words, about in (
        ("put", _put, ("db", "key", "value"), "set a key"),
        ("get", _get, ("db", "key"), "print a key's value"),
        ("delete", _delete, ("db", "key"), "remove a key"),
        ("dump-sst", _dump, ("file",), "print a data file's entries"),
        ("version", None, (), "print the version"),
        ("help", None, (), "print this message"),
    ):
        command = commands.add_parser(name, help=about)
        command.set_defaults(run=run)
        for word in words:
            command.add_argument(word)
        if name in ("put", "delete"):
            command.add_argument("--sync", action="store_true", help="durable against a loss of power")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = arguments()
    try:
        a = parser.parse_args(argv)
    except SystemExit as e:  # 0 after --help, else a usage error that has been printed
        return e.code
    if a.run is None:
        print(loam.__version__ if a.command == "version" else parser.format_help().rstrip())
        return DONE
    own = spark is None
    if own:
        spark = SparkSession.builder.appName("loam").config("spark.ui.showConsoleProgress", "false").getOrCreate()
        spark.sparkContext.setLogLevel("ERROR")
    try:
        a.run(spark, a)
    except NotFound:
        print("loam: not found", file=sys.stderr)
        return ABSENT
    except (StoreError, PySparkException) as e:
        print(f"loam: {getattr(e, 'code', type(e).__name__)}: {str(e).splitlines()[0] if str(e) else ''}", file=sys.stderr)
        return FAILED
    finally:
        sys.stdout.flush()
        if own:
            spark.stop()
    return DONE


if __name__ == "__main__":
    sys.exit(main())
