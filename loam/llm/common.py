"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Arrow batches hold at most this many rows and bytes, so that a Python worker's memory does not grow with the table.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Where the session names none: in local mode, as in tests, a temporary folder is set; on a cluster it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="loam-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def stage(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    drop_left(df)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def leaving(df: DataFrame, *used: DataFrame) -> DataFrame:
    """df, which reads the staged tables used; stage(df), or drop_left(df) once df has been written, removes them."""
    df._left = used
    return df


def drop_left(df: DataFrame) -> None:
    for used in getattr(df, "_left", ()):
        drop_staged(used)


def drop_staged(df: DataFrame) -> None:
    """Remove what stage() wrote; only for tables that no later plan reads."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._staged_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: What a Python worker keeps between tasks, and the operator it belongs to: workers outlive stages, models must not.
_kept: dict = {}
_ran = [""]
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only


def kept(name, make: Callable):
    """make(), or what it made before in this worker; gone once the worker turns to another operator."""
    if name not in _kept:
        _kept[name] = make()
    return _kept[name]


def turn_to(operator: str) -> None:
    if _ran[0] != operator:
        _kept.clear()
        _ran[0] = operator
        pa.set_memory_pool(pa.system_memory_pool())  # the others hold on to freed memory


def give_back() -> None:
    """Freed memory goes back to the machine: idle workers are counted with their executor."""
    if _trim:
        _trim(0)


def lean(run: Callable, operator: str) -> Callable:
    """A function for mapInArrow whose worker keeps nothing of other operators and gives freed memory back."""

    def out(batches):
        turn_to(operator)
        try:
            yield from run(batches)
        finally:
            give_back()

    return out


def leanly(operator: str, f: Callable, *args):
    """The same for one group of applyInArrow."""
    turn_to(operator)
    try:
        return f(*args)
    finally:
        give_back()


def map_rows(df: DataFrame, columns: list[str], each: Callable[[Iterator[tuple]], Iterable[tuple]], schema: str, size: int = BATCH_ROWS) -> DataFrame:
    """Apply a generator over the partition's rows (tuples of columns) and gather what it yields under schema."""
    bound_batches(df.sparkSession)
    target = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(target)

    def run(batches):
        def rows():
            for b in batches:
                yield from zip(*(c.to_pylist() for c in b.columns))

        kept = []
        for r in each(rows()):
            kept.append(r)
            if len(kept) >= size:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*kept), arrow)], schema=arrow)
                kept = []
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*kept), arrow)], schema=arrow)

    return df.select(*columns).mapInArrow(lean(run, each.__module__), schema)


def filter_rows(df: DataFrame, column: str, keep: Callable[[list], list]) -> DataFrame:
    """Rows of df, with all their columns, for which keep(values of column) is true; batch by batch."""
    bound_batches(df.sparkSession)
    at = df.columns.index(column)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(keep(b.column(at).to_pylist()), pa.bool_()))

    return df.mapInArrow(lean(run, keep.__module__), df.schema)
