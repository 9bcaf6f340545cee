"""Running aggregates, dense positions and cuts over whole tables, without gathering them into one task.

Rows are cut into runs; a window works inside each run, and the runs' totals (one row each) are accumulated and joined
back. A hot group is cut like any other, since runs are cut by order and not by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window, functions as F

#: Rows of a run, where the order is a dense index; runs of runs, before one task accumulates what is left.
RUN, LEVELS = 4096, 2

#: Rows of the sample that one part's cuts come from.
SAMPLE_A_PART = 100


def running(df: DataFrame, index: str, value: str, out: str, kind: str = "sum", by: tuple[str, ...] = (), run: int = RUN, levels: int = LEVELS, inclusive: bool = True) -> DataFrame:
    """df with out: the sum or maximum of value up to and with this row, by a non-negative index, within each group of by.

    Not inclusive: up to the row before; null where there is none. With two levels, the last window has a row for each
    run * run indexes (60,000 rows of 10**12).
    """
    f = {"sum": F.sum, "max": F.max}[kind]
    end = Window.currentRow if inclusive else -1
    if not levels:
        return df.withColumn(out, f(value).over(Window.partitionBy(*by).orderBy(index).rowsBetween(Window.unboundedPreceding, end)))
    name, total, before, inside = (f"_{x}{levels}" for x in ("run", "total", "before", "inside"))
    cut = df.withColumn(name, F.floor(F.col(index) / run))
    near = Window.partitionBy(*by, name).orderBy(index).rowsBetween(Window.unboundedPreceding, end)
    totals = cut.groupBy(*by, name).agg(f(value).alias(total))
    earlier = running(totals, name, total, before, kind, by, run, levels - 1, False).select(*by, name, before)
    joined = cut.withColumn(inside, f(value).over(near)).join(earlier, [*by, name])
    merged = F.coalesce(F.col(inside) + F.col(before), inside, before) if kind == "sum" else F.greatest(inside, before)
    return joined.withColumn(out, merged).select(*df.columns, out)


def directions(order: list[tuple[str, bool]]) -> list[Column]:
    """Nulls come first, whichever the direction."""
    return [F.asc_nulls_first(c) if up else F.desc_nulls_first(c) for c, up in order]


def cuts_of(df: DataFrame, order: list[tuple[str, bool]], parts: int) -> list[Row]:
    """At most parts - 1 cut points of the order, from SAMPLE_A_PART rows a part chosen by hash, in one pass."""
    keys = [c for c, _ in order]
    dealt = F.xxhash64(*keys)
    some = df.groupBy(F.pmod(dealt, F.lit(SAMPLE_A_PART * parts)).alias("_b")).agg(F.min_by(F.struct(*keys), dealt).alias("_k"))
    ranked = some.select("_k.*").dropna().orderBy(*directions(order)).collect()
    return [ranked[len(ranked) * k // parts] for k in range(1, parts)] if len(ranked) >= parts else []


def part_of(order: list[tuple[str, bool]], cuts: list[Row]) -> Column:
    """How many cuts are at or before the row, by binary search; 0 where a column is null."""
    if not cuts:
        return F.lit(0)
    held = F.array(*(F.struct(*(F.lit(cut[c]).alias(c) for c, _ in order)) for cut in cuts))

    def reached(cut: Column) -> Column:
        out = F.lit(True)
        for c, up in reversed(order):
            out = F.when(F.col(c) == cut[c], out).otherwise(F.col(c) > cut[c] if up else F.col(c) < cut[c])
        return out

    steps = F.array(*(F.lit(1 << k) for k in reversed(range(len(cuts).bit_length()))))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(reached(F.get(held, at + step - 1)), at + step).otherwise(at))


def parts_for(df: DataFrame, parts: int | None) -> int:
    return parts or max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def positions(df: DataFrame, order: list[tuple[str, bool]], out: str, parts: int | None = None, start: int = 1) -> DataFrame:
    """df with out: dense positions in the order of (column, ascending) pairs, which must tell rows apart.

    Three passes: a bounded sample for the cuts, the size of each part, the numbers. A key with many rows is cut as well.
    """
    cuts = cuts_of(df, order, parts_for(df, parts))
    cut_up = df.withColumn("_part", part_of(order, cuts))
    sizes = dict(cut_up.groupBy("_part").count().collect())
    offsets, at = [], start - 1
    for k in range(len(cuts) + 1):
        offsets.append(at)
        at += sizes.get(k, 0)
    base = F.element_at(F.array(*(F.lit(x).cast("long") for x in offsets)), F.col("_part") + 1)
    number = F.row_number().over(Window.partitionBy("_part").orderBy(*directions(order)))
    return cut_up.withColumn(out, base + number).select(*df.columns, out)
