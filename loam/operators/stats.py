"""Measurement analytics: log-linear histograms, percentiles, round summaries, amplification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# Exact below 16, then 16 buckets a power of two.
SUB = 16


def bucket(v: Column) -> Column:
    """The bucket of a non-negative integer."""
    v = v.cast("long")
    shift = F.length(F.bin(v)) - 5
    return F.when(v < SUB, v).otherwise(SUB * shift + F.call_function("shiftright", v, shift)).cast("long")


def lower_bound(b: Column) -> Column:
    shift = F.floor(b / SUB) - 1
    return F.when(b < SUB, b).otherwise(F.call_function("shiftleft", (b % SUB) + SUB, shift.cast("int"))).cast("long")


def upper_bound(b: Column) -> Column:
    """The first value above the bucket."""
    return lower_bound(b + 1)


def histogram(samples: DataFrame, value: str = "value") -> DataFrame:
    b = F.col("bucket")
    return samples.groupBy(bucket(F.col(value)).alias("bucket")).agg(F.count("*").alias("n")).select("bucket", lower_bound(b).alias("low"), upper_bound(b).alias("high"), "n")


def summary(samples: DataFrame, value: str = "value") -> DataFrame:
    v = F.col(value)
    return samples.agg(F.count(v).alias("n"), F.min(v).alias("least"), F.max(v).alias("most"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("deviation"))


def percentiles(samples: DataFrame, ps: list[float], value: str = "value") -> DataFrame:
    """By rank in the buckets, interpolated inside the bucket and held to the least and most value. 976 buckets at most."""
    h = histogram(samples, value)
    total = samples.agg(F.count(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("most"))
    upto = F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    asked = samples.sparkSession.createDataFrame([(float(p),) for p in ps], "p double")
    rows = h.withColumn("upto", upto).crossJoin(F.broadcast(total)).crossJoin(F.broadcast(asked))
    wanted = F.col("total") * F.col("p") / 100
    first = rows.where(F.col("upto") >= wanted).groupBy("p", "total", "least", "most").agg(F.min_by(F.struct("low", "high", "n", "upto"), "bucket").alias("b"))
    inside = (wanted - (F.col("b.upto") - F.col("b.n"))) / F.col("b.n")
    value_at = F.col("b.low") + (F.col("b.high") - F.col("b.low")) * inside
    return first.select("p", F.greatest(F.col("least").cast("double"), F.least(F.col("most").cast("double"), value_at)).alias("value"))


def rounds(measured: DataFrame, stable_cv: float = 0.05, least_rounds: int = 5) -> DataFrame:
    """workload, value -> median, mean, least, most, coefficient of variation (sample), and whether it is stable."""
    cv = F.when((F.col("n") < 2) | (F.col("mean") == 0), F.lit(0.0)).otherwise(F.col("sd") / F.abs("mean"))
    out = measured.groupBy("workload").agg(F.count("*").alias("n"), F.median("value").alias("median"), F.avg("value").alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"), F.stddev_samp("value").alias("sd")).withColumn("cv", cv)
    return out.withColumn("stable", F.col("cv") <= stable_cv).withColumn("publishable", F.col("stable") & (F.col("n") >= least_rounds)).drop("sd")


def write_amplification(written: DataFrame) -> DataFrame:
    """payload, flushed, compacted (bytes) -> amplification."""
    return written.withColumn("amplification", (F.col("flushed") + F.col("compacted")) / F.col("payload"))
