"""Summaries of runs, timings and learning curves."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import shuffle_partitions, written


def by_directory(summaries: DataFrame, value: str) -> DataFrame:
    """Mean and interval of ``value`` over all rows of each directory of summaries (column ``directory`` of ``readers.run_summaries``)."""
    return mean_and_ci(summaries.withColumn(value, F.col(value).try_cast("double")), value, "directory")


def mean_and_ci(df: DataFrame, value: str, *by: str) -> DataFrame:
    """Mean and half width of the 95 % interval (1.96 standard errors); NaN below two values."""
    ci = F.when(F.count(value) < 2, F.lit(float("nan"))).otherwise(1.96 * F.stddev_samp(value) / F.sqrt(F.count(value)))
    return df.groupBy(*by).agg(F.coalesce(F.avg(value), F.lit(float("nan"))).alias("mean"), ci.alias("ci"), F.count(value).alias("n"))


def _joined(left: DataFrame, right: DataFrame, *by: str, how: str = "inner") -> DataFrame:
    """A join on equal columns, nulls being equal too."""
    own = right.withColumnsRenamed({c: f"__right_{c}" for c in by})
    return left.join(own, reduce(lambda a, b: a & b, [left[c].eqNullSafe(own[f"__right_{c}"]) for c in by], F.lit(True)), how).drop(*[f"__right_{c}" for c in by])


def ranked_values(df: DataFrame, value: str, *by: str) -> DataFrame:
    """(…, value, start, stop, n): for each distinct value of a group the ranks from 0 that it takes in it, and the group's size.

    Values are counted first, dealt to ranges of (group, value), and ranked by the sums of the ranges before: so neither a
    large group nor a frequent value is one task's work. Nulls are left out.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("value")).agg(F.count("*").alias("k"))
    own = written(counts.repartitionByRange(shuffle_partitions(df.sparkSession), *by, "value").withColumn("__run", F.spark_partition_id()), "ranges")
    runs = own.groupBy(*by, "__run").agg(F.sum("k").alias("__k"))
    group = Window.partitionBy(*by)
    runs = runs.select(*by, "__run", F.coalesce(F.sum("__k").over(group.orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"), F.sum("__k").over(group).alias("n"))
    inside = F.coalesce(F.sum("k").over(Window.partitionBy(*by, "__run").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    both = _joined(own.withColumn("__inside", inside), runs, *by, "__run").withColumn("start", F.col("__before") + F.col("__inside"))
    return both.select(*by, "value", "start", (F.col("start") + F.col("k")).alias("stop"), "n")


def _at(rank: Column) -> Column:
    """The value at a rank from 0, as an aggregate of ``ranked_values``."""
    return F.max(F.when((F.col("start") <= rank) & (rank < F.col("stop")), F.col("value")))


def stage_stats(df: DataFrame, value: str, *by: str) -> DataFrame:
    """Count, mean, population deviation, extremes and interpolated percentiles."""
    places = {f"p{round(100 * q)}": F.lit(q) * (F.col("n") - 1) for q in (0.5, 0.9, 0.95, 0.99)}

    def between(place: Column) -> Column:
        low, high = _at(F.floor(place)), _at(F.ceil(place))
        part = F.max(place - F.floor(place))
        return low + (high - low) * part

    moments = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("stddev"), F.min(value).alias("min"), F.max(value).alias("max"))
    cuts = ranked_values(df, value, *by).groupBy(*by).agg(*[between(p).alias(name) for name, p in places.items()])
    return _joined(moments, cuts, *by, how="left")


def nearest_rank(df: DataFrame, value: str, p: float, *by: str) -> DataFrame:
    """The value at place ceil(p n); 0 for none."""
    place = F.greatest(F.lit(0), F.ceil(F.lit(p) * F.col("n")) - 1)
    found = ranked_values(df, value, *by).groupBy(*by).agg(_at(place).alias("value"))
    empty = df.groupBy(*by).agg(F.count(value).alias("n")).where("n = 0").select(*by, F.lit(0.0).alias("value"))
    return found.unionByName(empty)


def last_of_run(results: DataFrame, run: str, order: str, *values: str) -> DataFrame:
    """Of each run's results the last."""
    return results.groupBy(run).agg(*[F.max_by(v, order).alias(v) for v in values])


def interpolated(curves: DataFrame, target: Column, *by: str) -> DataFrame:
    """(…, tokens): where each curve (tokens, metric) first crosses ``target``, by the straight line between its neighbours."""
    w = Window.partitionBy(*by).orderBy("tokens")
    seg = curves.withColumn("t1", F.lead("tokens").over(w)).withColumn("m1", F.lead("metric").over(w)).withColumn("__target", target)
    m, g = F.col("metric"), F.col("__target")
    hit = seg.where(F.col("t1").isNotNull() & (((m >= g) & (F.col("m1") <= g)) | ((m <= g) & (F.col("m1") >= g))))
    x = F.when(m == F.col("m1"), F.col("tokens")).otherwise(F.col("tokens") + (g - m) / (F.col("m1") - m) * (F.col("t1") - F.col("tokens")))
    return hit.withColumn("__x", x).groupBy(*by).agg(F.min_by("__x", "tokens").alias("tokens"))


def data_equivalent_factor(baseline: DataFrame, other: DataFrame, target: float) -> DataFrame:
    """One row: tokens that the baseline needs over those that the other needs; NaN if either never gets there."""
    one = lambda c, name: interpolated(c.withColumn("__c", F.lit(1)), F.lit(target), "__c").agg(F.first("tokens").alias(name))
    both = one(baseline, "base").crossJoin(one(other, "other"))  # one row each
    return both.select(F.when(F.col("base").isNull() | F.col("other").isNull() | (F.col("other") == 0), F.lit(float("nan"))).otherwise(F.col("base") / F.col("other")).alias("factor"))
