"""Mixing sources to target weights by Poisson replication, with DataFrame functions only.

A source of mass m and target share w is repeated at the mean rate w * total / m. Each document's count inverts the
Poisson distribution of that rate at a uniform number taken from a hash of seed and id, so it depends on nothing else;
the document is exploded by its count. The copies are dealt out evenly, whatever their ids or texts are, and each part is
sorted by a second hash: a global shuffle with one exchange and no sampling pass. A rate above ``MOST_RATE`` is the sum of
equal smaller ones, with a number of its own for each, as a sum of Poisson draws is one of the sum of the rates.

Defined results: a null source is a source of its own; null ids and repeated rows draw the same number as their like; empty
and very long texts count by their length; a source without a weight is left out, and one of no mass (only empty or null
texts) has rate 0 under ``unit="chars"``; an empty table gives an empty result. Column names are kept; where the table has a
column of the name ``copy_col`` already, the added one has as many underscores at its end as make it new.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import shuffle_partitions, written

#: Up to so many bytes the table of sources is broadcast; beyond, the join is by shuffle.
BROADCAST_BYTES = 32 << 20
#: Beyond this a draw would need more terms than a double can tell apart.
MOST_RATE = 500.0


def uniform(seed: int, *cols: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5: exact as a double, and the same in any engine."""
    key = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("bigint").cast("double") / float(1 << 52)


def poisson_cdf(rate: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... until what is left is below 1e-15 or so."""
    terms = F.sequence(F.lit(1), F.ceil(rate + 9 * F.sqrt(rate) + 20).cast("int"))
    start = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("cdf"))

    def step(s: Column, k: Column) -> Column:
        p = s["p"] * rate / k.cast("double")
        return F.struct(p.alias("p"), F.concat(s["cdf"], F.array(F.element_at(s["cdf"], -1) + p)).alias("cdf"))

    return F.aggregate(terms, start, step, lambda s: s["cdf"])


def replication(df: DataFrame, source_col: str, text_col: str, weights: dict[str | None, float] | None, power: float, unit: str) -> DataFrame:
    """(source, rate): by the given weights, or by each source's mass to a power below 1 (which lifts small sources)."""
    mass = F.count("*").cast("double") if unit == "docs" else F.sum(F.length(F.coalesce(F.col(text_col), F.lit("")))).cast("double")
    of = df.groupBy(F.col(source_col).alias("source")).agg(mass.alias("mass"))
    if weights is None:
        of = of.withColumn("weight", F.pow("mass", F.lit(power)))
    else:
        kind = T.StructType([T.StructField("source", df.schema[source_col].dataType), T.StructField("weight", T.DoubleType())])
        of = of.join(df.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], kind).withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    of = written(of, "sources")  # a row for each source
    total = of.agg(F.sum("mass"), F.sum("weight"), F.count("*")).first()
    if not total[2]:
        return of.select("source", F.lit(0.0).alias("rate"))
    rate = F.when(F.col("mass") > 0, F.col("weight") / F.lit(total[1] or 1.0) * F.lit(total[0]) / F.col("mass")).otherwise(0.0)
    return of.select("source", rate.alias("rate"))


def mix(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: dict[str | None, float] | None = None, power: float = 0.7, unit: str = "chars", seed: int = 2024, copy_col: str = "copy") -> DataFrame:
    """The rows of ``df``, each as often as its count says, shuffled; ``copy_col`` numbers the copies of a row from 0."""
    while copy_col.lower() in {c.lower() for c in df.columns}:
        copy_col += "_"
    rates = replication(df, source_col, text_col, weights, power, unit)
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / MOST_RATE)).cast("int")
    rates = rates.withColumn("parts", parts).withColumn("rate", F.col("rate") / F.col("parts"))
    size = rates.agg(F.coalesce(F.sum(100 + 8 * (F.col("rate") + 9 * F.sqrt("rate") + 20)), F.lit(0.0))).first()[0]
    table = rates.select(F.col("source").alias("__gm_source"), F.col("parts").alias("__gm_parts"), poisson_cdf(F.col("rate")).alias("__gm_cdf"))
    table = F.broadcast(table) if size <= BROADCAST_BYTES else table
    columns = [F.col(f"`{c}`") for c in df.columns]
    drawn = df.withColumn("__gm_own", F.col(source_col)).withColumn("__gm_id", F.col(id_col)).withColumn("__gm_u", uniform(seed, F.col(id_col)))
    drawn = drawn.join(table, F.col("__gm_own").eqNullSafe(F.col("__gm_source")))
    one = lambda u: F.size(F.filter("__gm_cdf", lambda c: c <= u))
    rest = F.aggregate(F.sequence(F.lit(1), F.col("__gm_parts") - 1), F.lit(0), lambda n, k: n + one(uniform(seed, F.col("__gm_id"), k)))
    count = one(F.col("__gm_u")) + F.when(F.col("__gm_parts") > 1, rest).otherwise(0)
    drawn = drawn.withColumn("__gm_n", count).where("__gm_n > 0")
    out = drawn.select(*columns, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__gm_n").cast("bigint") - 1)).alias(copy_col))
    out = out.repartition(shuffle_partitions(df.sparkSession))
    return out.sortWithinPartitions(F.xxhash64(F.lit(seed + 1), F.col(f"`{id_col}`"), F.col(f"`{copy_col}`")))
