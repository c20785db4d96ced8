"""Train, validation and test splits in an order that a hash of the id gives, so they don't depend on partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sampling import hash_order, with_global_rank


def fraction_counts(n: int, train: float, val: float) -> tuple[int, int, int]:
    """Sizes by truncated shares, one at least; where these leave nothing for the test split, all but two train."""
    if n == 0:
        return 0, 0, 0
    a, b = max(1, int(n * train)), max(1, int(n * val))
    if a + b >= n:
        a, b = max(1, n - 2), 1
    return a, min(b, n - a), max(0, n - a - b)


def split_fractions(df: DataFrame, id_col: str = "doc_id", train: float = 0.9, val: float = 0.05) -> DataFrame:
    """``df`` and ``split``. The rank goes over all rows without one task seeing them all."""
    a, b, _ = fraction_counts(df.count(), train, val)
    ranked = with_global_rank(df, hash_order(F.col(id_col)), id_col)
    return ranked.withColumn("split", F.when(F.col("rank") < a, "train").when(F.col("rank") < a + b, "val").otherwise("test")).drop("rank")


def stratified_split(df: DataFrame, by: list[str], id_col: str = "doc_id", train: float = 0.8, val: float = 0.1, test: float = 0.1) -> DataFrame:
    """``df`` and ``split``, by shares of each stratum (half-even rounding; one for training and one for validation at least).

    Rows with a null in a stratum column go, singletons train, pairs train and validate.
    """
    if not math.isclose(train + val + test, 1.0, rel_tol=1e-3):
        raise ValueError("fractions must add up to 1")
    some = df.dropna(subset=by)
    sizes = some.groupBy(*by).agg(F.count("*").cast("double").alias("__n"))
    share = lambda f: F.greatest(F.lit(1.0), F.bround(F.col("__n") * F.lit(float(f)), 0))
    full = share(train) + share(val) >= F.col("__n")
    a = F.when(full, F.greatest(F.lit(1.0), F.col("__n") - 2)).otherwise(share(train))
    b = F.when(full, F.lit(1.0)).otherwise(share(val))
    short = (F.col("__n") - a - b <= 0) & (a > 1)
    sizes = sizes.select(*by, F.when(short, a - 1).otherwise(a).alias("__a"), b.alias("__b"))
    # a stratum may hold a large share of all rows: rank within 256 parts of it by hash, then add the sizes of those before
    own = some.withColumn("__key", hash_order(F.col(id_col))).withColumn("__head", F.substring("__key", 1, 2))
    before = F.coalesce(F.sum("count").over(Window.partitionBy(*by).orderBy("__head").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    heads = own.groupBy(*by, "__head").count().select(*by, "__head", before.alias("__before"))
    within = F.row_number().over(Window.partitionBy(*by, "__head").orderBy("__key", id_col)) - 1
    ranked = own.withColumn("__in", within).join(heads, [*by, "__head"]).withColumn("__rank", F.col("__before") + F.col("__in")).drop("__key", "__head", "__in", "__before")
    marked = ranked.join(sizes, by)
    return marked.withColumn("split", F.when(F.col("__rank") < F.col("__a"), "train").when(F.col("__rank") < F.col("__a") + F.col("__b"), "val").otherwise("test")).drop("__rank", "__a", "__b")


def by_hash(id_col: Column, buckets: int = 10) -> Column:
    """A bucket from 0, from the first 7 hexadecimal digits of the id's SHA-1."""
    return F.conv(F.substring(F.sha1(id_col.cast("string").cast("binary")), 1, 7), 16, 10).cast("bigint") % buckets
