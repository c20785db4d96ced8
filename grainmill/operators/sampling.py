"""Shuffles, ranks and samples in hash order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(id_col: Column, seed: int = 0) -> Column:
    """A key to sort by: the SHA-1 of the id (and seed); the same in any engine and under any partitioning."""
    text = id_col.cast("string") if not seed else F.concat_ws("|", F.lit(str(seed)), id_col.cast("string"))
    return F.sha1(text.cast("binary"))


def shuffled(df: DataFrame, id_col: str = "doc_id", seed: int = 0) -> DataFrame:
    return df.orderBy(hash_order(F.col(id_col), seed), id_col)


def with_global_rank(df: DataFrame, order: Column, *ties: str) -> DataFrame:
    """``df`` and ``rank`` from 0 in the order of a hexadecimal key.

    Rows are ranked within the 65536 values of the key's first four digits, whose sizes (a table of as many rows at most)
    are summed up separately; the hash deals rows evenly to them.
    """
    own = df.withColumn("__key", order).withColumn("__head", F.substring("__key", 1, 4))
    sizes = own.groupBy("__head").count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("__head").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("__head", before.alias("__before"))
    within = F.row_number().over(Window.partitionBy("__head").orderBy("__key", *ties)) - 1
    return own.withColumn("__in", within).join(F.broadcast(sizes), "__head").withColumn("rank", F.col("__before") + F.col("__in")).drop("__key", "__head", "__in", "__before")


def random_k(df: DataFrame, k: int, id_col: str = "doc_id", seed: int = 0) -> DataFrame:
    """``k`` rows without replacement, all if there are no more: a distributed top-k by hash, also a reservoir's result."""
    return df.orderBy(hash_order(F.col(id_col), seed), id_col).limit(k)


def epochs(df: DataFrame, n: int, *ids: str, seed: int = 0) -> DataFrame:
    """``n`` passes over ``df`` (column ``epoch``), each in an order of its own by hash (column ``place``, to sort by within an epoch)."""
    out = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return out.withColumn("place", F.sha1(F.concat_ws("|", F.lit(str(seed)), F.col("epoch").cast("string"), *[F.col(c).cast("string") for c in ids]).cast("binary")))


def batches(df: DataFrame, rank: str, size: int, item: str) -> DataFrame:
    """(batch, items): runs of ``size`` rows in the order of a rank from 0."""
    return df.groupBy(F.floor(F.col(rank) / size).alias("batch")).agg(F.transform(F.array_sort(F.collect_list(F.struct(rank, item))), lambda x: x[item]).alias("items"))


def limited(docs: DataFrame, text: Column, limit: int | None, nonempty_first: bool = True) -> DataFrame:
    """Up to ``limit`` documents with text. ``nonempty_first`` counts these alone (0 or None: no limit); else the limit counts
    all rows before empty ones go (None: no limit, 0: nothing)."""
    some = (text.isNotNull()) & (text != "")
    if nonempty_first:
        out = docs.where(some)
        return out.limit(limit) if limit else out
    return (docs if limit is None else docs.limit(limit)).where(some)
