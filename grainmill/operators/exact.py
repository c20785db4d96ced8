"""Exact deduplication by content key: the first row in a given order stays."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..tables import written


def marked(df: DataFrame, key: Column, *order: str) -> DataFrame:
    """(order columns, key, kept): whether the row is the first of its key. The order must tell rows apart.

    Keys are computed once and written without the rest of the row. The first is a pre-aggregated minimum and is joined back,
    so that a very common key isn't one task's work.
    """
    keys = written(df.select(*order, key.alias("key")), "keys")
    first = keys.groupBy(F.col("key").alias("__key")).agg(F.min(F.struct(*order)).alias("__first"))
    return keys.join(first, keys["key"].eqNullSafe(first["__key"])).select(*order, "key", (F.struct(*order).eqNullSafe(F.col("__first"))).alias("kept"))


def _rows(df: DataFrame, marks: DataFrame, order: tuple[str, ...], how: str) -> DataFrame:
    """``df`` joined with a table of its own order columns, which is written, so that a small one is known to be small and is broadcast."""
    own = written(marks, "marks").select(*[F.col(c).alias(f"__{c}") for c in order], *[c for c in marks.columns if c not in order])
    return df.join(own, reduce(lambda a, b: a & b, [df[c].eqNullSafe(own[f"__{c}"]) for c in order]), how).drop(*[f"__{c}" for c in order])


def ranked(df: DataFrame, key: Column, *order: str) -> DataFrame:
    """``df``, ``key`` and ``kept``."""
    return _rows(df, marked(df, key, *order), order, "inner")


def keep_first(df: DataFrame, key: Column, *order: str) -> DataFrame:
    return _rows(df, marked(df, key, *order).where("kept"), order, "left_semi")


def drop_list(chunks: DataFrame, hash_col: str = "exact_hash") -> DataFrame:
    """(shard_id, local_index) of all chunks but the first of each hash."""
    return marked(chunks, F.col(hash_col), "shard_id", "local_index").where("NOT kept").select("shard_id", "local_index")


def duplicate_counts(df: DataFrame, key: Column) -> DataFrame:
    """One row: keys that repeat, and rows beyond the first of each."""
    return df.groupBy(key.alias("key")).count().agg(F.coalesce(F.sum((F.col("count") > 1).cast("bigint")), F.lit(0)).alias("repeated_keys"), F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicates"), F.coalesce(F.sum("count"), F.lit(0)).alias("n_rows"))


def manifest(df: DataFrame, entry_id: Column, digest: Column, *order: str) -> DataFrame:
    """(id, hash, kept, reason) for each row; ``entry_id`` is made of the order columns."""
    return marked(df, digest, *order).select(entry_id.alias("id"), F.col("key").alias("hash"), "kept", F.when(~F.col("kept"), "duplicate").alias("reason"))


def doc_manifest(docs: DataFrame, digest=F.sha1) -> DataFrame:
    """Documents by the hash of their simple normal form, the first doc_id stays."""
    return manifest(docs, X.manifest_doc_id(F.col("doc_id")), digest(X.normalize_simple(F.col("text")).cast("binary")), "doc_id")


def chunk_manifest(chunks: DataFrame, digest=F.sha1) -> DataFrame:
    return manifest(chunks, X.manifest_chunk_id(F.col("doc_id"), F.col("position")), digest(F.col("text").cast("binary")), "doc_id", "position")
