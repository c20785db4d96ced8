"""Sinks: shards, drop lists, manifests, split lists, reports and summaries."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.near import Shingles, shingle_sets
from ..tables import written


def write_shards(sharded: DataFrame, path: str, shard_size: int = 10_000, tokens: Callable[[Column], Column] | None = None) -> None:
    """Chunks as Parquet, a folder for each shard: columns tokens, text, length, doc_id, position, local_index.

    With ``tokens``, the tokens are cut from the text again and don't travel with it. There are many small files, so tasks put
    theirs in place themselves: done by the driver, one by one, that would take longer than the rest.
    """
    order = sharded.columns
    rows = (sharded.drop("tokens") if tokens else sharded).repartition("shard_id").sortWithinPartitions("shard_id", "local_index")
    rows = rows.withColumn("tokens", tokens(F.col("text"))).select(*order) if tokens and "tokens" in order else rows
    rows.write.options(**{"maxRecordsPerFile": shard_size, "mapreduce.fileoutputcommitter.algorithm.version": 2}).partitionBy("shard_id").mode("overwrite").parquet(path)


def write_shard_set(sharded: DataFrame, path: str, shard_size: int = 10_000, shingle_size: int = 5, tokens: Callable[[Column], Column] | None = None) -> None:
    """Everything that later steps read of a set of shards, under ``path``:

    ``shards`` (Parquet), ``chunk_metadata`` (JSON lines of shard_id, local_index, length, exact_hash), ``shingles`` (JSON lines of
    shard_id, local_index, shingles; gzip) and ``manifest`` (one JSON object: a record for each shard, the two paths, and the total of tokens).

    The chunks are cut once and written; all four are made of that table, not of the shards' many files. ``tokens`` as in ``write_shards``.
    """
    sharded = sharded.drop("exact_hash")
    rows = written(sharded.drop("tokens") if tokens else sharded, "sharded")
    write_shards(rows.withColumn("tokens", tokens(F.col("text"))).select(*sharded.columns) if tokens else rows, f"{path}/shards", shard_size, tokens)
    rows.select("shard_id", "local_index", "length", X.sha1_signed64(F.col("text")).alias("exact_hash")).write.mode("overwrite").json(f"{path}/chunk_metadata")
    own = rows.withColumn("ord", F.struct("shard_id", "local_index"))
    sets = shingle_sets(own, Shingles(F.col("text"), F.col("length"), shingle_size, "none"))
    sets.select("ord.*", "shingles").write.mode("overwrite").option("compression", "gzip").json(f"{path}/shingles")
    shards = rows.groupBy("shard_id").agg(F.count("*").alias("chunk_count"), F.sum("length").alias("token_count"))
    record = F.struct("shard_id", F.concat(F.lit(f"{path}/shards/shard_id="), F.col("shard_id")).alias("path"), "chunk_count", "token_count")
    whole = shards.agg(F.sort_array(F.collect_list(record)).alias("shards"), F.lit(f"{path}/chunk_metadata").alias("chunk_metadata_path"), F.lit(f"{path}/shingles").alias("shingle_path"), F.coalesce(F.sum("token_count"), F.lit(0)).alias("total_tokens"))
    whole.select(F.to_json(F.struct(*whole.columns)).alias("value")).write.mode("overwrite").text(f"{path}/manifest")


def write_drop_hashes(drops: dict[str, DataFrame], manifest_path: str, path: str, order: str = "ord") -> None:
    """For each split the hashes (column ``hash``) that its corpus shares with training, in the order of the corpus, as JSON lines in ``<split>_drop``;
    and in ``manifest_digest`` the digests of the manifest's files, for an audit."""
    for split, rows in drops.items():
        rows.orderBy(order).select("hash").write.mode("overwrite").json(f"{path}/{split}_drop")
        spark = rows.sparkSession
    if drops:
        file_digests(spark, manifest_path).write.mode("overwrite").json(f"{path}/manifest_digest")


def write_drop_list(dropped: DataFrame, path: str) -> None:
    """Sorted JSON lines of (shard_id, local_index)."""
    dropped.select("shard_id", "local_index").distinct().orderBy("shard_id", "local_index").write.mode("overwrite").json(path)


def manifest_line(df: DataFrame) -> Column:
    """One JSON object: id, hash, kept, then reason and meta unless null."""
    return F.to_json(F.struct(*[c for c in ("id", "hash", "kept", "reason", "meta") if c in df.columns]), {"ignoreNullFields": "true"})


def write_manifest(manifest: DataFrame, path: str) -> None:
    manifest.select(manifest_line(manifest).alias("value")).write.mode("overwrite").text(path)


def content_digest(df: DataFrame) -> DataFrame:
    """One row: a digest of a table that doesn't depend on the order of rows, and their number."""
    row = F.xxhash64(*[F.col(c) for c in df.columns])
    return df.agg(F.coalesce(F.bit_xor(row), F.lit(0)).alias("digest_xor"), F.coalesce(F.sum(F.pmod(row, F.lit(1 << 31))), F.lit(0)).alias("digest_sum"), F.count("*").alias("n_rows"))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, digest): XXH64 of each file's bytes; empty files are passed over, as scans do."""
    @F.pandas_udf("string")
    def digest(contents: pd.Series) -> pd.Series:
        import xxhash

        return contents.map(xxhash.xxh64_hexdigest)

    return spark.read.format("binaryFile").load(path).select("path", digest("content").alias("digest"))


def write_split_lists(split: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """JSON lines of ids, a folder for each split."""
    split.select(id_col, "split").orderBy("split", id_col).write.partitionBy("split").mode("overwrite").json(path)


def write_summary(df: DataFrame, path: str) -> None:
    """Tab-separated with a header and no quoting."""
    df.write.csv(path, sep="\t", header=True, quote="", escapeQuotes=False, mode="overwrite")


def report(summary: DataFrame, path: str, **more) -> None:
    """A nested JSON report of a summary with one row for each run (a few rows)."""
    with open(path, "w", encoding="utf-8") as f:
        json.dump(more | {"runs": [r.asDict(recursive=True) for r in summary.collect()]}, f, indent=2)
