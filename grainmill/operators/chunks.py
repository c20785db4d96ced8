"""Token windows of documents, their statistics, and shard numbers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..tables import shuffle_partitions, written


def build_chunks(docs: DataFrame, size: int, stride: int, least: int = 0, prefix: str = "train", full_only: bool = False, tokens: Callable[[Column], Column] = X.word_tokens, normalize: Callable[[Column], Column] = X.normalize_simple, glue: str = " ", carry: tuple[str, ...] = ()) -> DataFrame:
    """(chunk_id, doc_id, position, tokens, text, length). Positions are given before windows below ``least`` tokens go.

    ``carry`` names columns of ``docs`` that each chunk gets as well.
    """
    cut = docs.select("doc_id", *carry, normalize(F.col("text")).alias("t")).select("doc_id", *carry, X.windows(tokens(F.col("t")), size, stride, full_only).alias("w"))
    out = cut.select("doc_id", *carry, F.posexplode("w").alias("position", "tokens")).withColumn("length", F.size("tokens"))
    return out.where(F.col("length") >= least).select(X.chunk_id(prefix, F.col("doc_id"), F.col("position")).alias("chunk_id"), "doc_id", "position", "tokens", F.array_join("tokens", glue).alias("text"), "length", *carry)


def chunk_stats(chunks: DataFrame) -> DataFrame:
    """One row; zeros for no chunks."""
    return chunks.agg(F.count("*").alias("n_chunks"), F.coalesce(F.avg("length"), F.lit(0.0)).alias("avg_length"), F.coalesce(F.sum("length"), F.lit(0)).cast("bigint").alias("total_tokens"))


def window_count(n: Column, size: int, stride: int, least: int = 0, full_only: bool = False) -> Column:
    """How many windows of at least ``least`` tokens ``n`` tokens give: those at a start that leaves so many."""
    need = size if full_only else max(1, least)
    return F.when(n >= need, F.floor((n - need) / stride) + 1).otherwise(0).cast("bigint") if least <= size else F.lit(0).cast("bigint")


def tokens_before(n: Column, place: Column, size: int, stride: int) -> Column:
    """The tokens of the first ``place`` windows of ``n`` tokens: full ones, then tails that each lose a stride."""
    full = F.least(place, F.when(n >= size, F.floor((n - size) / stride) + 1).otherwise(0)).cast("bigint")
    tails = place - full
    return full * size + tails * n - F.lit(stride) * F.floor((full + place - 1) * tails / 2).cast("bigint")


def document_offsets(docs: DataFrame, size: int, stride: int, least: int = 0, full_only: bool = False, tokens: Callable[[Column], Column] = X.word_tokens, normalize: Callable[[Column], Column] = X.normalize_simple) -> DataFrame:
    """(doc_id, n_tokens, n_chunks, chunks_before, tokens_before): by arithmetic on each document's number of tokens, which is written once, without making a window."""
    t = docs.select("doc_id", normalize(F.col("text")).alias("t"))
    count = X.word_count(F.col("t")) if (tokens, normalize) == (X.word_tokens, X.normalize_simple) else F.size(tokens(F.col("t")))
    n = written(t.select("doc_id", count.cast("bigint").alias("n_tokens")), "tokens")
    n = n.withColumn("n_chunks", window_count(F.col("n_tokens"), size, stride, least, full_only)).where("n_chunks > 0")
    n = n.withColumn("__all", tokens_before(F.col("n_tokens"), F.col("n_chunks"), size, stride) + F.col("n_chunks"))
    before = running_offset(n, ["doc_id"], ["n_chunks", "__all"])
    return before.select("doc_id", "n_tokens", "n_chunks", F.col("before_n_chunks").alias("chunks_before"), F.col("before___all").alias("tokens_before"))


def sharded_chunks(docs: DataFrame, shard_size: int, size: int, stride: int, least: int = 0, **how) -> DataFrame:
    """The chunks of ``docs`` with shard number and place in the shard, by (doc_id, position).

    Windows below ``least`` tokens are a document's last, so a chunk's place among its document's chunks is its position.
    """
    offsets = document_offsets(docs, size, stride, least, **{k: v for k, v in how.items() if k in ("full_only", "tokens", "normalize")})
    placed = docs.join(written(offsets.select("doc_id", "chunks_before"), "offsets"), "doc_id")  # of known size, so that a small one is broadcast
    at = F.col("chunks_before") + F.col("position")
    chunks = build_chunks(placed, size, stride, least, carry=("chunks_before",), **how)
    return chunks.withColumn("shard_id", F.floor(at / shard_size).cast("bigint")).withColumn("local_index", (at % shard_size).cast("bigint")).drop("chunks_before")


def assign_shards(chunks: DataFrame, shard_size: int) -> DataFrame:
    """Shard number and place in the shard of any table of chunks, by (doc_id, position).

    Numbering goes by document: each document's count of chunks, a running sum over documents, then the place within.
    """
    before = running_offset(chunks.groupBy("doc_id").agg(F.count("*").alias("n")), ["doc_id"], ["n"])
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("position")) - 1
    at = F.col("before_n") + F.col("place")
    return chunks.withColumn("place", place).join(before.select("doc_id", "before_n"), "doc_id").withColumn("shard_id", F.floor(at / shard_size).cast("bigint")).withColumn("local_index", (at % shard_size).cast("bigint")).drop("place", "before_n")


def running_offset(df: DataFrame, keys: list[str], sizes: list[str]) -> DataFrame:
    """``df`` and a column ``before_…`` for each of ``sizes``: its sum over all rows before, in the order of ``keys``, which tell rows apart.

    Rows are dealt to ranges by sampled bounds and written once; a window runs within each range, and another over the sums of the ranges, a row for each partition. So no task sees
    all rows, whatever the values of the keys are.
    """
    own = written(df.repartitionByRange(shuffle_partitions(df.sparkSession), *keys).withColumn("__run", F.spark_partition_id()), "ranges")
    runs = own.groupBy("__run").agg(*[F.sum(c).alias(c) for c in sizes])
    over = Window.orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("__run", *[F.coalesce(F.sum(c).over(over), F.lit(0)).alias(f"__{c}") for c in sizes])
    within = Window.partitionBy("__run").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    for c in sizes:
        own = own.withColumn(f"before_{c}", F.coalesce(F.sum(c).over(within), F.lit(0)))
    both = own.join(F.broadcast(runs), "__run")
    for c in sizes:
        both = both.withColumn(f"before_{c}", F.col(f"before_{c}") + F.col(f"__{c}"))
    return both.drop("__run", *[f"__{c}" for c in sizes])


def shard_manifest(sharded: DataFrame) -> DataFrame:
    """A row for each shard: chunks and tokens."""
    return sharded.groupBy("shard_id").agg(F.count("*").alias("chunk_count"), F.sum("length").alias("token_count"))


def merge_shards(worker_chunks: DataFrame) -> DataFrame:
    """The union of workers' shards with new shard numbers, in the order of (worker, shard).

    The numbers come from the table of shards and are joined back.
    """
    shards = worker_chunks.select("worker", "shard_id").distinct().withColumn("n", F.lit(1).cast("bigint"))
    shards = running_offset(shards, ["worker", "shard_id"], ["n"]).select("worker", "shard_id", F.col("before_n").alias("new_shard_id"))
    return worker_chunks.join(shards, ["worker", "shard_id"])


def usable_chunks(chunks: DataFrame, dropped: DataFrame, block: int) -> DataFrame:
    """Chunks that aren't on the drop list and hold a whole block, cut to it."""
    stay = chunks.join(dropped, ["shard_id", "local_index"], "left_anti").where(F.size("tokens") >= block)
    return stay.withColumn("tokens", F.slice("tokens", 1, block))
