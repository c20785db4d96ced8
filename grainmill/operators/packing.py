"""Canaries, token packing, sliding windows and evaluation tails."""

from __future__ import annotations

import random
import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .chunks import running_offset, tokens_before


def canary_phrases(n: int, length: int = 24, prefix: str = "CANARY", seed: int = 116) -> list[str]:
    """``prefix-000:body`` with a seeded body of lower-case letters and digits."""
    rng = random.Random(seed)
    return [f"{prefix}-{i:03d}:{''.join(rng.choices(string.ascii_lowercase + string.digits, k=length))}" for i in range(n)]


def canary_chunks(spark: SparkSession, phrases: list[str], size: int, eos: str | None = None, tokens=X.word_tokens, glue: str = " ") -> DataFrame:
    """A chunk for each phrase, of document -1; one of ``size`` tokens or more is cut, and closed by ``eos``."""
    rows = spark.createDataFrame(list(enumerate(phrases)), "position int, phrase string")
    t = tokens(F.col("phrase"))
    cut = F.slice(t, 1, size - 1)
    cut = F.array_append(cut, F.lit(eos)) if eos is not None else cut
    rows = rows.withColumn("tokens", F.when(F.size(t) >= size, cut).otherwise(t))
    return rows.select(F.format_string("canary-%03d", "position").alias("chunk_id"), F.lit(-1).cast("bigint").alias("doc_id"), "position", "tokens", X.normalize_simple(F.array_join("tokens", glue)).alias("text"), F.size("tokens").alias("length"))


def insert_canaries(chunks: DataFrame, canaries: DataFrame) -> DataFrame:
    """After deduplication, so that canaries are never dropped."""
    return chunks.unionByName(canaries)


def canary_recall(generated: DataFrame) -> DataFrame:
    """(hits, recall) of (phrase, generated)."""
    hit = F.coalesce(F.contains("generated", "phrase"), F.lit(False)).cast("int")
    return generated.agg(F.coalesce(F.sum(hit), F.lit(0)).cast("bigint").alias("hits"), (F.coalesce(F.sum(hit), F.lit(0)) / F.greatest(F.lit(1), F.count("*"))).alias("recall"))


def packed(chunks: DataFrame, limit: int | None = None, offsets: DataFrame | None = None, size: int = 0, stride: int = 0) -> DataFrame:
    """(…, offset, take): where each chunk starts in the stream of all tokens with one closing token each, and how many of its
    tokens (the closing one included) come before ``limit``. The order is that of (doc_id, position).

    Offsets are running sums by document, then by position. For the whole chunks of documents they follow from ``offsets``
    (of ``document_offsets``, with the same ``size`` and ``stride``) by arithmetic; for any other table of chunks they are summed up.
    """
    own = chunks.withColumn("__size", F.col("length").cast("bigint") + 1)
    if offsets is not None:
        docs = offsets.select("doc_id", F.col("tokens_before").alias("__start"), "n_tokens")
        inside = tokens_before(F.col("n_tokens"), F.col("position").cast("bigint"), size, stride) + F.col("position")
        out = own.join(docs, "doc_id").withColumn("offset", F.col("__start") + inside).drop("n_tokens", "__start")
    else:
        docs = running_offset(own.groupBy("doc_id").agg(F.sum("__size").alias("n")), ["doc_id"], ["n"]).select("doc_id", F.col("before_n").alias("__start"))
        inside = F.coalesce(F.sum("__size").over(Window.partitionBy("doc_id").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        out = own.withColumn("__inside", inside).join(docs, "doc_id").withColumn("offset", F.col("__start") + F.col("__inside")).drop("__start", "__inside")
    take = F.col("__size") if not limit else F.least(F.col("__size"), F.lit(limit) - F.col("offset"))
    return out.withColumn("take", take).where("take > 0").drop("__size")


def sliding_windows(tokens: Column, block: int) -> Column:
    """Inputs and targets one apart, at every start but the last."""

    def cut(w: Column) -> Column:
        n = F.size(w) - block - 1
        starts = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))
        pairs = F.transform(starts, lambda i: F.struct(F.slice(w, i + 1, F.lit(block)).alias("x"), F.slice(w, i + 2, F.lit(block)).alias("y")))
        return F.when(n > 0, pairs).otherwise(F.expr("CAST(array() AS array<struct<x: array<string>, y: array<string>>>)"))

    return X.let(tokens, cut)


def perplexity(losses: DataFrame, *by: str) -> DataFrame:
    """exp of the mean loss weighted by tokens; losses that aren't finite are left out."""
    finite = losses.where(~F.isnan("loss") & (F.abs("loss") < float("inf")))
    return finite.groupBy(*by).agg(F.exp(F.sum(F.col("loss") * F.col("n_tokens")) / F.sum("n_tokens")).alias("perplexity"))


def best_option(scores: DataFrame, item: str = "item", option: str = "option", score: str = "score") -> DataFrame:
    """(item, pred): the option of the highest score, the lowest of equals."""
    return scores.groupBy(item).agg(F.max_by(option, F.struct(F.col(score), -F.col(option))).alias("pred"))


def accuracy(predicted: DataFrame, pred: Column, label: Column) -> DataFrame:
    return predicted.agg((F.coalesce(F.sum((pred == label).cast("int")), F.lit(0)) / F.greatest(F.lit(1), F.count("*"))).alias("accuracy"), F.count("*").alias("n_items"))
