"""Recipes end to end: chunks, splits, deduplication by recipe, cross-split cleaning, canaries, and one summary row for each."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import near
from ..operators.chunks import build_chunks
from ..tables import written
from .config import Cleaning, NearRules, Recipe, Settings


def normalizer(cleaning: Cleaning):
    """The normal form that the settings ask for, as a function of a column."""

    def normalize(text: Column) -> Column:
        return X.normalize_full(text, cleaning.lowercase, cleaning.strip_html, cleaning.collapse_whitespace)

    return normalize


def deduplicated(rows: DataFrame, recipe: Recipe, rules: NearRules, like: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(kept, after the exact step) of each split. ``rows`` are signed (ord, split, length, digest, size, key), and ``like`` (a, b, jaccard) has the similar keys, either way round."""
    out = rows
    if recipe.exact:
        out = rows.groupBy("split", "digest").agg(F.min_by(F.struct("ord", "length", "size", "key"), "ord").alias("s")).select("s.ord", "split", "s.length", "digest", "s.size", "s.key")
        out = written(out, "exact")
    if recipe.threshold is None:
        return out, out
    rank = F.struct((-F.col("length")).alias("less"), "ord")
    best = written(out.where((F.col("size") > 0) & (F.col("length") >= rules.skip_short)).groupBy("split", "key").agg(F.min(rank).alias("best")), "best")
    pairs = like.where(F.col("jaccard") >= recipe.threshold)
    other = best.select("split", F.col("key").alias("b"), F.col("best").alias("rival"))
    beaten = best.withColumnRenamed("key", "a").join(pairs.select("a", "b"), "a").join(other, ["split", "b"]).where("rival < best").select("split", F.col("a").alias("key")).distinct()
    best = best.join(beaten.withColumn("beaten", F.lit(True)), ["split", "key"], "left")
    banded = (F.col("size") > 0) & (F.col("length") >= rules.skip_short)
    kept = out.join(best, ["split", "key"], "left").where(~banded | ((rank == F.col("best")) & F.col("beaten").isNull()))
    return written(kept.select("ord", "split", "length", "digest", "size", "key"), "kept"), out


def prepared(rows: DataFrame, recipe: Recipe, cfg: Settings, like: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(kept, after the exact step); training chunks that collide with validation or test chunks go.

    The cross-split step looks for near copies whenever these are enabled, at the general threshold.
    """
    kept, exact = deduplicated(rows, recipe, cfg.near, like)
    if not cfg.cross_split:
        return kept, exact
    train, others = kept.where("split = 'train'"), kept.where("split <> 'train'")
    clean = train.join(others.select("digest").distinct(), "digest", "left_anti")
    if cfg.near.enabled:
        keys = others.where("size > 0").select("key").distinct()
        near_keys = like.where(F.col("jaccard") >= cfg.near.threshold).join(keys.withColumnRenamed("key", "b"), "b").select(F.col("a").alias("key"))
        hit = keys.unionByName(near_keys).distinct().withColumn("hit", F.lit(True))
        clean = clean.join(hit, "key", "left").where(F.col("hit").isNull() | (F.col("size") == 0) | (F.col("length") < cfg.near.skip_short)).drop("hit")
    return clean.unionByName(others), exact


def signed_rows(chunks: DataFrame, cfg: Settings) -> tuple[DataFrame, DataFrame | None]:
    """(rows, like) for all recipes: each chunk is signed once, and similar sets are verified once, at the least threshold that is asked for."""
    asked = [r.threshold for r in cfg.recipes if r.threshold is not None] + ([cfg.near.threshold] if cfg.cross_split and cfg.near.enabled else [])
    own = ("ord", "split", "length", "digest", "size", "key")
    if not asked:
        return chunks.select("ord", "split", "length", F.sha1(F.col("text").cast("binary")).alias("digest"), F.lit(0).alias("size"), F.lit(0).cast("bigint").alias("key")), None
    lsh, how = cfg.near.lsh, near.Shingles(F.col("text"), F.col("length"), cfg.near.lsh["n"])
    rows = written(near.signed(chunks, how, lsh["num_perm"], cfg.seed, lsh["rows"], empty=True, carry=("split",)), "signed")
    classes = rows.where("size > 0").groupBy(F.col("key").alias("id")).agg(F.min("ord").alias("ord"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    classes = written(classes.withColumn("rank", F.col("id")), "classes")
    pairs = near.similar(near.meeting(classes), near.sets_from(chunks, how, classes), min(asked))
    like = written(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "jaccard")), "like")
    return rows.select(*own), like


def summary(docs: DataFrame, cfg: Settings) -> DataFrame:
    """A row for each recipe: chunks and tokens that train, and the chunks of the other splits. ``docs`` has doc_id, text and split."""
    w = cfg.windows
    some = docs.where(X.has_text(F.col("text")))
    chunks = build_chunks(some, w.size, w.stride, w.least, normalize=normalizer(cfg.cleaning), carry=("split",))
    chunks = written(chunks.select(F.struct("doc_id", "position").alias("ord"), "split", "length", "text"), "chunks")
    signed, like = signed_rows(chunks, cfg)
    found = []
    for r in cfg.recipes:
        kept, exact = prepared(signed, r, cfg, like)
        of = lambda s: F.count(F.when(F.col("split") == s, 1))
        counts = kept.agg(of("train").alias("train_chunks"), F.coalesce(F.sum(F.when(F.col("split") == "train", F.col("length"))), F.lit(0)).cast("bigint").alias("train_tokens"), of("val").alias("val_chunks"), of("test").alias("test_chunks"))
        found.append(counts.crossJoin(exact.agg(of("train").alias("exact_chunks"))).select(F.lit(r.name).alias("run"), "*"))  # one row each
    return reduce(DataFrame.unionByName, found)
