"""Scans: documents, chunks, manifests, drop lists, run summaries, metadata and grids."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import first_text
from ..operators.sampling import limited, shuffled
from ..tables import hadoop_path


def documents(spark: SparkSession, path: str | list[str], fmt: str = "parquet", text_field: str = "text", limit: int | None = None, shuffle_seed: int | None = None, stand_in: bool = True) -> DataFrame:
    """Documents with text: the named field, ``raw_content``, ``text``, then (with ``stand_in``) the first string column that isn't blank.

    Without ``stand_in`` an id or a label is never taken for text. ``limit`` counts documents that have text. Formats: parquet, json (lines), text (a line is a document), csv.
    """
    raw = spark.read.option("header", True).csv(path) if fmt == "csv" else spark.read.format(fmt).load(path)
    raw = raw.withColumnRenamed("value", "text") if fmt == "text" else raw
    strings = [f.name for f in raw.schema.fields if isinstance(f.dataType, T.StringType)]
    named = [c for c in (text_field, "raw_content", "text") if c in raw.columns]
    order = list(dict.fromkeys([*named, *(strings if stand_in else [])]))
    if not order:
        raise ValueError("no column holds text")
    docs = raw.withColumn("text", first_text(F.col(order[0]), *[F.col(c) for c in order[1:]]))
    docs = limited(docs, F.col("text"), None)
    if shuffle_seed is not None:
        docs = shuffled(docs, "doc_id" if "doc_id" in docs.columns else "text", shuffle_seed)
    return docs.limit(limit) if limit else docs


def streamed_documents(spark: SparkSession, path: str, text_field: str = "text", limit: int | None = None) -> DataFrame:
    """The chunk builder's scan: ``limit`` counts all rows, and only ``raw_content`` stands in for missing text."""
    raw = spark.read.parquet(path)
    fallback = [F.col("raw_content")] if "raw_content" in raw.columns else []
    return limited(raw.withColumn("text", F.coalesce(F.when(F.col(text_field) != "", F.col(text_field)), *fallback)), F.col("text"), limit, nonempty_first=False)


def prefetched(docs: DataFrame, path: str) -> DataFrame:
    """Materialise once; later scans read Parquet."""
    docs.write.mode("overwrite").parquet(path)
    return docs.sparkSession.read.parquet(path)


def jsonl_documents(spark: SparkSession, path: str) -> DataFrame:
    """(id, text); a row without either raises when it is read."""
    rows = spark.read.schema("id string, text string").json(path)
    need = lambda c: F.coalesce(F.col(c), F.raise_error(F.lit(f"a document lacks {c}")).cast("string")).alias(c)
    return rows.select(need("id"), need("text"))


def jsonl_texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("text string").json(path)


def shards(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of ``sinks.write_shards``. Their folders are listed in few tasks; by default each folder, up to 10,000, is a task of its own."""
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(key)
    spark.conf.set(key, 4 * spark.sparkContext.defaultParallelism)
    try:
        return spark.read.parquet(path)
    finally:
        spark.conf.set(key, before)


def chunk_metadata(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("shard_id int, local_index int, exact_hash bigint").json(path)


def shingle_sets(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema("shard_id int, local_index int, shingles array<bigint>").json(path)
    return rows.withColumn("shingles", F.coalesce("shingles", F.expr("CAST(array() AS array<bigint>)")))


def shard_set_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row: shards, chunk_metadata_path, shingle_path, total_tokens."""
    return spark.read.schema("shards array<struct<shard_id: bigint, path: string, chunk_count: bigint, token_count: bigint>>, chunk_metadata_path string, shingle_path string, total_tokens bigint").json(f"{path}/manifest")


def drop_list(spark: SparkSession, path: str) -> DataFrame:
    """(shard_id, local_index); a missing file is an empty list."""
    schema = "shard_id int, local_index int"
    fs, found = hadoop_path(spark, path)
    if not fs.exists(found):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id string, hash string, kept boolean, reason string, meta map<string,string>").json(path)


def kept_hashes(spark: SparkSession, path: str) -> DataFrame:
    return manifest(spark, path).where("kept").select("hash").distinct()


def run_summary(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """All columns as strings; cast where they are used."""
    return spark.read.csv(path, sep="\t", header=True, quote="")


def run_summaries(spark: SparkSession, directories: list[str], name: str = "summary.tsv") -> DataFrame:
    """The summaries of several run directories, and the last part of each one's path (column ``directory``); a directory without one is passed over."""
    found = [path for path in (f"{d.rstrip('/')}/{name}" for d in directories) if (lambda fs_path: fs_path[0].exists(fs_path[1]))(hadoop_path(spark, path))]
    if not found:
        return spark.createDataFrame([], "run string, val_perplexity string, directory string")
    return run_summary(spark, found).withColumn("directory", F.regexp_extract(F.input_file_name(), rf"([^/]+)/{re.escape(name)}[^/]*(?:/[^/]*)?$", 1))


def metadata(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """Parquet by its suffix, else CSV with inferred types."""
    rows = spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else spark.read.csv(path, header=True, inferSchema=True)
    if missing := [c for c in required if c not in rows.columns]:
        raise ValueError(f"metadata lacks {', '.join(missing)}")
    return rows


def grid(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("name string, dedup string, tokens string, model string, seed int").csv(path, header=True)


def synthetic_chunks(spark: SparkSession, n: int = 5000, seed: int = 13, per_shard: int = 500, shingles: int = 80, reuse: float = 0.15) -> DataFrame:
    """(shard_id, local_index, exact_hash, shingles): chunks for profiling, a function of the seed alone.

    A share of hashes is reused; sets come from n / 100 base sets, some with up to 10 added, some with up to 10 left out.
    """
    u = lambda *key: F.pmod(F.xxhash64(F.lit(seed), *[F.lit(k) if isinstance(k, str) else k for k in key]), F.lit(1 << 30)) / float(1 << 30)
    i = F.col("id")
    base = F.floor(u("base", i) * max(1, n // 100)).cast("bigint")
    word = lambda *key: F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1 << 32))
    own = F.transform(F.sequence(F.lit(1), F.lit(shingles)), lambda k: word(F.lit("shingle"), base, k))
    noise = F.transform(F.sequence(F.lit(1), F.lit(10)), lambda k: word(F.lit("noise"), i, k))
    less = F.when(u("less", i) < 0.35, 1 + F.floor(u("few", i) * 10)).otherwise(0).cast("int")
    sets = F.concat(F.slice(own, F.lit(1), F.lit(shingles) - less), F.when(u("more", i) < 0.4, noise).otherwise(F.expr("CAST(array() AS array<bigint>)")))
    source = F.when((u("reuse", i) < reuse) & (i > 0), F.floor(u("which", i) * i).cast("bigint")).otherwise(i)
    return spark.range(n).select(F.floor(i / per_shard).cast("int").alias("shard_id"), (i % per_shard).cast("int").alias("local_index"), F.xxhash64(F.lit(seed), F.lit("hash"), source).alias("exact_hash"), F.array_distinct(sets).alias("shingles"))
