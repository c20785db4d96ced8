"""The steps of preparing a corpus as one command: ``python -m grainmill prepare --docs ... --out ... [--settings ...]``.

Documents are cut into shards (with their metadata, shingles and manifest), copies are listed, and the chunks that can be
used are written. Each step reads what the one before has written, so a run that has failed may be taken up at any step.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import exact, near
from ..operators.chunks import sharded_chunks, usable_chunks
from ..sources import readers, sinks
from ..tables import written
from .config import Settings, load_settings, resolved
from .recipes import normalizer
from .timing import stage

STEPS = ("chunks", "drops", "blocks")


def write_chunks(cfg: Settings, docs: DataFrame, out: str, shard_size: int) -> None:
    w = cfg.windows
    sinks.write_shard_set(sharded_chunks(docs, shard_size, w.size, w.stride, w.least, normalize=normalizer(cfg.cleaning)), f"{out}/chunks", shard_size, cfg.near.lsh["n"], X.word_tokens)


def write_drops(spark: SparkSession, cfg: Settings, out: str) -> None:
    """The union of exact copies and, if these are enabled, of the later of near copies."""
    copies = exact.drop_list(readers.chunk_metadata(spark, f"{out}/chunks/chunk_metadata"))
    if cfg.near.enabled:
        rows = readers.shards(spark, f"{out}/chunks/shards").withColumn("ord", F.struct("shard_id", "local_index"))
        gone = near.near_losers(rows, F.col("text"), F.col("length"), cfg.near.threshold, seed=cfg.seed, rule="earlier", short="none", skip_short=cfg.near.skip_short, **cfg.near.lsh)
        copies = copies.unionByName(gone.select(F.col("ord.shard_id").cast("int").alias("shard_id"), F.col("ord.local_index").cast("int").alias("local_index")))
    sinks.write_drop_list(copies, f"{out}/drops")


def write_blocks(spark: SparkSession, out: str, block: int) -> None:
    chunks = readers.shards(spark, f"{out}/chunks/shards")
    usable_chunks(chunks, readers.drop_list(spark, f"{out}/drops"), block).write.mode("overwrite").parquet(f"{out}/blocks")


def prepare(spark: SparkSession, cfg: Settings, docs: str, out: str, fmt: str = "parquet", text_field: str = "text", shard_size: int = 10_000, block: int = 256, first: str = "chunks") -> None:
    """All steps from ``first`` on."""
    todo = STEPS[STEPS.index(first) :]
    if "chunks" in todo:
        with stage("chunks"):
            rows = readers.documents(spark, docs, fmt, text_field)
            rows = rows if "doc_id" in rows.columns else written(rows.withColumn("doc_id", F.monotonically_increasing_id()), "documents")
            write_chunks(cfg, rows, out, shard_size)
    if "drops" in todo:
        with stage("drops"):
            write_drops(spark, cfg, out)
    if "blocks" in todo:
        with stage("blocks"):
            write_blocks(spark, out, block)


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="grainmill", description="Prepare a text corpus with Spark")
    prepare_ = parser.add_subparsers(dest="command", required=True).add_parser("prepare", help="cut, list copies, and write what can be used")
    prepare_.add_argument("--docs", required=True, help="documents to read")
    prepare_.add_argument("--out", required=True, help="folder to write to")
    prepare_.add_argument("--settings", help="YAML or JSON file of settings")
    prepare_.add_argument("--format", default="parquet", choices=["parquet", "json", "text", "csv"])
    prepare_.add_argument("--text-field", default="text")
    prepare_.add_argument("--shard-size", type=int, default=10_000)
    prepare_.add_argument("--block", type=int, default=256, help="tokens of a training block")
    prepare_.add_argument("--from", dest="first", default="chunks", choices=STEPS, help="step to begin with")
    a = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("grainmill").getOrCreate()
    prepare(spark, load_settings(a.settings), resolved(a.docs), resolved(a.out), a.format, a.text_field, a.shard_size, a.block, a.first)
