"""Structured Streaming front ends: exact and near deduplication of arriving documents, and event-time windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import text as X
from ..operators import near
from ..tables import collected, delete, hadoop_path, written


def exact_stream(docs: DataFrame, event_time: str | None = None, within: str = "1 hour") -> DataFrame:
    """The first document of each normalised text. With an event time, keys are forgotten once ``within`` has passed; without
    one the state grows with the number of distinct texts."""
    keyed = docs.withColumn("key", F.sha2(X.normalize_simple(F.col("text")).cast("binary"), 256))
    if event_time:
        return keyed.withWatermark(event_time, within).dropDuplicatesWithinWatermark(["key"]).drop("key")
    return keyed.dropDuplicates(["key"]).drop("key")


def near_stream(docs: DataFrame, bands_path: str, kept_path: str, checkpoint: str, threshold: float = 0.85, rows: int = 4, num_perm: int = 128):
    """A query that keeps what isn't like anything kept before or earlier in the same micro-batch.

    The bands of kept documents are a table; each batch signs its texts once, joins its bands with the table, verifies, and appends. The
    sets of older documents are made again from what is kept, for those that share a band. A batch's rows are written under its number, so
    that a batch run again replaces them; what it needs itself is deleted after it.
    """
    text = X.normalize_simple(F.col("text"))

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        how = near.Shingles(F.col("t"), F.col("length"))
        formed = lambda df: df.select(F.col("doc_id").alias("ord"), text.alias("t")).withColumn("length", X.word_count(F.col("t")))
        with collected() as paths:
            raw = written(batch, "batch")
            own = formed(raw)
            members = written(near.signed(own, how, num_perm, 17, rows, empty=True), "members")
            gone = near.losers(members, own, how, threshold, "earlier")
            bands = near.band_rows(members.where("size > 0"), "ord")
            if _exists(spark, bands_path):
                known = spark.read.parquet(bands_path).where(F.col("batch") < number)
                hits = written(bands.join(known.select("band", "band_key", F.col("ord").alias("b")), ["band", "band_key"]).select(F.col("ord").alias("a"), "b").distinct(), "hits")
                old = formed(spark.read.parquet(kept_path).where(F.col("batch") < number))
                sets = lambda df, side: near.shingle_sets(df.join(hits.select(F.col(side).alias("ord")).distinct(), "ord", "left_semi"), how)
                like = near.compared(hits, written(sets(own, "a").unionByName(sets(old, "b")), "sets"), threshold)
                gone = gone.unionByName(like.select(F.col("a").alias("ord"))).distinct()
            gone = written(gone, "gone")
            part = f"batch={number}"
            raw.join(gone, raw["doc_id"] == gone["ord"], "left_anti").write.mode("overwrite").parquet(f"{kept_path}/{part}")
            bands.join(gone, "ord", "left_anti").write.mode("overwrite").parquet(f"{bands_path}/{part}")
        for path in paths:
            delete(spark, path)

    return docs.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _exists(spark: SparkSession, path: str) -> bool:
    fs, found = hadoop_path(spark, path)
    return fs.exists(found)


def drained(stream: DataFrame, path: str, mode: str = "update") -> DataFrame:
    """All that a stream gives for what has arrived so far: each micro-batch's rows are written under its number and read again."""
    spark = stream.sparkSession

    def one(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    stream.writeStream.foreachBatch(one).outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    if not _exists(spark, f"{path}/out"):
        return spark.createDataFrame([], stream.schema)
    rows = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{path}/out")
    last = rows.where(F.col("batch") == rows.agg(F.max("batch")).first()[0]) if mode == "complete" else rows
    return last.drop("batch")


def first_seen(docs: DataFrame, key: str, order: str, ttl_ms: int | None = 3_600_000) -> DataFrame:
    """(key, first, seen): for each key and micro-batch the least order value so far and the number of rows, in state that ends after ``ttl_ms`` idle.

    With None the state stays. A query with an idle time never runs out of batches, so it suits no trigger that ends.
    """

    def update(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        least, n = state.get if state.exists else (None, 0)
        for b in batches:
            low = int(b[order].min())
            least, n = (low if least is None else min(least, low)), n + len(b)
        state.update((least, n))
        if ttl_ms is not None:
            state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame({"key": [k[0]], "first": [least], "seen": [n]})

    return docs.groupBy(key).applyInPandasWithState(update, "key string, first bigint, seen bigint", "first bigint, seen bigint", "update", GroupStateTimeout.NoTimeout if ttl_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def event_windows(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums by event-time window (tumbling, or sliding by ``slide``) and type."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of users, closed by a gap."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
