"""Exact deduplication by content sort.

Rows are range-partitioned by sampled splitters of (head, hash, id), where head is the first bytes of the normalised
text, sorted on disk within each partition by (head, hash, whole text, id), and neighbours are compared byte by byte.
The splitters hold a short head instead of the text, so that they stay small on the driver; the id in them spreads a
large group of equal texts over several partitions. Groups that cross a partition border are joined by their whole
texts: at most the first and last few runs of each partition take part.

Rows that are carried cross the shuffle once, with their text in them; a partition is read in pieces of ``PIECE`` bytes.

Defined results: a null text counts as empty, and a very long one is compared whole like others. A row with a null id never
stays while its group has another row. Of repeated rows with equal id and text exactly one stays, any of them where other
columns differ; all of these are in one partition. An empty table gives an empty result. Extra columns are carried by
``drop_exact_duplicates`` whatever their names, and ignored by ``exact_duplicates``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import lean, shuffle_partitions, written
from ._tokens import pieces

HEAD_BYTES, PIECE, ROWS = 32, 1 << 21, 20_000


class _Run:
    """Equal neighbours: their ids (or their count), and where the last one is."""

    __slots__ = ("ids", "last", "n", "no", "text")

    def __init__(self, text: bytes, no: int):
        self.text, self.no, self.n, self.ids, self.last = text, no, 0, [], None


def _sorted(df: DataFrame, id_col: str, text_col: str, keep: str, normalise, carry: bool) -> DataFrame:
    """(head, hash, id, t) in the order of content; with ``carry`` also the row, in which t is left to be looked up unless it is normalised."""
    if keep not in ("largest", "smallest"):
        raise ValueError("keep is largest or smallest")

    def content(text: Column) -> Column:
        text = F.coalesce(text, F.lit(""))
        return (normalise(text) if normalise else text).cast("binary")

    last = F.asc_nulls_first("id") if keep == "largest" else F.desc_nulls_first("id")
    t = content(F.col(text_col))
    row = [F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")] if carry else [t.alias("t")]
    x = df.select(F.substring(t, 1, HEAD_BYTES).alias("head"), F.xxhash64(t).alias("hash"), F.col(id_col).alias("id"), *row)
    x = x.repartitionByRange(shuffle_partitions(df.sparkSession), "head", "hash", last)
    x = x.withColumn("t", content(F.col("row").getField(text_col))) if carry else x
    x = x.sortWithinPartitions("head", "hash", "t", last)
    return x.drop("t") if carry and not normalise else x


def _in_pieces(batches: Iterator[pa.RecordBatch], text: Callable[[pa.RecordBatch], pa.Array]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of batches of up to ``PIECE`` bytes of text, and their texts."""
    for batch in batches:
        for first, texts in pieces(text(batch), PIECE):
            yield batch.slice(first, len(texts)), [x or b"" for x in texts]


def _groups(batches: Iterator[pa.RecordBatch], ids: bool, text: Callable[[pa.RecordBatch], pa.Array]) -> Iterator[tuple[list[_Run] | None, bool, pa.RecordBatch | None]]:
    """The runs that share a head and hash, whether these are the partition's first or last; and each piece when it has been read."""
    key, runs, first, no = None, [], True, 0
    for batch, texts in _in_pieces(batches, text):
        heads, hashes = batch.column("head").to_pylist(), batch.column("hash").to_pylist()
        owners = batch.column("id").to_pylist() if ids else None
        for i, at in enumerate(zip(heads, hashes, strict=True)):
            if at != key:
                if runs:
                    yield runs, first, None
                    first = False
                key, runs = at, []
            if not runs or texts[i] != runs[-1].text:
                runs.append(_Run(texts[i], no))
                no += 1
            run = runs[-1]
            run.n += 1
            run.last = (batch, i)
            if ids:
                run.ids.append(owners[i])
        yield None, False, batch
    if runs:
        yield runs, True, None


def _mark(schema: pa.Schema) -> Callable:
    @lean
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each input row: its run's kept id and size, and the text once for each run at a border."""
        part = TaskContext.get().partitionId()
        rows: list[list] = [[] for _ in schema]

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(rows, schema, strict=True)], schema=schema)
            for x in rows:
                x.clear()
            return made

        for runs, border, _ in _groups(batches, ids=True, text=lambda b: b.column("t")):
            for run in runs or ():
                sha = hashlib.sha256(run.text).hexdigest()
                for at in range(0, run.n, ROWS):  # a run may be most of a partition
                    own = run.ids[at : at + ROWS]
                    n, ends = len(own), at + ROWS >= run.n
                    for x, more in zip(rows, (own, [sha] * n, [run.ids[-1]] * n, [run.n] * n, [False] * (n - 1) + [ends], [part] * n, [run.no] * n, [border] * n, [None] * (n - 1) + [run.text if border and ends else None]), strict=True):
                        x.extend(more)
                    if len(rows[0]) >= ROWS:
                        yield out()
        yield out()

    return mark


def _last_rows(schema: pa.Schema, text: Callable[[pa.RecordBatch], pa.Array]) -> Callable:
    @lean
    def last_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The last row of each run, whole, with what is needed to join runs at borders."""
        part = TaskContext.get().partitionId()
        ready: dict[int, tuple[pa.RecordBatch, list]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for batch, found in ready.values():
                picked = batch.take(pa.array([i for i, *_ in found]))
                col = {name: picked.column(k) for k, name in enumerate(picked.schema.names)}
                made = [col["row"], col["id"], pa.array([part] * len(found), pa.int32()), *[pa.array(list(x), f.type) for x, f in zip(list(zip(*found, strict=True))[1:], list(schema)[3:], strict=True)]]
                yield pa.RecordBatch.from_arrays([x.cast(f.type) if x.type != f.type else x for x, f in zip(made, schema, strict=True)], schema=schema)
            ready.clear()

        for runs, border, done in _groups(batches, ids=False, text=text):
            for run in runs or ():
                batch, i = run.last
                ready.setdefault(id(batch), (batch, []))[1].append((i, run.no, border, run.text if border else None))
            if done is not None:
                yield from out()
        yield from out()

    return last_rows


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _joined_borders(runs: DataFrame, keep: str, sized: bool) -> DataFrame:
    """A row for each run at a border: what holds for all runs of its text. At most a few rows for each partition."""
    best = F.max if keep == "largest" else F.min
    edge = runs.where("border AND text IS NOT NULL")
    all_runs = edge.groupBy("text").agg(best("id").alias("all_id"), F.max(F.struct("part", "run")).alias("final"), *([F.sum("size").alias("all_size")] if sized else []))
    return edge.select("text", "part", "run").join(all_runs, "text").drop("text")


def exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", normalise: Callable[[Column], Column] | None = None) -> DataFrame:
    """A row for each row of ``df``: id, keep_id, group_size, kept, text_sha256."""
    kind = df.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("sha", T.StringType()), T.StructField("keep_id", kind), T.StructField("size", T.LongType()), T.StructField("is_last", T.BooleanType()), T.StructField("part", T.IntegerType()), T.StructField("run", T.LongType()), T.StructField("border", T.BooleanType()), T.StructField("text", T.BinaryType())])
    runs = written(_sorted(df, id_col, text_col, keep, normalise, carry=False).mapInArrow(_mark(_arrow(schema)), schema), "runs")
    # two runs or so for each partition, without texts: a bound that follows from the number of partitions
    whole = F.broadcast(_joined_borders(runs.withColumn("id", F.col("keep_id")), keep, sized=True))
    crossed = F.col("final").isNotNull()
    return runs.drop("text").join(whole, ["part", "run"], "left").select(
        F.col("id").alias(id_col),
        F.when(crossed, F.col("all_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("all_size", "size").alias("group_size"),
        (F.col("is_last") & (~crossed | (F.col("final") == F.struct("part", "run")))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", normalise: Callable[[Column], Column] | None = None) -> DataFrame:
    """The rows of ``df`` that stay, with all their columns."""
    x = _sorted(df, id_col, text_col, keep, normalise, carry=True)
    schema = T.StructType([x.schema["row"], T.StructField("id", x.schema["id"].dataType), T.StructField("part", T.IntegerType()), T.StructField("run", T.LongType()), T.StructField("border", T.BooleanType()), T.StructField("text", T.BinaryType())])
    place = [c.lower() for c in df.columns].index(text_col.lower())
    text = (lambda b: b.column("t")) if normalise else (lambda b: b.column("row").field(place).cast(pa.binary()))
    runs = written(x.mapInArrow(_last_rows(_arrow(schema), text), schema), "rows")
    whole = F.broadcast(_joined_borders(runs, keep, sized=False))
    stay = runs.join(whole, ["part", "run"], "left").where("final IS NULL OR (final.part = part AND final.run = run)")
    return stay.select("row.*")
