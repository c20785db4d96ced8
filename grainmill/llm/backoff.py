"""Stupid-backoff language-model scores from n-gram counts over the whole corpus.

1. Documents are gathered into blocks of about ``BLOCK`` words: a vocabulary of word hashes and a stream of numbers in it.
2. Each block explodes into its n-grams, one order after the other, counted within the block and dealt by hash into buckets.
3. A bucket of the count table adds the counts of its n-grams over all blocks and joins them back: each block gets the
   corpus counts of its n-grams in their order. The number of buckets follows the corpus, so that a bucket stays small,
   and a common n-gram is one entry for each block, so none is hot.
4. Each block scores its words and sums by document.

The score of a word is count(n-gram) / count(context) where the n-gram occurs at least ``least`` times, else ``ALPHA`` times
the score of the next lower order; that of a single word is count / total.

Rows would be the plainer form of steps 2 and 3, but their shuffle exceeds the disk that is allowed; packed by block and
bucket an n-gram takes about 5 bytes. In a corpus of so many buckets that a block has few n-grams in each, the packed rows
come near to rows of one n-gram.

Defined results: a null or wordless text has no words, score 0 and no perplexity; a very long text is scored whole, and may
make a block of its own; repeated rows count and are scored as often as they occur; null ids are kept; equal counts of a
context and its n-gram give a score of 0; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import lean, new_path, power_of_two
from ._tokens import _R, mixed, pieces, words

ALPHA, BLOCK, BUCKET_ROWS = 0.4, 2_000_000, 1_000_000
KEY_BITS = 56  # of an n-gram's hash: among N different ones, one shares its key with another with a chance of N / 2^56


def _packed(x: np.ndarray) -> bytes:
    """Unsigned integers as compressed byte planes: all lowest bytes, then the next; high planes of zeros compress to nothing."""
    return pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes(), codec="zstd", asbytes=True) if len(x) else b""


def _unpack(raw: bytes, n: int, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    if not n:
        return np.empty(0, kind)
    plain = pa.decompress(raw, decompressed_size=n * size, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(plain, np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


def _grams(h: np.ndarray, doc: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of a block, for each order from 1: the places of the last words of its n-grams, and the n-grams' hashes."""
    gram = h
    for n in range(1, order + 1):
        if n > 1:
            gram = mixed(gram[:-1] * _R + h[n - 1 :] + np.uint64(n)) if len(gram) else gram
        whole = doc[n - 1 :] == doc[: max(0, len(doc) - n + 1)]
        yield np.flatnonzero(whole) + n - 1, mixed(gram + np.uint64(n))[whole] >> np.uint64(64 - KEY_BITS)


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray]:
    vocabulary, stream = np.frombuffer(row["vocabulary"], np.uint64), _unpack(row["stream"], row["words"], np.uint32)
    sizes = np.frombuffer(row["sizes"], np.int32)
    return vocabulary[stream], np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)


def _blocks(docs: DataFrame) -> DataFrame:
    kind = T.StructType([T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(docs.schema["id"].dataType)), T.StructField("sizes", T.BinaryType()), T.StructField("vocabulary", T.BinaryType()), T.StructField("stream", T.BinaryType()), T.StructField("words", T.LongType()), T.StructField("grams", T.LongType())])
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(kind)

    @lean
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no, part = 0, TaskContext.get().partitionId()
        ids: list = []
        hashes: list[np.ndarray] = []
        sizes: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            nonlocal no
            h = np.concatenate(hashes)
            vocabulary, stream, times = np.unique(h, return_inverse=True, return_counts=True)
            order = np.argsort(-times, kind="stable")  # frequent words get small numbers, which compress well
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            vocabulary, stream = vocabulary[order], rank[stream]
            made = [[part << 32 | no], [ids], [np.concatenate(sizes).astype(np.int32).tobytes()], [vocabulary.tobytes()], [_packed(stream)], [len(h)], [len(h) + len(vocabulary)]]
            no += 1
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(made, schema, strict=True)], schema=schema)

        held = 0
        for batch in batches:
            for first, texts in pieces(batch.column(0)):
                h, doc = words(texts)
                ids += batch.column(1).slice(first, len(texts)).to_pylist()
                hashes.append(h)
                sizes.append(np.bincount(doc, minlength=len(texts)))
                held += len(h)
                if held >= BLOCK:
                    yield out()
                    ids, hashes, sizes, held = [], [], [], 0
        if ids:
            yield out()

    path = new_path(docs.sparkSession, "blocks")
    docs.select("t", "id").mapInArrow(gather, kind).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(kind).parquet(path)


def scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 2, least: int = 2) -> DataFrame:
    """(id, n_words, log_score, mean_log_score, perplexity) for each row of ``df``."""
    docs = df.select(F.col(text_col).cast("binary").alias("t"), F.col(id_col).alias("id"))
    blocks = _blocks(docs)
    total, grams = blocks.agg(F.coalesce(F.sum("words"), F.lit(0)), F.coalesce(F.sum("grams"), F.lit(0))).first()
    buckets = power_of_two(max(64, order * grams / BUCKET_ROWS))
    shift = np.uint64(KEY_BITS - buckets.bit_length() + 1)
    schema = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("n", pa.int32()), ("m", pa.int32()), ("keys", pa.binary()), ("times", pa.binary())])

    @lean
    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                for n, (_, keys) in enumerate(_grams(*_unpacked(row), order), 1):
                    distinct, times = np.unique(keys, return_counts=True)
                    bucket = (distinct >> shift).astype(np.int64)
                    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.empty(0, np.int64)
                    cut = list(zip(first.tolist(), [*first[1:].tolist(), len(bucket)], strict=True)) if len(first) else []
                    for at in range(0, len(cut), 4096):
                        some = cut[at : at + 4096]
                        rows = [bucket[[a for a, _ in some]], [row["block"]] * len(some), [n] * len(some), [b - a for a, b in some], [_packed(np.diff(distinct[a:b], prepend=np.uint64(0))) for a, b in some], [_packed(times[a:b].astype(np.uint32)) for a, b in some]]
                        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(rows, schema, strict=True)], schema=schema)

    def add(table: pa.Table) -> pa.Table:
        sizes = table["m"].to_pylist()
        keys = np.concatenate([np.cumsum(_unpack(x.as_py(), m, np.uint64), dtype=np.uint64) for x, m in zip(table["keys"], sizes, strict=True)])
        times = np.concatenate([_unpack(x.as_py(), m, np.uint32) for x, m in zip(table["times"], sizes, strict=True)])
        distinct, number = np.unique(keys, return_inverse=True)
        count = np.bincount(number, weights=times, minlength=len(distinct)).astype(np.uint64)[number]
        back = np.split(count, np.cumsum(sizes)[:-1])
        return pa.table({"block": table["block"], "bucket": table["bucket"], "n": table["n"], "m": table["m"], "counts": pa.array([_packed(np.ascontiguousarray(c)) for c in back], pa.binary())})

    exploded = blocks.select("block", "vocabulary", "stream", "sizes", "words").mapInArrow(explode, "bucket int, block bigint, n int, m int, keys binary, times binary")
    counted = exploded.groupBy("bucket").applyInArrow(add, "block bigint, bucket int, n int, m int, counts binary")
    kind = T.StructType([T.StructField("id", docs.schema["id"].dataType), T.StructField("n_words", T.LongType()), T.StructField("log_score", T.DoubleType())])

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        h, doc = _unpacked(row)
        ids = row["ids"]
        answers = sorted(zip(right["n"].to_pylist(), right["bucket"].to_pylist(), right["m"].to_pylist(), right["counts"].to_pylist(), strict=True))
        value, own = np.zeros(len(h)), np.zeros(len(h))
        for n, (at, keys) in enumerate(_grams(h, doc, order), 1):
            told = [_unpack(c, m, np.uint64) for k, _, m, c in answers if k == n]
            if not told:
                break
            c = np.concatenate(told).astype(np.float64)[np.unique(keys, return_inverse=True)[1]]
            if n == 1:
                value[at] = np.log(c) - np.log(max(1, total))
            else:
                value[at] = np.where(c >= least, np.log(c) - np.log(np.maximum(1, own[at - 1])), np.log(ALPHA) + value[at])
            own = np.zeros(len(h))
            own[at] = c
        return pa.table({"id": pa.array(ids, left.schema.field("ids").type.value_type), "n_words": pa.array(np.bincount(doc, minlength=len(ids)), pa.int64()), "log_score": pa.array(np.bincount(doc, weights=value, minlength=len(ids)), pa.float64())})

    out = blocks.select("block", "ids", "vocabulary", "stream", "sizes", "words").groupBy("block").cogroup(counted.groupBy("block")).applyInArrow(score, kind)
    mean = F.col("log_score") / F.col("n_words")
    some = F.col("n_words") > 0
    return out.select(F.col("id").alias(id_col), "n_words", "log_score", F.when(some, mean).alias("mean_log_score"), F.when(some, F.exp(-mean)).alias("perplexity"))
