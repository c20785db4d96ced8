"""Substring deduplication by sliding sentence spans.

A text is cut into sentences at full stops, question and exclamation marks and line breaks. Only sentences of more than
``LONGEST`` words are cut further, before each word whose hash is the least of some ``WINDOW`` words in a row of the sentence
(winnowing): such a cut depends on no word that is further away, so a passage that is shared inside running text without
marks still holds whole units. From each sentence on, the shortest span of at least ``SENTENCES`` sentences and ``WORDS`` words is
hashed. Spans are counted over the corpus; the occurrences of repeated spans are ranked by (id, position), and the sentences
that any occurrence but the first covers are removed.

Counts are pre-aggregated before they are shuffled, joins on a span's hash can be split when it is very common, and what is
gathered for one document is bounded by that document.

Defined results: a null text is returned as null, a text without words as it is; a very long text is one text like others.
Of rows of equal id and text (null ids included) one counts as the first, and the others lose every sentence that a span
covers; null ids come first in the order; shorter repeats than a span stay; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import lean, written
from ._tokens import _R, _power, mixed, pieces, word_places

SENTENCES, WORDS, LONGEST, WINDOW = 3, 20, 12, 8
_END = np.zeros(256, np.int64)
_END[list(b".!?\n\r")] = 1


def _over(x: np.ndarray, of, size: int) -> np.ndarray:
    """``of`` (minimum or maximum) over each ``size`` values in a row."""
    have = 1
    while have < size:
        step = min(have, size - have)
        x = of(x[:-step], x[step:])
        have += step
    return x


def least_of_windows(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether each word's hash is the least of a window of ``WINDOW`` words of equal ``doc``."""
    n, w = len(h), WINDOW
    if n < w:
        return np.zeros(n, bool)
    key = mixed(h + np.uint64(13)) | np.uint64(1)
    least = np.where(doc[: n - w + 1] == doc[w - 1 :], _over(key, np.minimum, w), np.uint64(0))  # 0: a window over an end
    edge = np.zeros(w - 1, np.uint64)
    return _over(np.r_[edge, least, edge], np.maximum, w) == key  # no window of a word has a larger minimum than the word itself


class Cut:
    """The sentences of some texts: for each its first word, that word's first byte, and its text's number."""

    def __init__(self, texts: list[bytes | None]):
        data, self.h, doc, start, stop, self.offsets = word_places(texts)
        n = len(self.h)
        ends = np.cumsum(_END[data])
        new = np.ones(n, bool)
        if n > 1:
            marked = ends[start[1:] - 1] > ends[stop[:-1] - 1]
            new[1:] = (doc[1:] != doc[:-1]) | marked
            first = np.flatnonzero(new)
            size = np.diff(np.r_[first, n])
            if (size > LONGEST).any():
                new |= np.repeat(size > LONGEST, size) & least_of_windows(self.h, np.repeat(np.arange(len(first)), size))
        self.first = np.flatnonzero(new)
        self.doc = doc[self.first]
        self.byte = start[self.first] - self.offsets[self.doc]  # within its text
        self.words = n

    def spans(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, first sentence, sentence after the last) of each span; sentences are numbered through all texts."""
        k = len(self.first)
        if not k:
            return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        edge = np.r_[self.first, self.words]
        last = np.searchsorted(self.doc, self.doc, side="right")  # the sentence after the text's last
        begin = np.arange(k)
        end = np.maximum(begin + SENTENCES, np.searchsorted(edge, edge[:-1] + WORDS))
        fits = end <= last
        begin, end = begin[fits], end[fits]
        up, down = _power(self.words + 1)
        sums = np.r_[np.uint64(0), np.cumsum(mixed(self.h + _R) * up[: self.words])]
        a, b = edge[begin], edge[end]
        return mixed((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64)), begin, end


def _span_rows(docs: DataFrame, places: bool) -> DataFrame:
    """A row for each span: its hash, and with ``places`` its document, first sentence and the one after its last (numbered in the text)."""
    kind = T.StructType([T.StructField("h", T.LongType()), *([T.StructField("id", docs.schema["id"].dataType), T.StructField("mark", T.LongType()), T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType())] if places else [])])

    @lean
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, texts in pieces(batch.column(0)):
                cut = Cut(texts)
                h, begin, end = cut.spans()
                cols = [pa.array(h.view(np.int64))]
                if places:
                    at = cut.doc[begin]
                    head = np.searchsorted(cut.doc, np.arange(len(texts)))[at]
                    own = pa.array(lo + at)
                    cols += [batch.column(1).take(own), batch.column(2).take(own), pa.array((begin - head).astype(np.int32)), pa.array((end - head).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(cols, names=kind.names)

    return docs.mapInArrow(rows, kind)


def repeated_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, mark, spans): for each document the repeated spans of which it isn't the first holder."""
    docs = df.select(F.col(text_col).cast("binary").alias("t"), F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("mark"))
    common = written(_span_rows(docs, places=False).groupBy("h").count().where("count > 1").select("h"), "common")
    held = written(_span_rows(docs, places=True).join(common, "h", "left_semi"), "held")
    # written, so that both sides of the join are plain shuffles, whose skewed parts (a very common span) Spark may split
    first = written(held.groupBy("h").agg(F.min(F.struct("id", "mark", "a")).alias("first")), "first")
    later = held.join(first, "h").where(~F.struct("id", "mark", "a").eqNullSafe(F.col("first")))
    return later.groupBy("id", "mark").agg(F.collect_set(F.struct("a", "b")).alias("spans"))


def _dead(n: int, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which of ``n`` sentences the spans cover."""
    change = np.zeros(n + 1, np.int64)
    for a, b in spans:
        change[a] += 1
        change[b] -= 1
    return np.cumsum(change)[:n] > 0


def _left(raw: bytes, byte: np.ndarray, dead: np.ndarray) -> tuple[bytes, str]:
    """The text without its dead sentences, and the code points (start:end) of what has gone."""
    dead, edge = np.r_[False, dead, False], np.r_[byte, len(raw)]
    a, b = edge[np.flatnonzero(dead[1:] & ~dead[:-1])], edge[np.flatnonzero(~dead[1:] & dead[:-1])]
    points = np.r_[0, np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)]
    kept = [raw[x:y] for x, y in zip(np.r_[0, b].tolist(), np.r_[a, len(raw)].tolist(), strict=True)]
    return b"".join(kept), ",".join(f"{points[x]}:{points[y]}" for x, y in zip(a.tolist(), b.tolist(), strict=True))


@lean
def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (t, id, spans, again) without the sentences of the given spans, or of all their spans if the row is there ``again``."""
    for batch in batches:
        for lo, texts in pieces(batch.column(0)):
            cut, size = Cut(texts), len(texts)
            head = np.searchsorted(cut.doc, np.arange(size + 1))
            gone = {i: [(x["a"], x["b"]) for x in v] for i, v in enumerate(batch.column(2).slice(lo, size).to_pylist()) if v}
            again = [i for i, v in enumerate(batch.column(3).slice(lo, size).to_pylist()) if v]
            if again:
                _, begin, end = cut.spans()
                of = cut.doc[begin]
                gone |= {i: list(zip((begin[of == i] - head[i]).tolist(), (end[of == i] - head[i]).tolist(), strict=True)) for i in again}
            out, removed, where = list(texts), np.zeros(size, np.int64), [""] * size
            for i, spans in gone.items():
                dead = _dead(int(head[i + 1] - head[i]), spans)
                if dead.any():
                    out[i], where[i] = _left(texts[i], cut.byte[head[i] : head[i + 1]], dead)
                    removed[i] = dead.sum()
            cols = [batch.column(1).slice(lo, size), pa.array(out, pa.binary()).view(pa.string()), pa.array(np.diff(head).astype(np.int64)), pa.array(removed), pa.array(where, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "text", "n_sentences", "n_removed", "removed"])


def remove_repeated_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, n_sentences, n_removed, removed) for each row of ``df``."""
    gone = written(repeated_spans(df, id_col, text_col).withColumnsRenamed({"id": "g_id", "mark": "g_mark"}), "repeats")
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("mark"))
    twice = written(docs.groupBy("id", "mark").count().where("count > 1").select(F.col("id").alias("t_id"), F.col("mark").alias("t_mark")), "twice")
    both = docs.join(gone, F.col("id").eqNullSafe(F.col("g_id")) & (F.col("mark") == F.col("g_mark")), "left")
    rows = both.select("t", "id", "spans", F.lit(False).alias("again"))
    if not twice.isEmpty():
        same = F.col("id").eqNullSafe(F.col("t_id")) & (F.col("mark") == F.col("t_mark"))
        number = F.row_number().over(Window.partitionBy("id", "mark").orderBy("mark"))  # rows are passed on one by one, however many are equal
        rows = both.join(twice, same, "left_anti").select("t", "id", "spans", F.lit(False).alias("again"))
        rows = rows.unionByName(both.join(twice, same, "left_semi").withColumn("again", number > 1).select("t", "id", "spans", "again"))
    kind = T.StructType([T.StructField("id", docs.schema["id"].dataType), T.StructField("text", T.StringType()), T.StructField("n_sentences", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("removed", T.StringType())])
    return rows.mapInArrow(_without, kind).withColumnRenamed("id", id_col)
