"""Benchmark decontamination by latent semantic retrieval.

1. Document frequencies of hashed words over all documents.
2. A randomised SVD of the TF-IDF matrix of the passages (blocks of ``BLOCK`` words) of all documents, in one task for each
   ``SKETCH_WORDS`` words (``SKETCHES`` at least), so that their sums, of up to 8 MB each, don't grow with the number of
   input splits. Each task multiplies its rows A by a random test matrix O and back, the sums A'AO are added up by bucket
   in Spark, and the driver takes the leading right singular vectors from this sketch (its size is fixed by ``BITS`` and
   ``RANK``). O is sparse, ``ENTRIES`` numbers for each bucket, so that a word costs a few additions for each word of its
   block. Coordinates are scaled by the inverse singular values, so that topic or language alone doesn't make passages
   similar. ``SPACE_DOCS`` may be set to a number of documents, drawn by hash, that shape the space instead; passages whose
   words all lie outside these have no coordinates then, and aren't found even word for word. No query does so.
3. Cosine search: every passage (two blocks, moved by one) of every document against every window of every benchmark
   item, in blocks of matrix products. Pairs of ``COSINE`` or more are candidates (``COSINE_SHORT`` for items that are
   shorter than a window, of which a passage holds more than the item).
4. Candidates that share half of the window's words are compared in full: the longest common subsequence of the item and
   the words around the passage, and whether the item's answer (its last ``ANSWER`` words) stands there. A document is
   contaminated when the subsequence covers ``VERBATIM`` of the item, or ``PARAPHRASE`` of it with the answer. Where too few
   of the item's words occur around the passage for that, the subsequence isn't looked for.
5. Items of fewer than ``LEAST`` words, too short for a passage, are searched by the hash of all their words in a row.

The benchmark is the query set: it is taken in blocks of up to ``ITEMS`` items, ``ITEM_BYTES`` of text and ``WINDOWS`` windows,
one pass over the documents each, so what is broadcast is some 40 MB at most, and more only for a single item beyond these.
Nothing is capped, and whole texts are read.

Defined results: null or wordless texts and items match nothing; null ids and repeated rows match like others, and items of
equal words each by itself; very long texts are searched like others, in one piece; extra columns of either table are
ignored, or carried by ``drop_contaminated`` whatever their names; with an empty documents or benchmark table nothing matches.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import lean, written
from ._tokens import _R, mixed, pieces, words

BITS, RANK, BLOCK, STEP, COSINE, COSINE_SHORT = 15, 64, 12, 6, 0.4, 0.4
VERBATIM, PARAPHRASE, ANSWER, LEAST = 0.8, 0.6, 5, 8
ITEMS, ITEM_BYTES, WINDOWS = 5000, 4 << 20, 40_000
SKETCHES, SKETCH_WORDS, ENTRIES = 12, 5_000_000, 2  # a word counts once in each document that holds it
SPACE_DOCS: int | None = None  # all
FOLD = 3  # windows hold sets of buckets in 2^(BITS - FOLD) bits
_SHIFT = np.uint64(64 - BITS)


def _buckets(h: np.ndarray) -> np.ndarray:
    return (h >> _SHIFT).astype(np.int64)


def _starts(group: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.empty(0, np.int64)


def _sums(matrix: np.ndarray, ids: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The sum of the matrix rows ``ids`` for each run of equal ``group``."""
    at = _starts(group)
    return np.add.reduceat(matrix[ids], at, axis=0) if len(at) else np.zeros((0, matrix.shape[1]), np.float32)


def _block_sums(matrix: np.ndarray, ids: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The sum of the matrix rows ``ids`` for each block of up to ``BLOCK`` words: one word of every block at a time."""
    out = np.zeros((len(start), matrix.shape[1]), np.float32)
    size = end - start
    for k in range(BLOCK):
        own = np.flatnonzero(size > k)
        if len(own) == len(out):
            out += matrix.take(ids[start + k], axis=0)
        else:
            out[own] += matrix.take(ids[start[own] + k], axis=0)
    return out


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """The number of texts that hold a word of each bucket, and the number of texts."""
    schema = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])

    @lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((1 << BITS) + 1, np.int64)
        for batch in batches:
            for _, texts in pieces(batch.column(0)):
                h, doc = words(texts)
                held = ((doc << BITS) | _buckets(h)).astype(np.uint32 if len(texts) <= 1 << (32 - BITS) else np.int64)
                held.sort()  # short numbers sort many times faster
                n[: 1 << BITS] += np.bincount(held[_starts(held)].astype(np.int64) & ((1 << BITS) - 1), minlength=1 << BITS)
                n[-1] += len(texts)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], schema=schema)

    rows = docs.select("t").mapInArrow(count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros((1 << BITS) + 1, np.int64)
    n[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return n[:-1], int(n[-1])


def _test_entries(rank: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The columns and the numbers of the entries of the sparse test matrix, by entry and bucket; signs alone could cancel out."""
    rng, shape = np.random.default_rng(seed), (ENTRIES, 1 << BITS)
    return rng.integers(0, rank, shape), rng.uniform(0.5, 1.5, shape) * rng.choice([-1.0, 1.0], shape)


def _test_matrix(rank: int, seed: int) -> np.ndarray:
    out = np.zeros((1 << BITS, rank))
    for column, number in zip(*_test_entries(rank, seed), strict=True):
        out[np.arange(1 << BITS), column] += number
    return out


def latent_space(docs: DataFrame, idf: np.ndarray, rank: int = RANK, seed: int = 5) -> np.ndarray:
    """For each bucket its TF-IDF weight times its row of the scaled right singular vectors."""
    kind = T.StructType([T.StructField("bucket", T.IntegerType()), *[T.StructField(f"z{i}", T.FloatType()) for i in range(rank)]])
    schema = pa.schema([("bucket", pa.int32()), *[(f"z{i}", pa.float32()) for i in range(rank)]])
    weight = idf.astype(np.float32)[:, None]

    @lean
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns, numbers = _test_entries(rank, seed)
        numbers *= idf
        z = np.zeros((1 << BITS) * rank)
        for batch in batches:
            for _, texts in pieces(batch.column(0)):
                h, doc = words(texts)
                if not len(h):
                    continue
                ids, start, end, _ = _blocks(h, doc)
                size = end - start
                for m in np.unique(size).tolist():  # blocks of m words: a row of z for each word, and there the entries of all of them
                    block = ids[start[size == m][:, None] + np.arange(m)]
                    square = np.maximum((idf[block] ** 2).sum(axis=1, keepdims=True), 1e-9)
                    for column, number in zip(columns, numbers, strict=True):
                        at = (block * rank)[:, :, None] + column[block][:, None, :]
                        np.add.at(z, at.ravel(), np.broadcast_to((number[block] / square)[:, None, :], at.shape).ravel())
        z = z.reshape(1 << BITS, rank).astype(np.float32)
        at = np.flatnonzero(z.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *[pa.array(z[at, i]) for i in range(rank)]], schema=schema)

    total = docs.select("t").mapInArrow(sketch, kind).groupBy("bucket").agg(*[F.sum(f"z{i}").cast("float").alias(f"z{i}") for i in range(rank)]).toArrow()
    z = np.zeros((1 << BITS, rank), np.float32)
    if total.num_rows:
        bucket = total["bucket"].to_numpy()
        for i in range(rank):
            z[bucket, i] = total[f"z{i}"].to_numpy()
    del total
    z *= weight  # A'AO
    test = _test_matrix(rank, seed)
    core, gram = np.zeros((rank, rank)), np.zeros((rank, rank))
    for s in range(0, 1 << BITS, 4096):  # in double precision, a part at a time
        part = z[s : s + 4096].astype(np.float64)
        core += test[s : s + 4096].T @ part
        gram += part.T @ part
    core = (core + core.T) / 2
    own, factor = np.linalg.eigh(core)  # none below zero but by rounding, as with few different words
    factor /= np.sqrt(np.maximum(own, 0) + 1e-6 * max(np.trace(core), 1e-6) / rank)
    squares, turn = np.linalg.eigh(factor.T @ gram @ factor)  # the singular values of z @ factor, squared
    values = np.sqrt(np.maximum(squares, 0))
    scale = np.where(values > 1e-6 * max(values[-1], 1e-9), 1 / np.maximum(values, 1e-12) ** 2, 0)
    out = z @ (factor @ turn * scale).astype(np.float32)
    out *= weight
    return out


def _blocks(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each word, first word of each block, word after its last, whether the next block follows in the same text)."""
    block, _ = _passages(doc)
    start = _starts(block)
    return _buckets(h), start, np.r_[start[1:], len(h)], np.r_[block[start][1:] == block[start][:-1] + 1, False]


def _passages(doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word its block, numbered through all texts with a gap between texts; and its place in its text."""
    first = _starts(doc)
    size = np.diff(np.r_[first, len(doc)])
    place = np.arange(len(doc)) - np.repeat(first, size)
    before = np.cumsum(np.r_[0, -(-size // BLOCK) + 1])[:-1]
    return np.repeat(before, size) + place // BLOCK, place


def common_subsequence(a: list[int], b: list[int]) -> int:
    """The length of the longest common subsequence, by bit-parallel addition."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for y in b:
        u = v & masks.get(y, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def _run_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each ``n`` words in a row."""
    out = h[: max(0, len(h) - n + 1)]
    for k in range(1, n):
        out = mixed(out * _R + h[k : len(h) - n + 1 + k])
    return out


class Items:
    """A block of benchmark items: their words, the windows of the longer ones, and what the search needs of these."""

    def __init__(self, ids: list, texts: list[bytes | None], space: np.ndarray):
        h, of = words(texts)
        edge = np.searchsorted(of, np.arange(len(ids) + 1)).tolist()
        self.ids, self.space, self.words = ids, space, [h[a:b].tolist() for a, b in zip(edge, edge[1:], strict=False)]
        self.times = [Counter(w) for w in self.words]
        self.short: dict[int, list[tuple[int, int]]] = {}  # number of words to (hash, item)
        windows, owner = [], []
        for i, w in enumerate(self.words):
            if len(w) >= LEAST:
                for s in sorted({*range(0, max(1, len(w) - 2 * BLOCK + 1), STEP), max(0, len(w) - 2 * BLOCK)}):
                    windows.append(w[s : s + 2 * BLOCK])
                    owner.append(i)
            elif w:
                self.short.setdefault(len(w), []).append((int(_run_hashes(h[edge[i] : edge[i + 1]], len(w))[0]), i))
        self.owner = np.array(owner, np.int64)
        self.sizes = np.array([len(set(w)) for w in windows], np.int64)
        sizes = [len(w) for w in windows]
        flat = np.array([x for w in windows for x in w], np.uint64)
        number = np.repeat(np.arange(len(windows)), sizes) if windows else np.empty(0, np.int64)
        self.vectors = _unit(_sums(space, _buckets(flat), number)).T.copy()
        self.least = np.array([COSINE if n == 2 * BLOCK else COSINE_SHORT for n in sizes], np.float32)
        self.holds = np.zeros((len(windows), (1 << (BITS - FOLD)) // 8), np.uint8)
        fold = _buckets(flat) >> FOLD
        np.bitwise_or.at(self.holds, (number, fold >> 3), (1 << (fold & 7)).astype(np.uint8))

    def parts(self) -> Iterator[Items]:
        """Blocks of up to ``WINDOWS`` windows; an item isn't divided."""
        cut, n = [0], 0
        for i, w in enumerate(self.words):
            own = len(w) // STEP + 1
            if n + own > WINDOWS and n:
                cut.append(i)
                n = 0
            n += own
        if len(cut) == 1:
            yield self
            return
        for a, b in zip(cut, [*cut[1:], len(self.ids)], strict=True):
            yield self._some(a, b)

    def _some(self, a: int, b: int) -> Items:
        out = Items.__new__(Items)
        mine = (self.owner >= a) & (self.owner < b)
        out.ids, out.space, out.words, out.times = self.ids[a:b], self.space, self.words[a:b], self.times[a:b]
        out.short = {n: own for n, x in self.short.items() if (own := [(h, i - a) for h, i in x if a <= i < b])}
        out.owner, out.sizes, out.vectors, out.least, out.holds = self.owner[mine] - a, self.sizes[mine], np.ascontiguousarray(self.vectors[:, mine]), self.least[mine], self.holds[mine]
        return out

    def search(self, h: np.ndarray, doc: np.ndarray) -> dict[tuple[int, int], tuple[float, int, bool]]:
        """(text, item) to (cosine, common subsequence, answer there) of its best passage."""
        found: dict[tuple[int, int], tuple[float, int, bool]] = {}
        if not len(h):
            return found
        self._search_short(h, doc, found)
        if not len(self.owner):
            return found
        ids, start, end, follows = _blocks(h, doc)
        own = _block_sums(self.space, ids, start, end)
        vectors, stop = own.copy(), end.copy()
        vectors[:-1] += own[1:] * follows[:-1, None]
        stop[:-1] = np.where(follows[:-1], end[1:], end[:-1])
        vectors = _unit(vectors)
        fold = np.r_[ids >> FOLD, np.zeros(2 * BLOCK, np.int64)]
        byte, bit, flat, width = fold >> 3, (fold & 7).astype(np.uint8), self.holds.ravel(), self.holds.shape[1]
        near: list[np.ndarray] = []  # passage, item and cosine of candidates
        items, per = len(self.ids), max(1, 500_000 // len(self.owner))
        for s in range(0, len(start), per):
            cosines = vectors[s : s + per] @ self.vectors
            p, w = np.divmod(np.flatnonzero(cosines >= self.least), len(self.owner))
            for q in range(0, len(p), 20_000):
                pp, ww = p[q : q + 20_000], w[q : q + 20_000]
                place = start[s + pp][:, None] + np.arange(2 * BLOCK)
                held = (flat.take((ww * width)[:, None] + byte.take(place)) >> bit.take(place)) & 1
                shared = (held & (place < stop[s + pp][:, None])).sum(axis=1, dtype=np.int16)
                good = shared * 2 >= self.sizes[ww]
                pp, ww = pp[good], ww[good]
                near.append(np.column_stack([(s + pp) * items + self.owner[ww], cosines[pp, ww]]))
        if near:
            whole = np.concatenate(near)  # a passage is compared once with an item, whatever the number of its windows
            whole = whole[np.lexsort((-whole[:, 1], whole[:, 0]))]
            whole = whole[_starts(whole[:, 0])]
            for key, cosine in whole.tolist():
                passage, item = divmod(int(key), items)
                self._compare(h, doc, item, cosine, int(start[passage]), int(stop[passage]), found)
        return found

    def _search_short(self, h: np.ndarray, doc: np.ndarray, found: dict) -> None:
        for n, own in self.short.items():
            runs = _run_hashes(h, n)
            whole = doc[n - 1 :] == doc[: max(0, len(doc) - n + 1)]
            at = np.flatnonzero(whole & np.isin(runs, np.array([x for x, _ in own], np.uint64)))
            hit = {(int(doc[k]), int(runs[k])): k for k in at.tolist()}
            for (text, run), k in hit.items():
                for x, i in own:
                    if x == run and h[k : k + n].tolist() == self.words[i]:
                        found[text, i] = (1.0, n, True)

    def _compare(self, h, doc, i, cosine, start, stop, found) -> None:
        item, text = self.words[i], int(doc[start])
        lo, hi = np.searchsorted(doc, [text, text + 1]).tolist()
        around = h[max(lo, start - len(item)) : min(hi, stop + len(item))].tolist()
        times = self.times[i]
        if sum(times[x] for x in times.keys() & set(around)) < PARAPHRASE * len(item):
            return  # a common subsequence can't be longer than this
        common = common_subsequence(item, around)
        if common < PARAPHRASE * len(item):
            return
        answer = item[-ANSWER:]
        there = any(around[k : k + ANSWER] == answer for k, x in enumerate(around) if x == answer[0])
        if common >= VERBATIM * len(item) or there:
            best = found.get((text, i))
            if best is None or (common, cosine) > (best[1], best[0]):
                found[text, i] = (cosine, common, there)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def contaminated(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", marked: bool = False) -> DataFrame:
    """(id, item id, cosine, lcs, coverage, answer) for each document and benchmark item that it holds.

    ``marked`` adds ``mark``, a hash of the text, which tells rows of one id apart.
    """
    spark = df.sparkSession
    docs = df.select(F.col(text_col).cast("binary").alias("t"), F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("mark"))
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).cast("binary").alias("t"))
    kind = T.StructType([T.StructField("id", docs.schema["id"].dataType), T.StructField("mark", T.LongType()), T.StructField("item", items.schema["item"].dataType), T.StructField("cosine", T.DoubleType()), T.StructField("lcs", T.LongType()), T.StructField("coverage", T.DoubleType()), T.StructField("answer", T.BooleanType())])
    n, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()
    out = spark.createDataFrame([], kind)
    if n and not docs.isEmpty():
        df_of, total = document_frequencies(docs)
        idf = np.log((1 + total) / (1 + df_of)) + 1e-3
        shaping = docs
        if SPACE_DOCS and SPACE_DOCS < total:
            shaping = docs.where(F.pmod(F.xxhash64(F.lit(3), "id", "mark"), F.lit(1 << 30)) < int(SPACE_DOCS / total * (1 << 30)))
        space = latent_space(shaping.select("t").coalesce(max(SKETCHES, int(df_of.sum()) // SKETCH_WORDS)), idf)
        blocks = -(-max(n, size * ITEMS // ITEM_BYTES) // ITEMS)
        shared: list[Broadcast] = []
        for b in range(blocks):
            rows = items.where(F.pmod(F.xxhash64("item", "t"), F.lit(blocks)) == b).collect() if blocks > 1 else items.collect()
            for part in Items([r["item"] for r in rows], [r["t"] and bytes(r["t"]) for r in rows], space).parts():
                shared.append(spark.sparkContext.broadcast(part))
                out = out.unionByName(_search(docs, shared[-1], kind))
            del rows
        out = written(out, "leaks")
        for x in shared:
            x.destroy()
    mark = ["mark"] if marked else []
    return out.select(F.col("id").alias(id_col), *mark, F.col("item").alias(item_col), "cosine", "lcs", "coverage", "answer")


def _search(docs: DataFrame, shared: Broadcast, kind: T.StructType) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(kind)

    @lean
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Items = shared.value
        for batch in batches:
            for first, texts in pieces(batch.column(0)):
                found = own.search(*words(texts))
                if not found:
                    continue
                at = [(first + d, i, v) for (d, i), v in found.items()]
                picked = batch.select([batch.schema.names[1], batch.schema.names[2]]).take(pa.array([d for d, _, _ in at], pa.int64()))
                cols = [picked.column(0), picked.column(1), [own.ids[i] for _, i, _ in at], [v[0] for *_, v in at], [v[1] for *_, v in at], [v[1] / len(own.words[i]) for _, i, v in at], [v[2] for *_, v in at]]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return docs.mapInArrow(search, kind)


def drop_contaminated(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that hold no benchmark item."""
    leaks = contaminated(df, benchmark, id_col, text_col, item_col, item_text_col, marked=True)
    leaks = written(leaks.select(F.col(id_col).alias("__gm_id"), F.col("mark").alias("__gm_mark")).distinct(), "leaks")
    own = df.withColumn("__gm_own", F.col(id_col)).withColumn("__gm_own_mark", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    stay = own.join(leaks, F.col("__gm_own").eqNullSafe(F.col("__gm_id")) & (F.col("__gm_own_mark") == F.col("__gm_mark")), "left_anti")
    return stay.select(*[F.col(f"`{c}`") for c in df.columns])
