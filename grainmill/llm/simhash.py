"""SimHash near-duplicates with pivot distance tables.

A pivot table alone discards pairs, but still has to look at every pair. Candidates therefore come from buckets:

* Links at ``bits`` differing bits of 64 are found exactly. The bits are cut into ``b`` blocks; fingerprints that differ in at
  most ``d`` bits agree on some ``b - d`` of them, so they meet in a bucket of one of the C(b, d) combinations.
* A similarity of the shingle sets (0.8, say) is about one bit in seven of a fingerprint, where blocks can't help. There,
  fingerprints have ``WIDE`` words of 64 bits, and meet in buckets of sampled bits; the number of samples is such that a pair
  of just this similarity is missed with a probability of ``MISS`` at most. These fingerprints count each shingle once, as the
  similarity does, and a hash of the set stands behind them, so that only texts of equal sets are one without verification.

Within a bucket, the table of distances to reference fingerprints discards a pair when any coordinate differs by more than
the bits allowed (the triangle inequality), and an exact distance verifies the rest; links by similarity are then verified on
the shingle sets themselves, for which only texts that take part in a link are read again. Only distinct fingerprints take part. A
bucket of more than ``SMALL`` yields spanning forests of its links, never all pairs; buckets beyond ``CHUNK`` fingerprints are
dealt out as pairs of chunks, so no task gets an unbounded group.

A small bucket offers all its pairs, so of a group of near copies most pairs are offered in some bucket. Not all are verified: a forest
of the nearest ones goes first, and of the others only those whose ends it hasn't joined follow, as the rest can't join anything.

Where links are verified later, a forest isn't enough: an edge of it may fail while another pair would have joined its ends. So a
bucket also names its groups of fingerprints that links within the bits connect. Those whose members the verified links haven't all
joined are gone through once more with the shingle sets at hand, in pairs of chunks of ``OPEN``: there, every pair that is still apart
is compared, and a spanning forest of the pairs that are similar enough is added. So no pair that shares a bucket is left out.

Defined results: a null or wordless text has fingerprint zero and is linked like any other; a very long text counts whole; null ids
never become a component's id while it has another; repeated rows are separate rows of one component, of which
``drop_near_duplicates`` keeps one, that of the least hash of all its columns; extra columns are ignored, or carried by it whatever
their names; an empty table gives an empty one.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import lean, shuffle_partitions, written
from ._tokens import mixed, pieces
from .components import components

PIVOTS, CHUNK, SMALL, OPEN, PIECE, AHEAD = 16, 4096, 32, 512, 1 << 17, 1 << 17
WIDE, MISS, SLACK = 4, 0.01, 0.045
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _pieces(raw: bytes) -> Iterator[bytes]:
    """``raw`` cut at white space into pieces of about ``PIECE`` bytes."""
    at = 0
    while len(raw) - at > PIECE:
        if not (space := _SPACE.search(raw, at + PIECE)):
            break
        yield raw[at : space.start()]
        at = space.end()
    yield raw[at:]


def text_fingerprint(raw: bytes | None, size: int = 4, seed: int = 42, width: int = 1, distinct: bool = False) -> list[int]:
    """The SimHash of the word shingles of a whole text: ``width`` unsigned words, the first of XXH64 itself, others of values mixed from it.

    With ``distinct`` each shingle counts once, and one more word follows, a hash of the set of shingles.
    """
    ones, n, tail = np.zeros((width, 64), np.int64), 0, []
    held: list[np.ndarray] = []
    xxh = xxhash.xxh64_intdigest

    def count(hashes: np.ndarray) -> None:
        for w in range(width):
            h = mixed(hashes + np.uint64(w)) if w else hashes
            ones[w] += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)

    for piece in _pieces(raw or b""):
        words = tail + piece.lower().split()
        tail = words
        if len(words) >= size:
            joined = b" ".join(words)
            ends = list(itertools.accumulate([len(w) + 1 for w in words]))
            hashes = [xxh(joined[s : e - 1], seed) for s, e in zip([0, *ends], ends[size - 1 :], strict=False)]
            if distinct:
                held.append(np.unique(np.array(hashes, np.uint64)))
            else:
                count(np.array(hashes, np.uint64))
                n += len(hashes)
            tail = words[len(words) - size + 1 :]
    if not n and not held and tail:
        held.append(np.array([xxh(b" ".join(tail), seed)], np.uint64))
    if held:
        found = np.unique(np.concatenate(held))
        count(found)
        n = len(found)
    whole = [xxh(found.tobytes(), seed) if held else 0] if distinct else []
    return [*_majority(ones, n), *whole]


def _majority(ones: np.ndarray, n: int) -> list[int]:
    return np.packbits(2 * ones > n, axis=1, bitorder="little").view(np.uint64)[:, 0].tolist() if n else [0] * len(ones)


def fingerprint(text: Column, size: int = 4, seed: int = 42, width: int = 1, distinct: bool = False) -> Column:
    """The fingerprint as an array of BIGINTs of equal bits."""

    @F.arrow_udf("array<bigint>")
    def of(raws: pa.Array) -> pa.Array:
        made = [text_fingerprint(x, size, seed, width, distinct) for _, some in pieces(raws) for x in some]
        return _rows(np.array(made, np.uint64).reshape(-1, width + distinct))

    return of(text.cast("binary"))


def _rows(x: np.ndarray) -> pa.ListArray:
    """The rows of a matrix of unsigned words as lists of BIGINTs of equal bits."""
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(np.ascontiguousarray(x).view(np.int64).ravel()))


def _signed(m: int) -> int:
    return m - (1 << 64) if m >> 63 else m


def _block_masks(bits: int, nodes: int) -> list[list[int]]:
    """One mask for each combination of blocks; more and finer ones for more fingerprints, so that buckets stay small."""
    for blocks in range(bits + 1, bits + 5):
        edges = np.linspace(0, 64, blocks + 1).round().astype(int).tolist()
        if nodes / 2 ** (64 * (blocks - bits) / blocks) <= 64:
            break
    block = [((1 << (hi - lo)) - 1) << lo for lo, hi in itertools.pairwise(edges)]
    return [[_signed(sum(c))] for c in itertools.combinations(block, blocks - bits)]


def differing_share(similarity: float) -> float:
    """The expected share of differing bits of two sets of equal size and this Jaccard similarity."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def _sample_masks(similarity: float, nodes: int, width: int = WIDE) -> list[list[int]]:
    """Masks of k random bits, k growing with the logarithm of ``nodes``, as many as ``MISS`` asks for."""
    k = max(14, math.ceil(math.log2(max(1, nodes) / 14)))
    n = math.ceil(math.log(MISS) / math.log(1 - (1 - differing_share(similarity)) ** k))
    rng = np.random.default_rng(7_919)
    out = []
    for _ in range(n):
        places = rng.choice(64 * width, k, replace=False).tolist()
        out.append([_signed(sum(1 << (p % 64) for p in places if p // 64 == w)) for w in range(width)])
    return out


def _pivots(width: int, n: int = PIVOTS) -> np.ndarray:
    """Fixed reference fingerprints."""
    return np.random.default_rng(20_011).integers(0, 1 << 63, (n, width), np.uint64) << np.uint64(1)


def _close(x: np.ndarray, table: np.ndarray, a: np.ndarray, b: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs (a, b), those within ``bits``: pivot coordinates discard first, four at a time, then whole distances."""
    for at in range(0, table.shape[1], 4):
        stay = (np.abs(table[a, at : at + 4] - table[b, at : at + 4]) <= bits).all(axis=1)
        a, b = a[stay], b[stay]
    stay = np.bitwise_count(x[a] ^ x[b]).sum(axis=1) <= bits
    return a[stay], b[stay]


def _forest(x: np.ndarray, table: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among ``x``."""
    left, found, queue = np.arange(1, len(x)), [], [0]
    while True:
        if not queue:
            if not len(left):
                return found
            queue, left = [int(left[0])], left[1:]
        u = queue.pop()
        near = left[np.abs(table[left, 0] - table[u, 0]) <= bits]
        _, hit = _close(x, table, np.full(len(near), u), near, bits)
        if len(hit):
            found += [(u, int(v)) for v in hit]
            queue += hit.tolist()
            left = np.setdiff1d(left, hit, assume_unique=True)


def _without_circles(ends: np.ndarray, n: int) -> np.ndarray:
    """Which of the links ``ends`` (pairs of numbers below ``n``) join what the ones before them haven't joined."""
    up = list(range(n))

    def top(u: int) -> int:
        while up[u] != u:
            up[u] = u = up[up[u]]
        return u

    new = np.zeros(len(ends), bool)
    for k, (u, v) in enumerate(ends.tolist()):
        if (u := top(u)) != (v := top(v)):
            up[u], new[k] = v, True
    return new


def _groups(x: np.ndarray, edges: list[tuple[int, int]]) -> list[np.ndarray]:
    """The members of each tree of a forest, of three at least: a tree of two is offered whole by its edge."""
    tree = np.arange(len(x))
    for u, v in edges:  # an edge's first end is in its tree already
        tree[v] = tree[u]
    order = np.argsort(tree, kind="stable")
    return [m for m in np.split(order, np.flatnonzero(np.diff(tree[order])) + 1) if len(m) > 2]


def _group_key(x: np.ndarray) -> int:
    """The same for the same members, whichever bucket they meet in."""
    return xxhash.xxh64_intdigest(x[np.lexsort(x.T)].tobytes()) - (1 << 63)


def _linker(bits: int, width: int):
    """A row (a, b, null) for each link offered; for those to be verified, also a row (null, member, group) for each member of a group of a large bucket."""
    words = pa.list_(pa.int64())
    schema = pa.schema([("a", words), ("b", words), ("g", pa.int64())])
    pivots, wide = _pivots(width), width + (width > 1)  # the word behind wide fingerprints tells sets apart and isn't part of distances
    levels = (bits,) if width == 1 else (bits // 3, 2 * bits // 3, bits)  # where links are verified later, near ones are offered first

    def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Group numbers and fingerprints, cut only between groups."""
        kept: list[np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns[:-1]] + [batch.columns[-1].flatten().to_numpy().reshape(-1, wide)]
            cols = cols if kept is None else [np.concatenate(x) for x in zip(kept, cols, strict=True)]
            new = np.any([c[1:] != c[:-1] for c in cols[:-1]], axis=0)
            at = np.flatnonzero(new)
            cut = int(at[-1]) + 1 if len(at) else 0
            if cut:
                yield np.concatenate([[0], np.cumsum(new[: cut - 1])]), cols[-1][:cut].view(np.uint64)
            kept = [c[cut:] for c in cols]
        if kept is not None:
            yield np.zeros(len(kept[0]), np.int64), kept[-1].view(np.uint64)

    @lean
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, x in whole_groups(batches):
            starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            sizes = np.diff(np.r_[starts, len(x)])
            more = np.repeat(sizes > 1, sizes)  # most groups of sampled bits hold one fingerprint
            whole, group = x[more], group[more]
            x = np.ascontiguousarray(whole[:, :width])
            sizes = sizes[sizes > 1]
            if not len(x):
                continue
            starts = np.r_[0, np.cumsum(sizes)[:-1]]
            table = np.stack([np.bitwise_count(x ^ p).sum(axis=1, dtype=np.int16) for p in pivots], axis=1)
            size = np.repeat(sizes, sizes)
            pairs, members, keys = [], [], []
            few = size <= SMALL
            for step in range(1, SMALL):
                a = np.flatnonzero(few[:-step] & (group[:-step] == group[step:])) if len(x) > step else np.empty(0, int)
                if not len(a):
                    break
                pairs.append(np.column_stack(_close(x, table, a, a + step, bits)))
            for s, n in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
                forests = [np.array(edges := _forest(x[s : s + n], table[s : s + n], most), int).reshape(-1, 2) for most in levels]
                offered = np.concatenate(forests)
                pairs.append((offered[_without_circles(offered, n)] if len(levels) > 1 else offered) + s)
                if len(levels) > 1:
                    for m in _groups(x[s : s + n], edges):
                        members.append(m + s)
                        keys.append(np.full(len(m), _group_key(whole[m + s]), np.int64))
            found = np.concatenate(pairs) if pairs else np.empty((0, 2), int)
            yield pa.RecordBatch.from_arrays([_rows(whole[found[:, 0]]), _rows(whole[found[:, 1]]), pa.nulls(len(found), pa.int64())], schema=schema)
            if members:
                own = _rows(whole[np.concatenate(members)])
                yield pa.RecordBatch.from_arrays([pa.nulls(len(own), words), own, pa.array(np.concatenate(keys))], schema=schema)

    return link


def links(fingerprints: DataFrame, bits: int, masks: list[list[int]], chunk: int = CHUNK) -> DataFrame:
    """(a, b, g): links among the distinct fingerprints of column ``fp``, enough to connect all that are within ``bits`` and share a bucket.

    With more words than one, rows with a group ``g`` name the members ``b`` of the groups of large buckets.
    """
    width = len(masks[0])
    key = lambda m: F.xxhash64(*[F.col("fp")[w].bitwiseAND(F.lit(x)) for w, x in enumerate(m) if x])
    keyed = fingerprints.select("fp", F.posexplode(F.array(*[key(m) for m in masks])).alias("c", "key"))
    large = written(keyed.groupBy("c", "key").count().where(F.col("count") > chunk).select("c", "key", F.ceil(F.col("count") / chunk).cast("int").alias("n")), "large")
    dealt = keyed.join(large, ["c", "key"], "left").withColumn("i", F.pmod(F.xxhash64("fp"), F.coalesce("n", F.lit(1))).cast("int"))
    dealt = dealt.withColumn("j", F.explode(F.sequence(F.lit(0), F.coalesce("n", F.lit(1)) - 1)))
    dealt = dealt.select("c", "key", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "fp")
    dealt = dealt.repartition(shuffle_partitions(fingerprints.sparkSession), "c", "key", "i", "j").sortWithinPartitions("c", "key", "i", "j")
    return dealt.mapInArrow(_linker(bits, width), "a array<bigint>, b array<bigint>, g bigint")


def shingle_set(raw: bytes | None, size: int) -> np.ndarray:
    """The distinct hashes of a text's word shingles."""
    words = (raw or b"").lower().split()
    joined, ends = b" ".join(words), list(itertools.accumulate([len(w) + 1 for w in words]))
    grams = [joined[s : e - 1] for s, e in zip([0, *ends], ends[size - 1 :], strict=False)] or ([joined] if words else [])
    return np.unique(np.array([xxhash.xxh64_intdigest(g) for g in grams], np.uint64)).view(np.int64)


def _sets(df: DataFrame, id_col: str, text_col: str, size: int, base: DataFrame, ends: DataFrame, tag: str) -> DataFrame:
    """(fp, s): the shingle set of each fingerprint of ``ends``. Rows of one fingerprint have equal sets; the first stands for all."""
    stand = base.join(ends, "fp", "left_semi").groupBy("fp").agg(F.min(F.struct("id", "mark")).alias("r"))
    stand = written(stand.select("fp", F.col("r.id").alias("r_id"), F.col("r.mark").alias("r_mark")), "ends")
    texts = df.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("mark"), F.col(text_col).cast("binary").alias("t"))
    numbers = T.ArrayType(T.LongType())

    @lean
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, raws in pieces(batch.column(1)):
                made = [shingle_set(x, size) for x in raws]
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(x) for x in made])], pa.int32()), pa.array(np.concatenate(made)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(raws)), lists], names=["fp", "s"])

    found = texts.join(stand, F.col("id").eqNullSafe(F.col("r_id")) & (F.col("mark") == F.col("r_mark"))).select("fp", "t")
    held = found.mapInArrow(sets, T.StructType([T.StructField("fp", numbers), T.StructField("s", numbers)]))
    return written(held.dropDuplicates(["fp"]), tag)


def _nearest_first(found: DataFrame) -> DataFrame:
    """The links (a, b) with ``first``: whether a spanning forest that takes the nearest ones holds them, of some ``AHEAD`` links that a task reads together."""
    words = pa.list_(pa.int64())
    schema = pa.schema([("a", words), ("b", words), ("first", pa.bool_())])

    def marked(some: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(some).combine_chunks().to_batches()[0]
        a, b = (c.flatten().to_numpy().reshape(len(c), -1) for c in rows.columns)
        far = np.bitwise_count((a[:, :WIDE] ^ b[:, :WIDE]).view(np.uint64)).sum(axis=1)
        order = np.argsort(far, kind="stable")
        nodes, number = np.unique(np.concatenate([a, b]), axis=0, return_inverse=True)
        first = np.empty(len(a), bool)
        first[order] = _without_circles(number.reshape(2, -1).T[order], len(nodes))
        return pa.RecordBatch.from_arrays([_rows(a.view(np.uint64)), _rows(b.view(np.uint64)), pa.array(first)], schema=schema)

    @lean
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some: list[pa.RecordBatch] = []
        for batch in batches:
            some += [batch] if batch.num_rows else []
            if sum(x.num_rows for x in some) >= AHEAD:
                yield marked(some)
                some = []
        if some:
            yield marked(some)

    return found.select("a", "b").mapInArrow(mark, "a array<bigint>, b array<bigint>, first boolean")


def _linked(df: DataFrame, id_col: str, text_col: str, size: int, similarity: float, base: DataFrame, found: DataFrame) -> DataFrame:
    """The components of the links (a, b) whose shingle sets are as similar as asked for.

    A forest of the nearest links is verified first; of the others, those whose ends it hasn't joined. The rest can't join anything.
    """
    ends = found.select(F.col("a").alias("fp")).unionByName(found.select(F.col("b").alias("fp"))).distinct()
    held = _sets(df, id_col, text_col, size, base, ends, "sets")
    found = written(_nearest_first(found), "nearest")
    label = written(components(written(_verified(held, similarity, found.where("first")), "verified")), "labels")
    root = lambda end: label.select(F.col("node").alias(end), F.col("root").alias(f"r_{end}"))
    rest = found.where("NOT first").join(root("a"), "a", "left").join(root("b"), "b", "left")
    rest = written(rest.where(~F.coalesce("r_a", "a").eqNullSafe(F.coalesce("r_b", "b"))).select("a", "b"), "rest")
    if rest.isEmpty():
        return label
    return _joined(label, written(_verified(held, similarity, rest), "verified"))


def _joined(label: DataFrame, more: DataFrame) -> DataFrame:
    """The components of ``label`` with more links: a node and its root are a link too, so the ones behind ``label`` aren't needed again."""
    return written(components(label.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)), "labels")


def _verified(held: DataFrame, similarity: float, found: DataFrame) -> DataFrame:
    """The links (a, b) whose shingle sets, as ``held``, are as similar as asked for."""
    found = found.select("a", "b")
    side = lambda name: held.select(F.col("fp").alias(name), F.col("s").alias(f"s_{name}"))
    both = found.join(side("a"), "a").join(side("b"), "b")
    common = F.size(F.array_intersect("s_a", "s_b"))
    return both.where(common >= F.lit(similarity) * (F.size("s_a") + F.size("s_b") - common) - 1e-9).select("a", "b")


def _joined_within(x: np.ndarray, label: np.ndarray, flat: np.ndarray, sizes: np.ndarray, bits: int, similarity: float) -> list[tuple[int, int]]:
    """Of the pairs of different labels within ``bits`` whose sets (``flat``, cut by ``sizes``) are similar enough, a spanning forest."""
    _, flat = np.unique(flat, return_inverse=True)
    starts = np.r_[0, np.cumsum(sizes)]
    mark = np.zeros(len(flat) + 1, bool)
    left, found, queue = np.arange(1, len(x)), [], [0]
    while True:
        if not queue:
            if not len(left):
                return found
            queue, left = [int(left[0])], left[1:]
        u = queue.pop()
        own = flat[starts[u] : starts[u + 1]]
        mark[own] = True
        same = label[left] == label[u]
        near = left[~same & (np.bitwise_count(x[left] ^ x[u]).sum(axis=1) <= bits)]
        near = near[np.minimum(sizes[near], sizes[u]) >= similarity * np.maximum(sizes[near], sizes[u]) - 1e-9]
        common = np.array([np.count_nonzero(mark[flat[starts[v] : starts[v + 1]]]) for v in near.tolist()], np.int64)
        mark[own] = False
        hit = near[common >= similarity * (sizes[near] + sizes[u] - common) - 1e-9]
        found += [(u, int(v)) for v in hit]
        queue += [*hit.tolist(), *left[same].tolist()]
        left = np.setdiff1d(left[~same], hit, assume_unique=True)


def _within_groups(df: DataFrame, id_col: str, text_col: str, size: int, similarity: float, bits: int, base: DataFrame, members: DataFrame, label: DataFrame, most: int = OPEN) -> DataFrame | None:
    """Verified links (a, b) among the members (g, fp) of groups that ``label`` leaves apart, or nothing if there are none."""
    told = members.join(label.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    told = written(told, "told")
    apart = told.groupBy("g").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("count")).where("lo <> hi")
    apart = written(apart.select("g", F.ceil(F.col("count") / most).cast("int").alias("n")), "apart")
    if apart.isEmpty():
        return None
    told = written(told.join(apart, "g"), "open")
    held = _sets(df, id_col, text_col, size, base, told.select("fp").distinct(), "open_sets")
    dealt = told.withColumn("i", F.pmod(F.xxhash64("fp"), "n").cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    dealt = dealt.select("g", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "fp", "root")

    def compare(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        sets = rows["s"].combine_chunks()
        x = np.array(rows["fp"].to_pylist(), np.int64).view(np.uint64)[:, :WIDE]
        label = np.unique(np.array(rows["root"].to_pylist(), np.int64), axis=0, return_inverse=True)[1].ravel()
        sizes = sets.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        found = np.array(_joined_within(x, label, sets.flatten().to_numpy(), sizes, bits, similarity), int).reshape(-1, 2)
        return pa.table({"a": rows["fp"].take(pa.array(found[:, 0])), "b": rows["fp"].take(pa.array(found[:, 1]))})

    return dealt.join(held, "fp").groupBy("g", "i", "j").applyInArrow(compare, "a array<bigint>, b array<bigint>")


def _members(df: DataFrame, id_col: str, text_col: str, bits: int, size: int, similarity: float | None) -> DataFrame:
    """id, fp, root (the component's own key, a fingerprint), mark (a hash of the text) and component_id for each row of ``df``."""
    width = WIDE if similarity else 1
    base = written(df.select(F.col(id_col).alias("id"), fingerprint(F.col(text_col), size, width=width, distinct=bool(similarity)).alias("fp"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("mark")), "fingerprints")
    nodes = written(base.groupBy("fp").agg(F.min("id").alias("own")), "nodes")
    n = nodes.count()
    most = int(64 * width * (differing_share(similarity) + SLACK)) if similarity else bits
    masks = _sample_masks(similarity, n) if similarity else _block_masks(bits, n)
    found = links(nodes.select("fp"), most, masks)
    found = written(found.distinct(), "links") if similarity else found
    members = found.where("g IS NOT NULL").select("g", F.col("b").alias("fp"))
    found = found.where("g IS NULL").select("a", "b")
    label = _linked(df, id_col, text_col, size, similarity, base, found) if similarity else written(components(found), "labels")
    more = _within_groups(df, id_col, text_col, size, similarity, most, base, members, label) if similarity else None
    label = _joined(label, more) if more is not None else label
    label = label.withColumnRenamed("node", "fp")
    least = label.join(nodes, "fp").groupBy("root").agg(F.min("own").alias("least"))
    whole = nodes.join(label.join(least, "root"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("least", "own").alias("component_id"))
    # written, so that both sides of the join are plain shuffles, whose skewed parts (a fingerprint of many copies) Spark may split
    return base.join(written(whole, "components"), "fp")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 4, size: int = 4, similarity: float | None = None) -> DataFrame:
    """(id, fingerprint, component_id) for each row of ``df``; component_id is the smallest id reachable.

    Links are at most ``bits`` differing bits of 64, or, with ``similarity``, at least this similarity of shingle sets; candidates for
    these differ in the share of bits that sets of this similarity are expected to, and ``SLACK`` more.
    """
    word = lambda w: F.lower(F.lpad(F.hex(w), 16, "0"))
    return _members(df, id_col, text_col, bits, size, similarity).select(F.col("id").alias(id_col), F.array_join(F.transform(F.slice("fp", 1, WIDE), word), "").alias("fingerprint"), "component_id")


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float | None = 0.8, size: int = 5, bits: int = 4) -> DataFrame:
    """The rows of ``df``, one for each component: that of the smallest id (of repeated rows, one)."""
    found = written(_members(df, id_col, text_col, bits, size, similarity).select("id", "mark", "root"), "members")
    stays = found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "mark")).alias("s"))
    stays = written(stays.select(F.col("s.id").alias("__gm_id"), F.col("s.mark").alias("__gm_mark")), "stays")
    own = df.withColumn("__gm_own", F.col(id_col)).withColumn("__gm_own_mark", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    columns = [F.col(f"`{c}`") for c in df.columns]
    same = F.col("__gm_own").eqNullSafe(F.col("__gm_id")) & (F.col("__gm_own_mark") == F.col("__gm_mark"))
    twice = found.groupBy("id", "mark").count().where("count > 1").select(F.col("id").alias("__gm_id"), F.col("mark").alias("__gm_mark"))
    twice = written(twice.join(stays, twice["__gm_id"].eqNullSafe(stays["__gm_id"]) & (twice["__gm_mark"] == stays["__gm_mark"]), "left_semi"), "twice")
    if twice.isEmpty():
        return own.join(stays, same, "left_semi").select(*columns)
    # of repeated rows one stays: a minimum, which is taken before the shuffle, so that any number of them may be equal
    alone = own.join(stays, same, "left_semi").join(twice, same, "left_anti").select(*columns)
    hashed = F.xxhash64(*[c for c, f in zip(columns, df.schema.fields, strict=True) if not _holds_map(f.dataType)])
    one = own.join(twice, same, "left_semi").groupBy("__gm_own", "__gm_own_mark").agg(F.min_by(F.struct(*columns), hashed).alias("__gm_row"))
    return alone.unionByName(one.select("__gm_row.*"))


def _holds_map(kind: T.DataType) -> bool:
    """Whether values of this type can't be hashed."""
    return '"map"' in kind.json() or isinstance(kind, T.VariantType)
