"""Text, hash and window functions as column expressions; Python only where no built-in has the semantics."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space as a Java class; Java's own class is ASCII, and its Unicode flag leaves out four control characters.
SPACE = r"\s\x1c-\x1f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACES = f"[{SPACE}]+"
#: Runs of white space but for a single blank, which most are and which need no replacement. Letters are told by one
#: comparison before the class is asked.
IRREGULAR = f"(?![!-~])(?:[{SPACE}&&[^ ]][{SPACE}]*| [{SPACE}]+)"
MASK61 = (1 << 61) - 1


def normalize_simple(text: Column) -> Column:
    """White space to single blanks, no blanks at the ends, lower case."""
    return F.lower(F.trim(F.regexp_replace(text, IRREGULAR, " ")))


def normalize_full(text: Column, lowercase: bool = True, strip_html: bool = True, collapse_whitespace: bool = True) -> Column:
    """Tags to blanks, then entities, NFKC, lower case and white space: in this order, so an escaped tag survives as text.

    Entity decoding and NFKC have no built-in, so the middle is an Arrow UDF; the rest stays in the JVM. Only a piece of a batch
    stands in Python's memory as strings at a time.
    """

    @F.arrow_udf("string")
    def decoded(texts: pa.Array) -> pa.Array:
        return decoded_batch(texts, strip_html)

    out = F.regexp_replace(text, "<[^>]+>", " ") if strip_html else text
    out = decoded(out)
    out = F.lower(out) if lowercase else out
    return F.trim(F.regexp_replace(out, IRREGULAR, " ")) if collapse_whitespace else out


def decoded_batch(texts: pa.Array, entities: bool, piece: int = 64) -> pa.Array:
    """NFKC of each text, after its entities; ``piece`` texts at a time become strings of Python."""

    def one(t: str | None) -> str | None:
        if t is None or t.isascii() and not (entities and "&" in t):
            return t
        return unicodedata.normalize("NFKC", html.unescape(t) if entities else t)

    return pa.concat_arrays([pa.array([one(t) for t in texts.slice(i, piece).to_pylist()], pa.string()) for i in range(0, len(texts), piece)] or [pa.array([], pa.string())])


def first_text(primary: Column, *fallbacks: Column) -> Column:
    """The primary text unless null or empty, else the first fallback that isn't blank."""
    return F.coalesce(F.when(primary != "", primary), *[F.when(F.trim(F.regexp_replace(c, SPACES, " ")) != "", c) for c in fallbacks])


def has_text(text: Column) -> Column:
    return text.isNotNull() & (text != "")


# hashes -----------------------------------------------------------------------------------------


def sha1_signed64(text: Column) -> Column:
    """The first 8 bytes of SHA-1 as a signed integer."""
    return F.conv(F.substring(F.sha1(text.cast("binary")), 1, 16), 16, -10).cast("bigint")


def sha1_61(text: Column) -> Column:
    return sha1_signed64(text).bitwiseAND(F.lit(MASK61))


def xxh64_hex(text: Column) -> Column:
    """XXH64 of seed 0 in hexadecimal. The built-in ``xxhash64`` is the same function of seed 42; this one is for digests that leave the engine."""

    @F.pandas_udf("string")
    def digest(texts: pd.Series) -> pd.Series:
        import xxhash

        return texts.map(lambda t: None if t is None else xxhash.xxh64_hexdigest(t.encode()))

    return digest(text)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once: an expression inside a lambda is otherwise evaluated for each element."""
    return F.transform(F.array(value), body)[0]


# tokens and windows -----------------------------------------------------------------------------


def word_tokens(text: Column) -> Column:
    """Words between blanks; the empty text has none."""
    return F.array_remove(F.split(text, " "), "")


def char_tokens(text: Column) -> Column:
    """Code points."""
    return F.array_remove(F.split(text, ""), "")


def word_count(normalized: Column) -> Column:
    """The number of words of text in its simple normal form: one more than it has blanks."""
    return F.when(normalized == "", 0).otherwise(F.length(normalized) - F.length(F.replace(normalized, F.lit(" "), F.lit(""))) + 1)


def bpe_tokens(path: str) -> Callable[[Column], Column]:
    """A tokenizer for ``build_chunks``: the numbers, as text, of a vocabulary file in the JSON form of the ``tokenizers`` library, which executors read at ``path``."""

    def encode(text: Column) -> Column:
        @F.pandas_udf("array<string>")
        def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            tokenizer = _tokenizer(path)
            for texts in batches:
                yield pd.Series([[str(i) for i in x.ids] for x in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)])

        return of(text)

    return encode


def bpe_text(tokens: Column, path: str) -> Column:
    """The text of numbers that ``bpe_tokens`` has given."""

    @F.pandas_udf("string")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = _tokenizer(path)
        for rows in batches:
            yield pd.Series([None if r is None else tokenizer.decode([int(i) for i in r], skip_special_tokens=False) for r in rows])

    return of(tokens)


def _tokenizer(path: str):
    try:
        from tokenizers import Tokenizer
    except ImportError as e:
        raise RuntimeError("subword tokens need the tokenizers library") from e
    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True
    return found


def windows(tokens: Column, size: int, stride: int, full_only: bool = False) -> Column:
    """Windows from 0, stride, ...; short tails stay unless ``full_only``."""
    if size <= 0 or stride <= 0:
        raise ValueError("window size and stride must be positive")

    def cut(w: Column) -> Column:
        last = F.size(w) - (size if full_only else 1)
        starts = F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(stride))
        return F.when(last >= 0, F.transform(starts, lambda i: F.slice(w, i + 1, F.lit(size)))).otherwise(F.array())

    return let(tokens, cut)


def runs(tokens: Column, n: Column) -> Column:
    """Every run of ``n`` tokens, as text."""
    return let(tokens, lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, n), " ")))


def word_shingles(tokens: Column, n: int, short: str = "none") -> Column:
    """Distinct n-grams of words. Fewer than n words give the words themselves (``short="words"``) or nothing."""

    def cut(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(w) - n, F.lit(0)))
        grams = F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice(w, i + 1, F.lit(n)), " ")))
        few = F.array_distinct(w) if short == "words" else F.expr("CAST(array() AS array<string>)")
        return F.when(F.size(w) >= n, grams).otherwise(few)

    return let(tokens, cut)


def char_shingles(text: Column, size: int = 32, step: int = 4) -> Column:
    """Distinct character windows that begin before the last ``size`` characters; texts up to ``size`` have none."""

    def cut(t: Column) -> Column:
        # code points as an array: a place in a string is found by walking from its start
        points = F.split(t, "")
        starts = F.sequence(F.lit(0), F.greatest(F.length(t) - size - 1, F.lit(0)), F.lit(step))
        grams = let(points, lambda c: F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice(c, i + 1, F.lit(size)), ""))))
        return F.when(F.length(t) > size, grams).otherwise(F.expr("CAST(array() AS array<string>)"))

    return let(text, cut)


# similarity -------------------------------------------------------------------------------------


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; null if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / (F.size(a) + F.size(b) - both))


def signature_similarity(a: Column, b: Column) -> Column:
    """The share of equal places of two signatures."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / F.size(a)


def band_keys(signature: Column, rows: int, bands: int) -> Column:
    """For each band a hash of its rows."""
    return let(signature, lambda s: F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.xxhash64(F.slice(s, b * rows + 1, F.lit(rows)))))


# ids and parsers --------------------------------------------------------------------------------


def chunk_id(prefix: str, doc_id: Column, position: Column) -> Column:
    return F.format_string(f"{prefix}-doc%05d-chunk%04d", doc_id, position)


def manifest_chunk_id(doc_id: Column, position: Column) -> Column:
    return F.concat_ws(":", F.lit("chunk"), doc_id.cast("string"), position.cast("string"))


def manifest_doc_id(doc_id: Column) -> Column:
    return F.concat(F.lit("doc:"), doc_id.cast("string"))


def canary_prefix(phrase: Column) -> Column:
    """What stands before the first colon, with the colon."""
    return F.concat(F.substring_index(phrase, ":", 1), F.lit(":"))


def curve_points(text: Column) -> Column:
    """``"3e9:50"`` as (tokens, metric)."""
    return F.struct(F.substring_index(text, ":", 1).cast("double").alias("tokens"), F.substring_index(text, ":", -1).cast("double").alias("metric"))


def context_and_target(text: Column) -> Column:
    """The text without its last word, and that word; null where there is no blank."""
    t = F.regexp_replace(text, f"^{SPACES}|{SPACES}$", "")
    return F.when(t.contains(" "), F.struct(F.regexp_extract(t, r"(?s)^(.*) ([^ ]*)$", 1).alias("context"), F.substring_index(t, " ", -1).alias("target")))


#: Fixed markers of the two-solution prompt format.
ASSISTANT, GOAL, FIRST, SECOND, OUTPUT = "### Assistant:", "You need to reach the goal", "The first solution is", "The second solution is", "Output"


def two_solution_prompt(text: Column) -> Column:
    """(goal, sol1, sol2, label) of a prompt in the marked format; null if a marker or the label is missing."""
    after = lambda t, marker: F.split(t, re.escape(marker), 2)
    head, tail = after(text, ASSISTANT)[0], F.get(after(text, ASSISTANT), F.lit(1))
    goal_rest = F.get(after(head, GOAL), F.lit(1))
    goal, rest = F.get(after(goal_rest, FIRST), F.lit(0)), F.get(after(goal_rest, FIRST), F.lit(1))
    sol1, rest2 = F.get(after(rest, SECOND), F.lit(0)), F.get(after(rest, SECOND), F.lit(1))
    sol2, closed = F.get(after(rest2, OUTPUT), F.lit(0)), F.get(after(rest2, OUTPUT), F.lit(1))
    strip = lambda c: F.regexp_replace(c, f"^{SPACES}|{SPACES}$", "")
    dots = lambda c: F.regexp_replace(strip(c), r"\.+$", "")
    label = F.regexp_extract(strip(tail), r"^([0-9])", 1).try_cast("int")
    return F.when(label.isNotNull() & closed.isNotNull(), F.struct(strip(goal).alias("goal"), dots(sol1).alias("sol1"), dots(sol2).alias("sol2"), label.alias("label")))


def option_prompt(context_a: Column, context_b: Column) -> Column:
    return F.trim(F.concat(context_a, F.lit(" "), context_b))


def cosine_lr(step: Column, lr: float, warmup: int, steps: int) -> Column:
    """A learning rate that rises in a line and falls along a cosine."""
    progress = F.least(F.lit(1.0), (step - warmup) / F.lit(float(max(1, steps - warmup))))
    return F.when(step < warmup, F.lit(lr) * (step + 1) / F.lit(float(max(1, warmup)))).otherwise(F.lit(lr * 0.5) * (1 + F.cos(F.pi() * progress)))
