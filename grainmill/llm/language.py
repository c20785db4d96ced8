"""Language ID by a string kernel, Nyström landmarks and one-versus-rest kernel ridge regression.

The blended-spectrum presence kernel of two texts is the number of n-grams (n = 1 to 3) that both hold, over the geometric
mean of how many each holds. N-grams are counted in hashed form, in ``1 << BITS`` buckets. A bounded sample of labelled
rows trains the model: about ``SAMPLE`` rows, dealt evenly to the languages (one of each language at least), of which longer
texts give a window of ``LONGEST`` characters at a place that a hash chooses, the first ``LANDMARKS`` of them (dealt evenly
too) as landmarks. Every whole text is then scored in batches of matrix products:
presence by landmarks, by the inverse root of the landmarks' kernel, by the ridge weights.

The scores rank languages, but can't tell that a text is of none of them: they sum to a constant. For that, ``familiar`` is the
share of a text's n-grams that are usual in the predicted language (held by ``USUAL`` of its training rows), less the language's
bound: halfway between what nearly all training rows reach, each by the others' n-grams, and what the same rows reach with
their letters shuffled. Short texts have ``ALLOWED`` over the root of their number of n-grams to spare.

Defined results: a null text or one without a letter is ``und`` with score 0, as is every text when nothing is labelled; a
null id counts as the empty string for the split; very long texts are scored whole; repeated rows get equal predictions, and
of equal scores the language that comes first by name is taken; other columns are ignored, or carried by ``keep_identified``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._tokens import pieces

USUAL, ALLOWED = 0.01, 0.5
BITS, SAMPLE, LANDMARKS, LONGEST, RIDGE, BATCH, PIECE = 15, 2048, 128, 20_000, 1e-3, 64, 1 << 20
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_FOLD = np.full(128, 32, np.uint32)  # ASCII without letters is a blank
_FOLD[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)


def held_out(id_col: Column) -> Column:
    """Whether the row is kept from training."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def mark_presence(text: str, row: np.ndarray) -> None:
    """Set ``row`` to 1 at the bucket of each n-gram of the whole text."""
    for at in range(0, max(1, len(text)), PIECE):
        codes = np.frombuffer(f" {text[at : at + PIECE + 2].lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.where(codes < 128, _FOLD[np.minimum(codes, 127)], codes)
        codes = codes[np.r_[True, (codes[1:] != 32) | (codes[:-1] != 32)]]  # runs of blanks count as one
        gram = np.zeros(len(codes), np.uint32)
        for n in range(1, 4):
            if len(codes) < n:
                break
            gram = (gram[: len(codes) - n + 1] + codes[n - 1 :]) * np.uint32(2_654_435_761)
            h = gram ^ (gram >> np.uint32(15))
            row[((h + np.uint32(n)) * np.uint32(2_246_822_519)) >> np.uint32(32 - BITS)] = 1


@dataclass
class Model:
    languages: list[str]
    landmarks: np.ndarray  # bits
    root: np.ndarray
    weights: np.ndarray
    usual: np.ndarray  # bits: for each bucket and language, whether it is usual there
    bounds: np.ndarray

    def ready(self) -> Ready:
        return Ready(self)


class Ready:
    """A model with its matrices unpacked, for as long as a task runs."""

    def __init__(self, model: Model):
        self.model = model
        self.landmarks = np.unpackbits(model.landmarks, axis=1).astype(np.float32)
        self.landmarks /= np.sqrt(self.landmarks.sum(axis=1, keepdims=True))
        self.usual = np.unpackbits(model.usual, axis=0).astype(np.float32)

    def features(self, x: np.ndarray) -> np.ndarray:
        """Nyström features of a batch of presence rows, and a constant."""
        k = (x @ self.landmarks.T) / np.sqrt(np.maximum(1, x.sum(axis=1, keepdims=True)))
        return np.hstack([k @ self.model.root, np.ones((len(x), 1), np.float32)])

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.model.weights

    def familiar(self, x: np.ndarray, best: np.ndarray) -> np.ndarray:
        """How far each row's share of usual n-grams of the language ``best`` is above the bound."""
        n = np.maximum(1, x.sum(axis=1))
        return (x @ self.usual)[np.arange(len(x)), best] / n - self.model.bounds[best] + ALLOWED / np.sqrt(n)


def _shuffled(text: str, rng: np.random.Generator) -> str:
    """The text with its letters in another order; all else stays in place."""
    chars = np.array(list(text.lower()))
    at = np.flatnonzero([c.isalpha() for c in chars])
    chars[at] = chars[rng.permutation(at)]
    return "".join(chars)


def usual_grams(texts: list[str], langs: list[str], names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For each bucket and language whether it is usual there, and the least share of usual n-grams for each language."""
    usual, bounds = np.zeros((1 << BITS, len(names)), bool), np.zeros(len(names), np.float32)
    rng = np.random.default_rng(31)
    for k, name in enumerate(names):
        own = list(dict.fromkeys(t for t, lang in zip(texts, langs, strict=True) if lang == name))
        bits = np.zeros((len(own), 1 << BITS), np.uint8)
        for row, t in zip(bits, own, strict=True):
            mark_presence(t, row)
        count = bits.sum(axis=0, dtype=np.int64)
        least = max(1, USUAL * len(own))
        usual[:, k] = count >= least
        if len(own) < 8:
            continue  # too few to tell; everything is let through
        size = bits.sum(axis=1, dtype=np.int64)
        share = np.array([np.count_nonzero(count[row > 0] > least) / max(1, n) for row, n in zip(bits, size, strict=True)])
        wild = []
        for t in own:
            row = np.zeros(1 << BITS, np.uint8)
            mark_presence(_shuffled(t, rng), row)
            wild.append(np.count_nonzero(count[row > 0] > least) / max(1, np.count_nonzero(row)))
        # of texts with enough n-grams to tell; the median of shuffled rows, as some are too short or uniform to be changed
        long = size >= min(100, np.median(size))
        bounds[k] = (np.quantile(share[long], 0.01) + np.median(np.array(wild)[long])) / 2
    return np.packbits(usual, axis=0), bounds


def fit(texts: list[str], langs: list[str]) -> Model | None:
    """Ridge regression on the Nyström features of the sample. The texts come in an order that alternates languages."""
    if not texts:
        return None
    names = sorted(set(langs))
    bits = np.zeros((min(LANDMARKS, len(texts)), 1 << BITS), np.uint8)
    for row, t in zip(bits, texts, strict=False):
        mark_presence(t, row)
    dense = bits.astype(np.float32)
    dense /= np.sqrt(dense.sum(axis=1, keepdims=True))
    values, vectors = np.linalg.eigh((dense @ dense.T).astype(np.float64))
    good = values > 1e-6 * values[-1]
    root = vectors[:, good] / np.sqrt(values[good])
    model = Model(names, np.packbits(bits, axis=1), root.astype(np.float32), np.zeros((int(good.sum()) + 1, len(names)), np.float32), *usual_grams(texts, langs, names))
    rows, ready = [], model.ready()
    for at in range(0, len(texts), BATCH):
        x = np.zeros((len(texts[at : at + BATCH]), 1 << BITS), np.float32)
        for row, t in zip(x, texts[at : at + BATCH], strict=True):
            mark_presence(t, row)
        rows.append(ready.features(x))
    phi = np.vstack(rows).astype(np.float64)
    y = np.where(np.array(langs)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    n = np.array([langs.count(x) for x in langs], float)  # languages weigh the same
    weighted = phi / n[:, None]
    model.weights = np.linalg.solve(phi.T @ weighted + RIDGE * np.eye(phi.shape[1]), weighted.T @ y).astype(np.float32)
    return model


def train(df: DataFrame, id_col: str, text_col: str, lang_col: str) -> Model | None:
    """The model of a bounded sample of the rows that are not held out."""
    text = F.col(text_col)
    places = F.pmod(F.xxhash64(F.lit(78), text), F.greatest(F.lit(1), F.length(text) - LONGEST + 1)).cast("int")
    window = F.when(F.length(text) <= LONGEST, text).otherwise(F.substring(text, places + 1, F.lit(LONGEST)))
    rows = df.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), window.alias("text")).where(~held_out(F.col("id")) & F.col("lang").isNotNull() & F.rlike("text", F.lit(r"\p{L}")))
    rows = rows.withColumn("draw", F.pmod(F.xxhash64(F.lit(77), F.coalesce(F.col("id").cast("string"), F.lit("")), "text"), F.lit(1 << 30)) / float(1 << 30))
    # a row for each language: its count, and the row that is drawn first
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"), F.min(F.struct("draw", "text")).alias("first")).collect()
    if not counts:
        return None
    each = max(1, SAMPLE // len(counts))
    by = {r["lang"]: {(r["first"]["draw"], r["first"]["text"])} for r in counts}
    share = df.sparkSession.createDataFrame([(r["lang"], min(1.0, 1.5 * each / r["n"])) for r in counts], f"lang {df.schema[lang_col].dataType.simpleString()}, share double")
    place = F.col("draw") / F.col("share")  # even over each language's rows, so that the limit cuts all alike
    picked = rows.join(F.broadcast(share), "lang").where("draw < share").withColumn("place", place)
    for r in picked.orderBy("place", "id").limit(2 * SAMPLE).select("lang", "draw", "text").collect():
        by[r["lang"]].add((r["draw"], r["text"]))
    order = sorted((i, lang, t) for lang, x in by.items() for i, (_, t) in enumerate(sorted(x)[:each]))
    return fit([t for _, _, t in order], [lang for _, lang, _ in order])


def predict(text: Column, model: Model | None, df: DataFrame) -> Column:
    """A struct of lang_pred, score and familiar for each text."""
    if model is None:
        return F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("familiar"))
    shared = df.sparkSession.sparkContext.broadcast(model)  # its size is bound by LANDMARKS and BITS

    @F.arrow_udf("lang_pred string, score double, familiar double")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value.ready()
        x = np.zeros((BATCH, 1 << BITS), np.float32)
        for batch in batches:
            names, scores, familiar = [UNKNOWN] * len(batch), np.zeros(len(batch)), np.zeros(len(batch))
            for first, texts in pieces(batch):
                at = [i for i, t in enumerate(texts) if t and _LETTER.search(t)]
                for s in range(0, len(at), BATCH):
                    own = [first + i for i in at[s : s + BATCH]]
                    x[: len(own)] = 0
                    for row, i in zip(x, at[s : s + BATCH], strict=False):
                        mark_presence(texts[i], row)
                    f = m.score(x[: len(own)])
                    best = f.argmax(axis=1)
                    scores[own] = np.clip((f[np.arange(len(own)), best] + 1) / 2, 0, 1)
                    familiar[own] = m.familiar(x[: len(own)], best)
                    for i, k in zip(own, best.tolist(), strict=True):
                        names[i] = m.model.languages[k]
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores), pa.array(familiar)], ["lang_pred", "score", "familiar"])

    return of(text)


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, held_out, lang_pred, score) for each row."""
    model = train(df, id_col, text_col, lang_col)
    return df.select(F.col(id_col), held_out(F.col(id_col)).alias("held_out"), predict(F.col(text_col), model, df).alias("p")).select(id_col, "held_out", "p.lang_pred", "p.score")


def keep_identified(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float = 0.0, languages: list[str] | None = None, known: bool = False) -> DataFrame:
    """The rows whose language is known, of the score asked for, among ``languages`` if given, and with ``known`` like its training rows."""
    model = train(df, id_col, text_col, lang_col)
    told = df.withColumn("__gm_p", predict(F.col(text_col), model, df))
    stay = (F.col("__gm_p.lang_pred") != UNKNOWN) & (F.col("__gm_p.score") >= least)
    stay = stay & (F.col("__gm_p.familiar") >= 0) if known else stay
    stay = stay & F.col("__gm_p.lang_pred").isin(languages) if languages else stay
    return told.where(stay).drop("__gm_p")
