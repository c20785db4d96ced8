"""Secret scans with corpus-wide ownership frequency, with DataFrame functions only.

One pass over the texts finds candidates by pattern and keeps, for each, the gap to the match before, its length and a
SHA-256 of its value, never the value or the text. Positions are running sums of gaps and lengths. Values are then
aggregated by the number of distinct repositories and owners that hold them: those that many owners share (or two in many
repositories) are copied examples; one owner's, in however many repositories, that is long and mixed looks live: its value has
``LONG`` characters, ``DISTINCT`` different ones and two of small letters, capitals and digits. The verdicts return to the spans
by an equi-join on the hash, whose skewed side Spark may split.

Base kinds (assign, access, hex) are always reported. The vendor kind (tokens and private keys of well-known forms) is
added where ownership does not show it to be a copied example.

Defined results: a null text counts as empty, very long ones are scanned whole; null ids and repeated rows are rows like others;
spans that begin at the same place come in the order of their kinds; a null repository is one repository; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import written

#: Fixed patterns: name, pattern, group of the value, least length of the value (or of the match, for group 0).
KINDS = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
    ("vendor", r"gh[opsu]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+|-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 20),
)
BASE = 3
LONG, DISTINCT = 16, 5


def _matches(text: Column, pattern: str, group: int, least: int) -> Column:
    """An array of (gap, len, ok, h): the text between matches by ``split``, the matches by ``regexp_extract_all``."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    gaps = F.split(text, pattern, -1)
    empty = F.expr("CAST(array() AS array<struct<gap: bigint, len: bigint, ok: boolean, strong: boolean, h: string>>)")
    rows = F.transform(
        F.arrays_zip(found.alias("m"), values.alias("v"), F.slice(gaps, F.lit(1), F.size(found)).alias("g")),
        lambda x: F.struct(F.length(x["g"]).cast("bigint").alias("gap"), F.length(x["m"]).cast("bigint").alias("len"), (F.length(x["v"]) >= least).alias("ok"), _strong(x["v"]).alias("strong"), F.sha2(x["v"].cast("binary"), 256).alias("h")),
    )
    # the cheap test keeps most texts from the work above
    return F.when(F.rlike(text, F.lit(pattern)), rows).otherwise(empty)


def _strong(value: Column) -> Column:
    """Whether a value is long and mixed."""
    classes = sum((F.rlike(value, F.lit(c)).cast("int") for c in ("[a-z]", "[A-Z]", "[0-9]")), F.lit(0))
    return (F.length(value) >= LONG) & (classes >= 2) & (F.size(F.array_distinct(F.split(value, ""))) >= DISTINCT)


def owner_of(repository: Column) -> Column:
    """``owner`` of ``owner/name``; a name without a slash is its own owner."""
    return F.substring_index(repository, "/", 1)


def ownership(spans: DataFrame, least_owners: int, least_repositories: int) -> DataFrame:
    """(h, owners, repositories, verdict): distinct counts are taken in two steps, so one value may be in any number of rows."""
    of = spans.groupBy("h").agg(F.countDistinct("owner").alias("owners"), F.countDistinct("repo").alias("repositories"))
    return of.withColumn("copied", (F.col("owners") >= least_owners) | ((F.col("owners") > 1) & (F.col("repositories") >= least_repositories)))


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "source", owner: Column | None = None, least_owners: int = 3, least_repositories: int = 5) -> DataFrame:
    """A row for each document: counts and digest of the base spans, all spans, and how many look live or copied."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    repo = F.coalesce(F.col(repo_col).cast("string"), F.lit(""))
    found = F.array(*[F.struct(F.lit(k).alias("kind"), _matches(text, pattern, group, least).alias("m")) for k, (_, pattern, group, least) in enumerate(KINDS)])
    found = F.flatten(F.transform(found, lambda x: F.transform(x["m"], lambda m, i: F.struct(x["kind"].alias("kind"), i.alias("no"), m["gap"].alias("gap"), m["len"].alias("len"), m["ok"].alias("ok"), m["strong"].alias("strong"), m["h"].alias("h")))))
    docs = df.select(F.col(id_col).alias("id"), repo.alias("repo"), F.coalesce(owner if owner is not None else owner_of(repo), F.lit("")).alias("owner"), found.alias("found"))
    docs = written(docs.withColumn("row", F.monotonically_increasing_id()), "candidates")

    along = Window.partitionBy("row", "kind").orderBy("no")
    spans = docs.where("size(found) > 0").select("row", "id", "repo", "owner", F.inline("found"))
    spans = spans.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(along)).withColumn("start", F.col("end") - F.col("len")).where("ok")
    spans = written(spans.select("row", "id", "repo", "owner", "kind", "start", "end", "strong", "h"), "spans")

    # written, so that both sides of the join are plain shuffles, whose skewed parts (a value in many documents) Spark may split
    known = written(ownership(spans, least_owners, least_repositories), "owners")
    judged = spans.join(known, "h").withColumn("live", ~F.col("copied") & F.col("strong"))
    span = F.struct("start", "kind", F.concat_ws(":", F.element_at(F.array(*[F.lit(k[0]) for k in KINDS]), F.col("kind") + 1), "start", "end").alias("at"), "live", "copied")
    each = judged.where((F.col("kind") < BASE) | ~F.col("copied")).groupBy("row").agg(F.sort_array(F.collect_list(span)).alias("s"))

    out = docs.select("row", "id").join(each, "row", "left").withColumn("s", F.coalesce("s", F.expr("CAST(array() AS array<struct<start: bigint, kind: int, at: string, live: boolean, copied: boolean>>)")))
    base = F.filter("s", lambda x: x["kind"] < BASE)
    joined = lambda x: F.array_join(F.transform(x, lambda s: s["at"]), ",")
    count = lambda test: F.size(F.filter("s", test)).cast("bigint")
    of_kind = lambda k: count(lambda x: x["kind"] == k)
    return out.select(
        F.col("id").alias(id_col),
        *[of_kind(k).alias(f"n_{KINDS[k][0]}") for k in range(BASE)],
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("s")).alias("spans"),
        count(lambda x: x["live"]).alias("n_live"),
        count(lambda x: x["copied"]).alias("n_copied"),
    )
