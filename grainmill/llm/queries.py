"""The queries of this subpackage: each applies its operator to its whole table. ORACLE has DuckDB SQL where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ._shared import spread
from .backoff import scores
from .decontaminate import contaminated
from .exact_content import exact_duplicates
from .language import identify
from .mixing import mix
from .secrets import scan_secrets
from .sentences import remove_repeated_spans
from .simhash import near_duplicates
from .urls import judge_urls
from .warc import archive_round_trip

#: The rules of op5: verdict, host, path.
URL_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_language_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(_table(spark, sf_dir, "documents"))


def op2_mix_sources_poisson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents"), power=0.7, unit="chars", seed=2024)


def op3_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(_table(spark, sf_dir, "documents"))


def op4_exact_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(_table(spark, sf_dir, "documents"), keep="largest")


def op5_url_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(_table(spark, sf_dir, "pages"), URL_RULES)


def op6_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_spans(_table(spark, sf_dir, "documents"))


def op7_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), bits=4, size=4)


def op9_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(_table(spark, sf_dir, "documents"), order=3, least=2)


def op10_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(_table(spark, sf_dir, "pages"), least=0).drop("target_uri")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_language_kernel, op2_mix_sources_poisson, op3_secret_ownership, op4_exact_content_sort, op5_url_trie, op6_sentence_spans, op7_latent_decontamination, op8_simhash_pivots, op9_stupid_backoff, op10_warc_transactions)
}

_PATTERNS = {
    "assign": (r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]{16,}", 0, 16),
    "vendor": (r"gh[opsu]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+|-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 20),
}


def _secret_sql() -> str:
    each = " UNION ALL ".join(
        f"""SELECT doc_id, owner, repo, '{kind}' AS kind, {k} AS k, unnest(range(1, len(m) + 1)) AS i, unnest(m) AS m, unnest(v) AS v, unnest(g[1:len(m)]) AS g
            FROM (SELECT doc_id, owner, repo, regexp_extract_all(t, '{p}', 0) AS m, regexp_extract_all(t, '{p}', {group}) AS v, string_split_regex(t, '{p}') AS g FROM d)"""
        for k, (kind, (p, group, _)) in enumerate((a, (b.replace("'", "''"), c, e)) for a, (b, c, e) in _PATTERNS.items())
    )
    least = " ".join(f"WHEN '{kind}' THEN {n}" for kind, (_, _, n) in _PATTERNS.items())
    return f"""
        WITH d AS (SELECT doc_id, coalesce(source, '') AS repo, split_part(coalesce(source, ''), '/', 1) AS owner, coalesce(text, '') AS t FROM documents),
        m AS ({each}),
        s AS (SELECT *, sum(length(g) + length(m)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS e FROM m),
        f AS (SELECT doc_id, owner, repo, kind, k, CAST(e - length(m) AS BIGINT) AS st, CAST(e AS BIGINT) AS e, sha256(v) AS h, v FROM s WHERE length(v) >= CASE kind {least} END),
        o AS (SELECT h, count(DISTINCT owner) >= 3 OR (count(DISTINCT owner) = 2 AND count(DISTINCT repo) >= 5) AS copied FROM f GROUP BY h),
        j AS (SELECT f.*, copied, kind || ':' || st || ':' || e AS span FROM f JOIN o USING (h)),
        r AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
                     string_agg(span, ',' ORDER BY st, k) FILTER (k < 3) AS base, string_agg(span, ',' ORDER BY st, k) AS spans,
                     count(*) FILTER (NOT copied AND strlen(v) >= 16 AND len(list_distinct(string_split(v, ''))) >= 5 AND ((lower(v) <> v AND upper(v) <> v) OR (v SIMILAR TO '.*[0-9].*' AND lower(v) <> upper(v)))) AS n_live, count(*) FILTER (copied) AS n_copied
              FROM j WHERE k < 3 OR NOT copied GROUP BY doc_id)
        SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
               coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied
        FROM documents LEFT JOIN r USING (doc_id)"""


_HOST = r"(?s)^.*?://([^/?#]*)"
_PATH = r"(?s)^.*?://[^/?#]*([^?#]*)"
_RULES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES)

ORACLE: dict[str, str] = {
    "op2_mix_sources_poisson": """
        WITH m AS (SELECT source, sum(length(coalesce(text, '')))::DOUBLE AS mass FROM documents GROUP BY source),
        r AS (SELECT source, CASE WHEN mass > 0 THEN pow(mass, 0.7) / sum(pow(mass, 0.7)) OVER () * sum(mass) OVER () / mass ELSE 0 END AS rate FROM m),
        p AS (SELECT source, k, exp(-rate + CASE WHEN k = 0 THEN 0 ELSE k * ln(rate) END - lgamma(k + 1)) AS p FROM r, range(0, 200) t(k) WHERE k <= ceil(rate + 9 * sqrt(rate) + 20) AND rate > 0),
        c AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS cdf FROM p),
        u AS (SELECT *, ('0x' || substr(md5('2024|' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496 AS u FROM documents),
        n AS (SELECT u.doc_id, u.source, count(*) AS n FROM u JOIN c ON u.source IS NOT DISTINCT FROM c.source AND c.cdf <= u.u GROUP BY ALL)
        SELECT d.*, unnest(range(0, n)) AS copy FROM documents d JOIN n ON d.doc_id = n.doc_id AND d.source IS NOT DISTINCT FROM n.source""",
    "op3_secret_ownership": _secret_sql(),
    "op4_exact_content_sort": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    "op5_url_trie": f"""
        WITH p AS (SELECT page_id, coalesce(translate(regexp_extract(url, '{_HOST}', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                          coalesce(regexp_extract(url, '{_PATH}', 1), '') AS path FROM pages),
        r AS (SELECT * FROM (VALUES {_RULES}) r(v, h, s)),
        b AS (SELECT page_id, arg_max({{'rule': h || s, 'verdict': v}}, len(h) * 1000 + len(s)) AS b
              FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, s) GROUP BY page_id)
        SELECT page_id, host, path, b.rule AS rule, coalesce(b.verdict, 'allow') AS verdict FROM p LEFT JOIN b USING (page_id)""",
    "op10_warc_transactions": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS d FROM pages),
        q AS (SELECT *, min(page_id) OVER (PARTITION BY t) AS first FROM p)
        SELECT page_id, strlen(t) AS payload_bytes,
               array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((('0x' || substr(d, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31 AS BIGINT) + 1, 1) FOR i IN range(32)], '') AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
        FROM q""",
}
