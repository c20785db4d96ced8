"""DuckDB SQL for the queries of the same names, written independently over the raw tables."""

from __future__ import annotations

from ..operators.near import permutations

_W = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _norm(c: str = "text") -> str:
    return f"lower(trim(regexp_replace({c}, '{_W}', ' ', 'g')))"


_N = f"n AS (SELECT *, {_norm()} AS t FROM documents)"
_WORDS = "CASE WHEN t = '' THEN CAST([] AS VARCHAR[]) ELSE string_split(t, ' ') END"
_D = f"{_N}, d AS (SELECT *, {_WORDS} AS w FROM n)"


def _cut(size: int, stride: int, least: int, full: bool = False, chars: bool = False) -> str:
    w = "CASE WHEN t = '' THEN CAST([] AS VARCHAR[]) ELSE string_split(t, '') END" if chars else _WORDS
    return f"""{_N}, d AS (SELECT *, {w} AS w FROM n),
        c0 AS (SELECT doc_id, source, CAST(i // {stride} AS INTEGER) AS position, w[i + 1 : i + {size}] AS tokens FROM d, unnest(range(0, len(w), {stride})) u(i)),
        c AS (SELECT format('train-doc{{:05d}}-chunk{{:04d}}', doc_id, position) AS chunk_id, doc_id, source, position, tokens,
                     array_to_string(tokens, '{"" if chars else " "}') AS text, CAST(len(tokens) AS INTEGER) AS length
              FROM c0 WHERE len(tokens) >= {size if full else least})"""


_C = _cut(128, 128, 32)
_SIGNED = "CAST(CASE WHEN h >= 9223372036854775808 THEN h - 18446744073709551616 ELSE h END AS BIGINT)"


def _hash64(c: str) -> str:
    return f"CAST(CAST('0x' || substr(sha1({c}), 1, 16) AS UBIGINT) AS HUGEINT)"


_S = f"""{_C}, s AS (SELECT *, row_number() OVER (ORDER BY doc_id, position) - 1 AS k FROM c),
    sh AS (SELECT *, k // 100 AS shard_id, k % 100 AS local_index, sha1(text) AS key FROM s),
    dr AS (SELECT shard_id, local_index FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY k) AS r FROM sh) WHERE r > 1)"""

_GRAMS = "CASE WHEN len(w) >= 5 THEN list_distinct([array_to_string(w[i : i + 4], ' ') FOR i IN range(1, len(w) - 3)]) ELSE {short} END"
_SETS = f"sets AS (SELECT doc_id, len(w) AS words, unnest({_GRAMS.format(short='list_distinct(w)')}) AS g FROM u)"
_FIRST = f"{_D}, u AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY t ORDER BY doc_id) = 1)"
_JACCARD = """sz AS (SELECT doc_id, any_value(words) AS words, count(*) AS k FROM sets GROUP BY doc_id),
    sh2 AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM sets a JOIN sets b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
    p AS (SELECT a, b, shared / (x.k + y.k - shared) AS jaccard, x.words AS len_a, y.words AS len_b FROM sh2 JOIN sz x ON x.doc_id = a JOIN sz y ON y.doc_id = b WHERE shared / (x.k + y.k - shared) >= 0.7)"""
_LONGER = "CASE WHEN len_b > len_a THEN a ELSE b END"

#: One row of a signature. The product wraps at 64 bits, by a mask, as remainders of 128-bit numbers are slow.
_ROW = "((a::HUGEINT * v + b::HUGEINT) & 18446744073709551615::HUGEINT)::UBIGINT % 2305843009213693951::UBIGINT"
_A, _B = permutations(128, 17)
_PERMS = ", ".join(f"({i}, {a}::UBIGINT, {b}::UBIGINT)" for i, (a, b) in enumerate(zip(_A.tolist(), _B.tolist(), strict=True)))
_SIG = f"""{_SETS}, pm(i, a, b) AS (VALUES {_PERMS}),
    hs AS (SELECT doc_id, {_hash64('g')} & 2305843009213693951 AS v FROM sets),
    mh AS (SELECT doc_id, i, CAST(min({_ROW}) AS BIGINT) AS m FROM hs, pm GROUP BY doc_id, i)"""
_BANDS = "bk AS (SELECT doc_id, CAST(i // 4 AS BIGINT) AS band, string_agg(m, ',' ORDER BY i) AS rows FROM mh GROUP BY ALL)"
_CAND = "cp AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM bk x JOIN bk y ON x.band = y.band AND x.rows = y.rows AND x.doc_id < y.doc_id)"

_BUCKET = "CAST('0x' || substr(sha1(CAST(doc_id AS VARCHAR)), 1, 7) AS BIGINT) % 10"
_SPLIT = f"CASE WHEN {_BUCKET} < 8 THEN 'train' WHEN {_BUCKET} = 8 THEN 'val' ELSE 'test' END"
_DS = f"n AS (SELECT *, {_SPLIT} AS split, {_norm()} AS t FROM documents), d AS (SELECT *, {_WORDS} AS w FROM n)"


def _like(left: str, right: str) -> str:
    """doc_id of rows of one relation that are like a row of the other (t, w), by brute force."""
    side = lambda r: f"(SELECT doc_id, len(gs) AS k, unnest(gs) AS g FROM (SELECT doc_id, {_GRAMS.format(short='list_distinct(w)')} AS gs FROM {r}))"
    return f"""SELECT DISTINCT a FROM (
        SELECT x.doc_id AS a, x.k AS ka, y.k AS kb, count(*) AS shared FROM {side(left)} x JOIN {side(right)} y USING (g)
        GROUP BY x.doc_id, x.k, y.doc_id, y.k) WHERE shared / (ka + kb - shared) >= 0.7"""


_CURVES = "(VALUES ('base', 3e9, 50.0), ('base', 6e9, 40.0), ('base', 9e9, 36.0), ('other', 3e9, 48.0), ('other', 6e9, 38.0), ('other', 9e9, 38.0)) c(curve, tokens, metric)"
_CROSS = f"""g AS (SELECT curve, tokens, metric, lead(tokens) OVER w AS t1, lead(metric) OVER w AS m1 FROM {_CURVES} WINDOW w AS (PARTITION BY curve ORDER BY tokens)),
    x AS (SELECT curve, target, arg_min(CASE WHEN metric = m1 THEN tokens ELSE tokens + (target - metric) / (m1 - metric) * (t1 - tokens) END, tokens) AS tokens
          FROM g, (VALUES (45.0::DOUBLE), (40.0), (38.0)) t(target) WHERE t1 IS NOT NULL AND ((metric >= target AND m1 <= target) OR (metric <= target AND m1 >= target)) GROUP BY ALL)"""
_MANIFEST = f"""{_N}, m AS (SELECT 'doc:' || doc_id AS id, sha1(t) AS hash, row_number() OVER (PARTITION BY t ORDER BY doc_id) = 1 AS kept FROM n)"""
_TRIM = rf"^{_W}|{_W}$"
_OPTIONS = "o AS (SELECT event_id // 4 AS item, event_id % 4 AS option, CAST(floor(value) AS BIGINT) AS score FROM events), b AS (SELECT item, arg_max(option, (score, -option)) AS pred FROM o GROUP BY item)"

_RANK = "row_number() OVER (ORDER BY sha1({key}), doc_id) - 1"


def _manifest_near() -> str:
    """Chunks of equal or similar signatures of character shingles; of two different texts the later one goes."""
    a, b = permutations(128, 1337)
    perms = ", ".join(f"({i}, {x}::UBIGINT, {y}::UBIGINT)" for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)))
    return f"""WITH {_cut(128, 128, 32, full=True)}, r AS (SELECT *, row_number() OVER (ORDER BY doc_id, position) AS k, min((doc_id, position)) OVER (PARTITION BY text) = (doc_id, position) AS first FROM c),
        g AS (SELECT k, unnest(list_distinct([substr(text, i + 1, 32) FOR i IN range(0, length(text) - 32, 4)])) AS g FROM r),
        h AS (SELECT k, {_hash64('g')} AS v FROM g), pm(i, a, b) AS (VALUES {perms}),
        mh AS (SELECT k, i, min({_ROW}) AS m FROM h, pm GROUP BY k, i),
        al AS (SELECT r.k, pm.i, coalesce(m, 2305843009213693951) AS m FROM r CROSS JOIN pm LEFT JOIN mh ON mh.k = r.k AND mh.i = pm.i),
        bk AS (SELECT k, i // 32 AS band, string_agg(m, ',' ORDER BY i) AS rows FROM al GROUP BY ALL),
        cp AS (SELECT DISTINCT x.k AS a, y.k AS b FROM bk x JOIN bk y ON x.band = y.band AND x.rows = y.rows AND x.k < y.k),
        ok AS (SELECT cp.a, cp.b FROM cp JOIN r x ON x.k = cp.a JOIN r y ON y.k = cp.b JOIN al p ON p.k = cp.a JOIN al q ON q.k = cp.b AND q.i = p.i WHERE x.text <> y.text GROUP BY cp.a, cp.b HAVING count(*) FILTER (p.m = q.m) / 128 >= 0.85),
        gone AS (SELECT DISTINCT text FROM r JOIN ok ON ok.b = r.k)
        SELECT 'chunk:' || doc_id || ':' || position AS id, first AND text NOT IN (SELECT text FROM gone) AS kept,
               CASE WHEN NOT first THEN 'duplicate' WHEN text IN (SELECT text FROM gone) THEN 'near_duplicate' END AS reason FROM r"""


def _recipe() -> str:
    """Recipe counts: exact copies within a split, near copies by brute force, then what validation and test share with training."""
    gram = "CASE WHEN len(tokens) >= 5 THEN list_distinct([array_to_string(tokens[i : i + 4], ' ') FOR i IN range(1, len(tokens) - 3)]) ELSE list_distinct(tokens) END"
    body = _C.replace("c AS (SELECT format", "c AS (SELECT format").replace("FROM documents)", f"FROM documents), sp AS (SELECT doc_id, {_SPLIT} AS split FROM documents)", 1)
    return f"""WITH {body},
        a AS (SELECT c.*, split, {gram} AS gs, row_number() OVER (PARTITION BY split, text ORDER BY doc_id, position) AS r, row_number() OVER (ORDER BY doc_id, position) AS k FROM c JOIN sp USING (doc_id)),
        g AS (SELECT k, split, text, length, len(gs) AS n, unnest(gs) AS g FROM a),
        hot AS (SELECT g FROM g GROUP BY g HAVING count(*) > 1),
        gg AS (SELECT * FROM g SEMI JOIN hot USING (g)),
        p AS (SELECT x.k AS a, y.k AS b, x.split AS sa, y.split AS sb, x.length AS la, y.length AS lb, x.text = y.text AS same FROM gg x JOIN gg y ON x.g = y.g AND x.k <> y.k
              GROUP BY x.k, y.k, x.split, y.split, x.length, y.length, x.n, y.n, x.text = y.text HAVING count(*) / (x.n + y.n - count(*)) >= 0.7),
        ex AS (SELECT k FROM a WHERE r = 1),
        lose AS (SELECT DISTINCT CASE WHEN lb > la THEN a ELSE b END AS k FROM p SEMI JOIN ex ON p.a = ex.k WHERE a < b AND sa = sb AND b IN (SELECT k FROM ex)),
        kept AS (SELECT 'no_dedup' AS run, k FROM a UNION ALL SELECT 'exact', k FROM ex UNION ALL SELECT 'near', k FROM ex ANTI JOIN lose USING (k)),
        rows AS (SELECT run, a.* FROM kept JOIN a USING (k)),
        bad AS (SELECT DISTINCT x.run, x.k FROM rows x JOIN p ON p.a = x.k JOIN rows y ON y.run = x.run AND y.k = p.b WHERE x.split = 'train' AND y.split <> 'train'),
        fin AS (SELECT * FROM rows ANTI JOIN bad USING (run, k))
        SELECT run, count(*) FILTER (split = 'train') AS train_chunks, coalesce(CAST(sum(length) FILTER (split = 'train') AS BIGINT), 0) AS train_tokens, count(*) FILTER (split = 'val') AS val_chunks, count(*) FILTER (split = 'test') AS test_chunks,
               CASE WHEN run = 'no_dedup' THEN (SELECT count(*) FROM a WHERE split = 'train') ELSE (SELECT count(*) FROM a WHERE split = 'train' AND r = 1) END AS exact_chunks
        FROM fin GROUP BY run"""


ORACLE: dict[str, str] = {
    "normalize_simple": f"SELECT doc_id, {_norm()} AS norm FROM documents WHERE text <> ''",
    "text_fallback": f"""WITH a AS (SELECT doc_id AS id, CASE WHEN doc_id % 7 = 0 THEN '' ELSE text END AS text, CASE WHEN doc_id % 14 = 0 THEN '  ' ELSE source END AS raw, lang AS other FROM documents
        UNION ALL SELECT page_id, NULL, html, url FROM pages)
        SELECT id, coalesce(nullif(text, ''), CASE WHEN trim(regexp_replace(raw, '{_W}', ' ', 'g')) <> '' THEN raw END, other) AS chosen FROM a""",
    "exact_hash61": f"SELECT doc_id, CAST({_hash64('text')} & 2305843009213693951 AS BIGINT) AS key FROM documents",
    "exact_hash64": f"SELECT doc_id, {_SIGNED} AS key FROM (SELECT doc_id, {_hash64('text')} AS h FROM documents)",
    "word_shingles": f"WITH {_D}, s AS (SELECT doc_id, {_GRAMS.format(short='CAST([] AS VARCHAR[])')} AS g FROM d) SELECT doc_id, len(g) AS n, array_to_string(list_sort([sha1(x) FOR x IN g]), ',') AS shingles FROM s",
    "word_shingles_fallback": f"WITH n AS (SELECT *, {_norm()} AS t FROM conversations), d AS (SELECT *, {_WORDS} AS w FROM n), s AS (SELECT conv_id, turn, {_GRAMS.format(short='list_distinct(w)')} AS g FROM d) SELECT conv_id, turn, len(g) AS n, array_to_string(list_sort(g), ',') AS shingles FROM s",
    "char_shingles": f"WITH {_N}, s AS (SELECT doc_id, list_distinct([substr(t, i + 1, 32) FOR i IN range(0, length(t) - 32, 4)]) AS g FROM n) SELECT doc_id, len(g) AS n, array_to_string(list_sort([sha1(x) FOR x IN g]), ',') AS shingles FROM s",
    "canary_prefixes": "SELECT page_id, split_part(url, ':', 1) || ':' AS prefix FROM pages",
    "lambada_split": f"WITH c AS (SELECT conv_id, turn, regexp_replace(text, '{_TRIM}', '', 'g') AS t FROM conversations) SELECT conv_id, turn, regexp_extract(t, '(?s)^(.*) ([^ ]*)$', 1) AS context, regexp_extract(t, '(?s)^(.*) ([^ ]*)$', 2) AS target FROM c WHERE contains(t, ' ')",
    "piqa_parse": f"SELECT conv_id, turn, regexp_replace(text, '{_TRIM}', '', 'g') AS goal, role AS sol1, 'b' AS sol2, CAST(conv_id % 2 AS INTEGER) AS label FROM conversations WHERE turn % 3 = 0",
    "option_prompts": "SELECT conv_id, turn, trim(role || ' ' || text) AS prompt FROM conversations",
    "cosine_lr": "SELECT step, round(CASE WHEN step < 30 THEN 0.0003::DOUBLE * (step + 1) / 30 ELSE 0.00015::DOUBLE * (1 + cos(pi() * least(1.0::DOUBLE, (step - 30) / 270.0::DOUBLE))) END, 12) AS lr FROM range(0, 400) t(step)",
    "chunk_words_keep_tail": f"WITH {_C} SELECT chunk_id, doc_id, position, text, length FROM c",
    "chunk_overlap_stride": f"WITH {_cut(128, 96, 1)} SELECT chunk_id, doc_id, position, text, length FROM c",
    "chunk_full_only": f"WITH {_cut(128, 128, 0, full=True)} SELECT chunk_id, doc_id, position, text, length FROM c",
    "chunk_chars": f"WITH {_cut(512, 512, 64, chars=True)} SELECT chunk_id, doc_id, position, text, length FROM c",
    "chunk_stats": f"WITH {_C} SELECT count(*) AS n_chunks, round(coalesce(avg(length), 0), 9) AS avg_length, CAST(coalesce(sum(length), 0) AS BIGINT) AS total_tokens FROM c",
    "shard_assignment": f"WITH {_S}, z AS (SELECT *, {_hash64('text')} AS h FROM sh) SELECT chunk_id, shard_id, local_index, length, {_SIGNED} AS exact_hash FROM z",
    "shard_manifest": f"WITH {_S} SELECT shard_id, count(*) AS chunk_count, CAST(sum(length) AS BIGINT) AS token_count FROM sh GROUP BY shard_id",
    "shard_merge_remap": f"WITH {_S} SELECT chunk_id, source AS worker, shard_id, dense_rank() OVER (ORDER BY source, shard_id) - 1 AS new_shard_id FROM sh",
    "apply_drop_list": f"WITH {_S} SELECT chunk_id, array_to_string(tokens[1:64], ' ') AS block FROM sh ANTI JOIN dr USING (shard_id, local_index) WHERE length >= 64",
    "block_filter": f"WITH {_S} SELECT chunk_id, CAST(100 AS BIGINT) AS n_tokens FROM sh WHERE length >= 100",
    "doc_exact_manifest": f"WITH {_MANIFEST} SELECT id, hash, kept, CASE WHEN NOT kept THEN 'duplicate' END AS reason FROM m",
    "chunk_exact_manifest": f"WITH {_cut(128, 128, 32, full=True)}, m AS (SELECT 'chunk:' || doc_id || ':' || position AS id, sha1(text) AS hash, row_number() OVER (PARTITION BY text ORDER BY doc_id, position) = 1 AS kept FROM c) SELECT id, hash, kept, CASE WHEN NOT kept THEN 'duplicate' END AS reason FROM m",
    "exact_keep_first": f"WITH {_C} SELECT chunk_id, length FROM c QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id, position) = 1",
    "exact_drop_list": f"WITH {_S} SELECT shard_id, local_index FROM dr",
    "exact_dup_counts": f"WITH {_N}, g AS (SELECT count(*) AS k FROM n GROUP BY t) SELECT count(*) FILTER (k > 1) AS repeated_keys, CAST(sum(k - 1) AS BIGINT) AS duplicates, CAST(sum(k) AS BIGINT) AS n_rows FROM g",
    "minhash_signature": f"WITH {_D}, u AS (SELECT * FROM d), {_SIG} SELECT doc_id, string_agg(m, ',' ORDER BY i) AS signature FROM mh GROUP BY doc_id",
    "band_keys": f"WITH {_FIRST}, {_SIG}, {_BANDS} SELECT doc_id, band, rows FROM bk",
    "lsh_candidates": f"WITH {_FIRST}, {_SIG}, {_BANDS}, {_CAND} SELECT a, b FROM cp",
    "profile_lsh": f"WITH {_FIRST}, {_SIG}, {_BANDS}, {_CAND} SELECT (SELECT count(*) FROM bk) AS bucket_ops, (SELECT count(*) FROM cp) AS candidates",
    "profile_near": f"WITH {_FIRST}, {_SIG}, {_BANDS}, {_CAND}, {_JACCARD} SELECT (SELECT count(*) FROM bk) AS bucket_ops, (SELECT count(*) FROM cp) AS candidates, (SELECT count(DISTINCT b) FROM p SEMI JOIN cp USING (a, b)) AS drops",
    "near_dedup_manifest": _manifest_near(),
    "jaccard_pairs": f"WITH {_FIRST}, {_SETS}, {_JACCARD} SELECT a, b, round(jaccard, 9) AS jaccard FROM p",
    "near_dedup_mem": f"WITH {_FIRST}, {_SETS}, {_JACCARD} SELECT doc_id FROM u WHERE doc_id NOT IN (SELECT {_LONGER} FROM p)",
    "near_dedup_fast": f"WITH {_FIRST}, {_SETS}, {_JACCARD} SELECT DISTINCT {_LONGER} AS doc_id FROM p",
    "near_dedup_skip_short": f"WITH {_FIRST}, {_SETS}, {_JACCARD} SELECT DISTINCT {_LONGER} AS doc_id FROM p WHERE len_a >= 120 AND len_b >= 120",
    "near_dedup_disk": f"WITH {_D}, u AS (SELECT * FROM d), sets AS (SELECT doc_id, len(w) AS words, unnest({_GRAMS.format(short='CAST([] AS VARCHAR[])')}) AS g FROM u), {_JACCARD} SELECT b AS doc_id FROM p UNION SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY t ORDER BY doc_id) AS r FROM n) WHERE r > 1",
    "cross_split_exact": f"WITH {_DS} SELECT doc_id FROM n WHERE split = 'train' AND t IN (SELECT t FROM n WHERE split = 'val')",
    "cross_split_near": f"WITH {_DS}, tr AS (SELECT * FROM d WHERE split = 'train'), va AS (SELECT * FROM d WHERE split = 'val') SELECT a AS doc_id FROM ({_like('tr', 'va')})",
    "cross_split_sequential": f"WITH {_DS}, tr AS (SELECT * FROM d WHERE split = 'train'), ev AS (SELECT * FROM d WHERE split <> 'train') SELECT doc_id FROM tr WHERE t NOT IN (SELECT t FROM ev) AND doc_id NOT IN (SELECT a FROM ({_like('tr', 'ev')}))",
    "benchmark_overlap": f"WITH {_N}, b AS (SELECT item_id, {_norm()} AS t FROM benchmark) SELECT sha1(t) AS hash FROM b WHERE EXISTS (SELECT 1 FROM n WHERE contains(' ' || n.t || ' ', ' ' || b.t || ' '))",
    "drop_hash_files": f"WITH {_DS} SELECT split, sha1(t) AS hash FROM n WHERE split <> 'train' AND t IN (SELECT t FROM n WHERE split = 'train')",
    "cross_drop_list": f"WITH {_DS} SELECT sha1(t) AS hash FROM n WHERE split <> 'train' AND t IN (SELECT t FROM n WHERE split = 'train')",
    "split_fractions": f"""WITH r AS (SELECT doc_id, {_RANK.format(key='CAST(doc_id AS VARCHAR)')} AS r, count(*) OVER () AS n FROM documents)
        SELECT doc_id, CASE WHEN r < greatest(1, floor(n * 0.9::DOUBLE)) THEN 'train' WHEN r < greatest(1, floor(n * 0.9::DOUBLE)) + greatest(1, floor(n * 0.05::DOUBLE)) THEN 'val' ELSE 'test' END AS split FROM r""",
    "stratified_split": """WITH r AS (SELECT doc_id, row_number() OVER (PARTITION BY lang, source ORDER BY sha1(CAST(doc_id AS VARCHAR)), doc_id) - 1 AS r, CAST(count(*) OVER (PARTITION BY lang, source) AS DOUBLE) AS n FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL),
        q AS (SELECT *, greatest(1, round_even(n * 0.8::DOUBLE, 0)) AS a0, greatest(1, round_even(n * 0.1::DOUBLE, 0)) AS b0 FROM r),
        z AS (SELECT *, CASE WHEN a0 + b0 >= n THEN greatest(1, n - 2) ELSE a0 END AS a1, CASE WHEN a0 + b0 >= n THEN 1 ELSE b0 END AS b FROM q),
        y AS (SELECT *, CASE WHEN n - a1 - b <= 0 AND a1 > 1 THEN a1 - 1 ELSE a1 END AS a FROM z)
        SELECT doc_id, CASE WHEN r < a THEN 'train' WHEN r < a + b THEN 'val' ELSE 'test' END AS split FROM y""",
    "canary_insert": f"WITH {_C} SELECT false AS canary, count(*) AS n, CAST(sum(length) AS BIGINT) AS total FROM c UNION ALL SELECT true, 20, 20",
    "canary_recall": "WITH g AS (SELECT contains('x ' || lang || ' ' || CASE WHEN doc_id % 3 = 0 THEN source ELSE '?' END, lang || ' ' || source) AS hit FROM documents) SELECT count(*) FILTER (hit) AS hits, round(count(*) FILTER (hit) / greatest(1, count(*)), 9) AS recall FROM g",
    "token_pack": f"WITH {_C}, o AS (SELECT chunk_id, length + 1 AS n, coalesce(sum(length + 1) OVER (ORDER BY doc_id, position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM c) SELECT chunk_id, CAST(s AS BIGINT) AS token_offset, CAST(least(n, 100000 - s) AS BIGINT) AS take FROM o WHERE s < 100000",
    "eval_windows": f"WITH n AS (SELECT *, {_norm()} AS t FROM benchmark), d AS (SELECT *, {_WORDS} AS w FROM n) SELECT item_id, i, array_to_string(w[i + 1 : i + 32], ' ') AS x, array_to_string(w[i + 2 : i + 33], ' ') AS y FROM d, unnest(range(0, len(w) - 33)) u(i)",
    "perplexity": "SELECT event_type, round(exp(sum(value / 100 * (1 + user_id % 50)) / sum(1 + user_id % 50)), 6) AS perplexity FROM events GROUP BY event_type",
    "option_argmax": f"WITH {_OPTIONS} SELECT item, pred FROM b",
    "option_accuracy": f"WITH {_OPTIONS} SELECT round(count(*) FILTER (pred = item % 4) / count(*), 9) AS accuracy, count(*) AS n_items FROM b",
    "mean_ci": "SELECT event_type, round(avg(value), 8) AS mean, round(1.96::DOUBLE * stddev_samp(value) / sqrt(count(value)), 8) AS ci, count(value) AS n FROM events GROUP BY event_type",
    "stage_stats": "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS stddev, round(min(value), 6) AS min, round(max(value), 6) AS max, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type",
    "percentiles": "SELECT event_type, quantile_disc(value, 0.5) AS value, 0.5::DOUBLE AS p FROM events GROUP BY event_type UNION ALL SELECT event_type, quantile_disc(value, 0.9), 0.9 FROM events GROUP BY event_type UNION ALL SELECT event_type, quantile_disc(value, 0.99), 0.99 FROM events GROUP BY event_type",
    "run_summary": "SELECT 'run' || user_id % 5 AS run, arg_max(value, event_id) AS value, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1",
    "curve_interpolation": f"WITH {_CROSS} SELECT curve, target, round(tokens, 3) AS tokens FROM x",
    "data_equivalent_factor": f"WITH {_CROSS} SELECT round(a.tokens / b.tokens, 9) AS factor FROM x a, x b WHERE a.curve = 'base' AND b.curve = 'other' AND a.target = 40 AND b.target = 40",
    "directory_analysis": "SELECT CASE WHEN event_id % 2 = 1 THEN 'odd' ELSE 'even' END AS directory, round(avg(value), 8) AS mean, round(1.96::DOUBLE * stddev_samp(value) / sqrt(count(value)), 8) AS ci, count(value) AS n FROM events GROUP BY 1",
    "epochs": "SELECT conv_id, turn, epoch, sha1('0|' || epoch || '|' || conv_id || '|' || turn) AS place FROM conversations, range(3) t(epoch)",
    "hash_shuffle": "SELECT doc_id, row_number() OVER (ORDER BY sha1('13|' || doc_id), doc_id) - 1 AS rank FROM documents",
    "reservoir_sample": "SELECT event_id, value FROM events ORDER BY sha1(CAST(event_id AS VARCHAR)), event_id LIMIT 200",
    "random_k": "SELECT doc_id FROM documents ORDER BY sha1('3|' || doc_id), doc_id LIMIT 50",
    "batching": f"WITH r AS (SELECT doc_id, {_RANK.format(key='CAST(doc_id AS VARCHAR)')} AS r FROM documents) SELECT r // 64 AS batch, string_agg(doc_id, ',' ORDER BY r) AS items FROM r GROUP BY 1",
    "top_examples": "SELECT doc_id, lang FROM documents WHERE contains(text, 'the') ORDER BY doc_id LIMIT 5",
    "scan_documents": "SELECT doc_id, length(text) AS n FROM documents WHERE text <> ''",
    "scan_streamed": "SELECT lang, count(*) AS n FROM documents WHERE text <> '' GROUP BY lang",
    "jsonl_round_trip": "SELECT CAST(doc_id AS VARCHAR) AS id, sha1(text) AS digest FROM documents",
    "drop_list_round_trip": f"WITH {_S} SELECT shard_id, local_index FROM dr",
    "manifest_round_trip": f"WITH {_N} SELECT DISTINCT sha1(t) AS hash FROM n",
    "manifest_lines": f"""WITH {_MANIFEST} SELECT id, '{{"id":"' || id || '","hash":"' || hash || '","kept":' || kept || CASE WHEN kept THEN '' ELSE ',"reason":"duplicate"' END || '}}' AS line FROM m""",
    "shard_round_trip": f"WITH {_S} SELECT shard_id, count(*) AS n, CAST(sum(length) AS BIGINT) AS total FROM sh GROUP BY shard_id",
    "summary_round_trip": "SELECT 'run' || user_id % 5 AS run, arg_max(value, event_id) AS value FROM events GROUP BY 1",
    "split_lists": f"""WITH r AS (SELECT doc_id, {_RANK.format(key='CAST(doc_id AS VARCHAR)')} AS r, count(*) OVER () AS n FROM documents),
        s AS (SELECT doc_id, CASE WHEN r < greatest(1, floor(n * 0.9::DOUBLE)) THEN 'train' WHEN r < greatest(1, floor(n * 0.9::DOUBLE)) + greatest(1, floor(n * 0.05::DOUBLE)) THEN 'val' ELSE 'test' END AS split FROM r)
        SELECT split, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS id_sum FROM s GROUP BY split""",
    "scan_formats": f"""WITH {_N}, x AS (SELECT sha1(replace(replace(t, '\\', ''), '"', '')) AS digest FROM n WHERE replace(replace(t, '\\', ''), '"', '') <> '')
        SELECT digest, count(*) AS n, format FROM x, (VALUES ('json'), ('csv'), ('text')) f(format) GROUP BY ALL""",
    "scan_shuffled": "SELECT doc_id, lang FROM documents WHERE text <> '' ORDER BY sha1('13|' || doc_id), doc_id LIMIT 100",
    "jsonl_texts": "SELECT sha1(text) AS digest FROM documents",
    "shard_set_metadata": f"WITH {_S}, z AS (SELECT *, {_hash64('text')} AS h FROM sh) SELECT CAST(shard_id AS INTEGER) AS shard_id, CAST(local_index AS INTEGER) AS local_index, {_SIGNED} AS exact_hash FROM z",
    "shard_set_shingles": f"""WITH {_S}, z AS (SELECT shard_id, local_index, tokens AS w FROM sh), g AS (SELECT shard_id, local_index, {_GRAMS.format(short='CAST([] AS VARCHAR[])')} AS g FROM z)
        SELECT CAST(shard_id AS INTEGER) AS shard_id, CAST(local_index AS INTEGER) AS local_index, len(g) AS n, array_to_string(list_sort([CAST({_hash64('x')} & 2305843009213693951 AS BIGINT) FOR x IN g]), ',') AS shingles FROM g""",
    "shard_set_manifest": f"WITH {_S} SELECT CAST(sum(sum(length)) OVER () AS BIGINT) AS total_tokens, shard_id, count(*) AS chunk_count, CAST(sum(length) AS BIGINT) AS token_count, 'shard_id=' || shard_id AS folder FROM sh GROUP BY shard_id",
    "metadata_strata": "SELECT lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars, scan FROM documents, (VALUES ('parquet'), ('csv')) s(scan) GROUP BY ALL",
    "recipe_summary": _recipe(),
    "stream_exact_dedup": f"WITH {_N} SELECT DISTINCT sha1(t) AS key FROM n",
    "stream_exact_within": "SELECT DISTINCT event_type || ' ' || user_id AS text FROM events",
    "stream_near_dedup": f"WITH {_D}, u AS (SELECT * FROM d), {_SETS}, {_JACCARD} SELECT doc_id FROM n WHERE doc_id NOT IN (SELECT b FROM p)",
    "stream_first_seen": "SELECT source AS key, min(doc_id) AS first, count(*) AS seen FROM documents GROUP BY source",
    "event_sliding": """WITH h AS (SELECT *, epoch(ts) AS s FROM events), w AS (SELECT CAST(floor(s / 10800) AS BIGINT) * 10800 - 10800 * k AS st, event_type, value FROM h, range(2) t(k))
        SELECT strftime(make_timestamp(st * 1000000), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY 1, 2""",
    "event_sessions": """WITH e AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 8 HOUR, true) AS new FROM events),
        s AS (SELECT *, sum(CAST(new AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e)
        SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts) + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') AS "end", count(*) AS n FROM s GROUP BY user_id, k""",
    "event_hours": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
}
