"""Small inputs with known results."""

import json
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from grainmill.functions import text as X
from grainmill.operators import analysis, chunks, cross, exact, near, packing, sampling, splits
from grainmill.plans import timing
from grainmill.plans.config import composed, dumped, field_map, grid_settings, load_settings, resolved, settings
from grainmill.sources import readers, sinks


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts, 1)), "doc_id bigint, text string")


def one(df):
    return df.first()[0]


def test_documents_keep_the_first(spark):
    m = {r["id"]: (r["kept"], r["reason"]) for r in exact.doc_manifest(docs(spark, "hello", " Hello ", "world")).collect()}
    assert m == {"doc:1": (True, None), "doc:2": (False, "duplicate"), "doc:3": (True, None)}


def test_chunks_of_equal_characters(spark):
    c = chunks.build_chunks(docs(spark, "abcdabcd", "abcdabcd"), 4, 4, tokens=X.char_tokens, glue="", full_only=True)
    m = exact.chunk_manifest(c).collect()
    assert sorted(r["id"] for r in m if r["kept"]) == ["chunk:1:0"] and len(m) == 4


def test_empty_character_sets_match_one_another(spark):
    c = chunks.build_chunks(docs(spark, "a" * 64, "a" * 60 + "b" * 4), 16, 16, tokens=X.char_tokens, glue="", full_only=True)
    m = near.manifest_near(c, 0.8, 32).collect()
    assert sum(r["kept"] for r in m) == 1 and sum(not r["kept"] for r in m) == 7


def test_drop_hashes(spark):
    m = exact.doc_manifest(docs(spark, "hello", "world"))
    assert cross.drop_hashes(docs(spark, "hello", "foo", "bar", "world"), m).count() == 2


@pytest.mark.parametrize(("full", "n"), [(True, 4), (False, 5)])
def test_windows(spark, full, n):
    w = spark.range(1).select(X.windows(F.array(*[F.lit(str(i)) for i in range(10)]), 4, 2, full))
    assert len(one(w)) == n and one(w)[1] == ["2", "3", "4", "5"]
    assert one(spark.range(1).select(X.windows(F.expr("CAST(array() AS array<string>)"), 4, 2))) == []
    with pytest.raises(ValueError):
        X.windows(F.col("x"), 0, 1)


@pytest.mark.parametrize(("raw", "want"), [(" Hello\nWorld  ", "hello world"), ("a b c\u001cd\u0085e", "a b c d e"), ("", ""), (" \t ", "")])
def test_simple_normal_form(spark, raw, want):
    assert one(spark.createDataFrame([(raw,)], "t string").select(X.normalize_simple(F.col("t")))) == want


@pytest.mark.parametrize(("raw", "want"), [("a<b>c</b>", "a c"), ("&lt;b&gt;", "<b>"), ("&amp;lt;", "&lt;"), ("ﬁn", "fin"), ("Ａ", "a"), (None, None)])
def test_full_normal_form(spark, raw, want):
    assert one(spark.createDataFrame([(raw,)], "t string").select(X.normalize_full(F.col("t")))) == want


@pytest.mark.parametrize(("n", "sets"), [(32, 0), (33, 1), (37, 2)])
def test_character_shingles_begin_before_the_last(spark, n, sets):
    text = "".join(chr(97 + i % 26) for i in range(n))
    assert len(one(spark.createDataFrame([(text,)], "t string").select(X.char_shingles(F.col("t"))))) == sets


def test_short_texts_have_words_or_nothing(spark):
    t = F.array(F.lit("a"), F.lit("b"), F.lit("a"))
    assert one(spark.range(1).select(X.word_shingles(t, 5, "words"))) == ["a", "b"]
    assert one(spark.range(1).select(X.word_shingles(t, 5))) == []


def test_hashes_agree_with_hashlib(spark):
    import hashlib

    key = int.from_bytes(hashlib.sha1(b"abc").digest()[:8], "big")
    row = spark.range(1).select(X.sha1_61(F.lit("abc")), X.sha1_signed64(F.lit("abc")), X.xxh64_hex(F.lit(""))).first()
    assert row[0] == key & X.MASK61 and row[1] % (1 << 64) == key and row[2] == "ef46db3751d8e999"


def test_near_copies_keep_the_longer(spark):
    base = [f"w{i}" for i in range(60)]
    d = docs(spark, " ".join(base), " ".join(base + ["x"]), "other words that are not like it at all here")
    x = d.select(F.col("doc_id").alias("ord"), F.col("text").alias("t"), F.size(F.split("text", " ")).alias("length"))
    assert [r["ord"] for r in near.near_losers(x, F.col("t"), F.col("length"), 0.8).collect()] == [1]
    assert [r["ord"] for r in near.near_losers(x, F.col("t"), F.col("length"), 0.8, rule="earlier").collect()] == [2]
    assert near.near_losers(x, F.col("t"), F.col("length"), 0.8, skip_short=100).count() == 0
    with pytest.raises(ValueError):
        near.near_losers(x, F.col("t"), F.col("length"), 0.8, rows=3)


@pytest.mark.parametrize(("n", "want"), [(0, (0, 0, 0)), (1, (1, 0, 0)), (2, (1, 1, 0)), (3, (1, 1, 1)), (100, (90, 5, 5))])
def test_fraction_counts(n, want):
    assert splits.fraction_counts(n, 0.9, 0.05) == want


def test_strata(spark):
    rows = [(i, "a" if i < 50 else "b" if i < 60 else "c" if i < 63 else "d" if i < 65 else "e" if i < 66 else None) for i in range(70)]
    got = splits.stratified_split(spark.createDataFrame(rows, "doc_id bigint, s string"), ["s"]).groupBy("s", "split").count().collect()
    n = {(r["s"], r["split"]): r["count"] for r in got}
    assert n == {("a", "train"): 40, ("a", "val"): 5, ("a", "test"): 5, ("b", "train"): 8, ("b", "val"): 1, ("b", "test"): 1, ("c", "train"): 1, ("c", "val"): 1, ("c", "test"): 1, ("d", "train"): 1, ("d", "val"): 1, ("e", "train"): 1}
    with pytest.raises(ValueError):
        splits.stratified_split(spark.createDataFrame(rows, "doc_id bigint, s string"), ["s"], train=0.5)


def test_ranks_are_dense(spark):
    r = sampling.with_global_rank(spark.range(500).withColumnRenamed("id", "doc_id"), sampling.hash_order(F.col("doc_id")), "doc_id")
    assert sorted(x["rank"] for x in r.collect()) == list(range(500))


def test_limits(spark):
    d = docs(spark, "", "a", "b")
    assert sampling.limited(d, F.col("text"), 2).count() == 2 and sampling.limited(d, F.col("text"), 0).count() == 2
    assert sampling.limited(d, F.col("text"), 0, nonempty_first=False).count() == 0 and sampling.limited(d, F.col("text"), None, nonempty_first=False).count() == 2


def test_mean_and_interval(spark):
    rows = spark.createDataFrame([("foo", 10.0), ("foo", 8.0), ("bar", 3.0)], "run string, v double")
    got = {r["run"]: r for r in analysis.mean_and_ci(rows, "v", "run").collect()}
    assert got["foo"]["mean"] == 9.0 and got["foo"]["ci"] == pytest.approx(1.96) and math.isnan(got["bar"]["ci"])


def test_factor(spark):
    curve = lambda *p: spark.createDataFrame(p, "tokens double, metric double")
    base, other = curve((3e9, 50.0), (6e9, 40.0)), curve((3e9, 48.0), (6e9, 38.0))
    assert one(analysis.data_equivalent_factor(base, other, 40.0)) == pytest.approx(6 / 5.4)
    assert math.isnan(one(analysis.data_equivalent_factor(base, other, 10.0)))


def test_canaries(spark):
    phrases = packing.canary_phrases(3)
    assert phrases[0].startswith("CANARY-000:") and len(phrases[0]) == 35 and phrases == packing.canary_phrases(3)
    c = packing.canary_chunks(spark, ["a b c d"], 3, eos="</s>").first()
    assert c["tokens"] == ["a", "b", "</s>"] and c["doc_id"] == -1


def test_settings(tmp_path):
    assert composed({"a": 1, "b": {"x": 1, "y": 2}}, {"b": {"y": 3, "z": 4}, "c": 5}) == {"a": 1, "b": {"x": 1, "y": 3, "z": 4}, "c": 5}
    cfg = settings({"dedup": {"near": {"threshold": 0.9}}, "runs": [{"name": "x"}, {"name": "y", "apply_near": True}, {"name": "z", "apply_exact": True, "apply_near": True, "near_threshold": 0.7}, {"name": "n", "near_threshold": 0.7}], "unknown": 1})
    assert [(r.name, r.exact, r.threshold) for r in cfg.recipes] == [("x", False, None), ("y", False, 0.9), ("z", True, 0.7), ("n", False, None)]
    assert [(r.name, r.exact, r.threshold) for r in settings().recipes] == [("no_dedup", False, None), ("exact", True, None), ("near", True, 0.85)]
    assert settings({"runs": [], "dedup": None}).recipes == () and settings({"dedup": {"strip_html": False}}).cleaning.strip_html is False
    (tmp_path / "s.json").write_text('{"seed": 3, "dedup": {"chunk_tokens": 9}}')
    assert (load_settings(f"{tmp_path}/s.json").seed, load_settings(f"{tmp_path}/s.json").windows.size, load_settings(None).seed) == (3, 9, 17)


def test_settings_files(tmp_path, monkeypatch):
    pytest.importorskip("yaml")
    (tmp_path / "fields.yaml").write_text("host: url_host\nlang: language\n")
    assert field_map(f"{tmp_path}/fields.yaml") == ["url_host", "language"]
    for kind, name, text in (("model", "tiny", "model: {width: 4}"), ("dedup", "exact", "dedup: {chunk_tokens: 64}"), ("tokens", "one", "tokens: 1")):
        (tmp_path / kind).mkdir()
        (tmp_path / kind / f"{name}.yaml").write_text(text)
    (tmp_path / "grid.csv").write_text("name,dedup,tokens,model,seed\nr1,exact,one,tiny,5\nr2,exact,one,tiny,\n")
    got = grid_settings(f"{tmp_path}/grid.csv", {"seed": 1, "dedup": {"cross_split": False}}, str(tmp_path))
    assert got == {n: {"seed": s, "dedup": {"cross_split": False, "chunk_tokens": 64}, "model": {"width": 4}, "tokens": 1} for n, s in (("r1", 5), ("r2", 1))}
    assert json.loads(dumped(got)) == got
    monkeypatch.setenv("GRAINMILL_WORKDIR", "/work")
    monkeypatch.setenv("HERE", "/abs")
    assert [resolved(x) for x in ("a/b", "/c", "$HERE/d")] == ["/work/a/b", "/c", "/abs/d"]


def test_grid_metadata_and_reports(spark, tmp_path):
    (tmp_path / "grid.csv").write_text("name,dedup,tokens,model,seed\nr1,exact,one,tiny,5\n")
    assert [tuple(r) for r in readers.grid(spark, f"{tmp_path}/grid.csv").collect()] == [("r1", "exact", "one", "tiny", 5)]
    (tmp_path / "lines.txt").write_text("a b\n\nc\n")
    assert sorted(r["text"] for r in readers.documents(spark, f"{tmp_path}/lines.txt", "text").collect()) == ["a b", "c"]
    with pytest.raises(ValueError):
        readers.documents(spark, f"{tmp_path}/lines.txt", "text").select(F.lit(1).alias("n")).write.parquet(f"{tmp_path}/n")
        readers.documents(spark, f"{tmp_path}/n")
    rows = spark.createDataFrame([("foo", 9.0), ("bar", 3.0)], "run string, mean double")
    sinks.report(rows, f"{tmp_path}/report.json", seed=1)
    assert json.loads((tmp_path / "report.json").read_text()) == {"seed": 1, "runs": [{"run": "foo", "mean": 9.0}, {"run": "bar", "mean": 3.0}]}


def test_file_digests(spark, tmp_path):
    import xxhash

    for name, content in (("a", b"hello"), ("b", b"hello, world")):
        (tmp_path / name).write_bytes(content)
    got = {r["path"][-1]: r["digest"] for r in sinks.file_digests(spark, str(tmp_path)).collect()}
    assert got == {"a": xxhash.xxh64_hexdigest(b"hello"), "b": xxhash.xxh64_hexdigest(b"hello, world")}
    table = spark.range(50).withColumn("x", F.col("id") % 3)
    same, other = sinks.content_digest(table.repartition(5)).first(), sinks.content_digest(table.where("id > 0")).first()
    assert same == sinks.content_digest(table.orderBy(F.desc("id"))).first() and same != other and same["n_rows"] == 50


def test_synthetic_chunks(spark):
    rows = readers.synthetic_chunks(spark, 400, seed=3, per_shard=100, shingles=20).collect()
    assert rows == readers.synthetic_chunks(spark, 400, seed=3, per_shard=100, shingles=20).collect() != readers.synthetic_chunks(spark, 400, seed=4, per_shard=100, shingles=20).collect()
    assert sorted((r["shard_id"], r["local_index"]) for r in rows) == [(i // 100, i % 100) for i in range(400)]
    assert 0.05 < 1 - len({r["exact_hash"] for r in rows}) / 400 < 0.2 and all(10 <= len(set(r["shingles"])) == len(r["shingles"]) <= 30 for r in rows)


def test_timers(spark, monkeypatch):
    monkeypatch.setattr(timing, "_records", [])
    with timing.stage("off"):
        pass
    monkeypatch.setenv("GRAINMILL_TIMING", "1")
    for _ in range(3):
        with timing.stage("on"):
            pass
    timing.record("set", 0.5)
    got = {r["stage"]: r for r in timing.timing_report(spark).collect()}
    assert set(got) == {"on", "set"} and got["on"]["n"] == 3 and got["set"]["p50"] == got["set"]["max"] == 500.0


def test_percentiles_by_brute_force(spark):
    rng = random.Random(3)
    rows = [(g, rng.choice([None, 1.0, 1.0, rng.random() * 50])) for g in ("a", "b", None) for _ in range(rng.randrange(1, 200))] + [("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r["g"]: r for r in analysis.stage_stats(df, "v", "g").collect()}
    near_ = {r["g"]: r["value"] for r in analysis.nearest_rank(df, "v", 0.9, "g").collect()}
    for g in ("a", "b", None):
        v = sorted(x for k, x in rows if k == g and x is not None)
        for q in (0.5, 0.9, 0.95, 0.99):
            low = math.floor(q * (len(v) - 1))
            assert got[g][f"p{round(100 * q)}"] == pytest.approx(v[low] + (v[math.ceil(q * (len(v) - 1))] - v[low]) * (q * (len(v) - 1) - low))
        assert near_[g] == v[max(0, math.ceil(0.9 * len(v)) - 1)]
    assert got["none"]["n"] == 0 and got["none"]["p50"] is None and near_["none"] == 0


@pytest.mark.parametrize(("size", "stride", "least", "full"), [(4, 4, 1, False), (4, 2, 1, False), (4, 6, 2, False), (4, 3, 4, False), (4, 2, 0, True), (4, 2, 5, False)])
def test_window_arithmetic(spark, size, stride, least, full):
    d = docs(spark, *[" ".join(f"w{j}" for j in range(n)) for n in (0, 1, 2, 3, 4, 5, 8, 9, 17)])
    c = chunks.build_chunks(d, size, stride, least, full_only=full)
    rows = sorted((r["doc_id"], r["position"], r["length"]) for r in c.collect())
    got = {(r["doc_id"], r["position"]): r for r in chunks.sharded_chunks(d, 3, size, stride, least, full_only=full).collect()}
    offsets = chunks.document_offsets(d, size, stride, least, full)
    summed = {(r["doc_id"], r["position"]): (r["offset"], r["take"]) for r in packing.packed(c, 11).collect()}
    counted = {(r["doc_id"], r["position"]): (r["offset"], r["take"]) for r in packing.packed(c, 11, offsets, size, stride).collect()}
    at, want = 0, {}
    for k, (i, p, n) in enumerate(rows):
        assert (got[i, p]["shard_id"], got[i, p]["local_index"]) == divmod(k, 3)
        if at < 11:
            want[i, p] = (at, min(n + 1, 11 - at))
        at += n + 1
    assert len(got) == len(rows) and summed == counted == want


def test_running_offsets_with_an_outlier(spark):
    rows = [(i, i % 5) for i in range(300)] + [(10**15, 7), (-5, 2)]
    got = chunks.running_offset(spark.createDataFrame(rows, "k bigint, n bigint").repartition(4), ["k"], ["n"]).collect()
    total = 0
    for (_, n), r in zip(sorted(rows), sorted(got, key=lambda r: r["k"]), strict=True):
        assert r["before_n"] == total
        total += n


def test_signatures_by_brute_force(spark):
    import hashlib

    d = docs(spark, "a b c d e f g", "a b", "", "é ü a b c")
    x = d.select(F.col("doc_id").alias("ord"), F.col("text").alias("t"), X.word_count(F.col("text")).alias("length"))
    how = near.Shingles(F.col("t"), F.col("length"))
    got = {r["ord"]: r["signature"] for r in near.signed(x, how, 16, 17, empty=True).collect()}
    a, b = near.permutations(16, 17)
    for i, text in enumerate(["a b c d e f g", "a b", "", "é ü a b c"], 1):
        w = text.split()
        grams = {" ".join(w[k : k + 5]) for k in range(len(w) - 4)} or set(w)
        keys = [int.from_bytes(hashlib.sha1(g.encode()).digest()[:8], "big") & X.MASK61 for g in grams]
        assert got[i] == [min(((p * k + q) % (1 << 64) % X.MASK61 for k in keys), default=X.MASK61) for p, q in zip(a.tolist(), b.tolist(), strict=True)]
    assert sorted(r["ord"] for r in near.signed(x, how, 16, 17, rows=4).collect()) == [1, 2, 4]


@pytest.mark.parametrize("rule", ["longer", "earlier"])
def test_near_rules_by_brute_force(spark, rule):
    rng = random.Random(4)
    base = [[f"w{rng.randrange(4000)}" for _ in range(60)] for _ in range(12)]
    texts = [" ".join(b[:60 - k] + [f"x{rng.randrange(9)}"] * (k > 0)) for b in base for k in (0, 0, 1, 2, 9)] + ["", "", "one two"]
    rng.shuffle(texts)
    d = docs(spark, *texts).select(F.col("doc_id").alias("ord"), F.col("text").alias("t"), X.word_count(F.col("text")).alias("length"))
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {(x,) for x in w} for i, t in enumerate(texts, 1) for w in [t.split()]}
    size = {i: len(t.split()) for i, t in enumerate(texts, 1)}
    lost = set()
    for p in sets:
        for q in sets:
            if p < q and sets[p] and sets[q] and len(sets[p] & sets[q]) >= 0.8 * len(sets[p] | sets[q]):
                lost.add(p if rule == "longer" and size[q] > size[p] else q)
    for exact_ in (True, False):
        assert {r["ord"] for r in near.near_losers(d, F.col("t"), F.col("length"), 0.8, rule=rule, exact=exact_).collect()} == lost


def test_manifest_of_near_chunks_by_brute_force(spark):
    rng = random.Random(8)
    make = lambda n: "".join(rng.choice("abcdef ") for _ in range(n))
    base = make(300)
    texts = [base, make(300), base, base[:296] + "zzzz", make(20), make(30), "q" * 32, base[:296] + "zzzz", make(20)]
    c = docs(spark, *texts).select("doc_id", F.lit(0).alias("position"), "text")
    a, b = near.permutations(64, 5)
    sign = [near.minhash(np.unique(near.sha1_keys(near.char_grams(t))), a, b) for t in texts]
    gone = {texts[j] for i in range(len(texts)) for j in range(i + 1, len(texts)) if texts[i] != texts[j] and (sign[i] == sign[j]).mean() >= 0.6 and any((sign[i][k : k + 4] == sign[j][k : k + 4]).all() for k in range(0, 64, 4))}
    got = {r["id"]: (r["kept"], r["reason"]) for r in near.manifest_near(c, 0.6, 64, 5, 16).collect()}
    want = {f"chunk:{i + 1}:0": (texts.index(t) == i and t not in gone, "duplicate" if texts.index(t) != i else "near_duplicate" if t in gone else None) for i, t in enumerate(texts)}
    assert got == want and gone


def test_contained_items(spark):
    items, texts = docs(spark, "a b c", "c d", "", "x y z w"), docs(spark, "q a b c d", "x y", "aa b c")
    assert sorted(r["doc_id"] for r in cross.contained(items, texts, F.col("text")).collect()) == [1, 2]


def test_subword_tokens(spark):
    path = "/opt/tokenizers/byte_bpe_50k.json"
    if not os.path.exists(path):
        pytest.skip("no vocabulary file")
    d = docs(spark, "Hello wörld, again and again", "", "<|endoftext|>")
    c = chunks.build_chunks(d, 4, 4, tokens=X.bpe_tokens(path), normalize=lambda t: t)
    whole = c.groupBy("doc_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("position", "tokens"))), lambda x: x["tokens"])).alias("t"))
    assert {r["doc_id"]: r["text"] for r in whole.select("doc_id", X.bpe_text(F.col("t"), path).alias("text")).collect()} == {1: "Hello wörld, again and again", 3: "<|endoftext|>"}


def test_command(spark, tmp_path):
    from grainmill.plans import steps

    text = " ".join(f"w{i}" for i in range(50))
    docs(spark, text, text + " x", text, "short").write.parquet(f"{tmp_path}/docs")
    (tmp_path / "s.json").write_text('{"dedup": {"chunk_tokens": 64, "stride_tokens": 64, "min_chunk_tokens": 2, "near": {"skip_short_tokens": 0}}}')
    run = ["prepare", "--docs", f"{tmp_path}/docs", "--out", f"{tmp_path}/out", "--settings", f"{tmp_path}/s.json", "--shard-size", "2", "--block", "40"]
    for more in ([], ["--from", "drops"]):
        steps.main(run + more)
        assert spark.read.parquet(f"{tmp_path}/out/blocks").selectExpr("doc_id", "size(tokens)").collect() == [(1, 40)]
    shards = readers.shard_set_manifest(spark, f"{tmp_path}/out/chunks").first()
    assert shards["total_tokens"] == 151 and [(s["shard_id"], s["chunk_count"]) for s in shards["shards"]] == [(0, 2), (1, 1)]
    assert sorted(map(tuple, readers.drop_list(spark, f"{tmp_path}/out/drops").collect())) == [(0, 1), (1, 0)]


def test_files(spark, tmp_path):
    sinks.write_drop_list(spark.createDataFrame([(1, 2), (0, 5), (1, 2)], "shard_id int, local_index int"), f"{tmp_path}/d")
    assert [tuple(r) for r in readers.drop_list(spark, f"{tmp_path}/d").collect()] == [(0, 5), (1, 2)]
    assert readers.drop_list(spark, f"{tmp_path}/none").count() == 0
    (tmp_path / "docs.jsonl").write_text(json.dumps({"id": 1, "text": "a"}) + "\n")
    assert [tuple(r) for r in readers.jsonl_documents(spark, f"{tmp_path}/docs.jsonl").collect()] == [("1", "a")]
    (tmp_path / "run.tsv").write_text("run\tval_perplexity\nfoo\t10\nfoo\t8\n")
    assert readers.run_summary(spark, f"{tmp_path}/run.tsv").count() == 2
    with pytest.raises(ValueError):
        readers.metadata(spark, f"{tmp_path}/run.tsv", ["url_host"])


def test_near_stream(spark, tmp_path):
    from grainmill.streaming.duplicates import near_stream

    text = " ".join(f"w{i}" for i in range(80))
    docs(spark, text, text + " x", "quite another text of a few words").coalesce(1).write.parquet(f"{tmp_path}/in")
    src = spark.readStream.schema("doc_id bigint, text string").parquet(f"{tmp_path}/in")
    for _ in range(2):
        near_stream(src, f"{tmp_path}/bands", f"{tmp_path}/kept", f"{tmp_path}/cp").awaitTermination()
        docs(spark, text).withColumn("doc_id", F.lit(9).cast("bigint")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    assert sorted(r["doc_id"] for r in spark.read.parquet(f"{tmp_path}/kept").collect()) == [1, 3]


ODD_TEXTS = ["plain text", "", "   ", "\u00a0\t", '" led by a mark', 'led out "', '"', "a, b\\", "-", "#x", "null", "doc_id", "\u0085\u2028", "x\x00y", "\x01 low", None, "plain text"]


def odd_tables(spark, tmp_path):
    """Documents with odd texts, in a folder as the queries read it."""
    rows = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(ODD_TEXTS)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["scan_documents", "scan_formats", "scan_shuffled"])
def test_scans_of_odd_texts_match_sql(spark, tmp_path, name):
    import duckdb
    from oracle import rows

    from grainmill.plans.oracles import ORACLE
    from grainmill.plans.queries import QUERIES

    df = QUERIES[name](spark, odd_tables(spark, tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    cols = sorted(df.columns)
    assert rows(df.select(cols).toArrow()) == rows(con.sql(ORACLE[name]).select(*[duckdb.ColumnExpression(c) for c in cols]).to_arrow_table())


def test_full_normal_form_holds_few_strings():
    import tracemalloc

    import pyarrow as pa

    texts = pa.array([None, "a &amp; \ufb01" + "x" * 20_000, "plain"] * 500)
    tracemalloc.start()
    got = X.decoded_batch(texts, True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.to_pylist()[:3] == [None, "a & fi" + "x" * 20_000, "plain"] and len(got) == 1500 and peak < 5_000_000


def test_character_sets_by_brute_force(spark):
    import hashlib

    texts = ["", "short", "x" * 33, "abcdefgh" * 20, "é" * 40 + "abc\U0001f600" * 20, None]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    want = {}
    for i, t in enumerate(texts):
        grams = {t[k : k + 32] for k in range(0, len(t) - 32, 4)} if t else set()
        want[i] = (len(grams), ",".join(sorted(hashlib.sha1(g.encode()).hexdigest() for g in grams)))
    assert {r["doc_id"]: (r["n"], r["shingles"]) for r in near.char_sets(d, F.col("text")).collect()} == want


def near_texts(n=60, seed=4):
    """Two groups of near copies, some lone texts, copies of equal sets, and texts of few words."""
    rng = random.Random(seed)
    bases = [[f"{c}{i}" for i in range(90)] for c in "ab"]
    out = []
    for i in range(n):
        words = list(bases[i % 2])
        for _ in range(rng.randrange(4)):
            words[rng.randrange(90)] = f"z{rng.randrange(10**6)}"
        out.append(" ".join(words))
    lone = [" ".join(f"q{rng.randrange(10**6)}" for _ in range(60)) for _ in range(15)]
    return [*out, *lone, out[0], out[1], "p q r s t p q r s t p q r s t", "p q r s t p q r s t p q r s t p q r s t", "few words", "few words", ""]


def grams(t):
    w = t.split()
    return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else set(w)


def alike(s, t, threshold=0.7):
    x, y = grams(s), grams(t)
    return bool(x and y) and len(x & y) / len(x | y) >= threshold


@pytest.mark.parametrize("most", [7, 512])
def test_pairs_of_large_groups_by_brute_force(spark, most):
    texts = near_texts()
    d = spark.createDataFrame([(i, t, len(t.split())) for i, t in enumerate(texts)], "ord bigint, t string, length int").repartition(3)
    how = near.Shingles(F.col("t"), F.col("length"))
    rows = near.signed(d, how, rows=4).localCheckpoint()
    met = near.meeting(rows.select(F.col("ord").alias("id"), F.col("ord").alias("rank"), "size", "bands"))
    want = {(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if alike(texts[a], texts[b])}
    got = near.similar(met, near.sets_from(d, how), 0.7, most=most).collect()
    assert {(r["a"], r["b"]) for r in got} == want and len(got) == len(want)
    x, y = next((grams(texts[r["a"]]), grams(texts[r["b"]])) for r in got)
    assert any(abs(r["jaccard"] - len(x & y) / len(x | y)) < 1e-12 for r in got)
    later = near.similar(met, near.sets_from(d, how), 0.7, "later", most=most).collect()
    assert sorted(r["id"] for r in later) == sorted({b for _, b in want})
    pairs = [tuple(r) for r in near.candidate_pairs(rows).collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) >= want


def test_sets_travel_with_buckets_and_not_with_pairs(spark):
    """Of twice the near copies, twice the rows go to be verified, not four times as many."""
    counts = []
    for n in (100, 200):
        d = spark.createDataFrame([(i, t, len(t.split())) for i, t in enumerate(near_texts(n)[:n])], "ord bigint, t string, length int")
        rows = near.signed(d, near.Shingles(F.col("t"), F.col("length")), rows=4).localCheckpoint()
        met = near.meeting(rows.select(F.col("ord").alias("id"), F.col("ord").alias("rank"), "size", "bands"))
        counts.append((near._units(met, 0.7, 512).count(), near.met_pairs(met).count()))
    assert counts[1][0] < 3 * counts[0][0] and counts[1][1] > 3.5 * counts[0][1]


def test_clean_train_by_brute_force(spark, monkeypatch):
    texts = near_texts()
    rows = [(i, t, len(t.split()), "train" if i % 3 else "other") for i, t in enumerate(texts)] + [(1000, None, 0, "train"), (1001, None, 0, "other")]
    d = spark.createDataFrame(rows, "ord bigint, t string, length int, split string")
    calls, signed = [], near.signed
    monkeypatch.setattr(cross, "signed", lambda *a, **k: calls.append(1) or signed(*a, **k))
    got = cross.clean_train(d.where("split = 'train'"), d.where("split = 'other'"), F.col("t"), F.col("length"), 0.7, 3).collect()
    other = [t for _, t, _, s in rows if s == "other" and t is not None]
    want = {i for i, t, n, s in rows if s == "train" and (t is None or t not in other and not (n >= 3 and any(alike(t, o) for o in other)))}
    assert {r["ord"] for r in got} == want and len(calls) == 2


def test_recipes_sign_each_chunk_once(spark, monkeypatch):
    from grainmill.plans import recipes
    from grainmill.plans.queries import recipe_settings

    texts = [t + " " + " ".join(f"w{i}" for i in range(40)) for t in near_texts()]
    d = spark.createDataFrame([(i, t, ("train", "val", "test")[i % 3]) for i, t in enumerate(texts)], "doc_id bigint, text string, split string")
    calls, signed = [], near.signed
    monkeypatch.setattr(near, "signed", lambda *a, **k: calls.append(1) or signed(*a, **k))
    rows = {r["run"]: r for r in recipes.summary(d, recipe_settings()).collect()}
    assert len(calls) == 1 and rows["near"]["train_chunks"] <= rows["exact"]["train_chunks"] <= rows["no_dedup"]["train_chunks"] and rows["near"]["exact_chunks"] == rows["exact"]["exact_chunks"]


def test_sets_of_shards_are_not_read_back(spark, tmp_path, monkeypatch):
    d = docs(spark, *[" ".join(f"w{i * k % 97}" for i in range(50)) for k in range(1, 9)], "")
    s = chunks.sharded_chunks(d, 3, 20, 20, 5)
    read = []
    monkeypatch.setattr(type(spark.read), "parquet", lambda self, *a, f=type(spark.read).parquet: read.extend(a) or f(self, *a))
    sinks.write_shard_set(s, f"{tmp_path}/set", 3, tokens=X.word_tokens)
    assert not [p for p in read if p.startswith(str(tmp_path))]
    monkeypatch.undo()
    want = {(r["shard_id"], r["local_index"]): (r["tokens"], r["text"], r["length"]) for r in s.collect()}
    got = {(r["shard_id"], r["local_index"]): (r["tokens"], r["text"], r["length"]) for r in readers.shards(spark, f"{tmp_path}/set/shards").collect()}
    assert got == want and readers.shingle_sets(spark, f"{tmp_path}/set/shingles").count() == readers.chunk_metadata(spark, f"{tmp_path}/set/chunk_metadata").count() == len(want)
    m = readers.shard_set_manifest(spark, f"{tmp_path}/set").first()
    assert m["total_tokens"] == sum(x[2] for x in want.values()) and [x["chunk_count"] for x in m["shards"]] == [3] * (len(want) // 3) + [len(want) % 3] * (len(want) % 3 > 0)


@pytest.mark.parametrize("name, most", [("apply_drop_list", 1), ("exact_keep_first", 1)])
def test_chunks_are_cut_once(spark, monkeypatch, name, most):
    from grainmill.plans import queries

    used = []
    monkeypatch.setattr(queries.chunks, "usable_chunks", lambda c, dropped, block, f=chunks.usable_chunks: used.append(c) or f(c, dropped, block))
    monkeypatch.setattr(queries.exact, "keep_first", lambda c, *a, f=exact.keep_first: used.append(c) or f(c, *a))
    queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert len(used) == most and "Generate" not in used[0]._jdf.queryExecution().executedPlan().toString()
