"""Worked examples: folds, imputation, scaling, windows, BM25, descriptors, metrics, significance, samples, text."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from policygrid.functions import text
from policygrid.operators import chunking, folds, graph, metrics, models, overlap_scores, panel, retrieval, sampling, selector, significance, tensors


def _brute_wilcoxon(diffs: list[float]) -> float:
    """The exact test by listing all signs."""
    n = len(diffs)
    order = sorted(range(n), key=lambda i: abs(diffs[i]))
    rank = {i: r + 1 for r, i in enumerate(order)}
    w = min(sum(rank[i] for i in range(n) if diffs[i] > 0), sum(rank[i] for i in range(n) if diffs[i] < 0))
    sums = [sum(r for r, s in zip(range(1, n + 1), signs, strict=True) if s) for signs in itertools.product((0, 1), repeat=n)]
    return min(1.0, 2 * sum(s <= w for s in sums) / 2**n)


def test_grouped_folds(spark):
    rows = [("d1", "FAMILY_1", "THA"), ("d2", "FAMILY_1", "THA"), ("d3", "FAMILY_2", "USA"), ("d4", "FAMILY_3", "JPN"), ("d5", "FAMILY_4", "KOR"), ("d6", "FAMILY_5", "FRA"), ("d7", "FAMILY_6", "BRA")]
    out = folds.grouped_kfold(spark.createDataFrame(rows, "document_id string, family_id string, iso string"), 3, 42)
    got = out.collect()
    assert len(got) == 7 and {r["fold"] for r in got} == {0, 1, 2}
    assert len({(r["group_key"], r["fold"]) for r in got}) == 6
    assert folds.leaking_groups(out).isEmpty()
    folds.check_folds(out, 3)
    with pytest.raises(ValueError):
        folds.grouped_kfold(spark.createDataFrame(rows, "document_id string, family_id string, iso string"), 9)
    with pytest.raises(ValueError):
        folds.grouped_kfold(spark.createDataFrame(rows, "document_id string, family_id string, iso string"), 1)


def test_blank_groups_share_one(spark):
    df = spark.createDataFrame([(1, " ", "a"), (2, None, "b"), (3, "F", "c")], "row_id long, family_id string, document_id string")
    assert {r["k"] for r in df.select(folds.group_key(df).alias("k")).collect()} == {"UNKNOWN_FAMILY", "F"}


def test_feature_selection_uses_train_only(spark):
    rows = [(0, "Trainland", 2000, "common", 1.0), (0, "Trainland", 2001, "common", 2.0), (0, "Testland", 2000, "common", 3.0), (0, "Testland", 2001, "common", 4.0), (0, "Testland", 2000, "test_only", 10.0), (0, "Testland", 2001, "test_only", 11.0)]
    df = spark.createDataFrame(rows, "table_idx int, country string, year int, feature string, value double")
    kept = panel.select_features(df, F.col("country") == "Trainland").where("verdict = 'kept'").collect()
    assert [r["feature"] for r in kept] == ["common"]


def test_correlation_rule_is_not_greedy(spark):
    import random

    rng = random.Random(1)
    rows = []
    for i in range(400):
        z = [rng.gauss(0, 1) for _ in range(3)]
        b = z[0]
        a, c = 0.85 * b + 0.53 * z[1], 0.85 * b + 0.53 * z[2]
        rows += [(0, f"c{i}", 2000, n, v) for n, v in (("a", a), ("b", b), ("c", c))]
    df = spark.createDataFrame(rows, "table_idx int, country string, year int, feature string, value double")
    got = {r["feature"]: r["verdict"] for r in panel.select_features(df, F.lit(True), threshold=0.75).collect()}
    assert got == {"a": "kept", "b": "correlated", "c": "correlated"}


def test_linear_imputation(spark):
    rows = [("x", t, v) for t, v in enumerate([None, None, 1.0, None, None, 4.0, None, None])] + [("none", 0, None), ("none", 1, None)]
    out = panel.interpolate_linear(spark.createDataFrame(rows, "k string, t int, v double"), ["k"], "t", "v").orderBy("k", "t").collect()
    assert [r["v"] for r in out] == [None, None, 1, 1, 1, 2, 3, 4, 4, 4]


def _scaled(spark):
    values = {"Trainland": ([1, 2, 3, 4, 5], [10, 10, 11, 12, 13]), "Trainland2": ([2, 3, 4, 5, 6], [9, 10, 10, 11, 12]), "Testland": ([5, 6, 7, 8, 9], [11, 12, 13, 14, 15])}
    rows = [(c, 2000 + i, f, float(v)) for c, ab in values.items() for f, vs in zip(("feature_a", "feature_b"), ab, strict=True) for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "country string, year int, feature string, value double")
    params = tensors.fit_scaler(df, F.col("country") != "Testland")
    return params, tensors.scale(df, params)


def test_train_only_scaling(spark):
    params, scaled = _scaled(spark)
    p = {r["feature"]: (r["mean"], r["std"]) for r in params.collect()}
    assert p["feature_a"] == pytest.approx((3.5, 1.5)) and p["feature_b"] == pytest.approx((10.8, 1.16619038))
    got = {(r["country"], r["year"], r["feature"]): r["value"] for r in scaled.collect()}
    assert got["Testland", 2000, "feature_a"] == pytest.approx(1.0) and got["Testland", 2004, "feature_b"] == pytest.approx(3.601470, abs=1e-6)


def test_windows_pad_with_zero_years(spark):
    _, scaled = _scaled(spark)
    anchors = spark.createDataFrame([("test_doc_1", "Testland", 2004)], "doc string, country string, year int")
    out = {r["window"]: r["tensor"] for r in tensors.window_tensor(tensors.window_cells(anchors, scaled, [1, 2, 5, 10], ["feature_a", "feature_b"]), ["doc"]).collect()}
    assert [len(out[w]) for w in (1, 2, 5, 10)] == [1, 2, 5, 10]
    assert out[1][0] == pytest.approx([3.666667, 3.601470], abs=1e-6)
    assert out[10][:5] == [[0.0, 0.0]] * 5 and out[10][5] == pytest.approx([1.0, 0.171499], abs=1e-6)


def test_one_hot_and_negatives(spark):
    df = spark.createDataFrame([(1, "Energy; Other;Transport ;"), (2, None)], "i int, s string").select("i", tensors.sector_one_hot(text.split_sectors(F.col("s"))).alias("v")).orderBy("i").collect()
    assert [i for i, x in enumerate(df[0]["v"]) if x] == [0, 6] and not any(df[1]["v"]) and len(df[0]["v"]) == 22
    pairs = tensors.negative_pairs(spark.createDataFrame([(1, "one"), (2, "two"), (3, "two")], "id int, s string"), "id", "s", 1, 3).collect()
    assert {(r["anchor"], r["negative"]) for r in pairs} == {(1, 2), (2, 1), (3, 1)}
    assert tensors.negative_pairs(spark.createDataFrame([(1, "one")], "id int, s string"), "id", "s", 2, 3).count() == 0


def test_bm25_golden(spark):
    docs = spark.createDataFrame([(0, "solar energy policy"), (1, "wind energy"), (2, "water policy water")], "id int, t string")
    q = spark.createDataFrame([("a", "solar water"), ("b", "energy policy")], "q string, t string")
    bm = retrieval.BM25(docs, "id", "t")
    got = {(r["query_id"], r["chunk_id"]): r["score"] for r in bm.score(q, "q", "t").collect()}
    assert got["a", 0] == pytest.approx(0.483622, abs=1e-6) and ("a", 1) not in got and got["a", 2] == pytest.approx(0.701563, abs=1e-6)
    assert [got["b", i] for i in range(3)] == pytest.approx([0.048362, 0.028779, 0.024181], abs=1e-6)
    with pytest.raises(ValueError):
        retrieval.BM25(docs.limit(0), "id", "t")


def test_series_descriptor(spark):
    rows = [("x", i, float(v)) for i, v in enumerate([3, 1, 4, 1, 5, 9, 2])] + [("y", 0, 7.0)]
    got = {r["k"]: r for r in selector.series_descriptor(spark.createDataFrame(rows, "k string, i int, v double"), ["k"], "i", "v").collect()}
    assert [got["x"][c] for c in selector.DESCRIPTOR] == pytest.approx([3.571429, 2.610810, 1, 9, 0.14, -0.28, 4.5, 2], abs=1e-6)
    assert [got["y"][c] for c in selector.DESCRIPTOR] == [0.0] * 8


def test_metrics_of_pooled_ranking(spark):
    s = spark.createDataFrame([(t, d, x) for t in "ABC" for d, x in (("A", 0.9), ("A", 0.2), ("B", 0.8), ("C", 0.85), ("C", 0.7))], "query_id string, document_id string, score double")
    t = spark.createDataFrame([(x, x) for x in "ABC"] + [("M", "missing")], "query_id string, target string")
    ranks = {r["query_id"]: r["rank"] for r in retrieval.target_ranks(retrieval.pool_documents(s), t).collect()}
    assert ranks == {"A": 1, "C": 2, "B": 3, "M": None}
    one = metrics.evaluate(spark.createDataFrame([(2,)], "rank long"), (1, 5)).first()
    assert (one["hit_1"], one["hit_5"], one["precision_5"], one["ndcg_5"], one["mrr_5"]) == pytest.approx((0, 1, 0.2, 0.63093, 0.5), abs=1e-6)
    none = metrics.evaluate(spark.createDataFrame([], "rank long")).first()
    assert none["queries_evaluated"] == 0 and none["hit_10"] == 0.0


def test_block_cosine_is_exact_with_ties_and_zeros(spark):
    import numpy as np

    g = np.random.default_rng(3)
    x = np.round(g.normal(size=(300, 8)), 3)
    x[5], x[6], x[7] = x[4], 2 * x[4], 0
    df = spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in enumerate(x)], "chunk_id long, vec array<double>")
    q = df.where("chunk_id < 20").withColumnRenamed("chunk_id", "query_id")
    got = {(r[0], r[1]): r[2] for r in retrieval.block_cosine(q, df).collect()}
    n = np.linalg.norm(x, axis=1)
    u = x / np.where(n, n, 1)[:, None]
    assert len(got) == 20 * 300 and all(abs(got[a, b] - u[a] @ u[b]) < 1e-9 for a, b in got)
    top = retrieval.top_per(retrieval.block_cosine(q, df, 5), ["query_id"], [F.col("score").desc(), F.col("chunk_id")], 5).collect()
    want = {(i, j) for i in range(20) for j in sorted(range(300), key=lambda j: (-round(float(u[i] @ u[j]), 10), j))[:5]}
    assert {(r["query_id"], r["chunk_id"]) for r in top} == want


def test_significance_goldens(spark):
    d1, d2 = [0.06, 0.05, 0.07, 0.03, 0.04], [0.06, -0.01, 0.07, 0.03, -0.02]
    assert significance.t_test_p(d1) == pytest.approx(0.002111, abs=1e-6) and significance.t_test_p(d2) == pytest.approx(0.223285, abs=1e-6)
    assert significance.wilcoxon_p(d1) == pytest.approx(0.0625) and significance.wilcoxon_p(d2) == pytest.approx(0.3125)
    assert math.isnan(significance.t_test_p([0.1])) and math.isnan(significance.wilcoxon_p([0.1]))
    for d in ([0.3, -0.1, 0.25, 0.7, -0.41, 0.09], [1.0, 2.0, 3.0]):
        assert significance.wilcoxon_p(d) == pytest.approx(_brute_wilcoxon(d))
    rows = [("b", f, 0.5) for f in range(5)] + [("c", f, 0.5 + d) for f, d in enumerate(d1)]
    s = significance.paired_statistics(spark.createDataFrame(rows, "method string, fold int, m double"), [("b", "c")], ["m"]).first()
    assert s["mean_diff"] == pytest.approx(0.05) and s["t_stat"] == pytest.approx(7.071068, abs=1e-5) and s["w_stat"] == 0
    assert significance.method_pairs(["a", "b", "c"], "pairwise") == [("a", "b"), ("a", "c"), ("b", "c")]


def test_stability_and_round_robin(spark):
    s = metrics.stability(spark.createDataFrame([("m", 0.30), ("m", 0.36), ("m", 0.33), ("one", 0.5)], "k string, v double"), "v", ["k"])
    got = {r["k"]: r for r in s.collect()}
    assert (got["m"]["mean"], got["m"]["std"], got["m"]["cv_pct"]) == (0.33, 0.03, 9.09) and got["one"]["std"] == 0.0
    pool = spark.createDataFrame([(i, c) for i, c in enumerate(["Africa"] * 3 + ["Asia"] + ["Europe"] * 2)], "id int, c string")
    counts = {r["c"]: r["n"] for r in sampling.round_robin(pool, "c", 5, "id").groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert counts == {"Africa": 2, "Asia": 1, "Europe": 2} and sampling.round_robin(pool, "c", 99, "id").count() == 6


def test_text_scalars(spark):
    one = lambda e, v: spark.createDataFrame([(v,)], "x string").select(e(F.col("x")).alias("y")).first()["y"]
    assert one(text.clean_html, "<p>a &amp;  b</p>") == "a & b" and one(lambda c: text.clean_html(c, True), "caf&eacute; &amp;lt;") == "café &lt;"
    assert one(text.clean_text, "a b\x1cc\u0085d  e\n\tf") == "a b c d e f" and one(text.clean_text, None) == ""
    assert one(text.clean_keywords, "Solar ; ;Wind  power;") == "Solar Wind power" and one(text.split_sectors, "Energy; Other;Transport ;") == ["Energy", "Transport"]
    assert one(text.safe_filename, "Côte d'Ivoire") == "C_te_d_Ivoire" and one(text.tokens, "CO2-free, 2030!") == ["co2", "free", "2030"]
    assert one(text.policy_year, "2004-01-01") == 2004 and one(text.policy_year, "n/a") is None and one(text.policy_year, "") is None
    assert (one(text.instrument_name, "Carbon Tax|Economic"), one(text.instrument_type, "Carbon Tax|Economic"), one(text.instrument_type, "Carbon Tax")) == ("Carbon Tax", "Economic", None)
    for first, last, label in ((100, 104, "stable"), (100, 106, "increasing"), (100, 90, "decreasing")):
        assert spark.range(1).select(sampling.trend_label(F.lit(float(first)), F.lit(float(last))).alias("y")).first()["y"] == label
    for p in (" ./data\\a//b.txt", "../data/a/b.txt", "/data/a/b.txt ", "data/a/b.txt"):
        assert one(text.normal_path, p) == "data/a/b.txt"
    assert one(text.normal_path, "./") is None


def test_word_chunks_cover_and_fit():
    t = " ".join(f"word{i}" for i in range(900)) + " " + "x" * 4000 + " end"
    parts = chunking.word_chunks(t, 1500, 200)
    assert all(len(p) <= 1500 and t[a : a + len(p)] == p for a, p in parts)
    assert set(range(len(t))) - {i for a, p in parts for i in range(a, a + len(p))} <= {i for i, c in enumerate(t) if c == " "}
    assert chunking.word_chunks("", 10, 2) == [] and chunking.word_chunks("a b", 10, 2) == [(0, "a b")]


def test_upsert_changes_only_what_differs(spark):
    c = spark.createDataFrame([("c1", "d1", "A", "x"), ("c2", "d1", "B", "x"), ("c3", "d2", "A", None), ("c4", None, "A", "x")], "chunk_id string, document_id string, geography string, sector string")
    w = spark.createDataFrame([("d1", "B", " "), ("d2", None, "y")], "document_id string, geography string, sector string")
    got = {r["chunk_id"]: (r["geography"], r["sector"], r["updated"]) for r in chunking.upsert_metadata(c, w, "document_id", ["geography", "sector"]).collect()}
    assert got == {"c1": ("B", "x", True), "c2": ("B", "x", False), "c3": ("A", "y", True), "c4": ("A", "x", False)}


def test_rouge(spark):
    assert [overlap_scores.porter(w) for w in ("caresses", "ponies", "hopping", "relational", "conditional", "controlling", "happy", "generalizations")] == ["caress", "poni", "hop", "relat", "condit", "control", "happi", "gener"]
    assert overlap_scores.lcs_length(list("abcbdab"), list("bdcaba")) == 4 and overlap_scores.lcs_length([], ["a"]) == 0
    p = spark.createDataFrame([(1, "the cat sat", "the cat ran"), (2, None, "x"), (3, "a", "a")], "k int, g string, h string")
    r1 = {r["k"]: r["rouge1"] for r in overlap_scores.rouge_n(p, "k", "g", "h", 1).collect()}
    r2 = {r["k"]: r["rouge2"] for r in overlap_scores.rouge_n(p, "k", "g", "h", 2).collect()}
    assert r1 == {1: 0.666667, 2: 0.0, 3: 1.0} and r2 == {1: 0.5, 2: 0.0, 3: 0.0}
    assert {r["k"]: r["rougeL"] for r in overlap_scores.rouge_l(p, "k", "g", "h").collect()} == {1: 0.666667, 2: 0.0, 3: 1.0}


def test_losses(spark):
    v = spark.createDataFrame([([0.0, 0.0], [0.0, 1.0], [3.0, 4.0])], "a array<double>, p array<double>, n array<double>")
    assert v.select(models.triplet_loss(F.col("a"), F.col("p"), F.col("n"), 5.0).alias("l")).first()["l"] == pytest.approx(1.0, abs=1e-4)
    s = spark.createDataFrame([(0, i, j, 1.0 if i == j else 0.0) for i in range(3) for j in range(3)], "b int, i int, j int, s double")
    assert models.contrastive_loss(s, "b", "i", "j", "s", 1.0).first()["loss"] == pytest.approx(math.log(math.e + 2) - 1)


def test_guarded_retries_only_rate_limits():
    waits, calls = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 4:
            raise RuntimeError("429 too many requests")
        return "ok"

    assert models.guarded(flaky, sleep=waits.append) == "ok" and waits == [1.0, 2.0, 4.0]
    with pytest.raises(KeyError):
        models.guarded(lambda: {}["x"], sleep=waits.append)


def test_parse_selected_titles():
    titles = ["Coal output", "Forest share", "Road km", "Coal share"]
    assert models.parse_selected_titles('["Road km", "coal"]', titles) == ["road km", "coal output"]
    assert models.parse_selected_titles("- Forest share\n- nothing; Coal share", titles) == ["forest share", "coal share"]
    assert models.parse_selected_titles(None, titles) == []


def test_generation_resumes_and_survives_errors(spark):
    class Fails:
        def generate(self, prompt):
            raise ValueError(prompt)

    df = spark.createDataFrame([(1, "a b"), (2, None), (3, "c")], "id int, p string")
    assert {r["id"]: r["out"] for r in models.generate_column(df, "p", models.Extract, "out", df.where("id = 3"), "id").collect()} == {1: "a b", 2: None}
    assert {r["out"] for r in models.generate_column(df, "p", Fails, "out").collect()} == {None}


def test_graph_levels_and_lookup(spark):
    r = spark.createDataFrame([("A", "Mid", "Top"), ("B", None, "Top"), ("C", " ", None)], "country string, sub_region string, region_name string")
    got = {(e["src"], e["dst"]) for e in graph.hierarchy(r).collect()}
    assert got == {("A", "Mid"), ("Mid", "Top"), ("B", "Top")}
    e = spark.createDataFrame([("PolicyDocument", "d1", "IN_SECTOR", "Sector", "Energy"), ("Country", "A", "APPLIES", "PolicyDocument", "d1"), ("Country", "A", "APPLIES", "PolicyDocument", "d2"), ("PolicyDocument", "d1", "ADDRESSES_HAZARD", "Hazard", "Flood")], list(graph.EDGE))
    assert [x[0] for x in graph.entity_lookup(e, [("Country", "A"), ("Sector", "Energy")]).collect()] == ["d1"] and graph.entity_lookup(e, []).count() == 0
    assert [(x["src"], x["dst"]) for x in graph.at_risk(e).collect()] == [("A", "Flood")]
    props = graph.with_properties(graph.nodes(e).where("key = 'd1'"), spark.createDataFrame([("d1", "T")], "id string, title string"), "id", ["title"]).first()
    assert props["props"] == {"title": "T"}


def test_filter_cascade_levels(spark):
    s = spark.createDataFrame([(q, c, 0.5) for q in ("q1", "q2", "q3") for c in ("c1", "c2", "c3")], "query_id string, chunk_id string, score double")
    q = spark.createDataFrame([("q1", "A", "x"), ("q2", "A", "none"), ("q3", None, "x")], "query_id string, country string, sector string")
    m = spark.createDataFrame([("c1", "A", "x"), ("c2", "A", "y"), ("c3", "B", "x")], "chunk_id string, geography string, sector string")
    got = {(r["query_id"], r["chunk_id"], r["level"]) for r in retrieval.filter_cascade(s, q, m).collect()}
    assert got == {("q1", "c1", 1), ("q2", "c1", 2), ("q2", "c2", 2), ("q3", "c1", 3), ("q3", "c2", 3), ("q3", "c3", 3)}
