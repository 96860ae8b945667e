"""Queries of policy cleaning, table selection by meaning, generation, judging, encoder evaluation and further retrieval, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from policygrid.functions import text
from policygrid.functions.ordering import top_per
from policygrid.operators import generation, graph, metrics, models, policies, retrieval, sampling, selector, significance, tensors
from policygrid.operators.tiles import Tiles
from policygrid.plans import q_panel, q_policies, q_retrieval
from policygrid.plans.q_policies import _squeeze
from policygrid.session import durable, scratch, table
from policygrid.sources.writers import Checkpoint

EMBEDDER = models.HashedWords(64)


def clean_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = policies.clean_policies(table(spark, sf_dir, "group_kfold_assignments"))
    return c.select("row_id", "document_id", F.md5("family_summary").alias("summary_digest"), F.array_join("sectors", "|").alias("sectors"), "geography", "event_date")


def policies_for_chunking(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = policies.load_policies(table(spark, sf_dir, "group_kfold_assignments"), ["fold", "document_id", "family_summary"])
    return p.select("row_id", "fold", "document_id", F.md5("family_summary").alias("summary_digest"), "geography", "sector")


def policies_for_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With keywords; rows with a blank summary are left out."""
    g = table(spark, sf_dir, "group_kfold_assignments").join(table(spark, sf_dir, "all_data_en").select("row_id", "keyword"), "row_id")
    p = policies.load_policies(g, ["fold", "document_id", "family_summary", "keyword"], keep_blank=False, keywords=True)
    return p.select("row_id", "fold", "document_id", F.md5("family_summary").alias("summary_digest"), "keyword")


def in_country_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filings from a country of the region table."""
    return policies.in_countries(table(spark, sf_dir, "all_data_en").select("row_id", "geography"), "geography", table(spark, sf_dir, "country_region"))


def trainable_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policies.trainable(table(spark, sf_dir, "all_data_en")).select("row_id", "sector")


def role_test_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that have chunks, with their last summary and the first text of a chunk that isn't blank."""
    c = table(spark, sf_dir, "chunk").where("trim(document_id) <> ''")
    g = table(spark, sf_dir, "group_kfold_assignments").where("document_id is not null and family_summary is not null")
    out = policies.test_rows(c.select("document_id").distinct(), g, c.select("document_id", F.col("text").alias("query_text"), F.col("chunk_id").alias("query_no")))
    return out.select("document_id", F.md5("summary").alias("summary_digest"), F.md5("query_text").alias("query_digest"))


def feature_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of the panel with their place and the domain of their table; tables are told apart by number, a third each of climate, socio and nothing known."""
    t = table(spark, sf_dir, "time_series").select("table_idx", "feature").distinct()
    path = F.concat(F.element_at(F.array(F.lit("climate"), F.lit("socio"), F.lit("misc")), F.pmod("table_idx", F.lit(3)) + 1), F.lit("/"), F.format_string("%06d", "table_idx"))
    keyed = t.select("feature", path.alias("path"))
    domains = policies.table_domains(keyed).join(keyed.select("path").distinct().withColumn("table_key", F.format_string("t%03d", F.row_number().over(W.orderBy("path")) - 1)), "table_key")
    named = keyed.join(domains, "path").select(F.concat_ws("__", "table_key", F.split_part("feature", F.lit("__"), F.lit(2))).alias("feature"))
    out = policies.feature_domains(named, policies.table_domains(keyed), ("climate", "socio"))
    return out.select("feature", F.col("feature_idx").cast("bigint").alias("feature_idx"), "domain")


def feature_names_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features at the places 0, 5, 10, ... up to 1,000, those out of bounds left out."""
    f = feature_domains(spark, sf_dir)
    return policies.names_at(f, spark.range(0, 1001, 5).withColumnRenamed("id", "feature_idx"))


def metadata_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "all_data_en")
    return a.select("row_id", generation.metadata_text(F.col("sector"), F.col("instrument"), F.col("keyword"), F.col("category"), F.lit("")).alias("text"))


def table_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The readings of Meridia from 2000 to 2009 as a block per table: feature, year and value in each row."""
    c = q_panel.cells(spark, sf_dir).where("country = 'meridia' and year between 2000 and 2009")
    cells = F.array("feature", F.col("year").cast("string"), F.col("value").cast("string"), F.lit(" "))
    rows = c.groupBy("table_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("feature", "year", cells.alias("r")))), lambda x: x["r"]).alias("rows"))
    return rows.select("table_idx", generation.table_block(F.concat(F.lit("Table "), "table_idx"), F.col("rows")).alias("block"))


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """table_idx, title: the names of a table's first six features as words."""
    f = table(spark, sf_dir, "time_series").select("table_idx", "feature").distinct()
    first = top_per(f, ["table_idx"], [F.col("feature").asc()], 6)
    words = F.replace(F.split_part("feature", F.lit("__"), F.lit(2)), F.lit("_"), F.lit(" "))
    named = first.groupBy("table_idx").agg(F.array_sort(F.collect_list(F.struct("rank", words.alias("w")))).alias("x"))
    return named.select("table_idx", F.array_join("x.w", ", ").alias("title"))


def _semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generation.title_matches(metadata_text(spark, sf_dir), "text", titles(spark, sf_dir), EMBEDDER, 5)


def selector_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five table titles most like the metadata of each filing."""
    return metadata_text(spark, sf_dir).join(_semantic(spark, sf_dir), "text").select("row_id", "title", "score", "rank")


def selector_semantic_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The selected titles of each different metadata text as a JSON list."""
    j = selector.selection_json(_semantic(spark, sf_dir), "text", "title")
    return metadata_text(spark, sf_dir).join(j, "text").select("row_id", "selected_titles")


def answered_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables that an answer names: here a list of each filing's two best titles in capitals and of something unknown."""
    known = [r["title"] for r in titles(spark, sf_dir).collect()]  # the catalogue of tables
    two = _semantic(spark, sf_dir).where("rank <= 2").groupBy("text").agg(F.array_sort(F.collect_list(F.struct("rank", "title"))).alias("x"))
    asked = two.select("text", F.concat(F.lit('["'), F.array_join(F.transform("x.title", F.upper), '", "'), F.lit('", "nothing of that kind"]')).alias("answer"))
    return metadata_text(spark, sf_dir).join(generation.answered_titles(asked, "text", "answer", known), "text").select("row_id", "title", "rank")


def _prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = durable(q_panel.cells(spark, sf_dir), "cells")
    top = q_panel._spot_selection(c, q_panel._spots(spark, sf_dir), "pearson").where("rank <= 3")
    return generation.analysis_prompts(c, top, titles(spark, sf_dir))


def analysis_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompts of the three best tables of each country, region and year of a policy."""
    return _prompts(spark, sf_dir).select("country", "region", "year", "table_idx", F.col("rank").cast("bigint").alias("rank"), "prompt")


def _policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "policy_document").select("document_id", F.col("summary").alias("source_text"))
    return d.join(q_panel._spots(spark, sf_dir), "document_id").select("document_id", "country", "region", "year", "source_text")


def _tail() -> models.Extract:
    return models.Extract(60, last=True)


def generated_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The staged generation over all policy documents with a country and a year; a generator that gives back the end of its prompt stands in."""
    chunks = table(spark, sf_dir, "chunk").where("trim(document_id) <> '' and trim(text) <> ''")
    return generation.generate_summaries(_policies(spark, sf_dir), durable(_prompts(spark, sf_dir), "prompts"), chunks, _tail, EMBEDDER)


def generated_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three runs without fallback of the policies whose number is divisible by 20, by seed; how many analyses and blends each has."""
    some = _policies(spark, sf_dir).where(q_retrieval._doc_number("document_id") % 20 == 0)
    chunks = table(spark, sf_dir, "chunk").where("trim(document_id) <> '' and trim(text) <> ''")
    prompts = durable(_prompts(spark, sf_dir), "prompts")
    runs = [generation.generate_summaries(some, prompts, chunks, _tail, EMBEDDER, fallback=False).withColumn("seed", F.lit(s)) for s in (1, 2, 3)]
    return runs[0].unionByName(runs[1]).unionByName(runs[2]).select("seed", "document_id", "n_analyses", "n_blends", F.md5("summary").alias("summary_digest"))


def judge_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores by words of a document's policy summary and of its last family summary against its title, by kind of summary."""
    p = q_policies._pairs(spark, sf_dir).join(table(spark, sf_dir, "policy_document").select("document_id", "document_title"), "document_id")
    kinds = F.array(F.struct(F.lit("generated").alias("summary_type"), F.col("generated").alias("t")), F.struct(F.lit("human").alias("summary_type"), F.col("human").alias("t")))
    long = p.select("document_id", "document_title", F.explode(kinds).alias("k")).select("document_id", "document_title", "k.summary_type", "k.t")
    return models.judge_means(models.judge_rows(long, "document_title", "t", models.SharedWords), "summary_type")


def _encoded_queries(spark: SparkSession, sf_dir: str, encoder: models.DualEncoder) -> DataFrame:
    """query_id, target, vec: the query tower over the first row of each document's tensor, as eight numbers, and the sectors of its filings."""
    spots = q_panel._spots(spark, sf_dir)
    scaled = tensors.scale(c := durable(q_panel.cells(spark, sf_dir), "cells"), tensors.fit_scaler(c, q_panel.train_country()))
    signal = selector.tensor_signal(spots.select("country", "year").distinct(), scaled, 10)
    own = table(spark, sf_dir, "group_kfold_assignments").where("document_id is not null").groupBy("document_id").agg(F.min_by("sector", "row_id").alias("sector"))
    q = spots.join(signal, ["country", "year"]).join(own, "document_id", "left").select("document_id", F.array(*[F.col(f"s_{d}") for d in selector.DESCRIPTOR]).alias("series"), tensors.sector_one_hot(text.split_sectors(F.col("sector"))).alias("one_hot"))
    return models.encode_queries(q, "series", "one_hot", encoder, "vec").select(F.col("document_id").alias("query_id"), F.col("document_id").alias("target"), "vec")


def encoder_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieval of documents by series: query tower against the text tower of all chunks, pooled by document. Weights are seeded, not trained."""
    encoder = models.DualEncoder.seeded(len(selector.DESCRIPTOR), len(tensors.SECTORS), q_retrieval.WIDTH, 32, 1)
    q = durable(_encoded_queries(spark, sf_dir, encoder), "encoded-queries")
    c = models.encode_texts(q_retrieval.chunk_set(spark, sf_dir).select("chunk_id", "document_id", "vec"), "vec", encoder, "enc").select("chunk_id", "document_id", F.col("enc").alias("vec"))
    return metrics.evaluate(Tiles(q, c).target_ranks().withColumn("rank", F.col("ranks")[0]), q_retrieval.CUTS)


def whole_document_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five policy documents most like each of those whose number is divisible by 20, itself left out."""
    d = table(spark, sf_dir, "policy_document").where(retrieval.usable_vector(F.col("embedding"), q_retrieval.WIDTH)).select("document_id", F.col("embedding").alias("vec"))
    q = d.where(q_retrieval._doc_number("document_id") % 20 == 0).withColumnRenamed("document_id", "query_id")
    s = retrieval.block_cosine(q, d.withColumnRenamed("document_id", "chunk_id"), 6).where("query_id <> chunk_id").withColumnRenamed("chunk_id", "document_id")
    return retrieval.rank_documents(s, 5).select("query_id", "document_id", "score", F.col("rank").cast("bigint").alias("rank"))


def hit5_by_sector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the 1,000 best chunks those of the query's sector, of these the first five documents: is the target among them?"""
    c = q_retrieval.chunk_set(spark, sf_dir).withColumn("s", F.nullif(F.trim("sector"), F.lit("")))
    q = q_retrieval.query_set(spark, sf_dir).withColumn("sector", F.trim("sector"))
    hits = q_retrieval.tiles(spark, sf_dir, queries=q, chunks=c).sector_hits(5).distinct().withColumn("hit", F.lit(1))
    return q.select("query_id").join(hits, "query_id", "left").select("query_id", F.coalesce("hit", F.lit(0)).alias("hit"))


def any_overlap_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a filing's sectors and those of its assignment have one in common."""
    a = table(spark, sf_dir, "all_data_en").select("row_id", text.split_sectors(F.col("sector")).alias("a"))
    b = table(spark, sf_dir, "group_kfold_assignments").select("row_id", text.split_sectors(F.col("sector")).alias("b"))
    return a.join(b, "row_id").select("row_id", metrics.any_overlap(F.col("a"), F.col("b")).alias("hit"))


def document_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents with the best chunk for each query."""
    r = q_retrieval.tiles(spark, sf_dir).top_documents(10)
    return r.select("query_id", "document_id", "score", F.col("rank").cast("bigint").alias("rank"))


def hits_with_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each query's first hit with geography and year of the document it retrieved, null where that is no policy document."""
    p = table(spark, sf_dir, "policy_document").groupBy("document_id").agg(F.min("geography").alias("geography"), F.min("approval_year").alias("approval_year"))
    h = q_retrieval.trace_hit1_collapse(spark, sf_dir).select("query_id", F.col("retrieved_doc_id").alias("document_id"), "hit1")
    return h.join(p, "document_id", "left").select("query_id", "document_id", "hit1", "geography", "approval_year")


def outcome_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty successes and twenty failures, taking turns between the folds of the queries."""
    h = q_retrieval.trace_hit1_collapse(spark, sf_dir).select("query_id", "hit1").join(q_retrieval.query_set(spark, sf_dir).select("query_id", "fold"), "query_id")
    return sampling.round_robin(h, "fold", 20, "query_id", 5, ["hit1"]).select("query_id", "hit1", F.col("sample_no").cast("bigint").alias("sample_no"))


def normalized_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fold metrics as the runs of encoders report them (window, backbone, loss), normalised."""
    m = q_retrieval.fold_metrics(spark, sf_dir).select(F.col("fold").alias("window"), F.split_part("method", F.lit("_"), F.lit(1)).alias("backbone"), F.split_part("method", F.lit("_"), F.lit(2)).alias("loss"), "hit_10", "mrr_10")
    return policies.normalize_results(m, "pooling").select("experiment", "fold", "method", "hit_10", "mrr_10")


def encoder_significance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired statistics of normalised results against the baseline backbone and loss."""
    m = durable(normalized_results(spark, sf_dir), "results")
    names = sorted(r["method"] for r in m.select("method").distinct().collect())
    pairs = significance.method_pairs(names, "method-vs-baselines", ["mean|pool"], "max|pool")
    s = significance.paired_statistics(m, pairs, ["hit_10", "mrr_10"])
    return s.select("baseline", "candidate", "metric", "n", F.round("mean_diff", 6).alias("mean_diff"), F.round("t_stat", 6).alias("t_stat"))


def stability_by_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value of each run beside the spread over runs, folds in the place of seeds: a row per method and seed."""
    m = durable(q_retrieval.fold_metrics(spark, sf_dir), "fold-metrics")
    return m.select("method", F.col("fold").alias("seed"), F.round("ndcg_10", 6).alias("value")).join(metrics.stability(m, "ndcg_10", ["method"]).select("method", "mean", "std"), "method")


HAZARDS = {"keyword": ("ADDRESSES_HAZARD", "Hazard"), "document_role": ("IS_OF_FRAMEWORK", "Framework"), "category": ("HAS_TARGET_TOPIC", "Topic")}


def graph_hazards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges to hazards, frameworks and topics (here from keyword, document_role and category) and the hazards that countries are at risk of, counted."""
    a = table(spark, sf_dir, "all_data_en").where("trim(document_id) <> ''")
    e = durable(graph.policy_edges(a, HAZARDS), "hazard-edges")
    both = e.where(F.col("rel").isin("ADDRESSES_HAZARD", "IS_OF_FRAMEWORK", "HAS_TARGET_TOPIC")).unionByName(graph.at_risk(e))
    return both.groupBy("rel", "dst").agg(F.count(F.lit(1)).alias("n"))


def best_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trial with the least loss of each fold; a trial is a pooling and its loss what it lacks to a mean reciprocal rank of 1."""
    m = q_retrieval.fold_metrics(spark, sf_dir).select("fold", F.col("method").alias("params"), F.round(1 - F.col("mrr_10"), 6).alias("val_loss"))
    return models.best_trial(m, ["fold"])


def embedding_stub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors of the policy summaries by place, zeros left out."""
    d = table(spark, sf_dir, "policy_document").select("document_id", "summary")
    e = models.embed_column(d, "summary", models.HashedWords(32)).select("document_id", F.posexplode("embedding").alias("place", "v"))
    return e.select("document_id", F.col("place").cast("bigint").alias("place"), F.round("v", 6).alias("v")).where("v <> 0")


def generation_stub(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "policy_document").select("document_id", "summary")
    return models.generate_column(d, "summary", models.Extract, "generated").select("document_id", "generated")


def role_agent_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The advisors' compact text of every document that has chunks, made through a cache of finished rows."""
    c = table(spark, sf_dir, "chunk").where("trim(document_id) <> ''")
    g = table(spark, sf_dir, "group_kfold_assignments").where("document_id is not null and family_summary is not null")
    rows = policies.test_rows(c.select("document_id").distinct(), g, c.select("document_id", F.col("text").alias("query_text"), F.col("chunk_id").alias("query_no")))
    kept = Checkpoint(spark, scratch(spark, "role-agents"), "cache_key")
    out = generation.role_agent_frame(rows, {"climate": "summary", "socio": "query_text", "other": "document_id"}, _tail, kept, {"fold": "0", "window": "10"})
    return out.select("document_id", "cache_key", "compact")


QUERIES = {
    f.__name__: f
    for f in (
        clean_policies, policies_for_chunking, policies_for_baselines, in_country_list, trainable_filings, role_test_rows, feature_domains, feature_names_at, metadata_text, table_blocks,
        selector_semantic, selector_semantic_json, answered_titles, analysis_prompts, generated_summaries, generated_stability, role_agent_frame, judge_means, encoder_metrics, whole_document_topk, hit5_by_sector,
        any_overlap_hit, document_ranking, hits_with_metadata, outcome_sample, normalized_results, encoder_significance, stability_by_seed, graph_hazards, best_trials, embedding_stub, generation_stub,
    )
}

_CLEAN = lambda c: f"coalesce({_squeeze(c)}, '')"
_SECTORS = "list_filter(list_transform(string_split(coalesce({0}, ''), ';'), lambda s: trim(s, ' ')), lambda s: s NOT IN ('', 'Other'))"
_META = f"""md AS (SELECT row_id, 'Targeted Sector: ' || {_CLEAN("sector")} || chr(10) || 'Policy Instrument: ' || {_CLEAN("instrument")} || chr(10) || 'Keywords: ' || {_CLEAN("keyword")} || chr(10) || 'Topics: ' || {_CLEAN("category")} || chr(10) || 'Hazards: ' AS text FROM all_data_en)"""
_TITLES = """ti AS (SELECT table_idx, string_agg(w, ', ' ORDER BY feature) AS title FROM (SELECT table_idx, feature, replace(split_part(feature, '__', 2), '_', ' ') AS w, row_number() OVER (PARTITION BY table_idx ORDER BY feature) AS r FROM (SELECT DISTINCT table_idx, feature FROM time_series)) WHERE r <= 6 GROUP BY table_idx)"""


def _vectors(name: str, src: str, col: str, width: int = 64) -> str:
    """CTEs: `name` (x, p, v): the hashed word vector of each different text by place; `name`n (x, n): its length."""
    return f"""{name}w AS (SELECT {col} AS x, md5(unnest(regexp_extract_all(lower({col}), '[a-z0-9]+'))) AS h FROM (SELECT DISTINCT {col} FROM {src})),
      {name} AS MATERIALIZED (SELECT x, CAST('0x' || substr(h, 1, 2) AS BIGINT) % {width} AS p, CAST(sum(CASE WHEN substr(h, 3, 1) >= '8' THEN 1 ELSE -1 END) AS DOUBLE) AS v FROM {name}w GROUP BY ALL), {name}n AS (SELECT x, sqrt(sum(v * v)) AS n FROM {name} GROUP BY x)"""


_MATCHES = f"""{_META}, {_TITLES}, {_vectors("a", "md", "text")}, {_vectors("b", "ti", "title")}, dt AS (SELECT a.x, b.x AS y, sum(a.v * b.v) AS d FROM a JOIN b USING (p) GROUP BY ALL),
   sc0 AS (SELECT m.text, t.title, round(coalesce(CASE WHEN an.n > 0 AND bn.n > 0 THEN d / (an.n * bn.n) END, 0), 6) AS score FROM (SELECT DISTINCT text FROM md) m CROSS JOIN (SELECT DISTINCT title FROM ti) t
     LEFT JOIN dt ON dt.x = m.text AND dt.y = t.title LEFT JOIN an ON an.x = m.text LEFT JOIN bn ON bn.x = t.title),
   mt AS (SELECT * FROM (SELECT text, title, score, row_number() OVER (PARTITION BY text ORDER BY score DESC, title) AS rank FROM sc0) WHERE rank <= 5)"""
_SLICE = """(SELECT string_agg(l, chr(10) ORDER BY year) FROM (SELECT year, year || ': ' || string_agg(feature || '=' || printf('%.2f', sign(value) * floor(abs(value) * 100 + 0.5) / 100), ', ' ORDER BY feature) AS l FROM cells WHERE cells.table_idx = {t} AND cells.country = {p} AND cells.year BETWEEN {y} - 10 AND {y} - 1 GROUP BY year))"""
_S = q_retrieval._BASE
_HIT1 = f"""{_S}, {q_retrieval._TRACE.format(k=10)}, h1 AS (SELECT query_id, arg_min(retrieved_doc_id, retrieved_rank) AS document_id, arg_min(is_relevant_doc, retrieved_rank) > 0 AS hit1 FROM t GROUP BY query_id HAVING min(retrieved_rank) = 1)"""
_WORDS = "list_distinct(regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9]+'))"
_RES = f"{_S}, {q_retrieval._FOLDED}, nr AS (SELECT 'pooling' AS experiment, fold, replace(method, '_', '|') AS method, hit_10, mrr_10 FROM fm)"
SQL = {
    "clean_policies": f"""SELECT * FROM (SELECT row_id, coalesce(document_id, '') AS document_id, md5(s) AS summary_digest, array_to_string(c, '|') AS sectors, trim(geography, ' ') AS geography, TRY_CAST(substr(trim(d, ' '), 1, 10) AS DATE) AS event_date
        FROM (SELECT *, last_event_in_timeline AS d, {_CLEAN(q_policies._XML.format("family_summary"))} AS s, {_SECTORS.format("sector")} AS c FROM group_kfold_assignments)
        WHERE s <> '' AND len(c) > 0 AND trim(geography, ' ') <> '' AND regexp_matches(trim(d, ' '), '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}([T ].*)?$')) WHERE event_date IS NOT NULL""",
    "policies_for_chunking": f"SELECT row_id, fold, document_id, md5({_CLEAN('family_summary')}) AS summary_digest, {_CLEAN('geography')} AS geography, {_CLEAN('sector')} AS sector FROM group_kfold_assignments WHERE document_id <> ''",
    "policies_for_baselines": f"""SELECT g.row_id, fold, g.document_id, md5({_CLEAN('family_summary')}) AS summary_digest, coalesce(array_to_string(list_filter(list_transform(string_split(coalesce(keyword, ''), ';'), lambda p: {_squeeze('p')}), lambda p: p <> ''), ' '), '') AS keyword
        FROM group_kfold_assignments g JOIN all_data_en a ON a.row_id = g.row_id WHERE g.document_id <> '' AND {_CLEAN('family_summary')} <> ''""",
    "in_country_list": "SELECT row_id, geography FROM all_data_en WHERE trim(geography, ' ') IN (SELECT trim(country, ' ') FROM country_region)",
    "trainable_filings": "SELECT row_id, sector FROM all_data_en WHERE sector IS NOT NULL AND sector <> 'Other' AND last_event_in_timeline IS NOT NULL",
    "role_test_rows": """WITH d AS (SELECT DISTINCT document_id FROM chunk WHERE trim(document_id, ' ') <> ''), s AS (SELECT document_id, arg_max(family_summary, row_id) AS s FROM group_kfold_assignments WHERE document_id IS NOT NULL AND family_summary IS NOT NULL GROUP BY document_id),
        q AS (SELECT document_id, arg_min(text, chunk_id) AS q FROM chunk WHERE trim(document_id, ' ') <> '' AND trim(text, ' ') <> '' GROUP BY document_id)
        SELECT document_id, md5(coalesce(s, '')) AS summary_digest, md5(coalesce(q, '')) AS query_digest FROM d LEFT JOIN s USING (document_id) LEFT JOIN q USING (document_id)""",
    "feature_domains": """WITH k AS (SELECT DISTINCT feature, ['climate', 'socio', 'misc'][table_idx % 3 + 1] || '/' || printf('%06d', table_idx) AS path FROM time_series), d AS (SELECT path, printf('t%03d', row_number() OVER (ORDER BY path) - 1) AS tk, split_part(path, '/', 1) AS dom FROM (SELECT DISTINCT path FROM k)),
        f AS (SELECT DISTINCT tk || '__' || split_part(feature, '__', 2) AS feature, dom FROM k JOIN d USING (path)) SELECT feature, row_number() OVER (ORDER BY feature) - 1 AS feature_idx, CASE WHEN dom IN ('climate', 'socio') THEN dom ELSE 'other' END AS domain FROM f""",
    "metadata_text": f"WITH {_META} SELECT row_id, text FROM md",
    "table_blocks": f"""WITH {q_panel._CELLS}, r AS (SELECT table_idx, feature, year, '[ROW] ' || feature || ',' || printf('%.2f', year::DOUBLE) || ',' || printf('%.2f', sign(value) * floor(abs(value) * 100 + 0.5) / 100) AS l FROM cells WHERE country = 'meridia' AND year BETWEEN 2000 AND 2009)
        SELECT table_idx, '[START_OF_TABLE]' || chr(10) || 'Table ' || table_idx || chr(10) || string_agg(l, chr(10) ORDER BY feature, year) || chr(10) || '[END_OF_TABLE]' AS block FROM r GROUP BY table_idx""",
    "selector_semantic": f"WITH {_MATCHES} SELECT row_id, title, score, rank FROM md JOIN mt USING (text)",
    "selector_semantic_json": f"WITH {_MATCHES}, j AS (SELECT text, CAST(to_json(list(title ORDER BY rank)) AS VARCHAR) AS selected_titles FROM mt GROUP BY text) SELECT row_id, selected_titles FROM md JOIN j USING (text)",
    "answered_titles": f"WITH {_MATCHES} SELECT row_id, lower(title) AS title, rank FROM md JOIN mt USING (text) WHERE rank <= 2",
    "analysis_prompts": f"""WITH {q_panel._selected(q_panel._pearson_sql(), "-1")}, {_TITLES}
        SELECT country, region, year, tp.table_idx, k AS rank, concat_ws(chr(10), 'Analyse the following data of a policy''s country in one paragraph.', 'DATASET:', 'Title: ' || title, 'Focused Country Data: ' || country, {_SLICE.format(t="tp.table_idx", p="tp.country", y="tp.year")},
          CASE WHEN region <> '' THEN region || ' Data:' END, CASE WHEN region <> '' THEN {_SLICE.format(t="tp.table_idx", p="tp.region", y="tp.year")} END, 'World Data:', {_SLICE.format(t="tp.table_idx", p="'world'", y="tp.year")}) AS prompt FROM tp JOIN ti ON ti.table_idx = tp.table_idx WHERE k <= 3""",
    "judge_means": f"""WITH h AS (SELECT document_id, arg_max(family_summary, row_id) AS human FROM group_kfold_assignments WHERE trim(family_summary, ' ') <> '' AND document_id IS NOT NULL GROUP BY document_id),
        l AS (SELECT document_title AS a, unnest([{{'k': 'generated', 't': summary}}, {{'k': 'human', 't': human}}]) AS u FROM policy_document JOIN h USING (document_id)), w AS (SELECT u.k AS summary_type, {_WORDS.format("a")} AS a, {_WORDS.format("u.t")} AS b FROM l)
        SELECT summary_type, count(*) AS n, round(avg(CASE WHEN len(b) > 0 THEN len(list_intersect(a, b)) / len(b) END), 4) AS score_alignment, round(avg(CASE WHEN len(a) > 0 THEN len(list_intersect(a, b)) / len(a) END), 4) AS score_coverage,
        count(*) FILTER (len(b) = 0) AS n_errors_alignment, count(*) FILTER (len(a) = 0) AS n_errors_coverage FROM w GROUP BY summary_type""",
    "whole_document_topk": f"""WITH d AS (SELECT document_id, CAST(embedding AS DOUBLE[]) AS v FROM policy_document WHERE {q_retrieval._OK}), q AS (SELECT * FROM d WHERE TRY_CAST(regexp_extract(document_id, '[0-9]+') AS BIGINT) % 20 = 0),
        s AS (SELECT q.document_id AS query_id, d.document_id, round(CASE WHEN list_dot_product(q.v, q.v) = 0 OR list_dot_product(d.v, d.v) = 0 THEN 0 ELSE list_dot_product(q.v, d.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(d.v, d.v))) END, 10) AS score FROM q JOIN d ON q.document_id <> d.document_id)
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id) AS rank FROM s) WHERE rank <= 5""",
    "hit5_by_sector": f"""WITH {_S}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rn FROM s), f AS (SELECT r.query_id, r.document_id, min(rn) AS rn FROM r JOIN q USING (query_id) JOIN c USING (chunk_id) WHERE rn <= 1000 AND trim(q.sector, ' ') <> '' AND trim(q.sector, ' ') = trim(c.sector, ' ') GROUP BY ALL),
        g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rn) AS k FROM f) SELECT query_id, CAST(count(g.document_id) FILTER (g.k <= 5 AND g.document_id = q.target) > 0 AS INTEGER) AS hit FROM q LEFT JOIN g USING (query_id) GROUP BY query_id""",
    "any_overlap_hit": f"SELECT a.row_id, CAST(list_has_any({_SECTORS.format('a.sector')}, {_SECTORS.format('g.sector')}) AS INTEGER) AS hit FROM all_data_en a JOIN group_kfold_assignments g ON a.row_id = g.row_id",
    "document_ranking": f"WITH {_S} SELECT * FROM (SELECT query_id, document_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id) AS rank FROM d) WHERE rank <= 10",
    "hits_with_metadata": f"WITH {_HIT1}, p AS (SELECT document_id, min(geography) AS geography, min(approval_year) AS approval_year FROM policy_document GROUP BY document_id) SELECT query_id, document_id, hit1, geography, approval_year FROM h1 LEFT JOIN p USING (document_id)",
    "outcome_sample": f"""WITH {_HIT1}, x AS (SELECT h1.query_id, hit1, fold, row_number() OVER (PARTITION BY hit1, fold ORDER BY md5('5:' || h1.query_id), h1.query_id) AS k FROM h1 JOIN q USING (query_id))
        SELECT * FROM (SELECT query_id, hit1, row_number() OVER (PARTITION BY hit1 ORDER BY k, fold) AS sample_no FROM x) WHERE sample_no <= 20""",
    "normalized_results": f"WITH {_RES} SELECT experiment, fold, method, hit_10, mrr_10 FROM nr",
    "encoder_significance": f"""WITH {_RES}, l AS (UNPIVOT (SELECT fold, method, hit_10, mrr_10 FROM nr) ON hit_10, mrr_10 INTO NAME metric VALUE v), x AS (SELECT metric, round(z.v - a.v, 12) AS d FROM l a JOIN l z USING (metric, fold) WHERE a.method = 'mean|pool' AND z.method = 'max|pool')
        SELECT 'mean|pool' AS baseline, 'max|pool' AS candidate, metric, count(*) AS n, round(avg(d), 6) AS mean_diff, round(CASE WHEN count(*) >= 2 AND stddev_samp(d) <> 0 THEN avg(d) / (stddev_samp(d) / sqrt(count(*))) END, 6) AS t_stat FROM x GROUP BY metric""",
    "stability_by_seed": f"""WITH {_S}, {q_retrieval._FOLDED} SELECT method, fold AS seed, round(ndcg_10, 6) AS value, round(avg(ndcg_10) OVER w, 6) AS mean, round(CASE WHEN count(ndcg_10) OVER w > 1 THEN stddev_samp(ndcg_10) OVER w ELSE 0 END, 6) AS std FROM fm WINDOW w AS (PARTITION BY method)""",
    "graph_hazards": """WITH a AS (SELECT * FROM all_data_en WHERE trim(document_id) <> ''), e AS MATERIALIZED (""" + " UNION ALL ".join(q_policies._edge("PolicyDocument", "document_id", rel, label, "v", f"(SELECT document_id, unnest(string_split({c}, ';')) AS v FROM a)") for c, (rel, label) in HAZARDS.items()) + f"""),
        ap AS ({q_policies._edge("Country", "geography", "APPLIES", "PolicyDocument", "document_id", "a")}), r AS (SELECT DISTINCT ap.src, 'AT_RISK_OF' AS rel, e.dst FROM ap JOIN e ON e.src = ap.dst AND e.rel = 'ADDRESSES_HAZARD')
        SELECT rel, dst, count(*) AS n FROM (SELECT src, rel, dst FROM e UNION ALL SELECT src, rel, dst FROM r) GROUP BY ALL""",
    "best_trials": f"WITH {_S}, {q_retrieval._FOLDED} SELECT fold, params, val_loss FROM (SELECT fold, method AS params, round(1 - mrr_10, 6) AS val_loss, row_number() OVER (PARTITION BY fold ORDER BY round(1 - mrr_10, 6), method) AS r FROM fm) WHERE r = 1",
    "embedding_stub": f"WITH {_vectors('a', 'policy_document', 'summary', 32)} SELECT document_id, p AS place, round(v / n, 6) AS v FROM policy_document JOIN a ON a.x = summary JOIN an ON an.x = summary WHERE round(v / n, 6) <> 0",
    "generation_stub": r"SELECT document_id, CASE WHEN regexp_matches(summary, '\S') THEN array_to_string(regexp_extract_all(summary, '[^\s\x{1c}-\x{1f}\x{b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+')[1:40], ' ') END AS generated FROM policy_document",
}
SQL["feature_names_at"] = f"SELECT feature_idx, feature FROM ({SQL['feature_domains']}) WHERE feature_idx % 5 = 0 AND feature_idx <= 1000"
