"""Queries of folds, distributions, text functions, chunks, samples, overlaps, the graph and model seams, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from policygrid.functions import text
from policygrid.functions.ordering import seeded
from policygrid.operators import chunking, distribution, folds, graph, models, overlap_scores, sampling
from policygrid.plans.q_panel import SPACES, XML as _XML, even, squeeze as _squeeze
from policygrid.session import durable, table


def _filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "all_data_en")


def _folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "group_kfold_assignments")


def grouped_kfold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.grouped_kfold(_filings(spark, sf_dir).select("row_id", "family_id", "family_title", "document_id")).select("row_id", "group_key", F.col("fold").cast("bigint").alias("fold"))


def fold_leakage_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families of the given assignments that lie in several folds."""
    g = _folded(spark, sf_dir).where("trim(family_id) <> '' and fold is not null").withColumn("group_key", F.trim("family_id"))
    return folds.leaking_groups(g)


def fold_train_test_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.fold_sizes(_folded(spark, sf_dir))


def _folds(spark: SparkSession, sf_dir: str) -> list[int]:
    return sorted(r[0] for r in _folded(spark, sf_dir).where("fold is not null").select("fold").distinct().collect())


def fold_train_without_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train rows of each held-out fold whose document is not also in its test rows."""
    g = _folded(spark, sf_dir).where("document_id is not null and fold is not null").select("row_id", "document_id", "fold")
    test = g.select("document_id", F.col("fold").alias("held")).distinct()
    return folds.held_out(g, _folds(spark, sf_dir)).join(test, ["document_id", "held"], "left_anti").select("held", "row_id", "document_id", F.col("fold").cast("bigint").alias("fold"))


def first_valid_group_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _filings(spark, sf_dir).withColumn("internal_family_id", F.lit(" "))
    keyed = a.select(folds.group_key(a, ("internal_family_id", "family_title", "document_id")).alias("group_key"))
    return keyed.groupBy("group_key").agg(F.count(F.lit(1)).alias("n"))


def region_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _filings(spark, sf_dir).select("row_id", "geography_iso")
    return folds.join_region(p, table(spark, sf_dir, "country_region"), "geography_iso", "alpha_3", ["region_name", "sub_region", "intermediate_region"])


def region_share_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the regions among train and test rows of each held-out fold side by side."""
    g = _folded(spark, sf_dir).where("fold is not null and region_name is not null").groupBy(F.col("region_name").alias("region"), "fold").agg(F.count(F.lit(1)).alias("n"))
    each = folds.counts_per_fold(g, "region", _folds(spark, sf_dir))
    pct = lambda c: F.round(F.coalesce(F.try_divide(F.col(c) * 100.0, F.sum(c).over(W.partitionBy("fold"))), F.lit(0.0)), 6)
    return each.select("fold", "region", pct("n_train").alias("train_pct"), pct("n_test").alias("test_pct"))


def multivalue_sector_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = distribution.sector_share(_folded(spark, sf_dir).where("fold is not null"), "sector", ["fold"])
    return s.select(F.col("fold").cast("bigint").alias("fold"), "sector", "n", F.round("pct", 6).alias("pct"))


def country_counts_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train and test rows of each country in each held-out fold, 0 where there are none."""
    g = _folded(spark, sf_dir).where("fold is not null and alpha_3 is not null").groupBy("alpha_3", "fold").agg(F.count(F.lit(1)).alias("n"))
    return folds.counts_per_fold(g, "alpha_3", _folds(spark, sf_dir))


def label_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distribution.label_codes(table(spark, sf_dir, "country_region"), "sub_region", "R")


def validation_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fifth of the train rows of each held-out fold."""
    return folds.validation_splits(_folded(spark, sf_dir).where("fold is not null"), "row_id", 0.2, _folds(spark, sf_dir), 7)


def regional_test_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.regional_test_pick(_folded(spark, sf_dir), "row_id", "region_name", "alpha_3", 40, 3).select("row_id", "region_name", "alpha_3")


def fold_set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many geographies filings and chunks have in common, in either, and only on one side."""
    a = _filings(spark, sf_dir).select("geography").where("geography is not null")
    b = table(spark, sf_dir, "chunk").select("geography").where("geography is not null")
    parts = [("both", a.intersect(b)), ("either", a.union(b).distinct()), ("filings_only", a.subtract(b)), ("chunks_only", b.subtract(a))]
    rows = [d.agg(F.lit(n).alias("side"), F.count(F.lit(1)).alias("n")) for n, d in parts]
    return rows[0].union(rows[1]).union(rows[2]).union(rows[3])


def html_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _folded(spark, sf_dir).select("row_id", text.clean_html(F.col("family_summary")).alias("clean"))


def html_clean_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With every HTML entity."""
    return _folded(spark, sf_dir).select("row_id", text.clean_html(F.col("family_summary"), full=True).alias("clean"))


def whitespace_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.clean_text(F.col("text"))).alias("digest"))


def keyword_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filings(spark, sf_dir).select("row_id", text.clean_keywords(F.col("keyword")).alias("clean"))


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents").select(F.explode(text.tokens(F.col("text"))).alias("token"))
    return t.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def filename_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "country_region").select("country", text.safe_filename(F.col("country")).alias("file_name"), text.slug(F.col("sub_region")).alias("slug"))


def ascii_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.ascii_only(F.col("text"))).alias("digest"))


def policy_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filings(spark, sf_dir).select("row_id", text.policy_year(F.col("last_event_in_timeline")).alias("year"))


def instrument_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = _filings(spark, sf_dir).select(F.explode(text.split_plain(F.col("instrument"))).alias("i"))
    return i.select(text.instrument_name(F.col("i")).alias("name"), text.instrument_type(F.col("i")).alias("kind")).where("name is not null").groupBy("name", "kind").agg(F.count(F.lit(1)).alias("n"))


def text_path_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    from policygrid.sources.readers import resolve_texts

    return resolve_texts(_filings(spark, sf_dir).select("row_id", "text_file_path"), table(spark, sf_dir, "text_files"), ["texts"])


def json_title_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of two JSON paths that is there, counted."""
    e = table(spark, sf_dir, "events")
    v = F.coalesce(F.get_json_object("props", "$.title"), F.get_json_object("props", "$.k"), F.lit("none"))
    return e.groupBy(v.alias("title")).agg(F.count(F.lit(1)).alias("n"))


def metadata_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk metadata read from a map under alias names."""
    m = table(spark, sf_dir, "chunk").select("chunk_id", F.create_map(F.lit("Document ID"), F.lit(" "), F.lit("doc_id"), F.col("document_id"), F.lit("Fold"), F.lit("x"), F.lit("fold"), F.col("fold").cast("string")).alias("m"))
    return m.select("chunk_id", chunking.read_alias(F.col("m"), "document_id", "Document ID", "doc_id").alias("document_id"), chunking.read_alias_int(F.col("m"), "Fold", "fold").alias("fold"))


def metadata_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with geography and sector of their policy where they differ."""
    wanted = _filings(spark, sf_dir).where("trim(document_id) <> ''").groupBy("document_id").agg(F.min_by("geography", "row_id").alias("geography"), F.min_by("sector", "row_id").alias("sector"))
    c = table(spark, sf_dir, "chunk").select("chunk_id", "document_id", "geography", "sector")
    return chunking.upsert_metadata(c, wanted, "document_id", ["geography", "sector"]).select("chunk_id", "geography", "sector", "updated")


def metadata_upsert_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata_upsert(spark, sf_dir).agg(F.count(F.lit(1)).alias("scanned"), F.count_if("updated").alias("updated"))


def chunk_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks different in text, document, source, geography and sector."""
    c = table(spark, sf_dir, "chunk").where("trim(document_id) <> '' and trim(text) <> ''")
    return chunking.distinct_chunks(c.select("chunk_id", F.md5("text").alias("digest"), "document_id", "source", "geography", "sector"), ["digest", "document_id", "source", "geography", "sector"], "chunk_id")


def chunk_fixed_stride(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunking.stride_chunks(table(spark, sf_dir, "text_files"), "text_file_path", "page_content")
    return c.select("text_file_path", F.col("start_index").cast("bigint").alias("start_index"), F.col("n_chars").cast("bigint").alias("n_chars"))


def chunk_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_documents(table(spark, sf_dir, "documents"), "doc_id", "text").select("document_id", "start_index", "chunk_id", F.length("text").alias("n_chars"))


def stratified_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """25 rows per fold, taking turns between regions."""
    g = _folded(spark, sf_dir).where("fold is not null and region_name is not null").select("row_id", "fold", "region_name")
    return sampling.round_robin(g, "region_name", 25, "row_id", 5, ["fold"]).select("row_id", F.col("fold").cast("bigint").alias("fold"), "region_name", F.col("sample_no").cast("bigint").alias("sample_no"))


def simple_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.simple_sample(_folded(spark, sf_dir).select("row_id"), "row_id", 50, 9)


def strata_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _folded(spark, sf_dir).where("region_name is not null").withColumn("stratum", F.coalesce(F.concat(F.lit("fold "), F.col("fold").cast("string")), F.lit("no fold")))
    regions = [r[0] for r in table(spark, sf_dir, "country_region").select("region_name").distinct().orderBy("region_name").collect()]  # a fixed list
    wide = distribution.contingency(g, "stratum", "region_name", regions)
    return wide.select("stratum", F.explode(F.map_from_arrays(F.array(*[F.lit(r) for r in regions]), F.array(*[F.col(f"`{r}`") for r in regions]))).alias("region", "n"))


def continent_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    look = table(spark, sf_dir, "country_region").select("country", F.col("region_name").alias("continent"))
    return sampling.with_continent(_filings(spark, sf_dir).select("row_id", "geography"), "geography", look).groupBy("continent").agg(F.count(F.lit(1)).alias("n"))


def metadata_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _filings(spark, sf_dir)
    return a.select("row_id", sampling.metadata_context(a, {"sector": "Sector", "category": "Category"}, ["geography", "lang"]).alias("context"))


def inverted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The different features of each unit."""
    t = table(spark, sf_dir, "time_series").where(~text.is_stand_in(F.col("unit")))
    return distribution.inverted_index(t, "feature", F.array(F.trim("unit")), "unit")


def cached_key_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _folded(spark, sf_dir).where("fold is not null and document_id is not null")
    part = lambda n, c: F.concat(F.lit(f"{n}="), c.cast("string"))
    return g.select("row_id", models.cache_key(part("fold", F.col("fold")), part("idx", F.col("row_id")), part("doc_id", F.col("document_id"))).alias("cache_key"))


def hparam_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """24 of the combinations of learning rate, margin, width and batch size."""
    axes = {"lr": [1e-4, 3e-4, 1e-3], "margin": [0.2, 0.5, 1.0], "width": [64.0, 128.0], "batch": [16.0, 32.0]}
    grid = spark.range(1)
    for name, values in axes.items():
        grid = grid.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in axes])
    return sampling.grid_sample(grid.drop("id").withColumn("trial", key), "trial", 24, 1)


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's policy summary beside the family summary of its last filing."""
    h = _folded(spark, sf_dir).where("trim(family_summary) <> '' and document_id is not null").groupBy("document_id").agg(F.max_by("family_summary", "row_id").alias("human"))
    return table(spark, sf_dir, "policy_document").select("document_id", F.col("summary").alias("generated")).join(h, "document_id")


def _rouge12(spark: SparkSession, sf_dir: str, stem: bool) -> DataFrame:
    p = durable(_pairs(spark, sf_dir), "pairs")
    return overlap_scores.rouge_n(p, "document_id", "generated", "human", 1, stem).join(overlap_scores.rouge_n(p, "document_id", "generated", "human", 2, stem), "document_id")


def rouge12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With stemming, which SQL here can't say; tested against a brute force."""
    return _rouge12(spark, sf_dir, True)


def rouge12_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words as they stand."""
    return _rouge12(spark, sf_dir, False)


def rouge_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap_scores.rouge_l(_pairs(spark, sf_dir), "document_id", "generated", "human")


LISTS = {"sector": ("IN_SECTOR", "Sector"), "keyword": ("HAS_KEYWORD", "Keyword")}


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _filings(spark, sf_dir).where("trim(document_id) <> ''")
    return graph.policy_edges(a, LISTS, F.split("instrument", ";")).unionByName(graph.hierarchy(table(spark, sf_dir, "country_region")))


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir).groupBy("src_label", "rel", "dst_label").agg(F.count(F.lit(1)).alias("n"))


def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.nodes(_edges(spark, sf_dir)).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def graph_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.hierarchy(table(spark, sf_dir, "country_region"))


def graph_related_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.related_documents(_filings(spark, sf_dir))


def graph_chunk_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.chunk_edges(table(spark, sf_dir, "chunk")).select("src", "dst")


def graph_entity_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that apply in Meridia and are in the sector Energy."""
    return graph.entity_lookup(_edges(spark, sf_dir), [("Country", "Meridia"), ("Sector", "Energy")])


def graph_qa_sectors_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents each sector has in each region: three hops and a count."""
    e = durable(_edges(spark, sf_dir), "edges")
    up = e.where("rel = 'IS_PART_OF'")
    region = up.where("src_label = 'Country'").select(F.col("src").alias("country"), F.col("dst").alias("mid")).join(up.where("src_label = 'SubRegion'").select(F.col("src").alias("mid"), F.col("dst").alias("region")), "mid")
    docs = e.where("rel = 'APPLIES'").select(F.col("src").alias("country"), F.col("dst").alias("doc")).join(region.select("country", "region").distinct(), "country").select("doc", "region").distinct()
    sectors = e.where("rel = 'IN_SECTOR'").select(F.col("src").alias("doc"), F.col("dst").alias("sector"))
    return docs.join(sectors, "doc").groupBy("region", "sector").agg(F.count_distinct("doc").alias("n_docs"))


def graph_qa_latest_by_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last approval year and the number of documents of each country."""
    e = durable(_edges(spark, sf_dir), "edges")
    years = e.where("rel = 'EFFECTIVE_FROM'").groupBy(F.col("src").alias("doc")).agg(F.max(F.col("dst").try_cast("int")).alias("y"))
    a = e.where("rel = 'APPLIES'").select(F.col("src").alias("country"), F.col("dst").alias("doc"))
    return a.join(years, "doc", "left").groupBy("country").agg(F.count_distinct("doc").alias("n_docs"), F.max("y").alias("last_year"))


def graph_qa_instrument_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents use instruments of each type."""
    e = durable(_edges(spark, sf_dir), "edges")
    used = e.where("rel = 'USES_INSTRUMENT'").select(F.col("src").alias("doc"), F.col("dst").alias("name"))
    kind = e.where("rel = 'IS_INSTRUMENT_TYPE'").select(F.col("src").alias("name"), F.col("dst").alias("kind"))
    return used.join(kind, "name").groupBy("kind").agg(F.count_distinct("doc").alias("n_docs"))


def advisor_stub(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "policy_document").select("document_id", "summary", "document_title", "geography")
    return models.advisor_chain(d, {"climate": "summary", "socio": "document_title", "other": "geography"}, models.Extract).select("document_id", "compact")


def encoder_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text tower over hashed word vectors of the summaries."""
    d = models.embed_column(table(spark, sf_dir, "policy_document").select("document_id", "summary"), "summary", models.HashedWords(32))
    e = models.encode_texts(d, "embedding", models.DualEncoder.seeded(4, 22, 32, 8))
    return e.select("document_id", F.array_join(F.transform("encoded", lambda x: F.format_string("%.4f", x)), " ").alias("vector"))


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling hours per event type: the plan that the stream of events runs, over all rows at once."""
    e = table(spark, sf_dir, "events")
    g = e.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select("event_type", F.col("window.start").cast("timestamp_ntz").alias("window_start"), "n", "total")


def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions per user with a gap of 30 minutes."""
    e = table(spark, sf_dir, "events").groupBy(F.session_window("ts", "30 minutes"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return e.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("session_start"), "n")


QUERIES = {
    f.__name__: f
    for f in (
        grouped_kfold, fold_leakage_check, fold_train_test_counts, fold_train_without_test, first_valid_group_key, region_left_join, region_share_pct, multivalue_sector_share, country_counts_outer,
        label_codes, validation_split, regional_test_pick, fold_set_operations, html_clean, html_clean_full, whitespace_clean, keyword_clean, token_counts, filename_sanitize, ascii_sanitize,
        policy_years, instrument_parse, text_path_resolution, json_title_fallback, metadata_alias, metadata_upsert, metadata_upsert_counts, chunk_dedupe, chunk_fixed_stride, chunk_words,
        stratified_round_robin, simple_sample, strata_crosstab, continent_lookup, metadata_context, inverted_index, cached_key_sha256, hparam_grid, rouge12, rouge12_plain, rouge_l, graph_edges, graph_nodes,
        graph_hierarchy, graph_related_docs, graph_chunk_edges, graph_entity_lookup, graph_qa_sectors_by_region, graph_qa_latest_by_country, graph_qa_instrument_types, advisor_stub, encoder_forward, event_windows, event_sessions,
    )
}

def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^{SPACES}|{SPACES}$', '', 'g')"


def _edge(src_label: str, src: str, rel: str, dst_label: str, dst: str, frm: str) -> str:
    return f"SELECT DISTINCT '{src_label}' AS src_label, trim({src}) AS src, '{rel}' AS rel, '{dst_label}' AS dst_label, trim({dst}) AS dst FROM {frm} WHERE trim({src}) <> '' AND trim({dst}) <> ''"


_LEVEL = "list_filter([CASE WHEN trim(country) <> '' THEN {'label': 'Country', 'name': trim(country)} END, CASE WHEN trim(sub_region) <> '' THEN {'label': 'SubRegion', 'name': trim(sub_region)} END, CASE WHEN trim(region_name) <> '' THEN {'label': 'Region', 'name': trim(region_name)} END], lambda x: x IS NOT NULL)"
_HIER = f"SELECT DISTINCT s[1].label AS src_label, s[1].name AS src, 'IS_PART_OF' AS rel, s[2].label AS dst_label, s[2].name AS dst FROM (SELECT unnest(list_zip(l[1:len(l) - 1], l[2:])) AS s FROM (SELECT {_LEVEL} AS l FROM country_region))"
_YEAR = "CASE WHEN regexp_full_match(trim(split_part(last_event_in_timeline, '-', 1)), '[+]?[0-9]{1,9}') THEN CAST(trim(split_part(last_event_in_timeline, '-', 1)) AS INTEGER) END"
_E = "WITH a AS (SELECT *, " + _YEAR + " AS y FROM all_data_en WHERE trim(document_id) <> ''), i AS (SELECT document_id, unnest(string_split(instrument, ';')) AS i FROM a), e AS MATERIALIZED (" + " UNION ALL ".join([
    _edge("PolicyDocument", "document_id", "EFFECTIVE_FROM", "ApprovalYear", "CAST(y AS VARCHAR)", "a"), _edge("PolicyDocument", "document_id", "IS_OF_TYPE", "DocumentType", "document_role", "a"),
    _edge("Country", "geography", "APPLIES", "PolicyDocument", "document_id", "a"),
    *[_edge("PolicyDocument", "document_id", rel, label, "v", f"(SELECT document_id, unnest(string_split({c}, ';')) AS v FROM a)") for c, (rel, label) in LISTS.items()],
    _edge("PolicyDocument", "document_id", "USES_INSTRUMENT", "PolicyInstrument", "split_part(i, '|', 1)", "i"), _edge("PolicyInstrument", "split_part(i, '|', 1)", "IS_INSTRUMENT_TYPE", "InstrumentType", "split_part(i, '|', 2)", "i"), _HIER,
]) + ")"


def _rouge(n: int) -> str:
    tok = "regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9]+')"
    gram = tok if n == 1 else "list_transform(list_zip(" + tok + "[:-2], " + tok + "[2:]), lambda z: z[1] || ' ' || z[2])"
    side = f"SELECT document_id, {{1}} AS side, unnest({gram}) AS x FROM p"
    return f"""l{n} AS ({side.format("generated", 0)} UNION ALL {side.format("human", 1)}), c{n} AS (SELECT document_id, x, count(*) FILTER (side = 0) AS g, count(*) FILTER (side = 1) AS h FROM l{n} GROUP BY ALL),
      s{n} AS (SELECT document_id, CAST(sum(least(g, h)) AS DOUBLE) AS m, sum(g) AS g, sum(h) AS h FROM c{n} GROUP BY document_id),
      r{n} AS (SELECT document_id, round(CASE WHEN m > 0 THEN 2 * (m / g) * (m / h) / (m / g + m / h) ELSE 0 END, 6) AS rouge{n} FROM s{n})"""


SQL = {
    "grouped_kfold": f"""WITH k AS (SELECT row_id, coalesce(nullif({_strip('family_id')}, ''), 'UNKNOWN_FAMILY') AS group_key FROM all_data_en),
        g AS (SELECT group_key, (row_number() OVER (ORDER BY md5('42:' || group_key), group_key) - 1) % 5 AS fold FROM (SELECT DISTINCT group_key FROM k)) SELECT row_id, group_key, fold FROM k JOIN g USING (group_key)""",
    "fold_leakage_check": "SELECT trim(family_id) AS group_key, count(DISTINCT fold) AS n_folds FROM group_kfold_assignments WHERE trim(family_id) <> '' AND fold IS NOT NULL GROUP BY 1 HAVING min(fold) <> max(fold)",
    "fold_train_test_counts": "SELECT fold, CAST(sum(count(*)) OVER () - count(*) AS BIGINT) AS n_train, count(*) AS n_test FROM group_kfold_assignments WHERE fold IS NOT NULL GROUP BY fold",
    "fold_train_without_test": """WITH g AS (SELECT row_id, document_id, fold FROM group_kfold_assignments WHERE document_id IS NOT NULL AND fold IS NOT NULL), f AS (SELECT DISTINCT fold AS held FROM group_kfold_assignments WHERE fold IS NOT NULL)
        SELECT held, row_id, document_id, CAST(fold AS BIGINT) AS fold FROM f JOIN g ON fold <> held WHERE NOT EXISTS (SELECT 1 FROM g t WHERE t.fold = held AND t.document_id = g.document_id)""",
    "first_valid_group_key": f"SELECT coalesce(nullif({_strip('family_title')}, ''), 'UNKNOWN_FAMILY') AS group_key, count(*) AS n FROM all_data_en GROUP BY 1",
    "region_left_join": "SELECT row_id, geography_iso, region_name, sub_region, intermediate_region FROM all_data_en LEFT JOIN country_region ON geography_iso = alpha_3",
    "region_share_pct": """WITH g AS (SELECT region_name AS region, fold FROM group_kfold_assignments WHERE fold IS NOT NULL AND region_name IS NOT NULL), f AS (SELECT DISTINCT fold AS held FROM group_kfold_assignments WHERE fold IS NOT NULL),
        s AS (SELECT held, region, count(*) FILTER (fold <> held) AS a, count(*) FILTER (fold = held) AS b FROM f, g GROUP BY ALL)
        SELECT held AS fold, region, round(coalesce(a * 100.0::DOUBLE / nullif(sum(a) OVER (PARTITION BY held), 0), 0), 6) AS train_pct, round(coalesce(b * 100.0::DOUBLE / nullif(sum(b) OVER (PARTITION BY held), 0), 0), 6) AS test_pct FROM s""",
    "multivalue_sector_share": """WITH x AS (SELECT fold, trim(unnest(string_split(sector, ';')), ' ') AS sector FROM group_kfold_assignments WHERE fold IS NOT NULL)
        SELECT CAST(fold AS BIGINT) AS fold, sector, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (PARTITION BY fold), 6) AS pct FROM x WHERE sector NOT IN ('', 'Other') GROUP BY fold, sector""",
    "country_counts_outer": """WITH g AS (SELECT alpha_3, fold FROM group_kfold_assignments WHERE fold IS NOT NULL AND alpha_3 IS NOT NULL), f AS (SELECT DISTINCT fold AS held FROM group_kfold_assignments WHERE fold IS NOT NULL)
        SELECT held AS fold, alpha_3, count(*) FILTER (fold <> held) AS n_train, count(*) FILTER (fold = held) AS n_test FROM f, g GROUP BY ALL""",
    "label_codes": "SELECT sub_region, printf('R%02d', row_number() OVER (ORDER BY sub_region)) AS code FROM (SELECT DISTINCT sub_region FROM country_region WHERE sub_region IS NOT NULL)",
    "validation_split": """WITH f AS (SELECT DISTINCT fold AS held FROM group_kfold_assignments WHERE fold IS NOT NULL),
        g AS (SELECT held, row_id, row_number() OVER (PARTITION BY held ORDER BY md5('7:' || row_id), row_id) AS r, count(*) OVER (PARTITION BY held) AS n FROM group_kfold_assignments, f WHERE fold <> held)
        SELECT held, row_id, r <= least(greatest(1, floor(n * 0.2::DOUBLE + 0.5)), n - 1) AS is_validation FROM g""",
    "regional_test_pick": """WITH c AS (SELECT row_id, region_name, alpha_3, md5('3:' || row_id) AS o FROM group_kfold_assignments WHERE region_name IS NOT NULL AND alpha_3 IS NOT NULL),
        b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY alpha_3 ORDER BY o, row_id) AS k FROM c) WHERE k = 1), l AS (SELECT *, row_number() OVER (PARTITION BY region_name ORDER BY o, row_id) AS r FROM b)
        SELECT row_id, region_name, alpha_3 FROM l ORDER BY CASE WHEN r = 1 THEN 0 ELSE 1 END, o, row_id LIMIT 40""",
    "fold_set_operations": """WITH a AS (SELECT DISTINCT geography AS g FROM all_data_en WHERE geography IS NOT NULL), b AS (SELECT DISTINCT geography AS g FROM chunk WHERE geography IS NOT NULL)
        SELECT 'both' AS side, count(*) AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'either', count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)
        UNION ALL SELECT 'filings_only', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'chunks_only', count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""",
    "html_clean": f"SELECT row_id, coalesce({_squeeze(_XML.format('family_summary'))}, '') AS clean FROM group_kfold_assignments",
    "whitespace_clean": f"SELECT doc_id, md5(coalesce({_squeeze('text')}, '')) AS digest FROM documents",
    "keyword_clean": f"SELECT row_id, coalesce(array_to_string(list_filter(list_transform(string_split(coalesce(keyword, ''), ';'), lambda p: {_squeeze('p')}), lambda p: p <> ''), ' '), '') AS clean FROM all_data_en",
    "token_counts": "SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM documents) GROUP BY token",
    "filename_sanitize": "SELECT country, coalesce(nullif(trim(regexp_replace(country, '[^A-Za-z0-9._-]+', '_', 'g'), '_'), ''), 'unknown') AS file_name, replace(lower(sub_region), ' ', '-') AS slug FROM country_region",
    "ascii_sanitize": r"SELECT doc_id, md5(regexp_replace(text, '[^\x00-\x7F]+', ' ', 'g')) AS digest FROM documents",
    "policy_years": f"SELECT row_id, {_YEAR} AS year FROM all_data_en",
    "instrument_parse": "WITH i AS (SELECT unnest(string_split(instrument, ';')) AS i FROM all_data_en) SELECT nullif(trim(split_part(i, '|', 1)), '') AS name, nullif(trim(split_part(i, '|', 2)), '') AS kind, count(*) AS n FROM i WHERE trim(split_part(i, '|', 1)) <> '' GROUP BY ALL",
    "json_title_fallback": "SELECT coalesce(json_extract_string(props, '$.title'), json_extract_string(props, '$.k'), 'none') AS title, count(*) AS n FROM events GROUP BY 1",
    "metadata_alias": "SELECT chunk_id, coalesce(nullif(trim(document_id), ''), '') AS document_id, fold FROM chunk",
    "metadata_upsert": """WITH w AS (SELECT document_id, trim(coalesce(arg_min_null(geography, row_id), '')) AS g, trim(coalesce(arg_min_null(sector, row_id), '')) AS s FROM all_data_en WHERE trim(document_id) <> '' GROUP BY document_id)
        SELECT chunk_id, CASE WHEN g <> '' AND g IS DISTINCT FROM geography THEN g ELSE geography END AS geography, CASE WHEN s <> '' AND s IS DISTINCT FROM sector THEN s ELSE sector END AS sector,
        coalesce((g <> '' AND g IS DISTINCT FROM geography) OR (s <> '' AND s IS DISTINCT FROM sector), false) AS updated FROM chunk LEFT JOIN w USING (document_id)""",
    "chunk_dedupe": "SELECT md5(text) AS digest, document_id, source, geography, sector, min(chunk_id) AS chunk_id FROM chunk WHERE trim(document_id) <> '' AND trim(text) <> '' GROUP BY ALL",
    "chunk_fixed_stride": "SELECT text_file_path, s AS start_index, CAST(least(1500, n - s) AS BIGINT) AS n_chars FROM (SELECT text_file_path, length(page_content) AS n, unnest(range(0, greatest(length(page_content) - 200, 1), 1300)) AS s FROM text_files WHERE length(page_content) > 0)",
    "stratified_round_robin": """WITH g AS (SELECT *, row_number() OVER (PARTITION BY fold, region_name ORDER BY md5('5:' || row_id), row_id) AS k FROM group_kfold_assignments WHERE fold IS NOT NULL AND region_name IS NOT NULL),
        s AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY k, region_name) AS sample_no FROM g) SELECT row_id, CAST(fold AS BIGINT) AS fold, region_name, sample_no FROM s WHERE sample_no <= 25""",
    "simple_sample": "SELECT row_id FROM group_kfold_assignments ORDER BY md5('9:' || row_id), row_id LIMIT 50",
    "strata_crosstab": """WITH g AS (SELECT coalesce('fold ' || fold, 'no fold') AS stratum, region_name AS region FROM group_kfold_assignments WHERE region_name IS NOT NULL)
        SELECT s.stratum, r.region, count(g.region) AS n FROM (SELECT DISTINCT stratum FROM g) s CROSS JOIN (SELECT DISTINCT region_name AS region FROM country_region) r LEFT JOIN g ON g.stratum = s.stratum AND g.region = r.region GROUP BY ALL""",
    "continent_lookup": "SELECT coalesce(region_name, 'Other') AS continent, count(*) AS n FROM all_data_en LEFT JOIN country_region ON trim(geography) = trim(country) GROUP BY 1",
    "metadata_context": """WITH a AS (SELECT row_id, geography, lang, CASE WHEN lower(trim(coalesce(sector, ''))) NOT IN ('', 'nan', 'none') THEN 'Sector: ' || trim(sector) END AS s, CASE WHEN lower(trim(coalesce(category, ''))) NOT IN ('', 'nan', 'none') THEN 'Category: ' || trim(category) END AS c FROM all_data_en)
        SELECT row_id, CASE WHEN s IS NOT NULL OR c IS NOT NULL THEN concat_ws(chr(10), s, c) ELSE coalesce(trim(geography), '') || ', ' || coalesce(trim(lang), '') END AS context FROM a""",
    "inverted_index": f"SELECT DISTINCT trim(unit) AS unit, feature FROM time_series WHERE unit IS NOT NULL AND lower(regexp_replace(unit, '{SPACES}', '', 'g')) NOT IN ({', '.join(chr(39) + v + chr(39) for v in text.NO_VALUE_EVEN)})",
    "cached_key_sha256": "SELECT row_id, sha256('fold=' || fold || '|idx=' || row_id || '|doc_id=' || document_id) AS cache_key FROM group_kfold_assignments WHERE fold IS NOT NULL AND document_id IS NOT NULL",
    "rouge12_plain": f"""WITH h AS (SELECT document_id, arg_max(family_summary, row_id) AS human FROM group_kfold_assignments WHERE trim(family_summary) <> '' AND document_id IS NOT NULL GROUP BY document_id),
        p AS MATERIALIZED (SELECT document_id, summary AS generated, human FROM policy_document JOIN h USING (document_id)), {_rouge(1)}, {_rouge(2)}
        SELECT p.document_id, coalesce(rouge1, 0) AS rouge1, coalesce(rouge2, 0) AS rouge2 FROM p LEFT JOIN r1 USING (document_id) LEFT JOIN r2 USING (document_id)""",
    "graph_edges": f"{_E} SELECT src_label, rel, dst_label, count(*) AS n FROM e GROUP BY ALL",
    "graph_nodes": f"{_E} SELECT label, count(*) AS n FROM (SELECT src_label AS label, src AS key FROM e UNION SELECT dst_label, dst FROM e) GROUP BY label",
    "graph_hierarchy": _HIER,
    "graph_related_docs": """WITH d AS (SELECT DISTINCT trim(document_id) AS document_id, trim(family_title) AS family_title FROM all_data_en WHERE trim(document_id) <> '' AND trim(family_title) <> '')
        SELECT a.family_title, a.document_id, count(*) AS n_related FROM d a JOIN d b ON a.family_title = b.family_title AND a.document_id <> b.document_id GROUP BY ALL""",
    "graph_chunk_edges": "SELECT DISTINCT trim(document_id) AS src, trim(chunk_id) AS dst FROM chunk WHERE trim(document_id) <> '' AND trim(chunk_id) <> ''",
    "graph_entity_lookup": f"{_E} SELECT dst AS document_id FROM e WHERE rel = 'APPLIES' AND src = 'Meridia' INTERSECT SELECT src FROM e WHERE dst_label = 'Sector' AND dst = 'Energy'",
    "graph_qa_sectors_by_region": f"""{_E} SELECT r.dst AS region, s.dst AS sector, count(DISTINCT s.src) AS n_docs FROM e a JOIN e m ON m.rel = 'IS_PART_OF' AND m.src_label = 'Country' AND m.src = a.src JOIN e r ON r.rel = 'IS_PART_OF' AND r.src_label = 'SubRegion' AND r.src = m.dst
        JOIN e s ON s.rel = 'IN_SECTOR' AND s.src = a.dst WHERE a.rel = 'APPLIES' GROUP BY ALL""",
    "graph_qa_latest_by_country": f"{_E} SELECT a.src AS country, count(DISTINCT a.dst) AS n_docs, max(TRY_CAST(y.dst AS INTEGER)) AS last_year FROM e a LEFT JOIN e y ON y.rel = 'EFFECTIVE_FROM' AND y.src = a.dst WHERE a.rel = 'APPLIES' GROUP BY a.src",
    "graph_qa_instrument_types": f"{_E} SELECT k.dst AS kind, count(DISTINCT u.src) AS n_docs FROM e u JOIN e k ON k.rel = 'IS_INSTRUMENT_TYPE' AND k.src = u.dst WHERE u.rel = 'USES_INSTRUMENT' GROUP BY k.dst",
    "event_windows": "SELECT event_type, date_trunc('hour', ts) AS window_start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "event_sessions": """WITH x AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
        s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM x) SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, k""",
}
_PATH = lambda c: rf"nullif(regexp_replace(regexp_replace({_strip(c)}, '[/\\]+', '/', 'g'), '^(/|\.\.?/)+', ''), '')"
SQL["text_path_resolution"] = f"""WITH r AS (SELECT row_id, {_PATH("text_file_path")} AS p FROM all_data_en), f AS (SELECT {_PATH("text_file_path")} AS k, text_file_path AS path FROM text_files),
    c AS (SELECT row_id, unnest([1, 2, 3]) AS place, unnest([p, 'texts/' || p, 'data/' || p]) AS k FROM r) SELECT row_id, arg_min(path, (place, path)) AS path FROM c JOIN f USING (k) GROUP BY row_id"""
SQL["hparam_grid"] = """WITH g AS (SELECT lr, margin, width, batch, l || '|' || m || '|' || w || '|' || b AS trial FROM (VALUES (0.0001::DOUBLE, '1.0E-4'), (0.0003, '3.0E-4'), (0.001, '0.001')) AS a(lr, l), (VALUES (0.2::DOUBLE, '0.2'), (0.5, '0.5'), (1.0, '1.0')) AS c(margin, m),
    (VALUES (64.0::DOUBLE, '64.0'), (128.0, '128.0')) AS d(width, w), (VALUES (16.0::DOUBLE, '16.0'), (32.0, '32.0')) AS e(batch, b)) SELECT * FROM g ORDER BY md5('1:' || trial), trial LIMIT 24"""
SQL["html_clean_full"] = SQL["html_clean"]  # to the entities that SQL resolves
SQL["metadata_upsert_counts"] = f"SELECT count(*) AS scanned, count(*) FILTER (updated) AS updated FROM ({SQL['metadata_upsert']})"
