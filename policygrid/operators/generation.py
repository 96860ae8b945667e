"""Selection of tables by meaning, and the staged generation of summaries from tables and chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from policygrid.functions.ordering import top_per
from policygrid.functions.text import clean_text
from policygrid.operators.models import Embedder, Generator, advisor_chain, cache_key, embed_column, generate_column, parse_selected_titles, two_decimals
from policygrid.operators.retrieval import block_cosine
from policygrid.operators.tiles import Tiles
from policygrid.session import durable, require_columns

#: Labels of the lines of a policy's metadata, in order. Fixed values.
METADATA_LINES = ("Targeted Sector", "Policy Instrument", "Keywords", "Topics", "Hazards")
#: Marks of a table block. Fixed values.
TABLE_START, TABLE_ROW, TABLE_END = "[START_OF_TABLE]", "[ROW]", "[END_OF_TABLE]"
CHUNK_MARK = "[NEW_CHUNK]"


def metadata_text(sector: Column, instrument: Column, keyword: Column, topic: Column, hazard: Column) -> Column:
    """The metadata of a policy as five labelled lines; null counts as empty."""
    return F.concat_ws("\n", *[F.concat(F.lit(f"{label}: "), clean_text(c)) for label, c in zip(METADATA_LINES, (sector, instrument, keyword, topic, hazard), strict=True)])


def table_row(cells: Column) -> Column:
    """Cells of a row (a list of strings) joined by commas: numbers to two decimals, blank cells left out."""
    one = lambda c: F.when(clean_text(c).try_cast("double").isNotNull(), F.format_string("%.2f", two_decimals(clean_text(c).try_cast("double")))).otherwise(clean_text(c))
    return F.array_join(F.filter(F.transform(F.coalesce(cells, F.array().cast("array<string>")), one), lambda c: c != ""), ",")


def table_block(title: Column, rows: Column) -> Column:
    """A title and its rows (a list of lists of strings) between marks; empty if no row holds anything."""
    lines = F.filter(F.transform(rows, table_row), lambda r: r != "")
    marked = F.transform(lines, lambda r: F.concat(F.lit(f"{TABLE_ROW} "), r))
    return F.when(F.size(lines) > 0, F.concat_ws("\n", F.lit(TABLE_START), title, F.array_join(marked, "\n"), F.lit(TABLE_END))).otherwise("")


def title_matches(texts: DataFrame, text: str, titles: DataFrame, embedder: Embedder, k: int, digits: int = 6) -> DataFrame:
    """text, title, score, rank: the k titles whose vectors are most like that of each different text, ties by title.

    Texts and titles are embedded once each; texts without words have score 0 throughout and
    take the first titles.
    """
    t = embed_column(texts.select(F.col(text).alias("query_id")).distinct(), "query_id", embedder, "vec")
    c = embed_column(titles.select(F.col("title").alias("chunk_id")).distinct(), "chunk_id", embedder, "vec")
    scores = block_cosine(durable(t, "texts"), durable(c, "titles"), k, digits)
    top = top_per(scores, ["query_id"], [F.col("score").desc(), F.col("chunk_id").asc()], k, salt=F.col("chunk_id"))
    return top.select(F.col("query_id").alias(text), F.col("chunk_id").alias("title"), "score", F.col("rank").cast("bigint").alias("rank"))


def answered_titles(answers: DataFrame, key: str, answer: str, titles: list[str]) -> DataFrame:
    """key, title, rank of the known titles that a generator's answer names; an answer that names none gives no row.

    `titles` is a catalogue of tables (a bounded list that every prompt holds anyway).
    """
    run = F.udf(lambda a: parse_selected_titles(a, titles), "array<string>", useArrow=True)
    return answers.select(key, F.posexplode(run(F.col(answer))).alias("rank", "title")).select(key, "title", (F.col("rank") + 1).cast("bigint").alias("rank"))


def slice_text(cells: DataFrame, wanted: DataFrame, keys: list[str], width: int = 10, offset: int = 1) -> DataFrame:
    """keys, place, text: the readings of a table in the years [year - width - offset + 1, year - offset] of a place, a line per year.

    `wanted` has the keys, place, year and table_idx; `cells` table_idx, country,
    year, feature, value. `offset` 0 includes the year itself. A place without
    readings has no row.
    """
    each = wanted.select(*keys, "place", "table_idx", F.explode(F.sequence(F.col("year") - width - offset + 1, F.col("year") - offset)).alias("_y"))
    read = each.join(cells.select("table_idx", F.col("country").alias("place"), F.col("year").alias("_y"), "feature", "value"), ["table_idx", "place", "_y"])
    cell = F.concat("feature", F.lit("="), F.format_string("%.2f", two_decimals(F.col("value"))))
    line = read.groupBy(*keys, "place", "_y").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("feature", cell.alias("c")))), lambda x: x["c"]), ", ").alias("_l"))
    dated = F.concat(F.col("_y").cast("string"), F.lit(": "), F.col("_l"))
    return line.groupBy(*keys, "place").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_y", dated.alias("l")))), lambda x: x["l"]), "\n").alias("text"))


def analysis_prompts(cells: DataFrame, selected: DataFrame, titles: DataFrame, width: int = 10) -> DataFrame:
    """country, region, year, table_idx, rank, prompt: for each selected table of a place and year its title and the slices of country, region and world.

    `selected` has country, region, year, table_idx, rank; policies of one place and
    year share their prompts.
    """
    keys = ["country", "region", "year", "table_idx", "rank"]
    places = F.array(F.struct(F.lit(1).alias("no"), F.col("country").alias("place")), F.struct(F.lit(2).alias("no"), F.col("region").alias("place")), F.struct(F.lit(3).alias("no"), F.lit("world").alias("place")))
    wanted = selected.select(*keys, F.explode(places).alias("p")).select(*keys, "p.no", "p.place").where("place <> ''")
    # Slices are made once per place, year and table, whatever number of policies and ranks asks for them.
    spots = wanted.select("place", "year", "table_idx").distinct().withColumn("at", F.struct("year", "table_idx"))
    texts = slice_text(cells, spots, ["at"], width).select("place", F.col("at.year").alias("year"), F.col("at.table_idx").alias("table_idx"), "text")
    head = F.when(F.col("no") == 1, F.concat(F.lit("Focused Country Data: "), F.col("place"))).when(F.col("no") == 2, F.concat(F.col("place"), F.lit(" Data:"))).otherwise("World Data:")
    part = F.concat_ws("\n", head, "text")
    found = wanted.join(texts, ["place", "year", "table_idx"], "left").groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", part.alias("t")))), lambda x: x["t"]), "\n").alias("_data"))
    named = found.join(titles.select("table_idx", "title"), "table_idx")
    return named.select(*keys, F.concat_ws("\n", F.lit("Analyse the following data of a policy's country in one paragraph."), F.lit("DATASET:"), F.concat(F.lit("Title: "), "title"), "_data").alias("prompt"))


def blend_prompt(analysis: Column, chunks: Column) -> Column:
    """The prompt that writes an analysis in the style of a list of chunks."""
    return F.concat_ws("\n", F.lit("Write one paragraph that blends the analysis with the related content and names no policy."), F.lit("Analysis:"), analysis, F.lit("Related content:"), F.array_join(chunks, "\n"))


def related_chunks(texts: DataFrame, text: str, chunks: DataFrame, embedder: Embedder, top_docs: int = 3, top_chunks: int = 1000) -> DataFrame:
    """text, chunks: for each different text the best chunk of each of the `top_docs` most similar documents, best first."""
    q = durable(embed_column(texts.select(F.col(text).alias("query_id")).distinct(), "query_id", embedder, "vec"), "queries")
    c = durable(embed_column(chunks.select("chunk_id", "document_id", "text"), "text", embedder, "vec"), "chunk-vectors")
    near = Tiles(q.withColumn("target", F.lit(None).cast("string")), c.select("chunk_id", "document_id", "vec", F.lit(True).alias("allowed")), digits=6).distinct_documents(top_docs, top_chunks)
    near = near.join(c.select("chunk_id", "text"), "chunk_id").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("doc_no", "text"))).alias("x"))
    return near.select(F.col("query_id").alias(text), F.col("x.text").alias("chunks"))


def generate_summaries(policies: DataFrame, prompts: DataFrame, chunks: DataFrame, make: Callable[[], Generator], embedder: Embedder, done: DataFrame | None = None, fallback: bool = True) -> DataFrame:
    """document_id, n_analyses, n_blends, used_fallback, summary of every policy that isn't in `done` (resume).

    `policies` has document_id, country, region, year and source_text; `prompts` is
    analysis_prompts(); `chunks` has chunk_id, document_id and text. Each stage is a
    table: an analysis per place, year and table; per policy its analyses, or its
    source text where there are none (unless `fallback` is off, as for runs that only
    measure stability); a blend per analysis with the chunks of three documents; the
    different blends in order make the summary. Equal prompts are sent once. A call that
    fails gives no text, and a policy without a blend no summary (null).
    """
    require_columns(policies, "document_id", "country", "region", "year", "source_text")
    if done is not None:
        policies = policies.join(done.select("document_id").distinct(), "document_id", "left_anti")
    place = ["country", "region", "year"]
    asked = durable(generate_column(prompts.select("prompt").distinct(), "prompt", make, "analysis").select("prompt", clean_text(F.col("analysis")).alias("analysis")).where("analysis <> ''"), "analyses")
    mine = policies.select("document_id", *place).join(prompts.join(asked, "prompt").select(*place, F.col("rank").cast("int").alias("no"), "analysis"), place).select("document_id", "no", "analysis")
    steps = mine.withColumn("used_fallback", F.lit(False))
    if fallback:
        source = policies.select("document_id", F.lit(1).alias("no"), clean_text(F.col("source_text")).alias("analysis")).where("analysis <> ''")
        steps = steps.unionByName(source.join(mine.select("document_id").distinct(), "document_id", "left_anti").withColumn("used_fallback", F.lit(True)))
    steps = durable(steps, "steps")
    near = related_chunks(steps, "analysis", chunks, embedder)
    asks = durable(near.select("analysis", blend_prompt(F.col("analysis"), F.col("chunks")).alias("prompt")), "blend-prompts")
    blended = durable(generate_column(asks, "prompt", make, "blend").select("analysis", clean_text(F.col("blend")).alias("blend")).where("blend <> ''"), "blends")
    whole = steps.join(blended, "analysis", "left").groupBy("document_id").agg(
        F.count(F.lit(1)).alias("n_analyses"), F.max("used_fallback").alias("used_fallback"), F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col("blend").isNotNull(), F.struct("no", "blend")))), lambda x: x["blend"])).alias("_b"))
    last = whole.withColumn("_p", F.when(F.size("_b") > 0, F.concat_ws("\n", F.lit("Summarize these chunks of information to one paragraph:"), F.array_join("_b", CHUNK_MARK))))
    out = generate_column(last, "_p", make, "_s")
    made = out.select("document_id", "n_analyses", F.size("_b").cast("bigint").alias("n_blends"), "used_fallback", F.nullif(clean_text(F.col("_s")), F.lit("")).alias("summary"))
    rest = policies.select("document_id").join(steps.select("document_id").distinct(), "document_id", "left_anti")
    return made.unionByName(rest.select("document_id", F.lit(0).cast("bigint").alias("n_analyses"), F.lit(0).cast("bigint").alias("n_blends"), F.lit(False).alias("used_fallback"), F.lit(None).cast("string").alias("summary")))


def role_agent_frame(rows: DataFrame, contexts: dict[str, str], make: Callable[[], Generator], checkpoint, scope: dict[str, str]) -> DataFrame:
    """The finished rows (document_id and the advisors' and later stages' texts) of a test frame, each with its cache_key.

    The key is the digest of `scope` (such as fold and window) and the document, so a
    frame of another fold or window is made anew while rows that are there already
    are read back. `checkpoint` is a sources.writers.Checkpoint by cache_key. The
    advisors read the columns that `contexts` names.
    """
    parts = [F.concat(F.lit(f"{k}={v}|doc_id="), F.col("document_id")) if i == len(scope) - 1 else F.lit(f"{k}={v}") for i, (k, v) in enumerate(scope.items())]
    keyed = rows.withColumn("cache_key", cache_key(*parts))
    done = checkpoint.run(keyed, lambda todo: advisor_chain(todo, contexts, make))
    return done.join(keyed.select("cache_key"), "cache_key", "left_semi")
