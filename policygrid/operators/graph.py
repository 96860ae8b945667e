"""The policy knowledge graph as node and edge tables, and lookups over them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from policygrid.functions.text import policy_year
from policygrid.session import require_columns

EDGE = ("src_label", "src", "rel", "dst_label", "dst")
#: Levels of a geography from the smallest, with the name column of each. Fixed values.
LEVELS = (("Country", "country"), ("SubRegion", "sub_region"), ("Region", "region_name"))


def edges(df: DataFrame, src_label: str, src: Column, rel: str, dst_label: str, dst: Column) -> DataFrame:
    """Distinct edges whose two ends aren't blank."""
    e = df.select(F.lit(src_label).alias("src_label"), F.trim(src.cast("string")).alias("src"), F.lit(rel).alias("rel"), F.lit(dst_label).alias("dst_label"), F.trim(dst.cast("string")).alias("dst"))
    return e.where((F.col("src") != "") & (F.col("dst") != "")).distinct()


def multi_edges(df: DataFrame, doc: str, values: Column, rel: str, label: str) -> DataFrame:
    """Edges from a document to each of its several values."""
    return edges(df.select(doc, F.explode(values).alias("_v")), "PolicyDocument", F.col(doc), rel, label, F.col("_v"))


def hierarchy(regions: DataFrame) -> DataFrame:
    """IS_PART_OF from every level of a geography to the next level that has a name."""
    require_columns(regions, *[c for _, c in LEVELS])
    named = F.array_compact(F.array(*[F.when(F.trim(c) != "", F.struct(F.lit(label).alias("label"), F.trim(c).alias("name"))) for label, c in LEVELS]))
    steps = regions.select(named.alias("l")).select(F.explode(F.arrays_zip(F.slice("l", 1, F.greatest(F.size("l") - 1, F.lit(0))).alias("a"), F.slice("l", F.lit(2), F.greatest(F.size("l") - 1, F.lit(0))).alias("b"))).alias("s"))
    return steps.select(F.col("s.a.label").alias("src_label"), F.col("s.a.name").alias("src"), F.lit("IS_PART_OF").alias("rel"), F.col("s.b.label").alias("dst_label"), F.col("s.b.name").alias("dst")).distinct()


def policy_edges(policies: DataFrame, lists: dict[str, tuple[str, str]], instruments: Column | None = None) -> DataFrame:
    """All edges of a policy table (document_id, geography, last_event_in_timeline, document_role, ...).

    `lists` maps a column of `;`-separated values to (relationship, node label);
    `instruments` is an array of `name|type`.
    """
    doc = F.col("document_id")
    parts = [
        edges(policies, "PolicyDocument", doc, "EFFECTIVE_FROM", "ApprovalYear", policy_year(F.col("last_event_in_timeline"))),
        edges(policies, "PolicyDocument", doc, "IS_OF_TYPE", "DocumentType", F.col("document_role")),
        edges(policies, "Country", F.col("geography"), "APPLIES", "PolicyDocument", doc),
    ]
    parts += [multi_edges(policies, "document_id", F.split(F.col(c), ";"), rel, label) for c, (rel, label) in lists.items()]
    if instruments is not None:
        flat = policies.select("document_id", F.explode(instruments).alias("_i"))
        name, kind = F.split_part("_i", F.lit("|"), F.lit(1)), F.split_part("_i", F.lit("|"), F.lit(2))
        parts += [
            edges(flat, "PolicyDocument", doc, "USES_INSTRUMENT", "PolicyInstrument", name), edges(flat.where(F.trim(name) != ""), "PolicyInstrument", name, "IS_INSTRUMENT_TYPE", "InstrumentType", kind),
        ]
    return reduce(DataFrame.unionByName, parts)


def at_risk(all_edges: DataFrame) -> DataFrame:
    """AT_RISK_OF from a country to the hazards of the documents that apply there."""
    applies = all_edges.where("rel = 'APPLIES'").select(F.col("src").alias("country"), F.col("dst").alias("doc"))
    hazards = all_edges.where("rel = 'ADDRESSES_HAZARD'").select(F.col("src").alias("doc"), F.col("dst").alias("hazard"))
    return edges(applies.join(hazards, "doc"), "Country", F.col("country"), "AT_RISK_OF", "Hazard", F.col("hazard"))


def related_documents(policies: DataFrame) -> DataFrame:
    """family_title, document_id, n_related: each document's family and how many other documents it links it with.

    The family is the class of its members; links within it are counted, not listed,
    so a family of any size costs a row per document.
    """
    docs = policies.select(F.trim("document_id").alias("document_id"), F.trim("family_title").alias("family_title")).where("document_id <> '' and family_title <> ''").distinct()
    families = docs.groupBy("family_title").agg((F.count(F.lit(1)) - 1).alias("n_related")).where("n_related > 0")
    return docs.join(families, "family_title").select("family_title", "document_id", "n_related")


def chunk_edges(chunks: DataFrame) -> DataFrame:
    """HAS_CHUNK from documents to chunks."""
    return edges(chunks, "PolicyDocument", F.col("document_id"), "HAS_CHUNK", "Chunk", F.col("chunk_id"))


def nodes(all_edges: DataFrame) -> DataFrame:
    """label, key of every node that an edge touches."""
    return all_edges.select(F.col("src_label").alias("label"), F.col("src").alias("key")).union(all_edges.select("dst_label", "dst")).distinct()


def with_properties(node: DataFrame, table: DataFrame, key: str, properties: list[str]) -> DataFrame:
    """Nodes with a map of those properties that aren't null; of rows with equal keys the first by value counts."""
    props = table.groupBy(F.trim(key).alias("key")).agg(*[F.min(p).alias(p) for p in properties])
    pairs = F.array_compact(F.array(*[F.when(F.col(p).isNotNull(), F.struct(F.lit(p).alias("k"), F.col(p).cast("string").alias("v"))) for p in properties]))
    return node.join(props, "key", "left").select("label", "key", F.map_from_entries(F.coalesce(pairs, F.array().cast("array<struct<k:string,v:string>>"))).alias("props"))


def entity_lookup(all_edges: DataFrame, wanted: list[tuple[str, str]]) -> DataFrame:
    """document_id of the documents linked with every (label, key) of `wanted`, whatever the direction."""
    if not wanted:
        return all_edges.select(F.col("src").alias("document_id")).limit(0)
    spark = all_edges.sparkSession
    want = spark.createDataFrame(sorted(set(wanted)), "label string, key string")
    out = all_edges.where("src_label = 'PolicyDocument'").select(F.col("src").alias("document_id"), F.col("dst_label").alias("label"), F.col("dst").alias("key"))
    back = all_edges.where("dst_label = 'PolicyDocument'").select(F.col("dst").alias("document_id"), F.col("src_label").alias("label"), F.col("src").alias("key"))
    met = out.unionByName(back).join(want, ["label", "key"]).groupBy("document_id").agg(F.count_distinct("label", "key").alias("n"))
    return met.where(F.col("n") == len(set(wanted))).select("document_id")
