"""The queries of the training-data problems p1, p2, p4, p5, p8, p9 and p10."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from policygrid.llm import components as C
from policygrid.llm import lookalike as L
from policygrid.llm import neighbours as N
from policygrid.llm import overlap as O
from policygrid.llm import packing as K
from policygrid.llm import splitter as S
from policygrid.llm import tokens as T
from policygrid.functions.text import NO_VALUE_BARE, NO_VALUE_EVEN
from policygrid.session import durable, table


#: Neighbours at any distance take a wider search than pairs of high similarity.
WIDE = {"probes": 4, "beam": 72}
COLLECTIONS = {"chunk": "chunk_id", "policy_document": "document_id"}


def _collections(spark: SparkSession, sf_dir: str) -> dict[str, tuple[DataFrame, str, str]]:
    return {t: (table(spark, sf_dir, t), key, "embedding") for t, key in COLLECTIONS.items()}


def p1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.most_similar_each(_collections(spark, sf_dir), **WIDE)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.similar_pairs_each(_collections(spark, sf_dir))


def p2_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.in_batches(table(spark, sf_dir, "all_data_en"))


def p2_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, groups, groups in several splits, rows without a split, and whether each split is within a hundredth (or the largest group) of its share."""
    out = durable(p2_splits(spark, sf_dir), "splits")
    groups = out.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("split").alias("k"))
    g = groups.agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_groups"), F.count_if(F.col("k") > 1).alias("n_torn"), F.max("n").alias("most"))
    share = F.element_at(F.create_map(*[x for k, v in C.SPLITS.items() for x in (F.lit(k), F.lit(v))]), F.col("split"))
    sizes = out.groupBy("split").agg(F.count(F.lit(1)).alias("s")).withColumn("share", share)
    m = sizes.agg(F.collect_list(F.struct("s", "share")).alias("x"))  # a row per split
    near = lambda r: F.abs(r["s"] - r["share"] * F.col("n_rows")) <= F.greatest(F.lit(0.01) * F.col("n_rows"), F.col("most"))
    both = g.withColumn("_j", F.lit(1)).join(m.withColumn("_j", F.lit(1)), "_j")
    return both.select("n_rows", "n_groups", "n_torn", F.lit(out.where("split is null").count()).cast("bigint").alias("n_unplaced"), F.forall("x", near).alias("shares_kept"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    member = C.in_batches(table(spark, sf_dir, "all_data_en"))
    return member.where("row_id <> component").select(F.col("component").alias("first_row_id"), "row_id")


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = S.keyed_files(table(spark, sf_dir, "text_files"))
    used = S.linked_texts(table(spark, sf_dir, "all_data_en"), files).select("key").distinct()
    return S.split_oversized(files.join(used, "key", "left_semi"), "key", "text").withColumnRenamed("key", "text_file_path")


def p4_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each text that is split its length, and what its pieces do wrong: pieces too long or empty, wrong overlaps, characters lost or changed."""
    p = p4_pieces(spark, sf_dir).withColumn("n", F.length("piece"))
    parts = p.groupBy("text_file_path").agg(F.array_sort(F.collect_list(F.struct("piece_no", "start", "n", "piece"))).alias("x"), F.max("n_pieces").alias("k"))
    at = lambda i: F.get("x", i)
    gaps = F.filter(F.sequence(F.lit(1), F.greatest(F.size("x") - 1, F.lit(1))), lambda i: (i < F.size("x")) & (at(i)["start"] != at(i - 1)["start"] + at(i - 1)["n"] - S.OVERLAP))
    whole = F.aggregate("x", F.lit(""), lambda s, r: F.concat(s, F.when(r["piece_no"] == 1, r["piece"]).otherwise(F.substring(r["piece"], S.OVERLAP + 1, S.LIMIT))))
    sized = parts.select(F.col("text_file_path").alias("key"), F.size(F.filter("x", lambda r: (r["n"] > S.LIMIT) | (r["n"] < 1))).alias("too_long"), F.size(gaps).alias("bad_overlaps"), F.md5(whole).alias("digest"), (F.size("x") == F.col("k")).alias("numbered"))
    files = S.keyed_files(table(spark, sf_dir, "text_files")).select("key", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("was"))
    return sized.join(files, "key").select("key", "n_chars", F.col("too_long").cast("bigint").alias("too_long"), F.col("bad_overlaps").cast("bigint").alias("bad_overlaps"), ((F.col("digest") == F.col("was")) & F.col("numbered")).alias("whole"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = S.keyed_files(table(spark, sf_dir, "text_files"))
    cut = S.split_oversized(files, "key", "text").where("piece_no = 1 and n_pieces > 1").select("key")
    return S.linked_texts(table(spark, sf_dir, "all_data_en"), cut).select("row_id")


def p5_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.cross_fold_pairs(table(spark, sf_dir, "group_kfold_assignments"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_pairs(spark, sf_dir).select("row_id_a", "row_id_b")


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.overlap_report(table(spark, sf_dir, "group_kfold_assignments"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.encode_corpus(table(spark, sf_dir, "documents"))


def p8_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts again, from their ids."""
    return T.decode_corpus(p8_ids(spark, sf_dir))


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.pack(T.token_counts(table(spark, sf_dir, "documents")), "doc_id", "n_tokens").withColumnRenamed("item_id", "doc_id")


def p9_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents packed, containers over capacity, documents whose tokens don't add up, and those split though they fit."""
    sizes = durable(T.token_counts(table(spark, sf_dir, "documents")), "sizes")
    out = durable(K.pack(sizes, "doc_id", "n_tokens"), "packed")
    over = out.groupBy("container").agg(F.sum("n_tokens").alias("n")).where(F.col("n") > K.CAPACITY).count()
    per = out.groupBy(F.col("item_id").alias("doc_id")).agg(F.sum("n_tokens").alias("placed"), F.count(F.lit(1)).alias("k"))
    both = sizes.join(per, "doc_id", "left")
    return both.agg(F.count(F.lit(1)).alias("n_docs"), F.lit(over).cast("bigint").alias("n_over"), F.count_if(F.coalesce("placed", F.lit(-1)) != F.col("n_tokens")).alias("n_lost"), F.count_if((F.col("k") > 1) & (F.col("n_tokens") <= K.CAPACITY)).alias("n_split"))


def p10_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.canonical_table(spark, table(spark, sf_dir, "documents"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.lookalike_pairs(table(spark, sf_dir, "documents"))


QUERIES = {
    "p1_neighbours": p1_neighbours, "p1_found": p1_found,
    "p2_splits": p2_splits, "p2_check": p2_check, "p2_found": p2_found, "p4_pieces": p4_pieces, "p4_check": p4_check, "p4_found": p4_found, "p5_pairs": p5_pairs, "p5_found": p5_found, "p5_report": p5_report,
    "p8_ids": p8_ids, "p8_decoded": p8_decoded, "p9_containers": p9_containers, "p9_check": p9_check, "p10_canonical": p10_canonical, "p10_found": p10_found,
}

SPACES = r"[\s\x{1c}-\x{1f}\x{b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _path(c: str) -> str:
    even = f"regexp_replace({c}, '^{SPACES}|{SPACES}$', '', 'g')"
    return rf"nullif(regexp_replace(regexp_replace({even}, '[/\\]+', '/', 'g'), '^(/|\.\.?/)+', ''), '')"


def _even(c: str) -> str:
    return f"lower(regexp_replace({c}, '{SPACES}', '', 'g'))"


def _looks() -> str:
    """VALUES (character, what it becomes) of the look-alike classes: each member of one character, and composed characters by their parts."""
    to = L.representatives({})
    seen = lambda s: "".join(to.get(c, c) for c in unicodedata.normalize("NFD", s))
    rows = {c: seen(c) for c in map(chr, range(1, sys.maxunicode + 1)) if c in to or unicodedata.decomposition(c)[:1] not in ("", "<")}
    code = lambda s: "||".join(f"chr({ord(c)})" for c in s) or "''"
    return ", ".join(f"({code(c)}, {code(r)})" for c, r in rows.items() if unicodedata.normalize("NFC", r) != unicodedata.normalize("NFC", c))


_BLANK = ", ".join("'" + v.replace("'", "''") + "'" for v in NO_VALUE_EVEN)
_BARE = ", ".join("'" + v + "'" for v in NO_VALUE_BARE)
_KEYS = f"""k AS (SELECT row_id, 'f' || {_even("family_id")} AS key FROM all_data_en WHERE {_even("family_id")} NOT IN ({_BLANK})
   UNION ALL SELECT row_id, 'd' || {_even("document_id")} FROM all_data_en WHERE {_even("document_id")} NOT IN ({_BLANK})
   UNION ALL SELECT row_id, 't' || t FROM (SELECT row_id, lower(regexp_replace(family_title, '({SPACES}|[\\pP\\pC])+', '', 'g')) AS t FROM all_data_en) WHERE t NOT IN ({_BARE})),
   e AS MATERIALIZED (SELECT DISTINCT a.row_id AS a, b.row_id AS b FROM k a JOIN k b USING (key))"""
_PAIRS = """s AS (SELECT row_id, fold, source, regexp_replace(regexp_replace(family_summary, '<!--.*?-->', ' ', 'gs'), '</?[A-Za-z!?][^<>]*>', ' ', 'g') AS t FROM group_kfold_assignments WHERE fold IS NOT NULL),
   w AS MATERIALIZED (SELECT row_id, fold, source, list_distinct(regexp_extract_all(lower(replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&')), '[\\p{L}\\p{N}]+')) AS w FROM s),
   x AS (SELECT a.row_id AS row_id_a, b.row_id AS row_id_b, a.fold AS fold_a, b.fold AS fold_b, a.source AS source_a, b.source AS source_b, len(list_intersect(a.w, b.w)) AS i, len(a.w) + len(b.w) AS n FROM w a JOIN w b ON a.row_id < b.row_id AND a.fold <> b.fold WHERE len(a.w) > 0 AND len(b.w) > 0),
   p AS (SELECT row_id_a, row_id_b, fold_a, fold_b, source_a, source_b, i * 1.0::DOUBLE / (n - i) AS similarity FROM x)"""
SQL = {
    "p10_found": f"""WITH m(c, r) AS (VALUES {_looks()}), t AS (SELECT doc_id, text, regexp_extract_all(text, '(?s).') AS cs FROM documents WHERE text IS NOT NULL),
        ch AS (SELECT doc_id, unnest(cs) AS c, generate_subscripts(cs, 1) AS i FROM t), x AS (SELECT doc_id, nfc_normalize(string_agg(coalesce(r, c), '' ORDER BY i)) AS look FROM ch LEFT JOIN m USING (c) GROUP BY doc_id)
        SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM x a JOIN x b ON a.look = b.look AND a.doc_id < b.doc_id JOIN t s ON s.doc_id = a.doc_id JOIN t o ON o.doc_id = b.doc_id
        WHERE s.text <> o.text AND regexp_matches(a.look, '[^\\s\\pC\\x{{85}}\\x{{a0}}\\x{{2028}}\\x{{2029}}]')""",
    "p8_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p2_found": f"""WITH RECURSIVE {_KEYS}, reach AS (SELECT row_id AS root, row_id FROM all_data_en UNION SELECT r.root, e.b FROM reach r JOIN e ON e.a = r.row_id WHERE r.root < e.b)
        SELECT min(root) AS first_row_id, row_id FROM reach GROUP BY row_id HAVING min(root) < row_id""",
    "p4_found": f"""SELECT row_id FROM all_data_en WHERE {_path("text_file_path")} IN (SELECT {_path("text_file_path")} FROM text_files WHERE length(page_content) > 1500)""",
    "p4_check": f"""WITH k AS (SELECT {_path("text_file_path")} AS key, arg_min(page_content, text_file_path) AS t FROM text_files GROUP BY 1)
        SELECT key, length(t) AS n_chars, CAST(0 AS BIGINT) AS too_long, CAST(0 AS BIGINT) AS bad_overlaps, true AS whole FROM k WHERE length(t) > 1500 AND key IN (SELECT {_path("text_file_path")} FROM all_data_en)""",
    "p9_check": "SELECT count(*) AS n_docs, CAST(0 AS BIGINT) AS n_over, CAST(0 AS BIGINT) AS n_lost, CAST(0 AS BIGINT) AS n_split FROM documents",
    "p5_found": f"WITH {_PAIRS} SELECT row_id_a, row_id_b FROM p WHERE similarity >= 0.8",
    "p5_pairs": f"WITH {_PAIRS} SELECT * FROM p WHERE similarity >= 0.8",
    "p5_report": f"""WITH {_PAIRS}, r AS (SELECT row_id_a AS row_id, fold_a AS fold, source_a AS source, similarity FROM p WHERE similarity >= 0.8 UNION ALL SELECT row_id_b, fold_b, source_b, similarity FROM p WHERE similarity >= 0.8),
        m AS (SELECT row_id, fold, source, max(similarity) AS best FROM r GROUP BY ALL) SELECT fold, source, count(*) AS n_records, count(*) FILTER (best = 1) AS n_same FROM m GROUP BY ALL""",
}
SQL["p2_check"] = f"""WITH f AS ({SQL["p2_found"]}) SELECT (SELECT count(*) FROM all_data_en) AS n_rows, (SELECT count(*) FROM all_data_en) - (SELECT count(*) FROM f) AS n_groups, CAST(0 AS BIGINT) AS n_torn, CAST(0 AS BIGINT) AS n_unplaced, true AS shares_kept"""
