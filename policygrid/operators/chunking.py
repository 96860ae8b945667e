"""Fixed-size word chunks of collapsed text with start positions, chunk tables and metadata upserts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from policygrid.functions.text import clean_text, first_non_blank


def word_chunks(text: str, size: int = 1500, overlap: int = 200) -> list[tuple[int, str]]:
    """(start, chunk) of a text whose white space is single spaces.

    Words are taken until the next would exceed `size`; words are then dropped from
    the front until at most `overlap` characters remain and the next word fits. A
    word longer than `size` is cut into pieces of `size` with `overlap`.
    """
    units: list[tuple[int, int]] = []
    at = 0
    for word in text.split(" "):
        end = at + len(word)
        while end - at > size:
            units.append((at, at + size))
            at += size - overlap
        if end > at:
            units.append((at, end))
        at = end + 1
    out, held = [], 0
    for k, (_, b) in enumerate(units):
        if k > held and b - units[held][0] > size:
            out.append((units[held][0], text[units[held][0] : units[k - 1][1]]))
            while held < k and (units[k - 1][1] - units[held][0] > overlap or b - units[held][0] > size):
                held += 1
    if units:
        out.append((units[held][0], text[units[held][0] : units[-1][1]]))
    return out


def chunk_documents(docs: DataFrame, key: str, text: str, size: int = 1500, overlap: int = 200) -> DataFrame:
    """document_id, start_index, chunk_id (`<document>_chunk_<start>`), text of every document with text."""
    clean = docs.select(F.col(key).cast("string").alias("document_id"), clean_text(F.col(text)).alias("t")).where("t <> ''")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parts = [word_chunks(t, size, overlap) for t in pdf["t"]]
            yield pd.DataFrame({
                "document_id": pdf["document_id"].repeat([len(p) for p in parts]).to_numpy(), "start_index": pd.Series([a for p in parts for a, _ in p], dtype="int64"), "text": [t for p in parts for _, t in p],
            })

    out = clean.mapInPandas(run, "document_id string, start_index long, text string")
    return out.select("document_id", "start_index", F.concat_ws("_chunk_", "document_id", F.col("start_index").cast("string")).alias("chunk_id"), "text")


def stride_chunks(docs: DataFrame, key: str, text: str, size: int = 1500, overlap: int = 200) -> DataFrame:
    """key, start_index, n_chars of chunks at a fixed stride of size - overlap characters, all in the JVM."""
    n = F.length(text)
    starts = F.sequence(F.lit(0), F.greatest(n - overlap - 1, F.lit(0)), F.lit(size - overlap))
    return docs.where(n > 0).select(F.col(key), n.alias("_n"), F.explode(starts).alias("start_index")).select(key, "start_index", F.least(F.lit(size), F.col("_n") - F.col("start_index")).alias("n_chars"))


def read_alias(meta: Column, *names: str) -> Column:
    """The first value of a metadata map that isn't blank under any of its names, trimmed; else the empty string."""
    return first_non_blank(*[F.try_element_at(meta, F.lit(n)) for n in names])


def read_alias_int(meta: Column, *names: str) -> Column:
    """The first value under any of the names that is a whole number, else null."""
    return F.coalesce(*[F.try_element_at(meta, F.lit(n)).try_cast("int") for n in names])


def upsert_metadata(chunks: DataFrame, wanted: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """`chunks` with the wanted value where it isn't blank and differs, and `updated` saying whether any did.

    `wanted` has one row per key; chunks of other documents stay as they are.
    """
    new = wanted.select(F.col(key), *[F.trim(F.coalesce(F.col(c), F.lit(""))).alias(f"_{c}") for c in columns])
    both = chunks.join(new, key, "left")
    change = {c: F.coalesce((F.col(f"_{c}") != "") & ~F.col(f"_{c}").eqNullSafe(F.col(c)), F.lit(False)) for c in columns}
    any_change = change[columns[0]]
    for c in columns[1:]:
        any_change = any_change | change[c]
    return both.withColumn("updated", any_change).withColumns({c: F.when(e, F.col(f"_{c}")).otherwise(F.col(c)) for c, e in change.items()}).drop(*[f"_{c}" for c in columns])


def distinct_chunks(chunks: DataFrame, keys: list[str], tie: str) -> DataFrame:
    """One chunk per key, the one with the smallest `tie`."""
    rest = [c for c in chunks.columns if c not in keys]
    return chunks.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(tie)).alias("_x")).select(*keys, "_x.*")
