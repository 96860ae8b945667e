"""Splitting oversized texts at natural boundaries, with an overlap between consecutive pieces."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from policygrid.functions.text import normal_path
from policygrid.session import require_columns

LIMIT, OVERLAP = 1500, 200
#: From the coarsest to the finest boundary; a cut is made after what the pattern matches. Fixed values.
LEVELS = (
    re.compile(r"\f+|\n[ \t\r]*\n[ \t\r]*\n\s*|\n(?=\s{0,3}(?:#{1,6} |={3,}|-{3,}|\*{3,}))"),  # section
    re.compile(r"\n[ \t\r]*\n\s*|\x{2029}+".replace(r"\x{2029}", " ")),  # paragraph
    re.compile(r"[.!?…]+[\"'”’»)\]]*\s+|[。！？]+[”’」』）]*\s*|[؟۔]+\s+|[\r\n]+"),  # sentence, line
    re.compile(r"\s+"),  # word
)


def boundaries(text: str, most: int) -> list[int]:
    """Ascending ends of units of at most `most` characters, by the coarsest level that gets there."""
    out: list[int] = []
    todo = [(0, len(text), 0)]
    while todo:
        a, b, level = todo.pop()
        if b - a <= most:
            out.append(b)
        elif level < len(LEVELS):
            ends = [m.end() for m in LEVELS[level].finditer(text, a, b) if a < m.end() < b]
            starts = [a, *ends]
            todo.extend((s, e, level + 1) for s, e in zip(reversed(starts), reversed([*ends, b]), strict=True))
        else:
            cut = a + most
            while cut > a + 1 and unicodedata.combining(text[cut]):
                cut -= 1  # a mark stays with its letter
            out.append(cut)
            todo.append((cut, b, level))
    return out


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Spans of pieces of at most `limit` characters that cover `text`; each begins `overlap` before the end of the one before.

    A text within the limit, an empty one included, is one piece. Units between
    boundaries (a unit too long for a piece is divided at the next finer kind of
    boundary) are packed greedily: a piece takes as many whole units as fit, so it can
    end at a finer boundary than one that lies further back. The last piece never
    repeats only what the one before already has.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than limit")
    n = len(text)
    if n <= limit:
        return [(0, n)]
    ends = boundaries(text, limit - overlap)
    spans, start, k = [], 0, 0
    while True:
        end = start
        while k < len(ends) and ends[k] - start <= limit:
            end = ends[k]
            k += 1
        spans.append((start, end))
        if end >= n:
            return spans
        start = end - overlap


def _pieces(limit: int, overlap: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            spans = [split_text(t, limit, overlap) for t in pdf["text"]]
            k = [len(s) for s in spans]
            yield pd.DataFrame({
                "key": pdf["key"].repeat(k).to_numpy(), "piece_no": [i + 1 for s in spans for i in range(len(s))], "start": [a for s in spans for a, _ in s],
                "piece": [t[a:b] for t, s in zip(pdf["text"], spans, strict=True) for a, b in s], "n_pieces": [n for n in k for _ in range(n)],
            })

    return run


def split_oversized(texts: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """key, piece_no (from 1), start (0-based code point), piece, n_pieces of every text longer than `limit`.

    Texts within the limit, empty and null ones are filtered before any Python
    runs and give no rows; other columns of `texts` are ignored. Each text is split
    by itself, without a shuffle.
    """
    require_columns(texts, key, text)
    long = texts.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).where(F.length("text") > limit)
    return long.mapInPandas(_pieces(limit, overlap), "key string, piece_no int, start long, piece string, n_pieces int")


def linked_texts(rows: DataFrame, files: DataFrame) -> DataFrame:
    """row_id, key of the rows whose text_file_path leads to a file; key is the file's normalised path."""
    require_columns(rows, "row_id", "text_file_path")
    paths = rows.select("row_id", normal_path(F.col("text_file_path")).alias("key")).where(F.col("key").isNotNull())
    return paths.join(files.select("key").distinct(), "key", "left_semi")


def keyed_files(files: DataFrame) -> DataFrame:
    """key, text of each file; of files whose paths are the same once normalised the first by path."""
    f = files.select(normal_path(F.col("text_file_path")).alias("key"), F.col("text_file_path").alias("p"), F.col("page_content").alias("text")).where(F.col("key").isNotNull())
    return f.groupBy("key").agg(F.min_by("text", "p").alias("text"))
