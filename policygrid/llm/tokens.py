"""Encoding with a public tokenizer: overlapping chunks, stitched where pre-token boundaries resynchronise."""

from __future__ import annotations

import base64
import importlib.util
import os
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from policygrid.session import durable, require_columns, spread

#: Where vocabulary files lie unless a path is given.
FOLDER = os.environ.get("POLICYGRID_TOKENIZERS", "/opt/tokenizers")
BYTE_BPE = "byte_bpe_50k.tiktoken"
#: Pre-token pattern of the byte-level vocabularies. Fixed value; it looks ahead one character and never back.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters from the start of one chunk to that of the next, and characters that two chunks share.
CHUNK, OVERLAP = 4096, 256
#: Chunks that make one task, about.
_TASK_CHUNKS = 512


def vocabulary_path(name: str = BYTE_BPE, folder: str = FOLDER) -> str:
    """The vocabulary file `name` in `folder`, else in the installed package of public tokenizers."""
    if (p := Path(folder, name)).exists():
        return str(p)
    spec = importlib.util.find_spec("public_tokenizers")
    if spec and spec.origin and (p := Path(spec.origin).parent / name).exists():
        return str(p)
    raise FileNotFoundError(f"{name} is neither in {folder} nor in an installed package")


@lru_cache(maxsize=4)
def encoding(path: str):
    """The byte-level encoder of a file of ranks; one per Python worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(Path(path).name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(text: str | None, path: str) -> np.ndarray:
    """Ids of a text; none for null and empty texts. Lone surrogates can't occur in parquet strings."""
    return encoding(path).encode_to_numpy(text, disallowed_special=()).astype(np.int32) if text else np.empty(0, np.int32)


def decode(ids: list[int], path: str) -> str:
    """The text of ids: their bytes joined, then read as UTF-8."""
    return b"".join(encoding(path).decode_tokens_bytes(list(ids))).decode("utf-8", "replace")


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays) if arrays else np.empty(0, np.int32), pa.int32()))


#: Characters of text whose ids make one Arrow batch at most, unless one text alone is longer.
_BATCH_CHARS = 4_000_000


def _encoder(path: str, count_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(keys: list, arrays: list[np.ndarray]) -> pa.RecordBatch:
            ids = pa.array([len(a) for a in arrays], pa.int32()) if count_only else _lists(arrays)
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), ids], ["doc_id", "n_tokens" if count_only else "ids"])

        for batch in batches:
            keys, arrays, size = [], [], 0
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys.append(key)
                arrays.append(encode(text, path))
                size += len(text or "")
                if size > _BATCH_CHARS:
                    yield out(keys, arrays)
                    keys, arrays, size = [], [], 0
            if keys:
                yield out(keys, arrays)

    return run


def pretoken_ends(text: str, a: int, b: int) -> list[int]:
    """Ends in [a, b) of the pre-tokens of `text` at which it can be parted.

    One at the very end isn't certain, and white space is split by what follows it,
    so ends after white space are left out too.
    """
    return [e for m in _PRETOKEN.finditer(text) if a <= (e := m.end()) < min(b, len(text)) and not text[e - 1].isspace()]


_PRETOKEN = regex.compile(PATTERN)


def _cut(size: int, overlap: int):
    """doc_id, chunk, last, text: the overlapping chunks of each text, a thousand of them in a batch at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n = max(1, -(-(len(text) - overlap) // size))
                for a in range(0, n, 1000):
                    some = range(a, min(n, a + 1000))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([key] * len(some), pa.int64()), pa.array(some, pa.int32()), pa.array([n - 1] * len(some), pa.int32()), pa.array([text[i * size : (i + 1) * size + overlap] for i in some], pa.string())],
                        ["doc_id", "chunk", "last", "text"])

    return run


def _marks(size: int, overlap: int):
    """Per chunk: pre-token ends, in the text's positions, within the part shared with the chunk before and after."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            head, tail = [], []
            for i, last, text in zip(*(batch.column(c).to_pylist() for c in ("chunk", "last", "text")), strict=True):
                ends = pretoken_ends(text, 0, len(text))
                head.append([i * size + e for e in ends if e <= overlap] if i else [])
                tail.append([i * size + e for e in ends if e >= size] if i < last else [])
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("chunk"), pa.array(head, kind), pa.array(tail, kind)], ["doc_id", "chunk", "head", "tail"])

    return run


def _encode_pieces(path: str, size: int, count_only: bool):
    """The ids (or their number) of each chunk's piece [a, b) of the text; b is null for the last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = []
            for chunk, text, a, b in zip(*(batch.column(c).to_pylist() for c in ("chunk", "text", "a", "b")), strict=True):
                at = chunk * size
                arrays.append(encode(text[a - at : None if b is None else b - at], path))
            ids = pa.array([len(x) for x in arrays], pa.int32()) if count_only else _lists(arrays)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("chunk"), ids], ["doc_id", "chunk", "n_tokens" if count_only else "ids"])

    return run


def _encoded(rows: DataFrame, path: str, size: int, overlap: int, count_only: bool) -> DataFrame:
    """encode_corpus() or token_counts() of doc_id, text."""
    kind = "n_tokens int" if count_only else "ids array<int>"
    done = []
    while True:
        more = F.coalesce(F.length("text") > size + overlap, F.lit(False))
        # A text of one chunk has no other to be stitched to.
        done.append(rows.where(~more).mapInArrow(_encoder(path, count_only), f"doc_id long, {kind}"))
        rows = rows.where(more)
        chunks = rows.agg(F.coalesce(F.sum(F.ceil((F.length("text") - overlap) / size)), F.lit(0))).first()[0]
        if not chunks:
            break
        tasks = -(-int(chunks) // _TASK_CHUNKS)
        cut = spread(rows.mapInArrow(_cut(size, overlap), "doc_id long, chunk int, last int, text string"), tasks, "doc_id", "chunk")
        marks = durable(cut.mapInArrow(_marks(size, overlap), "doc_id long, chunk int, head array<long>, tail array<long>"), "marks")
        # The stitch after chunk i: the first boundary that its tail and the head of chunk i + 1 share.
        after = marks.select("doc_id", (F.col("chunk") - 1).alias("chunk"), F.col("head").alias("next_head"))
        stitches = durable(marks.join(after, ["doc_id", "chunk"]).select("doc_id", "chunk", F.array_min(F.array_intersect("tail", "next_head")).alias("stitch")), "stitches")
        loose = stitches.where("stitch is null").select("doc_id").distinct()
        firm = stitches.join(loose, "doc_id", "left_anti")
        ends = firm.select("doc_id", (F.col("chunk") + 1).alias("chunk"), F.col("stitch").alias("a"))
        bounds = firm.select("doc_id", "chunk", F.col("stitch").alias("b")).join(ends, ["doc_id", "chunk"], "full").select("doc_id", "chunk", F.coalesce("a", F.lit(0)).alias("a"), "b")
        pieces = cut.select("doc_id", "chunk", "text").join(bounds, ["doc_id", "chunk"]).mapInArrow(_encode_pieces(path, size, count_only), f"doc_id long, chunk int, {kind}")
        if count_only:
            whole = pieces.groupBy("doc_id").agg(F.sum("n_tokens").cast("int").alias("n_tokens"))
        else:
            whole = pieces.groupBy("doc_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "ids"))), lambda x: x["ids"])).alias("ids"))
        done.append(whole)
        if loose.isEmpty():
            break
        # A pre-token longer than an overlap: those texts again, with wider chunks and overlaps.
        rows, size, overlap = rows.join(loose, "doc_id", "left_semi"), 4 * size, 4 * overlap
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def encode_corpus(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, ids of every row; null and empty texts have no ids (an empty list).

    Texts are cut into chunks of `size` + `overlap` characters, one starting every
    `size`, which are pre-tokenised in parallel. The pattern reads forwards only, so
    from a position that is a boundary in both of two neighbouring chunks on, both
    agree with the whole text: there they are stitched, and the pieces between
    stitches are encoded in parallel and their ids joined. Where an overlap has no
    common boundary (a pre-token longer than it) the text is cut again with chunks
    and overlaps four times as wide, until there is one or the text is one chunk.
    Every row comes out once; `key` must be unique and not null; other columns,
    whatever their names, are ignored; no rows give no rows.
    """
    require_columns(docs, key, text)
    return _encoded(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")), path or vocabulary_path(), size, overlap, False)


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_tokens of every row, by the chunks of encode_corpus(); 0 for null and empty texts. The ids stay in the Python worker."""
    require_columns(docs, key, text)
    return _encoded(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")), path or vocabulary_path(), size, overlap, True)


def _decoder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([decode(ids, path) for ids in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return run


def decode_corpus(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text of doc_id, ids: the bytes of the ids joined; no ids give the empty text."""
    return encoded.select("doc_id", "ids").mapInArrow(_decoder(path or vocabulary_path()), "doc_id long, text string")
