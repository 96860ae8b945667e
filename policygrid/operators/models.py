"""Seams for models that can't run here, with deterministic stand-ins; losses and the dual encoder's forward pass."""

from __future__ import annotations

import hashlib
import random
import re
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Embedder(Protocol):
    """Texts to vectors of one length."""

    width: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class Generator(Protocol):
    """A prompt to a text."""

    def generate(self, prompt: str) -> str: ...


class HashedWords:
    """Embedder that adds a signed unit per word at a hashed place; unit length, zeros for a text without words.

    The place is the number of the first two digits of the word's md5, the sign is
    that of the third (8 and above add), so SQL can say the same.
    """

    def __init__(self, width: int = 64) -> None:
        self.width = width

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.width))
        for row, text in zip(out, texts, strict=True):
            for word in re.findall("[a-z0-9]+", (text or "").lower()):
                h = hashlib.md5(word.encode()).hexdigest()
                row[int(h[:2], 16) % self.width] += 1 if int(h[2], 16) >= 8 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1)


class Extract:
    """Generator that gives back the first words of its prompt, or with `last` the last ones."""

    def __init__(self, words: int = 40, last: bool = False) -> None:
        self.words, self.last = words, last

    def generate(self, prompt: str) -> str:
        words = prompt.split()
        return " ".join(words[-self.words :] if self.last else words[: self.words])


class Judge(Protocol):
    """Scores of a text against what it was made from, by metric; a metric that can't be had raises."""

    metrics: tuple[str, ...]

    def score(self, metric: str, source: str, text: str) -> float: ...


class SharedWords:
    """Judge by words: alignment is the part of the text's words that the source has, coverage the reverse."""

    metrics = ("alignment", "coverage")

    def score(self, metric: str, source: str, text: str) -> float:
        a, b = (set(re.findall("[a-z0-9]+", t.lower())) for t in (source, text))
        of = b if metric == "alignment" else a
        if not of:
            raise ValueError("no words")
        return len(a & b) / len(of)


def rate_limited(error: Exception) -> bool:
    """Whether an error's text says that a rate limit was hit."""
    text = str(error).lower()
    return any(mark in text for mark in ("rate limit", "rate_limit", "429", "too many requests"))


def guarded(call: Callable[[], str], tries: int = 5, first_wait: float = 1.0, most: float = 16.0, retry: Callable[[Exception], bool] = rate_limited, jitter: float = 0.0, sleep: Callable[[float], None] = time.sleep) -> str:
    """`call`, tried again with doubling waits where `retry` says so; other errors are raised at once."""
    wait = first_wait
    for attempt in range(tries):
        try:
            return call()
        except Exception as error:
            if attempt == tries - 1 or not retry(error):
                raise
            sleep(wait + random.uniform(0, jitter))
            wait = min(most, wait * 2)
    raise AssertionError("unreachable")


def embed_column(df: DataFrame, text: str, embedder: Embedder, name: str = "embedding") -> DataFrame:
    """`df` with the vectors of a text column, Arrow batch by Arrow batch; null texts embed as empty."""

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(list(embedder.embed([t if isinstance(t, str) else "" for t in texts])), dtype=object)

    return df.withColumn(name, F.pandas_udf(run, "array<double>")(F.col(text)))


def generate_column(df: DataFrame, prompt: str, make: Callable[[], Generator], name: str, done: DataFrame | None = None, key: str | None = None, in_flight: int = 1, retry: Callable[[Exception], bool] = rate_limited, jitter: float = 0.0) -> DataFrame:
    """`df` with the generated text of each prompt; rows whose key is in `done` are left out (resume).

    A generator is made once per task, and a task has at most `in_flight` calls open,
    so that times the number of tasks bounds all of them. Calls are tried again where
    `retry` says so (on rate limits, unless another rule is given), after doubling
    waits with up to `jitter` seconds more; another error gives null.
    """
    if done is not None and key is not None:
        df = df.join(done.select(key).distinct(), key, "left_anti")
    schema = df.withColumn(name, F.lit("")).schema
    schema[name].nullable = True

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()

        def one(p: str | None) -> str | None:
            try:
                return guarded(lambda: model.generate(p), retry=retry, jitter=jitter) if isinstance(p, str) and p.strip() else None
            except Exception:
                return None

        with ThreadPoolExecutor(in_flight) as pool:
            for pdf in batches:
                out = list(pool.map(one, pdf[prompt]) if in_flight > 1 else map(one, pdf[prompt]))
                yield pdf.assign(**{name: pd.Series(out, dtype=object, index=pdf.index)})

    return df.mapInPandas(run, schema)


#: Advisors and the later stages of the chain. Fixed values.
ADVISORS = ("climate", "socio", "other")
STAGES = ("expert", "draft", "rewrite", "compact")


def advisor_chain(df: DataFrame, contexts: dict[str, str], make: Callable[[], Generator]) -> DataFrame:
    """`df` with the texts of three advisors, then of expert, draft, rewrite and compact, each made from the ones before."""
    for name in ADVISORS:
        df = generate_column(df.withColumn("_prompt", F.concat(F.lit(f"Advice on {name}: "), F.coalesce(F.col(contexts[name]), F.lit("")))), "_prompt", make, f"advice_{name}").drop("_prompt")
    before = [f"advice_{n}" for n in ADVISORS]
    for stage in STAGES:
        prompt = F.concat_ws("\n", F.lit(f"{stage}:"), *[F.coalesce(F.col(c), F.lit("")) for c in before])
        df = generate_column(df.withColumn("_prompt", prompt), "_prompt", make, stage).drop("_prompt")
        before = [stage]
    return df


def cache_key(*parts: Column) -> Column:
    """SHA-256 of `name=value` parts joined by a bar, as cached texts are keyed by."""
    return F.sha2(F.concat_ws("|", *parts), 256)


def two_decimals(x: Column) -> Column:
    """Rounded to two decimals by the binary value, halves away from zero."""
    return F.signum(x) * F.floor(F.abs(x) * 100 + 0.5) / 100


def render_table(values: Column, names: list[str], rows: int = 10, cols: int = 22) -> Column:
    """A tensor (array of rows) as text: up to `rows` last rows of `name=0.00` cells; rows are parted by a backslash and an n."""
    shown = names[:cols]
    line = lambda r: F.array_join(F.array(*[F.concat(F.lit(f"{n}="), F.format_string("%.2f", two_decimals(F.get(r, F.lit(i))))) for i, n in enumerate(shown)]), ", ")
    return F.array_join(F.transform(F.slice(values, F.greatest(-F.size(values), F.lit(-rows)), rows), line), "\\n")


def parse_selected_titles(answer: str | None, titles: list[str]) -> list[str]:
    """Known titles that an answer names: a list literal or lines, items matched whole or as a part of a title, in order.

    Titles are compared in lower case; of a part the first title in alphabetical
    order counts, and titles the answer contains word for word come last.
    """
    import ast

    known = sorted({t.strip().lower() for t in titles if t and t.strip()})
    text = (answer or "").strip()
    try:
        items = ast.literal_eval(text)
        items = [str(i) for i in items] if isinstance(items, (list, tuple)) else [str(items)]
    except (ValueError, SyntaxError, MemoryError, RecursionError):
        items = re.split(r"[\n;,•]| - ", text)
    items = [i.strip().strip("\"'[]-* ").lower() for i in items]
    items = [i for i in items if i] + [t for t in known if t in text.lower()]
    out: dict[str, None] = {}
    for item in items:
        hit = item if item in known else next((t for t in known if item in t), None)
        if hit is not None:
            out.setdefault(hit)
    return list(out)


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance with 1e-6 added to each difference."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double") + 1e-6) ** 2), F.lit(0.0), lambda s, x: s + x))


def triplet_loss(anchor: Column, positive: Column, negative: Column, margin: float = 1.0) -> Column:
    """max(0, d(anchor, positive) - d(anchor, negative) + margin)."""
    return F.greatest(distance(anchor, positive) - distance(anchor, negative) + margin, F.lit(0.0))


def contrastive_loss(scores: DataFrame, batch: str, row: str, col: str, score: str, temperature: float = 0.07) -> DataFrame:
    """batch, loss: symmetric in-batch cross entropy of scores whose target is the diagonal (row = col)."""
    z = scores.withColumn("_z", F.col(score) / temperature)

    def side(key: str) -> DataFrame:
        top = z.groupBy(batch, key).agg(F.max("_z").alias("_m"))
        part = z.join(top, [batch, key]).groupBy(batch, key).agg((F.first("_m") + F.log(F.sum(F.exp(F.col("_z") - F.col("_m"))))).alias("_l"), F.max(F.when(F.col(row) == F.col(col), F.col("_z"))).alias("_d"))
        return part.groupBy(batch).agg(F.avg(F.col("_l") - F.col("_d")).alias("loss"))

    return side(row).unionByName(side(col)).groupBy(batch).agg(F.avg("loss").alias("loss"))


@dataclass
class DualEncoder:
    """Forward pass of the two towers: a perceptron over the series beside a linear map of sectors, and a linear map of text vectors."""

    hidden: np.ndarray
    hidden_bias: np.ndarray
    series: np.ndarray
    sector: np.ndarray
    join: np.ndarray
    text: np.ndarray

    @classmethod
    def seeded(cls, n_series: int, n_sectors: int, n_text: int, width: int = 32, seed: int = 0) -> DualEncoder:
        g = np.random.default_rng(seed)
        m = lambda a, b: g.normal(0, 1 / np.sqrt(max(1, a)), (a, b))
        return cls(m(n_series, width), np.zeros(width), m(width, width), m(n_sectors, width), m(2 * width, width), m(n_text, width))

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        n = np.linalg.norm(x, axis=1, keepdims=True)
        return x / np.where(n > 0, n, 1)

    def encode_query(self, series: np.ndarray, sectors: np.ndarray) -> np.ndarray:
        left = np.maximum(series @ self.hidden + self.hidden_bias, 0) @ self.series
        return self._unit(np.concatenate([left, sectors @ self.sector], 1) @ self.join)

    def encode_text(self, vectors: np.ndarray) -> np.ndarray:
        return self._unit(vectors @ self.text)


def encode_texts(df: DataFrame, vector: str, encoder: DualEncoder, name: str = "encoded") -> DataFrame:
    """`df` with the text tower's vectors."""

    def run(v: pd.Series) -> pd.Series:
        return pd.Series(list(encoder.encode_text(np.array(v.to_list(), dtype=np.float64).reshape(len(v), -1))), dtype=object)

    return df.withColumn(name, F.pandas_udf(run, "array<double>")(F.col(vector)))


def encode_queries(df: DataFrame, series: str, sectors: str, encoder: DualEncoder, name: str = "encoded") -> DataFrame:
    """`df` with the query tower's vectors of a flat series and the 0/1 list of sectors."""

    def run(s: pd.Series, k: pd.Series) -> pd.Series:
        m = lambda v: np.array(v.to_list(), dtype=np.float64).reshape(len(v), -1)
        return pd.Series(list(encoder.encode_query(m(s), m(k))), dtype=object)

    return df.withColumn(name, F.pandas_udf(run, "array<double>")(F.col(series), F.col(sectors)))


def input_dims(records: DataFrame, series: str, sectors: str) -> tuple[int, int]:
    """Length of the flattened series and of the sector list; raises ValueError where records differ. One row reaches the driver."""
    flat = F.size(F.flatten(series)) if records.schema[series].dataType.simpleString().startswith("array<array") else F.size(series)
    row = records.agg(F.min(flat).alias("a"), F.max(flat).alias("b"), F.min(F.size(sectors)).alias("c"), F.max(F.size(sectors)).alias("d")).first()
    if row["a"] is None or row["a"] != row["b"] or row["c"] != row["d"]:
        raise ValueError(f"records have no common shape: {row.asDict()}")
    return row["a"], row["c"]


def judge_rows(df: DataFrame, source: str, text: str, make: Callable[[], Judge]) -> DataFrame:
    """`df` with score_<metric> and error_<metric> of each row: what a metric raises is kept as text, the others still count."""
    metrics = make().metrics
    schema = T.StructType(list(df.schema.fields))
    for m in metrics:
        schema = schema.add(f"score_{m}", "double").add(f"error_{m}", "string")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = make()
        for pdf in batches:
            for m in metrics:
                scores, errors = [], []
                for a, b in zip(pdf[source], pdf[text], strict=True):
                    try:
                        scores.append(float(judge.score(m, a if isinstance(a, str) else "", b if isinstance(b, str) else "")))
                        errors.append(None)
                    except Exception as error:
                        scores.append(None)
                        errors.append(str(error))
                pdf = pdf.assign(**{f"score_{m}": pd.Series(scores, dtype="float64", index=pdf.index), f"error_{m}": pd.Series(errors, dtype=object, index=pdf.index)})
            yield pdf

    return df.mapInPandas(run, schema)


def judge_means(judged: DataFrame, by: str) -> DataFrame:
    """Mean of every score by kind of text, rounded to four places; rows without a score don't count (errors are)."""
    scores = [c for c in judged.columns if c.startswith("score_")]
    return judged.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(F.nanvl(F.col(c), F.lit(None))), 4).alias(c) for c in scores], *[F.count(c.replace("score_", "error_")).alias(c.replace("score_", "n_errors_")) for c in scores])


def best_trial(trials: DataFrame, by: list[str], params: str = "params", loss: str = "val_loss") -> DataFrame:
    """by, params, val_loss of the trial with the least loss, ties to the smaller parameters."""
    return trials.groupBy(*by).agg(F.min(F.struct(loss, params)).alias("_x")).select(*by, f"_x.{params}", f"_x.{loss}")
