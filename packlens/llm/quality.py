"""Quality scores by a factorisation machine.

Inputs of a row: the text's words hashed to buckets (square root of the share of the text, so a
text of any length has unit norm), statistics of its structure, and metadata columns. The machine
adds a bias, a weight for each input and an interaction of each pair of inputs, the product of
their factor vectors. The sum over all pairs is taken in linear time:

    sum over i < j of <v_i, v_j> x_i x_j  =  1/2 sum over f of ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)

Training is numpy (Adam, weighted logistic loss) on a bounded sample of labelled rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from packlens.llm.common import words_of
from packlens.llm.langid import by_size

BUCKETS = 1 << 14
FACTORS = 8
#: Bound of the training sample: rows for each label. A row's inputs are bounded by the buckets, however long its text.
ROWS_PER_LABEL = 3000
STATISTICS = 11
_CAPITAL = re.compile(r"[A-Z]")
_UPPER = regex.compile(r"\p{Lu}")
_SYMBOL = re.compile(r"[^\w\s]")
_DIGIT = re.compile(r"\d")
_KNOWN_WORDS = 500_000


@dataclass(frozen=True)
class Machine:
    """Weights of the buckets followed by those of the dense inputs, which are centred and scaled first."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray
    centre: np.ndarray
    scale: np.ndarray

    def scores(self, buckets: list[np.ndarray], values: list[np.ndarray], dense: np.ndarray) -> np.ndarray:
        """Probability of label 1 of each row."""
        n = len(buckets)
        dense = self.scaled(dense)
        total = np.full(n, self.bias) + dense @ self.weights[BUCKETS:]
        sums = dense @ self.factors[BUCKETS:]
        squares = (dense**2) @ (self.factors[BUCKETS:] ** 2)
        rows = np.repeat(np.arange(n), [len(b) for b in buckets])
        if len(rows):
            ids, x = np.concatenate(buckets), np.concatenate(values).astype(np.float64)
            total += np.bincount(rows, self.weights[ids] * x, n)
            for f in range(FACTORS):
                vx = self.factors[ids, f] * x
                sums[:, f] += np.bincount(rows, vx, n)
                squares[:, f] += np.bincount(rows, vx * vx, n)
        total += 0.5 * (sums**2 - squares).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))

    def scaled(self, dense: np.ndarray) -> np.ndarray:
        return np.clip((dense - self.centre) / self.scale, -4, 4)


class Features:
    """Inputs of texts. Keeps the buckets of words it has met, up to a bound."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def bucket(self, word: str) -> int:
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= _KNOWN_WORDS:
                self.known.clear()
            found = self.known[word] = zlib.crc32(word.encode("utf-8", "replace")) & (BUCKETS - 1)
        return found

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray, list[float]]:
        """Buckets, their values, and the statistics. A null text counts as an empty one."""
        text = text or ""
        words = words_of(text)
        counts = Counter(words)
        n, chars = max(1, len(words)), max(1, len(text))
        summed: dict[int, int] = {}
        for word, c in counts.items():
            b = self.bucket(word)
            summed[b] = summed.get(b, 0) + c
        ids = np.fromiter(summed.keys(), np.int32, len(summed))
        values = np.sqrt(np.fromiter(summed.values(), np.float32, len(summed)) / n)
        letters = len("".join(words)) if words else 0
        symbols = len(_SYMBOL.findall(text))
        stats = [
            float(np.log1p(len(text))),
            float(np.log1p(len(words))),
            letters / n,
            len((_CAPITAL if text.isascii() else _UPPER).findall(text)) / chars,
            symbols / chars,
            len(_DIGIT.findall(text)) / chars,
            len(counts) / n,
            text.count("\n") / n,
            text.count("|") / n,
            text.count("!") / n,
            max(counts.values(), default=0) / n,
        ]
        return ids, values, stats


def metadata(columns: Sequence[Column]) -> Column:
    """Metadata inputs of a row: log1p of each number, 0 where it is null, negative or not finite."""
    def clean(c: Column) -> Column:
        c = c.cast("double")
        return F.when((c >= 0) & (c < float("inf")), F.log1p(c)).otherwise(F.lit(0e0))

    return F.array(*[clean(c) for c in columns]) if columns else F.array().cast("array<double>")


def sample(docs: DataFrame, labels: DataFrame, *, key: str, text: str, label: str, meta: Sequence[str], per_label: int, counts: dict[int, int]) -> DataFrame:
    """Inputs (k, y, ids, values, dense) of a bounded, repeatable sample: for each label the keys of smallest hash.

    Keys are chosen among the labels alone, so no text is shuffled: the chosen keys, a bounded
    number, go to the scan of the texts. A hash limit keeps about twice as many keys as are wanted
    before they are ranked, so a label with most rows brings no more rows to one task.
    """
    h = F.pmod(F.xxhash64("k"), F.lit(1 << 30))
    limit = F.lit(0)
    for y, n in counts.items():
        limit = F.when(F.col("y") == y, int((1 << 30) * min(1.0, (2 * per_label + 100) / n))).otherwise(limit)
    rank = F.row_number().over(Window.partitionBy("y").orderBy("h", "k"))
    chosen = (
        labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(label).cast("int").alias("y"))
        .withColumn("h", h).filter(F.col("h") < limit).withColumn("r", rank).filter(F.col("r") <= per_label).select("k", "y").distinct()
    )
    texts = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), metadata([F.col(c) for c in meta]).alias("m"))

    def inputs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features = Features()
        for batch in batches:
            found = [features.of(t) for t in batch["t"]]
            yield pd.DataFrame({
                "k": batch["k"], "y": batch["y"],
                "ids": [f[0].tobytes() for f in found], "values": [f[1].tobytes() for f in found],
                "dense": [np.array([*f[2], *m]).tobytes() for f, m in zip(found, batch["m"], strict=True)],
            })

    return texts.join(F.broadcast(chosen), "k").mapInPandas(inputs, "k long, y int, ids binary, values binary, dense binary")


def fit(
    ids: list[np.ndarray], values: list[np.ndarray], dense: np.ndarray, y: np.ndarray, weight: np.ndarray, *,
    epochs: int = 12, batch: int = 128, rate: float = 0.01, decay: float = 1e-4, seed: int = 3,
) -> Machine:
    rng = np.random.default_rng(seed)
    size = BUCKETS + dense.shape[1]
    centre, scale = dense.mean(0), dense.std(0) + 1e-6
    dense = np.clip((dense - centre) / scale, -4, 4)
    p = {"b": np.zeros(1), "w": np.zeros(size), "v": rng.normal(0, 0.05, (size, FACTORS))}
    first = {k: np.zeros_like(a) for k, a in p.items()}
    second = {k: np.zeros_like(a) for k, a in p.items()}
    tail, step = np.arange(BUCKETS, size), 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for start in range(0, len(order), batch):
            rows = order[start : start + batch]
            own = np.concatenate([np.repeat(np.arange(len(rows)), [len(ids[r]) for r in rows]), np.repeat(np.arange(len(rows)), len(tail))])
            at = np.concatenate([*(ids[r] for r in rows), np.tile(tail, len(rows))])
            x = np.concatenate([*(values[r] for r in rows), dense[rows].reshape(-1)]).astype(np.float64)
            vx = p["v"][at] * x[:, None]
            sums = np.stack([np.bincount(own, vx[:, f], len(rows)) for f in range(FACTORS)], 1)
            squares = np.bincount(own, (vx**2).sum(1), len(rows))
            z = p["b"][0] + np.bincount(own, p["w"][at] * x, len(rows)) + 0.5 * ((sums**2).sum(1) - squares)
            wrong = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows]) * weight[rows] / weight[rows].sum()
            pull = wrong[own] * x
            grad = {
                "b": np.array([wrong.sum()]),
                "w": np.bincount(at, pull, size) + decay * p["w"],
                "v": np.stack([np.bincount(at, pull * (sums[own, f] - vx[:, f]), size) for f in range(FACTORS)], 1) + decay * p["v"],
            }
            step += 1
            for k, g in grad.items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                p[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return Machine(float(p["b"][0]), p["w"], p["v"], centre, scale)


def train(
    docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality",
    meta: Sequence[str] = ("n_chars",), per_label: int = ROWS_PER_LABEL,
) -> Machine | None:
    """A machine fitted to a bounded sample of the documents that ``labels`` (key, label) marks 0 or 1; None where there are none.

    Labels keep the weight they have among all rows, whatever their share of the sample.
    """
    marked = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull())
    shares = {r["y"]: r["n"] for r in marked.groupBy(F.col(label).cast("int").alias("y")).agg(F.count("*").alias("n")).collect()}
    found = sample(docs, labels, key=key, text=text, label=label, meta=meta, per_label=per_label, counts=shares).toPandas()
    if found.empty:
        return None
    found = found.sort_values(["k", "y"], kind="stable")
    y = found["y"].to_numpy(np.float64)
    drawn = found["y"].value_counts().to_dict()
    weight = np.array([shares[v] / drawn[v] for v in found["y"]])
    return fit(
        [np.frombuffer(b, np.int32) for b in found["ids"]], [np.frombuffer(b, np.float32) for b in found["values"]],
        np.stack([np.frombuffer(b) for b in found["dense"]]), y, weight / weight.mean(),
    )


def score(spark: SparkSession, machine: Machine | None, text: Column, meta: Sequence[Column] = ()) -> Column:
    """Probability that a text has label 1. Null texts are scored as empty ones; 0.5 without a machine.

    The machine has a fixed size (buckets times factors) and goes out as a broadcast value.
    """
    shared = spark.sparkContext.broadcast(machine)

    def scored(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model, features = shared.value, Features()
        for texts, more in batches:
            out = np.full(len(texts), 0.5)
            if model:
                texts = texts.where(texts.notna(), "")
                for group in by_size(list(range(len(texts))), texts):
                    found = [features.of(texts.iloc[i]) for i in group]
                    dense = np.array([[*f[2], *more.iloc[i]] for f, i in zip(found, group, strict=True)])
                    out[group] = model.scores([f[0] for f in found], [f[1] for f in found], dense)
            yield pd.Series(out)

    return F.pandas_udf(scored, "double").asNondeterministic()(text, metadata(meta))
