"""Language identification by a convolutional network over bytes.

Each text is cut into windows of a fixed number of UTF-8 bytes. A window's bytes are embedded,
filters of several widths slide over them, each filter keeps its largest response, and a softmax
over these gives the window's languages. A text's languages are the mean over all its windows, so
that every byte of a long text counts. Training is plain numpy (Adam, mini-batches) on windows of
a bounded sample of labelled texts.

For scoring, embedding and filters are folded into two tables indexed by pairs of neighbouring
bytes; a response is then the sum of two table rows. That is the same network, evaluated by
look-ups in place of multiplications.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from packlens.llm.common import staged

#: Bytes of a window, and the widths of the filters.
WINDOW = 256
WIDTHS = (2, 3, 4)
SPAN = 4
#: Bounds of the training sample: texts for a language, texts in all, windows for a text. Every language has one text at least.
TEXTS_PER_LANGUAGE = 2000
TEXTS_IN_ALL = 128_000
WINDOWS_PER_TEXT = 4
UNKNOWN = "und"
#: Windows scored in one numpy call.
BATCH = 64


@dataclass(frozen=True)
class ByteNet:
    """A trained network. ``bytes_`` is 256 x e, ``filters`` (4 x e) x f with zeros beyond a filter's width."""

    languages: tuple[str, ...]
    bytes_: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def pair_tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Responses of the filters to the byte pair at offset 0, and to that at offset 2."""
        e = self.bytes_.shape[1]
        single = [self.bytes_ @ self.filters[j * e : (j + 1) * e] for j in range(SPAN)]
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, -1).astype(np.float32)
        return pair(single[0], single[1]), pair(single[2], single[3])

    def probabilities(self, windows: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Softmax of each row of ``windows`` (n x (WINDOW + 3) bytes)."""
        found = np.empty((len(windows), self.filters.shape[1]), np.float32)
        codes = windows[:, :-1].astype(np.int32) * 256 + windows[:, 1:]
        for at in range(0, len(windows), BATCH):
            c = codes[at : at + BATCH]
            answer = tables[0].take(c[:, :WINDOW], axis=0)
            answer += tables[1].take(c[:, 2 : WINDOW + 2], axis=0)
            found[at : at + BATCH] = answer.max(axis=1)
        return softmax(np.maximum(found + self.bias, 0) @ self.out + self.out_bias)


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def windows_of(text: str) -> np.ndarray:
    """All windows of a text, the last one filled with zero bytes, each followed by three zero bytes."""
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    n = max(1, -(-len(data) // WINDOW))
    out = np.zeros((n, WINDOW + SPAN - 1), np.uint8)
    whole = np.zeros(n * WINDOW, np.uint8)
    whole[: len(data)] = data
    out[:, :WINDOW] = whole.reshape(n, WINDOW)
    return out


def fit_network(
    windows: np.ndarray, labels: np.ndarray, languages: tuple[str, ...], *, embed: int = 8, filters: int = 16,
    epochs: int = 3, least_steps: int = 600, batch: int = 64, rate: float = 0.004, seed: int = 7,
) -> ByteNet:
    """Trains on windows (n x (WINDOW + 3) bytes) and class numbers. The same input gives the same network.

    A small sample is gone through more often than ``epochs`` times, for ``least_steps`` steps in all.
    """
    epochs = max(epochs, -(-least_steps // -(-len(windows) // batch)))
    rng = np.random.default_rng(seed)
    total = filters * len(WIDTHS)
    mask = np.zeros((SPAN * embed, total), np.float32)
    for k, width in enumerate(WIDTHS):
        mask[: width * embed, k * filters : (k + 1) * filters] = 1
    p = {
        "bytes": rng.normal(0, 0.5, (256, embed)).astype(np.float32),
        "filters": rng.normal(0, 0.3, mask.shape).astype(np.float32) * mask,
        "bias": np.zeros(total, np.float32),
        "out": rng.normal(0, 0.1, (total, len(languages))).astype(np.float32),
        "out_bias": np.zeros(len(languages), np.float32),
    }
    first = {k: np.zeros_like(v) for k, v in p.items()}
    second = {k: np.zeros_like(v) for k, v in p.items()}
    at = np.arange(WINDOW)[:, None] + np.arange(SPAN)[None, :]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for start in range(0, len(order), batch):
            rows = order[start : start + batch]
            x, y = windows[rows], labels[rows]
            seen = p["bytes"][x]  # n, WINDOW + 3, e
            spans = np.lib.stride_tricks.sliding_window_view(seen, SPAN, axis=1)  # n, WINDOW, e, SPAN
            spans = np.ascontiguousarray(spans.transpose(0, 1, 3, 2)).reshape(len(rows) * WINDOW, SPAN * embed)
            answer = (spans @ p["filters"]).reshape(len(rows), WINDOW, total)
            where = answer.argmax(axis=1)  # n, total
            pooled = np.take_along_axis(answer, where[:, None, :], axis=1)[:, 0] + p["bias"]
            hidden = np.maximum(pooled, 0)
            wrong = softmax(hidden @ p["out"] + p["out_bias"])
            wrong[np.arange(len(rows)), y] -= 1
            wrong /= len(rows)
            back = (wrong @ p["out"].T) * (pooled > 0)  # n, total
            best = spans.reshape(len(rows), WINDOW, -1)[np.arange(len(rows))[:, None], where]  # n, total, 4e
            grad = {
                "out": hidden.T @ wrong,
                "out_bias": wrong.sum(0),
                "bias": back.sum(0),
                "filters": np.einsum("nt,ntd->dt", back, best) * mask,
                "bytes": np.zeros_like(p["bytes"]),
            }
            down = (back[:, :, None] * p["filters"].T[None]).reshape(-1, embed)  # n * total * SPAN, e
            hit = np.take_along_axis(x[:, None, :], at[where].reshape(len(rows), 1, -1), axis=2).reshape(-1)
            np.add.at(grad["bytes"], hit, down)
            step += 1
            for k, g in grad.items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                p[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return ByteNet(languages, p["bytes"], p["filters"], p["bias"], p["out"], p["out_bias"])


def sample_windows(
    texts: DataFrame, *, key: str, text: str, lang: str, per_language: int = TEXTS_PER_LANGUAGE,
    in_all: int = TEXTS_IN_ALL, per_text: int = WINDOWS_PER_TEXT,
) -> DataFrame:
    """Windows (``lang``, ``bytes``) of a bounded, repeatable sample of the labelled texts.

    Every label takes part with the ``per_language`` texts whose key has the smallest hash, fewer where
    there are so many labels that ``in_all`` texts would not do, each text with ``per_text`` windows
    spread over its length. A hash limit keeps about
    twice as many rows as are wanted before they are ranked, so a label with most rows brings no
    more rows to one task than any other.
    """
    rows = texts.select(F.col(key).alias("k"), F.col(lang).alias("l")).filter("k is not null and l is not null")
    common = staged(rows.groupBy("l").count(), "labels")
    labels = common.count()
    per_language = max(1, min(per_language, in_all // max(1, labels)))
    # Joined by broadcast as long as the labels are few, so that no label's texts meet in one task.
    common = F.broadcast(common) if labels <= in_all else common
    rank = F.row_number().over(Window.partitionBy("l").orderBy("h", "k"))
    chosen = (
        rows.withColumn("h", F.pmod(F.xxhash64("k"), F.lit(1 << 30))).join(common, "l")
        .filter(F.col("h") * F.col("count") < F.lit((1 << 30) * (2 * per_language + 100)))
        .withColumn("r", rank).filter(F.col("r") <= per_language).select("k").distinct()
    )
    raw = (
        texts.select(F.col(key).alias("k"), F.col(lang).alias("l"), F.col(text).alias("t"))
        .join(F.broadcast(chosen), "k", "left_semi")
        .select("k", "l", F.col("t").cast("binary").alias("b"))
        .filter("l is not null and b is not null and length(b) > 0")
        .withColumn("n", F.ceil(F.length("b") / WINDOW).cast("int"))
    )
    picks = F.transform(
        F.sequence(F.lit(0), F.least(F.col("n"), F.lit(per_text)) - 1),
        lambda i: F.floor(i * F.col("n") / F.least(F.col("n"), F.lit(per_text))).cast("int"),
    )
    return raw.select("k", "l", "b", F.explode(picks).alias("i")).select(
        "k", F.col("l").alias("lang"), "i", F.expr(f"substring(b, i * {WINDOW} + 1, {WINDOW})").alias("bytes")
    )


def train(texts: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", **bounds: int) -> ByteNet | None:
    """A network fitted to a bounded sample of ``texts``; None where no text has a label."""
    found = sample_windows(texts, key=key, text=text, lang=lang, **bounds).toPandas()
    if found.empty:
        return None
    found = found.sort_values(["lang", "k", "i"], kind="stable")
    languages = tuple(sorted(found["lang"].unique()))
    windows = np.zeros((len(found), WINDOW + SPAN - 1), np.uint8)
    for row, data in zip(windows, found["bytes"], strict=True):
        row[: len(data)] = np.frombuffer(bytes(data), np.uint8)
    labels = np.searchsorted(np.array(languages, object), found["lang"].to_numpy(object))
    return fit_network(windows, labels, languages)


def identify(spark: SparkSession, net: ByteNet | None, text: Column) -> Column:
    """Struct (lang, score) of a text. Null, empty or without a letter: ``und`` and 0.

    The network, some hundred kilobytes at most, goes to the executors as a broadcast value.
    Texts are scored one after another, each in batches of windows, so memory is bounded by the
    longest text.
    """
    shared = spark.sparkContext.broadcast(net)

    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared.value
        tables = model.pair_tables() if model else None
        for batch in batches:
            langs, scores = [UNKNOWN] * len(batch), np.zeros(len(batch))
            known = [i for i, t in enumerate(batch) if model and isinstance(t, str) and any(map(str.isalpha, t))]
            for group in by_size(known, batch):
                cut = [windows_of(batch.iloc[i]) for i in group]
                share = model.probabilities(np.concatenate(cut), tables)
                starts = np.cumsum([0, *map(len, cut)])[:-1]
                mean = np.add.reduceat(share, starts, axis=0) / np.array([len(c) for c in cut])[:, None]
                for i, row in zip(group, mean, strict=True):
                    best = int(row.argmax())
                    langs[i], scores[i] = model.languages[best], float(min(1.0, row[best]))
            yield pd.DataFrame({"lang": langs, "score": scores})

    # Not deterministic only in name: it keeps a filter on the result from running the network twice.
    return F.pandas_udf(scored, "lang string, score double").asNondeterministic()(text)


def by_size(rows: list[int], texts: pd.Series, chars: int = 1 << 20) -> Iterator[list[int]]:
    """Consecutive rows whose texts together have about ``chars`` characters; a longer text is alone."""
    group, size = [], 0
    for i in rows:
        n = len(texts.iloc[i])
        if group and size + n > chars:
            yield group
            group, size = [], 0
        group.append(i)
        size += n
    if group:
        yield group
