"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Documents are reduced to counts in one narrow pass over Arrow buffers. Counts become shares that are drawn towards the usual
share where a text is short, then angles, whose spread depends little on the share. Each class is a Gaussian whose covariance is
shrunk towards a scaled identity by as much as its size asks for; the score is the logistic of the difference of the two log
densities, each a Mahalanobis distance under a cached Cholesky factor.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import give_back, stored, table
from .language_id import held_out

#: Bytes of text counted at once, about; a longer text is counted in pieces cut at white space.
PIECE_BYTES = 2 << 20
#: Words before a word in which it is looked for.
NEAR = 4
#: Statistics of a text, in bytes or words.
COUNTS = ["spaces", "letters", "upper", "digits", "marks", "symbols", "lines", "words", "word_bytes", "marked", "repeated", "near", "short", "long", "ended"]
#: Features: share of a statistic in another, and the units of the latter that a short text is filled up with at the usual share.
SHARES = [
    ("spaces", "bytes", 50), ("upper", "bytes", 50), ("digits", "bytes", 50), ("marks", "bytes", 50), ("symbols", "bytes", 50), ("lines", "words", 20),
    ("marked", "words", 20), ("repeated", "words", 20), ("near", "words", 20), ("short", "words", 20), ("long", "words", 20), ("ended", "words", 20),
]
#: Variance, in units of the pooled one, below which no direction of a class falls.
FLOOR = 0.02

_KIND = np.full(256, 1, np.uint8)  # 0 white space, 1 letter, 2 upper-case letter, 3 digit, 4 usual mark, 5 symbol
_KIND[:128] = 5
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[97:123], _KIND[65:91], _KIND[48:58] = 1, 2, 3
_KIND[[ord(c) for c in ".,;:!?'\"()-"]] = 4
_STOP = np.isin(np.arange(256), [ord(c) for c in ".!?"])
#: Powers of an odd base and of its inverse modulo 2 ** 64, for rolling hashes of words.
_BASE = 0x9E3779B97F4A7C15


def _between(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def count_texts(text: np.ndarray, offsets: np.ndarray, before: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(counts of every text in the order of COUNTS, hashes of the last NEAR words); texts lie one after the other.

    before: what the call for the piece before returned, where the one text is a piece of a longer one.
    """
    kind = _KIND[text]
    out = [_between(kind == k, offsets) for k in range(6)] + [_between(text == 10, offsets)]
    word = kind > 0
    left, right = np.concatenate([[False], word[:-1]]), np.concatenate([word[1:], [False]])
    left[offsets[:-1][offsets[:-1] < len(text)]] = False
    right[offsets[1:][offsets[1:] > 0] - 1] = False
    start, end = np.flatnonzero(word & ~left), np.flatnonzero(word & ~right) + 1
    cuts = np.searchsorted(start, offsets)
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(text), _BASE, np.uint64)]))
    inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(text), pow(_BASE, -1, 1 << 64), np.uint64)]))
    sums = np.concatenate([[np.uint64(0)], np.cumsum((text + np.uint64(1)) * power[:-1], dtype=np.uint64)])
    hashes = (sums[end] - sums[start]) * inverse[start]
    number = np.repeat(np.arange(len(offsets) - 1), np.diff(cuts))
    if before is not None:
        hashes, number = np.concatenate([before, hashes]), np.concatenate([np.zeros(len(before), np.int64), number])
    n_before = len(hashes) - len(start)
    same = []
    for k in range(1, NEAR + 1):
        found = np.zeros(len(hashes), bool)
        found[k:] = (hashes[k:] == hashes[:-k]) & (number[k:] == number[:-k])
        same.append(found[n_before:])
    symbols = np.concatenate([[0], np.cumsum(kind == 5, dtype=np.int64)])
    size = end - start
    flags = [symbols[end] > symbols[start], same[0], np.logical_or.reduce(same[1:]) & ~same[0], size <= 3, size >= 16, _STOP[text[end - 1]] if len(end) else np.zeros(0, bool)]
    out += [np.diff(cuts), _between(word, offsets), *[_between(f, cuts) for f in flags]]
    return np.stack(out, 1), hashes[-NEAR:]


def _count_long(text: np.ndarray) -> np.ndarray:
    total, before, at = np.zeros((1, len(COUNTS)), np.int64), np.empty(0, np.uint64), 0
    while at < len(text):
        end = min(at + PIECE_BYTES, len(text))
        while end < len(text) and _KIND[text[end]]:
            end += 1
        counts, before = count_texts(text[at:end], np.array([0, end - at]), before)
        total += counts
        at = end
    return total


def document_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with a column `counts`, an array of longs in the order of COUNTS; null texts are empty, a narrow map.

    `text` itself is left out; a column named counts is replaced.
    """
    keep = [c for c in docs.columns if c not in (text, "counts")]

    @F.pandas_udf("array<long>")
    def count(texts: pd.Series) -> pd.Series:
        whole = pa.array(texts, pa.large_string(), from_pandas=True).fill_null("").cast(pa.large_binary())
        offsets = np.frombuffer(whole.buffers()[1], np.int64)[: len(whole) + 1]
        data = np.frombuffer(whole.buffers()[2] or b"", np.uint8)
        parts, at = [], 0
        while at < len(whole):
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE_BYTES, "right")) - 1)
            part = data[offsets[at] : offsets[end]]
            parts.append(_count_long(part) if len(part) > 2 * PIECE_BYTES else count_texts(part, offsets[at : end + 1] - offsets[at])[0])
            at = end
        give_back()
        return pd.Series(list(np.concatenate(parts)) if parts else [], dtype=object)

    return docs.select(*keep, count(F.col(text)).alias("counts"))


@dataclass
class Gaussian:
    """A class: mean, Cholesky factor of the shrunk covariance, log of its determinant, log prior."""

    mean: np.ndarray
    factor: np.ndarray
    log_det: float
    log_prior: float

    def log_density(self, x: np.ndarray) -> np.ndarray:
        z = np.linalg.solve(self.factor, (x - self.mean).T)
        return self.log_prior - 0.5 * (self.log_det + (z * z).sum(0))


@dataclass
class Model:
    """usual: the shares that short texts are drawn to; centre and scale of the angles; classes 0 and 1, None where no row had the label."""

    usual: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    classes: list[Gaussian | None]

    def score(self, counts: np.ndarray) -> np.ndarray:
        """Probability of class 1. With one class known it is certain, with none 0.5."""
        low, high = self.classes
        if low is None or high is None:
            return np.full(len(counts), 0.5 if low is high else float(high is not None))
        x = (angles(counts, self.usual) - self.centre) / self.scale
        return 1 / (1 + np.exp(np.clip(low.log_density(x) - high.log_density(x), -700, 700)))


def _parts(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(numerators, denominators) of SHARES."""
    column = {name: counts[:, i].astype(np.float64) for i, name in enumerate(COUNTS)}
    column["bytes"] = column["spaces"] + column["word_bytes"]
    return np.stack([column[a] for a, _, _ in SHARES], 1), np.stack([column[b] for _, b, _ in SHARES], 1)


def angles(counts: np.ndarray, usual: np.ndarray) -> np.ndarray:
    """arcsin sqrt of each share, filled up with the usual one; shares over 1 (more lines than words) count as 1."""
    own, of = _parts(counts)
    fill = np.array([w for _, _, w in SHARES], np.float64)
    return np.arcsin(np.sqrt(np.minimum((own + fill * usual) / (of + fill), 1.0)))


def shrink(s: np.ndarray, n: float) -> tuple[np.ndarray, float]:
    """(covariance, weight): s of n rows mixed with a scaled identity, oracle-approximating weight (Chen, Wiesel, Eldar, Hero 2010)."""
    p = len(s)
    trace, square = np.trace(s), (s * s).sum()
    off = (n + 1 - 2 / p) * (square - trace**2 / p)
    weight = 1.0 if off <= 0 else min(1.0, ((1 - 2 / p) * square + trace**2) / off)
    return (1 - weight) * s + weight * trace / p * np.eye(p), weight


def fit(labelled: DataFrame, label: str = "quality") -> Model:
    """A model from rows with `counts` and a label 0 or 1; other labels and nulls teach nothing. All rows count: tasks add up
    moments, some hundred numbers each, which Spark sums."""
    rows = labelled.select("counts", F.col(label).cast("int").alias("label")).where("label in (0, 1) and counts is not null")
    d = len(SHARES)

    def summed(moments) -> dict[int, np.ndarray]:
        def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                for k, own in batch.groupby("label"):
                    found = moments(np.stack(own["counts"].to_numpy()))
                    sums[k] = sums[k] + found if k in sums else found
            for k, v in sums.items():
                yield pd.DataFrame({"label": k, "i": np.arange(len(v)), "v": v})

        total = rows.mapInPandas(partial, "label int, i int, v double").groupBy("label", "i").agg(F.sum("v").alias("v")).toPandas().sort_values("i")  # at most 2 (1 + d + d * d) rows
        return {int(k): own["v"].to_numpy() for k, own in total.groupby("label")}

    first = summed(lambda c: np.concatenate([x.sum(0) for x in _parts(c)]))
    both = sum(first.values()) if first else np.zeros(2 * d)
    usual = both[:d] / np.maximum(both[d:], 1.0)

    def second(c: np.ndarray) -> np.ndarray:
        x = angles(c, usual)
        return np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()])

    known = summed(second)
    zero = np.zeros(1 + d + d * d)
    n, s1, s2 = (lambda t: (max(t[0], 1.0), t[1 : 1 + d], t[1 + d :].reshape(d, d)))(sum(known.values(), zero))
    centre = s1 / n
    scale = np.maximum(np.sqrt(np.maximum(np.diag(s2) / n - centre**2, 0.0)), 1e-3)
    classes: list[Gaussian | None] = [None, None]
    for k, t in known.items():
        m = t[1 : 1 + d] / t[0]
        covariance = (t[1 + d :].reshape(d, d) / t[0] - np.outer(m, m)) / np.outer(scale, scale)
        factor = np.linalg.cholesky(shrink(covariance, t[0])[0] + FLOOR * np.eye(d))
        classes[k] = Gaussian((m - centre) / scale, factor, 2 * np.log(np.diag(factor)).sum(), np.log(t[0] / n))
    return Model(usual, centre, scale, classes)


def score_documents(counted: DataFrame, model: Model) -> DataFrame:
    """counted (see document_counts) with `score` instead of `counts`. The model is a few kB."""
    shared = counted.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(counts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(np.stack(counts.to_numpy())) if len(counts) else [], dtype=float)

    return counted.select(*[c for c in counted.columns if c not in ("counts", "score")], score("counts").alias("score"))


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """docs without `text`, with `score` (0 to 1, higher: label 1 likelier). labels: (doc_id, label) of the rows to learn from.

    Texts that are null, empty or of white space only have the usual shares, and a score like any other. Very long texts are
    counted whole, in pieces. Repeated rows are scored alike, and a repeated id teaches each of its texts each of its labels once
    per row of docs. Null ids have a score and teach nothing. Without labels every score is 0.5, with labels of one class 1 or 0.
    An empty table gives no row. Texts are read once; what is joined and kept is a row of counts a document.
    """
    counted = stored(document_counts(docs, text), "counts")
    known = labels.select(F.col(doc_id).alias("_id"), F.col(label).alias("_label")).distinct()
    rows = counted.select(F.col(doc_id).alias("_id"), "counts").join(known, "_id").select("counts", "_label")
    return score_documents(counted, fit(rows, "_label"))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every text of `documents`, learned from labels of ids whose crc32 mod 5 is not 0."""
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"), 5, 0))
    found = classify(table(spark, sf_dir, "documents").select("doc_id", "text"), labels)
    return found.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
