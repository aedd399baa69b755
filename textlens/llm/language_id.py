"""Language ID: interpolated Kneser-Ney character models, one per language, over shared sorted hash arrays."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import give_back, table

ORDER = 4
#: Labelled documents that each language's model is fitted on at most, half as many again to calibrate: of those with the smallest
#: hashes every third calibrates, however few there are.
DOCS_PER_LANGUAGE = 400
#: Held-out texts from which a language has a mean and a spread of its own; one with fewer takes those of all languages together
#: (one odd text among few would make its spread so wide that nothing is rejected).
OWN_MEAN, OWN_SPREAD = 5, 30
#: Parts of a language in which the smallest hashes are found first, so that a language with very many rows isn't one task's.
SALTS = 16
#: A text is rejected when even its best model is this many standard deviations worse than held-out texts of that language.
REJECT_Z = 12.0
#: Characters scored at once; a longer text is scored in pieces.
BATCH_CHARS = 250_000
UNKNOWN = "und"

#: Letters and marks by Unicode category; numerals that aren't digits (½, Ⅷ) are gaps too.
_GAPS, _LETTER = regex.compile(r"[^\p{L}\p{M}]+"), regex.compile(r"\p{L}")


def letters_of(text: str | None) -> str:
    """Lower-case letters and marks with a blank for every run of anything else, blanks around; empty if there is no letter."""
    words = _GAPS.sub(" ", (text or "").lower()).strip(" ")
    return f" {words} " if _LETTER.search(words) else ""


def gram_hashes(codes: np.ndarray, order: int) -> np.ndarray:
    """64-bit hashes of all n-grams of one order; the one at i covers codes[i : i + order]."""
    n = len(codes) - order + 1
    h = np.full(max(n, 0), order, np.uint64)
    for k in range(order):
        h = (h ^ codes[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


@dataclass
class Order:
    """n-grams of one order: sorted hashes, for each language the log probability (with all lower orders mixed in) and, if
    the n-gram is a context of the next order, the log weight left to that order's unseen continuations. `index` holds where
    the hashes with the same leading bits begin."""

    hashes: np.ndarray
    logp: np.ndarray
    backoff: np.ndarray

    def __post_init__(self):
        self.bits = max(1, int(len(self.hashes)).bit_length())
        starts = np.arange((1 << self.bits) + 1, dtype=np.float64) * 2.0 ** (64 - self.bits)
        self.index = np.searchsorted(self.hashes, np.append(starts[:-1].astype(np.uint64), np.uint64(2**64 - 1)), "left")
        self.index[-1] = len(self.hashes)
        self.longest = int(np.diff(self.index).max(initial=0))

    def find(self, h: np.ndarray) -> np.ndarray:
        """Places of hashes, -1 where absent: a jump to the slot of the leading bits, then a few steps."""
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        at, end = self.index[slot], self.index[slot + 1]
        if not len(self.hashes):
            return np.full(len(h), -1)
        last = len(self.hashes) - 1
        hit = self.hashes[np.minimum(at, last)] == h
        out = np.where(hit & (at < end), at, -1)
        open_ = np.flatnonzero((out < 0) & (at + 1 < end))
        for k in range(1, self.longest):
            if not len(open_):
                break
            place = at[open_] + k
            hit = self.hashes[place] == h[open_]
            out[open_[hit]] = place[hit]
            open_ = open_[~hit & (place + 1 < end[open_])]
        return out


@dataclass
class Model:
    languages: list[str]
    orders: list[Order]  # of 1, 2, ... ORDER
    floor: np.ndarray  # log probability of an unknown character
    calibration: np.ndarray | None = None  # per language: mean, spread between texts, spread of one character

    def entropies(self, codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pieces x languages) negative log probability, and how many characters counted: all but the ORDER - 1 that each piece
        begins with, which are its context. Pieces start at `starts`."""
        n = len(codes)
        order, lengths = len(self.orders), np.diff(np.append(starts, n))
        # the character at i is predicted from at most order - 1 characters before it in the same text
        since = np.arange(n) - np.repeat(starts, lengths)
        total = np.zeros((n, len(self.languages)), np.float32)
        todo = np.arange(n)
        for k in range(order, 0, -1):
            if not len(todo):
                break
            model, ends = self.orders[k - 1], todo
            long = since[ends] >= k - 1
            h = gram_hashes(codes, k)
            place = np.full(len(ends), -1)
            place[long] = model.find(h[ends[long] - k + 1])
            seen = place >= 0
            total[ends[seen]] += model.logp[place[seen]]
            todo = ends[~seen]
            if k > 1 and len(todo):  # the context's weight for what it hasn't been followed by
                context = since[todo] >= k - 1
                at = todo[context]
                found = self.orders[k - 2].find(gram_hashes(codes, k - 1)[at - k + 1])
                total[at[found >= 0]] += self.orders[k - 2].backoff[found[found >= 0]]
        total[todo] += self.floor
        counted = since >= order - 1
        sums = np.add.reduceat(np.where(counted[:, None], total, 0), starts, axis=0, dtype=np.float64) if n else np.empty((0, len(self.languages)))
        return -sums, np.maximum(lengths - order + 1, 0)

    def predict(self, texts: list[str | None]) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
        """(language, score, cross-entropy, rejected) of each text."""
        names, score, best, rejected = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.full(len(texts), np.nan), np.ones(len(texts), bool)
        order, h, n = len(self.orders), np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64)
        group: list[tuple[int, np.ndarray]] = []
        size = 0

        def flush():
            if group:
                starts = np.concatenate([[0], np.cumsum([len(p) for _, p in group])[:-1]])
                sums, counts = self.entropies(np.concatenate([p for _, p in group]), starts)
                rows = [r for r, _ in group]
                np.add.at(h, rows, sums)
                np.add.at(n, rows, counts)

        for i, text in enumerate(texts):
            if clean := letters_of(text):
                codes = _codes(" " * (order - 2) + clean)  # as in training
                for a in range(0, len(codes) - order + 1, BATCH_CHARS):
                    group.append((i, codes[a : a + BATCH_CHARS + order - 1]))
                    size += len(group[-1][1])
                    if size > BATCH_CHARS:
                        flush()
                        group, size = [], 0
        flush()
        rows = np.flatnonzero(n)
        if len(rows):
            m = n[rows]
            h = h[rows] / m[:, None]
            pick = h.argmin(1)
            top = h[np.arange(len(rows)), pick]
            # posterior of the best model if a text were worth 50 characters at most
            weight = np.exp(-np.minimum(m, 50)[:, None] * (h - top[:, None]))
            score[rows], best[rows] = 1 / weight.sum(1), top
            rejected[rows] = False
            if self.calibration is not None:
                mean, between, within = self.calibration[pick].T
                rejected[rows] = (top - mean) / np.sqrt(between**2 + within**2 / m) > REJECT_Z
            for r, p in zip(rows.tolist(), pick, strict=True):
                names[r] = self.languages[p]
        return names, score, best, rejected


def fit(grams: pd.DataFrame, languages: list[str], order: int = ORDER) -> Model:
    """Interpolated Kneser-Ney from counts of the highest order: columns language (number), gram (of `order` characters), n.
    Lower orders count the distinct characters that precede an n-gram; one discount per order and language, n1 / (n1 + 2 n2)."""
    frames = {order: grams[["language", "gram", "n"]]}
    for k in range(order - 1, 0, -1):
        shorter = frames[k + 1].assign(gram=frames[k + 1]["gram"].str[1:])
        frames[k] = shorter.groupby(["language", "gram"], sort=False, as_index=False)["gram"].size().rename(columns={"size": "n"})
    L = len(languages)
    sizes = np.array([(frames[1]["language"] == i).sum() for i in range(L)])
    uniform = 1.0 / (sizes + 1)
    orders, floors = [], np.log(uniform)
    previous: tuple[dict, np.ndarray] | None = None  # gram -> row of the order below, its probabilities
    held: list[tuple[list[str], np.ndarray, np.ndarray]] = []
    for k in range(1, order + 1):
        f = frames[k]
        names = f["gram"].unique()
        if k < order:  # contexts that only stand at a text's start have a weight too
            names = pd.unique(np.concatenate([names, frames[k + 1]["gram"].str[:-1].unique()]))
        row = pd.Series(np.arange(len(names)), index=names)
        counts = np.zeros((len(names), L))
        counts[row[f["gram"]].to_numpy(), f["language"].to_numpy()] = f["n"].to_numpy()
        n1, n2 = (counts == 1).sum(0), (counts == 2).sum(0)
        discount = np.where(n1 > 0, n1 / np.maximum(n1 + 2 * n2, 1), 0.5)
        discount = np.clip(discount, 0.05, 0.95)
        contexts = pd.Series(names).str[:-1]
        group, labels = pd.factorize(contexts)
        total, kinds = np.zeros((len(labels), L)), np.zeros((len(labels), L))
        np.add.at(total, group, counts)
        np.add.at(kinds, group, counts > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            weight = np.where(total > 0, discount * kinds / total, 1.0)  # left to the lower order
            main = np.where(total[group] > 0, np.maximum(counts - discount, 0) / total[group], 0.0)
        if k == 1:
            below = np.broadcast_to(uniform, counts.shape)
            floors = np.log(np.where(total[0] > 0, weight[0], 1.0) * uniform) if len(labels) else np.log(uniform)
        else:
            index, p = previous
            below = p[index.reindex(pd.Series(names).str[1:]).to_numpy(dtype=np.int64)]
        p = main + weight[group] * below
        held.append((list(names), p, np.ones((len(names), L))))
        if k > 1:  # the weights belong to the contexts, n-grams of the order below
            at = previous[0].reindex(labels)
            ok = at.notna().to_numpy()
            held[k - 2][2][at[ok].to_numpy(dtype=np.int64)] = weight[ok]
        previous = row, p
    for k, (names, p, weight) in enumerate(held, 1):
        h = gram_hashes(np.concatenate([_codes(x) for x in names]) if names else np.empty(0, np.uint64), k)[::k] if names else np.empty(0, np.uint64)
        by = np.argsort(h)
        orders.append(Order(h[by], np.log(p[by]).astype(np.float32), np.log(weight[by]).astype(np.float32)))
    return Model(languages, orders, floors.astype(np.float32))


def _spread(h: np.ndarray, n: np.ndarray, mean: np.ndarray | float) -> tuple[float, float]:
    """(spread between long texts, spread of one character) of the cross-entropies h of texts of n characters about mean."""
    off = (h - mean) ** 2
    return max(np.sqrt(off[n >= np.median(n)].mean()), 0.05), max(np.sqrt((off * n).mean()), 1.0)


def _calibration(told: pd.DataFrame, languages: list[str]) -> np.ndarray:
    """(mean, spread between texts, spread of a character) by language from held-out texts: columns language, h and n. A language
    with fewer than OWN_SPREAD takes the spread of all together, with fewer than OWN_MEAN also at least their mean, with none
    the largest mean. With fewer than OWN_MEAN texts in all there is no spread to measure, and nothing with letters is rejected."""
    calibration = np.tile([0.0, 10.0, 10.0], (len(languages), 1))
    if len(told) < OWN_MEAN:
        return calibration
    h, n, names = told["h"].to_numpy(), told["n"].to_numpy(), told["language"].to_numpy()
    means = {x: np.average(h[names == x], weights=n[names == x]) for x in np.unique(names)}
    enough = {x for x in means if (names == x).sum() >= OWN_MEAN}
    # about each language's own mean where that is more than a text or two
    use = np.isin(names, list(enough)) if enough else np.ones(len(names), bool)
    overall = np.average(h[use], weights=n[use])
    pooled = _spread(h[use], n[use], np.array([means[x] for x in names[use]]) if enough else overall)
    for i, name in enumerate(languages):
        own = names == name
        if name in enough:
            mean = means[name]
        else:
            mean = max(means[name], overall) if name in means else max(means.values())
        calibration[i] = mean, *(_spread(h[own], n[own], mean) if own.sum() >= OWN_SPREAD else pooled)
    return calibration


def train(labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", docs_per_language: int = DOCS_PER_LANGUAGE) -> Model:
    """Fits and calibrates on a bounded sample of labelled rows: per language the docs_per_language * 3 / 2 texts with the
    smallest hash of the id, of which two thirds are fitted on and one third calibrates. Rows without language, id, text or
    letters teach nothing and take no place in the sample.

    The sample is found from ids and languages, so that whole texts only pass behind a broadcast filter of bounded size.
    """
    known = labelled.where(F.col(lang).isNotNull() & F.col(doc_id).isNotNull() & F.col(text).rlike(r"\p{L}"))
    first = F.row_number().over(Window.partitionBy("_lang", "_salt").orderBy("_hash", "_id"))
    order = Window.partitionBy("_lang").orderBy("_hash", "_id")
    picked = (
        known.select(F.col(doc_id).alias("_id"), F.col(lang).alias("_lang"), F.xxhash64(F.col(doc_id), F.lit(7)).alias("_hash"))
        .withColumn("_salt", F.pmod(F.xxhash64("_id", F.lit(11)), F.lit(SALTS)))
        .withColumn("_rank", first).where(F.col("_rank") <= docs_per_language * 3 // 2)
        .withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= docs_per_language * 3 // 2)
        .groupBy("_id", "_lang").agg(F.min("_rank").alias("_rank"))
        .withColumn("_held", F.row_number().over(Window.partitionBy("_lang").orderBy("_rank")) % 3 == 2)
    )
    sample = known.select(F.col(doc_id).alias("_id"), F.col(lang).alias("_lang"), F.col(text).alias("_text")).join(F.broadcast(picked), ["_id", "_lang"]).dropDuplicates(["_id", "_lang", "_text"])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for language, group in batch.groupby("_lang"):
                seen: dict[str, int] = {}
                for value in group["_text"]:
                    s = letters_of(value)
                    s = s and " " * (ORDER - 2) + s
                    for i in range(len(s) - ORDER + 1):
                        g = s[i : i + ORDER]
                        seen[g] = seen.get(g, 0) + 1
                yield pd.DataFrame({"language": language, "gram": list(seen), "n": list(seen.values())})

    counts = sample.where(~F.col("_held")).select("_lang", "_text").mapInPandas(count, "language string, gram string, n long")
    # the sample's bound is the model's: distinct n-grams of docs_per_language texts a language
    grams = counts.groupBy("language", "gram").agg(F.sum("n").alias("n")).toPandas().sort_values(["language", "gram"], ignore_index=True)
    languages = sorted(grams["language"].unique())
    if not languages:
        return Model([], [], np.empty(0, np.float32))
    grams["language"] = grams["language"].map({x: i for i, x in enumerate(languages)})
    model = fit(grams, languages)

    shared = sample.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            names, _, h, _ = shared.value.predict(batch["_text"].tolist())
            size = [len(letters_of(t)) - 1 for t in batch["_text"]]
            yield pd.DataFrame({"language": batch["_lang"], "picked": names, "h": h, "n": size})

    told = sample.where("_held").select("_lang", "_text").mapInPandas(measure, "language string, picked string, h double, n long").where("language = picked and n > 0").toPandas()
    model.calibration = _calibration(told, languages)
    return model


def identify(docs: DataFrame, model: Model, text: str = "text", prefix: str = "") -> DataFrame:
    """docs with lang_pred, score, cross_entropy (nats a character) and rejected (names prefixed; same-named columns are replaced).

    The language of the lowest length-normalised cross-entropy, ties to the first by name; score: its posterior, 0 to 1.
    Texts that are null or without letters are `und` with score 0, and rejected, like those that fit no language. With no
    labelled text at all everything is `und`. A narrow map; the model is broadcast, its size bounded by the sample.
    Repeated rows are judged alike, an empty table gives none, and a very long text is scored in pieces, whole.
    """
    added = [prefix + x for x in ("lang_pred", "score", "cross_entropy", "rejected")]
    keep = [c for c in docs.columns if c not in added]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, cross_entropy double, rejected boolean")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [None if x is None or x is pd.NA else x for x in batch.tolist()]
            if shared.value.languages:
                names, score, best, rejected = shared.value.predict(texts)
            else:
                names, score, best, rejected = [UNKNOWN] * len(texts), 0.0, np.nan, True
            yield pd.DataFrame({"lang_pred": names, "score": score, "cross_entropy": best, "rejected": rejected}, index=range(len(texts)))
            give_back()

    out = docs.select(*keep, predict(F.col(text)).alias("_found"))
    return out.select(*keep, *[F.col(f"_found.{x[len(prefix):]}").alias(x) for x in added])


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves `fold`; a null id counts as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds == fold


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.where(~held_out(F.col("doc_id"), 3, 1)))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "lang_pred", "score", "rejected")
