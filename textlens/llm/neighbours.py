"""Approximate nearest neighbours: hash-prefix forests of sorted arrays, ascended synchronously until enough candidates are met."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import table

TREES, BITS = 32, 64
#: Distinct vectors in one forest at most, about; every query visits every forest.
BLOCK_ROWS = 16_384
#: A forest chooses how many candidates its queries ascend to by this recall of SAMPLE of its own vectors against brute force.
TARGET_RECALL, SAMPLE = 0.96, 96
#: Queries of a block handled at once.
QUERY_ROWS = 512


class Forest:
    """TREES sorted arrays of BITS-bit hash strings over the rows of x. Bits are signs of random projections of the vectors
    after the reduction of inner product to angle: one more component brings every row to the length `radius`."""

    def __init__(self, x: np.ndarray, radius: float, trees: int = TREES, seed: int = 5):
        self.x, self.trees = x, trees
        self.planes = np.random.default_rng(seed).standard_normal((x.shape[1] + 1, trees * BITS))
        rest = np.sqrt(np.maximum(radius**2 - (x**2).sum(1), 0))
        codes = self.codes(np.column_stack([x, rest]))
        self.order = np.argsort(codes, axis=0, kind="stable")
        self.sorted = np.take_along_axis(codes, self.order, 0)

    def codes(self, rows: np.ndarray) -> np.ndarray:
        out = np.empty((len(rows), self.trees), np.uint64)
        for a in range(0, len(rows), 4096):
            bits = (rows[a : a + 4096] @ self.planes > 0).reshape(-1, self.trees, BITS)
            out[a : a + 4096] = np.packbits(bits, axis=2).view(">u8")[:, :, 0]
        return out

    def ranges(self, codes: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where, in each tree, the strings that share `level` leading bits with each query begin and end."""
        low = np.where(level >= BITS, np.uint64(0), np.uint64(2**64 - 1) >> np.minimum(level, BITS - 1).astype(np.uint64))[:, None]
        a, b = np.empty(codes.shape, np.int64), np.empty(codes.shape, np.int64)
        for t in range(self.trees):
            a[:, t] = np.searchsorted(self.sorted[:, t], codes[:, t] & ~low[:, 0], "left")
            b[:, t] = np.searchsorted(self.sorted[:, t], codes[:, t] | low[:, 0], "right")
        return a, b

    def level_for(self, codes: np.ndarray, wanted: int) -> np.ndarray:
        """The deepest level at which all trees together hold `wanted` matches: the descent to the longest match and the
        synchronous ascent from it, as a bisection over levels."""
        low, high = np.zeros(len(codes), np.int64), np.full(len(codes), BITS, np.int64)
        while (low < high).any():
            middle = (low + high + 1) // 2
            a, b = self.ranges(codes, middle)
            enough = (b - a).sum(1) >= wanted
            low, high = np.where(enough, middle, low), np.where(enough, high, middle - 1)
        return low

    def tune(self, k: int, target: float = TARGET_RECALL) -> int:
        """The smallest number of matches (a vector counts in each tree) that reaches the target on a sample of own rows."""
        n = len(self.x)
        pick = np.random.default_rng(1).permutation(n)[:SAMPLE]
        scores = self.x[pick] @ self.x.T
        scores[np.arange(len(pick)), pick] = -np.inf
        near = np.argsort(-scores, axis=1)[:, : min(k, n - 1)]
        if not near.size:
            return n * self.trees
        own = self.codes(np.column_stack([self.x[pick], np.zeros(len(pick))]))
        place = np.empty_like(self.order)
        np.put_along_axis(place, self.order, np.arange(n)[:, None], 0)
        theirs = np.take_along_axis(self.sorted, place, 0)[near]
        same = np.bitwise_xor(theirs, own[:, None, :]).min(2)  # the best tree has the longest common prefix
        depth = np.where(same == 0, BITS, BITS - 1 - np.floor(np.log2(np.maximum(same, 1).astype(np.float64))).astype(np.int64))
        wanted = 4 * k
        while wanted < n * self.trees:
            if (depth >= self.level_for(own, wanted)[:, None]).mean() >= target:
                return wanted
            wanted = int(wanted * 1.25) + 1
        return n * self.trees

    def search(self, queries: np.ndarray, wanted: int) -> Iterator[np.ndarray]:
        """Candidates (row numbers, ascending) of each query."""
        codes = self.codes(np.column_stack([queries, np.zeros(len(queries))]))
        a, b = self.ranges(codes, self.level_for(codes, wanted))
        for i in range(len(queries)):
            met = np.zeros(len(self.x), bool)
            for t in range(self.trees):
                met[self.order[a[i, t] : b[i, t], t]] = True
            yield np.flatnonzero(met)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query its k nearest found by inner product, in double precision, nearest
    first, ties to the smaller vec_id; all of them if there are fewer. A query never finds a row with its own id.

    queries: rows of the same shape. Rows whose vector is null, empty, zero or holds null or non-finite components, or whose
    id is null, take no part; rows that repeat an id and vector count once; an id with several vectors may be found with
    each. Vectors of another length than most count as another space and are searched apart. Other columns are ignored.

    Equal vectors are one entry of the index, which keeps the k + 1 smallest ids, so a vector that a third of all rows hold
    is indexed once. Entries are dealt into blocks by hash; each builds a forest in its task's memory, every query visits
    every block, and the blocks' best are merged.
    """

    def sound(df: DataFrame) -> DataFrame:
        v = F.col(embedding).cast("array<double>")
        ok = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists(v, lambda x: x != 0)
        return df.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.coalesce(ok, F.lit(False)))

    by_id = Window.partitionBy("v").orderBy("vec_id")
    entries = (
        sound(vectors).dropDuplicates(["vec_id", "v"]).withColumn("r", F.row_number().over(by_id)).where(F.col("r") <= k + 1)
        .groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
        .withColumns({"dim": F.size("v"), "norm": F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))})
    )
    spaces = {r["dim"]: (r["n"], r["m"]) for r in entries.groupBy("dim").agg(F.count("*").alias("n"), F.max("norm").alias("m")).collect()}
    if len(spaces) > 10_000:
        raise ValueError(f"{len(spaces)} different vector lengths")
    if not spaces:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    n_blocks = {d: -(-n // block_rows) for d, (n, _) in spaces.items()}
    blocks_of = F.create_map(*[F.lit(x) for pair in n_blocks.items() for x in pair])
    radius = {d: m for d, (_, m) in spaces.items()}
    dealt = entries.select("v", "ids", "dim", F.pmod(F.xxhash64("v"), F.try_element_at(blocks_of, F.col("dim"))).cast("int").alias("block"))
    asked = (
        sound(queries).dropDuplicates(["vec_id", "v"]).withColumn("dim", F.size("v")).withColumn("n", F.try_element_at(blocks_of, F.col("dim")))
        .where("n is not null").select("vec_id", "v", "dim", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("block"))
    )

    def search(index: pd.DataFrame, wants: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(index) and len(wants):
            index = index.iloc[np.lexsort((index["ids"].map(lambda i: i[0]).to_numpy(),))]
            x, ids = np.stack(index["v"].to_numpy()), index["ids"].tolist()
            forest = Forest(x, radius[x.shape[1]])
            wanted = forest.tune(k)
            for a in range(0, len(wants), QUERY_ROWS):
                part = wants.iloc[a : a + QUERY_ROWS]
                q = np.stack(part["v"].to_numpy())
                for own, row, met in zip(part["vec_id"].tolist(), q, forest.search(q, wanted), strict=True):
                    score = x[met] @ row
                    if len(met) > k + 1:
                        edge = np.partition(score, -(k + 1))[-(k + 1)]
                        met, score = met[score >= edge], score[score >= edge]
                    pairs = sorted((-s, i) for m, s in zip(met.tolist(), score.tolist(), strict=True) for i in ids[m] if i != own)[:k]
                    found.append((np.full(len(pairs), own), np.array([p[1] for p in pairs], np.int64), np.array([-p[0] for p in pairs])))
        columns = [np.concatenate(c) if found else [] for c in zip(*found, strict=True)] if found else [[], [], []]
        return pd.DataFrame({"query_id": columns[0], "vec_id": columns[1], "score": columns[2]}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    hits = dealt.groupBy("dim", "block").cogroup(asked.groupBy("dim", "block")).applyInPandas(search, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(rows, rows.where("vec_id % 20 = 0"))
