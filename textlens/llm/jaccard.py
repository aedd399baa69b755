"""N-gram Jaccard join: PartEnum signatures over word shingles, exact verification, link components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import discard, give_back, mix64, pack, stored, table, unpack
from ._components import connected_components

WORDS = 5
#: Two sets link when 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Size bands: the upper ends grow by this factor.
BAND_RATIO = 1.5
#: Second-level parts of a first-level part; all but one of them make a signature.
PARTS = 3
#: Bytes of text for which one signature bucket is made, MIN_BUCKETS at least; signatures that a task holds before it sends them on.
BUCKET_BYTES, MIN_BUCKETS, HELD = 8 << 20, 24, 750_000
#: Members and bytes of one group in a task, in verification and in the comparison of large groups; larger groups are split.
GROUP, GROUP_BYTES = 1024, 32 << 20
#: A class with more than this part of all rows gets its component from a broadcast of HOT rows at most.
HOT = 1000
#: Bits of a broadcast filter of ids at most, and of one of its rows.
BITS, SLICE = 1 << 27, 1 << 16
NO_ID = -(2**63)


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words `[^\\x20\\x09-\\x0D]+` of the A-Z lower-cased text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of runs of `words` words; fewer words are one shingle, none are none."""
    w = word_hashes(text)
    size = min(words, len(w))
    if not size:
        return w
    h = np.full(len(w) - size + 1, size, np.uint64)
    for k in range(size):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + w[k : k + len(h)])
    return np.unique(h)


class PartEnum:
    """Signatures for the threshold `percent`.

    Two sets that link have sizes a <= b with 100 a >= percent b, and differ in at most (a + b)(1 - t)/(1 + t) elements. A set
    takes part in the instance of its own size band and in those of larger bands in which a partner may lie; an instance
    allows k = 2 r (1 - t)/(1 + t) differences, r being the upper end of its band. The domain of hashes is cut into n1 parts,
    each into PARTS smaller ones. A part with no difference agrees, one with a single difference agrees but for one smaller
    part. So each choice of all but one smaller part gives a signature: a hash of the elements that fall in them. Choices
    without elements give none. Linked sets can miss each other only if every part either holds two differences, or is thin
    (some choice is empty) and holds one, or is empty: a set with `thin` and `empty` such parts is certain to share a signature
    while n1 > empty + thin + (k - thin) // 2, for which n1 has spare parts. A set that isn't certain also takes part under
    the next seed: of two linked sets either one is certain under some seed, or both go on to the next.
    """

    def __init__(self, percent: int = PERCENT):
        self.percent = percent
        self.ends = [max(4, percent // max(1, 100 - percent))]

    def band(self, size: int) -> int:
        while self.ends[-1] < size:
            self.ends.append(max(int(self.ends[-1] * BAND_RATIO), self.ends[-1] + 1))
        return int(np.searchsorted(self.ends, size))

    def bands(self, size: int) -> range:
        first = last = self.band(size)
        while True:
            self.band(self.ends[last] + 1)
            if 100 * size < self.percent * (self.ends[last] + 1):
                return range(first, last + 1)
            last += 1

    def shape(self, band: int) -> tuple[int, int, int]:
        """(differences allowed, first-level parts, second-level parts)."""
        k = 2 * self.ends[band] * (100 - self.percent) // (100 + self.percent)
        return (k, -(-61 * k // 100) + 2, PARTS) if k else (0, 1, 1)

    def parts(self, band: int, seed: int, owner: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(sums, counts), each n x n1 x n2: sums of mixed hashes and elements in each smaller part of n sets."""
        _, n1, n2 = self.shape(band)
        h = mix64(hashes ^ mix64(np.array([seed * 256 + band + 1], np.uint64)))
        place = owner * (n1 * n2) + (h % np.uint64(n1 * n2)).astype(np.int64)
        sums = np.zeros(n * n1 * n2, np.uint64)
        np.add.at(sums, place, mix64(h + np.uint64(0x632BE59BD9B4E019)))
        return sums.reshape(n, n1, n2), np.bincount(place, minlength=n * n1 * n2).reshape(n, n1, n2)

    def signatures(self, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(set numbers, signatures, needs): 48 bits of hash and 8 of the band; needs: rows (set number, band, how many
        signatures of the band a linked set shares at least: one for each part that can't fail)."""
        todo: dict[int, list[int]] = {}
        for i, s in enumerate(sets):
            if len(s):
                for j in self.bands(len(s)):
                    todo.setdefault(j, []).append(i)
        owners, found, needs = [], [], []
        for band, members in todo.items():
            k, n1, n2 = self.shape(band)
            seed, left = 0, np.array(members)
            while len(left):
                own = np.repeat(np.arange(len(left)), [len(sets[i]) for i in left])
                sums, counts = self.parts(band, seed, own, np.concatenate([sets[i] for i in left]), len(left))
                if n2 > 1:  # all but one smaller part
                    whole = counts.sum(2, keepdims=True)
                    sums, counts = sums.sum(2, keepdims=True) - sums, whole - counts
                    empty = (whole[:, :, 0] == 0).sum(1)
                    thin = (counts == 0).any(2).sum(1) - empty
                    sure = n1 - (empty + thin + np.maximum(k - thin, 0) // 2)
                else:
                    sure = np.ones(len(left), np.int64)
                if not seed:
                    needs.append(np.stack([left, np.full(len(left), min(band, 255)), np.maximum(sure, 1)], 1))
                salt = mix64(np.arange(n1 * n2, dtype=np.uint64) + np.uint64((seed * 256 + band) << 32)).reshape(n1, n2)
                full = counts > 0
                who = np.broadcast_to(left[:, None, None], full.shape)[full]
                owners.append(who)
                found.append(mix64(sums ^ salt)[full] & ~np.uint64(0xFFFF) | np.uint64(min(band, 255)))
                left = left[sure < 1]
                seed += 1
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty((0, 3), np.int64)
        return np.concatenate(owners), np.concatenate(found), np.concatenate(needs)

    def vector(self, band: int, s: np.ndarray) -> np.ndarray:
        """One byte for each of 2 r parts of the domain, r being the upper end of the band: the sum of the mixed hashes in it.
        Parts whose bytes differ differ in an element, so two sets differ in at least as many elements as bytes."""
        while len(self.ends) <= band:
            self.band(self.ends[-1] + 1)
        size = 2 * self.ends[band]
        h = mix64(s ^ mix64(np.array([~band & 0xFFFFFFFF], np.uint64)))
        sums = np.bincount((h % np.uint64(size)).astype(np.int64), (h >> np.uint64(56)).astype(np.float64), size)
        return (sums.astype(np.int64) & 255).astype(np.uint8)


def set_table(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, with_set: bool = False) -> DataFrame:
    """(doc_id, n_shingles, key, digest[, shingles]): a narrow map; digest is 128 bits of the whole set, key its first 64, both
    null for an empty one."""
    schema = "doc_id long, n_shingles long, key long, digest binary" + (", shingles binary" if with_set else "")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 1000):
                part = batch.slice(a, 1000)
                sets = [shingles(t, words) for t in part.column(1).to_pylist()]
                raw = [s.tobytes() for s in sets]
                digests = [xxhash.xxh3_128_digest(r) if r else None for r in raw]
                columns = [part.column(0).cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([d and _key(d) for d in digests], pa.int64()), pa.array(digests, pa.binary())]
                yield pa.RecordBatch.from_arrays([*columns, *([pa.array(raw, pa.binary())] if with_set else [])], names=[f.split()[0] for f in schema.split(", ")])
            give_back()

    return docs.select(doc_id, text).mapInArrow(rows, schema)


def _key(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def _shared(values: np.ndarray) -> np.ndarray:
    """Which of sorted values occur more than once."""
    same = np.zeros(len(values) + 1, bool)
    same[1:-1] = values[1:] == values[:-1]
    return (same[1:] | same[:-1])[: len(values)]


def shared_signatures(docs: DataFrame, text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(hub, key, band, n, need): sets (by key) that share signatures, grouped by hub.

    Of the sets with one signature that of the smallest mixed key is the hub; n counts the signatures that led to the row. A
    hub is a row of its own group. Rows with a null hub say how many signatures of the band a linked set shares at least.
    Copies within a task send their set once; signatures of one set alone lead to no row.
    """
    size = docs.agg(F.sum(F.octet_length(F.col(text))).alias("b")).first()["b"] or 0
    buckets = max(MIN_BUCKETS, -(-size // BUCKET_BYTES))
    columns = {"bucket": pa.int32(), "sigs": pa.binary(), "keys": pa.binary(), "which": pa.binary()}

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enum, seen = PartEnum(percent), set()
        held: list[tuple[np.ndarray, ...]] = []
        give_back()

        def blobs() -> pa.RecordBatch:
            sigs, keys, need, need_keys = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(sigs)
            sigs, keys = sigs[order], keys[order]
            edges = np.array([-(-(b << 64) // buckets) for b in range(1, buckets)], np.uint64)
            ends = np.concatenate([[0], np.searchsorted(sigs, edges), [len(sigs)]])
            packed = [(-1, need.astype(np.uint64), need_keys, np.empty(0, np.uint32))]
            for b, (x, y) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
                if x < y:
                    packed.append((b, sigs[x:y], *np.unique(keys[x:y], return_inverse=True)))
            rows = [(b, *(zstandard.compress(pack(v), 1) for v in (s, k, w.astype(np.uint32)))) for b, s, k, w in packed]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), columns.values(), strict=True)], names=list(columns))

        for batch in batches:
            for a in range(0, len(batch), 500):
                keys, sets = [], []
                for s in (shingles(t, words) for t in batch.column(0).slice(a, 500).to_pylist()):
                    digest = xxhash.xxh3_128_digest(s.tobytes())
                    if len(s) and digest not in seen:
                        seen.add(digest)
                        keys.append(_key(digest))
                        sets.append(s)
                owner, sigs, needs = enum.signatures(sets)
                key = np.array(keys, np.int64)
                held.append((sigs, key[owner], needs[:, 1] << 32 | needs[:, 2], key[needs[:, 0]]))
                if sum(len(h[0]) for h in held) >= HELD:
                    yield blobs()
                    held = []
                    give_back()
        if sum(len(h[0]) for h in held):
            yield blobs()

    def meet(part: pd.DataFrame) -> pd.DataFrame:
        def whole(column: str, dtype) -> list[np.ndarray]:
            return [unpack(zstandard.decompress(b), dtype) for b in part[column]]

        give_back()
        sigs, keys = np.concatenate(whole("sigs", np.uint64)), whole("keys", np.int64)
        if part["bucket"].iloc[0] < 0:
            return pd.DataFrame({"hub": pd.array([None] * len(sigs), "Int64"), "key": np.concatenate(keys), "band": (sigs >> np.uint64(32)).astype(np.int64), "n": 0, "need": (sigs & np.uint64(0xFFFFFFFF)).astype(np.int64)})
        order = np.argsort(sigs)
        order = order[_shared(sigs[order])]  # most stand alone, and need no key
        before = np.cumsum([0, *map(len, keys)])
        which = np.concatenate([w + np.uint32(b) for w, b in zip(whole("which", np.uint32), before[:-1], strict=True)])
        sigs, keys = sigs[order], np.concatenate(keys)[which[order]]
        order = np.lexsort((mix64(keys.view(np.uint64)), sigs))
        sigs, keys = sigs[order], keys[order]
        new = np.append(True, (sigs[1:] != sigs[:-1]) | (keys[1:] != keys[:-1]))[: len(sigs)]  # copies from several tasks are one
        sigs, keys = sigs[new], keys[new]
        begin = np.flatnonzero(np.append(True, sigs[1:] != sigs[:-1])[: len(sigs)])
        count = np.diff(np.append(begin, len(sigs)))
        several = np.repeat(count > 1, count)
        found = pd.DataFrame({"hub": np.repeat(keys[begin], count)[several], "key": keys[several], "band": (sigs[several] & np.uint64(255)).astype(np.int64)})
        return found.groupby(["hub", "key", "band"], as_index=False).size().rename(columns={"size": "n"}).assign(need=0)

    sent = docs.select(text).mapInArrow(send, ", ".join(f"{c} {'int' if c == 'bucket' else 'binary'}" for c in columns))
    own = F.when(F.col("bucket") < 0, F.pmod(F.xxhash64("keys"), F.lit(buckets)))  # needs are dealt anyhow
    return sent.groupBy("bucket", own.alias("_own")).applyInPandas(meet, "hub long, key long, band long, n long, need long")


def verify(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The (a, b) of pairs (a, b, n) of classes whose sets (cls, shingles) link; n: the size of a's set. Each set is sent once for
    each pair it is the second of. The first one goes to parts of GROUP pairs and GROUP_BYTES at most, so a set with very
    many pairs is dealt over tasks, and tasks take several parts."""
    size = F.count("*") * F.max("n") * 8
    fan = stored(pairs.groupBy("a").agg(F.ceil(F.greatest(F.count("*") / F.lit(GROUP), size / F.lit(GROUP_BYTES))).cast("int").alias("fan"), size.alias("bytes")), "fan")
    dealt = max(MIN_BUCKETS, -(-(fan.agg(F.sum("bytes")).first()[0] or 0) // GROUP_BYTES))
    left = fan.join(sets.withColumnRenamed("cls", "a"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("fan") - 1)).alias("part"), F.lit(None).cast("long").alias("b"), "shingles")
    right = stored(pairs.join(fan, "a").select("a", F.pmod(F.xxhash64("b"), F.col("fan")).cast("int").alias("part"), "b"), "dealt").join(sets.withColumnRenamed("cls", "b"), "b").select("a", "part", "b", "shingles")

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (a, _), group in rows.groupby(["a", "part"], sort=False):
            own = group["b"].isna()
            s = np.frombuffer(group["shingles"][own].iloc[0], np.uint64)
            for b, raw in zip(group["b"][~own].astype("int64"), group["shingles"][~own], strict=True):
                t = np.frombuffer(raw, np.uint64)
                both = int((s[np.minimum(np.searchsorted(s, t), len(s) - 1)] == t).sum())
                if 100 * both >= percent * (len(s) + len(t) - both):
                    out.append((a, b))
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    whole = left.union(right).withColumn("b", F.col("b").cast("decimal(20,0)"))  # keeps null apart from numbers in pandas
    return whole.groupBy(F.pmod(F.xxhash64("a", "part"), F.lit(dealt)).alias("_deal")).applyInPandas(compare, "a long, b long")


def _vectors(sets: DataFrame, wanted: DataFrame, percent: int) -> DataFrame:
    """(cls, band, vector): compressed part vectors of the classes and bands of `wanted`."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enum = PartEnum(percent)
        for batch in batches:
            made = [zstandard.compress(enum.vector(band, np.frombuffer(raw, np.uint64)).tobytes(), 1) for raw, band in zip(batch["shingles"], batch["band"], strict=True)]
            yield pd.DataFrame({"cls": batch["cls"], "band": batch["band"], "vector": made})

    return wanted.join(sets, "cls").select("cls", "band", "shingles").mapInPandas(rows, "cls long, band long, vector binary")


def _near(rows: DataFrame, dealt: int, forests: int, percent: int) -> DataFrame:
    """Pairs (a, b, n, hub, band, more) that may link by their part vectors, from rows (hub, band, x, y, block, cls, n, comp, pivot,
    failed, vector); failed: classes with which this one was compared in vain, or null.

    Rows of one hub, band, x and y are compared: with the row that is the pivot if there is one, else those of different
    components (of different blocks, if x <> y). A group hands on `forests` spanning forests of its components at most, so no
    more pairs than `forests` times its rows; more: it has others. A pair can come from several groups, either way round."""

    def fit(n: np.ndarray, m: np.ndarray, differ: np.ndarray) -> np.ndarray:
        return (differ * (100 + percent) <= (n + m) * (100 - percent)) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))

    def differences(v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """In how many bytes each row of v differs from each of w."""
        bits = np.packbits(v[:, None, :] != w[None], axis=2)
        return np.bitwise_count(bits).sum(2, dtype=np.int64)

    def compare(group: pd.DataFrame) -> Iterator[tuple]:
        group = group.sort_values("cls")  # groups with the same members choose the same pairs
        n, comp, cls, block, pivot = (group[c].to_numpy() for c in ("n", "comp", "cls", "block", "pivot"))
        left = np.flatnonzero(pivot)[:1]
        names, comp, count = np.unique(comp, return_inverse=True, return_counts=True)
        if len(names) < 2:
            return
        if not len(left):
            left = np.flatnonzero(comp != count.argmax())  # all but the largest component, against all
        v = np.stack([np.frombuffer(zstandard.decompress(b), np.uint8) for b in group["vector"]])
        step = max(1, (16 << 20) // max(1, v.size))
        ok = np.empty((len(left), len(v)), bool)
        for at in range(0, len(left), step):
            i = left[at : at + step]
            ok[at : at + step] = (comp[i][:, None] != comp[None]) & fit(n[i][:, None], n[None], differences(v[i], v))
        if group["x"].iloc[0] != group["y"].iloc[0]:
            ok &= block[left][:, None] != block[None]
        place = np.full(len(v), -1)
        place[left] = np.arange(len(left))

        def drop(i: int, j: np.ndarray) -> None:
            ok[place[i], j] = False
            ok[place[j[place[j] >= 0]], i] = False

        for i, failed in enumerate(group["failed"]):
            if failed is not None:
                j = np.flatnonzero(np.isin(cls, failed))
                ok[place[j[place[j] >= 0]], i] = False
                if place[i] >= 0:
                    ok[place[i], j] = False
        out = []
        for _ in range(forests):
            root = comp.copy()
            for i, may in zip(left.tolist(), ok, strict=True):
                j = np.flatnonzero(may & (root != root[i]))
                if len(j):
                    joined, first = np.unique(root[j], return_index=True)
                    out += [(int(cls[i]), b, int(n[i])) for b in cls[j[first]].tolist()]
                    drop(i, j[first])
                    root[np.isin(root, joined)] = root[i]
            if not ok.any():
                break
        hub, band, more = int(group["hub"].iloc[0]), int(group["band"].iloc[0]), bool(ok.any())
        yield from ((*pair, hub, band, more) for pair in out)

    def near(part: pd.DataFrame) -> pd.DataFrame:
        out: dict[tuple, None] = {}
        for _, group in part.groupby(["hub", "band", "x", "y"], sort=False):
            if len(group) > 1:
                out |= dict.fromkeys(pair if pair[-1] else (*pair[:3], 0, 0, False) for pair in compare(group))
        return pd.DataFrame(list(out), columns=["a", "b", "n", "hub", "band", "more"]).astype({"more": bool} | dict.fromkeys(("a", "b", "n", "hub", "band"), "int64"))

    return rows.groupBy(F.pmod(F.xxhash64("hub", "band", "x", "y"), F.lit(dealt)).alias("_deal")).applyInPandas(near, "a long, b long, n long, hub long, band long, more boolean")


def _once(found: DataFrame) -> DataFrame:
    """Each pair of _near() once and one way round."""
    return found.groupBy(F.least("a", "b").alias("_low"), F.greatest("a", "b").alias("_high")).agg(F.first(F.struct("a", "b", "n")).alias("pair")).select("pair.*")


def _maybe_among(docs: DataFrame, ids: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs whose id is one of the long column `id` of ids, and some others: a bit for each hash, BITS at most, is
    broadcast in slices, so that texts need no shuffle."""
    bits = min(BITS, max(SLICE, 1 << (64 * ids.count()).bit_length()))

    def gather(part: pd.DataFrame) -> pd.DataFrame:
        at = np.unique(part["at"].to_numpy() % SLICE)
        words = np.zeros(SLICE // 64, np.uint64)
        np.bitwise_or.at(words, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        return pd.DataFrame({"slice": [int(part["slice"].iloc[0])], "words": [words.view(np.int64)]})

    def at(c: str):
        return F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(bits)).alias("at")

    hashed = ids.select(at("id")).distinct().withColumn("slice", (F.col("at") / SLICE).cast("int"))
    slices = hashed.groupBy("slice").applyInPandas(gather, "slice int, words array<long>")
    seen = docs.withColumn("at", at(doc_id)).withColumn("slice", (F.col("at") / SLICE).cast("int")).join(F.broadcast(slices), "slice")
    return seen.where(F.expr(f"getbit(words[int(at % {SLICE} / 64)], int(at % 64)) = 1")).select(*docs.columns)


def link_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs.

    Two documents link when their sets of `words`-word shingles have a Jaccard similarity of `percent` per cent or more;
    component_id is the smallest doc_id that links reach, itself included. Null, empty and blank texts have an empty set,
    link with nothing, and are their own component. Rows with a null id take part; a component of such rows alone has a null
    id. Rows that repeat an id are repeated; if their texts differ each has its own set. An empty table gives an empty one, and
    other columns of docs take no part. doc_id must be an integer.

    Documents with equal sets (128 bits) are one class. Sets that share a signature meet in the group of the signature's hub,
    so a pair meets once for each hub it shares and not for each signature. First each group is compared with one member
    only; what then still lies in different components within a group is compared by part vectors, an exact bound, in
    blocks of bounded size, and verified by the sets. A group hands on a spanning forest of its components only; where one of
    its pairs fails, the next round compares what is still apart, with sixteen times the forests. So no link between components
    is lost, large groups of near copies hand on a pair for each member, and other members of a group cost byte comparisons.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    about = stored(set_table(docs, words=words).select("*", F.monotonically_increasing_id().alias("row")), "sets")
    # a class is named by its first row; `rep` is the id of a document that stands for it, `many` says that rows repeat that id
    by_id = about.where("n_shingles > 0").groupBy("digest", "key", "doc_id").agg(F.count("*").alias("copies"), F.min("row").alias("row"), F.max("n_shingles").alias("n"))
    classes = stored(
        by_id.groupBy("digest", "key").agg(F.min("row").alias("cls"), F.min("doc_id").alias("first_id"), F.min(F.coalesce("doc_id", F.lit(NO_ID))).alias("rep"), F.max(F.col("copies") > 1).alias("many"), F.sum("copies").alias("copies"), F.max("n").alias("n")),
        "classes",
    )

    # what shares too few signatures to link with anything leaves
    shared = stored(shared_signatures(docs, words=words, percent=percent), "shared")
    need = shared.where("hub is null").groupBy("key", "band").agg(F.min("need").alias("need"))
    enough = shared.where("hub is not null").groupBy("key", "band").agg(F.sum("n").alias("m")).join(need, ["key", "band"]).where("m >= need").select("key", "band")
    met = shared.where("hub is not null").select("hub", "key", "band").distinct().join(enough, ["key", "band"]).join(classes.select("key", "cls", "n"), "key").select("hub", "band", "cls", "n")
    met = stored(met, "met")
    discard(shared)
    narrow = met
    blocks = F.ceil(F.greatest(F.count("*") / F.lit(GROUP), F.count("*") * F.max("n") * 3 / F.lit(GROUP_BYTES))).cast("int").alias("blocks")
    groups = met.groupBy("hub", "band").agg(F.count("*").alias("m"), F.min(F.struct(F.xxhash64("cls").alias("h"), "cls")).alias("first"), blocks).where("m > 1").select("hub", "band", F.col("first.cls").alias("pivot"), "blocks")
    met = stored(met.join(groups, ["hub", "band"]).withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")), "grouped")

    wanted = stored(met.select("cls", "band").distinct(), "wanted")
    chosen = stored(classes.join(wanted.select("cls").distinct(), "cls", "left_semi").select("digest", "cls", "rep", "many"), "chosen")
    plain = docs.withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID)))
    found = set_table(_maybe_among(plain, chosen.select(F.col("rep").alias("id"))), words=words, with_set=True)
    found = stored(found.join(chosen, (found["digest"] == chosen["digest"]) & (found["doc_id"] == chosen["rep"])).select("cls", "shingles", "many"), "shingles")
    sets = found.where("not many").union(found.where("many").dropDuplicates(["cls"])).select("cls", "shingles")
    vectors = stored(_vectors(sets, wanted, percent), "vectors")
    dealt = max(MIN_BUCKETS, -(-(met.agg(F.sum(F.col("n") * 3)).first()[0] or 0) // GROUP_BYTES))

    here, all_blocks = F.array("block"), F.sequence(F.lit(0), F.col("blocks") - 1)
    star = (
        met.withColumn("is_pivot", F.col("cls") == F.col("pivot"))
        .withColumn("x", F.explode(F.when(F.col("is_pivot"), all_blocks).otherwise(here)))
        .select("hub", "band", "x", F.col("x").alias("y"), "block", "cls", "n", F.col("cls").alias("comp"), F.col("is_pivot").alias("pivot"), F.lit(None).cast("array<long>").alias("failed"))
    )
    pairs = stored(_once(_near(star.join(vectors, ["cls", "band"]), dealt, 1, percent)), "pairs")
    links = stored(verify(pairs, sets, percent), "links")
    failed = stored(pairs.join(links, ["a", "b"], "left_anti").select("a", "b"), "failed")
    roots = connected_components(links)
    discard(pairs)

    forests, left, spent = 1, None, [links, failed]
    while True:
        comp = stored(met.join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.coalesce("root", "cls")).drop("root"), "comp")
        # a group of two is settled by its star
        still = comp.groupBy("hub", "band").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("m")).where("m > 2 and low <> high").select("hub", "band")
        still = stored(still if left is None else still.join(left, ["hub", "band"], "left_semi"), "open")
        rest = (
            comp.join(still, ["hub", "band"]).join(failed.groupBy(F.col("b").alias("cls")).agg(F.collect_set("a").alias("failed")), "cls", "left").withColumn("other", F.explode(all_blocks))
            .select("hub", "band", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "cls", "n", "comp", F.lit(False).alias("pivot"), "failed")
        )
        near = stored(_near(rest.join(vectors, ["cls", "band"]), dealt, forests, percent), "near")
        again = stored(_once(near), "pairs")
        discard(comp, still)
        spent += [near, again]
        if again.isEmpty():
            break
        now = stored(verify(again, sets, percent), "links")
        missed = stored(again.join(now, ["a", "b"], "left_anti").select("a", "b"), "failed")
        failed = failed.union(missed)
        roots = connected_components(now.union(roots))  # the stars of the components so far, and what joins them
        # if all that a group handed on links, so does what it kept back; a group with a pair that doesn't is compared once more
        either = missed.union(missed.select("b", "a"))
        left = stored(near.where("more").join(either, ["a", "b"], "left_semi").select("hub", "band").distinct(), "left")
        spent += [now, missed, left]
        if left.isEmpty():
            break
        forests *= 16
    discard(narrow, met, vectors, wanted, chosen)
    of_class = classes.join(roots.withColumnRenamed("node", "cls"), "cls", "left").select("digest", "first_id", "copies", F.coalesce("root", "cls").alias("root"))
    smallest = of_class.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_class = stored(of_class.join(smallest, "root").select("digest", "copies", "component_id"), "components")
    discard(found, classes, *spent)

    # classes with over a thousandth of the rows are a thousand at most
    most = (about.count() + HOT - 1) // HOT
    hot = about.join(F.broadcast(of_class.where(F.col("copies") > most).select("digest", F.col("component_id").alias("hot_id"), F.lit(True).alias("hot"))), "digest", "left")
    dealt_key = F.when(F.col("hot").isNull() & F.col("digest").isNotNull(), F.col("digest")).otherwise(F.encode(F.col("row").cast("string"), "utf-8")).alias("digest")
    rest = hot.select("doc_id", "n_shingles", "hot", "hot_id", dealt_key).join(of_class.select("digest", "component_id"), "digest", "left")
    own = F.when(F.col("n_shingles") == 0, F.col("doc_id")).when(F.col("hot"), F.col("hot_id")).otherwise(F.col("component_id"))
    return rest.select("doc_id", "n_shingles", own.alias("component_id"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs with one document of each component, that of the smallest id; all columns stay. Rows that repeat an id are one
    document and stay together; rows with a null id stay."""
    gone = link_components(docs, doc_id, text, words, percent).where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs[doc_id].cast("long") == gone["_gone"], "left_anti")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_components(table(spark, sf_dir, "documents").select("doc_id", "text"))
