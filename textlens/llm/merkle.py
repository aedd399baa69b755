"""Merkle dataset manifest: ranks are split into digits, the digits grouped away one after the other, child structs nested.

Leaves are ranked within their group, a rank is written in digits of base FANOUT, and LEVELS digits at a time form a block of
bounded size that one row holds: grouping the lowest digit away collects a run of siblings, hashes them and nests them in their
parent, and so on up to the block. Blocks are the leaves of the next tier, until each group is one node, its subroot; subroots
are rolled up in the same way. On the way back each nested row is unrolled by one transform and one explode, which write the
siblings of every leaf of the block; what a block inherits from above comes to it by a union and a grouping, not by a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import discard, shuffle_partitions, stored, table
from .language_id import held_out

FANOUT = 3
#: Levels of one block, which holds FANOUT ** LEVELS = 729 leaves at most.
LEVELS = 6
BLOCK = FANOUT**LEVELS

_STEPS = "array<struct<left:array<string>,right:array<string>>>"


def field(value: Column) -> Column:
    """`-` for null, else the UTF-8 byte count, `:` and the value (integers decimal)."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*fields: Column) -> Column:
    """Lower-case hex SHA-256 of the fields in a row; every field is delimited, so no two rows share an input."""
    return F.sha2(F.concat(*map(field, fields)), 256)


def proof_digest(steps: Column) -> Column:
    """SHA-256 of all siblings, level by level upwards, left to right."""
    return F.sha2(F.array_join(F.flatten(F.transform(steps, lambda s: F.concat(s["left"], s["right"]))), ""), 256)


def fold(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(steps, leaf, lambda h, s: F.sha2(F.concat(F.array_join(s["left"], ""), h, F.array_join(s["right"], "")), 256))


def height(n: Column) -> Column:
    """Levels above n leaves until one node remains."""
    return F.size(F.filter(F.array(*[F.lit(FANOUT**k).cast("long") for k in range(39)]), lambda p: p < n))


def ranked(items: DataFrame) -> DataFrame:
    """items (g, o, h, x) as (g, r, height, h, x): r is the rank from 0 in g by o, then h; nulls come first.

    Rows are sorted by ranges of (g, o, h), so a large group spreads over many tasks; a row's place in its task and the number of
    rows of its group in the tasks before give the rank. Equal rows are dealt by their place in the stored input.
    """
    source = stored(items, "leaves")
    keys = [F.col(c).asc_nulls_first() for c in ("g", "o", "h", "_tie")]
    tied = source.withColumn("_tie", F.monotonically_increasing_id())
    placed = stored(tied.repartitionByRange(shuffle_partitions(items.sparkSession), *keys).sortWithinPartitions(*keys).drop("_tie").withColumn("_at", F.monotonically_increasing_id()), "sorted")
    discard(source)
    task = F.shiftright("_at", 33)
    parts = placed.groupBy(F.col("g").alias("_g"), task.alias("_task")).agg(F.min("_at").alias("_first"), F.count("*").alias("_own"))
    # for a group at most as many rows as there are tasks
    w = Window.partitionBy("_g").orderBy("_task")
    before = F.coalesce(F.sum("_own").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    offsets = parts.select("_g", "_task", (before - F.col("_first")).alias("_shift"), F.sum("_own").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_n"))
    found = placed.join(offsets, placed["g"].eqNullSafe(offsets["_g"]) & (task == offsets["_task"]))
    return found.select("g", (F.col("_at") + F.col("_shift")).alias("r"), height(F.col("_n")).alias("height"), "h", "x")


def _roll(items: DataFrame, tier: int) -> DataFrame:
    """(g, height, b, h, kids): items (g, r, height, h, x) nested by block, one shuffle for all levels."""
    digits = [F.expr(f"r div {FANOUT**k} % {FANOUT}").cast("int").alias(f"d{k}") for k in range(LEVELS)]
    level = items.select("g", "height", F.expr(f"r div {BLOCK}").alias("b"), *digits, F.struct(F.expr(f"cast(r % {FANOUT} as int)").alias("d"), "h", "r", "x").alias("node")).repartition("g", "b")
    for k in range(LEVELS):
        above = [f"d{j}" for j in range(k + 1, LEVELS)]
        kids = F.array_sort(F.collect_list("node"))
        level = level.groupBy("g", "height", "b", *above).agg(kids.alias("kids"))
        hashed = F.when(F.col("height") > tier * LEVELS + k, F.sha2(F.array_join(F.col("kids.h"), ""), 256)).otherwise(F.col("kids")[0]["h"])
        level = level.select("g", "height", "b", *above, hashed.alias("h"), "kids")
        if above:
            level = level.select("g", "height", "b", *above, F.struct(F.col(f"d{k + 1}").alias("d"), "h", "kids").alias("node"))
    return level


def _tree(items: DataFrame) -> list[DataFrame]:
    """The tiers of blocks above items, stored; the last has one row for each g, whose h is the subroot."""
    tiers, level, top = [], items, None
    while True:
        blocks = stored(_roll(level, len(tiers)), "blocks")
        tiers.append(blocks)
        top = blocks.agg(F.max("height").alias("m")).first()["m"] or 0 if top is None else top
        if LEVELS * len(tiers) >= top:
            return tiers
        level = blocks.select("g", F.col("b").alias("r"), "height", "h", F.lit(None).cast("int").alias("x"))


def _unrolled(kids: Column, k: int, tier: int, steps: Column) -> Column:
    """Nested runs of level k as one array of (r, h, x, steps): steps of the levels above, each with the siblings of the run before it."""

    def one(kid: Column) -> Column:
        side = lambda f: F.transform(F.filter(kids, f), lambda s: s["h"])
        own = F.when(F.col("height") > tier * LEVELS + k, F.array(F.struct(side(lambda s: s["d"] < kid["d"]).alias("left"), side(lambda s: s["d"] > kid["d"]).alias("right")))).otherwise(F.expr(f"cast(array() as {_STEPS})"))
        path = F.concat(own, steps)
        return _unrolled(kid["kids"], k - 1, tier, path) if k else F.struct(kid["r"].alias("r"), kid["h"].alias("h"), kid["x"].alias("x"), path.alias("steps"))

    return F.flatten(F.transform(kids, one)) if k else F.transform(kids, one)


def _proofs(tiers: list[DataFrame], above: DataFrame) -> DataFrame:
    """(g, info, r, h, x, steps) for every leaf, from above (g, info, steps) for every g."""
    down = above.select("g", F.lit(0).cast("long").alias("b"), "info", "steps")
    for tier in reversed(range(len(tiers))):
        blocks = tiers[tier].select("g", "b", "height", "kids")
        both = blocks.unionByName(down, allowMissingColumns=True).groupBy("g", "b").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("height", "kids", "info", "steps")])
        found = both.select("g", "info", F.explode(_unrolled(F.col("kids"), LEVELS - 1, tier, F.col("steps"))).alias("e")).select("g", "info", "e.*")
        down = found.select("g", F.col("r").alias("b"), "info", "steps")
    return found


def manifest(rows: DataFrame, leaf: Column, group: str = "source", order: str = "doc_id", carry: list[Column] | None = None) -> DataFrame:
    """One row for each row of `rows`: (group, order, leaf, subroot, root, steps, carried columns), named as in `rows`.

    leaf: a hex digest of the row, see leaf_digest(). Leaves of a group ascend by `order`, null first, equal ones by their digest;
    while a group has more than one node, every FANOUT consecutive ones (the last run may be shorter, even a single one) become
    the digest of their digests. What remains is the subroot; subroots, ordered by group (null first, bytes), likewise give the
    root. steps: for each level up to the root the siblings to the left and to the right; fold() turns a leaf and its steps into
    the root, proof_digest() digests them.

    Nulls in any column are values; empty and very long texts only count in the leaf. Repeated rows are leaves of their own, next
    to each other. A group with a third of all rows is sorted and rolled up in blocks by many tasks. An empty table gives no row.
    Columns of `rows` may have any names.
    """
    carried = [c.alias(f"c{i}") for i, c in enumerate(carry or [])]
    names = [rows.select(c).columns[0] for c in carry or []]
    items = rows.select(F.col(group).alias("g"), F.col(order).alias("o"), leaf.alias("h"), F.struct(F.col(order).alias("o"), *carried).alias("x"))
    tiers = _tree(ranked(items))
    subroots = tiers[-1].select(F.lit(0).alias("g"), F.col("g").alias("o"), "h", F.struct(F.col("g").alias("o")).alias("x"))
    upper = _tree(ranked(subroots))
    top = upper[-1].select("g", F.col("h").alias("info"), F.expr(f"cast(array() as {_STEPS})").alias("steps"))
    groups = _proofs(upper, top).select(F.col("x.o").alias("g"), F.struct(F.col("h").alias("subroot"), F.col("info").alias("root")).alias("info"), "steps")
    found = _proofs(tiers, groups)
    fields = [F.col(f"x.c{i}").alias(name) for i, name in enumerate(names)]
    return found.select(F.col("g").alias(group), F.col("x.o").alias(order), F.col("h").alias("leaf"), F.col("info.subroot").alias("subroot"), F.col("info.root").alias("root"), "steps", *fields)


def verify(proofs: DataFrame, leaf: str = "leaf") -> DataFrame:
    """proofs with folded_root, recomputed from the column `leaf` and the steps, and verified: whether it is the root. A null leaf isn't."""
    return proofs.withColumn("folded_root", fold(F.col(leaf), F.col("steps"))).withColumn("verified", F.coalesce(F.col("folded_root") == F.col("root"), F.lit(False)))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest of `documents` by source; a row whose id has an even crc32 is checked with its text's line feeds deleted (a null id is not)."""
    docs = table(spark, sf_dir, "documents")
    columns = ["doc_id", "source", "lang", "n_chars"]
    digest = lambda text: leaf_digest(*map(F.col, columns), text)
    tampered = F.col("doc_id").isNotNull() & held_out(F.col("doc_id"), 2, 0) & F.contains("text", F.lit("\n"))
    checked = F.when(tampered, digest(F.translate("text", "\n", ""))).alias("tampered")
    proofs = manifest(docs, digest(F.col("text")), "source", "doc_id", [checked])
    found = verify(proofs.withColumn("checked", F.coalesce("tampered", "leaf")), "checked")
    return found.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("steps")).alias("proof_sha256"), "folded_root", "verified")


OP12_SQL = r"""
WITH RECURSIVE f AS (
  SELECT *, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
    CASE WHEN doc_id IS NOT NULL AND list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(strlen(doc_id::VARCHAR)), lambda i: ascii(substr(doc_id::VARCHAR, i + 1, 1))::BIGINT)),
      lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda y, z: CASE WHEN y % 2 = 1 THEN xor(y // 2, 3988292384) ELSE y // 2 END)) % 2 = 1 THEN replace(text, chr(10), '') ELSE text END AS other
  FROM documents),
h AS MATERIALIZED (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(other) || ':' || other, '-')) AS checked FROM f),
r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r, count(*) OVER (PARTITION BY source) AS n FROM h),
t AS (
  SELECT source, 0 AS lvl, r AS i, leaf AS d, n FROM r
  UNION ALL
  SELECT source, lvl + 1, i // 3, sha256(string_agg(d, '' ORDER BY i)), (any_value(n) + 2) // 3 FROM t WHERE n > 1 GROUP BY source, lvl, i // 3),
s AS MATERIALIZED (SELECT source, d AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS r, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (
  SELECT 0 AS lvl, r AS i, subroot AS d, n FROM s
  UNION ALL
  SELECT lvl + 1, i // 3, sha256(string_agg(d, '' ORDER BY i)), (any_value(n) + 2) // 3 FROM u WHERE n > 1 GROUP BY lvl, i // 3),
a AS MATERIALIZED (
  SELECT source, lvl, i, coalesce(string_agg(o, '' ORDER BY j) FILTER (j < i), '') AS left_, coalesce(string_agg(o, '' ORDER BY j) FILTER (j > i), '') AS right_
  FROM (SELECT x.source, x.lvl, x.i, y.i AS j, y.d AS o FROM t x JOIN t y ON x.source IS NOT DISTINCT FROM y.source AND x.lvl = y.lvl AND x.i // 3 = y.i // 3 WHERE x.n > 1) GROUP BY ALL),
b AS MATERIALIZED (
  SELECT lvl, i, coalesce(string_agg(o, '' ORDER BY j) FILTER (j < i), '') AS left_, coalesce(string_agg(o, '' ORDER BY j) FILTER (j > i), '') AS right_
  FROM (SELECT x.lvl, x.i, y.i AS j, y.d AS o FROM u x JOIN u y ON x.lvl = y.lvl AND x.i // 3 = y.i // 3 WHERE x.n > 1) GROUP BY ALL),
heights AS (SELECT source, max(lvl) AS top FROM t GROUP BY source),
p AS (
  SELECT r.source, r.r, r.doc_id, r.leaf, 0 AS lvl, r.r AS i, checked AS folded, '' AS proof, top, s.subroot, s.r AS sr FROM r JOIN heights g ON r.source IS NOT DISTINCT FROM g.source JOIN s ON r.source IS NOT DISTINCT FROM s.source
  UNION ALL
  SELECT p.source, r, doc_id, leaf, p.lvl + 1, p.i // 3, sha256(left_ || folded || right_), proof || left_ || right_, top, subroot, sr
  FROM p JOIN a ON p.lvl < top AND p.source IS NOT DISTINCT FROM a.source AND p.lvl = a.lvl AND p.i = a.i),
q AS (
  SELECT doc_id, leaf, subroot, 0 AS lvl, sr AS i, folded, proof FROM p WHERE lvl = top
  UNION ALL
  SELECT doc_id, leaf, subroot, q.lvl + 1, q.i // 3, sha256(left_ || folded || right_), proof || left_ || right_ FROM q JOIN b ON q.lvl = b.lvl AND q.i = b.i)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM q, (SELECT d AS root, lvl AS last FROM u WHERE n = 1) WHERE lvl = last
"""
