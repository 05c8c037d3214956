"""Merkle manifests of datasets: levels built bottom-up, proofs pushed top-down, in DataFrame functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomstead.llm.common import staged, unstage

#: Nodes that one parent takes.
FAN = 16
#: Columns that a leaf hashes, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_STEP = "struct<before: string, after: string>"


def leaf_of(fields: tuple[str, ...] = FIELDS, **instead: Column) -> Column:
    """sha256 of a row's fields: each `-` if null, else its length in bytes, `:` and its value."""
    shown = [instead.get(f, F.col(f)).cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in shown]), 256)


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with place (from 0 in each group, by order, nulls last) and n, the group's number of rows; group has no nulls.

    Rows are dealt out in ranges of group and order and counted in each, so a
    group can lie in many ranges and none is numbered in one task.
    """
    keys = [F.asc_nulls_last(c) for c in order]
    dealt = rows.repartitionByRange(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.asc(group), *keys)
    dealt = staged(dealt.withColumn("_range", F.spark_partition_id()), "ranges")
    held = dealt.groupBy(F.col("_range").alias("_r"), F.col(group).alias("_g")).agg(F.count(F.lit(1)).alias("_held"))
    of = W.partitionBy("_g")  # a row for each range that the group lies in
    before = F.coalesce(F.sum("_held").over(of.orderBy("_r").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    held = held.select("_r", "_g", before.alias("_base"), F.sum("_held").over(of).alias("n"))
    own = dealt.withColumn("_own", F.row_number().over(W.partitionBy("_range", group).orderBy(*keys)))
    found = own.join(held, (F.col("_range") == F.col("_r")) & (F.col(group) == F.col("_g")))
    found = staged(found.select(*rows.columns, (F.col("_base") + F.col("_own") - 1).alias("place"), "n"), "placed")
    unstage(dealt)
    return found


def build_levels(leaves: DataFrame, fan: int = FAN) -> list[DataFrame]:
    """Levels over leaves (g, place, n, hash, ...), the leaves first: each is written, and its nodes are (g, place, n, hash, children).

    Up to `fan` consecutive nodes of a group of several become the next
    level's node, whose hash is that of theirs, joined; n is the number of
    the group's nodes in the level. A group ends with its only node.
    """
    levels = [leaves.withColumn("children", F.lit(None).cast("array<string>"))]
    while True:
        up = levels[-1].where("n > 1").groupBy("g", F.expr(f"place div {fan}").alias("place"))
        nodes = up.agg(F.max(F.expr(f"(n + {fan - 1}) div {fan}")).alias("n"), F.array_sort(F.collect_list(F.struct("place", "hash"))).alias("c"))
        nodes = nodes.withColumn("children", F.col("c.hash"))
        level = staged(nodes.select("g", "place", "n", F.sha2(F.array_join("children", ""), 256).alias("hash"), "children"), "level")
        if level.isEmpty():
            unstage(level)
            return levels
        levels.append(level)


def tops(levels: list[DataFrame]) -> DataFrame:
    """(g, hash): the last node of every group."""
    ends = [x.where("n = 1").select("g", "hash") for x in levels]
    return staged(_union(ends), "tops")


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for x in tables[1:]:
        out = out.unionByName(x)
    return out


def push_proofs(levels: list[DataFrame], above: DataFrame, fan: int = FAN) -> DataFrame:
    """Every leaf of levels (its columns but n) with the columns of its group in above (g, path, ...); its path is its siblings level by level, then its group's.

    A step of a path is (before, after): the hashes of the run's nodes before
    and after the own one, joined. From the top down, children meet their
    parent, put its other children before what it inherited, and pass it on.
    """
    carried = [c for c in above.columns if c not in ("g", "path")]
    given = above.select(F.col("g").alias("g1"), "path", *carried)
    down = None
    for depth, level in reversed(list(enumerate(levels))):
        kept = ["g", "place", "children"] if depth else [c for c in level.columns if c not in ("n", "children")]
        found = level.where("n = 1").join(given, F.col("g") == F.col("g1")).select(*kept, "path", *carried)
        if down is not None:
            parent = down.select(F.col("g").alias("g1"), F.col("place").alias("up"), F.col("children").alias("run"), "path", *carried)
            i = F.expr(f"cast(place % {fan} as int)")
            step = F.struct(F.array_join(F.slice("run", F.lit(1), i), "").alias("before"), F.array_join(F.slice("run", i + 2, F.lit(fan)), "").alias("after"))
            met = level.where("n > 1").join(parent, (F.col("g") == F.col("g1")) & (F.expr(f"place div {fan}") == F.col("up")))
            found = found.unionByName(met.select(*kept, F.concat(F.array(step), F.col("path")).alias("path"), *carried))
        down = found
    return down


@dataclass
class Manifest:
    """A dataset's tree: rows (the leaves, numbered), the levels of the groups' trees, the groups' roots (numbered), the tree over them, and its root (a row)."""

    rows: DataFrame
    levels: list[DataFrame]
    roots: DataFrame
    top: list[DataFrame]
    root: DataFrame
    fan: int


def build(docs: DataFrame, fan: int = FAN, tampered: Column | None = None) -> Manifest:
    """The manifest of docs: a tree over each source's rows by doc_id, and one over the sources' roots.

    rows are (doc_id, leaf, changed, g, place, n, hash); changed is the leaf
    with `tampered` for the text (the leaf itself without it). g is the source
    with `=` before it, empty for null, so that null comes first and sources
    follow bytewise. Of equal ids the lesser leaf comes first; null ids come
    last. Null texts and other nulls hash as `-`, empty ones as `0:`. Repeated
    rows are leaves each; other columns are ignored, whatever their names; an
    empty table has no node and no root.
    """
    kinds = {"doc_id": "long", "n_chars": "long"}
    given = docs.select(*[F.col(f).cast(kinds.get(f, "string")).alias(f) for f in FIELDS])
    group = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    leaves = given.select("doc_id", leaf_of().alias("hash"), (leaf_of(text=tampered) if tampered is not None else leaf_of()).alias("changed"), group.alias("g"))
    rows = numbered(leaves, "g", ["doc_id", "hash"])
    levels = build_levels(rows, fan)
    subroots = tops(levels).select(F.col("g").alias("name"), "hash", F.lit("").alias("g"))
    roots = numbered(subroots, "g", ["name"])
    top = build_levels(roots, fan)
    return Manifest(rows, levels, roots, top, tops(top).select(F.col("hash").alias("root")), fan)


def proofs(tree: Manifest) -> DataFrame:
    """(doc_id, leaf, changed, subroot, root, path) of every row: its siblings level by level, through its source's root to the root."""
    start = tree.root.select(F.lit("").alias("g"), "root", F.array().cast(f"array<{_STEP}>").alias("path"))
    sources = push_proofs(tree.top, start, tree.fan).select(F.col("name").alias("g"), F.col("hash").alias("subroot"), "path", "root")
    return push_proofs(tree.levels, sources, tree.fan).select("doc_id", F.col("hash").alias("leaf"), "changed", "subroot", "root", "path")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, leaf, lambda h, step: F.sha2(F.concat(step["before"], h, step["after"]), 256))


def audited(docs: DataFrame, tampered: Column, fan: int = FAN) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row of docs (see build).

    folded_root is what the row's leaf with `tampered` for its text and its
    siblings of the untampered tree give; verified says that it is the root.
    """
    told = proofs(build(docs, fan, tampered))
    proof = F.array_join(F.transform("path", lambda step: F.concat(step["before"], step["after"])), "")
    shown = told.select("doc_id", "leaf", "subroot", "root", F.sha2(proof, 256).alias("proof_sha256"), folded(F.col("changed"), F.col("path")).alias("folded_root"))
    return shown.withColumn("verified", F.col("folded_root") == F.col("root"))


def lowered_in_a_fifth() -> Column:
    """The text with A-Z lower-cased where 5 divides the crc32 of the id in decimal; null ids are left alone."""
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))


def oracle(fan: int = FAN) -> str:
    """audited(documents, lowered_in_a_fifth()) in DuckDB SQL."""
    field = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    hashed = lambda text: "sha256(" + " || ".join(field(c) for c in (*FIELDS[:-1], text)) + ")"
    step = "xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)"
    return f"""
WITH RECURSIVE digits AS (SELECT doc_id, 0 AS i, 4294967295::BIGINT AS c FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)
 UNION ALL SELECT doc_id, i + 1, CASE WHEN i % 9 = 0 THEN xor(c, ascii(substr(doc_id::VARCHAR, i // 9 + 1, 1))) ELSE {step} END FROM digits WHERE i < 9 * strlen(doc_id::VARCHAR)),
crc AS (SELECT doc_id, xor(c, 4294967295) AS crc FROM digits WHERE i = 9 * strlen(doc_id::VARCHAR)),
d AS (SELECT documents.*, CASE WHEN crc % 5 = 0 THEN translate(text, '{UPPER}', '{LOWER}') ELSE text END AS changed_text FROM documents LEFT JOIN crc USING (doc_id)),
l AS (SELECT row_number() OVER () AS r, doc_id, coalesce('=' || source, '') AS g, {hashed("text")} AS leaf, {hashed("changed_text")} AS changed FROM d),
p AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS LAST, leaf) - 1 AS place, count(*) OVER (PARTITION BY g) AS n FROM l),
t AS (SELECT 0 AS lvl, g, place, n, leaf AS hash FROM p
 UNION ALL SELECT lvl + 1, g, place // {fan}, (max(n) + {fan - 1}) // {fan}, sha256(string_agg(hash, '' ORDER BY place)) FROM t WHERE n > 1 GROUP BY lvl, g, place // {fan}),
s AS (SELECT g, hash AS subroot, lvl AS height, row_number() OVER (ORDER BY g) - 1 AS place, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT 0 AS lvl, place, n, subroot AS hash FROM s
 UNION ALL SELECT lvl + 1, place // {fan}, (max(n) + {fan - 1}) // {fan}, sha256(string_agg(hash, '' ORDER BY place)) FROM u WHERE n > 1 GROUP BY lvl, place // {fan}),
root AS (SELECT hash AS root, lvl AS height FROM u WHERE n = 1),
low AS (SELECT r, lvl, coalesce(string_agg(hash, '' ORDER BY place) FILTER (WHERE place < own), '') AS before, coalesce(string_agg(hash, '' ORDER BY place) FILTER (WHERE place > own), '') AS after
 FROM (SELECT r, p.g, k AS lvl, p.place // ({fan} ** k)::BIGINT AS own FROM p JOIN s USING (g) JOIN (SELECT unnest(range(20)) AS k) ON k < height) a JOIN t USING (g, lvl) WHERE t.place // {fan} = own // {fan} GROUP BY r, lvl),
high AS (SELECT g, k AS lvl, coalesce(string_agg(hash, '' ORDER BY u.place) FILTER (WHERE u.place < own), '') AS before, coalesce(string_agg(hash, '' ORDER BY u.place) FILTER (WHERE u.place > own), '') AS after
 FROM (SELECT g, k, place // ({fan} ** k)::BIGINT AS own FROM s, (SELECT unnest(range(20)) AS k), root WHERE k < root.height) a JOIN u ON u.lvl = k WHERE u.place // {fan} = own // {fan} GROUP BY g, k),
steps AS (SELECT r, lvl, before, after FROM low UNION ALL SELECT r, s.height + high.lvl, before, after FROM high JOIN p USING (g) JOIN s USING (g)),
path AS (SELECT r, list({{'b': before, 'a': after}} ORDER BY lvl) AS path FROM steps GROUP BY r),
f AS (SELECT r, 0 AS i, changed AS h FROM p UNION ALL SELECT r, i + 1, sha256(path[i + 1].b || h || path[i + 1].a) FROM f JOIN path USING (r) WHERE i < len(path))
SELECT doc_id, leaf, subroot, root, sha256(coalesce(array_to_string(list_transform(path, lambda x: x.b || x.a), ''), '')) AS proof_sha256, h AS folded_root, h = root AS verified
FROM p JOIN s USING (g) CROSS JOIN root LEFT JOIN path USING (r) JOIN f USING (r) WHERE i = coalesce(len(path), 0)
"""
