"""N-gram Jaccard join: size-banded tiles with hashed bitmap signatures."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomstead.llm.common import MASK, drop_shuffles, maybe_among, mixed, shingle_set, staged, unstage
from loomstead.llm.components import connected_components

#: Share of a set's shingles that its prefix is chosen from, in prefixes: the rarest of twice as many.
FRONT = 2
#: A shingle that one in so many rows has, or somewhat fewer, is counted before the others; so there are no more of these than
#: twice this number times the mean number of a set's shingles, whatever the number of rows.
HOT = 500
#: Sets and shingles that a block of a tile holds at most, if no single set is larger.
BLOCK_SETS = 256
BLOCK_SHINGLES = 500_000


def prefix_size(size: int, percent: int) -> int:
    """Shingles of a set, first in any order common to all, of which linked sets share one."""
    return size - -(-percent * size // 100) + 1


@lru_cache(maxsize=8)
def front_edges(percent: int) -> tuple[int, int]:
    """Where the hash space is cut in three: shingles below the first come first in the common order."""
    first = min(0.98, FRONT * (100 - percent) / 100)
    return int(first * 2**64), int((1 + first) / 2 * 2**64)


def front(grams: np.ndarray, percent: int) -> tuple[np.ndarray, int, int]:
    """The shingles of the thirds of the hash space that a set's prefix can lie in, as signed numbers, and how many are below each edge."""
    if not len(grams):
        return np.empty(0, np.int64), 0, 0
    one, two = (int(x) for x in np.searchsorted(grams, np.array(front_edges(percent), np.uint64)))
    k = prefix_size(len(grams), percent)
    upto = next(x for x in (one, two, len(grams)) if x >= k)
    return (grams[:upto] ^ np.uint64(1 << 63)).view(np.int64), one, two


def set_number(grams: np.ndarray) -> int:
    """A 64-bit number of the whole set."""
    total = int(mixed(grams * np.uint64(0xC2B2AE3D27D4EB4F)).sum(dtype=np.uint64)) + len(grams) * 0x9E3779B97F4A7C15
    return int(mixed(np.array([total & MASK], np.uint64)).astype(np.int64)[0])


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in arrays]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays) if arrays else np.empty(0, np.int64), pa.int64()))


def frequent(tokens: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that many of a few sets have, and how many."""
    found, times = np.unique(np.concatenate(tokens), return_counts=True) if tokens else (np.empty(0, np.int64), np.empty(0, np.int64))
    many = times >= max(4, len(tokens) // (4 * HOT))
    return found[many], times[many].astype(np.int64)


_DESCRIBED = "doc_id long, text_hash long, n_shingles long, set_id long, below_one long, below_two long, tokens array<long>, frequent array<long>, times array<long>"


def _described(words: int, percent: int):
    def describe(batches):
        for batch in batches:
            sizes, numbers, ones, twos, tokens, seen = [], [], [], [], [], set()
            for text in batch.column("text").to_pylist():
                grams = shingle_set(text, words)
                number = set_number(grams) if len(grams) else None
                some, one, two = front(grams, percent)
                sizes.append(len(grams))
                numbers.append(number)
                ones.append(one)
                twos.append(two)
                tokens.append(some[:0] if number in seen else some)  # an equal set of this batch gives them
                seen.add(number)
            none = [np.empty(0, np.int64)] * (len(tokens) - 1)  # the first row tells what is frequent in the batch
            often = [_lists([x, *none] if tokens else []) for x in frequent(tokens)]
            columns = [batch.column("doc_id"), batch.column("text_hash"), *(pa.array(x, pa.int64()) for x in (sizes, numbers, ones, twos)), _lists(tokens), *often]
            yield pa.record_batch(columns, names=["doc_id", "text_hash", "n_shingles", "set_id", "below_one", "below_two", "tokens", "frequent", "times"])

    return describe


def prefixes(described: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(set_id, token, n_shingles): the shingles of each set's prefix that another row has too, in the order of hash third, frequency and hash.

    Frequencies are counted over all rows of described. Any order common to
    all sets loses no link; rare shingles first make few false candidates.
    A set with as many shingles of its own as its prefix is long has no rows.
    The most frequent shingles, a bounded number, get theirs from the counts
    of the batches and a broadcast; so no shingle puts many rows in one task.
    """
    often = described.select(F.explode(F.arrays_zip("frequent", "times")).alias("x")).groupBy(F.col("x.frequent").alias("token")).agg(F.sum("x.times").alias("df"))
    hot = F.broadcast(staged(often.where(F.col("df") >= max(4, described.count() // (2 * HOT))), "hot"))
    rows = described.select("set_id", F.explode("tokens").alias("token"))
    counted = F.count(F.lit(1)).over(W.partitionBy("token"))
    cold = rows.join(hot, "token", "left_anti").withColumn("df", counted).where("df > 1")
    held = cold.select("set_id", "token", "df").unionByName(rows.join(hot, "token").select("set_id", "token", "df"))
    held = held.groupBy("set_id", "token").agg(F.min("df").alias("df"))  # equal sets of several batches gave theirs more than once
    one, two = (x - (1 << 63) for x in front_edges(percent))
    third = (F.col("token") >= one).cast("int") + (F.col("token") >= two).cast("int")
    rows = held.withColumn("third", third).join(classes.select("set_id", "n_shingles", "below_one", "below_two").hint("merge"), "set_id")
    of_third = W.partitionBy("set_id", "third")
    rows = rows.withColumn("rank", F.row_number().over(of_third.orderBy("df", "token"))).withColumn("n_common", F.count(F.lit(1)).over(of_third))
    end = F.when(F.col("third") == 0, F.col("below_one")).when(F.col("third") == 1, F.col("below_two")).otherwise(F.col("n_shingles"))
    size = F.col("n_shingles") - F.ceil(F.col("n_shingles") * percent / 100) + 1
    found = staged(rows.where(end - F.col("n_common") + F.col("rank") <= size).select("set_id", "token", "n_shingles"), "prefixes")
    drop_shuffles(found)
    return found


def candidate_edges(prefix: DataFrame, percent: int) -> DataFrame:
    """(a, b): edges that join all sets which share a token of their prefixes and whose sizes can link, without their pairs.

    Sizes that can link lie in one band or in neighbouring ones. The sets of
    a token and a band are joined to the least of them, and bands by it.
    """
    width = math.log(100 / percent) * 1.0001 if percent < 100 else 1e-9
    banded = prefix.withColumn("band", F.floor(F.log("n_shingles") / width))
    groups = banded.groupBy("token", "band").agg(F.min("set_id").alias("least"), F.min("n_shingles").alias("low"), F.max("n_shingles").alias("high"))
    groups = staged(groups, "groups")
    a, b = groups.alias("a"), groups.alias("b")
    stars = banded.alias("x").join(a, (F.col("x.token") == F.col("a.token")) & (F.col("x.band") == F.col("a.band"))).where("x.set_id <> a.least")
    next_to = (F.col("a.token") == F.col("b.token")) & (F.col("a.band") + 1 == F.col("b.band"))
    bridges = a.join(b, next_to).where((F.col("b.low") * percent <= F.col("a.high") * 100) & (F.col("a.least") != F.col("b.least")))
    edges = stars.select(F.col("x.set_id").alias("a"), F.col("a.least").alias("b")).union(bridges.select(F.col("a.least"), F.col("b.least"))).distinct()
    edges = staged(edges, "candidates")
    unstage(groups)
    return edges


def parity_bitmaps(sets: list[np.ndarray], bits: int) -> np.ndarray:
    """A row of 64-bit words for each set; a member flips the bit that it hashes to, so rows differ in no more bits than sets in members."""
    rows = np.zeros((len(sets), bits // 64), np.uint64)
    for row, grams in zip(rows, sets, strict=True):
        odd = (np.bincount((grams & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)
        row[:] = np.packbits(odd).view(np.uint64)
    return rows


def links_in_tile(sets: list[np.ndarray], sides: np.ndarray, percent: int, known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among the sets of a tile.

    sides: 0 and 1 for the two blocks of a tile, whose pairs are across; all
    0 for a block with itself. known: equal numbers for sets that are joined
    already. The counts of differing bits bound the overlap from above; what
    passes is decided on the sorted arrays, most alike first, and sets that
    are joined already are passed over.
    """
    order = np.argsort([len(s) for s in sets], kind="stable")
    sets, sides = [sets[i] for i in order], np.asarray(sides)[order]
    sizes, within = np.array([len(s) for s in sets], np.int64), not sides.any()
    label = np.arange(len(sets)) if known is None else np.unique(np.asarray(known)[order], return_inverse=True)[1]
    bits = 256
    while bits < min(16384, 3 * int(np.median(sizes))):
        bits *= 2
    maps, forest = parity_bitmaps(sets, bits), []
    for i in range(1, len(sets)):
        first = int(np.searchsorted(sizes, -(-percent * sizes[i] // 100)))
        near = np.arange(min(first, i), i)
        near = near[(label[near] != label[i]) & (within | (sides[near] != sides[i]))]
        if not len(near):
            continue
        least = np.bitwise_count(maps[near] ^ maps[i]).sum(axis=1, dtype=np.int64)
        bound = (sizes[near] + sizes[i] - least) // 2  # of the overlap
        enough = bound * (100 + percent) >= percent * (sizes[near] + sizes[i])
        near, least = near[enough], least[enough]
        for j in near[np.argsort(least, kind="stable")]:
            if label[j] == label[i]:
                continue
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * both >= percent * (sizes[i] + sizes[j] - both):
                forest.append((int(order[i]), int(order[j])))
                label[label == label[j]] = label[i]
    return forest


def _tile_links(words: int, percent: int):
    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        sets, numbers = [shingle_set(x, words) for x in pdf["text"]], pdf["set_id"].to_numpy()
        found = links_in_tile(sets, pdf["side"].to_numpy(), percent, pdf["root"].to_numpy())
        return pd.DataFrame({"a": [numbers[i] for i, _ in found], "b": [numbers[j] for _, j in found]}, dtype="int64")

    return links


def _blocks(live: DataFrame) -> DataFrame:
    """(set_id, cluster, n_shingles, block): the sets of a cluster laid out by size in blocks of bounded number and mass.

    A cell of one size that is larger than a block is split by hash.
    """
    weight = F.greatest(F.col("n_shingles") / BLOCK_SHINGLES, F.lit(1 / BLOCK_SETS))
    cells = live.groupBy("cluster", "n_shingles").agg((F.count(F.lit(1)) * F.first(weight)).alias("mass"))
    before = F.sum("mass").over(W.partitionBy("cluster").orderBy("n_shingles").rowsBetween(W.unboundedPreceding, -1))
    cells = cells.select(
        F.col("cluster").alias("c"), F.col("n_shingles").alias("n"), F.floor(F.coalesce(before, F.lit(0.0))).alias("first"), F.ceil(F.col("mass")).alias("split")
    )
    placed = live.join(cells, (live.cluster == cells.c) & (live.n_shingles == cells.n))
    return placed.select("set_id", "cluster", "n_shingles", (F.col("first") + F.pmod(F.xxhash64("set_id"), F.col("split"))).alias("block"))


def _tile_pairs(placed: DataFrame, percent: int) -> DataFrame:
    """(cluster, low, high) of the blocks of placed (set_id, cluster, n_shingles, block, root) that can have links across which join anything, with the one root of each block that has but one."""
    only = F.when(F.min("root") == F.max("root"), F.min("root"))
    spans = placed.groupBy("cluster", "block").agg(F.min("n_shingles").alias("lo"), F.max("n_shingles").alias("hi"), only.alias("only"))
    a, b = spans.alias("a"), spans.alias("b")
    pairs = a.join(b, (F.col("a.cluster") == F.col("b.cluster")) & (F.col("a.block") < F.col("b.block")))
    pairs = pairs.where((F.col("b.lo") * percent <= F.col("a.hi") * 100) & ~F.coalesce(F.col("a.only") == F.col("b.only"), F.lit(False)))
    return pairs.select(F.col("a.cluster").alias("c"), F.col("a.block").alias("low"), F.col("b.block").alias("high"), F.col("a.only").alias("low_only"), F.col("b.only").alias("high_only"))


def verified_links(live: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Staged (a, b): links that join all linked sets of live (set_id, cluster, n_shingles), whose texts are given once each.

    First each block is joined with itself. In clusters of several blocks, one
    set of each component so found then stands for it in blocks of its own;
    last, blocks are joined with each other as far as they hold sets not yet
    joined. A great cluster of copies is one component after the second step.
    """
    placed = _blocks(live)
    full = staged(placed.join(texts, "set_id"), "live")
    tile, schema = _tile_links(words, percent), "a long, b long"
    alone = full.select("set_id", "text", F.lit(0).alias("side"), F.col("set_id").alias("root"), "cluster", "block")
    links = staged(alone.groupBy("cluster", "block").applyInPandas(tile, schema), "links")
    large = full.where("block > 0").select("cluster").distinct()
    if large.isEmpty():
        unstage(full)
        return links
    sets = staged(full.select("set_id", "cluster", "n_shingles", "block").join(large, "cluster"), "large")

    def rooted(found: DataFrame) -> DataFrame:
        roots = connected_components(found).withColumnRenamed("node", "set_id")
        return sets.join(roots, "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))

    stand_ins = rooted(links).groupBy("cluster", "root").agg(F.min(F.struct("set_id", "n_shingles")).alias("x"))
    again = _blocks(stand_ins.select("x.set_id", "cluster", "x.n_shingles"))
    again = again.join(full.select("set_id", "text"), "set_id").select("set_id", "text", F.lit(0).alias("side"), F.col("set_id").alias("root"), "cluster", "block")
    links = staged(links.union(again.groupBy("cluster", "block").applyInPandas(tile, schema)), "links")
    placed = staged(rooted(links), "rooted")
    pairs = staged(_tile_pairs(placed, percent), "pairs")
    sides = []
    for side, own, other in ((0, "low", "high_only"), (1, "high", "low_only")):
        open_ = F.col(other).isNull() | (F.col(other) != F.col("root"))
        joined = placed.join(pairs, (F.col("cluster") == F.col("c")) & (F.col("block") == F.col(own))).where(open_)
        sides.append(joined.select("set_id", "root", "cluster", "low", "high", F.lit(side).alias("side")))
    across = sides[0].union(sides[1]).join(full.select("set_id", "text"), "set_id")
    across = across.select("set_id", "text", "side", "root", "cluster", "low", "high").groupBy("cluster", "low", "high").applyInPandas(tile, schema)
    links = staged(links.union(across), "links")
    unstage(full, sets, placed, pairs)
    return links


def jaccard_groups(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, text_hash, n_shingles, set_id, component_id, root.

    Two documents link when 100 * intersection >= percent * union of their
    sets of distinct shingles of `words` words (A-Z lower-cased; with fewer
    words the whole sequence; none for null or blank texts, which link with
    nothing). component_id is the smallest doc_id reachable by links.

    Equal sets are one node from the start. Linked sets share a shingle of
    their prefixes, in an order with the rarest first (see prefixes): without
    loss, these give the nodes that can have a partner and small clusters of
    them. Each cluster is cut into size-banded tiles of bounded number and
    mass, where bitmaps bound the overlap before the sorted arrays decide. A
    tile returns a spanning forest, never its pairs (see verified_links).

    Nulls: a null doc_id is a document of its own whose component_id is the
    smallest id that it reaches, null if there is none. Rows with one doc_id
    are separate documents. Ties and repeated rows join as equal sets. Other
    columns are ignored. An empty table gives an empty result. Texts of any
    length are one set each. Sets and shingles are told apart by 64-bit
    hashes. root names a component whatever its ids are: it is one of its
    set_ids, null where set_id is.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    described = staged(rows.mapInArrow(_described(words, percent), _DESCRIBED), "described")
    classes = described.where("set_id is not null").groupBy("set_id").agg(
        F.min("doc_id").alias("least_id"), F.min(F.struct("doc_id", "text_hash")).alias("shown"), *(F.max(c).alias(c) for c in ("n_shingles", "below_one", "below_two"))
    )
    classes = staged(classes, "classes")
    named = staged(described.select("doc_id", "text_hash", "n_shingles", "set_id"), "sets")
    prefix = prefixes(described, classes, percent)
    unstage(described)
    edges = candidate_edges(prefix, percent)
    unstage(prefix)
    clusters = connected_components(edges).select(F.col("node").alias("set_id"), F.col("root").alias("cluster"))
    live = staged(classes.join(clusters, "set_id").select("set_id", "cluster", "n_shingles", "shown"), "live")
    shown = live.select("set_id", F.col("shown.doc_id").alias("at_id"), F.col("shown.text_hash").alias("at_hash"))
    near = maybe_among(rows, live.select(F.col("shown.text_hash").alias("text_hash")), "text_hash")
    texts = near.join(shown, F.col("doc_id").eqNullSafe(F.col("at_id")) & (F.col("text_hash") == F.col("at_hash")))
    texts = texts.groupBy("set_id").agg(F.min("text").alias("text"))
    links = verified_links(live.select("set_id", "cluster", "n_shingles"), texts, words, percent)
    roots = connected_components(links)
    joined = classes.select("set_id", "least_id").join(roots.select(F.col("node").alias("set_id"), "root"), "set_id", "left")
    joined = joined.select("set_id", "least_id", F.coalesce("root", "set_id").alias("root"))
    smallest = joined.groupBy("root").agg(F.min("least_id").alias("component_id"))
    of_sets = staged(joined.select("set_id", "root").join(smallest, "root").select(F.col("set_id").alias("of_set"), "component_id", "root"), "named")
    unstage(edges, live, links, classes)
    drop_shuffles(of_sets)
    component = F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    return named.join(of_sets, named.set_id == of_sets.of_set, "left").select("doc_id", "text_hash", "n_shingles", "set_id", component, "root")
