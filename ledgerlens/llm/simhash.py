"""SimHash fingerprints, their near-duplicate links by a binary trie self-join, and the components of those links.

Rows with the same fingerprint collapse first, so copies cost nothing. Two fingerprints that differ in at most ``budget``
bits agree on ``budget``-less-than-all of any split of their bits into blocks; every such choice of agreeing blocks is a
key, and fingerprints that share a key form a cell. More fingerprints get finer blocks, so cells stay small on average; a
cell over ``CELL`` is dealt out as pairs of its parts. Inside a task the cells are implicit binary tries over sorted
fingerprints, and pairs of trie nodes are traversed together, level by level, adding up differing bits and dropping a pair
whose sum exceeds the budget. A task reports only a spanning forest of the links it finds, never all pairs. The forests are
merged into components by alternating large-star and small-star steps.

With several fingerprints a row, the keys are what fills disks. Then cells are wide, so that there are few keys, and a task splits
a wide cell again, by choices of blocks of the bits that its key leaves open, and compares what agrees in one directly. As such
links are verified, it reports near pairs themselves: all of a fingerprint that has few, else those of several minimum forests.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import broadcast_few, fresh, frugal, materialise

CELL = 512
PAIRS_AT_ONCE = 100_000
#: With several fingerprints: about how many of them share a key at most; those that are compared directly, and in one piece; the
#: least and the times the expected number from which a cell is dealt out; and the forests of near pairs that it hands on.
WIDE, DIRECT, TILE, LEAST_HOT, TIMES_HOT, FORESTS = 1 << 18, 4096, 512, 4096, 4, 2


def mixer(i: int) -> int:
    """The i-th odd multiplier that makes further hash values of a shingle from its XXH64 value, as other seeds would."""
    return (0x9E3779B97F4A7C15 * (2 * i + 1) ^ (i * 0xC2B2AE3D27D4EB4F)) % (1 << 64) | 1


def fingerprints(text: str | None, shingle: int, seed: int = 42, several: int = 1) -> list[int]:
    """Bit-wise majorities of the XXH64 values of all word shingles (repeats included), as signed 64-bit integers.

    The first is that of the values themselves, the others are of values mixed from them.
    """
    words = text.encode().lower().split() if text else []
    if not words:
        return [0] * several
    ends = list(accumulate(len(w) + 1 for w in words))
    joined = b" ".join(words)
    spans = zip([0, *ends], ends[shingle - 1 :]) if len(words) > shingle else [(0, ends[-1])]
    digest = xxhash.xxh64_intdigest
    hashes, out = np.array([digest(joined[a : b - 1], seed) for a, b in spans], dtype="<u8"), []
    for i in range(several):
        if i:
            mixed = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(mixer(i))
            hashes_i = mixed ^ (mixed >> np.uint64(32))
        else:
            hashes_i = hashes
        ones = np.zeros(64, dtype=np.int64)
        for at in range(0, len(hashes_i), 1 << 16):
            part = hashes_i[at : at + (1 << 16)]
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0]))
    return out


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """The distinct XXH64 values of a text's word shingles, in order."""
    words = text.encode().lower().split() if text else []
    size = min(shingle, len(words))
    each = {xxhash.xxh64_intdigest(b" ".join(words[i : i + size]), 42) for i in range(len(words) - size + 1)} if words else ()
    return np.sort(np.array(list(each), dtype=np.uint64).view(np.int64))


def shingle_sets(text: str, shingle: int):
    @F.pandas_udf(T.ArrayType(T.LongType()))
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        frugal()
        for batch in batches:
            yield pd.Series([shingle_set(t, shingle) for t in batch], dtype=object)

    return udf(F.col(text))


def fingerprint_column(text: str, shingle: int):
    @F.pandas_udf(T.LongType())
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        frugal()
        for batch in batches:
            yield pd.Series([fingerprints(t, shingle)[0] for t in batch], dtype="int64")

    return udf(F.col(text))


def several_fingerprints(text: str, shingle: int, several: int):
    @F.pandas_udf(T.ArrayType(T.LongType()))
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        frugal()
        for batch in batches:
            yield pd.Series([fingerprints(t, shingle, several=several) for t in batch], dtype=object)

    return udf(F.col(text))


def trie_pairs(fp: np.ndarray, starts: np.ndarray, ends: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of fingerprints that differ in at most ``budget`` bits, within each [start, end) of sorted distinct values."""
    la, ha, lb, hb = starts, ends, starts, ends
    diff = np.zeros(len(starts), dtype=np.int8)
    found_a, found_b = [], []
    for bit in range(63, -2, -1):  # below bit 0 every node is a single value, so nothing is left to split
        alone = (ha - la == 1) & (hb - lb == 1)
        if alone.any():
            a, b = la[alone], lb[alone]
            near = (a != b) & (np.bitwise_count(fp[a] ^ fp[b]) <= budget)
            found_a.append(a[near])
            found_b.append(b[near])
            la, ha, lb, hb, diff = (x[~alone] for x in (la, ha, lb, hb, diff))
        if not len(la):
            break
        ones = np.concatenate(([0], np.cumsum((fp >> np.uint64(bit)) & np.uint64(1)).astype(np.int64)))
        ma, mb, same = ha - (ones[ha] - ones[la]), hb - (ones[hb] - ones[lb]), la == lb
        parts = [
            (la, ma, lb, mb, diff, np.ones(len(la), bool)),
            (ma, ha, mb, hb, diff, np.ones(len(la), bool)),
            (la, ma, mb, hb, diff + 1, diff < budget),
            (ma, ha, lb, mb, diff + 1, (diff < budget) & ~same),
        ]
        kept = [[x[keep & (p[0] < p[1]) & (p[2] < p[3])] for x in p[:5]] for p in parts for keep in [p[5]]]
        la, ha, lb, hb, diff = (np.concatenate(x) for x in zip(*kept))
    return np.concatenate(found_a or [starts[:0]]), np.concatenate(found_b or [starts[:0]])


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each of n nodes reaches over the links (a, b)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        for x in (a, b):
            np.minimum.at(new, root[x], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def nearest_forest(n: int, a: np.ndarray, b: np.ndarray, distance: np.ndarray) -> np.ndarray:
    """Which of the links (a, b) make a minimum spanning forest of n nodes: two linked nodes meet over links no longer than theirs."""
    root, kept = np.arange(n), []
    for d in np.unique(distance):
        links = np.flatnonzero(distance == d)
        while True:
            ra, rb = root[a[links]], root[b[links]]
            links, ra, rb = links[ra != rb], ra[ra != rb], rb[ra != rb]
            if not len(links):
                break
            high, first = np.unique(np.maximum(ra, rb), return_index=True)  # each of these joins a lower one, so none goes round
            kept.append(links[first])
            up = np.arange(n)
            up[high] = np.minimum(ra, rb)[first]
            while (up[up] != up).any():
                up = up[up]
            root = up[root]
    return np.concatenate(kept or [np.empty(0, np.int64)])


def tile_pairs(fp: np.ndarray, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of fingerprints that differ in at most ``budget`` bits: each with each, a tile at a time."""
    for i in range(0, len(fp), TILE):
        for j in range(i, len(fp), TILE):
            right = fp[j : j + TILE]
            near = np.flatnonzero(np.bitwise_count(fp[i : i + TILE, None] ^ right) <= budget)
            a, b = near // len(right) + i, near % len(right) + j
            yield a[a < b], b[a < b]


def cell_pairs(fp: np.ndarray, budget: int, agreed: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same of a cell whose fingerprints agree in the bits ``agreed``; a pair may come several times.

    A large cell is split by each choice of blocks of its other bits, unless so many agree in these too that this would be more work.
    """
    if len(fp) > DIRECT:
        masks = [np.uint64(m) for m in block_masks(len(fp), budget, TILE // 2, [b for b in range(64) if not agreed >> b & 1])]
        cuts = lambda x: np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1], [True])))
        if 2 * sum(int((np.diff(cuts(np.sort(fp & m))) ** 2).sum()) for m in masks) < len(fp) ** 2:
            for m in masks:
                order = np.argsort(fp & m)
                at = cuts((fp & m)[order])
                for start, end in zip(at[:-1], at[1:]):
                    if end - start > 1:
                        own = order[start:end]
                        yield from ((own[a], own[b]) for a, b in tile_pairs(fp[own], budget))
            return
    yield from tile_pairs(fp, budget)


def few_links(a: np.ndarray, b: np.ndarray, distance: np.ndarray) -> np.ndarray:
    """Which of the links (a, b) make ``FORESTS`` minimum spanning forests, each of what the ones before it left: all those of a node with so few."""
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    u, v = ends[: len(a)], ends[len(a) :]
    left, kept = np.arange(len(a)), []
    for _ in range(FORESTS):
        own = nearest_forest(len(nodes), u[left], v[left], distance[left])
        kept.append(left[own])
        left = np.delete(left, own)
        if not len(left):
            break
    return np.concatenate(kept)


def cell_links(fp: np.ndarray, budget: int, agreed: int) -> tuple[np.ndarray, np.ndarray]:
    """The near pairs of a cell, or the nearest ones that ``few_links`` keeps; of all near pairs only some are held at once."""
    held, n = [(np.empty(0, np.int64), np.empty(0, np.int64))], 0

    def fewer() -> tuple[np.ndarray, np.ndarray]:
        a, b = (np.concatenate(x) for x in zip(*held))
        once = np.unique(np.minimum(a, b) * len(fp) + np.maximum(a, b))
        a, b = once // len(fp), once % len(fp)
        own = few_links(a, b, np.bitwise_count(fp[a] ^ fp[b]))
        return a[own], b[own]

    for a, b in cell_pairs(fp, budget, agreed):
        if len(a):
            held.append((a, b))
            n += len(a)
            if n > PAIRS_AT_ONCE + 2 * FORESTS * len(fp):
                held = [fewer()]
                n = len(held[0][0])
    return fewer() if n else held[0]


def _cell_links(budget: int):
    """Over batches sorted by cell: (u, root) links of each cell's spanning forest."""

    def links(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        starts, ends = _cells(keys)
        group = np.repeat(np.arange(len(starts)), ends - starts)
        fps = fps[np.lexsort((fps, group))]
        run = np.cumsum((ends - starts) ** 2) // PAIRS_AT_ONCE
        u, v = [], []
        for r in np.unique(run):
            own = run == r
            lo = starts[own][0]
            part = fps[lo : ends[own][-1]]
            root = forest(len(part), *trie_pairs(part, starts[own] - lo, ends[own] - lo, budget))
            moved = np.flatnonzero(root != np.arange(len(part)))
            u.append(part[moved])
            v.append(part[root[moved]])
        u, v = np.concatenate(u).view(np.int64), np.concatenate(v).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return _by_cell(links)


def _near_cell_links(budget: int, masks: list[int]):
    """Over batches sorted by cell: (u, v, block) of each cell's near pairs, where they are many the nearest."""

    def links(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        u, v, block = [fps[:0]], [fps[:0]], [keys[:0, 0]]
        for start, end in zip(*_cells(keys)):
            if end - start > 1:
                cell = np.sort(fps[start:end])  # so that reruns choose the same among links of a length
                a, b = cell_links(cell, budget, masks[int(keys[start, 0]) % len(masks)])
                u.append(cell[a])
                v.append(cell[b])
                block.append(np.repeat(keys[start, 0], len(a)))
        u, v = np.concatenate(u).view(np.int64), np.concatenate(v).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(np.concatenate(block))], names=["u", "v", "block"])

    return _by_cell(links)


def _cells(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
    return np.concatenate(([0], cuts)), np.concatenate((cuts, [len(keys)]))


def _by_cell(links):
    """``links`` of the keys and fingerprints of whole cells, from batches sorted by cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frugal()
        held, n, most = [(np.empty((0, 3), np.int64), np.empty(0, np.uint64))], 0, 50_000
        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            held.append((np.stack(cols[:3], axis=1).astype(np.int64), cols[3].astype(np.int64).view(np.uint64)))
            n += batch.num_rows
            if n > most:
                keys, fps = (np.concatenate(x) for x in zip(*held))
                last = np.flatnonzero((keys != keys[-1]).any(axis=1))
                cut = last[-1] + 1 if len(last) else 0
                if cut:
                    yield links(keys[:cut], fps[:cut])
                held, n = [(keys[cut:], fps[cut:])], len(keys) - cut
                most = max(50_000, 2 * n)  # a cell that goes on is put together a few times only
        if n:
            yield links(*(np.concatenate(x) for x in zip(*held)))

    return run


def block_masks(n: int, budget: int, cell: int = 64, bits: Sequence[int] = range(64)) -> list[int]:
    """Masks of those of ``bits`` on which some choice of blocks agrees; enough blocks that n fingerprints make cells of about ``cell``."""
    blocks = budget + 1
    while n >> (len(bits) * (blocks - budget) // blocks) > cell and blocks < budget + 4:
        blocks += 1
    edges = [round(i * len(bits) / blocks) for i in range(blocks + 1)]
    each = [sum(1 << b for b in bits[edges[i] : edges[i + 1]]) for i in range(blocks)]
    return [sum(c) for c in combinations(each, blocks - budget)]


def near_links(fps: DataFrame, budget: int, several: int = 0) -> DataFrame:
    """Links (u, v) whose components are those of all pairs of distinct fingerprints (column ``fp``) within the budget.

    With ``several`` fingerprints, numbered in ``i``, each kind is linked in itself, links are (i, u, v) and near pairs themselves:
    all of a fingerprint that has few in a cell, and else near pairs are linked over the nearest.
    """
    n = fps.count() // max(1, several)
    masks = block_masks(n, budget, WIDE if several else 64)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    most = max(LEAST_HOT, TIMES_HOT * (n >> min(m.bit_count() for m in masks))) if several else CELL
    kind = F.col("i") if several else F.lit(0)
    blocks = F.array(*[F.struct((kind * len(signed) + i).alias("block"), F.col("fp").bitwiseAND(F.lit(m)).alias("part")) for i, m in enumerate(signed)])
    keyed = fps.select("fp", F.explode(blocks).alias("k")).select("k.*", "fp")
    sizes = keyed.groupBy("block", "part").count().filter(F.col("count") > most)
    hot = materialise(sizes.select("block", "part", F.ceil(F.col("count") / most).cast("int").alias("cuts")), "hot")
    cut = keyed.join(broadcast_few(hot), ["block", "part"], "left")
    own = F.pmod(F.xxhash64("fp"), F.col("cuts")).cast("int")
    # Each part of a hot cell meets each other part once, in a cell of their own; a cell that isn't hot is its only part.
    others = F.when(F.col("cuts").isNull(), F.array(F.lit(0))).otherwise(F.transform(F.sequence(F.lit(0), F.col("cuts") - 1), lambda q: F.least(q, own) * F.col("cuts") + F.greatest(q, own)))
    cells = cut.select("block", "part", F.explode(others).alias("cell"), "fp")
    dealt = cells.repartition("block", "part", "cell").sortWithinPartitions("block", "part", "cell").select("block", "part", "cell", "fp")
    if not several:
        return dealt.mapInArrow(_cell_links(budget), "u long, v long")
    links = dealt.mapInArrow(_near_cell_links(budget, masks), "u long, v long, block long")
    return links.select(F.floor(F.col("block") / len(signed)).cast("int").alias("i"), "u", "v")


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every linked node, by alternating large-star and small-star steps until nothing changes."""
    edges = materialise(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct()
        edges = materialise(small, "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now


def named_components(classes: DataFrame, budget: int) -> DataFrame:
    """(fp, component_id) of classes (fp, first): the least ``first`` of all fingerprints reachable over the links."""
    roots = components(near_links(classes.select("fp"), budget))
    rooted = classes.join(roots, classes.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    # Only components of several fingerprints need a name; they are few, so a large one isn't gathered to be named.
    several = rooted.groupBy("root").agg(F.min("first").alias("least"), F.count("*").alias("n")).filter("n > 1").drop("n")
    several = broadcast_few(materialise(several, "several"))
    return materialise(rooted.join(several, "root", "left").select("fp", F.coalesce("least", "first").alias("component_id")), "components")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 5, budget: int = 4) -> DataFrame:
    """One row per input row: key, ``fp`` (signed), ``component_id`` (the smallest key reachable over the links).

    Null, empty and blank texts have fingerprint zero and link like any other; rows with a null key are kept, but a null is
    a component's id only if the component has no other key. Repeated rows stay repeated. Empty tables give no rows.
    """
    rows = materialise(docs.select(F.col(key).alias("id"), fingerprint_column(text, shingle).alias("fp")), "fingerprints")
    classes = materialise(rows.groupBy("fp").agg(F.min("id").alias("first")), "classes")
    return rows.join(named_components(classes, budget), "fp").select(F.col("id").alias(key), "fp", "component_id")


def joint_components(classes: DataFrame, budget: int, several: int) -> DataFrame:
    """(node, root) over classes (``node``, ``fps``) that are near in any of their fingerprints.

    Besides classes there is a node for each fingerprint value that several classes have or that has a link; a class is linked
    to the nodes of its values, and near values of a fingerprint to each other.
    """
    value = lambda i, fp: F.xxhash64(F.lit(i), fp)
    edges = []
    for i in range(several):
        own = classes.select("node", F.element_at("fps", i + 1).alias("fp"))
        values = materialise(own.groupBy("fp").agg(F.count("*").alias("n")), "values")
        links = materialise(near_links(values.select("fp"), budget), "near")
        used = values.filter("n > 1").select("fp").union(links.select("u")).union(links.select("v")).distinct()
        edges.append(links.select(value(i, F.col("u")).alias("u"), value(i, F.col("v")).alias("v")))
        edges.append(own.join(used, "fp").select(F.col("node").alias("u"), value(i, F.col("fp")).alias("v")))
    return components(reduce(DataFrame.union, edges))


def verified_links(docs: DataFrame, classes: DataFrame, budget: int, several: int, text: str, key: str, marks: list, shingle: int, least: float) -> DataFrame:
    """(u, v) of classes (``node``, ``fps``, ``first``) near in any fingerprint whose texts' shingle sets have a Jaccard of ``least``.

    Classes that share a value of a fingerprint are linked to the least of them, which stands for the value; near values of it are
    linked as ``near_links`` says. Only texts of linked classes are hashed again, and sets meet only if their sizes allow.
    """
    own = classes.select("node", F.posexplode("fps").alias("i", "fp"))
    values = materialise(own.groupBy("i", "fp").agg(F.min("node").alias("stands"), F.count("*").alias("n")), "values")
    near = near_links(values.select("i", "fp"), budget, several).distinct()
    name = lambda c: values.select("i", F.col("fp").alias(c), F.col("stands").alias(f"{c}_stands"))
    links = [near.join(name("u"), ["i", "u"]).join(name("v"), ["i", "v"]).select(F.col("u_stands").alias("u"), F.col("v_stands").alias("v"))]
    links.append(own.join(values.filter("n > 1"), ["i", "fp"]).select(F.col("node").alias("u"), F.col("stands").alias("v")))
    both = reduce(DataFrame.union, links).filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    both = materialise(both, "candidates")
    named = materialise(classes.join(both.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "node", "left_semi").select("node", "first.id", "first.h1", "first.h2"), "linked")
    n, h1, h2 = [F.col(f"l_{x}") for x in ("id", "h1", "h2")]
    slim = docs.select(F.col(key).alias("own_id"), marks[0].alias("own_h1"), marks[1].alias("own_h2"), F.col(text).alias("text"))
    firsts = broadcast_few(named.select("node", F.col("id").alias("l_id"), F.col("h1").alias("l_h1"), F.col("h2").alias("l_h2")))
    texts = slim.join(firsts, F.col("own_id").eqNullSafe(n) & (F.col("own_h1") == h1) & (F.col("own_h2") == h2)).dropDuplicates(["node"])
    sets = materialise(texts.select("node", shingle_sets("text", shingle).alias("set")), "sets")
    sizes = sets.select("node", F.size("set").alias("n"))
    size = lambda c: sizes.select(F.col("node").alias(c), F.col("n").alias(f"{c}n"))
    fits = both.join(size("u"), "u").join(size("v"), "v").filter(F.least("un", "vn") >= least * F.greatest("un", "vn"))
    whole = lambda c: sets.select(F.col("node").alias(c), F.col("set").alias(f"{c}s"))
    met = fits.join(whole("u"), "u").join(whole("v"), "v").withColumn("shared", F.size(F.array_intersect("us", "vs")))
    alike = (F.col("un") + F.col("vn") == 0) | (F.col("shared") >= least * (F.col("un") + F.col("vn") - F.col("shared")))
    return met.filter(alike).select("u", "v")


def one_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 5, budget: int = 4, several: int = 1, least: float | None = None) -> DataFrame:
    """The documents without near-duplicates: of each component the smallest row, all columns kept.

    Texts are near if any of their ``several`` fingerprints are, each of which is another draw of the same similarity, so more
    of them find more of the near copies. With ``least`` a link counts only if the texts' sets of shingles have that Jaccard
    similarity: links are taken over the nearest fingerprints, and texts that only the unlike connect stay apart. Rows are told apart by key and text, so rows that share a key, or have none, are near
    copies only if their texts are. Rows are ordered by key, those without one last, then by hashes of the text; of rows with
    the same key and text one stays. Null, empty and blank texts are copies of each other; an empty table gives no rows; the
    operator's own columns take names that the table does not have.
    """
    marks = [F.coalesce(F.xxhash64(text), F.lit(0)), F.coalesce(F.xxhash64(F.lit(1), text), F.lit(0))]
    hashed = docs.select(F.col(key).alias("id"), several_fingerprints(text, shingle, several).alias("fps"), marks[0].alias("h1"), marks[1].alias("h2"))
    rows = materialise(hashed, "fingerprints").groupBy("fps", "id", "h1", "h2").agg(F.count("*").alias("copies"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h1", "h2", "copies"))
    classes = materialise(rows.groupBy("fps").agg(first.alias("first")).withColumn("node", F.xxhash64(F.lit("class"), "fps")), "classes")
    roots = joint_components(classes, budget, several) if least is None else components(verified_links(docs, classes, budget, several, text, key, marks, shingle, least))
    rooted = classes.join(roots, "node", "left").select(F.coalesce("root", "node").alias("root"), "first")
    keep = materialise(rooted.groupBy("root").agg(F.min("first").alias("first")).select("first.*").drop("none"), "keep")
    n, h1, h2, copies = [fresh(docs, c) for c in ("keep_id", "h1", "h2", "copies")]
    t1, t2 = fresh(docs, "text_h1"), fresh(docs, "text_h2")
    keep = keep.withColumnsRenamed({"id": n, "h1": h1, "h2": h2, "copies": copies})
    told = docs.withColumns({t1: marks[0], t2: marks[1]})
    same = F.col(key).eqNullSafe(F.col(n)) & (F.col(t1) == F.col(h1)) & (F.col(t2) == F.col(h2))
    kept = told.join(broadcast_few(keep), same, "inner").drop(n, h1, h2)
    single = kept.filter(F.col(copies) == 1).drop(t1, t2, copies)
    if keep.filter(F.col(copies) > 1).isEmpty():
        return single
    repeated = kept.filter(F.col(copies) > 1).dropDuplicates([key, t1, t2])
    return single.unionByName(repeated.drop(t1, t2, copies))
