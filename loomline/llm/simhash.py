"""SimHash near-duplicates with BK-trees.

Distinct fingerprints are cut into ``PARTS`` parts of bits. Two that differ in at most ``RADIUS`` bits agree on all but RADIUS
of the parts, so each choice of PARTS - RADIUS parts makes a table of shards in which every close pair meets in at least
one. A shard's BK-tree (children keyed by their integer distance to the parent) is searched by its own fingerprints along
edges within the radius only. What a shard yields is a spanning forest of its links, so its output has fewer rows
than its input. A shard over ``SHARD`` fingerprints is cut again in the same way by the bits it doesn't agree on: 32 are left
after the first cut, 16 after the second and 8 after the third, when no shard has over 256. Splits of a shard never meet pair by pair. Trees
go to tasks with their shard rather than to all tasks: all trees together grow with the corpus, so no bound for a broadcast can be proven.

Components come from star contraction over the links (pre-aggregated minima, then a join), and the table is cut from its
lineage each round. Nothing of a document's size or number is collected.

Nulls and empty texts have the fingerprint zero, which links like any other. Repeated rows have equal fingerprints and
keep a row each. An empty table gives an empty table. Whole texts are read, however long. Extra columns are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomline.llm.common import bounded_batches, col, discard, free, out_batch, slices, stored

BITS, RADIUS, PARTS, SHARD, LEVELS, SEED = 64, 2, 4, 4096, 3, 42
#: Trees of fewer fingerprints are built node by node; larger ones level by level with numpy.
SMALL = 48


def fingerprint(text: bytes, size: int = 3) -> int:
    words = text.lower().split()  # bytes: only A-Z, and only ASCII white space
    if not words:
        return 0
    joined = b" ".join(words)
    n = len(words)
    if n <= size:
        grams = [joined]
    else:
        ends = np.cumsum([len(w) + 1 for w in words]).tolist()
        grams = [joined[a:b] for a, b in zip([0, *ends[: n - size]], [e - 1 for e in ends[size - 1 :]])]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(g, SEED) for g in grams], "<u8")
    ones = np.zeros(BITS, "i8")
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype="i8")
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
    for batch in batches:
        for part, data in slices(batch, "text"):
            found = np.array([fingerprint(x) for x in data], "u8").view("i8")
            yield out_batch(schema, (part.column("doc_id"), found))


class BKTree:
    """A BK-tree over 64-bit fingerprints: node = (value, {distance: child})."""

    def __init__(self):
        self.root = None

    def add(self, value: int) -> None:
        if self.root is None:
            self.root = (value, {})
            return
        node = self.root
        while True:
            d = (node[0] ^ value).bit_count()
            if d == 0:
                return
            if d not in node[1]:
                node[1][d] = (value, {})
                return
            node = node[1][d]

    def within(self, value: int, radius: int) -> list[int]:
        found, todo = [], [self.root] if self.root else []
        while todo:
            own, children = todo.pop()
            d = (own ^ value).bit_count()
            if d <= radius:
                found.append(own)
            todo += [children[e] for e in range(max(1, d - radius), d + radius + 1) if e in children]
        return found


def bulk_links(tree: np.ndarray, queries: np.ndarray, radius: int, joined) -> None:
    """The BK-tree over tree, built and searched level by level: joined(node, close queries) for each node.

    A node's subtree for edge e holds what lies e from it; queries go down an edge if theirs differs by at most radius.
    """
    todo = [(tree, queries)]
    while todo:
        own, asked = todo.pop()
        node, rest = own[0], own[1:]
        d = np.bitwise_count(asked ^ node)
        close = asked[d <= radius]
        if len(close):
            joined(node, close)
        if not len(rest):
            continue
        edges = np.bitwise_count(rest ^ node)
        for e in np.unique(edges):
            down = asked[np.abs(d.astype("i2") - int(e)) <= radius]
            if len(down):
                todo.append((rest[edges == e], down))


class Forest:
    """Union-find over fingerprints that keeps the links that joined two sets."""

    def __init__(self):
        self.up: dict[int, int] = {}
        self.links: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    def join(self, a: int, b: int) -> None:
        x, y = self.root(a), self.root(b)
        if x != y:
            self.up[max(x, y)] = min(x, y)
            self.links.append((a, b))


def shard_links(own: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """A spanning forest of the links within a shard's distinct fingerprints."""
    forest = Forest()
    if len(own) < SMALL:
        tree = BKTree()
        for x in own.tolist():
            for y in tree.within(x, radius):
                forest.join(y, x)
            tree.add(x)
    else:

        def joined(node, close):
            for q in close.tolist():
                if q != node:
                    forest.join(int(node), q)

        bulk_links(own, own, radius, joined)
    return forest.links


def _search(radius: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def search(batches):
        """Rows come sorted by shard (mask, key); a shard is searched when the next begins."""
        held: list[np.ndarray] = []

        def links(rows: np.ndarray):
            same = np.flatnonzero(np.any(rows[1:, :2] != rows[:-1, :2], axis=1)) + 1
            for lo, hi in zip([0, *same], [*same, len(rows)]):
                if hi - lo > 1:
                    yield from shard_links(rows[lo:hi, 2].view("u8"), radius)

        def batch_of(found):
            pairs = np.array(list(found), "u8").reshape(-1, 2).view("i8")
            return out_batch(schema, (pairs[:, 0], pairs[:, 1]))

        for batch in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False).astype("i8") for c in batch.columns], axis=1)
            if not len(rows):
                continue
            held.append(rows)
            last = rows[-1, :2]
            if (rows[0, :2] == last).all():
                continue
            rows = np.concatenate(held)
            cut = int(np.flatnonzero(np.any(rows[:, :2] != last, axis=1))[-1]) + 1
            held = [rows[cut:].copy()]
            yield batch_of(links(rows[:cut]))
        if held:
            yield batch_of(links(np.concatenate(held)))

    return search


def agreed_bits(mask: int, radius: int = RADIUS, parts: int = PARTS) -> list[int]:
    """The masks by which a shard whose fingerprints agree on the bits of mask is cut: those bits and all but radius parts of the rest."""
    rest = [b for b in range(BITS) if not mask >> b & 1]
    edges = [len(rest) * p // parts for p in range(parts + 1)]
    own = [sum(1 << b for b in rest[lo:hi]) for lo, hi in zip(edges, edges[1:])]
    return [mask | sum(chosen) for chosen in combinations(own, parts - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def close_pairs(fingerprints: DataFrame, radius: int = RADIUS, parts: int = PARTS, shard: int = SHARD) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints (column fp) within radius of each other; not all pairs.

    A shard over ``shard`` fingerprints is cut again by the bits that it doesn't agree on yet, up to ``LEVELS`` times.
    """
    long = lambda x: F.lit(_signed(x)).cast("long")
    found, rows, masks = None, fingerprints.select("fp", long(0).alias("mask")), [0]
    for level in range(1, LEVELS + 1):
        finer = {m: agreed_bits(m, radius, parts) for m in masks}
        cuts = F.create_map(*(x for m, own in finer.items() for x in (long(m), F.array(*map(long, own)))))
        dealt = rows.select("fp", F.explode(cuts[F.col("mask")]).alias("mask")).withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        sizes = dealt.groupBy("mask", "key").agg(F.count("*").alias("n")).filter("n > 1")
        met = dealt.join(sizes, ["mask", "key"])
        if level < LEVELS:
            met = stored(met, "shards")
        whole = met if level == LEVELS else met.filter(F.col("n") <= shard)
        own = whole.select("mask", "key", "fp").repartition("mask", "key").sortWithinPartitions("mask", "key", "fp")
        links = own.mapInArrow(_search(radius), "a bigint, b bigint")
        found = links if found is None else found.union(links)
        rows = met.filter(F.col("n") > shard).select("fp", "mask")
        if level == LEVELS or rows.isEmpty():
            return found
        masks = [f for own in finer.values() for f in own]


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of links (a, b): alternate large and small stars until no edge moves."""
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")
    before = None
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = stored(large, "links")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        after = stored(small.filter("u <> v").distinct(), "links")
        discard(edges)
        discard(large)
        edges = after
        seen = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if seen == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = seen


def one_row_each(docs: DataFrame) -> DataFrame:
    """The rows of docs, of those that repeat a doc_id only the one whose text has the smallest hash."""
    nth = free(docs, "nth")
    numbered = docs.withColumn(nth, F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text"))))
    return numbered.filter(col(nth) == 1).drop(col(nth))


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp (signed), component_id: the smallest doc_id that links reach, for each row of docs (doc_id, text)."""
    bounded_batches(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long"), "text")
    prints = stored(source.mapInArrow(_fingerprints, "doc_id bigint, fp bigint"), "prints")
    firsts = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "firsts")
    links = components(close_pairs(firsts.select("fp"), radius))
    roots = links.withColumnRenamed("node", "fp")
    rooted = firsts.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    per_print = stored(rooted.join(ids, "root", "left").select("fp", "component_id"), "component")
    discard(firsts, links)
    return prints.join(per_print, "fp", "left").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of their component; of rows that repeat a doc_id, one.

    A row without doc_id can't be named as a copy of another and stays.
    """
    unnamed, docs = docs.filter("doc_id is null"), docs.filter("doc_id is not null")
    found = near_duplicates(docs, radius)
    stay = found.filter(F.col("component_id") == F.col("doc_id")).select(F.col("doc_id").alias("stays")).distinct()
    return one_row_each(docs.join(stay, F.col("doc_id") == F.col("stays"), "left_semi")).union(unnamed)
