"""SimHash near-duplicates: 64-bit fingerprints, linked within a radius by BK-trees.

Fingerprints at 3 differing bits or fewer agree in one of four blocks of 16 bits, so each distinct fingerprint is dealt to four shards, by block and value. A
shard with more than ``limit`` members is dealt again by the bits it doesn't share, in four blocks of 12, and once more in blocks of 9: such members
still agree in one block of what is left. A shard is one BK-tree: a child hangs on its parent by their distance, and a search follows only the edges
within the radius of its own distance. The few shards that remain large are several trees of about ``limit`` members each; those trees are broadcast to
the shard's members if their counted size allows it, and else meet them in a join by shard. Of what is found in a tree, a spanning set of links goes on:
it has the same classes.

Trees of all shards in a batch are built and searched together, a level at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from .components import components
from .work import drop, read_table, row_count, small, stored

SEED = 42
#: Bits of the blocks of one level; four of them are what the level before left.
WIDTHS = (16, 12, 9)
_ONES = np.uint64(0x0101010101010101)


def fingerprint(text: str | None, width: int = 3) -> int:
    """A bit is 1 if it is set in over half of the shingles' hashes. 0 without words; with fewer than ``width``, the whole sequence is the one shingle."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    data = b" ".join(words)
    count = len(words) - width + 1
    if count <= 1:
        return xxhash.xxh64_intdigest(data, SEED)
    space = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
    begin, end = np.r_[0, space + 1][:count], np.r_[space, len(data)][width - 1 :]
    total = np.zeros(64, np.int64)
    for at in range(0, count, 1 << 16):
        pairs = zip(begin[at : at + (1 << 16)].tolist(), end[at : at + (1 << 16)].tolist())
        h = np.frombuffer(b"".join([xxhash.xxh64_digest(data[i:j], SEED) for i, j in pairs]), ">u8").astype("<u8")
        rows = np.arange(0, len(h), 255)
        for j in range(8):  # eight counters of a byte each in a word, over as many rows as they can hold
            lanes = np.add.reduceat((h >> np.uint64(j)) & _ONES, rows)
            total[j::8] += lanes.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > count, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, fp) of each row, ``fp`` as a signed number; stored."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), width) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["doc_id", "fp"])

    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return stored(slim.mapInArrow(run, f"doc_id {kind}, fp long"), "fingerprints")


def shards(nodes: DataFrame, limit: int) -> tuple[DataFrame, DataFrame | None]:
    """(shards (shard, nodes) with two to ``limit`` members, parts (shard, lot, nodes) of those that stay larger) for distinct ``fp``.

    Together they hold every pair that agrees in a block, some more than once.
    """
    whole: DataFrame | None = None
    rows = nodes.select("fp", F.col("fp").alias("rest"), F.lit(1).cast("long").alias("shard"))
    for width in WIDTHS:
        mask = (1 << width) - 1

        def block(t: int, width: int = width, mask: int = mask):
            upper = F.shiftrightunsigned("rest", t * width)
            value = upper.bitwiseAND(F.lit(mask))
            low = F.col("rest").bitwiseAND(F.lit((1 << t * width) - 1))
            left = F.shiftleft(F.shiftrightunsigned(upper, width), t * width).bitwiseOR(low)
            return F.struct(((F.col("shard") * 4 + t) * (mask + 1) + value).alias("shard"), left.alias("rest"))

        dealt = rows.select("fp", F.inline(F.array(*[block(t) for t in range(4)])))
        sizes = dealt.groupBy("shard").count()
        hot = stored(sizes.filter(F.col("count") > limit), "hot-shards")  # one in ``limit`` rows at most
        cool = dealt.join(small(hot, "shard"), "shard", "left_anti") if row_count(hot) else dealt
        groups = cool.groupBy("shard").agg(F.collect_list("fp").alias("nodes")).filter(F.size("nodes") > 1)
        whole = groups if whole is None else whole.unionByName(groups)
        if not row_count(hot):
            return whole, None
        rows = stored(dealt.join(small(hot, "shard"), "shard"), "hot-members")
    lots = rows.withColumn("lot", F.pmod(F.xxhash64("fp"), F.ceil(F.col("count") / limit)))
    return whole, lots.groupBy("shard", "lot").agg(F.collect_list("fp").alias("nodes"))


def forest(node: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(parent, edge) of each node in its BK-tree; ``start``: where the nodes of each tree begin. The first is the root, without parent (-1)."""
    size = np.diff(np.r_[start, len(node)])
    parent, edge = np.full(len(node), -1), np.zeros(len(node), np.int16)
    at = np.repeat(start, size)
    todo = np.setdiff1d(np.arange(len(node)), start, assume_unique=True)
    while len(todo):
        apart = np.bitwise_count(node[todo] ^ node[at[todo]]).astype(np.int64)
        _, first, of = np.unique(at[todo] * 65 + apart, return_index=True, return_inverse=True)
        child = todo[first]  # the first with that distance becomes the child, the others go down to it
        parent[child], edge[child] = at[child], apart[first]
        at[todo] = child[of]
        todo = todo[child[of] != todo]
    return parent, edge


def within(node: np.ndarray, parent: np.ndarray, edge: np.ndarray, asked: np.ndarray, root: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, node): what lies within the radius of each query, in the tree with its ``root``."""
    kids = np.argsort(parent, kind="stable")
    kids = kids[np.searchsorted(parent[kids], 0) :]
    begin = np.searchsorted(parent[kids], np.arange(len(node) + 1))
    found = []
    query, here = np.arange(len(asked)), root
    while len(query):
        apart = np.bitwise_count(asked[query] ^ node[here]).astype(np.int64)
        hit = apart <= radius
        found.append(np.stack([query[hit], here[hit]]))
        n = begin[here + 1] - begin[here]
        of = np.repeat(np.arange(len(query)), n)
        child = kids[np.arange(len(of)) + np.repeat(begin[here] - (np.cumsum(n) - n), n)]
        near = np.abs(edge[child] - apart[of]) <= radius
        query, here = query[of[near]], child[near]
    pairs = np.concatenate(found, axis=1) if found else np.empty((2, 0), np.int64)
    return pairs[0], pairs[1]


def spanning(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest member of each of n members' class."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def tree_links(node: np.ndarray, start: np.ndarray, radius: int, room: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the classes within each tree, every node being searched for in its own. ``room``: comparisons that are held at once."""
    parent, edge = forest(node, start)
    size = np.diff(np.r_[start, len(node)])
    root = np.repeat(start, size)
    label = np.arange(len(node))
    for part in _chunks(np.repeat(size, size), room):
        q, hit = within(node, parent, edge, node[part], root[part], radius)
        label = label[spanning(label[q + part.start], label[hit], len(node))] if len(q) else label
    label = spanning(np.arange(len(node)), label, len(node))
    far = np.flatnonzero(label != np.arange(len(node)))
    return node[far], node[label[far]]


def _chunks(cost: np.ndarray, room: int) -> Iterator[slice]:
    lot = np.cumsum(cost) // room
    cut = np.r_[0, np.flatnonzero(np.diff(lot)) + 1, len(cost)]
    for a, b in zip(cut, cut[1:]):
        if b > a:
            yield slice(int(a), int(b))


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(all values, where each row's begin)."""
    n = column.value_lengths().to_numpy()
    return column.flatten().to_numpy(), np.cumsum(n) - n


def _links(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])


def shard_links(groups: DataFrame, radius: int) -> DataFrame:
    """(a, b) for shards that are a tree each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                node, start = _lists(whole.column(0).slice(at, 2048))
                if len(node):
                    yield _links(*tree_links(node.view(np.uint64), start, radius))

    return groups.select("nodes").mapInArrow(run, "a long, b long")


def part_links(parts: DataFrame, radius: int, limit: int) -> DataFrame:
    """(a, b) for the parts of large shards: each part is a tree, built once, which the members of the shard's parts up to its own are searched in."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                node, start = _lists(row.column(2))
                parent, edge = forest(node.view(np.uint64), start)
                lists = [pa.array([x.tolist()], pa.list_(t)) for x, t in ((parent, pa.int32()), (edge, pa.int16()))]
                yield pa.RecordBatch.from_arrays([*row.columns, *lists], ["shard", "lot", "nodes", "parent", "edge"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                asked, node, parent, edge = (batch.column(k).slice(at, 1).flatten().to_numpy() for k in range(4))
                asked, node = asked.view(np.uint64), node.view(np.uint64)
                every, of = np.unique(np.r_[asked, node], return_inverse=True)
                label = np.arange(len(every))
                for part in _chunks(np.full(len(asked), len(node)), 1 << 21):
                    q, hit = within(node, parent.astype(np.int64), edge, asked[part], np.zeros(part.stop - part.start, np.int64), radius)
                    label = label[spanning(label[of[q + part.start]], label[of[len(asked) + hit]], len(every))]
                label = spanning(np.arange(len(every)), label, len(every))
                far = np.flatnonzero(label != np.arange(len(every)))
                yield _links(every[far], every[label[far]])

    trees = stored(parts.select("shard", "lot", "nodes").mapInArrow(build, "shard long, lot long, nodes array<long>, parent array<int>, edge array<short>"), "shard-trees")
    asked = trees.select("shard", F.col("lot").alias("part"), F.col("nodes").alias("asked"))
    # a part has about ``limit`` members by its hash, at 14 bytes each; twice that is taken here
    cells = asked.join(small(trees, extra=28 * limit), "shard").filter("lot >= part")
    return cells.select("asked", "nodes", "parent", "edge").mapInArrow(run, "a long, b long")


def simhash_dedup(docs: DataFrame, width: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """(doc_id, fp, component_id), one row per input row; ``component_id`` is the smallest id reachable over fingerprints at ``radius`` differing bits or fewer,
    which is 3 at most.

    Words are of anything but ASCII blanks, A-Z lower-cased; shingles count as often as they stand. Null, empty and blank texts have fingerprint 0 and are
    linked like any other. Equal fingerprints are one node, so repeated rows and ids are no special case: each row has the class of its own text. A row without
    id has a class, but is nobody's smallest id; a class of such rows alone has none. Other columns are ignored; an empty table gives an empty result.
    """
    if not 0 <= radius <= 3:
        raise ValueError("four blocks find up to 3 differing bits")
    prints = fingerprints(docs, width, id_col, text_col)
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows")), "fingerprint-nodes")
    whole, parts = shards(nodes, limit)
    found = shard_links(whole, radius)
    if parts is not None:
        found = found.unionByName(part_links(parts, radius, limit))
    labels = components(found)
    classed = nodes.join(labels.select(F.col("node").alias("fp"), "label"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    least = classed.groupBy("label").agg(F.min("first").alias("component_id"))
    named = stored(classed.join(least, "label").select("fp", "rows", "component_id"), "fingerprint-classes")
    # at most 1000 fingerprints have more than a thousandth of the rows: those are broadcast, and the other join has no heavy key
    heavy = row_count(prints) // 1000
    hot = F.broadcast(named.filter(F.col("rows") > heavy).select("fp", F.col("component_id").alias("own"), F.lit(True).alias("hot")))
    marked = prints.join(hot, "fp", "left")
    warm = marked.filter("hot is null").select("doc_id", "fp").join(named.filter(F.col("rows") <= heavy).select("fp", "component_id"), "fp")
    return warm.select("doc_id", "fp", "component_id").unionByName(marked.filter("hot").select("doc_id", "fp", F.col("own").alias("component_id")))


def op11_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
