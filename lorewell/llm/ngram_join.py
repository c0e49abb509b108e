"""N-gram Jaccard join with adaptive multi-match prefixes; classes of linked documents.

Two sets of shingles link when den * |x & y| >= num * |x | y|. Then they share at least T(n) = ceil(num * n / den) shingles for either size n. In
one order of all shingles, rare ones first, the prefix of the first n - T(n) + m shingles of both sets shares at least m shingles. Each document picks
its own m: a longer prefix means more postings, but a candidate needs more shared prefix shingles before it is verified, so the m with the least
estimated cost is taken, from a sketch of how many documents hold each shingle (all documents counted). What a
pair shares beyond the shorter prefix is bounded by what is left of its set, so a pair is a candidate only if its shared prefix shingles and that
rest reach the overlap that its sizes ask for.

Sizes. Equal sets are one node from the start. Shingles that one node alone holds are dropped by an aggregation, which also names a hub for every other
list: its node with the smallest digest. A first round verifies for each node only the hub it shares most prefix shingles with and joins what links;
lists that are of one class then drop out. The last round looks at all pairs of nodes of different classes in the remaining lists. Nodes of long lists are
dealt into blocks of about ``block`` nodes and ``block_tokens`` shingles, and a task compares two blocks at a time. A pair stays if its sizes allow a link
and so do two parity sketches of 1024 bits, whose distance is a lower bound of a symmetric difference, so both are exact: one of the sets, one of what is left
of the prefixes. Pairs are never rows: a cell of two blocks gives its nodes that are in pairs, each with the part of the cell that it is joined to by pairs, so at most one
row for each that it read. The sets of a part then meet, all overlaps are counted there, and the part gives one link for each node at most.
Both verifications read the texts of the nodes in pairs only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .components import components
from .shingles import mix, shingle_sets
from .work import drop, read_table, row_count, shuffle_count, small, stored

SLICE = 1 << 14
MOST_CLASHES = 1 << 16
SLICE_TOKENS = 1 << 20
SIGNATURE_BITS = 1024


@dataclass(frozen=True)
class Rule:
    width: int = 5
    num: int = 80
    den: int = 100
    most_matches: int = 4
    sketch_bits: int = 20
    #: Nodes in a block, and shingles of their sets in all, about; bytes of the matrix of nodes and lists that a task holds at once.
    block: int = 1024
    block_tokens: int = 1 << 23
    matrix_bytes: int = 1 << 24
    #: Cost of verifying a candidate, in postings.
    verify_cost: float = 20.0
    #: Bits of the digest that names a set, unless another set has the same.
    digest_bits: int = 64

    def need(self, n):
        """Shingles that a set of n shares with any set it links to, at least."""
        return -(-self.num * n // self.den)

    def enough(self, hits: Column, n_a: Column, m_a: Column, n_b: Column, m_b: Column) -> Column:
        """Can two sets link that share so many prefix shingles? What they share beyond is in the rest of one of them, which is need(n) - m long; in all they
        must share num / (num + den) of their sizes' sum."""
        need = lambda n: F.ceil(F.lit(self.num) * n / self.den)
        all_ = F.ceil(F.lit(self.num) * (n_a + n_b) / (self.num + self.den))
        return hits + F.greatest(need(n_a) - m_a, need(n_b) - m_b) >= all_


def _batches(batches: Iterator[pa.RecordBatch], rule: Rule):
    for batch in batches:
        ids = batch.column("doc_id").to_pylist()
        yield from zip(ids, shingle_sets(batch.column("text").to_pylist(), rule.width))


def _digest(s: np.ndarray, rule: Rule) -> tuple[int, int]:
    """Two digests of a set; with its size they tell it from all others."""
    m = mix(s + np.uint64(0x51ED270B))
    first = m.sum(dtype=np.uint64) >> np.uint64(64 - rule.digest_bits)
    return int(first.astype(np.int64)), int(np.bitwise_xor.reduce(mix(m)).astype(np.int64)) if len(m) else 0


def _node(digest: tuple[int, int], clashes: frozenset[int]) -> int:
    """The number of a set: its first digest, or, where other sets have that too, its second."""
    return digest[1] if digest[0] in clashes else digest[0]


def _signature(s: np.ndarray) -> bytes:
    return np.packbits(np.bincount((s >> np.uint64(7)).astype(np.int64) & (SIGNATURE_BITS - 1), minlength=SIGNATURE_BITS).astype(np.uint8) & 1).tobytes()


def describe(docs: DataFrame, rule: Rule) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, n, d1, d2, sig) of each document, and the sketch: how many documents hold a shingle of each hash cell."""
    cells = 1 << rule.sketch_bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n", "d1", "d2", "sig", "slice", "lot", "counts", "is_doc"]
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.bool_())
        counts, rows = np.zeros(cells, np.int64), []
        pending: list[np.ndarray] = []

        def out(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        for doc, s in _batches(batches, rule):
            rows.append((doc, len(s), *_digest(s, rule), _signature(s), None, None, None, True))
            pending.append(s)
            if len(rows) >= 4096:
                counts += np.bincount(_cell(np.concatenate(pending), rule), minlength=cells)
                yield out(rows)
                rows, pending = [], []
        if rows:
            counts += np.bincount(_cell(np.concatenate(pending), rule), minlength=cells)
            yield out(rows)
        if counts.any():
            lot = TaskContext.get().partitionId() % 256
            for k in range(0, cells, SLICE):
                yield out([(None, None, None, None, None, k // SLICE, lot, counts[k : k + SLICE].astype("<i4").tobytes(), False)])

    schema = "doc_id long, n long, d1 long, d2 long, sig binary, slice int, lot int, counts binary, is_doc boolean"
    both = stored(docs.mapInArrow(run, schema), "shingle-sets", partition_by="is_doc")

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, "<i4").astype(np.int64) if len(x) == 4 * SLICE else np.frombuffer(x, "<i8") for x in pdf["counts"])
        return pd.DataFrame({"slice": pdf["slice"].iloc[:1].to_numpy(), "counts": [total.tobytes()]})

    lots = both.filter("not is_doc").select("slice", "lot", "counts").groupBy("slice", "lot").applyInPandas(add, "slice int, counts binary")
    sketch = np.zeros(cells, np.int64)
    for r in lots.groupBy("slice").applyInPandas(add, "slice int, counts binary").collect():  # as many rows as slices: the sketch has one size
        sketch[r["slice"] * SLICE : (r["slice"] + 1) * SLICE] = np.frombuffer(r["counts"], "<i8")
    return both.filter("is_doc").select("doc_id", "n", "d1", "d2", "sig"), sketch


def set_nodes(described: DataFrame) -> tuple[DataFrame, frozenset[int]]:
    """(d1, d2, n, node, first, sig) of each distinct set that is not empty, ``first`` being the smallest id that has it (null if no row with it has an id), and the
    first digests that several sets share. Those are few, by the width of a digest: 3 among 10**10 sets."""
    sets = stored(described.filter("n > 0").groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("first"), F.any_value("sig").alias("sig")), "sets")
    shared = sets.groupBy("d1").agg(F.count("*").alias("sets")).filter("sets > 1").select("d1")
    clashes = frozenset(r["d1"] for r in shared.limit(MOST_CLASHES + 1).collect())
    if len(clashes) > MOST_CLASHES:
        raise ValueError("digests clash far more often than their width allows")
    node = F.when(F.col("d1").isin(sorted(clashes)), F.col("d2")).otherwise(F.col("d1")) if clashes else F.col("d1")
    nodes = sets.withColumn("node", node)
    if clashes and row_count(sets) > nodes.select("node").distinct().count():
        raise ValueError("two sets share both digests")
    return nodes, clashes


def _cell(s: np.ndarray, rule: Rule) -> np.ndarray:
    return (s >> np.uint64(64 - rule.sketch_bits)).astype(np.int64)


def choose_prefix(s: np.ndarray, sketch: np.ndarray, common: float, rule: Rule) -> tuple[np.ndarray, int]:
    """The prefix of a set in the global order and the matches it asks for. Cells no fuller than ``common`` count as rare; there the hash decides."""
    count = sketch[_cell(s, rule)]
    level = np.where(count > common, count, 0)
    order = np.lexsort((s, level))
    n, need = len(s), rule.need(len(s))
    others = np.cumsum(np.where(level > 0, level, 0)[order])  # documents met in the lists of common shingles
    best, cost = 1, np.inf
    for m in range(1, min(rule.most_matches, need) + 1):
        p = n - need + m
        c = p + others[p - 1] * (1 + rule.verify_cost / m**2)
        if c < cost:
            best, cost = m, c
    return s[order[: n - need + best]], best


def postings(docs: DataFrame, sketch: np.ndarray, clashes: frozenset[int], rule: Rule) -> DataFrame:
    """(token, node, n, m): the prefix of each set, with its number, size and m; equal sets of one partition emit theirs once."""
    mean = float(sketch.mean())
    shared = docs.sparkSession.sparkContext.broadcast(sketch)  # 2**sketch_bits counts, whatever the input
    common = mean + 5 * mean**0.5 + 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = shared.value, set()
        tokens, rows = [], []

        def out() -> pa.RecordBatch:
            n = [len(t) for t in tokens]
            node, size, m = (np.repeat(np.array(c, np.int64), n) for c in zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(node), pa.array(size.astype(np.int32)), pa.array(m.astype(np.int32))], ["token", "node", "n", "m"])

        for _, s in _batches(batches, rule):
            if not len(s) or (d := _node(_digest(s, rule), clashes)) in seen:
                continue
            if len(seen) < 1_000_000:  # the set only saves work
                seen.add(d)
            prefix, m = choose_prefix(s, counts, common, rule)
            tokens.append(prefix)
            rows.append((d, len(s), m))
            if len(rows) >= 2048:
                yield out()
                tokens, rows = [], []
        if rows:
            yield out()

    return docs.mapInArrow(run, "token long, node long, n int, m int")


def lists_by_head(mixed: DataFrame) -> DataFrame:
    """(hub, node, tokens, n, m, label), stored: the lists of one first node that a node is in."""
    return stored(mixed.groupBy(F.col("head").alias("hub"), "node").agg(F.collect_list("token").alias("tokens"), *[F.any_value(c).alias(c) for c in ("n", "m", "label")]), "lists-by-hub")


def prefix_sketches(mixed: DataFrame) -> DataFrame:
    """(node, total, parity): in how many lists a node is, and the parity sketch of their shingles in words of 64 bits."""
    words = [F.expr(f"bit_xor(if((token >> 6) & {SIGNATURE_BITS // 64 - 1} = {k}, shiftleft(1L, cast(token & 63 as int)), 0L))") for k in range(SIGNATURE_BITS // 64)]
    return mixed.groupBy("node").agg(F.count("*").cast("int").alias("total"), F.array(*words).alias("parity"))


def shared_lists(tokens: list[np.ndarray], left: np.ndarray, right: np.ndarray, rule: Rule) -> np.ndarray | None:
    """How many shingles each set of ``left`` shares with each of ``right``, a few shingles at a time; None if no shingle is in two sets."""
    row = np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])
    _, held, nodes = np.unique(np.concatenate(tokens), return_inverse=True, return_counts=True)
    held = held.reshape(-1)
    many = nodes > 1
    if not many.any():
        return None
    row, held = row[many[held]], (np.cumsum(many) - 1)[held[many[held]]]
    n_lists, width = int(many.sum()), max(1, rule.matrix_bytes // (4 * len(tokens)))
    if n_lists > width:
        order = np.argsort(held, kind="stable")
        row, held = row[order], held[order]
    shared = np.zeros((len(left), len(right)))
    for at in range(0, n_lists, width):
        a, b = np.searchsorted(held, (at, at + width)) if n_lists > width else (0, len(held))
        holds = np.zeros((len(tokens), min(width, n_lists - at)), np.float32)
        holds[row[a:b], held[a:b] - at] = 1
        shared += holds[left] @ holds[right].T
    return shared


def overlaps(sets: list[np.ndarray], rule: Rule) -> np.ndarray:
    """The sizes of the intersections of sorted sets, above the diagonal, a range of shingles at a time. Shingles that few sets have are counted pair by pair,
    since a product of matrices costs the same for each shingle."""
    every, few = np.arange(len(sets)), len(sets) // 16
    slices = -(-sum(len(s) for s in sets) // SLICE_TOKENS)
    ends = np.array([(k << 64) // slices for k in range(1, slices)], np.uint64)
    cuts = [np.r_[0, np.searchsorted(s, ends), len(s)] for s in sets]
    out = np.zeros((len(sets), len(sets)))
    for k in range(slices):
        some = [s[c[k] : c[k + 1]] for s, c in zip(sets, cuts)]
        sizes = [len(s) for s in some]
        token = np.concatenate(some)
        order = np.argsort(token, kind="stable")
        row, token = np.repeat(every, sizes)[order], token[order]
        held = np.diff(np.r_[np.flatnonzero(np.r_[True, token[1:] != token[:-1]]), len(token)]) if len(token) else np.empty(0, np.int64)
        holders = np.repeat(held, held)
        rare = (holders > 1) & (holders <= few)
        row, token = row[rare], token[rare]
        for d in range(1, few):
            same = np.flatnonzero(token[d:] == token[:-d])
            if not len(same):
                break
            np.add.at(out, (row[same], row[same + d]), 1)
        often = np.zeros(len(order), bool)
        often[order] = holders > max(few, 1)
        common = shared_lists([s[o] for s, o in zip(some, np.split(often, np.cumsum(sizes)[:-1]))], every, every, rule)
        if common is not None:
            out += common
    return out


def _reach(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The smallest of n indexes that each reaches over the pairs x, y."""
    low = np.arange(n)
    while True:
        new = low.copy()
        np.minimum.at(new, x, low[y])
        np.minimum.at(new, y, low[x])
        new = new[new]
        if (new == low).all():
            return low
        low = new


def list_parts(lists: DataFrame, sketches: DataFrame, rule: Rule) -> DataFrame:
    """(part, node): the nodes that may link with a node of another class in one list, as size and ``sketches`` (node, sig, total, parity) allow. Two that may
    link are in one part.

    Lists with the same first node are taken together; their shingles are all in that node's prefix. Nodes are dealt into cells of two blocks (bi, bj). A
    part is what pairs of a cell join, and is named by its nodes, so that it comes once if several cells have it. If two parts had one name, they would be one.
    """
    fields = "hub long, bi int, bj int, block int, node long, n int, m int, label long, sig binary, total int, parity array<long>, tokens array<long>"
    names = [f.split()[0] for f in fields.split(", ")]
    words = SIGNATURE_BITS // 64

    def apart(sketch: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bitwise_count(sketch[a[k : k + 8192]] ^ sketch[b[k : k + 8192]]).sum(axis=1, dtype=np.int64) for k in range(0, max(len(a), 1), 8192)])

    def pairs(run: dict[str, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The pairs of one cell, a few nodes' at a time."""
        label = run["label"]
        if label.min() == label.max():
            return
        split = run["bi"][0] != run["bj"][0]
        left = np.flatnonzero(run["block"] == run["bi"][0])
        right = np.flatnonzero(run["block"] == run["bj"][0]) if split else left
        shared = shared_lists(run["tokens"], left, right, rule)
        n, m, total = (run[k].astype(np.int64) for k in ("n", "m", "total"))
        elsewhere, beyond = total - np.array([len(t) for t in run["tokens"]]), rule.need(n) - m
        for at in range(0, len(left) if shared is not None else 0, 64):
            i = left[at : at + 64]
            ni, nj = n[i][:, None], n[right][None, :]
            hits = shared[at : at + 64]
            ok = (hits > 0) & (label[i][:, None] != label[right][None, :]) & (rule.num * np.maximum(ni, nj) <= rule.den * np.minimum(ni, nj))
            if not split:
                ok &= i[:, None] < right[None, :]
            x, y = np.nonzero(ok)
            a, b, hits = i[x], right[y], hits[x, y].astype(np.int64)
            # what two sets must share, and what of it in lists
            both = -(-rule.num * (n[a] + n[b]) // (rule.num + rule.den))
            listed = both - np.maximum(beyond[a], beyond[b])
            good = hits + np.minimum(elsewhere[a], elsewhere[b]) >= listed
            a, b, both, listed = a[good], b[good], both[good], listed[good]
            good = apart(run["parity"], a, b) <= total[a] + total[b] - 2 * listed
            a, b, both = a[good], b[good], both[good]
            good = apart(run["sig"], a, b) <= n[a] + n[b] - 2 * both
            if good.any():
                yield a[good], b[good]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: dict[str, np.ndarray] | None = None

        def emit(cols: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
            new = np.flatnonzero((np.diff(cols["hub"]) != 0) | (np.diff(cols["bi"]) != 0) | (np.diff(cols["bj"]) != 0)) + 1
            found: list[np.ndarray] = []
            for a, b in zip(np.r_[0, new], np.r_[new, len(cols["hub"])]):
                if some := list(pairs({k: v[a:b] for k, v in cols.items()})):
                    x, y = (np.concatenate(c) for c in zip(*some))
                    low, inside = _reach(b - a, x, y), np.unique(np.r_[x, y])
                    node = cols["node"][a:b][inside]
                    name = np.zeros(b - a, np.uint64)
                    np.add.at(name, low[inside], mix(node.view(np.uint64)))
                    found.append(np.stack([name[low[inside]].view(np.int64), node]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.concatenate(found, axis=1)], ["part", "node"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = {k: batch.column(i).to_numpy(zero_copy_only=False) for i, k in enumerate(names) if k not in ("sig", "parity")}
            cols["sig"] = np.frombuffer(b"".join(batch.column(names.index("sig")).to_pylist()), np.uint64).reshape(-1, words)
            cols["parity"] = batch.column(names.index("parity")).flatten().to_numpy().view(np.uint64).reshape(-1, words)
            if rest is not None:
                cols = {k: np.concatenate([rest[k], cols[k]]) for k in cols}
            # the last cell may go on in the next batch
            last = np.flatnonzero((cols["hub"] != cols["hub"][-1]) | (cols["bi"] != cols["bi"][-1]) | (cols["bj"] != cols["bj"][-1]))
            cut = last[-1] + 1 if len(last) else 0
            if cut:
                yield from emit({k: v[:cut] for k, v in cols.items()})
            rest = {k: v[cut:] for k, v in cols.items()}
        if rest is not None:
            yield from emit(rest)

    # one in ``block`` rows at most, or one in ``block_tokens`` shingles
    sizes = lists.groupBy("hub").agg(F.greatest(F.count("*") / rule.block, F.sum("n") / rule.block_tokens).alias("size"))
    long_lists = stored(sizes.filter("size > 1").select("hub", F.ceil("size").cast("int").alias("blocks")), "long-lists")
    placed = lists.join(sketches, "node").join(small(long_lists), "hub", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    cells = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"bi": F.least("block", "other"), "bj": F.greatest("block", "other")})
    dealt = cells.select(*names).repartition(shuffle_count(lists.sparkSession), "hub", "bi", "bj").sortWithinPartitions("hub", "bi", "bj")
    return dealt.mapInArrow(scan, "part long, node long").distinct()


def sets_of(wanted: DataFrame, docs: DataFrame, clashes: frozenset[int], rule: Rule) -> DataFrame:
    """A stored table (doc_id, node, ...) of numbers with the sets of its nodes, ``shingles``, in place of the ids."""
    names = [c for c in wanted.columns if c != "doc_id"]
    # beyond the broadcast's limit the texts are shuffled by id; a scan that is large enough is then thinned out by Spark's runtime Bloom filter
    texts = docs.join(small(wanted), "doc_id").select(*names, "text")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 200):  # a set is larger than its text
                batch = whole.slice(at, 200)
                sets = list(shingle_sets(batch.column(len(names)).to_pylist(), rule.width))
                # an id may stand for other texts too: it must be the set that was meant
                own = [len(s) > 0 and _node(_digest(s, rule), clashes) == node for s, node in zip(sets, batch.column(names.index("node")).to_pylist())]
                cols = [*batch.columns[: len(names)], pa.array([s.tobytes() for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, [*names, "shingles"]).filter(pa.array(own, pa.bool_()))

    return texts.mapInArrow(hashed, ", ".join([*(f"{c} {wanted.schema[c].dataType.simpleString()}" for c in names), "shingles binary"]))


def linked_parts(parts: DataFrame, nodes: DataFrame, docs: DataFrame, clashes: frozenset[int], rule: Rule) -> DataFrame:
    """Links (a, b) that join the nodes of each part as all links between them do, stored: at most one for each row of ``parts``."""
    parts = stored(parts, "parts")
    wanted = stored(parts.join(nodes.select("node", F.col("first").alias("doc_id")), "node").select("doc_id", "node", "part"), "wanted-sets")
    drop(parts)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        of = None

        def links() -> Iterator[pa.RecordBatch]:
            if len(held) > 1:
                node, n = np.array(list(held), np.int64), np.array([len(s) for s in held.values()])
                common = overlaps(list(held.values()), rule)
                common *= rule.num + rule.den
                x, y = np.nonzero(np.triu(common >= rule.num * (n[:, None] + n[None, :]), 1))
                low = _reach(len(n), x, y)
                far = np.flatnonzero(low != np.arange(len(n)))
                yield pa.RecordBatch.from_arrays([pa.array(node[far]), pa.array(node[low[far]])], ["a", "b"])

        for batch in batches:
            for i, (node, part) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if part != of:
                    yield from links()
                    held, of = {}, part
                held[node] = np.frombuffer(batch.column(2)[i].as_buffer(), np.uint64)
        yield from links()

    met = sets_of(wanted, docs, clashes, rule).repartition(shuffle_count(docs.sparkSession), "part").sortWithinPartitions("part")
    links = stored(met.mapInArrow(compare, "a long, b long"), "links")
    drop(wanted)
    return links


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, clashes: frozenset[int], rule: Rule, fan: int = 512) -> DataFrame:
    """The pairs (a, b) that do link, stored. The sets of all a meet that of their b; a b with more than ``fan`` of them is dealt out over several groups."""
    pairs = stored(pairs, "candidates")
    if not row_count(pairs):
        return pairs
    # one in ``fan`` rows at most
    crowded = stored(pairs.groupBy("b").count().filter(F.col("count") > fan).select("b", F.ceil(F.col("count") / fan).cast("int").alias("lots")), "crowded-hubs")
    dealt = pairs.join(small(crowded), "b", "left").select("a", "b", F.pmod(F.xxhash64("a"), F.coalesce("lots", F.lit(1))).cast("int").alias("lot"))
    # place: 2 * lot, and 1 more for the hub itself
    wanted = dealt.select(F.col("a").alias("node"), "b", (2 * F.col("lot")).alias("place")).unionByName(dealt.select(F.col("b").alias("node"), "b", (2 * F.col("lot") + 1).alias("place")).distinct())
    wanted = stored(wanted.join(nodes.select("node", F.col("first").alias("doc_id")), "node").select("doc_id", "node", "b", "place"), "wanted-sets")
    drop(pairs, crowded)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, of = np.empty(0, np.uint64), None
        for batch in batches:
            a, b = [], []
            for i, (node, group, place) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(3)))):
                s = np.frombuffer(batch.column(3)[i].as_buffer(), np.uint64)
                if place & 1:
                    hub, of = s, group
                elif of == group and node != group:
                    common = len(np.intersect1d(s, hub, assume_unique=True))
                    if rule.den * common >= rule.num * (len(s) + len(hub) - common):
                        a.append(node), b.append(group)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    sets = sets_of(wanted, docs, clashes, rule).withColumn("lot", F.shiftright("place", 1))
    met = sets.repartition(shuffle_count(docs.sparkSession), "b", "lot").sortWithinPartitions("b", "lot", F.desc("place")).drop("lot")
    links = stored(met.mapInArrow(compare, "a long, b long"), "links")
    drop(wanted)
    return links


def best_hub(pairs: DataFrame, rule: Rule) -> DataFrame:
    """For each node, of the hubs that it may link to, the one it shares most lists with. A hub's own m isn't known here; 1 is the least."""
    hits = pairs.groupBy("node", "hub").agg(F.count("*").alias("hits"), *[F.any_value(c).alias(c) for c in ("n", "m", "hub_n")])
    hits = hits.filter(rule.enough(F.col("hits"), F.col("n"), F.col("m"), F.col("hub_n"), F.lit(1)))
    return hits.groupBy("node").agg(F.max_by("hub", F.struct("hits", "hub")).alias("b")).select(F.col("node").alias("a"), "b")


def with_labels(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """Posting lists with the class of each node and their first node by class, without the lists that are of one class; stored."""
    labelled = lists.join(small(labels), "node", "left").withColumn("label", F.coalesce("label", "node"))
    ends = labelled.groupBy("token").agg(F.min(F.struct("label", "node")).alias("low"), F.max("label").alias("last")).filter("low.label < last")
    ends = stored(ends.select("token", F.col("low.node").alias("head")), "list-heads")
    mixed = stored(labelled.join(ends, "token").select("token", "node", "n", "m", "label", "head"), "mixed-lists")
    drop(ends)
    return mixed


def ngram_join(docs: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per input row: the size of the document's set and the smallest id reachable over links.

    Null and empty texts, and texts without words, have an empty set and are linked with nothing, each its own component. Equal sets always link, so
    repeated rows do. An id that stands for several texts is a row for each, and each has the component of its own text. A row without id gives no links:
    it gets the component of the documents with an equal set, and null if there is none. Other columns are ignored; an empty table gives an empty result.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known = slim.filter("doc_id is not null")
    described, sketch = describe(slim, rule)
    all_nodes, clashes = set_nodes(described)
    nodes = all_nodes.filter("first is not null")
    prefix = postings(known, sketch, clashes, rule)
    shared = prefix.groupBy("token").agg(F.min(F.struct("node", "n")).alias("hub"), F.max("node").alias("last")).filter("hub.node < last")
    shared = stored(shared.select("token", F.col("hub.node").alias("hub"), F.col("hub.n").alias("hub_n")), "shared-tokens")
    lists = stored(prefix.join(shared, "token").groupBy("token", "node").agg(*[F.any_value(c).alias(c) for c in ("n", "m", "hub", "hub_n")]), "posting-lists")
    drop(shared)

    links = verified(best_hub(lists.filter("node <> hub"), rule), nodes, known, clashes, rule)
    labels = components(links)
    mixed = with_labels(lists, labels)
    drop(links, lists)
    lists = lists_by_head(mixed)
    sketches = nodes.select("node", "sig").join(prefix_sketches(mixed), "node")
    links = linked_parts(list_parts(lists, sketches, rule), nodes, known, clashes, rule)
    drop(mixed, lists)
    if row_count(links):
        before, labels = labels, joined(labels, links)
        drop(before)
    drop(links)

    classes = all_nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = classes.groupBy("label").agg(F.min("first").alias("component_id"))
    of_set = classes.join(least, "label").select("d1", "d2", "n", "component_id")
    out = described.join(of_set, ["d1", "d2", "n"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Classes after further links."""
    return components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(links))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(read_table(spark, sf_dir, "documents"), Rule(width=4, num=85, den=100))


SQL = {
    "op2_ngram_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) >= 4 THEN list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
r AS (SELECT doc_id AS a, doc_id AS c FROM documents UNION SELECT p.b, r.c FROM r JOIN p ON p.a = r.a WHERE r.c < p.b)
SELECT s.doc_id, len(s.sh) AS n_shingles, m.component_id FROM s JOIN (SELECT a, min(c) AS component_id FROM r GROUP BY a) m ON m.a = s.doc_id"""
}
