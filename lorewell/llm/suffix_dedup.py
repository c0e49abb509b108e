"""Repeated passages by suffix arrays over shards of candidate text.

A byte goes if it is covered by a string of ``length`` bytes that also starts in a document with a smaller id.

1. Copies. Of identical texts only the one with the smallest id is looked at; the others, if long enough, go whole.
2. Anchors. Each string of ``length`` bytes has a key that depends on its bytes alone: the smallest hash among its 20-byte substrings. Runs of
   neighbouring strings with one key form a snippet, of bounded length. Equal strings have equal keys, so only keys that stand in two documents matter; one
   shuffle by key finds them.
3. Shards. The snippets of those keys are dealt by key. A task sorts its rows by key and builds suffix arrays over blocks of whole keys (distinct
   snippets once); where the permuted common prefixes reach ``length``, neighbours are of one class, which has a smallest document. A key with more than
   ``LOT`` rows is dealt out in lots: each has arrays of its own; what is the first of its class in a lot may not be so in others, so those are merged by a digest of
   the string.
4. The strings of every class that stand in other documents are the spans to cut; only documents that have some are read again.

Inside, ``doc`` is the id, null being the largest long, and ``variant`` tells apart the texts of rows that repeat an id: a hash of the text there,
0 elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .shingles import mix
from .suffix_array import common_prefixes, suffix_array
from .work import drop, read_table, row_count, shuffle_count, small, stored

#: Rows of one key that a task takes together, and string starts in one row, so that a lot has at most LOT * (MOST_STARTS + length) bytes.
LOT = 8192
MOST_STARTS = 512
GRAM = 20
ROW = ["doc", "variant"]
_BYTE = np.random.default_rng(50_021).integers(1, 1 << 63, 256, dtype=np.uint64)


def anchors(text: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, first, last): the runs of string starts with one key. ``length`` must be 20 at least."""
    if len(text) < length:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    h = _BYTE[np.frombuffer(text, np.uint8)]
    k = 1
    while k < GRAM:
        step = min(k, GRAM - k)
        h = h[:-step] * np.uint64(0x9E3779B97F4A7C15 + 2 * k) + h[step:]  # another odd factor for each step
        k += step
    w, m, k = length - GRAM + 1, mix(h), 1
    while 2 * k <= w:
        m = np.minimum(m[:-k], m[k:])
        k *= 2
    if w > k:
        m = np.minimum(m[: len(m) - (w - k)], m[w - k :])
    first = np.r_[0, np.flatnonzero(m[1:] != m[:-1]) + 1]
    last = np.r_[first[1:], len(m)] - 1
    pieces = (last - first) // MOST_STARTS + 1
    if pieces.max() > 1:  # a long run, as of a periodic text, is several: their strings are its strings
        run = np.repeat(np.arange(len(first)), pieces)
        inner = np.arange(len(run)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = first[run] + inner * MOST_STARTS
        return m[first][run], begin, np.minimum(begin + MOST_STARTS - 1, last[run])
    return m[first], first, last


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]


def anchor_rows(docs: DataFrame, length: int) -> DataFrame:
    """(key, doc, variant, at) of all runs; ``at``: where the snippet begins, in the upper 32 bits, and its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, size = [], 0
            for doc, variant, text in zip(*(batch.column(c).to_pylist() for c in ROW), _texts(batch)):
                k, first, last = anchors(text, length)
                if len(k):
                    parts.append((k.view(np.int64), np.full(len(k), doc, np.int64), np.full(len(k), variant, np.int64), (first << 32) + last - first + length))
                    size += len(k)
                if size > 200_000:
                    yield rows(parts)
                    parts, size = [], 0
            if size:
                yield rows(parts)

    def rows(parts: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts)], ["key", *ROW, "at"])

    return docs.select(*ROW, "text").mapInArrow(run, "key long, doc long, variant long, at long")


def shared_keys(rows: DataFrame, lot: int = LOT) -> DataFrame:
    """The runs whose key stands in two documents at least, with the lot of their key that each is in. Rows of a key pass by in order; only the open run is
    held back, and of it no more than one document's rows."""
    names = ["key", *ROW, "at"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, known, passed = None, None, 0  # the open run, while one document's; the open run's key, once it is known to be shared, and its rows so far
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(i).to_numpy() for i in range(4)]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            key, doc = cols[:2]
            start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            stop = np.r_[start[1:], len(key)]
            many = doc[start] != doc[stop - 1]  # rows of a key are sorted by document
            many[0] |= key[0] == known
            place = np.arange(len(key)) - np.repeat(start, stop - start)
            if key[0] == known:
                place[: stop[0]] += passed
            take = np.repeat(many, stop - start)
            if take.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[take]) for x in (*cols, (place // lot).astype(np.int32))], [*names, "lot"])
            known, passed = (key[-1], int(place[-1]) + 1) if many[-1] else (None, 0)
            held = None if many[-1] else [x[start[-1] :] for x in cols]

    dealt = rows.repartition(shuffle_count(rows.sparkSession), "key").sortWithinPartitions("key", "doc")
    return dealt.mapInArrow(run, "key long, doc long, variant long, at long, lot int")


def snippets(docs: DataFrame, shared: DataFrame) -> DataFrame:
    """(key, lot, doc, variant, first, snippet) of the shared runs."""
    ids = stored(shared.select(*ROW).distinct(), "shared-ids")
    per_doc = shared.groupBy(*ROW).agg(F.collect_list(F.struct("key", "lot", "at")).alias("runs"))
    texts = docs.join(small(ids), ROW, "left_semi").join(per_doc, ROW).select(*ROW, F.col("text").cast("binary").alias("text"), *[F.col("runs")[c].alias(c) for c in ("key", "lot", "at")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(2)
            for begin, n in _few(batch.column(3)):
                lists = [batch.column(i).slice(begin, n) for i in range(3, 6)]
                key, lot, at = (x.flatten().to_numpy() for x in lists)
                count = np.diff(lists[0].offsets.to_numpy())
                doc, variant = (np.repeat(batch.column(i).slice(begin, n).to_numpy(), count) for i in range(2))
                first, size = at >> 32, at & 0xFFFFFFFF
                spans = zip(first.tolist(), (first + size).tolist())
                cut = []
                for i, m in enumerate(count.tolist()):
                    whole = text[begin + i].as_py() or b""
                    cut += [whole[a:b] for a, b in islice(spans, m)]
                yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in (key, lot, doc, variant, first.astype(np.int32))), pa.array(cut, pa.binary())], ["key", "lot", *ROW, "first", "snippet"])

    return texts.mapInArrow(run, "key long, lot int, doc long, variant long, first int, snippet binary")


def _few(lists: pa.ListArray, most: int = 100_000) -> Iterator[tuple[int, int]]:
    """(from, count) of stretches of rows whose lists have about ``most`` entries together."""
    ends = lists.offsets.to_numpy()[1:] - lists.offsets[0].as_py()
    at = 0
    while at < len(ends):
        n = max(1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most)) - at)
        yield at, n
        at += n


class Classes:
    """The strings of ``length`` bytes in some snippets, by class: equal strings are of one."""

    def __init__(self, snippets: list[bytes], length: int):
        number: dict[bytes, int] = {}
        self.which = np.array([number.setdefault(x, len(number)) for x in snippets])
        distinct = list(number)
        self.n = len(distinct)
        sizes = np.array([len(x) for x in distinct])
        self.data = np.frombuffer(b"\0".join(distinct) + b"\0", np.uint8)
        self.begin = np.cumsum(sizes + 1) - sizes - 1
        self.of = np.repeat(np.arange(self.n), sizes + 1)
        left = np.repeat(self.begin + sizes, sizes + 1) - np.arange(len(self.data))  # bytes from here to the snippet's end
        symbols = np.append(self.data.astype(np.uint16) + np.uint16(2), np.uint16(0))
        symbols[self.begin + sizes] = 1
        sa = suffix_array(symbols, 258)
        shared = common_prefixes(symbols, sa)
        sa = sa[1:]
        self.sa = sa[left[sa] >= length]
        self.fresh = shared[self.sa] < length
        self.fresh[0] = True
        #: the strings' places in ``data``, and the class of each
        self.at = np.flatnonzero(left >= length)
        of_place = np.empty(len(self.data), np.int64)
        of_place[self.sa] = np.cumsum(self.fresh) - 1
        self.of_string = of_place[self.at]

    def rows_of(self, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, item): for every row, the items that its distinct snippet owns; ``owner`` is sorted."""
        count = np.bincount(owner, minlength=self.n)
        rows = np.repeat(np.arange(len(self.which)), count[self.which])
        inner = np.arange(len(rows)) - np.repeat(np.cumsum(count[self.which]) - count[self.which], count[self.which])
        return rows, (np.cumsum(count) - count)[self.which[rows]] + inner


def spans_of_block(docs: np.ndarray, firsts: np.ndarray, texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, Classes, np.ndarray]:
    """(row, from, to) of the strings among some snippets that have a smaller document in the same suffix array; also the classes, and the smallest document
    of each string."""
    c = Classes(texts, length)
    least = np.full(c.n, np.iinfo(np.int64).max)
    np.minimum.at(least, c.which, docs)
    first_doc = np.minimum.reduceat(least[c.of[c.sa]], np.flatnonzero(c.fresh))[c.of_string]
    # runs of neighbouring strings of one snippet with one smallest document
    owner = c.of[c.at]
    new = np.r_[True, (owner[1:] != owner[:-1]) | (first_doc[1:] != first_doc[:-1])]
    start, stop = c.at[new], c.at[np.r_[np.flatnonzero(new)[1:] - 1, len(c.at) - 1]]
    rows, run = c.rows_of(c.of[start])
    gone = docs[rows] > first_doc[new][run]
    rows, run = rows[gone], run[gone]
    shift = firsts[rows] - c.begin[c.which[rows]]
    return rows, start[run] + shift, stop[run] + shift + length, c, first_doc


def firsts_of_lot(docs: np.ndarray, firsts: np.ndarray, c: Classes, first_doc: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, from, digest) of the strings of a lot that have no smaller document in it; the digest, two longs, is that of the string's class."""
    raw = c.data.tobytes()
    digest = np.frombuffer(b"".join(xxhash.xxh3_128_digest(raw[i : i + length]) for i in c.sa[c.fresh].tolist()), "<i8").reshape(-1, 2)
    rows, item = c.rows_of(c.of[c.at])
    own = docs[rows] == first_doc[item]
    rows, item = rows[own], item[own]
    return rows, c.at[item] + firsts[rows] - c.begin[c.which[rows]], digest[c.of_string[item]]


def repeated_strings(rows: DataFrame, length: int, block_bytes: int = 1 << 21) -> DataFrame:
    """(doc, variant, from, to, h1, h2) from snippet rows, dealt and sorted by key and lot. A suffix array covers whole keys of about ``block_bytes``, or a
    lot of a key that has several (lot 0 or more), and gives the spans to cut; of a lot also the strings that are to be compared with other lots', with the
    digests of their classes."""
    names = [*ROW, "from", "to", "h1", "h2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple] = []
        held, open_, apart = 0, None, False

        def out() -> Iterator[pa.RecordBatch]:
            docs, variants, firsts = (np.concatenate([p[i] for p in parts]) for i in range(3))
            rows, begin, end, classes, first_doc = spans_of_block(docs, firsts, [x for p in parts for x in p[3]], length)
            yield pa.RecordBatch.from_arrays([pa.array(docs[rows]), pa.array(variants[rows]), pa.array(begin.astype(np.int64)), pa.array(end.astype(np.int64)), *[pa.nulls(len(rows), pa.int64())] * 2], names)
            if apart:
                rows, begin, digest = firsts_of_lot(docs, firsts, classes, first_doc, length)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (docs[rows], variants[rows], begin.astype(np.int64), begin.astype(np.int64) + length, digest[:, 0].copy(), digest[:, 1].copy())], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            key, lot, doc, variant, first = (batch.column(i).to_numpy() for i in range(5))
            text = batch.column(5).to_pylist()
            start = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (lot[1:] != lot[:-1])])
            size = np.cumsum([0] + [len(x) for x in text])
            at = 0
            for a in start.tolist():
                mine = (key[a], lot[a])
                if mine != open_ and (held + size[a] - size[at] >= block_bytes or apart or lot[a] >= 0):
                    if a > at:
                        parts.append((doc[at:a], variant[at:a], first[at:a], text[at:a]))
                    if parts:
                        yield from out()
                    parts, held, at = [], 0, a
                    apart = bool(lot[a] >= 0)
                open_ = mine
            parts.append((doc[at:], variant[at:], first[at:], text[at:]))
            held += size[-1] - size[at]
        if parts:
            yield from out()

    dealt = rows.repartition(shuffle_count(rows.sparkSession), "key", "lot").sortWithinPartitions("key", "lot")
    return dealt.mapInArrow(run, "doc long, variant long, from long, to long, h1 long, h2 long")


def repeated_spans(docs: DataFrame, shared: DataFrame, length: int) -> DataFrame:
    """(doc, variant, spans), stored: what is to be cut from each text that has something to cut."""
    # one key in LOT rows at most
    split = stored(shared.filter("lot > 0").select("key").distinct(), "split-keys")
    if row_count(split):
        shared = shared.join(small(split).withColumn("split", F.lit(True)), "key", "left").withColumn("lot", F.when(F.col("split"), F.col("lot")).otherwise(F.lit(-1))).drop("split")
    else:
        shared = shared.withColumn("lot", F.lit(-1))
    found = stored(repeated_strings(snippets(docs, shared), length), "repeated-strings")
    spans = found.filter("h1 is null").select(*ROW, "from", "to")
    if row_count(split):
        strings = found.filter("h1 is not null")
        least = strings.groupBy("h1", "h2").agg(F.min("doc").alias("first_doc"), F.max("doc").alias("last_doc")).filter("first_doc < last_doc")
        spans = spans.unionByName(strings.join(least, ["h1", "h2"]).filter("doc > first_doc").select(*ROW, "from", "to"))
    per_text = stored(spans.groupBy(*ROW).agg(F.collect_set(F.struct("from", "to")).alias("spans")), "spans-by-text")
    drop(found, split)
    return per_text


def _cut(text: pd.Series, spans: pd.Series) -> pd.DataFrame:
    kept, removed, count = [], [], []
    for t, own in zip(text, spans):
        raw = (t or "").encode()
        s = np.array(sorted((x["from"], x["to"]) for x in own), np.int64)
        reach = np.maximum.accumulate(s[:, 1])
        new = np.r_[True, s[1:, 0] > reach[:-1]]
        begin = s[new, 0]
        end = reach[np.r_[np.flatnonzero(new)[1:] - 1, len(s) - 1]]
        edges = [0, *np.stack([begin, end], axis=1).ravel().tolist(), len(raw)]
        kept.append(b"".join(raw[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2)))
        removed.append(int((end - begin).sum()))
        count.append(len(begin))
    return pd.DataFrame({"kept": kept, "n_removed": removed, "n_spans": count})


def suffix_dedup(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept), one row per input row: ``kept`` is binary, since a cut may fall inside a character.

    Texts are UTF-8 bytes, null counts as empty; matches never cross documents; overlaps within one document alone are left. ``length`` must be 20 at
    least. A null id counts as the largest long, so after all others. Rows that repeat an id (null included) are cut each by what stands under smaller
    ids, never by each other. Other columns are ignored; an empty table gives an empty result.
    """
    doc = F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("doc")
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).select("doc_id", doc, "text")
    digests = stored(plain.select("doc_id", "doc", F.octet_length("text").cast("long").alias("n_bytes"), F.unhex(F.sha2("text", 256)).alias("digest"), F.xxhash64("text").alias("hash")), "digests")
    repeated = stored(digests.groupBy("doc").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).filter("low <> high").select("doc"), "repeated-ids")

    def with_variant(rows: DataFrame, own: Column) -> DataFrame:
        if not row_count(repeated):
            return rows.withColumn("variant", F.lit(0).cast("long"))
        return rows.join(small(repeated).withColumn("again", F.lit(True)), "doc", "left").withColumn("variant", F.when(F.col("again"), own).otherwise(F.lit(0).cast("long"))).drop("again")

    slim = with_variant(plain, F.xxhash64("text"))
    digests = with_variant(digests, F.col("hash")).filter(f"n_bytes >= {length}")
    # written, so that both sides of the join are plain exchanges, which AQE can split at a large group of copies
    groups = stored(digests.groupBy("digest").agg(F.min("doc").alias("least"), F.count("*").alias("n")).filter("n > 1").select("digest", "least"), "copies")
    copies = stored(digests.join(groups, "digest").filter("doc <> least").select(*ROW).distinct(), "copied-ids")
    single = slim.join(small(copies), ROW, "left_anti")
    shared = stored(shared_keys(anchor_rows(single.filter(f"octet_length(text) >= {length}"), length)), "shared-anchors")
    spans = repeated_spans(slim, shared, length)
    drop(shared)
    touched = small(spans, *ROW)
    n_bytes = F.octet_length("text").cast("long").alias("n_bytes")
    cut = F.pandas_udf(_cut, "kept binary, n_removed long, n_spans long")
    some = slim.join(touched, ROW, "left_semi").join(spans, ROW).withColumn("c", cut("text", "spans")).select("doc_id", n_bytes, "c.n_removed", "c.n_spans", "c.kept")
    zero = F.lit(0).cast("long")
    none = single.join(touched, ROW, "left_anti").select("doc_id", n_bytes, zero.alias("n_removed"), zero.alias("n_spans"), F.col("text").cast("binary").alias("kept"))
    whole = digests.join(copies, ROW, "left_semi").select("doc_id", "n_bytes", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit("").cast("binary").alias("kept"))
    return some.unionByName(none).unionByName(whole)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(read_table(spark, sf_dir, "documents"), length=50)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
