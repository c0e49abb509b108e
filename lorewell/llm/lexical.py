"""Ranked lexical search by inner products of impact vectors, pruned by norm buckets and coordinate bounds; scores are exact integers.

A query is the vector of its terms' weights (times their repeats), a document that of its terms' impacts; only terms that some query has can count, so a
document keeps those alone. Each task takes its documents in order of their vectors' length, longest first, in buckets. With a query's k-th best score
so far as the threshold,

- a bucket is passed over if its greatest length times the query's is below the threshold (Cauchy-Schwarz); those after it are shorter still;
- inside, the query's heaviest coordinates say in which range a document's must lie if the angle between both is to be small enough; what a document has there
  is counted, and the rest adds no more than the rest of both lengths, nor than each further coordinate at the bucket's greatest impact;
- what survives is scored again in 64-bit integers.

Queries are dealt into blocks by the number of their terms; a pass over the documents answers one block.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import floor, log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .work import drop, numbered, read_table, row_count, stored

#: Terms are of ASCII letters and digits and of whatever isn't ASCII; A-Z is lower-cased, other ASCII separates.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: Room for rounding in what is compared in floating point.
SLACK = 1e-9


@dataclass(frozen=True)
class Settings:
    top: int = 10
    #: Documents of a bucket, at most; coordinates that bound a query; terms of all queries of a block, about.
    bucket: int = 1024
    focus: int = 24
    block_terms: int = 1 << 17


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


def query_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, item_id, term, times), stored; ``row`` tells items with one id apart."""
    rows, row = numbered(items.select(F.col(id_col).alias("item_id"), F.col(text_col).cast("string").alias("text")), "items")
    kind = rows.schema["item_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                count = Counter(terms(batch.column("text")[at].as_py()))
                one = [pa.array([batch.column(c)[at].as_py()] * len(count), batch.column(c).type) for c in (row, "item_id")]
                yield pa.RecordBatch.from_arrays([*one, pa.array(list(count), pa.binary()), pa.array(list(count.values()), pa.int64())], ["row", "item_id", "term", "times"])

    found = stored(rows.mapInArrow(run, f"row long, item_id {kind}, term binary, times long"), "item-terms")
    drop(rows)
    return found


def term_vectors(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, terms, tfs), stored: a document's number of terms, and which of the vocabulary it has how often."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # the terms of one block of queries
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.get
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                n, size, term, tf = [], [0], [], []
                for text in batch.column(1):
                    words = terms(text.as_py())
                    count = Counter(map(number, words))
                    count.pop(None, None)
                    n.append(len(words))
                    term.extend(count)
                    tf.extend(count.values())
                    size.append(len(term))
                at_ = pa.array(size, pa.int32())
                lists = [pa.ListArray.from_arrays(at_, pa.array(x, t)) for x, t in ((term, pa.int32()), (tf, pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])

    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return stored(slim.mapInArrow(run, f"doc_id {kind}, n long, terms array<int>, tfs array<long>"), "term-vectors")


class Queries:
    """A block of queries over a vocabulary: their weights, lengths, and heaviest coordinates."""

    def __init__(self, rows: pd.DataFrame, weight: np.ndarray, focus: int):
        """``rows``: row, term (its number), times."""
        self.rows, of = np.unique(rows["row"].to_numpy(), return_inverse=True)
        order = np.argsort(of, kind="stable")
        self.begin = np.r_[0, np.cumsum(np.bincount(of, minlength=len(self.rows)))]
        self.term = rows["term"].to_numpy()[order].astype(np.int64)
        self.weight = (rows["times"].to_numpy()[order] * weight[self.term]).astype(np.int64)
        self.size = len(weight)
        self.length = np.sqrt(np.add.reduceat(self.weight.astype(float) ** 2, self.begin[:-1]))
        # place -1 is that of a query with fewer coordinates
        self.focus, self.share = np.full((len(self.rows), focus), -1), np.zeros((len(self.rows), focus))
        for q in range(len(self.rows)):
            mine = slice(self.begin[q], self.begin[q + 1])
            best = np.argsort(-self.weight[mine], kind="stable")[:focus]
            self.focus[q, : len(best)] = self.term[mine][best]
            self.share[q, : len(best)] = self.weight[mine][best] / max(self.length[q], 1.0)
        #: Documents that a bucket can have if all these coordinates of theirs are to be held at once, in 32 MB.
        self.room = max(16, (1 << 22) // (len(np.unique(self.focus)) + 1))


def survivors(q: Queries, active: np.ndarray, least: np.ndarray, start: np.ndarray, term: np.ndarray, impact: np.ndarray, length: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(query, documents of the bucket that may reach its threshold). A document is left out only if a bound is below ``least``."""
    used = np.unique(q.focus[active])
    used = used[used >= 0]
    place = np.full(q.size + 1, len(used))  # the last column is all 0, also for place -1
    place[used] = np.arange(len(used))
    row = np.repeat(np.arange(len(length)), np.diff(start))
    held = place[term] < len(used)
    unit = np.zeros((len(length), len(used) + 1))
    unit[row[held], place[term[held]]] = impact[held] / length[row[held]]
    # the greatest impact of each term here, and what a query's terms beyond its heaviest can add at most
    top = np.zeros(q.size + 1)
    np.maximum.at(top, term, impact)
    others = np.add.reduceat(q.weight * top[q.term], q.begin[:-1])[active] - (q.share[active] * q.length[active, None] * top[q.focus[active]]).sum(axis=1)
    for at in range(0, len(active), 64):
        some = active[at : at + 64]
        d, c = unit[:, place[q.focus[some]]], q.share[some]
        cos = np.minimum(least[some] / (q.length[some] * length[0]), 1.0)[:, None]
        spread = np.sqrt(np.maximum((1 - c**2) * (1 - cos**2), 0))
        low, high = c * cos - spread - SLACK, np.where(cos > c, c * cos + spread, 1) + SLACK
        ok = ((d >= low) & (d <= high)).all(axis=2)
        both = q.length[some] * length[:, None]
        rest = np.sqrt(np.maximum(1 - (c**2).sum(axis=1), 0)) * np.sqrt(np.maximum(1 - (d**2).sum(axis=2), 0)) * both
        ok &= ((d * c).sum(axis=2) * both + np.minimum(rest, others[at : at + 64])) * (1 + SLACK) + SLACK * both >= least[some]
        for j in np.flatnonzero(ok.any(axis=0)):
            yield some[j], np.flatnonzero(ok[:, j])


def search(q: Queries, vectors: DataFrame, settings: Settings) -> DataFrame:
    """(row, doc_id, score): each task's best documents for each query. ``vectors``: doc_id, terms, impacts, length; sorted by length within a partition."""
    shared = vectors.sparkSession.sparkContext.broadcast(q)
    kind = vectors.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        best = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool))] * len(q.rows)
        least = np.ones(len(q.rows))
        dense = np.zeros(q.size, np.int64)
        id_type = None
        for whole in batches:
            id_type = whole.column(0).type
            step = min(settings.bucket, q.room)
            for at in range(0, whole.num_rows, step):
                part = whole.slice(at, step)
                length = part.column(3).to_numpy()
                active = np.flatnonzero(q.length * length[0] * (1 + SLACK) >= least) if len(length) else []
                if not len(active):
                    continue
                nameless = np.asarray(part.column(0).is_null())
                ids = part.column(0).fill_null(np.iinfo(np.int64).max).to_numpy().astype(np.int64)
                start = np.r_[0, np.cumsum(part.column(1).value_lengths().to_numpy())]
                term, impact = part.column(1).flatten().to_numpy().astype(np.int64), part.column(2).flatten().to_numpy()
                for i, docs in survivors(q, active, least, start, term, impact, length):
                    mine = slice(q.begin[i], q.begin[i + 1])
                    dense[q.term[mine]] = q.weight[mine]
                    n = start[docs + 1] - start[docs]
                    entry = np.arange(n.sum()) + np.repeat(start[docs] - (np.cumsum(n) - n), n)
                    score = np.add.reduceat(dense[term[entry]] * impact[entry], np.cumsum(n) - n)
                    dense[q.term[mine]] = 0
                    new = np.flatnonzero(score >= least[i])
                    if not len(new):
                        continue
                    scores, keys, null = (np.concatenate([a, b]) for a, b in zip(best[i], (score[new], ids[docs[new]], nameless[docs[new]])))
                    order = np.lexsort((keys, null, -scores))[: settings.top]
                    best[i] = scores[order], keys[order], null[order]
                    if len(order) == settings.top:
                        least[i] = max(1, scores[order[-1]])
        found = [i for i in range(len(q.rows)) if len(best[i][0])]
        if found:
            scores, keys, null = (np.concatenate(x) for x in zip(*(best[i] for i in found)))
            row = np.repeat(q.rows[found], [len(best[i][0]) for i in found])
            yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(np.where(null, 0, keys), pa.int64(), mask=null).cast(id_type), pa.array(scores, pa.int64())], ["row", "doc_id", "score"])

    return vectors.mapInArrow(run, f"row long, doc_id {kind}, score long")


def lexical_search(docs: DataFrame, items: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``top`` documents with a score above 0, best first, equal scores by ascending id, null last.

    A null or empty text has no terms: such a document is never found and not counted, such an item finds nothing. Each row of either table stands for
    itself, whatever its id: repeated rows are found, or asked for, once each. ``id_col`` is an integer. Other columns are ignored. If either table is
    empty, so is the result.
    """
    asked = query_terms(items, item_id, item_text)
    blocks = max(1, -(-row_count(asked) // settings.block_terms))
    names = asked.select("row", "item_id").distinct()
    found: DataFrame | None = None
    for b in range(blocks):
        block = asked.filter(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b).select("row", "term", "times").toPandas()  # about block_terms rows
        block["term"] = block["term"].map(bytes)
        vocabulary = {t: i for i, t in enumerate(sorted(set(block["term"])))}
        vectors = term_vectors(docs, vocabulary, id_col, text_col)
        total = vectors.agg(F.count_if(F.col("n") > 0).alias("documents"), F.sum("n").alias("length")).first()
        many, length = total["documents"], total["length"] or 0
        if not len(block) or not length:
            drop(vectors)
            continue
        df = np.zeros(len(vocabulary), np.int64)
        for r in vectors.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # the vocabulary's size at most
            df[r["term"]] = r["count"]
        weight = np.array([floor(1000 * log((2 * many + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
        block["term"] = block["term"].map(vocabulary)
        m = F.expr(f"25 + ((75 * n * {many}L) div {length}L)")
        impact = F.expr("transform(tfs, tf -> (1000000000L * tf) div (1000L * tf + 8L * m))")
        weighed = vectors.filter(F.size("terms") > 0).withColumn("m", m).select("doc_id", "terms", impact.alias("impacts"))
        weighed = weighed.withColumn("length", F.sqrt(F.aggregate("impacts", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))))
        hits = stored(search(Queries(block, weight, settings.focus), weighed.sortWithinPartitions(F.desc("length")), settings), "hits")
        drop(vectors)
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        return names.select("item_id", F.lit(1).alias("rank"), F.lit(None).cast(docs.schema[id_col].dataType).alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    order = Window.partitionBy("row").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= settings.top)
    return best.join(names, "row").select("item_id", "rank", "doc_id", "score")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


SQL = {
    "op12_lexical_search": r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
len AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM len),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY doc_id, term),
w AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY term),
s AS (SELECT q.item_id, tf.doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms))))::BIGINT AS score
  FROM (SELECT item_id, term, count(*) AS times FROM q GROUP BY ALL) q JOIN tf USING (term) JOIN w USING (term) JOIN len ON len.doc_id = tf.doc_id, total, range(times) GROUP BY q.item_id, tf.doc_id),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10"""
}
