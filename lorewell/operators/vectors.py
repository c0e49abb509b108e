"""Embedding and filtered hybrid top-k search. Search is exact."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import DEFAULT, Config
from ..functions.blocks import SCORES, Best, DenseQueries, SparseQueries, runs
from ..functions.encoders import HashedTokens
from ..plans.store import counted

#: Queries up to this many, and up to so many bytes of them, go to every task as one block; more are dealt in blocks within both limits, to meet blocks of about
#: ``CHUNK_BLOCK`` chunks. ``STRIDE``: chunks that are scored at once, at most; with many queries they are fewer.
MATRIX_QUERIES = 4096
MATRIX_BYTES = 16 << 20
CHUNK_BLOCK = 16384
STRIDE = 1024


def embed(df: DataFrame, text_col: str, encoder: Callable[[], Callable] = HashedTokens, batch: int = DEFAULT.embedding_batch, mode: str = "document", retry: bool = False) -> DataFrame:
    """``df`` with dense_vector and sparse_vector. ``encoder`` makes the model, once per task, which is called with texts and ``mode`` ("document" or "query"); a
    batch it fails on keeps its rows, without vectors; with ``retry`` the texts of such a batch are tried again one by one. Only the text goes to the model; the
    other columns stay in the JVM."""

    def encoded(model: Callable, texts: list[str]) -> tuple[list, list]:
        try:
            dense, sparse = model(texts, mode)
            return list(dense), list(sparse)
        except Exception:  # whatever the model raises, its rows are reported without vectors
            if not retry or len(texts) == 1:
                return [None] * len(texts), [None] * len(texts)
        alone = [encoded(model, [t]) for t in texts]
        return [d[0] for d, _ in alone], [s[0] for _, s in alone]

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = encoder()
        for whole in parts:
            dense, sparse = [], []
            for at in range(0, len(whole), batch):
                texts = ["" if t is None else t for t in whole.iloc[at : at + batch]]
                d, s = encoded(model, texts)
                dense += d
                sparse += s
            yield pd.DataFrame({"dense": pd.Series(dense, dtype="object"), "sparse": pd.Series(sparse, dtype="object")})

    # nondeterministic, or a filter on the vectors would run the model again
    as_udf = F.pandas_udf(run, "dense array<float>, sparse map<long,float>").asNondeterministic()
    both = df.withColumn("_vectors", as_udf(F.col(text_col)))
    return both.select(*[F.col(f"`{c}`") for c in df.columns], F.col("_vectors.dense").alias("dense_vector"), F.col("_vectors.sparse").alias("sparse_vector"))


def to_sparse_map(tokens: Column, weights: Column) -> Column:
    return F.map_from_arrays(tokens, weights)


def validate_vectors(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with both vectors, a one-row table of the number of rows and of the dense dimensions). Different dimensions make ``single_dim`` false."""
    ok = df.filter((F.size("dense_vector") > 0) & (F.size("sparse_vector") > 0))
    n = F.size("dense_vector")
    return ok, ok.agg(F.count("*").alias("rows"), F.min(n).alias("min_dim"), F.max(n).alias("max_dim")).withColumn("single_dim", F.col("min_dim") == F.col("max_dim"))


def cosine(a: Column, b: Column) -> Column:
    """Null if either vector has length 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)


def top(df: DataFrame, by: str, score: Column, tie: str, k: int) -> DataFrame:
    """The k best rows per ``by``, with their rank from 1."""
    w = Window.partitionBy(by).orderBy(score.desc(), F.col(tie).asc())
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _stride(queries: int) -> int:
    return max(1, min(STRIDE, SCORES // max(queries, 1)))


def _search(queries: DataFrame, chunks: DataFrame, prepare: Callable, payload: list[Column], k: int, digits: int, heft: Column | None = None) -> DataFrame:
    """(query_id, chunk_id, score): for every query the k best chunks, at least, among those of its items (null: all). ``payload``: the array columns of either table
    that ``prepare`` makes a block of queries from. ``heft``: from the payload ``p0``, ``p1``, .. what makes a chunk likely to score high; such chunks come first."""
    names = [f"p{i}" for i in range(len(payload))]
    columns = [c.alias(n) for c, n in zip(payload, names)]
    # kept, for the plan that gives them runs once, whatever reads them
    asked, rows = counted(queries.select("query_id", "item_names", *columns))
    corpus = chunks.select("chunk_id", "item_name", *columns)
    kinds = {f.name: f.dataType.simpleString() for f in [*asked.schema, *corpus.schema]}
    out = f"query_id {kinds['query_id']}, chunk_id {kinds['chunk_id']}, score double"
    width = sum((F.greatest(F.size(n), F.lit(0)) for n in names), F.lit(2)) * 8
    bytes_ = asked.agg(F.sum(width).alias("n")).first()["n"] or 0
    if rows > MATRIX_QUERIES or bytes_ > MATRIX_BYTES:
        per_block = max(1, min(MATRIX_QUERIES, MATRIX_BYTES * rows // bytes_))
        return _in_cells(asked, corpus, prepare, names, per_block, k, digits, out, kinds, F.lit(0.0) if heft is None else heft)
    block = asked.toArrow().combine_chunks()  # within the limits above
    if not block.num_rows:
        return chunks.sparkSession.createDataFrame([], out)
    one = lambda c: pa.concat_arrays(block.column(c).chunks)
    shared = chunks.sparkSession.sparkContext.broadcast((one("query_id"), block.column("item_names").to_pylist(), prepare(*map(one, names))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, wanted, whole = shared.value
        free = np.array([i for i, own in enumerate(wanted) if own is None], int)
        of_item: dict[str, list[int]] = {}
        for i, own in enumerate(wanted):
            for name in set(own or ()):
                of_item.setdefault(name, []).append(i)
        ready: dict = {}
        best, kind = Best(len(ids), k, digits), None
        for batch in (part for whole_batch in batches for part in _parts(whole_batch, names)):
            kind = batch.column(0).type
            item = batch.column(1).dictionary_encode()
            known = item.dictionary.to_pylist()
            # items that no query asks for are one group, with the rows without an item
            code = np.array([i if name in of_item else -1 for i, name in enumerate(known)] + [-1])[item.indices.fill_null(len(known)).to_numpy()]
            read, chunk_ids = whole.look(*(batch.column(c) for c in names)), batch.column(0).to_numpy(zero_copy_only=False)
            for group in np.unique(code).tolist():
                key = known[group] if group >= 0 else None
                if key not in ready:
                    of = np.array(sorted({*free.tolist(), *of_item.get(key, ())}), int)
                    ready[key] = of, whole.take(of)
                of, own = ready[key]
                if len(of):
                    mine, step = np.flatnonzero(code == group), _stride(len(of))
                    for at in range(0, len(mine), step):
                        columns, scores = own.score(read, mine[at : at + step], best.least[of])
                        best.add(scores, of[columns], chunk_ids[mine[at : at + step]])
        found = best.rows(ids, kind)
        if found is not None:
            yield found

    return corpus.mapInArrow(run, out)


def _parts(batch: pa.RecordBatch, names: list[str]) -> Iterator[pa.RecordBatch]:
    """A batch in slices, each with a bounded number of tokens or components."""
    for first, end in runs(batch.column(names[0]), max(1, batch.num_rows)):
        yield batch.slice(first, end - first)


def _in_cells(queries: DataFrame, chunks: DataFrame, prepare: Callable, names: list[str], per_block: int, k: int, digits: int, out: str, kinds: dict[str, str], heft: Column) -> DataFrame:
    """Many queries: those of an item are dealt in blocks of about ``per_block``, its chunks in larger ones, and a cell is a block of both. A cell's queries come first
    and are held; its chunks stream past them, those with much ``heft`` first. An item with many rows is many cells."""
    free = F.col("item_names").isNull()
    item = lambda name: F.concat(F.lit("1"), name)
    q = queries.withColumn("item", F.explode(F.when(free, F.array(F.lit("0"))).otherwise(F.transform(F.filter(F.array_distinct("item_names"), lambda n: n.isNotNull()), item))))
    every, own = ([] if queries.filter(free).isEmpty() else [F.lit("0")]), F.when(F.col("item_name").isNotNull(), item(F.col("item_name")))
    c = chunks.withColumn("item", F.explode(F.array_compact(F.array(*every, own))))
    blocks = lambda df, size, name: df.groupBy("item").agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    # a row per item that is asked for; up to 32 MB of them, at 200 bytes a row, go to the chunks, which are then moved once, to their cells
    grid, items = counted(blocks(q, per_block, "q_blocks").join(blocks(c, CHUNK_BLOCK, "c_blocks"), "item"))
    grid = F.broadcast(grid) if items * 200 <= 32 << 20 else grid
    dealt = lambda df, key, mine, other: df.join(grid, "item").withColumn(f"{mine}_no", F.pmod(F.xxhash64(key), F.col(f"{mine}_blocks")).cast("int")).withColumn(f"{other}_no", F.explode(F.sequence(F.lit(0), F.col(f"{other}_blocks") - 1)))
    cell = ["item", "q_no", "c_no"]
    left = dealt(q, "query_id", "q", "c").select(*cell, F.lit(0).alias("side"), "query_id", F.lit(None).cast(kinds["chunk_id"]).alias("chunk_id"), *names)
    right = dealt(c, "chunk_id", "c", "q").select(*cell, F.lit(1).alias("side"), F.lit(None).cast(kinds["query_id"]).alias("query_id"), "chunk_id", *names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, ready = None, [], None

        def done() -> Iterator[pa.RecordBatch]:
            if ready is not None:
                found = ready[2].rows(ready[0], kind)
                if found is not None:
                    yield found

        kind = None
        for batch in batches:
            if not batch.num_rows:
                continue
            kind = batch.column(5).type
            own = [batch.column(0).dictionary_encode().indices.to_numpy(), *(batch.column(i).to_numpy() for i in (1, 2, 3))]
            new = np.flatnonzero(np.r_[True, np.any([np.diff(x) != 0 for x in own], axis=0)])
            for a, b in zip(new.tolist(), [*new[1:].tolist(), batch.num_rows]):
                part = batch.slice(a, b - a)
                at = (part.column(0)[0].as_py(), int(own[1][a]), int(own[2][a]))
                if at != cell:
                    yield from done()
                    cell, held, ready = at, [], None
                if own[3][a] == 0:
                    held.append(part)
                    continue
                if ready is None:
                    if not held:
                        continue
                    block = pa.Table.from_batches(held).combine_chunks()
                    one = lambda c: pa.concat_arrays(block.column(c).chunks)  # noqa: B023, E731
                    # the numbers are copied, so that the batches can go
                    ready, held = (one("query_id").take(pa.array(np.arange(block.num_rows))), prepare(*map(one, names)), Best(block.num_rows, k, digits)), []
                    del block
                for few in _parts(part, names):
                    read, chunk_ids, step = ready[1].look(*(few.column(c) for c in names)), few.column(5).to_numpy(zero_copy_only=False), _stride(ready[1].n)
                    for first in range(0, few.num_rows, step):
                        rows = np.arange(first, min(first + step, few.num_rows))
                        columns, scores = ready[1].score(read, rows, ready[2].least)
                        ready[2].add(scores, columns, chunk_ids[rows])
        yield from done()

    parts = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = left.unionByName(right).repartition(parts, *cell).sortWithinPartitions(*cell, "side", F.when(F.col("side") == 1, heft).desc(), "chunk_id")
    return met.mapInArrow(run, out)


def dense_topk(queries: DataFrame, chunks: DataFrame, k: int = DEFAULT.leg_limit, metric: str = "cosine") -> DataFrame:
    """(query_id, chunk_id, score, rank): the k nearest chunks by cosine, or with ``metric`` "ip" by inner product, among those of the query's items.

    ``queries``: query_id, vector, item_names (null: no filter). ``chunks``: chunk_id, item_name, vector. A vector of length 0 is near nothing by cosine, a null
    vector or one of another dimension by neither.
    """
    digits = 12 if metric == "cosine" else 9
    found = _search(queries, chunks, lambda vectors: DenseQueries(metric, vectors), [F.col("vector")], k, digits)
    return top(found, "query_id", F.round("score", digits), "chunk_id", k)


def sparse_topk(queries: DataFrame, chunks: DataFrame, k: int = DEFAULT.leg_limit) -> DataFrame:
    """(query_id, chunk_id, score, rank): the k best chunks by inner product of token weights among those of the query's items (null: all); a chunk without a
    common token isn't found. ``queries`` and ``chunks`` have a map ``sparse`` in place of a vector."""
    found = _search(queries, chunks, SparseQueries, [F.map_keys("sparse"), F.map_values("sparse")], k, 9, F.size("p1") * F.array_max("p1").cast("double"))
    return top(found, "query_id", F.round("score", 9), "chunk_id", k)


def unit_cosine(s: Column) -> Column:
    return (s + 1) / 2


def unit_product(s: Column) -> Column:
    return F.lit(0.5) + F.atan(s) / F.pi()


def hybrid(dense: DataFrame, sparse: DataFrame, k: int = DEFAULT.fused_limit, weights: tuple[float, float] = DEFAULT.leg_weights, norms: tuple[Callable, Callable] = (unit_cosine, unit_product)) -> DataFrame:
    """(query_id, chunk_id, score, rank): the weighted sum of both legs' normalised scores; a leg that lacks a chunk adds nothing."""
    legs = [leg.select("query_id", "chunk_id", (F.lit(w) * norm(F.col("score"))).alias("part")) for leg, w, norm in zip((dense, sparse), weights, norms)]
    fused = legs[0].unionByName(legs[1]).groupBy("query_id", "chunk_id").agg(F.sum("part").alias("score"))
    return top(fused, "query_id", F.round("score", 12), "chunk_id", k)


def hybrid_search(queries: DataFrame, corpus: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Both legs over one corpus (chunk_id, item_name, vector, sparse) and their fusion."""
    return hybrid(dense_topk(queries, corpus, config.leg_limit), sparse_topk(queries, corpus, config.leg_limit), config.fused_limit, config.leg_weights)


def hyde_queries(requests: DataFrame, documents: DataFrame) -> DataFrame:
    """(request_id, path, text): each question as it is, and once more with its hypothetical document, if only an empty one."""
    both = requests.join(documents.select("request_id", F.col("document")), "request_id", "left")
    texts = F.array(F.struct(F.lit("plain").alias("path"), F.col("query").alias("text")), F.struct(F.lit("hyde").alias("path"), F.concat("query", F.lit("\n"), F.coalesce("document", F.lit(""))).alias("text")))
    return both.select("request_id", F.inline(texts))
