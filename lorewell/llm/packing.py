"""Best-fit packing of token pieces into sequences, with a vector of capacities.

Each piece takes (tokens, 1 document, tokens^2 of attention cost) from its sequence. Pieces are placed longest first; among the open sequences
that can bear a piece under every constraint, the one with the largest weighted dot product of the piece and the residual, or with the
smallest weighted norm of what would remain, gets it. Pieces are dealt at random into groups of about ``group_pieces`` and packed group by
group, so no task holds more than a group however long the table is; a group wastes at most its last, partly filled sequences.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .tokens import default_path, encode
from .work import read_table, row_count, stored

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: full ones, but for the first, which takes the remainder."""
    first = n if n <= capacity else n % capacity or capacity
    return [(0, first)] + [(at, capacity) for at in range(first, n, capacity)]


def token_pieces(docs: DataFrame, capacity: int, end_id: int, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of each document's ids and its end id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.array([*encode(text.as_py(), vocabulary), end_id], dtype="<u4")
                rows += [(doc, k, at, n, zlib.crc32(ids[at : at + n].tobytes())) for k, (at, n) in enumerate(cut(len(ids), capacity))]
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, PIECE)


def best_fit(lengths: np.ndarray, capacities: tuple[float, float, float], weights: tuple[float, float, float], rule: str = "norm") -> np.ndarray:
    """The bin number of each piece. ``rule``: 'norm' or 'dot'. A piece that no empty sequence could bear gets one of its own."""
    caps, w = np.asarray(capacities, float), np.asarray(weights, float)
    bins = np.full(len(lengths), -1, np.int64)
    order = np.argsort(-lengths, kind="stable")
    room = np.empty((3, max(1, len(lengths))))
    number = np.empty(max(1, len(lengths)), np.int64)
    n_open = made = 0
    shortest = lengths.min() if len(lengths) else 0
    for at, i in enumerate(order):
        need = np.array([lengths[i], 1.0, float(lengths[i]) ** 2])
        here = room[:, :n_open]
        fits = np.flatnonzero((here >= need[:, None]).all(axis=0)) if n_open else np.empty(0, int)
        if fits.size:
            left = here[:, fits]
            score = ((left * (need * w / caps**2)[:, None]).sum(0)) if rule == "dot" else -((w / caps**2)[:, None] * (left - need[:, None]) ** 2).sum(0)
            b = fits[int(score.argmax())]
        else:
            b, n_open = n_open, n_open + 1
            room[:, b], number[b] = caps, made
            made += 1
        room[:, b] -= need
        bins[i] = number[b]
        if room[0, b] < shortest or room[1, b] < 1 or room[2, b] < shortest**2:  # full: the last open one takes its place
            n_open -= 1
            room[:, b], number[b] = room[:, n_open], number[n_open]
    return bins


def pack(pieces: DataFrame, capacity: int = 1024, max_docs: int = 1024, attention: float | None = None, weights: tuple[float, float, float] = (1.0, 1e-6, 1e-6), rule: str = "norm", group_pieces: int = 16384) -> DataFrame:
    """``pieces`` with sequence_id and offset (the place in the sequence, without gaps from 0).

    ``attention``: the most sum of squared lengths in a sequence; by default capacity^2, which never binds. Lengths must lie in 1..capacity.
    Repeated rows are pieces of their own; further columns pass through; an empty table gives an empty result. Sequence numbers are
    distinct over all groups: the group in the upper bits, the number within it in the lower 32. The pieces are written first, and dealt by their place in what was
    written; the result reads nothing else.
    """
    deal, group = ("_deal", "_group")
    while deal in pieces.columns or group in pieces.columns:
        deal, group = deal + "_", group + "_"
    # by its place in the table, so that rows without id, or of one id, are dealt out like others
    kept = stored(pieces.withColumn(deal, F.xxhash64(F.monotonically_increasing_id())), "pieces")
    groups = max(1, -(-row_count(kept) // group_pieces))
    caps = (float(capacity), float(max_docs), float(attention or capacity**2))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable", ignore_index=True)
        bins = best_fit(pdf["length"].to_numpy(), caps, weights, rule)
        order = np.argsort(bins, kind="stable")
        n = pdf["length"].to_numpy()[order]
        ahead = np.cumsum(n) - n
        new = np.r_[True, np.diff(bins[order]) != 0]
        offset = np.empty(len(n), np.int64)
        offset[order] = ahead - np.maximum.accumulate(np.where(new, ahead, 0))
        pdf["sequence_id"] = (pdf[group].to_numpy().astype(np.int64) << 32) | bins
        pdf["offset"] = offset
        return pdf.drop(columns=group)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return kept.withColumn(group, F.pmod(F.col(deal), F.lit(groups))).drop(deal).groupBy(group).applyInPandas(run, schema)


def pack_documents(docs: DataFrame, capacity: int = 1024, end_id: int = 2, vocabulary: str | None = None, **options) -> DataFrame:
    """Tokenise whole texts (null: empty, one end id), cut what is longer than ``capacity`` and pack all pieces. A null id stays null.
    Other columns of ``docs`` are ignored."""
    return pack(token_pieces(docs, capacity, end_id, vocabulary or default_path()), capacity, **options)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
