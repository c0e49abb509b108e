"""Line-level duplicates: explode normalised lines, hash, count documents per hash, drop, reassemble by position."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from .work import BLANKS, read_table, stored

_BLANK_BYTES = BLANKS.encode()


def _keys(text: bytes | None) -> list[bytes]:
    """The key of each line: blanks stripped at both ends, A-Z lower-cased (bytes.lower touches ASCII only)."""
    return [x.strip(_BLANK_BYTES).lower() for x in (text or b"").split(b"\n")]


def _long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode("utf-8", "replace")) >= min_chars)


def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """(h1, h2, doc_id): each distinct key of each document once, as 128 bits."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, seen = [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                own = {xxhash.xxh3_128_digest(k) for k in _keys(text) if _long_enough(k, min_chars)}
                ids += [doc] * len(own)
                seen += own
            h = np.frombuffer(b"".join(seen), dtype="<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), pa.array(ids, pa.int64())], ["h1", "h2", "doc_id"])

    return docs.mapInArrow(explode, "h1 long, h2 long, doc_id long")


def line_dedup(docs: DataFrame, min_docs: int = 5, min_chars: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Lines are split at ``\\n``; a key of at least ``min_chars`` code points found in at least ``min_docs`` documents loses all its lines
    except in the largest id that holds it. What stays is joined by ``\\n``.

    Returns all columns of ``docs`` with the text replaced by ``kept_text``'s content under that name, plus ``n_lines`` (before) and
    ``n_dropped``. A null or empty text is one empty line, whose kept text is ''. Rows that repeat an id count as one document for
    ``min_docs`` and are all cleaned alike; a null id is never a holder, and its rows are left as they are. Existing columns named like
    the new ones are replaced.

    Shuffles: the key hashes once (32 bytes a line, folded map-side), the keys of common lines with the documents that hold them, and the
    texts once to meet their list of dropped keys. The second is a plain join on the hash, which AQE splits when one line is in a third of
    all documents.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ids_repeat = not slim.groupBy("doc_id").count().filter("doc_id is not null and count > 1").isEmpty()
    lines = line_hashes(slim.filter(f"doc_id is not null and octet_length(text) >= {min_chars}"), min_chars)
    # written, since they are read twice and the texts are hashed once
    lines = stored(lines.distinct() if ids_repeat else lines, "line-hashes")
    common = lines.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc_id").alias("keep_id")).filter(F.col("n") >= min_docs)
    # written, so that both sides of the join are plain exchanges, which AQE can split at a hot line
    common = stored(common.select("h1", "h2", "keep_id"), "common-lines")
    drops = lines.join(common, ["h1", "h2"]).filter("doc_id <> keep_id").groupBy(F.col("doc_id").alias("_drop_id")).agg(F.collect_set(F.struct("h1", "h2")).alias("_drop"))
    base = docs.drop("kept_text", "n_lines", "n_dropped", "_drop", "_drop_id").withColumn("_text", F.col(text_col))
    joined = base.join(drops, F.col(id_col).cast("long") == F.col("_drop_id"), "left").withColumn("_kept", _clean(min_chars)("_text", "_drop"))
    return joined.withColumns({"kept_text": F.col("_kept.kept_text"), "n_lines": F.col("_kept.n_lines"), "n_dropped": F.col("_kept.n_dropped")}).drop("_text", "_kept", "_drop", "_drop_id")


def _clean(min_chars: int):

    @F.pandas_udf("kept_text string, n_lines long, n_dropped long")
    def clean(text: pd.Series, drop: pd.Series) -> pd.DataFrame:
        kept, n_lines, n_dropped = [], [], []
        for t, gone in zip(text, drop):
            if gone is None or not len(gone):
                kept.append(t or "")
                n_lines.append((t or "").count("\n") + 1)
                n_dropped.append(0)
                continue
            gone = {np.array([x["h1"], x["h2"]], "<i8").tobytes() for x in gone}
            raw = t.encode()
            parts = raw.split(b"\n")
            stay = [p for p, k in zip(parts, _keys(raw)) if not (_long_enough(k, min_chars) and xxhash.xxh3_128_digest(k) in gone)]
            kept.append(b"\n".join(stay).decode())
            n_lines.append(len(parts))
            n_dropped.append(len(parts) - len(stay))
        return pd.DataFrame({"kept_text": kept, "n_lines": n_lines, "n_dropped": n_dropped})

    return clean


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup(read_table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=5, min_chars=40)
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = {
    "op8_line_dedup": r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS keep_id FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, c.keep_id IS NOT NULL AND c.keep_id <> k.doc_id AS gone FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id"""
}
