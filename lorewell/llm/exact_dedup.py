"""Exact duplicates by a tree-merge of sorted digest runs.

Every input partition first folds its rows into one sorted run of digests. The runs then travel through
``rounds`` of a radix-``fan_in`` butterfly (the binomial exchange, with more than two partners): in round r
the partitions whose numbers differ only in digit r swap, and each keeps the digests that have its own digit
there. Each meets ``fan_in`` sorted runs, merges them and holds, for each digest, one entry: the best row so
far and the number of rows. After the last round a digest has one entry in all. An entry carries the length and
a second, independent hash of its text: entries merge only if those agree too.

A partition never holds more than one entry for a digest, however many rows have it, so a text that is a third
of the table weighs as much as any other.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, functions as F

from .work import read_table, row_count, shuffle_count, squeezed, stored

KEY = ("digest", "n_bytes", "check")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, code points of the original text, and the digest of the text without blanks."""
    norm = squeezed(F.col(text_col))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_chars"),
        norm.alias("norm"),
    ).select("doc_id", "n_chars", F.unhex(F.sha2("norm", 256)).alias("digest"), F.octet_length("norm").cast("long").alias("n_bytes"), F.xxhash64("norm").alias("check"))


def folded(rows: DataFrame, *by: str) -> DataFrame:
    """One entry per digest: the row with most code points, then the smallest id (null last), and the number of rows."""
    return rows.groupBy(*by, *KEY).agg(F.min("best").alias("best"), F.sum("n").alias("n"))


def tree_merge(rows: DataFrame, fan_in: int | None = None) -> DataFrame:
    """``digests`` rows -> one row per digest with ``keep_id`` and ``group_size``. ``fan_in``: by default 8, or less so that there are two rounds at least."""
    slots = max(4, shuffle_count(rows.sparkSession))
    fan_in = fan_in or min(8, math.isqrt(slots))
    rounds = max(1, math.ceil(math.log(slots, fan_in)))
    # 28 bits of the digest are the number of the partition where it ends
    goal = F.conv(F.substring(F.hex("digest"), 1, 7), 16, 10).cast("long") % F.lit(fan_in**rounds)
    runs = rows.select(*KEY, F.struct((-F.col("n_chars")).alias("fewest"), F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("id")).alias("best"), F.lit(1).cast("long").alias("n"), (F.spark_partition_id() % F.lit(fan_in**rounds)).cast("long").alias("slot"))
    runs = folded(runs, "slot")
    for r in range(rounds):
        low = fan_in**r
        own = F.floor(F.col("slot") / low) % fan_in
        new = F.floor(goal / low) % fan_in
        runs = folded(runs.withColumn("slot", (F.col("slot") + (new - own) * low).cast("long")).repartition(slots, "slot"), "slot")
    return runs.select(*KEY, F.col("best.id").alias("keep_id"), F.col("n").alias("group_size"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int | None = None) -> DataFrame:
    """Texts are equal when identical after deleting ASCII blanks. Of equal texts the row with most code points in the original stays,
    then the smallest id, null last.

    Returns doc_id, keep_id, group_size, kept, text_sha256, one row per input row. A null text counts as empty; empty texts form one
    group; a repeated row (same id and text) counts in group_size each time, and each such row is reported. ``kept`` says
    whether a row has the id ``keep_id``, a null being equal to a null: if only rows without id have the most code points, ``keep_id`` is
    null, and all rows without id in that group are kept, since nothing tells them apart. Other columns are ignored,
    whatever their names. An empty table gives an empty result.
    """
    rows = stored(digests(docs, id_col, text_col), "digests")
    groups = stored(tree_merge(rows, fan_in), "digest-groups")
    many = groups.filter("group_size > 1")
    # At most `hot_groups` groups can hold more than 1/hot_groups of all rows: that side is bounded, so it is broadcast, and the other
    # join has no heavy key.
    hot_groups = 1000
    hot_size = row_count(rows) // hot_groups + 1
    hot = F.broadcast(many.filter(F.col("group_size") > hot_size).select(*KEY, F.col("keep_id").alias("hot_id"), F.col("group_size").alias("hot_n")))
    warm = many.filter(F.col("group_size") <= hot_size)
    left = rows.join(hot, list(KEY), "left")
    cold = left.filter("hot_n is null").drop("hot_id", "hot_n").join(warm, list(KEY), "left")
    both = cold.unionByName(left.filter("hot_n is not null").withColumnsRenamed({"hot_id": "keep_id", "hot_n": "group_size"}))
    # a row that met no group is alone; in a group keep_id may be null itself
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return both.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), keep.eqNullSafe(F.col("doc_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read_table(spark, sf_dir, "documents"))


SQL = {
    "op10_exact_dedup": r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
g AS (SELECT doc_id, first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size, sha256(norm) AS text_sha256 FROM d)
SELECT doc_id, keep_id, group_size, keep_id = doc_id AS kept, text_sha256 FROM g"""
}
