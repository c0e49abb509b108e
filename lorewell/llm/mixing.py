"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Targets. Every source asks for its share of all words by weight; a source may give at most ``max_epochs`` times its words. Clamping the
sources that ask too much and resharing what they leave, by weight, until none is above, ends at one water level L:
target = min(cap, weight * L) with the targets adding up to all words. Sources fill up in the order of cap / weight, so L follows from
running sums over the sources sorted by that ratio, without a loop.

Repetitions. A source with target t and size s takes floor(t / s) whole copies of each document, and the rest of t from its documents in a
seeded hash order: whole documents, and of the one at the boundary as many leading words as are missing. The order is found without sorting a
source in one task: hash buckets of about ``bucket_docs`` documents, prefix sums over the buckets, and a running sum inside each. Rows without id, or many of
one id, share a bucket; one that holds over eight times its share is dealt into lots by the rows' places in a stored table, and the sums go over lots.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .work import WORD, read_table, row_count, stored


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def seeded(doc_id: Column, seed: int) -> Column:
    """60 bits that depend on the seed and the id alone, and that other engines can compute too."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), doc_id.cast("string"))), 1, 15), 16, 10).cast("long")


def water_fill(sources: DataFrame, max_epochs: int = 3) -> DataFrame:
    """(source, source_size, weight) -> the same with ``target``. One row per source: a table of sources, not of documents, is ordered here."""
    cap, ratio = F.col("source_size") * F.lit(max_epochs), F.col("cap") / F.col("weight")
    order = Window.orderBy("ratio", "source_key")
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    level = (F.col("total") - F.col("cap_before")) / (F.col("weights") - F.col("weight_before"))
    return (
        sources.withColumn("cap", cap)
        .withColumn("ratio", ratio)
        .withColumns({
            "total": F.sum("source_size").over(whole),
            "weights": F.sum("weight").over(whole),
            "cap_before": F.coalesce(F.sum("cap").over(upto), F.lit(0)),
            "weight_before": F.coalesce(F.sum("weight").over(upto), F.lit(0)),
        })
        .withColumn("level", level)
        # the first source in this order that can bear the level reached there sets it for all that follow
        .withColumn("water", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "source_key", "level"))).over(whole)["level"])
        .withColumn("target", F.least(F.col("cap").cast("double"), F.col("weight") * F.coalesce(F.col("water"), F.col("ratio"))))
        .select("source_key", "source_size", "n_docs", "weight", "target")
    )


def in_lots(placed: DataFrame, room: int) -> DataFrame:
    """``placed`` (source_key, bucket, _place, ..) with ``lot``, of about ``room`` rows; a bucket with no more than that is one lot."""
    # one in ``room`` rows at most
    full = stored(placed.groupBy("source_key", "bucket").count().filter(F.col("count") > room).select("source_key", "bucket", F.ceil(F.col("count") / room).alias("lots")), "full-buckets")
    if not row_count(full):
        return placed.withColumn("lot", F.lit(0).cast("long"))
    return placed.join(full, ["source_key", "bucket"], "left").withColumn("lot", F.pmod("_place", F.coalesce("lots", F.lit(1)))).drop("lots")


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3, seed: int = 17, bucket_docs: int = 2000, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken, copies (whole repetitions) and part (leading words of one more).

    Sources in code-point order, null last, weigh ``weights`` in turn. A null text has size 0; a source without words gets target 0 and its
    documents take nothing; an empty table gives an empty result. Rows that repeat an id are documents of their own; equal rows of one
    source take their words in no particular order, the sum being the same. Other columns are ignored, but ``row_col``, which tells rows
    apart, is passed through if given. Reruns agree, whatever the partitioning; only where thousands of rows have no id, or one id, do they depend on the order of
    the input too.
    """
    own = [row_col] if row_col else []
    key = F.struct(F.col("source").isNull().alias("last"), F.coalesce("source", F.lit("")).alias("name"))
    rows = stored(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), seeded(F.col(id_col), seed).alias("u"), *own).withColumns({"source_key": key, "_place": F.xxhash64(F.monotonically_increasing_id())}).drop("source"), "mix-sizes")
    sources = rows.groupBy("source_key").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    turn = (F.row_number().over(Window.orderBy("source_key")) - 1) % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int"))
    plan = stored(water_fill(sources.withColumn("weight", weight.cast("long")), max_epochs), "mix-plan")
    plan = plan.select("source_key", "source_size", "target", (F.floor(F.col("n_docs") / bucket_docs) + 1).alias("buckets"), F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long").alias("copies"))
    plan = plan.withColumn("rest", F.round(F.col("target") - F.col("copies") * F.col("source_size")).cast("long"))

    # the plan has a row per source: small, and AQE splits a join whose key is a hot source
    placed = rows.join(plan, "source_key").withColumn("bucket", F.pmod(F.shiftright("u", 8), F.col("buckets")))
    placed = in_lots(placed, 8 * bucket_docs)
    lot = ["source_key", "bucket", "lot"]
    sums = placed.groupBy(*lot).agg(F.sum("size").alias("lot_size"))
    before = F.coalesce(F.sum("lot_size").over(Window.partitionBy("source_key").orderBy("bucket", "lot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumn("lot_before", before).drop("lot_size")
    inner = Window.partitionBy(*lot).orderBy("u", "doc_id", "size", *own).rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.col("lot_before") + F.coalesce(F.sum("size").over(inner), F.lit(0))
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("rest") - F.col("ahead")))
    return (
        placed.join(sums, lot)
        .withColumn("ahead", ahead)
        .withColumn("part", part)
        .select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size") + F.col("part")).alias("taken"), "copies", "part", *own)
    )


def apply_mix(docs: DataFrame, mixed: DataFrame, on: str = "doc_id") -> DataFrame:
    """The mixed corpus: each document as often as ``mixed`` says, with the columns of ``docs``; a partial copy keeps its leading words and the
    blanks between them, and ``n_chars`` follows its text. ``on`` names the column that tells the rows of both apart: it must be
    unique and not null."""
    words = F.regexp_extract_all("text", F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"))
    size, copies, part = (F.col(f"_mix_{c}") for c in ("size", "copies", "part"))  # a document's own columns of these names pass by
    whole = F.when((part == size) & (part > 0), copies + 1).otherwise(copies)
    cut = F.when((part > 0) & (part < size), F.array(F.array_join(F.slice(words, 1, part.cast("int")), ""))).otherwise(F.array().cast("array<string>"))
    texts = F.concat(F.array_repeat("text", whole.cast("int")), cut)
    both = docs.join(mixed.select(on, *[F.col(c).alias(f"_mix_{c}") for c in ("size", "copies", "part")]), on).withColumn("text", F.explode(texts))
    return both.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


SQL = {
    "op5_mixing": r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, ('0x' || substr(md5('17:' || doc_id), 1, 15))::BIGINT AS u FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n_docs, 3 * sum(size)::BIGINT AS cap,
             [5, 2, 1][1 + (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3]::BIGINT AS weight FROM d GROUP BY source),
r AS (SELECT *, cap / weight AS ratio, sum(source_size) OVER ()::BIGINT AS total, sum(weight) OVER ()::BIGINT AS weights,
             coalesce(sum(cap) OVER o, 0)::BIGINT AS cap_before, coalesce(sum(weight) OVER o, 0)::BIGINT AS weight_before
      FROM s WINDOW o AS (ORDER BY cap / weight, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (total - cap_before) / (weights - weight_before) AS level FROM r),
t AS (SELECT *, least(cap::DOUBLE, weight * (SELECT level FROM l WHERE level <= ratio ORDER BY ratio, source IS NULL, encode(source) LIMIT 1)) AS target FROM l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS copies, n_docs // 2000 + 1 AS buckets FROM t),
x AS (SELECT d.doc_id, d.size, p.source_size, p.target, p.copies, round(p.target - p.copies * p.source_size)::BIGINT AS rest,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY (d.u >> 8) % p.buckets, d.u, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, copies * size + greatest(0, least(size, rest - ahead)) AS taken, copies, greatest(0, least(size, rest - ahead)) AS part FROM x"""
}
