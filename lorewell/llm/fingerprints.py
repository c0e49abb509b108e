"""Document fingerprints: a canonical exact digest, in DataFrame functions only.

Canonical form: compatibility composition (NFKC), full case folding, composition again, then every run of white space one blank and none at the
ends. Spark bundles ICU for its collations, and the SQL function ``reflect`` calls its normaliser; texts of ASCII alone need only ``lower``.
The fingerprint is 128 bits of xxhash64 (two seeds). Texts meet in buckets of equal 128 bits, where their bytes are compared; should two
different canonical texts ever share a bucket, the fingerprints in it are extended by SHA-256 of the canonical text, which each row carries.

An exact digest knows no degrees: the likeness of two fingerprints is 1 if they are equal, else 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .work import drop, read_table, row_count, shuffle_count, small, stored

SECOND_SEED = 7_046_029_254_386_353_131
#: Rows without id that a task takes together, about.
SLICE_ROWS = 4096


def canonical(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    compose = lambda c: F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    fold = lambda c: F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), c, F.lit(True))
    folded = F.when(F.length(t) == F.octet_length(t), F.lower(t)).otherwise(compose(fold(compose(t))))
    return F.regexp_replace(F.regexp_replace(folded, r"(?U)\s+", " "), "^ | $", "")


def wide(canon: Column, bits: int = 128) -> Column:
    """(h1, h2, s): the two hashes, of which fewer than 128 ``bits`` may be kept, and SHA-256."""
    h1, h2 = F.xxhash64(canon), F.xxhash64(F.lit(SECOND_SEED), canon)
    if bits < 128:
        h1, h2 = F.shiftrightunsigned(h1, 64 - min(bits, 63)), F.lit(0).cast("long")
    return F.struct(h1.alias("h1"), h2.alias("h2"), F.unhex(F.sha2(canon, 256)).alias("s"))


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """Each row of ``docs`` (doc_id, text, h) with ``next_<column>`` of the next one by descending doc_id, and ``times``; after the last comes the first.

    Rows are dealt by ranges of ids (one shuffle); the first row of each range also visits the range before it, as its last row's neighbour. Rows that repeat an id
    follow each other in the order of their hashes, in one range. Rows without id come behind the least id, in the order of their hashes: equal ones are one row, which
    is followed by itself ``times`` less one, and the rest is dealt by slices of the hash, so that neither many of them nor many copies meet in one task.
    """
    spark = docs.sparkSession
    named = docs.filter("doc_id is not null")
    lost = stored(docs.filter("doc_id is null").groupBy("h", "text").agg(F.count("*").alias("times")), "rows-without-id")
    n = shuffle_count(spark)
    cuts = sorted({int(x) for x in (named.select("doc_id").approxQuantile("doc_id", [i / n for i in range(1, n)], 0.25 / n) if n > 1 else [])})
    side = max(1, round(len(cuts) ** 0.5))
    lots = [cuts[i : i + side] for i in range(0, len(cuts), side)] or [[]]
    below = lambda bounds: F.size(F.filter(bounds, lambda b: b <= F.col("doc_id")))
    if cuts:
        arr = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
        lot = below(arr([x[0] for x in lots]))
        fine = F.element_at(F.array(*[arr(x) for x in lots]), F.greatest(lot, F.lit(1)))
        spot = F.when(lot == 0, F.lit(0)).otherwise((lot - 1) * side + below(fine))
    else:
        spot = F.lit(0)
    placed = named.withColumns({"times": F.lit(1).cast("long"), "_range": spot.cast("int")})
    tops = placed.groupBy("_range").agg(F.max("doc_id").alias("top")).collect()  # a row per range
    chain = [(r["_range"], r["top"]) for r in sorted(tops, key=lambda r: -r["_range"])]
    some = row_count(lost) > 0
    if some:
        slices = -(-row_count(lost) // SLICE_ROWS)
        # by the upper bits of the hash, as a share of all that it can be
        of_hash = F.least(F.lit(slices - 1), F.floor((F.col("h.h1") / F.lit(2.0**64) + 0.5) * slices)).cast("int")
        spread = lost.select(F.lit(None).cast("long").alias("doc_id"), "text", "h", "times", (-1 - of_hash).alias("_range"))
        mark = F.struct("h.h1", "h.h2", F.xxhash64("text").alias("t"))
        firsts = spread.groupBy("_range").agg(F.min(mark).alias("first")).collect()  # a row per slice
        chain += [(r["_range"], tuple(r["first"])) for r in sorted(firsts, key=lambda r: -r["_range"])]
    # what comes first in a range visits the range before; what comes first of all, the last
    visits = [(key, before) for (before, _), (_, key) in zip([*chain[-1:], *chain], chain)]
    by_id = spark.createDataFrame([(k, r) for k, r in visits if not isinstance(k, tuple)], "doc_id long, visits int").groupBy("doc_id").agg(F.collect_list("visits").alias("_visits"))
    rows = placed.join(F.broadcast(by_id), "doc_id", "left")
    if some:
        by_hash = spark.createDataFrame([(*k, r) for k, r in visits if isinstance(k, tuple)], "k1 long, k2 long, kt long, visits int").groupBy("k1", "k2", "kt").agg(F.collect_list("visits").alias("_visits"))
        is_first = (F.col("h.h1") == F.col("k1")) & (F.col("h.h2") == F.col("k2")) & (F.xxhash64("text") == F.col("kt"))
        rows = rows.unionByName(spread.join(F.broadcast(by_hash), is_first, "left").drop("k1", "k2", "kt"))
    seats = F.concat(F.array(F.struct(F.lit(0).alias("guest"), F.col("_range").alias("r"))), F.coalesce(F.transform("_visits", lambda v: F.struct(F.lit(1).alias("guest"), v.alias("r"))), F.array().cast("array<struct<guest:int,r:int>>")))
    w = Window.partitionBy("_seat.r").orderBy("_seat.guest", F.desc_nulls_last("doc_id"), "h.h1", "h.h2", F.xxhash64("text"))
    seated = rows.withColumn("_seat", F.explode(seats)).drop("_range", "_visits")
    out = seated.withColumns({f"next_{c}": F.lead(c).over(w) for c in columns}).filter("_seat.guest = 0").drop("_seat")
    if not some:
        return out
    last = F.struct(F.lit(1).cast("long").alias("times"), *[F.col(f"next_{c}") for c in columns])
    copies = F.struct((F.col("times") - 1).alias("times"), *[F.col(c).alias(f"next_{c}") for c in columns])
    return out.select(*docs.columns, F.inline(F.array(last, copies))).filter("times > 0")


def edited_text() -> Column:
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    return F.concat(F.substr("text", F.lit(1), (F.col("n_chars") - cut).cast("int")), F.substr(F.coalesce("next_text", F.lit("")), F.lit(1), cut))


def fingerprint_text(h: str) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(f"{h}.h1"), 16, "0"), F.lpad(F.hex(f"{h}.h2"), 16, "0")))


def clashing(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """(h1, h2) of the buckets that hold different canonical texts, stored. Their SHA-256 are compared in every bucket, and in those with more than one row
    whose SHA-256 agree the bytes of all that have an id, too."""
    both = marks.select("doc_id", F.lit(0).alias("edited"), "h.*").unionByName(marks.select("doc_id", F.lit(1).alias("edited"), "e.*"))
    crowded = stored(both.groupBy("h1", "h2").agg(F.count("*").alias("n"), (F.min("s") != F.max("s")).alias("apart")).filter("n > 1"), "crowded-buckets")
    members = both.filter("doc_id is not null").join(crowded.filter("not apart").select("h1", "h2"), ["h1", "h2"], "left_semi")
    own = members.groupBy("doc_id").agg(F.max("edited").alias("edited"), F.min("edited").alias("plain"))
    who = stored(own.join(marks.select("doc_id", "next_doc_id", F.struct("h.h1", "h.h2").alias("h"), F.struct("e.h1", "e.h2").alias("e")).distinct(), "doc_id"), "bucket-members")
    wanted = stored(who.select("doc_id").unionByName(who.filter("edited = 1").select(F.col("next_doc_id").alias("doc_id"))).distinct(), "bucket-texts")
    texts = docs.select("doc_id", "text").join(small(wanted), "doc_id", "left_semi")
    mine = texts.join(who, "doc_id")
    plain = mine.filter("plain = 0").select("h", canonical(F.col("text")).alias("canon"))
    after = texts.select(F.col("doc_id").alias("next_doc_id"), F.col("text").alias("next_text"))
    changed = mine.filter("edited = 1").withColumn("n_chars", F.length("text")).join(after, "next_doc_id").select(F.col("e").alias("h"), canonical(edited_text()).alias("canon"))
    # distinct (bucket, text) first: copies of one text fold before they are shuffled
    bytes_apart = plain.unionByName(changed).distinct().groupBy("h").count().filter("count > 1").select("h.h1", "h.h2")
    bad = stored(crowded.filter("apart").select("h1", "h2").unionByName(bytes_apart).distinct(), "clashes")
    drop(who, wanted, crowded)
    return bad


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 128) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text replaces the last third (rounded down) of the code points by the first as many of the next document by descending id. A null
    text counts as empty; the fingerprint of an empty text is that of ''. A single document is its own next one. Rows that repeat an id each
    get a row and follow each other in the order of their hashes; rows without id come last, likewise. Other columns are ignored; an empty table gives
    an empty result. ``bits`` below 128 shortens the hashes.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = with_next(slim.withColumn("canon", canonical(F.col("text"))).withColumn("h", wide(F.col("canon"), bits)).drop("canon"), ["doc_id", "text", "h"])
    marks = rows.withColumn("n_chars", F.length("text").cast("long")).withColumn("edited", edited_text())
    marks = marks.select("doc_id", "next_doc_id", "times", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "h", canonical(F.col("edited")).alias("canon"), F.col("next_h").alias("n"))
    marks = stored(marks.withColumn("e", wide(F.col("canon"), bits)).drop("canon"), "fingerprints")
    bad = clashing(slim, marks)
    out = marks.withColumns({k: fingerprint_text(h) for k, h in (("fingerprint", "h"), ("edited_fingerprint", "e"), ("next_fingerprint", "n"))})
    if row_count(bad):
        for k, h in (("fingerprint", "h"), ("edited_fingerprint", "e"), ("next_fingerprint", "n")):
            mark = small(bad).select(F.col("h1").alias("_1"), F.col("h2").alias("_2"), F.lit(True).alias("_bad"))
            out = out.join(mark, (F.col(f"{h}.h1") == F.col("_1")) & (F.col(f"{h}.h2") == F.col("_2")), "left")
            out = out.withColumn(k, F.when(F.col("_bad"), F.concat_ws(":", k, F.lower(F.hex(f"{h}.s")))).otherwise(F.col(k))).drop("_1", "_2", "_bad")
    out = out.withColumn("times", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", (F.col("fingerprint") == F.col("edited_fingerprint")).cast("double").alias("near_edited"), (F.col("fingerprint") == F.col("next_fingerprint")).cast("double").alias("near_next"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(read_table(spark, sf_dir, "documents"))
