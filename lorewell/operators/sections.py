"""Documents -> sections -> chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..config import DEFAULT, Config
from ..functions.splitter import split_body
from ..functions.tables import linearize, linearize_tables
from ..functions.text import needs_split, none_if_blank, normalize_newlines, strip

# Fixed value: a heading line; blanks are Unicode blanks, and the title ends at a line feed only.
HEADING = r"(?Ud)^\s*(#{1,6})\s+(.+)"


def split_by_headings(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, file_title, md_content) -> (doc_id, sec_no, level, title, body, file_title, parent_title), and those columns of the document that ``keep`` names.

    One exchange, on doc_id: the fence count, the section number, the enclosing titles and the section's text all need the lines of one document in order.
    A line that begins with a fence mark opens or closes a code block; headings count outside of blocks only. What stands before the first heading has
    the file's title and is dropped if blank.
    """
    order = Window.partitionBy("doc_id").orderBy("line_no")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    lines = docs.select("doc_id", "file_title", *keep, F.posexplode(F.split(normalize_newlines(F.coalesce("md_content", F.lit(""))), "\n")).alias("line_no", "line"))
    marked = strip(F.col("line"))
    fenced = F.sum((marked.startswith("```") | marked.startswith("~~~")).cast("int")).over(upto) % 2 == 1
    lines = lines.withColumn("fenced", fenced)
    is_heading = ~F.col("fenced") & F.col("line").rlike(HEADING)
    lines = lines.withColumns({
        "level": F.when(is_heading, F.length(F.regexp_extract("line", HEADING, 1))),
        "heading": F.when(is_heading, strip(F.regexp_extract("line", HEADING, 2))),
    })
    lines = lines.withColumn("sec_no", F.sum(F.col("level").isNotNull().cast("int")).over(upto).cast("int"))
    above = [F.last(F.when(F.col("level") <= i, F.when(F.col("heading") != "", F.col("heading"))), ignorenulls=True).over(before) for i in range(1, 6)]
    lines = lines.withColumn("parent", F.element_at(F.array(F.lit(None).cast("string"), *above), F.coalesce(F.col("level"), F.lit(1))))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("level").isNull(), F.struct("line_no", "line")))), lambda x: x["line"]), "\n")
    sections = lines.groupBy("doc_id", "sec_no").agg(F.first("file_title").alias("file_title"), F.max("level").alias("level"), F.max("heading").alias("heading"), F.max("parent").alias("parent"), strip(body).alias("body"), *[F.first(c).alias(c) for c in keep])
    title = F.coalesce(none_if_blank(F.col("heading")), F.col("file_title"))
    return sections.filter((F.col("heading").isNotNull() & (F.col("heading") != "")) | (F.col("body") != "")).select("doc_id", "sec_no", F.coalesce("level", F.lit(0)).alias("level"), title.alias("title"), "body", "file_title", F.coalesce("parent", title).alias("parent_title"), *keep)


def split_long_sections(sections: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Sections whose title and body exceed the limit in numbered parts; tables are put into sentences first. Only long rows leave the JVM."""
    size = config.max_content_length
    sections = sections.withColumn("body", linearize_tables(F.col("body")))
    long = needs_split(F.col("title"), F.col("body"), size)
    # nondeterministic and exploded with null rows kept, or Spark pushes the whole expression into a filter too and runs it twice
    as_udf = F.pandas_udf(_split_series, "array<string>").asNondeterministic()
    room = F.lit(size) - F.length("title") - 2
    parts = F.when(long, as_udf(F.when(long, F.col("body")), F.when(long, room))).otherwise(F.array("body"))
    pieces = sections.withColumn("_parts", parts).withColumn("_parts", F.when(F.size("_parts") > 1, F.col("_parts")).otherwise(F.array("body")))
    out = pieces.select(*[c for c in sections.columns if c != "body"], F.size("_parts").alias("_n"), F.posexplode_outer("_parts").alias("part_no", "body"))
    return out.withColumn("title", F.when(F.col("_n") > 1, F.concat("title", F.lit("("), F.col("part_no") + 1, F.lit(")"))).otherwise(F.col("title"))).drop("_n")


def _split_series(bodies: pd.Series, rooms: pd.Series) -> pd.Series:
    return pd.Series([None if b is None else split_body(b, int(r)) for b, r in zip(bodies, rooms)])


def merge_short_sections(sections: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """A section with a short body takes in those after it while they share its parent and the whole stays within the limit. One pass over each document's
    lengths and parents numbers the groups; the texts are joined once. ``chunk_sections`` does the same without a second exchange, which the numbers cost here."""
    if "part_no" not in sections.columns:
        sections = sections.withColumn("part_no", F.lit(0))
    rows = F.array_sort(F.collect_list(F.struct("sec_no", "part_no", "title", "body", "parent_title")))
    per_doc = sections.groupBy("doc_id").agg(F.first("file_title").alias("file_title"), rows.alias("rows"))
    number = F.pandas_udf(_groups(config.min_content_length, config.max_content_length), "array<int>").asNondeterministic()
    numbered = per_doc.withColumn("group", number(F.transform("rows", lambda r: F.length(r["body"])), F.transform("rows", lambda r: r["parent_title"])))
    each = numbered.select("doc_id", "file_title", F.posexplode_outer(F.arrays_zip("rows", "group")).alias("at", "x")).select("doc_id", "file_title", "at", F.col("x.group").alias("sec_no"), "x.rows.title", "x.rows.body", "x.rows.parent_title")
    parts = F.array_sort(F.collect_list(F.struct("at", "title", "body")))
    whole = each.groupBy("doc_id", "sec_no").agg(F.first("file_title").alias("file_title"), F.first("parent_title").alias("parent_title"), parts.alias("parts"))
    join = lambda c, by: F.array_join(F.transform("parts", lambda x: x[c]), by).alias(c)
    return whole.select("doc_id", "sec_no", join("title", " / "), join("body", "\n\n"), "file_title", "parent_title")


def _groups(short: int, limit: int):
    def number(lengths: pd.Series, parents: pd.Series) -> pd.Series:
        out = []
        for sizes, own in zip(lengths, parents):
            group, held, of, open_ = -1, 0, None, False
            mine = []
            for n, parent in zip(sizes, own):
                if open_ and parent == of and held + n + 2 <= limit:
                    held += n + 2
                else:
                    group, held, of, open_ = group + 1, n, parent, n <= short
                mine.append(group)
            out.append(mine)
        return pd.Series(out)

    return number


def chunk_document(titles: list[str], bodies: list[str], parents: list[str], config: Config) -> Iterator[tuple[str, str, str]]:
    """(title, content, parent) of a document's chunks: its sections with tables as sentences, long ones in parts, short ones taken together."""
    held: list | None = None  # titles, bodies, length, parent, and whether it takes more
    for title, body, parent in zip(titles, bodies, parents):
        if "<table>" in body:
            body = linearize(body)
        room = config.max_content_length - len(title) - 2
        pieces = split_body(body, room) if 0 < room < len(body) else []
        for name, text in [(f"{title}({k})", p) for k, p in enumerate(pieces, 1)] if len(pieces) > 1 else [(title, body)]:
            if held and held[4] and parent == held[3] and held[2] + len(text) + 2 <= config.max_content_length:
                held[0].append(name), held[1].append(text)
                held[2] += len(text) + 2
                continue
            if held:
                yield _chunk(held)
            held = [[name], [text], len(text), parent, len(text) <= config.min_content_length]
    if held:
        yield _chunk(held)


def _chunk(held: list) -> tuple[str, str, str]:
    title = " / ".join(held[0])
    return title, "## " + title + "\n\n" + "\n\n".join(held[1]), held[3]


def chunk_sections(sections: DataFrame, config: Config = DEFAULT, keep: tuple[str, ...] = (), report: bool = False) -> DataFrame:
    """(doc_id, chunk_no, title, content, file_title, parent_title, ..) from sections: split, merged and numbered in one pass over each document, in the exchange
    that put its lines together. ``keep`` names columns of the document that its chunks have too. With ``report`` a document that can't be cut doesn't fail the
    job: it gives one row, without content, whose column ``error`` says why; for chunks that is null."""
    ordered = F.array_sort(F.collect_list(F.struct("sec_no", "title", "body", "parent_title")))
    own = ("file_title", *keep)
    per_doc = sections.groupBy("doc_id").agg(*[F.first(c).alias(c) for c in own], ordered.alias("rows"))
    each = lambda c: F.transform("rows", lambda r: r[c]).alias("_" + c)
    per_doc = per_doc.select("doc_id", *own, *map(each, ("title", "body", "parent_title")))
    kinds = {f.name: f.dataType.simpleString() for f in per_doc.schema}
    names = ["doc_id", *own, "chunk_no", "title", "content", "parent_title", *["error"] * report]

    def cut(row: list) -> list[tuple]:
        try:
            return [(*chunk, None) for chunk in chunk_document(*row, config)]
        except Exception as e:  # whatever a text does to the splitter concerns its own document only
            if not report:
                raise
            return [(None, None, None, f"{type(e).__name__}: {e}"[:500])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                made = [cut([batch.column(c)[i].as_py() for c in ("_title", "_body", "_parent_title")]) for i in range(batch.num_rows)]
                of = pa.array([i for i, rows in enumerate(made) for _ in rows], pa.int32())
                number = pa.array([k for rows in made for k in range(len(rows))], pa.int32())
                texts = [pa.array([row[j] for rows in made for row in rows], pa.string()) for j in range(3 + report)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(of) for c in ("doc_id", *own)), number, *texts], names)

    chunks = per_doc.mapInArrow(run, ", ".join([f"`{c}` {kinds[c]}" for c in names[: 1 + len(own)]] + ["chunk_no int, title string, content string, parent_title string" + ", error string" * report]))
    return chunks.select("doc_id", "chunk_no", "title", "content", "file_title", "parent_title", *keep, *["error"] * report)


def assemble_chunks(sections: DataFrame) -> DataFrame:
    """(doc_id, chunk_no, title, content, file_title, parent_title); the content opens with the title as a heading."""
    order = Window.partitionBy("doc_id").orderBy("sec_no", *(["part_no"] if "part_no" in sections.columns else []))
    content = F.concat(F.lit("## "), F.col("title"), F.lit("\n\n"), F.col("body"))
    return sections.select("doc_id", (F.row_number().over(order) - 1).alias("chunk_no"), "title", content.alias("content"), "file_title", "parent_title")


def chunk_stats(sections: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per document: sections, chunks, and the total, largest, smallest and (integer) mean length of the chunks."""
    n = F.length("content")
    per_chunk = chunks.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum(n).alias("total_chars"), F.max(n).alias("max_chars"), F.min(n).alias("min_chars"))
    counted = sections.groupBy("doc_id").agg(F.count("*").alias("sections")).join(per_chunk, "doc_id", "left")
    return counted.withColumn("mean_chars", F.expr("total_chars div chunks"))
