"""Scalar text functions, all JVM-side. White space is Unicode white space, as in the rules they restate."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from ..schemas import EXTRACTION, WEB_REPLY

#: Fixed value: image syntax with one nested pair of brackets in the address; group 1 is the alt text without outer blanks.
IMAGE = r"!\[[^\S\n]*([^\]\n]*?)[^\S\n]*\]\([^()\n]*(?:\([^()\n]*\)[^()\n]*)*\)"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def is_blank(c: Column) -> Column:
    """True for null, empty and white space."""
    return c.isNull() | (strip(c) == "")


def none_if_blank(c: Column) -> Column:
    return F.when(~is_blank(c), c)


def normalize_newlines(c: Column) -> Column:
    return F.regexp_replace(c, "\r\n?", "\n")


def strip_image_syntax(c: Column) -> Column:
    """Images become their alt text."""
    return F.regexp_replace(c, "(?U)" + IMAGE, "$1")


def extract_images(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit("(?U)(" + IMAGE + ")"), F.lit(1))


def needs_split(title: Column, body: Column, max_length: int) -> Column:
    """True where title, blank line and body exceed the limit and the title leaves room for a body."""
    head = F.length(title) + 2
    return (head + F.length(body) > max_length) & (head < max_length)


def embedding_input(item: Column, content: Column) -> Column:
    return F.concat(F.coalesce(item, F.lit("")), F.lit("\n"), strip_image_syntax(F.coalesce(content, F.lit(""))))


def valid_inputs(df: DataFrame, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows with text, rows without, with a reason)."""
    blank = is_blank(F.col(text_col))
    return df.filter(~blank), df.filter(blank).withColumn("reason", F.lit("blank text"))


def object_url(base: Column, bucket: Column, doc: Column, name: Column) -> Column:
    """base/bucket/doc/name with both segments percent-encoded."""

    def quoted(c: Column) -> Column:
        c = F.url_encode(c)
        for a, b in (("+", "%20"), ("%2F", "/"), ("*", "%2A"), ("%7E", "~")):
            c = F.replace(c, F.lit(a), F.lit(b))
        return c

    return F.concat_ws("/", base, bucket, quoted(doc), quoted(name))


def resolve_item_name(answer: Column, title: Column) -> Column:
    """The title stands in for a missing answer and for UNKNOWN."""
    said = strip(answer)
    return F.when(answer.isNull() | said.isin("", "UNKNOWN"), title).otherwise(said)


def parse_extraction(raw: Column, original: Column) -> Column:
    """struct(item_names, rewritten_query) of a reply in JSON, with or without a code fence. What is malformed or missing gives no names and the
    original query."""
    bare = F.regexp_replace(F.regexp_replace(strip(raw), r"^```(?:json)?\s*", ""), r"\s*```$", "")
    reply = F.from_json(bare, EXTRACTION, {"mode": "PERMISSIVE"})
    names = F.filter(reply["item_names"], lambda n: n.isNotNull())
    return F.struct(
        F.coalesce(names, F.array().cast("array<string>")).alias("item_names"),
        F.coalesce(none_if_blank(reply["rewritten_query"]), original).alias("rewritten_query"),
    )


def parse_web_results(df: DataFrame, raw_col: str = "raw") -> DataFrame:
    """(request_id, pos, snippet, title, url) from replies {"pages": [...]}; bad JSON gives no row."""
    reply = F.from_json(F.col(raw_col), WEB_REPLY)
    pages = df.select("request_id", F.posexplode(reply["pages"]).alias("pos", "page"))
    text = lambda k: strip(F.coalesce(F.col(f"page.{k}"), F.lit(""))).alias(k)
    return pages.filter("page is not null").select("request_id", "pos", text("snippet"), text("title"), text("url"))


def render_prompt(template: str, **values: Column) -> Column:
    """The template with its {names} replaced; a null value is left empty. Doubled braces stand for braces."""
    parts = re.split(r"(\{\{|\}\}|\{\w+\})", template)
    cols = []
    for p in parts:
        if p in ("{{", "}}"):
            cols.append(F.lit(p[0]))
        elif len(p) > 2 and p[0] == "{":
            cols.append(F.coalesce(values[p[1:-1]], F.lit("")))
        elif p:
            cols.append(F.lit(p))
    return F.concat(*cols) if cols else F.lit("")


def format_duration(c: Column) -> Column:
    """Under a minute 12.3s, else 2m5s."""
    return F.when(c < 60, F.format_string("%.1fs", c)).otherwise(F.format_string("%dm%.0fs", F.floor(c / 60), c - F.floor(c / 60) * 60))


def prepare_requests(df: DataFrame, id_cols: list[str]) -> tuple[DataFrame, DataFrame]:
    """(requests with session and task id, rejected ones). A missing session gets an id that depends on the row's identity alone."""
    blank = is_blank(F.col("query"))
    own = lambda tag: F.sha2(F.concat_ws("\x1f", F.lit(tag), *[F.col(c).cast("string") for c in id_cols]), 256)
    ready = df.filter(~blank).withColumns({"session_id": F.coalesce(none_if_blank(F.col("session_id")), own("session")), "task_id": own("task")})
    return ready, df.filter(blank).withColumn("reason", F.lit("blank query"))
