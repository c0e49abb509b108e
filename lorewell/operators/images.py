"""Images that documents refer to."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import DEFAULT, Config
from ..functions.links import replace_links
from ..functions.text import strip

# An image, its address in group 1, and a heading line.
_IMAGE_HEAD = r"(?U)!\[[^\]\n]*\]\(([^()\n]*(?:\([^()\n]*\)[^()\n]*)*)\)"
_HEADINGS = r"(?Um)(^#{1,6}\s+[^\n]+)"


def references(docs: DataFrame) -> DataFrame:
    """(doc_id, ref_no, syntax, name): each image in a document's text, in order, with the file name its address ends in."""
    found = F.regexp_extract_all("md_content", F.lit("(" + _IMAGE_HEAD.replace("(?U)", "") + ")"), F.lit(1))
    address = F.regexp_extract("syntax", _IMAGE_HEAD, 1)
    return docs.select("doc_id", F.posexplode(found).alias("ref_no", "syntax")).withColumn("name", F.regexp_extract(address, r"([^/\\]*)$", 1))


def references_to(docs: DataFrame, images: DataFrame, by_suffix: bool = False) -> DataFrame:
    """(doc_id, name, ref_no, syntax): the references to each image. With ``by_suffix`` an address that merely ends in the name counts, as ``data.jpg`` for
    ``a.jpg``: an equi-join on the endings of the addresses, of those lengths only that the document's image names have."""
    own = images.select("doc_id", "name").distinct()
    found = references(docs)
    if not by_suffix:
        return found.join(own, ["doc_id", "name"]).select("doc_id", "name", "ref_no", "syntax")
    sizes = own.groupBy("doc_id").agg(F.collect_set(F.length("name")).alias("sizes"))
    n = F.length("name")
    ends = F.transform(F.filter("sizes", lambda k: k <= n), lambda k: F.substr(F.col("name"), n - k + 1, k))
    ending = found.join(sizes, "doc_id").select("doc_id", "ref_no", "syntax", F.explode(ends).alias("name"))
    return ending.join(own, ["doc_id", "name"]).select("doc_id", "name", "ref_no", "syntax")


def match_images(docs: DataFrame, images: DataFrame, by_suffix: bool = False) -> tuple[DataFrame, DataFrame]:
    """(images their document refers to, images it does not)."""
    hit = references_to(docs, images, by_suffix).select("doc_id", "name").distinct()
    return images.join(hit, ["doc_id", "name"], "left_semi"), images.join(hit, ["doc_id", "name"], "left_anti")


def image_context(docs: DataFrame, images: DataFrame, config: Config = DEFAULT, by_suffix: bool = False) -> DataFrame:
    """(doc_id, name, heading, up_text, down_text) of the first reference to each image: the last heading before it and the text on either side."""
    n = config.image_context_length
    first = Window.partitionBy("doc_id", "name").orderBy("ref_no")
    refs = references_to(docs, images, by_suffix).withColumn("k", F.row_number().over(first)).filter("k = 1")
    at = F.instr(F.col("md_content"), F.col("syntax"))
    up = F.substr("md_content", F.greatest(F.lit(1), F.col("at") - n), F.least(F.lit(n), F.col("at") - 1))
    down = F.substr("md_content", F.col("at") + F.length("syntax"), F.lit(n))
    headings = F.regexp_extract_all(F.substr("md_content", F.lit(1), F.col("at") - 1), F.lit(_HEADINGS), F.lit(1))
    both = refs.join(docs.select("doc_id", "md_content"), "doc_id").withColumn("at", at)
    return both.select("doc_id", "name", F.coalesce(strip(F.try_element_at(headings, F.lit(-1))), F.lit("")).alias("heading"), up.alias("up_text"), down.alias("down_text"))


def replace_image_links(docs: DataFrame, summaries: DataFrame) -> DataFrame:
    """Documents whose images point to (summary, url) where the file name is known."""
    known = summaries.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("name", F.struct("summary", "url")))).alias("_known"))
    as_udf = F.pandas_udf(_replace_series, "string")
    both = docs.join(known, "doc_id", "left")
    has = F.col("_known").isNotNull() & F.col("md_content").contains("![")
    return both.withColumn("md_content", F.when(has, as_udf(F.when(has, F.col("md_content")), _entries("_known"))).otherwise(F.col("md_content"))).drop("_known")


def _entries(name: str) -> Column:
    return F.transform(F.map_entries(name), lambda e: F.struct(e["key"].alias("name"), e["value"]["summary"].alias("summary"), e["value"]["url"].alias("url")))


def _replace_series(texts: pd.Series, known: pd.Series) -> pd.Series:
    return pd.Series([t if k is None else replace_links(t, {e["name"]: (e["summary"], e["url"]) for e in k}) for t, k in zip(texts, known)], dtype="object")
