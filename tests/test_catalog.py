"""Every query with SQL gives the same rows as DuckDB; the others give rows."""

from __future__ import annotations

import re
import zlib

import pytest

from lorewell.catalog import registry

from .conftest import DATA, same_rows

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, str(DATA))
    if name in SQL:
        same_rows(df, duck.sql(SQL[name]))
    else:
        assert df.count() > 0


def test_names_match():
    assert set(SQL) <= set(QUERIES)


def pieces_of(text, size):
    """The published rule of recursive splitting, stated once more: cut before the coarsest separator there is, cut what is too long by the finer ones, join
    neighbours that are not while they fit."""
    seps = ["\n\n", "\n", "。", "！", "？", "；", ".", "!", "?", ";", " ", ""]

    def cut(t, level):
        while seps[level] and seps[level] not in t:
            level += 1
        sep = seps[level]
        bits = list(t) if not sep else [x for x in re.split(f"(?={re.escape(sep)})", t) if x]
        if len(sep) == 2:  # separators don't overlap
            bits = [x for x in (lambda p: [p[0], *[sep + y for y in p[1:]]])(t.split(sep)) if x]
        out, held = [], []
        for x in bits:
            if len(x) < size:
                if sum(map(len, held)) + len(x) > size:
                    out.append("".join(held))
                    held = []
                held.append(x)
                continue
            out.append("".join(held))
            held = []
            out += [x] if len(x) == size or level + 1 == len(seps) else cut(x, level + 1)
        return [*out, "".join(held)]

    return [x.strip() for x in cut(text, 0) if x.strip()]


def test_pieces_chunks_and_ingest_against_plain_loops(spark):
    """Whole tables of long_section_pieces, merged_chunks, ingest_job and embedded_documents from the sections, which SQL has checked."""
    sections = sorted((r.doc_id, r.sec_no, r.title, r.body, r.parent_title) for r in QUERIES["sections_by_heading"](spark, str(DATA)).collect())
    pieces = []
    for doc, sec, title, body, parent in sections:
        room = 2000 - len(title) - 2
        if room > 0 and len(body) > room:
            pieces += [(doc, sec, k - 1, f"{title}({k})", p, parent) for k, p in enumerate(pieces_of(body, room), 1)]
        else:
            pieces.append((doc, sec, 0, title, body, parent))
    got = sorted((r.doc_id, r.sec_no, r.part_no, r.title, r.body, r.parent_title) for r in QUERIES["long_section_pieces"](spark, str(DATA)).collect())
    assert got == pieces and any(p[2] for p in pieces)
    merged = []
    for doc in sorted({p[0] for p in pieces}):
        held = None
        for _, _, _, title, body, parent in (p for p in pieces if p[0] == doc):
            if held and held[3] == parent and len(held[2]) + len(body) + 2 <= 2000:
                held[1:3] = f"{held[1]} / {title}", f"{held[2]}\n\n{body}"
                continue
            entry = [doc, title, body, parent]
            held = entry if len(body) <= 500 else None
            merged.append(entry)
    number = {}
    chunks = []
    for d, t, b, p in merged:
        chunks.append((d, number.get(d, 0), t, f"## {t}\n\n{b}", p))
        number[d] = number.get(d, 0) + 1
    rows = sorted((r.doc_id, r.chunk_no, r.title, r.content, r.parent_title) for r in QUERIES["merged_chunks"](spark, str(DATA)).collect())
    assert rows == chunks
    token = re.compile(r"\w+")
    strip_images = lambda t: re.sub(r"!\[[^\S\n]*([^\]\n]*?)[^\S\n]*\]\([^()\n]*(?:\([^()\n]*\)[^()\n]*)*\)", r"\1", t)
    name = lambda d: f"item {d % 50}" if d % 3 == 2 else f"doc {d}"
    words = lambda t: len({zlib.crc32(x.encode()) for x in token.findall(t.lower())})
    stored = sorted((r.doc_id, r.chunk_no, r.title, r.content, r.item_name, r.dim, r.tokens) for r in QUERIES["ingest_job"](spark, str(DATA)).collect())
    assert stored == [(d, n, t, c, name(d), 64, words(f"{name(d)}\n{strip_images(c)}")) for d, n, t, c, _ in chunks]
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect() if r.text}
    embedded = {r.doc_id: (r.dim, r.tokens, r.weight) for r in QUERIES["embedded_documents"](spark, str(DATA)).collect()}
    assert embedded == {d: (64, words(t), float(len(token.findall(t.lower())))) for d, t in texts.items() if token.search(t)}


def test_whole_texts_reach_the_prompts(spark):
    texts = {str(r.doc_id): (r.text or "").strip() for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = QUERIES["merged_whole_sources"](spark, str(DATA)).collect()
    local = {r.chunk_id: r.content for r in rows if r.source == "local"}
    assert local == {k: t for k, t in texts.items() if t} and max(map(len, local.values())) > 2000
    html = {r.url: r.html for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    web = [r for r in rows if r.source == "web"]
    assert web and any(r.content.count("\n") > 1 for r in web) and all(r.content.split("\n")[-1] in re.sub("<[^>]*>", "", html[r.url]) for r in web)
    prompts = [r.prompt for r in QUERIES["whole_prompts"](spark, str(DATA)).collect()]
    assert any(t in p for p in prompts for t in texts.values() if len(t) > 300)


def test_whole_texts_answer_the_questions(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = QUERIES["whole_hyde_queries"](spark, str(DATA)).collect()
    asked = {r.request_id: r.text for r in rows if r.path == "plain"}
    assert {r.request_id: r.text for r in rows if r.path == "hyde"} == {i: f"{asked[i]}\n{t if t and t.strip() else ''}" for i, t in texts.items()}
