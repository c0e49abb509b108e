"""Hand-made cases of the rules, and random ones against plain statements of them."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from lorewell.config import Config
from lorewell.functions.blocks import Best, DenseQueries, SparseQueries
from lorewell.functions.links import protect_images, repair_links, replace_links, restore_images
from lorewell.functions.splitter import split_body, split_text
from lorewell.functions.tables import _Cells, linearize, spread, table_is_complex
from lorewell.operators.context import build_prompts, format_documents
from lorewell.operators.fusion import cliff_cutoff, normalize_hits, rerank, rrf
from lorewell.operators.images import image_context, match_images, replace_image_links
from lorewell.operators.items import align_item_names, filter_confirmed
from lorewell.operators.sections import assemble_chunks, merge_short_sections, split_by_headings, split_long_sections
from lorewell.operators.tasklog import request_rate, task_rollup
from lorewell.operators import vectors
from lorewell.operators.vectors import dense_topk, embed, sparse_topk, validate_vectors


def docs(spark, *texts, title="M"):
    return spark.createDataFrame([(i, title, t) for i, t in enumerate(texts)], "doc_id long, file_title string, md_content string")


def test_headings(spark):
    text = "intro\n# A\na1\n~~~\n# not a heading\n~~~\n### B\nb1\n## C\nc1"
    rows = split_by_headings(docs(spark, text)).orderBy("sec_no").collect()
    assert [(r.title, r.parent_title, r.body) for r in rows] == [("M", "M", "intro"), ("A", "A", "a1\n~~~\n# not a heading\n~~~"), ("B", "A", "b1"), ("C", "A", "c1")]
    merged = merge_short_sections(split_by_headings(docs(spark, text)))
    chunks = assemble_chunks(merged).orderBy("chunk_no").collect()
    assert [c.title for c in chunks] == ["M", "A / B / C"] and chunks[1].content.startswith("## A / B / C\n\na1")


def test_headings_at_the_edges(spark):
    cases = ["", None, "no heading", "####### seven\n# ", "　# wide\r\nbody\r# next\r\n"]
    rows = {}
    for r in split_by_headings(docs(spark, *cases)).orderBy("doc_id", "sec_no").collect():
        rows.setdefault(r.doc_id, []).append((r.title, r.body))
    assert 0 not in rows and 1 not in rows
    assert rows[2] == [("M", "no heading")]
    assert rows[3] == [("M", "####### seven\n#")]
    assert rows[4] == [("wide", "body"), ("next", "")]


def test_long_section(spark):
    image = "![alt](http://x/" + "y" * 90 + ".png)"
    text = "# T\n" + "one two three. " * 20 + image + " tail"
    rows = split_long_sections(split_by_headings(docs(spark, text)), Config(max_content_length=60, min_content_length=10)).orderBy("part_no").collect()
    assert [r.title for r in rows] == [f"T({i + 1})" for i in range(len(rows))] and len(rows) > 3
    assert sum(image in r.body for r in rows) == 1
    assert all(len(r.body) <= 57 or image in r.body for r in rows)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .\n。;!?", max_size=300), st.integers(1, 40))
def test_splitter_loses_blanks_only(text, size):
    parts = split_text(text, size)
    assert all(0 < len(p) <= size and p == p.strip() for p in parts)
    squeeze = lambda s: "".join(s.split())
    assert squeeze("".join(parts)) == squeeze(text)


def test_images_round_trip():
    text = "a ![x](u (1).png) b ![y](v) c"
    held, images = protect_images(text)
    assert "![" not in held and restore_images(held, images) == text
    assert restore_images("%%KBIMG9%%", images) == "%%KBIMG9%%"
    assert split_body(text, 500) == [text]


def test_merge_against_a_plain_loop(spark):
    rng = random.Random(5)
    rows = [(d, i, f"t{i}", "x" * rng.choice([0, 3, 9, 20, 39]), "M", rng.choice("pq")) for d in range(60) for i in range(rng.randint(0, 8))]
    df = spark.createDataFrame(rows, "doc_id long, sec_no int, title string, body string, file_title string, parent_title string")
    got = {}
    for r in merge_short_sections(df, Config(max_content_length=40, min_content_length=10)).orderBy("doc_id", "sec_no").collect():
        got.setdefault(r.doc_id, []).append((r.title, r.body))
    for d in range(60):
        out, held = [], None
        for _, _, title, body, _, parent in (r for r in rows if r[0] == d):
            if held and held[2] == parent and len(held[1]) + len(body) + 2 <= 40:
                held = (f"{held[0]} / {title}", f"{held[1]}\n\n{body}", parent)
                continue
            out += [held] if held else []
            held = (title, body, parent) if len(body) <= 10 else None
            out += [] if held else [(title, body, parent)]
        out += [held] if held else []
        assert got.get(d, []) == [(t, b) for t, b, _ in out]


def test_tables():
    html = '<table><tr><td rowspan="12">直流电压</td><td>200mV</td><td>±(0.5%+2)</td></tr><tr><td>2000mV</td><td>±(0.5%+2)</td></tr><tr><td>20V</td><td>±(0.5%+2)</td></tr></table>'
    lines = linearize(html).strip().split("\n")
    assert table_is_complex(html)
    assert lines[0] == "- 【直流电压】(对应直流电压)：200mV为2000mV，±(0.5%+2)为±(0.5%+2)。"
    assert lines[2:] == ["- 【直流电压】"] * 9 and len(lines) == 11
    assert linearize("<table><tr><td>k</td><td>v</td></tr><tr><td></td><td>w</td></tr><tr><td>x</td><td></td></tr></table>") == "\n\n- 【k】：v。\n- 【未知属性】：w。\n- 【x】：无。\n\n"
    assert linearize("<table><tr><th>n</th><th>a</th></tr><tr><td>r</td><td>-</td></tr></table>") == "\n\n- 【r】\n\n"
    assert linearize("<table><tr><td></td><td>a</td></tr><tr><td></td><td>1</td></tr></table>") == "\n\n- 【未知项目】：a为1。\n\n"
    assert linearize("x\n| a | b |\n|---|---|\n| 1 | 无 |\ny") == "x\n\n\n- 【1】\n\ny"
    assert linearize("| a | b |\n| 1 | 2 |") == "| a | b |\n| 1 | 2 |"
    assert table_is_complex("<table><tr><td><table></table></td></tr></table>") and not table_is_complex("<p>")
    assert linearize(None) is None and linearize("") == ""


def test_links():
    assert repair_links("[a](http://x/y (1).png)") == "[a](http://x/y%20%281%29.png)"
    assert repair_links('![a](图.png "t t") [b](ok%20) [c](open') == '![a](%E5%9B%BE.png "t t") [b](ok%20) [c](open'
    assert repair_links("[a](x\ny)") == "[a](x\ny)" and repair_links(None) is None
    assert repair_links("[a](x\\)y)") == "[a](x\\%29y)"
    assert repair_links("[a](x[b) [c](d é)") == "[a](x[b) [c](d%20%C3%A9)" and repair_links("]( (é)") == "]( (é)"
    assert repair_links("[a](é" * 30_000 + ")") == "[a](é" * 29_999 + "[a](%C3%A9)"  # time in proportion to the text
    assert replace_links("![o](images/a.png) ![o](b.png)", {"a.png": ("s", "u")}) == "![s](u) ![o](b.png)"


def test_images(spark):
    d = docs(spark, "# H\nsome ![x](img/a.jpg) text ![y](data.jpg) and ![x](img/a.jpg)")
    images = spark.createDataFrame([(0, "a.jpg"), (0, "ta.jpg"), (0, "no.png")], "doc_id long, name string")
    used, unused = match_images(d, images)
    assert {r.name for r in used.collect()} == {"a.jpg"} and {r.name for r in unused.collect()} == {"ta.jpg", "no.png"}
    assert {r.name for r in match_images(d, images, by_suffix=True)[0].collect()} == {"a.jpg", "ta.jpg"}
    (c,) = image_context(d, images).collect()
    assert (c.heading, c.up_text, c.down_text) == ("# H", "# H\nsome ", " text ![y](data.jpg) and ![x](img/a.jpg)")
    known = spark.createDataFrame([(0, "a.jpg", "s", "u")], "doc_id long, name string, summary string, url string")
    assert replace_image_links(d, known).first().md_content == "# H\nsome ![s](u) text ![y](data.jpg) and ![s](u)"


def test_rrf(spark):
    hit = "request_id long, pos int, entity struct<chunk_id:string,content:string>"
    a = spark.createDataFrame([(1, 1, None), (1, 2, ("c1", "v")), (1, 3, ("c2", "v")), (1, 4, ("c3", "v"))], hit)
    b = spark.createDataFrame([(1, 1, ("c2", "h")), (1, 2, ("c1", "h")), (1, 3, ("c4", "h")), (1, 4, ("", "h"))], hit)
    rows = rrf([(normalize_hits(a), 1.0), (normalize_hits(b), 1.0)]).orderBy("rank").collect()
    assert [r.chunk_id for r in rows] == ["c1", "c2", "c3", "c4"] and rows[1].content == "v"
    assert rows[0].score == pytest.approx(1 / 61 + 1 / 62) and rows[2].score == pytest.approx(1 / 63)


def test_cliff(spark):
    cases = [([0.99, 0.98, 0.30, 0.05], 3), ([0.9, 0.8, 0.7, 0.6, 0.05], 4), ([0.9, 0.5], 2), ([None] * 12, 10), ([0.5] * 12, 10), ([2.0, 1.9, 1.8, 1.7, 1.1, 1.0, 0.4], 4)]
    rows = [(i, k + 1, s) for i, (scores, _) in enumerate(cases) for k, s in enumerate(scores)]
    out = cliff_cutoff(spark.createDataFrame(rows, "request_id long, rank int, score double")).groupBy("request_id").count().collect()
    assert {r.request_id: r["count"] for r in out} == {i: n for i, (_, n) in enumerate(cases)}


def test_rerank_with_a_model(spark):
    rows = spark.createDataFrame([(1, "q", 1, "low"), (1, "q", 2, "high")], "request_id long, query string, pos int, content string")
    model = lambda: lambda queries, contents: [2.0 if c == "high" else -2.0 for c in contents]
    ranked = rerank(rows, model).orderBy("rank").collect()
    assert [r.content for r in ranked] == ["high", "low"] and ranked[0].score == pytest.approx(0.880797, abs=1e-6)
    failed = rerank(rows, lambda: lambda q, c: None).orderBy("rank").collect()
    assert [r.pos for r in failed] == [1, 2] and failed[0].score is None

    def picky():
        def model(queries, contents):
            if "odd" in queries:
                raise RuntimeError("no score")
            return [1.0] * len(queries)

        return model

    mixed = rows.unionByName(spark.createDataFrame([(2, "odd", 1, "a"), (2, "odd", 2, "b")], rows.schema)).coalesce(1)
    assert [(r.request_id, r.pos, r.score is None) for r in rerank(mixed, picky).orderBy("request_id", "rank").collect()] == [(1, 1, False), (1, 2, False), (2, 1, True), (2, 2, True)]

    def absent():
        raise RuntimeError("no model")

    assert [r.score for r in rerank(rows, absent).collect()] == [None, None]


def test_alignment(spark):
    rows = [
        (1, 0, "X", "X", 0.9), (1, 0, "X", "Y", 0.8), (2, 0, "X", "Y", 0.75),
        (3, 0, "X", "Y", 0.8), (3, 0, "X", "Z", 0.79), (3, 0, "X", "V", 0.78), (3, 0, "X", "W", 0.77),
        (4, 0, "X", "Y", 0.65), (4, 0, "X", "Z", 0.62), (4, 0, "X", "W", 0.59), (5, 0, "X", "Y", 0.59),
        (6, 0, "P", "P", 0.95), (6, 1, "Q", "Q", 0.79),
    ]
    matches = spark.createDataFrame(rows, "request_id long, name_pos int, extracted_name string, item_name string, score double")
    out = align_item_names(matches)
    got = {r.request_id: (r.confirmed, r.options) for r in out.collect()}
    assert got == {1: (["X"], []), 2: (["Y"], []), 3: ([], ["Y", "Z", "V"]), 4: ([], ["Y", "Z"]), 5: ([], []), 6: (["P", "Q"], [])}
    assert [r.item_name for r in filter_confirmed(matches, out.filter("request_id = 6")).collect()] == ["P"]


def test_alignment_against_a_plain_loop(spark):
    rng = random.Random(9)
    rows = [(q, n, rng.choice("ABC"), i, round(rng.choice([0.55, 0.6, 0.65, 0.7, 0.8]) + k / 1000, 3)) for q in range(80) for n in range(rng.randint(1, 4)) for k, i in enumerate(rng.sample("ABCDEFG", rng.randint(1, 6)))]
    one = {}
    rows = [(q, n, one.setdefault((q, n), x), i, s) for q, n, x, i, s in rows]
    got = {r.request_id: (r.confirmed, r.options) for r in align_item_names(spark.createDataFrame(rows, "request_id long, name_pos int, extracted_name string, item_name string, score double")).collect()}
    for q in range(80):
        sure, open_ = [], []
        for n in sorted({r[1] for r in rows if r[0] == q}):
            own = sorted((r for r in rows if r[:2] == (q, n)), key=lambda r: -r[4])
            high = [r[3] for r in own if r[4] >= 0.7]
            if one[q, n] in high or len(high) == 1:
                pick = one[q, n] if one[q, n] in high else high[0]
                sure += [pick] if pick not in sure else []
            elif high:
                open_ += [h for h in high[:3] if h not in open_ and h not in sure]
            else:
                open_ += [r[3] for r in own if 0.6 <= r[4] and r[3] not in open_ and r[3] not in sure][:3]
        assert got[q] == (sure, open_[:3])


def test_prompts(spark):
    ranked = spark.createDataFrame([(1, 1, "主板短路", "t", "c1", None, "local", 0.9937), (1, 2, " ", "t", None, "u", "web", 0.5), (1, 3, "b", None, None, "u", "web", None)], "request_id long, rank int, content string, title string, chunk_id string, url string, source string, score double")
    (r,) = format_documents(ranked).collect()
    assert r.context == "[1] [source=local] [chunk_id=c1] [title=t] [score=0.9937]\n主板短路\n\n[3] [source=web] [url=u]\nb"
    assert r.remaining == 12000 - len(r.context.replace("\n\n", "")) - 2
    tight = format_documents(ranked, 5).first()
    assert (tight.context, tight.remaining) == ("", 5)
    requests = spark.createDataFrame([(1, "q?", None, ["a", "b"]), (2, "q2", "r2", [])], "request_id long, original_query string, rewritten_query string, item_names array<string>")
    history = spark.createDataFrame([(1, 1, "user", "hi"), (1, 2, "system", "no"), (1, 3, "assistant", "yo")], "request_id long, pos int, role string, text string")
    prompts = {p.request_id: p.prompt for p in build_prompts(requests, ranked, history).collect()}
    assert "用户: hi\n助手: yo" in prompts[1] and "a, b" in prompts[1] and prompts[1].endswith("q?")
    assert "无参考内容" in prompts[2] and "暂无历史对话" in prompts[2] and prompts[2].endswith("r2")


def test_tasks(spark):
    rows = [("t", "entry_node", "start", 1, None), ("t", "entry_node", "done", 2, 1.234), ("t", "x", "start", 3, None), ("u", "x", "done", 1, 2.0), ("u", None, "failed", 2, None), ("u", None, "completed", 3, None)]
    events = spark.createDataFrame(rows, "task_id string, node string, event string, s int, duration double").selectExpr("task_id", "node", "event", "timestamp_seconds(s) as ts", "duration")
    got = {r.task_id: r for r in task_rollup(events).collect()}
    assert got["t"].status == "processing" and got["t"].running_list == ["x"] and got["t"].done_list == ["检查文件"] and got["t"].durations == {"检查文件": 1.23} and got["t"].progress == 14
    assert got["u"].status == "completed" and got["u"].total_seconds == 2.0
    ticks = spark.createDataFrame([(1, 0), (1, 59), (1, 60)], "k int, s int").selectExpr("k", "s", "timestamp_seconds(s) as ts")
    assert {r.s: r.recent for r in request_rate(ticks, "k").collect()} == {0: 1, 59: 2, 60: 2}


def test_vectors(spark):
    chunks = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "a", [0.0, 0.0]), (3, "a", [1.0, 1.0]), (4, "b", [1.0, 0.0]), (5, "a", None)], "chunk_id long, item_name string, vector array<float>")
    queries = spark.createDataFrame([(1, [1.0, 0.0], ["a"]), (2, [1.0, 0.0], None), (3, [0.0, 0.0], ["a"])], "query_id long, vector array<float>, item_names array<string>")
    got = {}
    for r in dense_topk(queries, chunks, 2).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.chunk_id)
    assert got == {1: [1, 3], 2: [1, 4]}

    def broken():
        def model(texts, mode):
            raise RuntimeError("no model")

        return model

    rows = spark.createDataFrame([(1, "a b")], "id long, text string")
    ok, report = validate_vectors(embed(rows, "text", broken))
    assert ok.count() == 0 and report.first().rows == 0
    assert validate_vectors(embed(rows, "text"))[1].first().single_dim


@pytest.mark.parametrize("most, most_bytes, stride", [(4096, 1 << 20, 1024), (4096, 1 << 20, 3), (3, 1 << 20, 2), (4096, 300, 5)])
def test_searches_against_a_plain_loop(spark, monkeypatch, most, most_bytes, stride):
    """With the queries in every task, and in cells of blocks that rows or bytes limit."""
    monkeypatch.setattr(vectors, "MATRIX_QUERIES", most)
    monkeypatch.setattr(vectors, "MATRIX_BYTES", most_bytes)
    monkeypatch.setattr(vectors, "CHUNK_BLOCK", 7)
    monkeypatch.setattr(vectors, "STRIDE", stride)
    rng = random.Random(33)
    vector = lambda: rng.choice([None, [0.0, 0.0, 0.0], *[[float(rng.randint(-3, 3)) for _ in range(3)]] * 8])
    words = lambda: rng.choice([None, *[{rng.randint(0, 9): float(rng.randint(-2, 4)) for _ in range(rng.randint(0, 4))}] * 8])
    chunks = [(i, rng.choice(["a", "b", None]), vector(), words()) for i in range(40)]
    queries = [(i, rng.choice([None, ["a"], ["a", "b", "a"], ["c"], []]), vector(), words()) for i in range(25)]
    c = spark.createDataFrame(chunks, "chunk_id long, item_name string, vector array<double>, sparse map<long,double>").repartition(3)
    q = spark.createDataFrame(queries, "query_id long, item_names array<string>, vector array<double>, sparse map<long,double>")

    def best(score):
        out = []
        for qi, names, qv, qs in queries:
            found = [(-round(s, 9), ci) for ci, item, cv, cs in chunks if names is None or item in names for s in [score(qv, cv, qs, cs)] if s is not None]
            out += [(qi, ci) for _, ci in sorted(found)[:4]]
        return sorted(out)

    dot = lambda x, y: sum(p * r for p, r in zip(x, y))
    ip = lambda a, b, *_: dot(a, b) if a is not None and b is not None else None
    cosine = lambda a, b, *_: dot(a, b) / (dot(a, a) * dot(b, b)) ** 0.5 if a and b and dot(a, a) and dot(b, b) else None
    tokens = lambda _a, _b, x, y: sum(x[t] * y[t] for t in x if t in y) if x and y and x.keys() & y.keys() else None
    pairs = lambda df: sorted((r.query_id, r.chunk_id) for r in df.collect())
    assert pairs(dense_topk(q, c, 4)) == best(cosine)
    assert pairs(dense_topk(q, c, 4, metric="ip")) == best(ip)
    assert pairs(sparse_topk(q, c, 4)) == best(tokens)


def test_spans_without_a_cap():
    tall = "<table><tr><td>n</td><td>a</td></tr><tr><td rowspan='3000'>s</td><td>0</td></tr>" + "".join(f"<tr><td>{i}</td></tr>" for i in range(1, 3000)) + "<tr><td>t</td><td>9</td></tr></table>"
    lines = linearize("<p/>" + tall.replace("<table>", "<table><tr><th>x</th><th>y</th></tr>")).strip().split("\n")
    assert lines[-2] == "- 【s】(对应x)：y为2999。" and lines[-1] == "- 【t】(对应x)：y为9。"
    crossed = "<table><tr><th>h</th><th>b</th><th>c</th></tr><tr><td rowspan='2'>r</td><td>1</td><td rowspan='3'>z</td></tr><tr><td>2</td></tr><tr><td colspan='2'>w</td></tr></table>"
    assert linearize(crossed).strip().split("\n") == ["- 【r】(对应h)：b为1，c为z。", "- 【r】(对应h)：b为2，c为z。", "- 【w】(对应h)：b为w，c为z。"]


def plain_grid(rows):
    """Every cell written into every place that it spans."""
    grid = [[] for _ in rows]
    for y, row in enumerate(rows):
        x = 0
        for text, down, across in row:
            while x < len(grid[y]) and grid[y][x] is not None:
                x += 1
            for r in range(y, y + down):
                while len(grid) <= r:
                    grid.append([])
                grid[r] += [None] * (x + across - len(grid[r]))
                grid[r][x : x + across] = [text] * across
            x += across
    return grid


def test_spans_against_a_plain_grid():
    rng = random.Random(12)
    for _ in range(400):
        rows = [[(rng.choice(("", "a", "b", "-")), rng.choice((1, 1, 1, 2, 3, 7)), rng.choice((1, 1, 2, 5))) for _ in range(rng.randrange(5))] for _ in range(rng.randrange(1, 6))]
        html = "<table>" + "".join("<tr>" + "".join(f"<td rowspan={d} colspan={a}>{t}</td>" for t, d, a in row) + "</tr>" for row in rows) + "</table>"
        grid = [[x or "" for x in row] for row in plain_grid(rows)]
        width = max(map(len, grid))
        lines = []
        for spans, times in spread(parsed_rows(html)):
            line = [""] * width
            for begin, end, text in spans:
                line[begin:end] = [text] * (end - begin)
            lines += [line] * times
        assert lines == [row + [""] * (width - len(row)) for row in grid]


def test_very_wide_and_very_deep_cells():
    wide = "<table><tr><th>n</th><th colspan=5000>v</th></tr><tr><td>s</td>" + "".join(f"<td>{i}</td>" for i in range(5000)) + "</tr></table>"
    assert linearize(wide) == "\n\n- 【s】(对应n)：" + "，".join(f"v为{i}" for i in range(5000)) + "。\n\n"
    deep = "<table><tr><td>k</td><td>v</td></tr><tr><td rowspan=100000>s</td><td>1</td></tr><tr><td>2</td></tr></table>"
    assert linearize(deep) == "\n\n- 【k】：v。\n- 【s】：1。\n- 【s】：2。\n" + "\n".join(["- 【s】：无。"] * 99_998) + "\n\n"
    blank = "<table><tr><td>k</td><td colspan=2000000000></td></tr><tr><td rowspan=1000000000></td><td>1</td></tr></table>"
    assert linearize(blank) == "\n\n- 【未知项目】(对应k)：属性1为1。\n\n"


def test_tables_within_tables():
    inner = "<table><tr><td>name</td><td>brand</td></tr><tr><td>N</td><td>x<table><tr><td>B</td><td>C<br>D</td></tr></table></td></tr></table>"
    assert linearize(inner) == "\n\n- 【N】(对应name)：brand为x B C D，属性2为B，属性3为C D。\n- 【B】(对应name)：brand为C D。\n\n</td></tr></table>"
    assert linearize("<table><tr><td>a<td>b<tr><td>c</table>") == "\n\n- 【c】\n\n"
    assert linearize("<table><td>a</td></table>") == "<table><td>a</td></table>"


def parsed_rows(html):
    cells = _Cells()
    cells.feed(html)
    cells.close()
    return cells.rows


def test_sparse_blocks_are_passed_over():
    """A block whose largest weights can't reach the k-th score isn't scored, and nothing is lost by it."""
    lists = lambda rows, kind: pa.array(rows, pa.list_(kind))
    rng = np.random.default_rng(2)
    tokens = [sorted(rng.choice(40, rng.integers(0, 9), replace=False).tolist()) for _ in range(300)]
    weights = [[float(rng.integers(-2, 9)) / (1 + i // 50) for _ in t] for i, t in enumerate(tokens)]
    q_tokens, q_weights = tokens[::30], weights[::30]
    q = SparseQueries(lists(q_tokens, pa.int64()), lists(q_weights, pa.float64()))
    block = q.look(lists(tokens, pa.int64()), lists(weights, pa.float64()))
    best, left_out = Best(len(q_tokens), 3, 9), 0
    for at in range(0, 300, 10):
        columns, scores = q.score(block, np.arange(at, at + 10), best.least)
        left_out += q.n - len(columns)
        best.add(scores, columns, np.arange(at, at + 10))
    expected = []
    for i, (t, w) in enumerate(zip(q_tokens, q_weights)):
        own = dict(zip(t, w))
        found = sorted((-round(sum(own[x] * y for x, y in zip(tt, ww) if x in own), 9), j) for j, (tt, ww) in enumerate(zip(tokens, weights)) if own.keys() & set(tt))
        expected += [(i, j) for _, j in found[:3]]
    assert sorted(zip(best.query.tolist(), best.ids.tolist())) == sorted(expected) and left_out > 20


@pytest.mark.parametrize("low", [1, -3])
def test_memory_of_sparse_scores_is_bounded(low):
    """Words that all queries and chunks have give no row for each pair of them; scores of 0 and no common word at all are told apart."""
    rng = np.random.default_rng(5)
    tokens = [sorted(rng.choice(130, 100, replace=False).tolist()) if i % 50 else [1000 + i] for i in range(1256)]
    weights = [rng.integers(low, 9, len(t)).astype(float).tolist() for t in tokens]
    if low < 0:
        tokens[1:3], weights[1:3], tokens[1001:1003], weights[1001:1003] = [[0, 1], [2]], [[2.0, -2.0], [0.0]], [[0, 1], [2]], [[3.0, 3.0], [5.0]]
    lists = lambda rows, kind: pa.array(rows, pa.list_(kind))
    q = SparseQueries(lists(tokens[:1000], pa.int64()), lists(weights[:1000], pa.float64()))
    block = q.look(lists(tokens[1000:], pa.int64()), lists(weights[1000:], pa.float64()))
    tracemalloc.start()
    columns, scores = q.score(block, np.arange(256), np.full(1000, -np.inf))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    whole, there = np.zeros((1256, 2300)), np.zeros((1256, 2300))
    for i, (t, w) in enumerate(zip(tokens, weights)):
        whole[i, t], there[i, t] = w, 1
    expected = np.where(there[1000:] @ there[:1000].T > 0, whole[1000:] @ whole[:1000].T, np.nan)
    assert len(columns) == 1000 and np.array_equal(scores, expected, equal_nan=True)
    assert low > 0 or scores[1, 1] == scores[2, 2] == 0
    assert peak < 100 << 20


def test_memory_of_a_full_block_is_bounded():
    """As many queries as a block has, each with half of 64 components as tokens, against the chunks that are scored at once."""
    rng = np.random.default_rng(6)
    values = rng.normal(size=(5120, 64)).astype(np.float32)
    lists = lambda rows, kind: pa.array([r.tolist() for r in rows], pa.list_(kind))
    sparse = lambda part: (lists([np.flatnonzero(r > 0) for r in part], pa.int64()), lists([r[r > 0] for r in part], pa.float32()))
    dense = lambda part: (lists(part, pa.float32()),)
    n = vectors.MATRIX_QUERIES
    for make, of, product in ((lambda v: DenseQueries("cosine", v), dense, values / np.linalg.norm(values, axis=1, keepdims=True)), (SparseQueries, sparse, np.maximum(values, 0))):
        q, best = make(*of(values[:n])), Best(n, 5, 9)
        block = q.look(*of(values[n:]))
        tracemalloc.start()
        step = vectors._stride(n)
        for at in range(0, 1024, step):
            columns, scores = q.score(block, np.arange(at, at + step), best.least)
            best.add(scores, columns, np.arange(at, at + step))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        expected = np.argsort(-(product[n:].astype(float) @ product[:n].astype(float).T), axis=0, kind="stable")[:5]
        assert sorted(zip(best.query.tolist(), best.ids.tolist())) == sorted((i, j) for i in range(n) for j in expected[:, i].tolist())
        assert peak < 100 << 20


@pytest.mark.parametrize("slices", [None, 7, 60, 200])
def test_rates_by_slices_of_time(spark, slices):
    """The counts of one key with most events, whatever the slices, against a plain loop."""
    rng = random.Random(21)
    rows = [(i, rng.choice((1, 1, 1, 1, 2, None)), rng.choice((None, *[rng.randrange(-500, 1500)] * 9))) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, k int, s int").selectExpr("id", "k", "timestamp_seconds(s) as ts").repartition(3)
    plain = {i: sum(k2 == k and (s2 is None if s is None else s2 is not None and s - 60 < s2 <= s) for _, k2, s2 in rows) for i, k, s in rows}
    out = request_rate(df, "k", 60, 5, slices)
    assert {r.id: (r.recent, r.over_limit) for r in out.collect()} == {i: (n, n > 5) for i, n in plain.items()} and out.columns == ["id", "k", "ts", "recent", "over_limit"]
