"""Files, whole jobs and streams."""

from __future__ import annotations

import itertools
import os
import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lorewell.catalog.registry import queries as catalog
from lorewell.config import Config
from lorewell.functions.encoders import HashedTokens
from lorewell.operators.history import clear_sessions, session_history, turns_to_messages, upsert_messages
from lorewell.operators.sections import chunk_sections, split_by_headings
from lorewell.operators.tasklog import task_rollup
from lorewell.operators.vectors import embed
from lorewell.plans import retrieve as retrieve_plan
from lorewell.plans.buckets import append, clear_stored, commit, folders, messages_table, read_buckets, upsert_stored
from lorewell.plans.ingest import chunk_documents, embed_chunks, image_links, image_requests, ingest, tables_to_review
from lorewell.plans.retrieve import answer_requests, retrieve, with_content
from lorewell.schemas import MESSAGES
from lorewell.sources.files import archive_originals, images_of, list_files, list_images, read_chunks, read_chunks_json, read_markdown, read_messages, referenced_images, route_files, write_chunks, write_chunks_json, write_messages, write_text_files
from lorewell.streaming import files as streaming_files
from lorewell.streaming.files import committed, file_batch, ingest_stream
from lorewell.streaming.tasks import Step, summary, task_rollup_stream

from .conftest import DATA


def manual(tmp_path, n=3):
    root = tmp_path / "in"
    (root / "images").mkdir(parents=True)
    for i in range(n):
        (root / f"手册 {i}.md").write_text(f"# pump {i}\nHow to start pump {i}. ![p](images/a.PNG)\n## valve\nOpen the valve {i} slowly.\n")
    (root / "x.pdf").write_bytes(b"%PDF")
    (root / "x.txt").write_text("no")
    (root / "images" / "a.PNG").write_bytes(b"i")
    return str(root)


def test_files(spark, tmp_path):
    root = manual(tmp_path)
    md, pdf, rejected = route_files(list_files(spark, root))
    assert (md.count(), pdf.count(), rejected.count()) == (3, 1, 2)
    assert [r.name for r in list_images(spark, root).collect()] == ["a.PNG"]
    docs = read_markdown(spark, f"{root}/*.md")
    assert {r.file_title for r in docs.collect()} == {"手册 0", "手册 1", "手册 2"} and docs.filter("md_content like '# pump%'").count() == 3
    archive_originals(docs.withColumn("ts", F.lit(datetime(2024, 5, 6))), str(tmp_path / "archive"))
    assert (tmp_path / "archive" / "dt=20240506").is_dir()


def test_chunk_table(spark, tmp_path):
    docs = read_markdown(spark, f"{manual(tmp_path)}/*.md")
    replies = docs.select("doc_id", F.lit("UNKNOWN").alias("answer"))
    chunks = ingest(docs, replies)
    out = str(tmp_path / "chunks")
    write_chunks(chunks, out)
    write_chunks(chunks, out, dedupe=True)
    back = read_chunks(spark, out)
    assert back.count() == chunks.count() == 3 and back.select("chunk_id").distinct().count() == 3
    assert {r.item_name for r in back.collect()} == {"手册 0", "手册 1", "手册 2"}
    write_chunks_json(back, str(tmp_path / "json"))
    assert read_chunks_json(spark, str(tmp_path / "json")).select("chunk_id", "content").exceptAll(back.select("chunk_id", "content")).count() == 0

    requests = spark.createDataFrame([(1, "how to start pump 1", None, ["手册 1"])], "request_id long, original_query string, rewritten_query string, item_names array<string>")
    hypo = spark.createDataFrame([(1, "Open the valve")], "request_id long, document string")
    web = spark.createDataFrame([(1, 0, "pump page", "pumps", "http://p")], "request_id long, pos int, snippet string, title string, url string")
    history = spark.createDataFrame([(1, 1, "user", "hello")], "request_id long, pos int, role string, text string")
    (prompt,) = retrieve(requests, back, hypo, web, history).collect()
    assert "pump 1" in prompt.prompt and "source=web" in prompt.prompt and "pump 2" not in prompt.prompt and "用户: hello" in prompt.prompt


def test_messages(spark, tmp_path):
    rows = [(f"m{i}", "s" if i < 3 else "t", "user", f"x{i}", None, None, float(i)) for i in range(5)]
    base = spark.createDataFrame(rows, MESSAGES)
    write_messages(base, str(tmp_path / "m"))
    assert read_messages(spark, str(tmp_path / "m")).count() == 5
    changes = spark.createDataFrame([("m1", "s", "user", "new", "rw", ["a"], 9.0), ("none", "s", "user", "lost", None, None, 9.0), (None, "u", "user", "fresh", None, None, 9.0)], MESSAGES)
    after = {r.text for r in upsert_messages(base, changes).collect()}
    assert after == {"x0", "new", "x2", "x3", "x4", "fresh"}
    kept, deleted = clear_sessions(base, spark.createDataFrame([("s",), ("none",)], "session_id string"))
    assert kept.count() == 2 and [(r.session_id, r.deleted) for r in deleted.collect()] == [("s", 3)]
    turns = spark.createDataFrame([("s", "q", "a", 1.0), ("s", "q2", " ", 2.0)], "session_id string, query string, answer string, ts double").withColumns({"rewritten_query": F.lit("r"), "item_names": F.array(F.lit("i"))})
    assert [(r.role, r.text) for r in turns_to_messages(turns).orderBy("ts", F.desc("role")).collect()] == [("user", "q"), ("assistant", "a"), ("user", "q2")]


def test_file_stream_equals_batch(spark, tmp_path):
    root = manual(tmp_path)
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    ingest_stream(spark, root, out, checkpoint).awaitTermination()
    (tmp_path / "in" / "late.md").write_text("# late\ntext")
    ingest_stream(spark, root, out, checkpoint).awaitTermination()
    batch = chunk_documents(read_markdown(spark, f"{root}/*.md"))
    assert read_chunks(spark, out).select("content").exceptAll(batch.select("content")).count() == 0
    assert read_chunks(spark, out).count() == batch.count() == 4
    assert {r.doc_id for r in read_chunks(spark, out).collect()} == {r.doc_id for r in batch.collect()}
    assert {r.file_title for r in read_chunks(spark, out).collect()} == {"手册 0", "手册 1", "手册 2", "late"}


def test_task_stream_equals_batch(spark, tmp_path):
    schema = "task_id string, node string, event string, ts timestamp, duration double"
    at = lambda s: datetime(2024, 1, 1, 0, 0, s)
    rows = [("t", "a", "start", at(1), None), ("t", "b", "start", at(4), None), ("t", "a", "done", at(3), 1.5), ("t", "a", "start", at(2), None), ("u", "a", "done", at(5), 2.0), ("u", None, "completed", at(6), None)]
    for i, part in enumerate((rows[::2], rows[1::2])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
        stream = task_rollup_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "events")), names={})
        seen = {}
        query = stream.writeStream.outputMode("update").foreachBatch(lambda df, _: seen.update({r.task_id: r for r in df.collect()})).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()
        if i == 0:
            first = dict(seen)
    final = first | seen
    batch = {r.task_id: r for r in task_rollup(spark.createDataFrame(rows, schema), names={}).collect()}
    for k, r in batch.items():
        assert final[k] == r


def test_repeated_running_steps(spark):
    """A step that finished and starts again goes to the end of the running list, in the batch and in the stream, in whatever order events arrive."""
    schema = "task_id string, node string, event string, ts timestamp, duration double"
    at = lambda s: datetime(2024, 1, 1, 0, 0, s)
    rows = [("t", "a", "start", at(1), None), ("t", "a", "done", at(2), 1.0), ("t", "b", "start", at(3), None), ("t", "a", "start", at(4), None), ("t", "a", "start", at(5), None)]
    (r,) = task_rollup(spark.createDataFrame(rows, schema), names={}).collect()
    assert r.running_list == ["b", "a"] and r.done_list == ["a"]
    for order in itertools.permutations(rows):
        steps: dict[str, Step] = {}
        for _, node, event, ts, duration in order:
            steps[node] = steps.get(node, Step()).after(int(ts.timestamp() * 1e6), event, duration)
        assert summary("t", "processing", steps, 7)["running_list"][0] == ["b", "a"]


def test_settled_starts_are_one():
    """Of the starts that no late finish can tell apart one stays, whatever their number, and nothing changes by it."""
    rng = random.Random(4)
    events = [(i, rng.choice(("start", "start", "done", "fail")), 1.0) for i in range(300)]
    plain = kept = Step()
    for at in range(0, 300, 20):
        for e in rng.sample(events[at : at + 20], 20):
            plain, kept = plain.after(*e), kept.after(*e, settled=at)
            assert plain.starts[:1] == kept.starts[:1] and plain[:4] == kept[:4]
    for i in range(1000, 2000):
        kept = kept.after(i, "start", None, settled=i)
    assert len(kept.starts) <= 3


def test_idle_tasks_are_forgotten(spark, tmp_path):
    schema = "task_id string, node string, event string, ts timestamp, duration double"
    at = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    batches = [
        [("t", "a", "done", at(0), 1.0), ("u", "a", "done", at(0), 1.0)],
        [("u", "b", "done", at(50), 1.0)],
        [("v", "a", "start", at(100), None)],
        [("v", "b", "start", at(101), None)],  # by now the watermark has passed t's time, not u's
        [("t", "c", "done", at(100), 1.0), ("u", "c", "done", at(100), 1.0)],
    ]
    seen = {}
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
        stream = task_rollup_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "events")), late="10 minutes", idle_minutes=60, names={})
        stream.writeStream.outputMode("update").foreachBatch(lambda df, _: seen.update({r.task_id: r for r in df.collect()})).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert seen["t"].done_list == ["c"] and seen["u"].done_list == ["a", "b", "c"] and seen["v"].running_list == ["a", "b"]


def test_history_with_repeated_ids(spark):
    rows = [("m1", "s", "user", "a", None, None, 1.0), ("m1", "s", "user", "b", None, None, 2.0), (None, "s", "user", "c", None, None, 3.0)]
    base = spark.createDataFrame(rows, MESSAGES)
    assert [(r.message_id, r.text, r.pos) for r in session_history(base).orderBy("pos").collect()] == [("m1", "a", 1), ("m1", "b", 2), ("", "c", 3)]
    changes = spark.createDataFrame([("m1", "s", "user", "timeless", None, None, None)], MESSAGES)
    assert [r.text for r in upsert_messages(base.filter("text = 'a'"), changes).collect()] == ["timeless"]
    both = changes.unionByName(changes.withColumns({"text": F.lit("timed"), "ts": F.lit(4.0)}))
    assert [r.text for r in upsert_messages(base.filter("text = 'a'"), both).collect()] == ["timed"]


def test_chunks_that_the_encoder_fails_on(spark):
    class Picky(HashedTokens):
        def __call__(self, texts, mode="document"):
            if any("bad" in t for t in texts):
                raise RuntimeError("no")
            return super().__call__(texts, mode)

    rows = [(1, 0, "good", "x"), (1, 1, "bad", "x"), (2, 0, "", ""), (2, 1, "fine", "y")]
    chunks = spark.createDataFrame(rows, "doc_id long, chunk_no int, content string, item_name string").repartition(4, "content")
    done, rejected = embed_chunks(chunks, Picky)
    failed = {(r.content, r.reason) for r in rejected.collect()}
    assert ("", "blank text") in failed and ("bad", "no vectors") in failed
    assert {r.content for r in done.collect()} | {c for c, _ in failed} == {"good", "bad", "", "fine"}


def test_images_of_documents(spark, tmp_path):
    root = manual(tmp_path)
    docs = read_markdown(spark, f"{root}/*.md")
    images = images_of(list_images(spark, root), docs)
    assert sorted({r.doc_id for r in images.collect()}) == sorted(r.doc_id for r in docs.collect()) and {r.name for r in images.collect()} == {"a.PNG"}
    used, unused = image_requests(docs, images.unionByName(images.withColumn("name", F.lit("b.png"))))
    assert {r.name for r in unused.collect()} == {"b.png"} and {r.heading for r in used.collect()} == {f"# pump {i}" for i in range(3)}
    links = image_links(used, used.select("doc_id", "name", F.lit("a pump").alias("summary")), docs, "http://s", "kb")
    chunks = chunk_documents(docs, links).collect()
    assert any("![a pump](http://s/kb/%E6%89%8B%E5%86%8C%201/a.PNG)" in c.content for c in chunks)
    d = spark.createDataFrame([(0, "M", "# H\nsee ![x](img/data.jpg)!")], "doc_id long, file_title string, md_content string")
    used, _ = image_requests(d, spark.createDataFrame([(0, "a.jpg", "p")], "doc_id long, name string, path string"))
    assert [(r.name, r.up_text, r.down_text) for r in used.collect()] == [("a.jpg", "# H\nsee ", "!")]


def test_tables_to_review(spark):
    deep = "<table><tr><td rowspan='11'>a</td><td>b</td></tr></table>"
    fine, review = tables_to_review(spark.createDataFrame([(1, "x"), (2, deep), (3, None)], "chunk_id long, content string"))
    assert {r.chunk_id for r in fine.collect()} == {1, 3} and {r.chunk_id for r in review.collect()} == {2}


def test_whole_answer_job(spark):
    docs = spark.createDataFrame([(i, f"pump {i}", f"# pump {i}\nHow to start pump {i}.\n## valve\nOpen valve {i} slowly.") for i in range(4)], "doc_id long, file_title string, md_content string")
    chunks = ingest(docs, docs.select("doc_id", F.col("file_title").alias("answer")))
    items = embed(docs.select(F.col("file_title").alias("item_name")), "item_name")
    raw = {1: '{"item_names": ["pump 1"], "rewritten_query": "start pump 1"}', 2: '```json\n{"item_names": ["pump"]}\n```', 3: "{oops", 4: '{"item_names": ["pump 2", "pump 3"]}'}
    requests = spark.createDataFrame([(i, f"q{i}") for i in range(1, 6)], "request_id long, original_query string")
    replies = spark.createDataFrame(list(raw.items()), "request_id long, raw string")
    none = lambda schema: spark.createDataFrame([], schema)
    out = answer_requests(requests, replies, items, chunks, none("request_id long, document string"), none("request_id long, pos int, snippet string, title string, url string"), none("request_id long, pos int, role string, text string"))
    got = {r.request_id: r for r in out.collect()}
    assert got[1].route == "search" and got[1].item_names == ["pump 1"] and "Open valve 1 slowly" in got[1].prompt and "valve 2" not in got[1].prompt and got[1].prompt.endswith("start pump 1")
    assert got[2].route == "clarify" and len(got[2].options) == 3 and got[2].prompt is None and got[2].answer
    assert got[3].route == got[5].route == "apologise"
    assert got[4].item_names == ["pump 2", "pump 3"] and "valve 2" in got[4].prompt and "valve 3" in got[4].prompt and got[4].prompt.endswith("q4")


def test_equal_queries_are_searched_once(spark, monkeypatch):
    """Requests with one question and one set of items are one search; each of them gets what it finds."""
    docs = spark.createDataFrame([(i, f"pump {i}", f"# pump {i}\nHow to start pump {i}.") for i in range(3)], "doc_id long, file_title string, md_content string")
    chunks = ingest(docs, docs.select("doc_id", F.col("file_title").alias("answer")))
    rows = [(i, "start it", items) for i, items in enumerate([["pump 1", "pump 2"], ["pump 2", "pump 1", "pump 2"], ["pump 2"], None, None, []])]
    requests = spark.createDataFrame([*rows, (6, "stop it", ["pump 2"])], "request_id long, query string, item_names array<string>")
    documents = spark.createDataFrame([(1, "open the valve")], "request_id long, document string")
    searched = []
    whole = retrieve_plan.hybrid_search
    monkeypatch.setattr(retrieve_plan, "hybrid_search", lambda queries, *rest: searched.append(queries.count()) or whole(queries, *rest))
    got = {}
    for r in retrieve_plan.search(requests, chunks, documents).collect():
        got.setdefault(r.request_id, []).append((r.rank, r.content.split("\n")[0]))
    # the plain and the hypothetical question have the same words but where there is a document
    assert searched == [6]
    found = {k: {x for _, x in v} for k, v in got.items()}
    assert found == {0: {"## pump 1", "## pump 2"}, 1: {"## pump 1", "## pump 2"}, 2: {"## pump 2"}, 3: {f"## pump {i}" for i in range(3)}, 4: {f"## pump {i}" for i in range(3)}, 6: {"## pump 2"}}
    assert sorted(got[3]) == sorted(got[4]) and all(len(v) == len(found[k]) for k, v in got.items())


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_chunker_has_one_exchange_and_each_udf_once(spark):
    plan = executed(catalog()["merged_chunks"](spark, str(DATA)))
    assert len(re.findall(r"\bExchange\b", plan)) == 1 and plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan
    plan = executed(catalog()["ingest_job"](spark, str(DATA)))
    assert len(re.findall(r"\bExchange\b", plan)) == 2 and plan.count("MapInArrow") == 1 and plan.count("ArrowEvalPython [") == 1
    assert "Broadcast" not in plan and "SortMergeJoin" not in plan
    assert executed(catalog()["long_section_pieces"](spark, str(DATA))).count("ArrowEvalPython [") == 2


def test_chunks_of_broken_documents(spark):
    """Null texts, repeated replies, and a column named like one of the job's."""
    docs = spark.createDataFrame([(1, "a", "# T\nbody", "mine"), (2, "b", None, "own"), (3, "c", "", None), (4, "d", "x" * 5000, "z")], "doc_id long, file_title string, md_content string, item_name string")
    replies = spark.createDataFrame([(1, "N"), (1, "M"), (2, None), (4, "UNKNOWN")], "doc_id long, answer string")
    rows = ingest(docs, replies).select("doc_id", "chunk_no", "title", "item_name").orderBy("doc_id", "chunk_no").collect()
    assert [tuple(r) for r in rows] == [(1, 0, "T", "N"), (4, 0, "d(1)", "d"), (4, 1, "d(2)", "d"), (4, 2, "d(3)", "d")]


class Refuses(HashedTokens):
    def __call__(self, texts, mode="document"):
        if any("unspeakable" in t for t in texts):
            raise RuntimeError("no")
        return super().__call__(texts, mode)


def test_broken_files_stop_nothing(spark, tmp_path, monkeypatch):
    """Of a batch with broken files the others are kept; a batch that is repeated, or that stopped before its commit, loses and doubles nothing."""
    root = tmp_path / "in"
    root.mkdir()
    good = {f"100% +g{i}": f"# title {i}\nbody {i}" for i in range(6)}
    for name, text in good.items():
        (root / f"{name}.md").write_text(text)
    (root / "bytes.md").write_bytes(b"# T\n\xff\xfe")
    (root / "blank.md").write_text(" \n")
    (root / "long.md").write_text("x" * 5000)
    (root / "mute.md").write_text("# T\nunspeakable")
    (root / "cursed.md").write_text("# T\n<table>" + "y" * 3000)
    out = str(tmp_path / "out")
    ingest_stream(spark, str(root), out, str(tmp_path / "state"), Config(max_content_length=2000), encoder=Refuses, most_bytes=4000, files_per_batch=4).awaitTermination()
    chunks, rejected = committed(spark, out)
    got = sorted((r.file_title, r.content) for r in chunks.collect())
    assert [g for g in got if g[0] in good] == sorted((k, "## " + t.replace("# ", "").replace("\n", "\n\n")) for k, t in good.items())
    why = {r.path.split("/")[-1]: r.reason for r in rejected.collect()}
    assert why == {"bytes.md": "not UTF-8", "blank.md": "blank text", "long.md": "too large", "mute.md": "no vectors"}
    # a batch again, as after a failure between its commit and the stream's own record of it
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").load(str(root)).select(F.col("_metadata.file_path").alias("path"), "length", "content")
    file_batch(files, out, 0, encoder=Refuses, most_bytes=4000)
    assert committed(spark, out)[0].count() == len(got)
    # a batch that stops before its commit isn't seen, and is written anew when it is repeated
    def stop(*_):
        raise OSError("disk")

    monkeypatch.setattr("lorewell.streaming.files.commit_folder", stop)
    with pytest.raises(OSError):
        file_batch(files, out, 99)
    monkeypatch.undo()
    monkeypatch.setattr("lorewell.streaming.files.write_chunk_batch", stop)
    with pytest.raises(OSError):
        file_batch(files, out, 99)
    assert committed(spark, out)[0].count() == len(got) and committed(spark, out)[1].count() == 4
    monkeypatch.undo()
    file_batch(files, out, 99, most_bytes=4000)
    assert committed(spark, out)[0].count() == 2 * len(got) + 1  # this encoder refuses nothing


def test_many_small_files(spark, tmp_path, monkeypatch):
    """Files lie in a few folders, and the stream reads many in a task; its settings stay its own."""
    rows = [(str(i), f"# title {i}\nbody {i}") for i in range(600)] + [("7", "more"), ("8", None)]
    root = tmp_path / "in"
    write_text_files(spark.createDataFrame(rows, "name string, text string"), str(root), folders=5)
    written = {p.name: p.read_text() for p in root.rglob("*.txt")}
    assert len(written) == 600 and len(list(root.iterdir())) == 5 and written["9.txt"] == "# title 9\nbody 9\n"
    assert {*written["7.txt"].splitlines()} == {"# title 7", "body 7", "more"} and sorted(written["8.txt"].splitlines()) == ["", "# title 8", "body 8"]
    write_text_files(spark.createDataFrame([], "name string, text string"), str(tmp_path / "none"))
    assert (tmp_path / "none").is_dir()

    tasks, batch = [], streaming_files.file_batch
    monkeypatch.setattr(streaming_files, "file_batch", lambda df, *rest: tasks.append(df.rdd.getNumPartitions()) or batch(df, *rest))
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    out = str(tmp_path / "out")
    ingest_stream(spark, str(root), out, str(tmp_path / "state"), pattern="*.txt").awaitTermination()
    assert len(tasks) == 1 and tasks[0] <= 20  # of two ways to read, eight each; at 4 MB a file, 32 of them are a task
    assert spark.conf.get("spark.sql.files.openCostInBytes") == before
    assert committed(spark, out)[0].select("file_title").distinct().count() == 600


def test_documents_that_cannot_be_cut(spark):
    docs = spark.createDataFrame([(1, "a", "# T\nfine"), (2, "b", "# T\n<table>" + "z" * 100)], "doc_id long, file_title string, md_content string")
    sections = split_by_headings(docs)

    rows = chunk_sections(sections, Unsplittable(), report=True).orderBy("doc_id").collect()
    assert [(r.doc_id, r.content, r.error) for r in rows] == [(1, "## T\n\nfine", None), (2, None, "ZeroDivisionError: no room")]
    with pytest.raises(Exception, match="no room"):
        chunk_sections(sections, Unsplittable()).collect()


class Unsplittable(Config):
    """Limits that can't be read for a long body."""

    class Limit(int):
        def __sub__(self, other):
            return Unsplittable.Limit(int(self) - other)

        def __gt__(self, other):
            return True

        def __lt__(self, other):
            if other > 50:
                raise ZeroDivisionError("no room")
            return False

    def __init__(self):
        object.__setattr__(self, "max_content_length", Unsplittable.Limit(2000))
        object.__setattr__(self, "min_content_length", 500)


def test_content_is_read_for_hits_only(spark, tmp_path):
    """Few hits go to the chunks, and the texts of others are not moved; many are dealt by id with them."""
    spark.range(1000).select(F.col("id").alias("chunk_id"), F.concat(F.lit("text "), "id").alias("content"), F.lit("t").alias("title"), F.lit("z").alias("item_name")).write.parquet(str(tmp_path / "c"))
    chunks = spark.read.parquet(str(tmp_path / "c"))
    hits = spark.createDataFrame([(1, 1, 7), (1, 2, 9), (2, 1, 7), (2, 2, 5000)], "request_id int, rank int, chunk_id long")
    few, many = with_content(hits, chunks), with_content(hits, chunks, most=100)
    rows = lambda df: sorted((r.request_id, r.rank, r.content) for r in df.collect())
    assert rows(few) == rows(many) == [(1, 1, "text 7"), (1, 2, "text 9"), (2, 1, "text 7")]
    assert "BroadcastHashJoin" in executed(few) and not re.search(r"Exchange hash", executed(few))
    assert "ShuffledHashJoin" in executed(many) and "Broadcast" not in executed(many)
    assert "ReadSchema: struct<chunk_id:bigint,content:string,title:string>" in few._jdf.queryExecution().executedPlan().toString()


def test_referenced_images_of_one_folder(spark):
    """A hundred thousand documents and a thousand images in one folder give as many rows as there are references."""
    docs = spark.range(100_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("file:///x/d%20"), "id", F.lit(".md")).alias("path"), F.concat(F.lit("![a](images/pic"), F.col("id") % 1000, F.lit(".png) and ![b](images/none.png)")).alias("md_content"))
    images = spark.range(1000).select(F.concat(F.lit("file:/x/images/pic"), "id", F.lit(".png")).alias("path"), F.concat(F.lit("pic"), "id", F.lit(".png")).alias("name"))
    assert referenced_images(images, docs).count() == 100_000
    few = docs.limit(50)
    assert "BroadcastNestedLoopJoin" not in executed(referenced_images(images, few, True)) and "CartesianProduct" not in executed(referenced_images(images, few, True))
    # by suffix pic7.png is also named by an address that ends in it
    ends = spark.createDataFrame([(1, "file:/x/a.md", "![](i/bigpic7.png) ![](pic12.png)"), (2, "file:/y/b.md", "![](pic7.png)")], "doc_id long, path string, md_content string")
    assert sorted((r.doc_id, r.name) for r in referenced_images(images, ends, by_suffix=True).collect()) == [(1, "pic12.png"), (1, "pic7.png")]
    assert sorted((r.doc_id, r.name) for r in referenced_images(images, ends).collect()) == [(1, "pic12.png")]


def test_a_change_writes_the_buckets_it_touches(spark, tmp_path, monkeypatch):
    kept = messages_table(str(tmp_path / "m"), 16)
    assert read_buckets(spark, kept).count() == 0
    base = spark.range(400).select(F.concat(F.lit("m"), "id").alias("message_id"), F.concat(F.lit("s"), F.col("id") % 50).alias("session_id"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"), F.lit(None).cast("string").alias("rewritten_query"), F.lit(None).cast("array<string>").alias("item_names"), F.col("id").cast("double").alias("ts"))
    append(base, kept)
    before = folders(spark, kept)[1]
    assert len(before) > 8 and read_buckets(spark, kept).count() == 400
    one = spark.createDataFrame([("m7", "s7", "user", "edited", None, None, 900.0)], MESSAGES)
    hit = upsert_stored(one, kept)
    after = folders(spark, kept)[1]
    assert len(hit) == 1 and {b for b in before if before[b] != after[b]} == set(hit)
    assert sorted(r.text for r in read_buckets(spark, kept).collect()) == sorted("edited" if i == 7 else str(i) for i in range(400))
    files = len(os.listdir(tmp_path / "m"))

    def stop(*_):
        raise OSError("crash")

    monkeypatch.setattr("lorewell.plans.buckets.commit", stop)
    with pytest.raises(OSError):
        upsert_stored(one.withColumn("text", F.lit("lost")), kept)
    monkeypatch.undo()
    assert len(os.listdir(tmp_path / "m")) == files + 1 and read_buckets(spark, kept).filter("text = 'edited'").count() == 1
    with pytest.raises(RuntimeError):  # a second writer that started from the same version
        commit(spark, kept, folders(spark, kept)[0], {})
    assert len(clear_stored(spark.createDataFrame([("s7",), ("s8",), ("none",)], "session_id string"), kept)) <= 3
    assert read_buckets(spark, kept).count() == 400 - 16
    # null sessions have a bucket too
    append(one.withColumn("session_id", F.lit(None).cast("string")), kept)
    assert read_buckets(spark, kept).filter("session_id is null").count() == 1
