from __future__ import annotations

import datetime as dt
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import dedup, guards, ledger, metrics, relevance, retrieval, synthesis
from scriptorium.operators.skew import join_groups
from scriptorium.plans import pipeline
from scriptorium.sources import readers, writers

CHUNKS = "chunk_row long, document_name string, page_number int, heading string, content string, n int"


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [
        (1, "Contract_A", 1, "Section 1", "unique sentence", 0), (2, "Contract_A", 2, "Liability", "shared clause", 0),
        (3, "Contract_B", 1, "Overview", "unique  Sentence ", 0), (4, "Contract_B", 3, "Terms", "same shared clause", 0),
        (5, None, None, None, None, 0), (6, "Z", 1, "", "", 0), (7, "Contract_B", 1, "Overview", "unique sentence", 0),
    ]
    return spark.createDataFrame(rows, CHUNKS)


def test_dedup(spark, chunks):
    flags = {r["chunk_row"]: r["is_duplicate"] for r in dedup.flag_duplicates(chunks).collect()}
    assert flags == {1: False, 2: False, 3: True, 4: False, 5: False, 6: True, 7: True}
    sources = {r["chunk_row"]: r["sources"] for r in dedup.running_sources(chunks).collect()}
    assert sources[1] == "Contract_A:p1" and sources[3] == sources[7] == "Contract_A:p1; Contract_B:p1" and sources[5] == ":p0"
    summary = dedup.summarise(chunks).first()
    assert (summary["indexed"], summary["deduplicated"]) == (4, 3)
    rolled = {r["sources"]: r for r in dedup.roll_up_sources(chunks).collect()}
    assert rolled["Contract_A:p1; Contract_B:p1"]["copies"] == 3
    vectors = pipeline.vectorize(chunks)
    assert vectors.count() == 7 and vectors.where("metadata.deduplicated").count() == 3
    assert dedup.registry(vectors).count() == 3  # the empty text isn't usable
    known = {r["chunk_row"]: r["known"] for r in dedup.against_registry(chunks, vectors).collect()}
    assert known[1] and not known[5]
    for operator in (dedup.flag_duplicates, dedup.running_sources, dedup.roll_up_sources):
        assert operator(chunks.limit(0)).count() == 0


def test_join_groups_with_a_hot_key(spark):
    rows = spark.range(9000).select("id", F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("key"))
    groups = rows.groupBy("key").agg(F.count("*").alias("n"))
    out = join_groups(rows, groups, ["key"], "n")
    assert out.count() == 9000 and out.where("key = -1 and n = 3000").count() == 3000


def test_search_and_answer(spark, chunks):
    corpus = pipeline.corpus_of_chunks(chunks)
    found = pipeline.search(corpus, "shared clause", 2).orderBy("rank").collect()
    assert [r["row_key"] for r in found] == [2, 1]  # the strong top row's document comes first
    assert pipeline.search(corpus, "", 3).count() == 3
    assert pipeline.search(corpus.limit(0), "x", 3).count() == 0
    talk = pipeline.ask(corpus, " Hello! ", 3).first()
    assert talk["citations"] is None and talk["answer"].startswith("Hello")
    answer = pipeline.ask(corpus, "shared clause", 3).first()
    assert answer["total_context_chunks"] >= 1 and answer["answer"]


def test_union_and_siblings(spark):
    def ranking(rows):
        return spark.createDataFrame(rows, "id string, row_key long, document_name string, score double")

    both = retrieval.union_distinct(ranking([("a", 1, "d", 0.2)]), ranking([("a", 2, "d", 0.9), ("b", 3, "e", 0.5), ("b", 4, "e", 0.6)]), "row_key")
    assert sorted((r["id"], r["row_key"]) for r in both.collect()) == [("a", 1), ("b", 4)]
    rows = [("a", 1, "d", 0.55), ("b", 2, "e", 0.50), ("c", 3, "d", 0.10), ("f", 4, "g", 0.39), ("h", 5, "g", 0.40)]
    shown = retrieval.promote_siblings(ranking(rows), 4, "id").orderBy("rank").collect()
    assert [r["id"] for r in shown] == ["a", "c", "b", "h"]
    weak = retrieval.promote_siblings(ranking([("a", 1, "d", 0.549999), *rows[1:]]), 3, "id").orderBy("rank").collect()
    assert [r["id"] for r in weak] == ["a", "b", "h"]


def test_blocks_against_brute_force(spark):
    random.seed(3)
    vectors = [(i, [random.gauss(0, 1) for _ in range(128)]) for i in range(60)] + [(60, None), (61, [1.0])]
    frame = spark.createDataFrame(vectors, "id long, embedding array<float>")
    asked = frame.where("id % 10 = 0").withColumnRenamed("id", "query_id")
    got = retrieval.nearest_in_blocks(frame, asked, 3, block=2, rows=25).collect()
    stored = {r["id"]: r["embedding"] for r in frame.collect() if r["embedding"] and len(r["embedding"]) == 128}
    for q in range(0, 60, 10):
        truth = sorted(stored, key=lambda i: (-sum(a * b for a, b in zip(stored[q], stored[i])), i))[:3]
        assert [r["id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == truth


def test_relevance(spark):
    def results(rows):
        full = [(0, "leave", i + 1, "d", "h", 1, t, s, ["d:p1"]) for i, (t, s) in enumerate(rows)]
        return spark.createDataFrame(full, "query_id int, query string, rank int, document_name string, heading string, page_number int, text string, score double, sources array<string>")

    kept = lambda rows, t=0.25: [r["rank"] for r in relevance.filter_results(results(rows), t).orderBy("rank").collect()]
    assert kept([("good text", 0.9), ("near text", 0.63), ("far text", 0.62)]) == [1, 2]
    assert kept([("good text", 0.64), ("far text", 0.26)]) == [1, 2]
    assert kept([("# Document: x", 0.9), ("weak text", 0.1), ("weaker", 0.05)]) == [2]
    assert kept([(None, 0.9)]) == []
    assert kept([("a text", 0.27)], 0) == [1]  # the fallback row
    cited = relevance.citations(results([("a\nb", 0.5)])).first()
    assert cited["preview"] == "a b" and cited["context"].startswith("[1] Document: d | Page: 1 | Section: h")
    words = spark.createDataFrame([(1, "a b c d e"), (2, None)], "k int, t string")
    groups = relevance.token_groups(words, "k", "t").orderBy("k", "group_no").collect()
    assert [r["token"] for r in groups] == ["a ", "b c d ", "e ", " "]


def test_synthesis():
    text = "### 1.1 Leave\n- Earned leave: thirty days in each year of service\n\nEvery employee may take medical leave on a certificate of the insurer. It is short."
    answer = synthesis.synthesise("medical leave", [text])
    assert "• **Earned leave**: thirty days in each year of service" in answer
    assert answer.startswith("Every employee may take medical leave on a certificate of the insurer.")
    assert synthesis.synthesise("x", []) == synthesis.NO_RESULTS
    assert synthesis.synthesise("leave", ["def a(): return len(b)"]) == synthesis.ONLY_CODE
    assert synthesis.synthesise("zzz", ["word " * 200]).endswith("…")
    assert synthesis.paragraphs("a\nb-\nc\n\n• d\ne") == ["a b-c", "• d e"]
    assert synthesis.paragraphs(None) == []


JOBS = (
    "id long, filename string, checksum string, total_pages int, processed_pages int, total_chunks int, embedded_chunks int, job_status string, status string, "
    "pipeline_run_id string, execution_time_ms long, error_message string, failure_reason string, started_at timestamp, completed_at timestamp, processed_at timestamp"
)


def job(i, name, checksum, state, status=None, error=None, run="r1", pages=3):
    now = dt.datetime(2024, 1, 1, 0, i)
    return (i, name, checksum, pages, 1, 5, 0, state, status, run, 10 * i, error, None, now, None, now)


def test_ledger(spark):
    old = spark.createDataFrame([job(1, "a.pdf", "s1", "FAILED", error="broken"), job(2, "b.pdf", " ", "VALIDATED", run="r2"), job(3, "c.pdf", None, None, "success")], JOBS)
    new = spark.createDataFrame([job(4, "a2.pdf", "s1", "VALIDATED"), job(5, "a2.pdf", "s1", "COMPLETED")], JOBS)
    rows = {r["checksum"]: r for r in ledger.upsert(old, new.where("id = 4")).collect()}
    assert rows["s1"]["filename"] == "a2.pdf" and rows["s1"]["error_message"] == "broken"
    assert set(rows) == {"s1", "unknown_b.pdf", "unknown_c.pdf"} and rows["unknown_c.pdf"]["job_status"] == "COMPLETED"
    done = {r["checksum"]: r for r in ledger.upsert(old, new).collect()}["s1"]
    assert (done["status"], done["error_message"], done["processed_pages"]) == ("SUCCESS", None, 3)
    files = spark.createDataFrame([("s1", 1), ("s9", 2), (None, 3)], "checksum string, n int")
    assert [r["n"] for r in ledger.skipped(files, new).collect()] == [1]
    assert sorted(r["n"] for r in ledger.work_set(files, new).collect()) == [2, 3]
    assert {r["id"] for r in ledger.resumable(old).collect()} == {1, 2}
    assert ledger.latest(old).first()["id"] == 3
    marked = {r["id"]: r for r in ledger.mark_completed(old, "r2").collect()}
    assert marked[2]["status"] == "SUCCESS" and marked[1]["job_status"] == "FAILED"
    assert ledger.mark_failed(old, "s1", "x" * 5000).where("id = 1").first()["error_message"] == "x" * 4000
    assert ledger.upsert(old.limit(0), new.limit(0)).count() == 0
    assert ledger.parse_summary(old).first()["failed"] == 1


def log_of(spark, rows):
    full = [(i, None if ms is None else dt.datetime(2024, 1, 1) + dt.timedelta(milliseconds=ms), c, q, 5, o, lat, ft) for i, (ms, c, q, o, lat, ft) in enumerate(rows)]
    return spark.createDataFrame(full, "request_id long, ts timestamp_ntz, client_key string, query_text string, top_k int, outcome string, latency_ms double, first_token_ms double")


def test_metrics(spark):
    log = log_of(spark, [(i, "c", "q", " success" if i % 4 else "Failure", float(i), 1.005 if i else None) for i in range(100)])
    p = metrics.percentiles(log).first()
    assert (p["samples"], p["p50"], p["p95"], p["p99"]) == (100, 49.0, 94.0, 98.0)
    q = metrics.load_percentiles(log).first()
    assert (q["p50"], q["p95"], q["p99"]) == (50.0, 95.0, 99.0)
    assert metrics.percentiles(log.limit(0)).first()["p99"] == 0
    assert {r["outcome"]: r["requests"] for r in metrics.outcome_counts(log).collect()} == {"SUCCESS": 75, "FAILURE": 25}
    assert metrics.first_token(log).first()["samples"] == 99
    assert metrics.hit_rate(log.select(F.lit(True).alias("hit")).limit(0)).first()["hit_rate"] == 0.0
    assert metrics.percentiles(log_of(spark, [(i, "c", "q", "x", float(i), None) for i in range(2100)])).first()["samples"] == 2048


def test_guards(spark):
    burst = log_of(spark, [(0, "c", "q", "x", 1.0, None)] * 31 + [(1000, "c", "q", "x", 1.0, None)] * 2 + [(0, " ", "q", "x", 1.0, None), (None, "c", "q", "x", 1.0, None)])
    out = {r["request_id"]: r for r in guards.token_bucket(burst).collect()}
    assert len(out) == 34 and [out[i]["allowed"] for i in (29, 30, 31, 32)] == [True, False, True, False] and out[33]["key"] == "anonymous"
    calls = [(i, "c", "q", "fail", 1.0, None) for i in range(10)] + [(5008, "c", "q", "fail", 1.0, None), (5009, "c", "q", "fail", 1.0, None), (10009, "c", "q", "ok", 1.0, None), (10010, "c", "q", "fail", 1.0, None)]
    states = [r["state"] for r in guards.circuit_breaker(log_of(spark, calls), F.col("outcome") == "fail").orderBy("request_id").collect()]
    assert states[8] == "CLOSED" and states[9:] == ["OPEN", "OPEN", "OPEN", "CLOSED", "CLOSED"]
    ttl = guards.ANSWER_TTL_MS
    hits = [r["hit"] for r in guards.expiring_cache(log_of(spark, [(0, "c", " Q", "x", 1.0, None), (ttl, "c", "q", "x", 1.0, None), (ttl + 1, "c", "q ", "x", 1.0, None)])).orderBy("request_id").collect()]
    assert hits == [False, True, False]
    shared = [r["shared"] for r in guards.coalesced(log_of(spark, [(0, "c", "q", "x", 50.0, None), (49, "c", "Q", "x", 9.0, None), (50, "c", "q", "x", None, None)])).orderBy("request_id").collect()]
    assert shared == [False, True, False]
    assert guards.token_bucket(burst.limit(0)).count() == 0


def test_files(spark, chunks, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.PDF").write_bytes(b"page one\fpage two")
    (tmp_path / "in" / "deep" / "bad.pdf").write_bytes(b"x")
    (tmp_path / "in" / "c.txt").write_bytes(b"no")
    files = readers.scan_files(spark, str(tmp_path / "in"))
    assert files.count() == 2
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path / "in"))
    pages, failed = readers.read_pages(raw.where("path like '%pdf' or path like '%PDF'"), lambda b: b.decode().split("\f") if len(b) > 1 else [])
    assert pages.count() == 2 and "no pages" in failed.first()["error"]
    assert readers.inspect_files(spark, str(tmp_path / "in")).first()["strategy"] == "STANDARD_STREAMING"
    lines = [json.dumps({"chunkId": "x", "content": "t"}), "{broken", ""]
    (tmp_path / "c.jsonl").write_text("\n".join(lines))
    good, bad = readers.read_chunks(spark, str(tmp_path / "c.jsonl"))
    assert good.first()["page_number"] == 0 and good.first()["document_name"] == "" and bad.count() == 1
    vectors = pipeline.vectorize(chunks)
    writers.write_vectors(vectors, str(tmp_path / "v"))
    back = spark.read.json(str(tmp_path / "v"))
    assert back.count() == 7
    writers.write_chunks(chunks.withColumn("chunk_id", F.lit("a")).withColumn("character_count", F.lit(1)), str(tmp_path / "k"))
    assert spark.read.json(str(tmp_path / "k")).count() == 7
    sent = writers.add_to_index(vectors, lambda rows: None).first()
    assert (sent["sent"], sent["failed"]) == (7, 0)

    def refuse(rows):
        raise OSError

    assert writers.add_to_index(vectors.select("id"), refuse, pause=0.001).first()["failed"] == 7


def test_stream_equals_batch(spark, tmp_path):
    from scriptorium.streaming import guards as streaming

    log = log_of(spark, [(100 * (i % 7), f"c{i % 3}", "q", "x", 1.0, None) for i in range(120)]).coalesce(1)
    log.write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(log.schema).parquet(str(tmp_path / "log"))
    out = streaming.token_bucket(stream).writeStream.format("memory").queryName("buckets").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert out.awaitTermination(120)
    got = {r["request_id"]: r["flag"] for r in spark.table("buckets").collect()}
    assert got == {r["request_id"]: r["allowed"] for r in guards.token_bucket(log).collect()}


def test_idle_states_expire(spark, tmp_path):
    from scriptorium.streaming import guards as streaming

    hour = 3_600_000
    batches = [[(0, "a", "q", "x", 1.0, None)] * 31], [[(30 * hour, "b", "q", "x", 1.0, None)]], [[(60 * hour, "b", "q", "x", 1.0, None)]]
    for n, (rows,) in enumerate(batches):
        log_of(spark, rows).coalesce(1).write.parquet(str(tmp_path / "log" / f"n={n}"))
        stream = spark.readStream.schema(log_of(spark, rows).schema).parquet(str(tmp_path / "log" / "n=*"))
        query = streaming.token_bucket(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).outputMode("append")
        query = query.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
    state = query.lastProgress["stateOperators"][0]
    assert state["numRowsTotal"] == 1  # b alone
    assert spark.read.parquet(str(tmp_path / "out")).where("not flag").count() == 1


def test_ledger_is_updated_twice(spark):
    old = [job(1, "a.pdf", "s1", "FAILED", error="broken"), job(2, "b.pdf", " ", "VALIDATED", run="r2")]
    a = [job(4, "a2.pdf", "s1", "VALIDATED")]
    b = [job(6, "a2.pdf", "s1", "FAILED", error="again"), job(7, "c.pdf", "s3", None, "success")]
    old, a, b = (spark.createDataFrame(x, JOBS) for x in (old, a, b))
    twice, once = ledger.upsert(ledger.upsert(old, a), b), ledger.upsert(old, a.unionByName(b))
    assert twice.columns == [c for c, _ in ledger._COLUMNS] and twice.schema == ledger.upsert(twice, b.limit(0)).schema
    assert sorted(map(str, twice.collect())) == sorted(map(str, once.collect()))
    assert {r["checksum"]: r["error_message"] for r in twice.collect()} == {"s1": "again", "unknown_b.pdf": None, "s3": None}


def test_marks_leave_other_jobs_alone(spark):
    rows = spark.createDataFrame([job(1, "a.pdf", "s1", "FAILED", error="broken", run=None), job(2, "b.pdf", None, None, run="r2")], JOBS)
    for marked in (ledger.mark_completed(rows, "r2"), ledger.mark_failed(rows, "s9", "x")):
        kept = {r["id"]: r for r in marked.collect()}
        assert kept[1]["error_message"] == "broken" and kept[2]["job_status"] is None


def test_ledger_saved_twice(spark, tmp_path):
    jobs = spark.createDataFrame([job(1, "a.pdf", "s1", "VALIDATED", run="r1")], JOBS)
    writers.save_ledger(jobs.limit(0), jobs, str(tmp_path / "one"))
    writers.save_ledger(readers.read_ledger(spark, str(tmp_path / "one")), jobs.withColumn("id", F.lit(5).cast("long")), str(tmp_path / "two"))
    assert readers.read_ledger(spark, str(tmp_path / "two")).first()["id"] == 5


def test_markdown_round_trip(spark, tmp_path):
    names = ["Order 7 (final)", "a/b", "_hidden", ".dot", "50% + 1.md", "x.y.z", "ü ñ", "?*"]
    rows = [(n, f"# {n}\n\nline\r\n\n## Page 2\n") for n in names] + [(None, "x"), ("", "x"), ("empty", ""), ("null", None)]
    documents = spark.createDataFrame(rows, "document_name string, text string")
    assert writers.write_markdown(documents, str(tmp_path / "md")) == len(names)
    back = {r["document_name"]: r["text"] for r in readers.read_staged(spark, str(tmp_path / "md")).collect()}
    assert back == dict(rows[: len(names)])


def test_ingest_against_stored_rows(spark):
    pages = spark.createDataFrame(
        [("A", 1, "The first clause of the order.", "c1"), ("B", 1, "The first clause of the order.", "c2"), ("C", 1, "Another clause.", "c3")],
        "document_name string, page_number int, page_text string, checksum string",
    )
    _, _, first = pipeline.ingest(pages.where("document_name = 'A'"))
    assert first.count() == 2  # the preamble and the page
    first = first.where("text like '%first clause%'")
    chunks = spark.createDataFrame(
        [(11, "B", 1, "h", first.first()["text"] + " "), (12, "C", 1, "h", "new text"), (13, "D", 1, "h", "New  text"), (14, "E", 1, None, None)],
        "chunk_row long, document_name string, page_number int, heading string, content string",
    )
    rows = {r["vec_row"]: r for r in pipeline.vectorize(chunks, first).collect()}
    assert {k: r["metadata"]["deduplicated"] for k, r in rows.items()} == {11: True, 12: False, 13: True, 14: False}
    assert rows[11]["metadata"]["sources"] == "A:p1; B:p1" and rows[13]["metadata"]["sources"] == "C:p1; D:p1"
    assert rows[11]["embedding"] == first.first()["embedding"] and rows[13]["embedding"] == rows[12]["embedding"]
    done = spark.createDataFrame([job(1, "other.pdf", "c1", "COMPLETED"), job(2, "B.pdf", "c2", "FAILED"), job(3, "C.pdf", "c3", "COMPLETED")], JOBS)
    assert {r["document_name"] for r in pipeline.ingest(pages, done)[0].collect()} == {"B"}  # by checksum, whatever the name
    staged = spark.createDataFrame([("other",)], "document_name string")
    assert {r["document_name"] for r in pipeline.ingest(pages, done, staged=staged)[0].collect()} == {"B", "C"}  # C's output is gone
    with pytest.raises(ValueError):
        pipeline.ingest(pages.drop("checksum"), done)


def test_landing_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(b"ORDER OF THE DAY\none\fpage two of it")
    (tmp_path / "in" / "bad.pdf").write_bytes(b"")
    got = []
    query = pipeline.ingest_stream(
        spark, str(tmp_path / "in"), lambda b: b.decode().split("\f"), lambda d, c, v, n: got.append((d.count(), v.count())), str(tmp_path / "cp")
    )
    query.awaitTermination(120)
    assert got == [(1, 3)]  # the preamble and two pages


def test_workspace_is_deleted(spark):
    from scriptorium.session import workspace, write_table

    with workspace(spark) as path:
        kept = write_table(spark.range(5).toDF("n"), "numbers")
        assert kept.count() == 5 and os.path.isdir(path.removeprefix("file://"))
    assert not os.path.exists(path.removeprefix("file://"))


def test_ask_with_a_model(spark, chunks):
    corpus = pipeline.corpus_of_chunks(chunks)
    told = pipeline.ask(corpus, "shared clause", 2, lambda asked: ["Told: " + p.split("QUESTION:\n")[1].split("\n")[0] for p in asked]).first()
    assert told["answer"] == "Told: shared clause" and told["citations"]

    def broken(asked):
        raise OSError

    for model in (broken, lambda asked: [" "] * len(asked)):
        assert pipeline.ask(corpus, "shared clause", 2, model).first()["answer"] == pipeline.ask(corpus, "shared clause", 2).first()["answer"]


def test_external_index(spark, chunks):
    from scriptorium.sources import index

    corpus = pipeline.corpus_of_chunks(chunks)
    plain = pipeline.search(corpus, "shared clause", 2).select("row_key", "score").collect()

    def broken(vector, k):
        raise OSError

    for ask in (broken, lambda vector, k: [], lambda vector, k: None):
        assert pipeline.search(corpus, "shared clause", 2, ask).select("row_key", "score").collect() == plain
    answer = [{"id": "x", "text": "shared clause of the index", "distance": 0.1, "document": "Far"}, {"id": "y"}]
    found = {r["id"]: r for r in index.candidates(spark, lambda vector, k: answer, "shared clause", 2).collect()}
    assert (found["y"]["document_name"], found["y"]["page_number"], found["y"]["heading"], found["y"]["score"]) == ("Unknown", 1, "General", 0.5)
    assert found["x"]["sources"] == ["Far:p1"] and abs(found["x"]["score"] - 0.95) < 1e-9
    assert pipeline.search(corpus, "shared clause", 5, lambda vector, k: answer).where("id = 'x'").count() == 1  # after the top row's siblings
    vectors = pipeline.vectorize(chunks)
    sent = index.resync(vectors, lambda rows: None).first()
    assert (sent["sent"], sent["failed"]) == (5, 0)  # the two empty texts aren't usable
