from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from scriptorium.llm import history as H
from scriptorium.llm import near_copies as N
from scriptorium.llm import textcore as core

from .test_format_copies import WORDS, frame, sentence


def grams(text):
    w = text.lower().split()
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)}


def edited(text, n, seed):
    rng, w = random.Random(seed), text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
    return " ".join(w)


def corpus(seed, n=60):
    rng, texts = random.Random(seed), []
    for i in range(n):
        base = sentence(seed * 1000 + i, 80)
        texts.append(base)
        for e in range(rng.randrange(3)):
            texts.append(edited(base, rng.randrange(1, 9), e * 31 + i))
    return texts


def brute(texts):
    out = set()
    for i, a in enumerate(texts):
        for j in range(i):
            x, y = grams(a), grams(texts[j])
            if len(x & y) * 5 >= 3 * len(x | y) and a.lower() != texts[j].lower():
                out.add((j, i))
    return out


def test_depth_shrinks_until_the_target():
    assert N.depth_for_recall(0.6, 48, 0.97) == 5
    assert N.depth_for_recall(0.9, 48, 0.97) > N.depth_for_recall(0.6, 48, 0.97) > N.depth_for_recall(0.6, 8, 0.97)


def test_depth_is_measured():
    assert N.depth_reached({(9, 32): 100, (5, 12): 500}) == 9  # unlikely pairs don't count
    assert N.depth_reached({(9, 32): 100, (7, 24): 5}) == 7
    assert N.depth_reached({(9, 32): 100, (5, 20): 50}) == N.depth_reached({}) == N.SHORTEST == 5


def test_wide_nodes_give_the_same_pairs(spark):
    base = sentence(3, 80)
    texts = [edited(base, 4, i) for i in range(60)] + corpus(4, 20)
    reps = N.signatures(frame(spark, texts))

    def pairs(**how):
        return {(r["a"], r["b"]) for r in N.by_sketch(N.candidate_pairs(reps, **how), reps).collect()}

    narrow = pairs()
    assert len(narrow) > 1000 and pairs(wide=5) == narrow
    assert pairs(wide=5, deep=None) == narrow and pairs(wide=5, deep=10) <= narrow


def test_deep_nodes_lose_no_pair(spark, monkeypatch):
    base = sentence(3, 80)
    texts = [edited(base, 4, i) for i in range(60)] + corpus(4, 20)
    rows = frame(spark, texts)
    reps = N.signatures(rows)

    def pairs(**how):
        found = N.verify(N.by_sketch(N.candidate_pairs(reps, **how), reps).select("src_table", "a", "b"), rows)
        return {(r["a"], r["b"]) for r in found.collect()}

    narrow = pairs()
    assert len(narrow) > 500 and pairs(wide=5, deep=10) == narrow
    monkeypatch.setattr(N, "BLOCK", 16)
    monkeypatch.setattr(N, "DEEP_BLOCK", 40)
    assert pairs(wide=5, deep=10) == pairs(wide=5, deep=None) == narrow


def test_keys_are_dealt_whole_and_packed():
    rng, rows = np.random.default_rng(3), 50
    labels = rng.integers(0, 1 << 48, (rows, N.TREES))
    labels[7] = labels[9]  # two rows of one node in every tree
    ids = rng.integers(-(1 << 63), (1 << 63) - 1, rows)
    ids[:2] = -(1 << 63), (1 << 63) - 1
    ords, codes = np.arange(rows, dtype=np.int32) * 1000 - 7, np.arange(rows) % 2
    batch = pa.table({"row_id": ids, "ord": ords, "code": codes.astype(np.int64), "labels": list(labels)}).to_batches()[0]
    dealt = [x for part in N._dealer(5)(iter([batch.slice(0, 0), batch.slice(0, 20), batch.slice(20)])) for x in part.to_pylist()]
    assert len(dealt) <= 2 * 5 and {x["part"] for x in dealt} == set(range(5))  # a row for each part of a batch, none for each key
    found, where = [], {}
    for x in dealt:
        keys = np.frombuffer(x["keys"], np.int64).tolist()
        row, ord_ = (N._unpack(x[f"{c}_least"], x[f"{c}_width"], x[f"{c}s"]).tolist() for c in ("row", "ord"))
        found += zip(keys, row, ord_, strict=True)
        assert all(where.setdefault(k >> 16, x["part"]) == x["part"] for k in keys)
    wanted = [((t * N.MOST_TABLES + int(codes[r])) << 48) + int(labels[r, t]) for r in range(rows) for t in range(N.TREES)]
    wanted = [(k - (1 << 64) if k >> 63 else k, int(ids[i // N.TREES]), int(ords[i // N.TREES])) for i, k in enumerate(wanted)]
    assert sorted(found) == sorted(wanted)


def test_many_parts_give_the_same_pairs(spark, monkeypatch):
    reps = N.signatures(frame(spark, corpus(4, 20)))

    def pairs():
        return {(r["a"], r["b"], r["depth"]) for r in N.candidate_pairs(reps).collect()}

    narrow = pairs()
    monkeypatch.setattr(N, "PART_KEYS", 200)
    assert len(narrow) > 10 and pairs() == narrow


def test_signing_folds_a_text_once(monkeypatch):
    calls, folded = [], core.folded
    monkeypatch.setattr(core, "folded", lambda texts: calls.append(texts) or folded(texts))
    texts = [sentence(i, 40) for i in range(3)]
    signed = N._signer([], N.SHINGLE, N.MIN_WORDS)({"src_table": ["t"] * 3, "row_id": [1, 2, 3]}, texts)
    assert calls == [texts] and signed["row_id"] == [1, 2, 3]


def test_sketches_leave_out_no_similar_pair():
    texts = [t for i in range(40) for t in (sentence(i, 60 + 10 * i), edited(sentence(i, 60 + 10 * i), 5 + i, i))]
    grams_, counts = core.distinct_per_text(*core.shingles(*core.words(texts), N.SHINGLE))
    sets = [set(x.tolist()) for x in np.split(grams_, np.cumsum(counts)[:-1])]
    words, spare = N._unpacked([x.tobytes() for x in N._sketches(grams_, counts)], counts)
    near = 0
    for i in range(len(texts)):
        most = np.bitwise_count(words & words[i]).sum(axis=1).astype(int) + np.minimum(spare, spare[i])
        for j in range(len(texts)):
            assert len(sets[i] & sets[j]) <= most[j]
            near += i != j and 8 * most[j] < 3 * (counts[i] + counts[j])
    assert near > 5000  # of 6,320: most pairs of unlike texts are left out


def test_pairs_against_brute_force(spark):
    texts = corpus(1)
    texts += [texts[0], texts[0].upper(), None, "", "short", "short"]
    truth = brute([t or "" for t in texts[:-4]])
    found = {(r["row_a"], r["row_b"]) for r in N.find_pairs(frame(spark, texts)).collect()}
    assert found <= truth and len(found) >= 0.97 * len(truth)
    assert N.find_pairs(frame(spark, texts).limit(0)).count() == 0
    linked = {r["row_id"]: r for r in N.groups(frame(spark, texts)).collect()}
    assert len(linked) == len(texts)
    for a, b in found:
        assert linked[a]["group_id"] == linked[b]["group_id"]
    assert linked[len(texts) - 1]["links"] == 0


def test_a_crowd_of_nearer_pairs_drops_no_others(spark):
    crowd, pairs = [edited(sentence(31, 80), 1, i) for i in range(90)], []
    for i in range(40):
        a = sentence(7000 + i, 80)
        b = edited(a, 6, i)
        if len(pairs) < 3 and 0.6 <= len(grams(a) & grams(b)) / len(grams(a) | grams(b)) <= 0.65:
            pairs.append((a, b))
    texts = crowd + [t for pair in pairs for t in pair]
    planted = {(90 + 2 * k, 91 + 2 * k) for k in range(3)}
    assert len(pairs) == 3
    found = {(r["row_a"], r["row_b"]) for r in N.find_pairs(frame(spark, texts)).collect()}
    assert planted <= found
    runs = spark.createDataFrame([("r0", 1), ("r1", 2)], "pipeline_run_id string, run_no int")
    chunks = spark.createDataFrame([(i, t, f"r{i % 2}") for i, t in enumerate(texts)], "chunk_row long, content string, pipeline_run_id string")
    jobs = spark.createDataFrame([], "id long, checksum string, job_status string, status string, pipeline_run_id string")
    cases = {r["row_id"] for r in H.find_repeats(chunks, jobs, runs, 1).collect()}
    assert {b for _, b in planted} <= cases and cases == brute_history(texts, [i % 2 for i in range(len(texts))])


def test_blocks_skip_pairs_of_old_rows_only(spark, monkeypatch):
    texts = [edited(sentence(3, 80), 4, i) for i in range(60)]
    reps = N.signatures(frame(spark, texts).selectExpr("*", "cast(row_id % 4 as int) as run"), "run")

    def pairs(**how):
        return {(r["a"], r["b"]) for r in N.by_sketch(N.candidate_pairs(reps, "run", 2, **how), reps).collect()}

    narrow = pairs()
    monkeypatch.setattr(N, "BLOCK", 16)
    assert len(narrow) > 500 and pairs(wide=5) == narrow


def test_hot_class_of_copies(spark):
    base = sentence(7, 80)
    near = edited(base, 2, 3)
    texts = [base] * 400 + [near] + [sentence(i, 80) for i in range(5000, 5200)]
    found = N.find_pairs(frame(spark, texts))
    assert found.count() == 400 and found.where("row_b = 400").count() == 400


def test_history(spark):
    base, other = sentence(11, 80), sentence(12, 80)
    chain = [edited(base, 5, 1)]
    rows = [
        (1, base, "r1"), (2, base, "r1"), (3, base.upper(), "r2"), (4, chain[0], "r2"), (5, other, "r3"), (6, edited(other, 4, 2), "r3"),
        (7, edited(other, 3, 9), "r4"), (8, None, "r4"), (9, base, "unknown"), (10, base, None), (11, "short", "r4"), (12, "short", "r1"),
    ]
    chunks = spark.createDataFrame(rows, "chunk_row long, content string, pipeline_run_id string")
    runs = spark.createDataFrame([("r4", 4), ("r1", 1), ("r3", 3), ("r2", 2)], "pipeline_run_id string, run_no int")
    sum_ = "AB" * 32
    jobs = spark.createDataFrame(
        [
            (1, f"sha256:{sum_}", "COMPLETED", None, "r1"), (2, sum_.lower(), None, None, "r2"), (3, sum_, None, None, "r1"),
            (4, "unknown", "COMPLETED", None, "r1"), (5, "unknown", None, None, "r2"), (6, "c" * 64, None, "success ", "r2"),
            (7, "C" * 64, None, None, "r3"), (8, "d" * 65, "COMPLETED", None, "r1"), (9, "d" * 65, None, None, "r2"), (10, None, None, None, None),
        ],
        "id long, checksum string, job_status string, status string, pipeline_run_id string",
    )
    found = {(r["kind"], r["row_id"]) for r in H.find_repeats(chunks, jobs, runs).collect()}
    assert found == {("chunk", 3), ("chunk", 4), ("chunk", 7), ("job", 2), ("job", 7)}
    assert H.find_repeats(chunks.limit(0), jobs.limit(0), runs).count() == 0


def test_a_case_is_not_history(spark):
    a = sentence(21, 100)
    b = " ".join(a.split()[20:] + WORDS[:20])
    c = " ".join(a.split()[40:] + WORDS[:40])
    x = grams(a)
    assert len(x & grams(b)) / len(x | grams(b)) >= 0.6 > len(x & grams(c)) / len(x | grams(c))
    rows = [(1, a, "r1"), (2, b, "r2"), (3, c, "r3"), (4, c, "r4")]
    chunks = spark.createDataFrame(rows, "chunk_row long, content string, pipeline_run_id string")
    runs = spark.createDataFrame([(f"r{i}", i) for i in range(1, 5)], "pipeline_run_id string, run_no int")
    jobs = spark.createDataFrame([], "id long, checksum string, job_status string, status string, pipeline_run_id string")
    # b repeats a and is rejected; c is like b only, so it is accepted and its own copy is the next case
    assert {r["row_id"] for r in H.find_repeats(chunks, jobs, runs).collect()} == {2, 4}


def test_batches_against_a_stored_history(spark, tmp_path, monkeypatch):
    texts = corpus(9, 30)
    rows = frame(spark, texts).selectExpr("src_table", "row_id", "text", "cast(row_id % 4 + 1 as int) as run_no")
    history = H.History(spark, f"file://{tmp_path}/history")
    found, signed = set(), []
    sign = H.sign
    monkeypatch.setattr(H, "sign", lambda batch: signed.append({r["row_id"] for r in batch.select("row_id").collect()}) or sign(batch))
    for run in range(1, 5):  # four batches, each appended before the next
        found |= {r["row_id"] for r in H.check_chunks(rows.where(f"run_no = {run}"), history, f"run-{run}").collect()}
    assert [len(s) for s in signed] == [rows.where(f"run_no = {r}").count() for r in range(1, 5)]  # a batch hashes its own texts only
    assert not set.intersection(*signed)
    at_once = H.look_up(sign(rows), rows, H.History(spark, f"file://{tmp_path}/empty"))
    assert found == {r["row_id"] for r in at_once.cases.collect()}
    kept = {r["row_id"] for r in history.contents().collect()}
    assert kept == {r["row_id"] for r in at_once.accepted.collect()} and not kept & found
    # the same rows once more bring nothing new
    again = rows.where("run_no = 4").selectExpr("src_table", "row_id + 1000 as row_id", "text", "5 as run_no")
    assert H.look_up(sign(again), again, history).cases.count() == again.count()


def brute_history(texts, runs):
    accepted, cases = [], set()
    for run in sorted(set(runs)):
        own = [i for i, r in enumerate(runs) if r == run]
        new = [i for i in own if not any(texts[i].lower() == texts[j].lower() or 5 * len(grams(texts[i]) & grams(texts[j])) >= 3 * len(grams(texts[i]) | grams(texts[j])) for j in accepted)]
        cases |= set(own) - set(new)
        accepted += new
    return cases


def test_history_against_brute_force(spark):
    texts = corpus(14, 40)
    texts += [t.upper() for t in texts[:9]] + texts[:5]
    rng = random.Random(5)
    runs = [rng.randrange(1, 6) for _ in texts]
    chunks = spark.createDataFrame([(i, t, f"r{r}") for i, (t, r) in enumerate(zip(texts, runs))], "chunk_row long, content string, pipeline_run_id string")
    order = spark.createDataFrame([(f"r{i}", i) for i in range(1, 6)], "pipeline_run_id string, run_no int")
    jobs = spark.createDataFrame([], "id long, checksum string, job_status string, status string, pipeline_run_id string")
    truth = brute_history(texts, runs)
    for batches in (1, 3):
        assert {r["row_id"] for r in H.find_repeats(chunks, jobs, order, batches).collect()} == truth
