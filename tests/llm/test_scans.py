from __future__ import annotations

import random
import re

from scriptorium.llm import scans as S

NAMES = ["council", "receiving", "depot", "guarantee", "secretary", "employee", "inspection", "register", "provisional", "certificate", "contractor", "months", "against", "written"]


def prose(seed, n=40):
    rng = random.Random(seed)
    return " ".join(rng.choice(NAMES) for _ in range(n)) + "."


def wrapped(words, width=6):
    return "\n".join(" ".join(words[i : i + width]) for i in range(0, len(words), width))


def test_distance():
    for seen, meant in (("ernployee", "employee"), ("counciI", "council"), ("inspecti0n", "inspection"), ("heacl", "head"), ("kcpt", "kept"), ("a9ainst", "against")):
        assert S.weighted_distance(seen, meant) <= S.CHEAP + 1e-9 < S.DEAR
    assert S.weighted_distance("abcd", "abxd") == S.DEAR
    assert S._misread_cost("collcet", "collect") == S.DEAR
    assert "cat" in S.deletes("chat") and "at" in S.deletes("chat") and "t" not in S.deletes("chat")


def test_running_lines():
    lines = [prose(1), "Page 94 of 134", prose(2), "", "[93]", "", prose(3), "LEGAL BRANCH — FOR OFFICIAL USE", prose(4), "Rules Vol II      6", prose(5)]
    assert S.running_lines(lines, "Rules_Vol_II") == [1, 4, 9]
    kept, running = S.clean_lines("\n".join(lines), "Rules_Vol_II", [S.mask(lines[7])])  # a stamp is known by its recurrence
    assert running and [x for x in kept if x] == [lines[i] for i in (0, 2, 6, 8, 10)]
    assert S.running_lines(["## Page 3", prose(1), prose(2), prose(3)], "x") == []
    assert S.running_lines(["5", "6", "7"], "x") == []
    assert S.running_lines([prose(1), "page 1 of 71.", prose(2), prose(3)], "x") == []


def test_noise_and_repair(spark):
    clean = [(i, "Rules_A", prose(i)) for i in range(300)]
    words = prose(900).rstrip(".").split()
    broken = wrapped(words[:12]) + " inspec-\ntion of the " + wrapped(words[12:])
    cases = [
        (1000, "Rules_A", wrapped(words)), (1001, "Rules_A", broken), (1002, "Rules_A", prose(901).replace("employee", "ernployee").replace("council", "counciI") + " the ernployee"),
        (1003, "Rules_A", wrapped(words[:18]) + "\n\nRULES A      7\n\n" + wrapped(words[18:])), (1004, None, None), (1005, "Rules_A", ""), (1006, "x", " \n"),
        (1007, "Rules_A", "stand-alone forms of co-operatives are kept by the co-\noperatives of the depot and of the council in the same register of months"),
        (1008, "Rules_A", "co-operatives and the council"), (1009, "x", "word " * 60_000),
    ]
    frame = spark.createDataFrame([("t", i, n, t, "clash") for i, n, t in clean + cases], "src_table string, row_id long, document_name string, text string, word string")
    found = {r["row_id"]: r for r in S.noise(frame).collect()}
    assert set(found) == {1001, 1002, 1003}
    fixed = {r["row_id"]: r["text"] for r in S.repair(frame).collect()}
    assert "inspection of the" in fixed[1001] and "\n" not in fixed[1001]
    assert "ernployee" not in fixed[1002] and "counciI" not in fixed[1002] and "the employee" in fixed[1002]
    assert "RULES" not in fixed[1003] and fixed[1003] == " ".join(words)
    assert S.noise(frame.limit(0)).count() == 0


def test_paragraphs_are_joined():
    text = "### Head\nfirst line\nsecond line\n\nnext para-\ngraph\n- item"
    assert S.repair_text(text, "", {}, set()) == "### Head\nfirst line second line\n\nnext paragraph\n- item"
    assert S.repair_text("a co-\noperative", "", {}, {"co-operative"}) == "a co-operative"
    assert S.repair_text("The Heacl", "", {"heacl": "head"}, set()) == "The Head"


def test_copies_of_noisy_text_count_once(spark):
    clean = [(i, "Rules_A", prose(i)) for i in range(300)]
    noisy = prose(901).replace("employee", "ernployee") + " the ernployee"
    copies = [(1000 + i, "Rules_A", noisy.replace(" ", "  ", i % 3)) for i in range(200)]
    rare = [(2000, "Rules_A", prose(902) + " the zeugnis"), (2001, "Rules_A", prose(903) + " the zeu9nis")]
    frame = spark.createDataFrame([("t", *r) for r in clean + copies + rare], "src_table string, row_id long, document_name string, text string")
    found = {r["row_id"]: {f["seen"]: f["meant"] for f in r["fixes"]} for r in S.noise(frame).collect()}
    assert set(found) == {*range(1000, 1200), 2001}
    assert found[1000] == {"ernployee": "employee"} and found[2001] == {"zeu9nis": "zeugnis"}


def test_readings():
    assert S.readings("emp1oyee") == ["empioyee", "employee"] and S.readings("con†ract") == ["contract"]
    assert S.readings("a4b") == S.readings("x2y1z") == S.readings("word") == S.readings("word†") == []


def test_headers_by_recurrence(spark):
    def scanned(i, header):
        words = prose(3000 + i).rstrip(".").split()
        return wrapped(words[:18]) + "\n" + header + "\n" + wrapped(words[18:])

    rows = [(i, f"D{i % 2}", scanned(i, f"Northern Railway Stores {i}")) for i in range(4)] + [(10, "D5", scanned(10, "Once Only"))]
    rows += [(20 + i, "D9", prose(i)) for i in range(5)]
    narrow = ["the council", "and depot", "Form Nine", "of the", "register is", "kept in", "months", "by it"]
    rows += [(30 + i, "D7", "\n".join([*narrow[:2], f"Form {i}", *narrow[3:], f"as item{'x' * i}"])) for i in range(3)]
    frame = spark.createDataFrame([("t", *r) for r in rows], "src_table string, row_id long, document_name string, text string")
    found = {r["row_id"]: r for r in S.noise(frame).collect()}
    assert set(found) == {0, 1, 2, 3, 30, 31, 32} and all(r["running"] for r in found.values())
    fixed = {r["row_id"]: r["text"] for r in S.repair(frame).collect()}
    assert fixed[0] == prose(3000).rstrip(".") and "Form" not in fixed[30]


def test_capitalised_short_and_doubled_misreads(spark):
    words = ("F0rm", "Up0n", "Artic1e", "C1ause", "Sh0uld", "M0nday", "Secti0n", "Ru1e", "Zentra1lager", "sha11", "l00k", "0f", "1n", "SECTI0N")
    assert all(map(S._telling, words))
    assert not any(map(S._telling, ("A75", "B0L", "I1O0", "10l", "10th", "1st", "1er", "D1012", "2026", "tbe")))
    plain = "form upon article clause should monday section rule zentrallager shall look of in"
    rows = [(i, f"{prose(i)} {plain} {i}") for i in range(100)] + [(200 + i, f"{prose(500 + i)} {w} here") for i, w in enumerate(words)] + [(300, prose(600) + " A75 B0L 10th 1st")]
    frame = spark.createDataFrame([("t", i, "D", t) for i, t in rows], "src_table string, row_id long, document_name string, text string")
    assert {r["row_id"] for r in S.noise(frame).collect()} == {200 + i for i in range(len(words))}
    fixed = {r["row_id"]: r["text"] for r in S.repair(frame).collect()}
    assert fixed[200].endswith(" Form here") and fixed[209].endswith(" shall here") and fixed[211].endswith(" of here") and fixed[213].endswith(" SECTION here")


def test_neighbours_decide_between_words(spark):
    rng = random.Random(4)
    texts = [f"On day {rng.randrange(99)} the outer pumps fail under load and are set aside." for _ in range(40)]
    texts += [f"In year {rng.randrange(99)} all rents fall towards winter and are set anew." for _ in range(60)]
    texts += ["As before the outer pumps fa1l under load again.", "As before all rents fa1l towards winter again.", "As before they fa1l."]
    rows = [("t", i, "d", x) for i, x in enumerate(texts)]
    frame = spark.createDataFrame(rows, "src_table string, row_id long, document_name string, text string")
    fixes = {r["row_id"]: {f["seen"]: f["meant"] for f in r["fixes"]} for r in S.noise(frame).collect()}
    assert fixes == {100: {"fa1l": "fail"}, 101: {"fa1l": "fall"}, 102: {"fa1l": "fall"}}


def test_short_words_keep_their_confusions():
    for seen, meant in (("tirne", "time"), ("gatber", "gather"), ("nodem", "nodern"), ("modem", "modern"), ("sbips", "ships"), ("vvorks", "works"), ("cliet", "diet"), ("sha11", "shall"), ("c0ci", "coci")):
        assert S.seen_keys(seen) & S.lexicon_keys(meant), (seen, meant)
    assert len(S.lexicon_keys("depots")) < len(S.deletes("depots")) / 2


def test_plans_hold_few_broadcasts(spark, monkeypatch):
    plans, write = {}, S.write_table

    def noted(df, name, *rest):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, name, *rest)

    monkeypatch.setattr(S, "write_table", noted)
    rows = [(i, "Rules_A", prose(i)) for i in range(100)] + [(1000, "Rules_A", prose(901).replace("employee", "ernployee") + " the inspec-\ntion of the depot")]
    frame = spark.createDataFrame([("t", *r) for r in rows], "src_table string, row_id long, document_name string, text string")
    assert [r["row_id"] for r in S.noise(frame).collect()] == [1000]
    joins = [x for x in plans["scan-likely"].splitlines() if re.search(r"Join.* \[key#\d+\], \[key#\d+\]", x)]
    assert joins and all("SortMergeJoin" in x for x in joins)  # the index isn't broadcast
    assert max(plan.count("BroadcastExchange") for plan in plans.values()) <= 6
