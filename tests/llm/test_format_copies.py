from __future__ import annotations

import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from scriptorium.llm import format_copies as C
from scriptorium.llm import textcore as core

WORDS = [f"word{i}" for i in range(400)]


def sentence(seed, n=40):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


def frame(spark, texts, src="t"):
    rows = [(src, i, t, "clash", 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "src_table string, row_id long, text string, k1 string, n long")


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60), st.text(max_size=60))
def test_hash_agrees_with_canonical_strings(a, b):
    canon = lambda t: "".join(c for c in t.casefold() if c.isalnum())
    ha, hb = core.rolling_hashes([a, b, a + " " + b])[0][:2], core.rolling_hashes([a, b])[1]
    assert (canon(a) == canon(b)) == (ha[0] == ha[1]) == (hb[0] == hb[1])
    assert core.canonical_equal(a, b) == (canon(a) == canon(b))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab1 ,.\nÄß–", max_size=30), min_size=1, max_size=5))
def test_words_agree_with_a_pattern(texts):
    expected = [re.findall(r"[^\W_]+", t.casefold()) for t in texts]
    hashes, counts = core.words(texts)
    assert counts.tolist() == [len(x) for x in expected]
    flat = [w for x in expected for w in x]
    for i, a in enumerate(flat):
        for j, b in enumerate(flat):
            assert (hashes[i] == hashes[j]) == (a == b)


def test_copies_and_fields(spark):
    base = sentence(1)
    fields = [f"Label{i}: value {i} " + " ".join(WORDS[i * 9 : i * 9 + 9]) for i in range(5)]
    texts = [
        base, base.upper(), "  " + base.replace(" ", ",\n"), sentence(2), None, "", " \n", "short text", "short text",
        "|".join(fields), "\n".join(reversed(fields)), ";".join(fields[:3] + fields[4:] + fields[3:4]), " ".join(fields).replace(":", " "),
        base + "x",
    ]
    found = sorted((r["row_a"], r["row_b"]) for r in C.find_copies(frame(spark, texts)).collect())
    assert found == [(0, 1), (0, 2), (9, 10), (9, 11), (9, 12)]
    copies = {r["row_id"]: r["copies"] for r in C.collapse(frame(spark, texts)).collect()}
    assert copies[0] == 3 and copies[9] == 4 and copies[4] == 1 and len(copies) == len(texts) - 5


def test_tables_are_apart_and_empty_tables_work(spark):
    both = frame(spark, [sentence(1)], "a").unionByName(frame(spark, [sentence(1)], "b"))
    assert C.find_copies(both).count() == 0
    assert C.find_copies(both.limit(0)).count() == 0
    assert C.collapse(both.limit(0)).count() == 0


def test_hot_group_and_long_text(spark):
    long = " ".join(WORDS * 500)
    texts = [sentence(5)] * 700 + [sentence(i) for i in range(100, 300)] + [long, long.upper()]
    found = C.find_copies(frame(spark, texts))
    assert found.where("row_a = 0").count() == 699
    assert found.where("row_a = 900").count() == 1 and found.count() == 700


def test_collisions_are_taken_apart(spark, monkeypatch):
    assert C._exact_key("Ab c") == C._exact_key("a-BC") != C._exact_key("abd")
    assert core.fields_equal("a: 1|b: 2|c: 3|d: 4", "d:4;C:3;b:2;a:1")
    assert not core.fields_equal("a: 1|b: 2|c: 3|d: 4", "d:4;C:3;b:2;a:2")
    assert core.fields_of("a: 1|b: 2|c: 3") is None and core.fields_of("a: 1|b: 2|c: 3:4|d: 5") is None
    assert np.array_equal(core.field_hashes(["a:1\nb:2\nc:3\nd:4"])[0], core.field_hashes(["d:4|c:3|b:2|a:1"])[0])
