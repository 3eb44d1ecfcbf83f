from __future__ import annotations

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scriptorium.functions import predicates as P
from scriptorium.functions import text as T
from scriptorium.functions import vector as V


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'int' if isinstance(v, int) else 'array<string>'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


def test_content_hash(spark):
    h = lambda t: one(spark, T.content_hash(F.col("t")), t=t)
    assert h("  The Shared\n\tClause ") == h("the shared clause") == "chk_" + hashlib.sha256(b"the shared clause").hexdigest()[:16]
    assert h(None) == h("") == h(" \t\n　") == "chk_empty"
    assert h("ÄÖ") == h("äö") != h("ao")
    assert h("a" * 300_000).startswith("chk_")


def test_small_functions(spark):
    assert one(spark, T.base_name(F.col("t")), t="a.b.pdf") == "a.b"
    assert one(spark, T.preview(F.col("t"), 5), t="a  b\nc d e") == "a b c..."
    assert one(spark, T.preview(F.col("t"), 5), t=None) == ""
    assert one(spark, T.sources_list(F.col("s"), F.col("d"), F.col("p")), s="a; ;b", d="x", p=3) == ["a", "b"]
    assert one(spark, T.sources_list(F.col("s"), F.col("d"), F.col("p")), s=None, d="x", p=3) == ["x:p3"]
    assert one(spark, T.citation_label(F.col("d"), F.col("s")), d="x", s=["a", "b"]) == "x (also in: a, b)"
    assert one(spark, T.client_address(F.col("a"), F.col("b"), F.col("c")), a=" 1.1.1.1, 2", b="3", c="4") == "1.1.1.1"
    assert one(spark, T.client_address(F.col("a"), F.col("b"), F.col("c")), a=" ", b=None, c="4") == "4"
    assert one(spark, T.keywords(F.col("q")), q="What is the Leave leave of A-12?") == ["leave", "leave"]
    assert one(spark, T.clean_content(F.col("t")), t="# Document: a\n> Source: b\n  ## page 3\nprose\n---") == "prose"
    assert one(spark, T.small_talk_reply(F.col("q")), q="Hello!!") == T.REPLIES["greeting"]


def test_predicates(spark):
    assert one(spark, P.is_conversational(F.col("q")), q=" Thank you! ") is True
    assert one(spark, P.is_conversational(F.col("q")), q="leave rules") is False
    assert one(spark, P.is_conversational(F.col("q")), q=None) is False
    assert one(spark, P.is_boilerplate(F.col("t")), t="# Document: a\n> Source: b\n> Total Pages: 3\n" + "x" * 400) is True
    assert one(spark, P.is_boilerplate(F.col("t")), t=None) is True
    code = "def f(): return len(x)"
    assert one(spark, P.is_code_dump(F.col("t"), F.lit("leave")), t=code) is True
    assert one(spark, P.is_code_dump(F.col("t"), F.lit("python code")), t=code) is False
    assert one(spark, P.is_code_dump(F.col("t"), F.lit("leave")), t="while only one mark") is False
    assert one(spark, P.is_resume(F.col("d"), F.col("t"), F.lit("leave")), d="my_resume", t="") is True
    assert one(spark, P.is_cover_page(F.col("t")), t="### INDEX of rules") is True


def test_embedding(spark):
    texts = [None, "", "é!", "one two two", "nothing else matters", "ünïcode ab12"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = frame.select(V.hash_embedding(F.col("t")).alias("a"), V.hash_embedding_builtin(F.col("t")).alias("b")).collect()
    for text, row in zip(texts, rows):
        assert len(row["a"]) == V.DIMS
        assert all(abs(x - y) < 1e-6 for x, y in zip(row["a"], row["b"])), text
    assert not any(rows[0]["a"]) and not any(rows[2]["a"])
    assert abs(sum(x * x for x in rows[3]["a"]) - 1) < 1e-6
    assert V.string_hash("polygenelubricants") == -(2**31)


def test_scores(spark):
    score = lambda v, l, m: spark.range(1).select(V.hybrid_score(F.lit(v), F.lit(l), F.lit(m)).alias("x")).first()["x"]  # noqa: E731, E741
    assert abs(score(0.8, 0.5, 0) - (0.35 * 0.8 + 0.65 * 0.5)) < 1e-12
    assert abs(score(0.8, 0.0, 0) - 0.6) < 1e-12
    assert abs(score(0.8, 0.5, 2) - (0.35 * 0.008 + 0.65 * 0.00125)) < 1e-12
    assert spark.range(1).select(V.distance_score(F.lit(3.0)).alias("x")).first()["x"] == 0.0
    frame = spark.createDataFrame([([1.0, 2.0], [3.0, 4.0]), ([1.0], [1.0, 2.0]), (None, [1.0])], "a array<float>, b array<float>")
    assert [r["x"] for r in frame.select(V.similarity(F.col("a"), F.col("b")).alias("x")).collect()] == [11.0, 0.0, 0.0]


@settings(max_examples=50, deadline=None)
@given(st.text(alphabet="ab \t\n", max_size=40))
def test_hash_ignores_case_and_space(text):
    normal = lambda t: " ".join(t.lower().split())
    assert normal(text) == normal(text.upper() + "\n")
