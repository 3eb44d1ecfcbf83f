from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st

from scriptorium.operators import chunking as C
from scriptorium.operators import structure as S


def test_fold_pages_headings_and_overlap():
    text = "# Document: d\n\n## Page 1\n### Leave\nshort\n## page 2 rest is dropped\n" + "word " * 260 + "\nnext\n"
    chunks = list(C.fold(text))
    assert [(c.page, c.heading) for c in chunks] == [(1, "General"), (1, "Leave"), (2, "Leave"), (2, "Leave")]
    assert chunks[1].content == "### Leave\nshort"
    assert chunks[2].size == 1301
    assert chunks[3].content.endswith("word next") and len(chunks[3].content) <= 150 + 5


def test_fold_edges():
    assert list(C.fold(None)) == list(C.fold("")) == list(C.fold("\n \n")) == []
    assert list(C.fold("a\n## Page 99999999999\nb")) == []
    assert len(list(C.fold("x" * 1199))) == 1  # 1200 with the line end: full, and no tail without white space
    assert [c.size for c in C.fold("x" * 1198)] == [1199]
    assert [c.content for c in C.fold("a\r\nb\rc")] == ["a\nb\nc"]
    assert len(list(C.fold("y" * 100_000))) == 1
    blank_carried = list(C.fold(" \n## Page 2\nz"))
    assert blank_carried[0].page == 2 and blank_carried[0].size == 4


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["## Page 2", "### Head", "some words here", "", "x" * 700, "tail end of it."]), max_size=30))
def test_fold_keeps_every_line(lines):
    chunks = list(C.fold("\n".join(lines)))
    joined = "\n".join(c.content for c in chunks)
    for line in lines:
        if line.strip() and not line.startswith("## Page"):
            assert line in joined
    assert all(c.content and c.size >= len(c.content) for c in chunks)


def test_page_markdown():
    page = "ORDER OF LEAVE\n1.1 Scope of rules\n1. First\n• point\nitem    qty    price\nbolt    3    |x\n\nplain text."
    out = S.page_markdown(page).split("\n")
    assert out[:4] == ["### ORDER OF LEAVE", "### 1.1 Scope of rules", "1. First", "- point"]
    assert out[4:7] == ["| item | qty | price |", "|---|---|---|", "| bolt | 3 | \\|x |"]
    assert S.page_markdown(None) == S.page_markdown("  \n") == "*(blank page)*\n"
    assert S.page_markdown("a    b    c\nlonger    row").startswith("| a | b | c |\n|---|---|---|\n| longer | row |  |")


def test_documents(spark):
    pages = spark.createDataFrame([("d", 2, "second page"), ("d", 1, "FIRST PAGE"), ("e", None, None), (None, 1, "x")], "document_name string, page_number int, page_text string")
    staged = S.stage_documents(pages)
    texts = {r["document_name"]: r["text"] for r in staged.collect()}
    assert texts["d"].index("## Page 1") < texts["d"].index("### FIRST PAGE") < texts["d"].index("## Page 2")
    assert "> Total Pages: 2" in texts["d"] and "*(blank page)*" in texts["e"]
    chunks = C.chunk_documents(staged).collect()
    assert {c["chunk_id"] for c in chunks if c["document_name"] == "d"} == {"d_chunk_0", "d_chunk_1", "d_chunk_2"}
    assert C.chunk_documents(staged.limit(0)).count() == 0
    lines = S.classify_lines(pages, "document_name", "page_text")
    assert {r["kind"] for r in lines.where("document_name = 'd'").collect()} == {"heading", "paragraph"}
    assert S.tables(lines, "document_name").count() == 0
    carried = S.carry_page_and_heading(staged.where("document_name = 'd'"), "document_name", "text").collect()
    assert carried[0]["page"] == 1 and carried[0]["heading"] == "General" and carried[-1]["page"] == 2 and carried[-1]["heading"] == "FIRST PAGE"
