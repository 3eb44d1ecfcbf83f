from __future__ import annotations

import random

import pytest

from scriptorium.llm import mojibake as M

CLEAN = [
    "The façade of the depot at {0} was reviewed by the naïve-risk panel — see “Annex {0}”.",
    "Señora Beltrão’s résumé — received on {0} — was filed under § {0}.",
    "Der Prüfer muss die Gerätekarte für jede der {0} Baustellen außerhalb der Öffnungszeiten prüfen.",
    "La commission d’évaluation devra céder le relevé après réception de {0} pièces.",
]


@pytest.mark.parametrize("read", [r for t, r in M.TRANSFORMATIONS if t == "utf-8" and r not in ("cp1251", "koi8-r", "cp866")])
def test_utf8_words_return(read):
    for word in ("façade", "naïve-risk", "Beltrão’s", "résumé", "Öffnungszeiten", "d’évaluation", "भुगतान"):
        garbled = M.garble(word, "utf-8", read)
        assert M.restore_utf8(garbled, read) == word
        if read in ("cp1252", "latin-1"):  # Greek and Cyrillic halfway forms of other encodings aren't followed
            twice = M.garble(garbled, "utf-8", read)
            assert M.restore_utf8(twice, read) == word


def test_ordinary_words_are_left():
    for word in ("CHÂTEAU", "REGIÃO", "AÇÃO", "├──", "d’évaluation", "«État»", "mémoire", "©️", "Nº"):
        assert not any(M.restore_utf8(word, read) for true, read in M.TRANSFORMATIONS if true == "utf-8"), word


def test_documents(spark):
    texts = {}
    for i in range(120):
        texts[i] = " ".join(s.format(i) for s in CLEAN)
    spoilt = {
        200: M.garble(CLEAN[0].format(7), "utf-8", "cp1252"), 201: M.garble(M.garble(CLEAN[1].format(8), "utf-8", "cp1252"), "utf-8", "cp1252"),
        202: M.garble(CLEAN[2].format(9), "utf-8", "mac_roman"), 203: M.garble(CLEAN[2].format(9), "cp1252", "cp850"), 204: CLEAN[3].format(5) + " " + M.garble(CLEAN[1].format(6), "utf-8", "cp437"),
        205: CLEAN[3].format(3).replace("é", M.LOST),
    }
    fine = {300: "The symbol Θ marks the angle, Ú and È the two outer terminals.", 301: "Â is the reactance; Ã its estimate.", 302: None, 303: "", 304: "plain", 305: "SÃO BELMIRO – REGIÃO 5: AÇÃO"}
    rows = [(k, v, 1) for k, v in (texts | spoilt | fine).items()]
    frame = spark.createDataFrame(rows, "doc_id long, text string, word int")
    found = {r["doc_id"] for r in M.garbled_words(frame).select("doc_id").distinct().collect()}
    assert found == set(spoilt)
    restored = {r["doc_id"]: r["text"] for r in M.restore(frame).collect()}
    assert restored[200] == CLEAN[0].format(7) and restored[201] == CLEAN[1].format(8) and restored[202] == restored[203] == CLEAN[2].format(9)
    assert restored[204] == CLEAN[3].format(5) + " " + CLEAN[1].format(6)
    assert restored[205] == CLEAN[3].format(3)
    assert M.restore(frame.limit(0)).count() == 0


def test_copies_of_a_garbled_document(spark):
    german = CLEAN[2]
    hot = M.garble(german.format(9), "cp1252", "cp850")
    alone = M.garble("Das Übergabeprotokoll für Zürich liegt bei.", "utf-8", "cp850")
    rows = [(i, german.format(i)) for i in range(40)] + [(100 + i, hot) for i in range(90)] + [(300, alone), (301, "Наша река и гордая правда, так и есть."), (302, "Πάντα ῥεῖ — так «правда».")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"] for r in M.garbled_words(frame).select("doc_id").distinct().collect()}
    assert found == {*range(100, 190), 300}
    restored = {r["doc_id"]: r["text"] for r in M.restore(frame).collect()}
    assert restored[100] == german.format(9) and restored[300] == "Das Übergabeprotokoll für Zürich liegt bei."


@pytest.mark.parametrize("text", ["Привет мир", "日本語の文", "καλημέρα σας", "שלום עולם", "مرحبا بكم", "한국어 글자", "সাধারণ কথা"])
@pytest.mark.parametrize("read", ["latin-1", "cp1252", "mac_roman", "cp437"])
def test_all_scripts(text, read):
    for word in text.split():
        garbled = M.garble(word, "utf-8", read)
        assert M.restore_utf8(garbled, read) == word
        assert M.restore_utf8(word, read) is None
        if len(word) > 2:
            assert M._unlearned(garbled, [read]) == (True, word)


def test_ordinary_words_of_other_scripts_stay():
    reads = [read for true, read in M.TRANSFORMATIONS if true == "utf-8"]
    for word in ("Привет", "отчёт", "«Север»", "№5", "ГОСТ", "καλημέρα", "日本語", "données—", "„Größe“", "naïve…", "Œuvre", "Ωμέγα", "États", "àÀâÂ", "ÎÏ“"):
        assert not any(M._unlearned(word, [read])[0] for read in reads), word


def test_maps_outside_the_list_are_learned(spark):
    odd = str.maketrans({"é": "¤", "ü": "¦", "ñ": "¬", "à": "Þ"})
    words = ["société", "général", "régime", "années", "über", "für", "münchen", "señor", "mañana", "español", "déjà", "voilà", "holà", "début", "müssen", "prünen", "niñera", "année", "écran"]
    rng = random.Random(3)
    clean = [" ".join(f"the {w} number stood in list" for w in rng.sample(words, 12)) + f" {i}." for i in range(40)]
    rows = [(i, t) for i, t in enumerate(clean)]
    rows += [(100 + i, clean[i].translate(odd)) for i in range(6)]  # near-twins of clean records
    rows += [(200, "Another " + " and another ".join(words).translate(odd)), (201, "one note more on société and mañana"), (300, None), (301, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    restored = {r["doc_id"]: r["text"] for r in M.restore(frame).collect()}
    assert set(restored) == {*range(100, 106), 200}
    assert restored[200] == "Another " + " and another ".join(words) and all(restored[100 + i] == clean[i] for i in range(6))
