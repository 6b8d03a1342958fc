"""Benchmark decontamination (operator 11) against brute force."""

import hashlib
import re

import pytest

from tidewell.llm import decontamination as leaks

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def brute(documents, items, size=10):
    windows = {}
    for item, text in items:
        words = WORD.findall(lowered(text))
        for a in range(max(1, len(words) - size + 1) if words else 0):
            windows.setdefault(tuple(words[a : a + size]), set()).add(item)
    out = []
    for doc, text in documents:
        words = WORD.findall(lowered(text))
        hit, found = set(), set()
        for n in {len(w) for w in windows}:
            for a in range(len(words) - n + 1):
                if tuple(words[a : a + n]) in windows:
                    hit |= set(range(a, a + n))
                    found |= windows[tuple(words[a : a + n])]
        names = sorted(str(i) for i in found if i is not None)
        digest = hashlib.sha256(",".join(names).encode()).hexdigest()
        out.append((doc, len(words), len(hit), len(names), digest, bool(hit)))
    return sorted(out, key=str)


LEAK = "The quick brown fox, jumps over; the lazy dog again and again until Zürich 42"
ITEMS = [
    (1, LEAK),
    (2, "the QUICK brown fox jumps over the lazy dog again"),
    (10, "Short question: who?"),
    (10, "another text of the same item with more than ten words in all"),
    (None, "an item without an id is found too but never named anywhere"),
    (11, None),
    (12, ""),
    (13, "  ...!?"),
    (14, "x"),
    (15, "short\nquestion WHO"),
]
DOCUMENTS = [
    (1, f"Before it. {LEAK.upper().replace('ZÜRICH', 'Zürich')} After."),
    (2, "the quick brown fox jumps over the lazy dog"),
    (3, "the quick-brown fox jumps_over the lazy dog AGAIN " * 3),
    (4, "short question who x"),
    (5, None),
    (6, ""),
    (7, " \n"),
    (8, "an item without an id is found too but never named anywhere"),
    (9, "nothing of it in here"),
    (9, "nothing of it in here"),
    (None, "X marks a row without an id"),
    (20, ("filler words go here " * 30_000) + LEAK + " end" * 5),
    (21, "zürich the quick brown fox 😀 " + LEAK),
]


@pytest.fixture
def items(spark):
    def build(rows):
        return spark.createDataFrame([(i, t, "h", 0) for i, t in rows], "item_id long, text string, h string, row int")

    return build


@pytest.mark.parametrize("most", [leaks.BROADCAST_BYTES, 0])
def test_equal_to_brute_force(spark, documents, items, most):
    found = leaks.annotate(documents(DOCUMENTS), items(ITEMS), keep=["doc_id"], broadcast_bytes=most)
    rows = sorted((tuple(r) for r in leaks.digests(found).collect()), key=str)
    assert rows == brute(DOCUMENTS, ITEMS)


@pytest.mark.parametrize("most", [leaks.BROADCAST_BYTES, 0])
def test_spans_and_removal(spark, documents, items, most):
    docs = documents(DOCUMENTS)
    found = {r["doc_id"]: r for r in leaks.annotate(docs, items(ITEMS), broadcast_bytes=most).collect()}
    text = dict(DOCUMENTS)[21]
    assert [text[s["start"] : s["end"]] for s in found[21]["spans"]] == [LEAK]
    assert found[21]["items"] == ["1", "2"]
    cut = leaks.without_spans(docs, items(ITEMS), broadcast_bytes=most)
    assert cut.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert texts[1] == "Before it.  After."
    assert texts[21] == "zürich the quick brown fox 😀 "
    assert texts[9] == "nothing of it in here" and texts[5] is None and texts[6] == ""
    kept = leaks.without_documents(docs, items(ITEMS), broadcast_bytes=most)
    assert kept.columns == docs.columns
    ids = sorted((r["doc_id"] for r in kept.collect()), key=str)
    assert ids == sorted([2, 5, 6, 7, 9, 9], key=str)
    half = leaks.without_documents(docs, items(ITEMS), share=0.5, broadcast_bytes=most).collect()
    assert 20 in [r["doc_id"] for r in half]


def test_a_clash_of_hashes_is_no_hit(monkeypatch):
    monkeypatch.setattr(leaks.common, "mix", lambda h: h & leaks._U(3))
    index = leaks.build_index(["1", "2"], ["a b c d e f g h i j k l", "q r s t u v w x y z"])
    words = leaks.Words(leaks.pa.array(["a b c d e f g h i j z y x", "r s t u v w x y z q", "q r s t u v w x y z"]))
    at, window = leaks._lookup(words, index)
    named = [index.names[index.item[index.first_item[w]]].as_py() for w in window]
    assert sorted(zip(at.tolist(), named, strict=True)) == [(0, "1"), (23, "2")]


@pytest.mark.parametrize("most", [leaks.BROADCAST_BYTES, -1])
def test_empty_tables_and_clashing_names(spark, documents, items, most):
    docs = documents(DOCUMENTS[:4])
    assert leaks.annotate(documents([]), items(ITEMS), broadcast_bytes=most).count() == 0
    for none in (items([]), items([(1, None), (2, "?!")])):
        assert [r["contaminated"] for r in leaks.digests(leaks.annotate(docs, none, broadcast_bytes=most)).collect()] == [False] * 4
    clashing = docs.withColumnRenamed("class", "n_hit").withColumnRenamed("ids", "Kept").withColumnRenamed("n", "found")
    found = leaks.annotate(clashing, items(ITEMS), broadcast_bytes=most)
    assert found.columns[-4:] == ["n_words", "n_hit_", "items", "spans"]
    assert {r["n_hit"] for r in found.collect()} == {"class"}


def test_one_pass_without_shuffle(spark, documents, items, plan):
    assert "Exchange" not in plan(leaks.annotate(documents(DOCUMENTS), items(ITEMS)))
