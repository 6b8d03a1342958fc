"""Jaccard groups (operator 8) against comparing every pair."""

import random
import re

import numpy as np
import pytest

from tidewell.llm import graphs, jaccard


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    group = {i: i for i in sets}

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                group[max(a, b)] = min(a, b)
    return sorted((i, len(sets[i]), find(i)) for i in ids)


def family(rng, base, copies, changes):
    out = []
    for _ in range(copies):
        words = list(base)
        for _ in range(rng.randint(0, changes)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def corpus(seed):
    rng = random.Random(seed)
    texts = []
    license_line = [f"license{i}" for i in range(30)]
    for size in (6, 12, 40, 120, 400):
        base = [f"b{size}_{rng.randrange(300)}" for _ in range(size)]
        texts += family(rng, base, 25, max(1, size // 12))
        texts += family(rng, license_line + base, 12, 2)
    # One large group of near copies, at the edge of the threshold.
    base = [f"n{i}" for i in range(90)]
    texts += family(rng, base, 90, 7)
    texts += [" ".join(license_line), " ".join(license_line[:28]), "a b c d e", "A B C D E", "a b", "a b", "a", "", " \t", None]
    rng.shuffle(texts)
    return [(i * 3 + 1, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize(("seed", "leaf", "often"), [(1, 32, 8), (2, 4, 3), (3, 2, 2)])
def test_groups_equal_brute_force(documents, monkeypatch, seed, leaf, often):
    monkeypatch.setattr(jaccard, "LEAF", leaf)
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    monkeypatch.setattr(jaccard, "OFTEN", often)
    monkeypatch.setattr(jaccard, "SAMPLE", leaf // 2)
    rows = corpus(seed)
    assert sorted(tuple(r) for r in jaccard.link_components(documents(rows)).collect()) == brute(rows)


def letters(n, common, own, seed=1):
    """Letters of one form: the same words first, others after them; no two are linked."""
    rng = random.Random(seed)
    form = [f"form{i}" for i in range(common)]
    return [(i, " ".join(form + [f"w{rng.randrange(10**7)}" for _ in range(own)])) for i in range(n)]


@pytest.mark.parametrize(("common", "own"), [(19, 5), (40, 12), (20, 4)])
def test_letters_of_one_form_meet_in_no_region(documents, tmp_path, common, own):
    """Common shingles come last: no letter is near in their regions, however many letters there are."""
    for n in (300, 600):
        texts = documents(letters(n, common, own)).select("doc_id", "text")
        frequent = jaccard._frequent(texts, f"{tmp_path}/{n}-{common}")
        order = np.argsort(frequent)
        known = texts.sparkSession.sparkContext.broadcast((frequent[order], order))
        assert jaccard._regions(jaccard._entries(texts, known), f"{tmp_path}/{n}").count() == 0


def test_letters_of_several_lengths(documents, monkeypatch):
    """Letters of one form and parts of it, some of them linked, against brute force, with small blocks."""
    monkeypatch.setattr(jaccard, "LEAF", 4)
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    rows, rng = [], random.Random(3)
    form = [f"form{i}" for i in range(44)]
    for i in range(260):
        cut = form[: rng.choice([20, 28, 36, 44])]
        rows.append((i, " ".join(cut + [f"w{rng.randrange(10**7)}" for _ in range(rng.choice([0, 3, 6, 9, 12, 15]))])))
    assert sorted(tuple(r) for r in jaccard.link_components(documents(rows)).collect()) == brute(rows)


def test_linked_sets_meet_where_the_smaller_is_near():
    rng = np.random.default_rng(5)
    for _ in range(2000):
        n = int(rng.integers(1, 80))
        base = rng.permutation(400)[: n + 40]
        a, b = set(base[:n].tolist()), set(base[int(rng.integers(0, n // 3 + 1)) : n + int(rng.integers(0, n // 3 + 1))].tolist())
        if b and 100 * len(a & b) >= 75 * len(a | b):
            small, large = sorted((sorted(a), sorted(b)), key=len)
            assert set(small[: jaccard.near_ones(len(small))]) & set(large[: jaccard.first_ones(len(large))])


def test_awkward_rows(awkward):
    found = sorted((tuple(r) for r in jaccard.link_components(awkward).collect()), key=str)
    by_id = {r[0]: r for r in found}
    assert len(found) == awkward.count()
    assert by_id[1] == (1, 0, 1) and by_id[2] == (2, 0, 2) and by_id[3] == (3, 0, 3)
    assert by_id[5][2] == 4 and by_id[6] == (6, 1, 6) and by_id[None] == (None, 3, None)
    assert by_id[8][1] == 2


def test_one_of_each(awkward):
    kept = jaccard.one_of_each(awkward)
    assert kept.columns == awkward.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 5 not in ids and ids.count(6) == 2 and None in ids and kept.count() == awkward.count() - 1


def test_empty_table(documents):
    assert jaccard.link_components(documents([])).count() == 0


def test_sketch_bounds_the_difference():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a = rng.integers(0, 2**60, rng.integers(1, 300)).astype(np.uint64)
        kept = a[rng.random(len(a)) < 0.9]
        b = np.concatenate((kept, rng.integers(0, 2**60, rng.integers(0, 200)).astype(np.uint64)))
        a, b = np.unique(a), np.unique(b)
        if not len(b):
            continue
        one, two = jaccard.sketch(a), jaccard.sketch(b)
        size = min(len(one), len(two))
        distance = np.bitwise_count(jaccard.folded(one, size) ^ jaccard.folded(two, size)).sum()
        assert distance <= len(np.setxor1d(a, b))
        if jaccard.linked(a, b):
            assert jaccard.close(len(a), one, len(b), two)


def test_components(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(50, 90)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(150)]
    group = {x: x for e in links for x in e}

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        group[max(a, b)] = min(a, b)
    found = graphs.components(spark.createDataFrame(links, "a long, b long")).collect()
    expected = {x: find(x) for a, b in links if a != b for x in (a, b)}
    assert {r.node: r.component for r in found} == expected
    assert graphs.components(spark.createDataFrame([], "a long, b long")).count() == 0
