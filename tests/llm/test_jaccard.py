import random

import numpy as np
import pytest

from flowloom.llm import jaccard
from flowloom.llm.components import components
from tests.llm.conftest import DOCS, prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = (text or "").translate(LOWER).split()
    if len(words) < 3:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(zip(words, words[1:], words[2:]))


def brute(rows):
    """n_shingles and component_id of each (doc_id, text)."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            shared = len(a & sets[j])
            if a and sets[j] and 100 * shared >= 90 * (len(a) + len(sets[j]) - shared):
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return [(doc_id, len(s), least.get(find(i))) for i, ((doc_id, _), s) in enumerate(zip(rows, sets))]


def edited(rng, text, edits):
    words = text.split()
    for _ in range(edits):
        at = rng.randrange(len(words))
        words[at : at + 1] = rng.choice([["other"], [], [words[at], "more"]])
    return " ".join(words)


def corpus(seed):
    rng = random.Random(seed)
    rows = []
    for size in (1, 2, 3, 5, 12, 22, 25, 40, 60, 200):
        for _ in range(2):
            text = prose(rng, size)
            rows += [edited(rng, text, rng.choice([0, 0, 1, 1, 2, 3])) if size > 3 else text for _ in range(7)]
    base = prose(rng, 150)
    rows += [edited(rng, base, rng.choice([1, 2, 3, 4])) for _ in range(60)]  # a list longer than a chunk
    passage = prose(rng, 30)
    rows += [prose(rng, 40) + " " + passage for _ in range(30)]
    rows += [None, "", " \n", rows[5], rows[5].upper(), rows[-70], "é " * 30, "É " * 30]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("chunk, centers, large", [(64, 16, 60), (8, 2, 60), (8, 1, 0)])
def test_equal_to_brute_force(spark, monkeypatch, chunk, centers, large):
    monkeypatch.setattr(jaccard, "CHUNK", chunk)
    monkeypatch.setattr(jaccard, "CENTERS", centers)
    monkeypatch.setattr(jaccard, "MAX_SMALL", large)
    rows = corpus(chunk + centers)
    rows += [rows[3], (5000, rows[9][1]), (None, rows[10][1]), (None, "words of no one else at all")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.groups(docs.selectExpr("*", "1 as class", "2 as size")).collect()]
    want = brute(rows)
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_without_broadcasts_of_asked_classes(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", 0)
    rows = corpus(77)
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.groups(docs).collect())
    assert got == sorted(brute(rows))


def test_light_and_heavy_agree(spark):
    rng = random.Random(5)
    texts = [prose(rng, 24) for _ in range(6)]
    rows = [(i, edited(rng, texts[i % 6], rng.choice([0, 1, 1]))) for i in range(60)]
    sets = {i: np.unique(np.array([hash(x) & (2**63 - 1) for x in shingles(t)], np.uint64)) for i, t in rows}
    frame = [(bytes([i]) * 16, len(s), s.view(np.int64).tolist()) for i, s in sets.items()]
    frame = spark.createDataFrame(frame, "class binary, size int, elements array<long>")
    for small in (18, 21, 24):
        links = {(r.a[0], r.b[0]) for r in jaccard.light_links(frame, small, 90).collect()}
        similar = lambda a, b: 100 * len(np.intersect1d(a, b)) >= 90 * len(np.union1d(a, b))
        assert all(similar(sets[a], sets[b]) for a, b in links)
        linked = components(jaccard.light_links(frame, small, 90))
        root = {r.node[0]: r.root[0] for r in linked.collect()}
        for i in sets:
            for j in sets:
                if i < j and similar(sets[i], sets[j]) and min(len(sets[i]), len(sets[j])) <= small:
                    equal = len(sets[i]) == len(sets[j]) and (sets[i] == sets[j]).all()
                    assert equal or root[i] == root[j]


def test_bitmaps_never_say_too_much():
    rng = np.random.default_rng(1)
    for size in (3, 200, 1500, 5000):
        a = np.unique(rng.integers(0, 2**63, size, np.uint64))
        b = np.unique(np.concatenate([a[: size // 2], rng.integers(0, 2**63, size // 3, np.uint64)]))
        assert jaccard.differing(jaccard.bitmap(a), jaccard.bitmap(b)) <= len(np.setxor1d(a, b))


def test_components_of_chains_and_stars(spark):
    names = random.Random(3).sample(range(10**6), 400)
    links = list(zip(names[:200], names[1:200])) + [(names[200], x) for x in names[201:300]] + [(names[300], names[300])]
    found = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert len({found[x] for x in names[:200]}) == 1 and len({found[x] for x in names[200:300]}) == 1
    assert len(found) == 300 and found[names[0]] != found[names[200]]
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_of_each_group_stays(spark, odd_docs, no_docs):
    rows = corpus(3)
    rows += [rows[3], rows[3], (5000, rows[9][1]), (None, rows[10][1])]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    want = sorted({(i, t) for (i, t), (_, n, c) in zip(rows, brute(rows)) if i == c or not n}, key=str)
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == want
    odd = jaccard.keep_one(odd_docs)
    assert odd.columns == odd_docs.columns and odd.count() == jaccard.groups(odd_docs).select("component_id", "doc_id").distinct().count() - 2
    assert jaccard.keep_one(no_docs).count() == 0 and jaccard.groups(no_docs).count() == 0


def test_unlinked_texts_without_an_id_or_with_the_same_one_stay(spark):
    rng = random.Random(31)
    a, b, c, d, e = (prose(rng, 40) for _ in range(5))
    rows = [(None, a), (None, a.upper()), (None, b), (None, b), (None, c), (1, d), (1, e), (1, e), (2, d), (2, "of its own"), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    kept = [(r.doc_id, (r.text or "").lower()) for r in jaccard.keep_one(docs).collect()]
    want = [(None, a), (None, b), (None, c), (1, d), (1, e), (2, "of its own"), (None, "")]
    assert sorted(kept, key=str) == sorted(want, key=str)
