import math
import os
import random

import pytest

import corpus_pipeline
from flowloom.llm import perplexity, pii
from tests.llm.conftest import DOCS, prose
from tests.llm.test_decontaminate import brute as brute_hits
from tests.llm.test_jaccard import brute as brute_groups
from tests.llm.test_jaccard import edited
from tests.llm.test_perplexity import brute as brute_nats

pytestmark = pytest.mark.skipif(not os.path.exists(corpus_pipeline.PIECES), reason="no vocabulary file")


def tables(spark, folder):
    rng = random.Random(21)
    item = prose(rng, 30)
    texts = [prose(rng, rng.randrange(20, 80)) for _ in range(40)]
    texts += [edited(rng, texts[0], 1), texts[1], texts[2].upper(), item + " tail", prose(rng, 400) + " card 4111111111111111 and 8.8.8.8"]
    texts += ["%%% " + t.upper().replace(" ", "## ") for t in texts[5:9]] + [None, "", "short"]
    rows = [(i, t, "en", "src0", len(t or "")) for i, t in enumerate(texts)]
    rows.append(rows[4])
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, 0) for i in range(30)] + [(41, 0, 0), (45, 0, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, set(range(30)), [(1, item)]


def brute(rows, trusted, items):
    """What is left: (doc_id, text, lang, source, n_chars) before the last stage."""
    nats = brute_nats([r[:3] for r in rows], trusted)
    judged = [(r, x) for r, x in zip(rows, nats)]
    good = [(r, x) for r, x in judged if r[0] in trusted and x is not None]
    usual = sum(x * len(r[1]) for r, x in good) / sum(len(r[1]) for r, _ in good)
    mixed = lambda r, x: (x * len(r[1]) + usual * perplexity.PRIOR) / (len(r[1]) + perplexity.PRIOR)
    steps = sorted(math.ceil(mixed(r, x) / perplexity.STEP) for r, x in good)
    limit = steps[math.ceil(len(steps) * perplexity.QUANTILE) - 1] * perplexity.STEP + perplexity.MARGIN
    left = [r for r, x in judged if r[1] and (x is None or mixed(r, x) <= limit)]
    groups = brute_groups([r[:2] for r in left])
    left = sorted({r for r, (i, n, c) in zip(left, groups) if i == c or not n})
    left = [r for r in left if not brute_hits(r[1], items, 13)[3]]
    return [(r[0], pii.Pseudonyms().replace(r[1]), *r[2:]) for r in left]


def test_run_equals_brute_force(spark, tmp_path):
    sentencepiece = pytest.importorskip("sentencepiece")
    rows, trusted, items = tables(spark, str(tmp_path))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "ids"]
    got = sorted(tuple(r) for r in out.collect())
    want = brute(rows, trusted, items)
    assert [r[:5] for r in got] == want
    library = sentencepiece.SentencePieceProcessor(model_file=corpus_pipeline.PIECES)
    assert [r[5] for r in got] == library.encode([r[1] for r in want])
    kept = {r[0] for r in want}
    assert not kept & {41, 43, 49, 50} and 44 in kept
    assert "4111111111111111" not in str(want) and "8.8.8.8" not in str(want)


def test_stages_keep_columns_and_stand_odd_rows(spark, odd_docs, no_docs, tmp_path):
    _, _, _ = tables(spark, str(tmp_path))
    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name
        last = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
        assert set(last.columns) == {*docs.columns, "ids"} and last.count() == docs.count()


def similar(a, b):
    """Whether the sets of five words of two texts have four fifths in common."""
    a, b = ({tuple(t.lower().split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in (a, b))
    return 5 * len(a & b) >= 4 * len(a | b)


def test_copies_with_a_passage_more_or_less_go(spark, tmp_path):
    rng = random.Random(8)
    texts = [prose(rng, n) for n in (60, 100, 200)]
    copies = [(t + " " + prose(rng, len(t.split()) // 7), t.rsplit(" ", len(t.split()) // 6)[0], t + " " + prose(rng, len(t.split()) // 3)) for t in texts]
    rows = list(enumerate([*texts, *(t for c in copies for t in c)]))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCS)
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()}
    assert kept == {i for i, t in rows if not any(similar(t, u) for _, u in rows[:i])}
    assert kept == {0, 1, 2, 5, 8, 11}


def test_queries_are_registered():
    import __spark_entry__

    names = list(__spark_entry__.queries())
    assert "pipeline" in names
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "n-gram Jaccard join", "benchmark decontamination", "personal data", "sentence pieces"
    ]
