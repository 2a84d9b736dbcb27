import math
import random
import tracemalloc
from collections import Counter, defaultdict

import pandas as pd
import pytest

from flowloom.llm import perplexity as p
from tests.llm.conftest import DOCS, prose


def train(texts, vocabulary):
    """Plain interpolated modified Kneser-Ney over characters; returns a function of (context, char)."""
    counts = {p.ORDER: Counter()}
    for text in texts:
        padded = p.PAD * (p.ORDER - 1) + text
        counts[p.ORDER].update(padded[i : i + p.ORDER] for i in range(len(text)))
    for n in range(p.ORDER - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    discount, total, held = {}, defaultdict(float), defaultdict(float)
    for n, table in counts.items():
        t = Counter(table.values())
        y = t[1] / (t[1] + 2 * t[2]) if t[1] else 0
        for i, plain in ((1, 0.5), (2, 1.0), (3, 1.5)):
            d = i - (i + 1) * y * t[i + 1] / t[i] if t[i] else plain
            discount[n, i] = d if t[1] and t[i] and t[i + 1] and 0 < d < i else plain
        for gram, c in table.items():
            total[gram[:-1]] += c
            held[gram[:-1]] += discount[n, min(c, 3)]

    def probability(gram):
        if not gram:
            return 1 / vocabulary
        lower = probability(gram[1:])
        context, n = gram[:-1], len(gram)
        if not total[context]:
            return lower
        c = counts[n][gram]
        return (max(c - discount[n, min(c, 3)], 0) if c else 0) / total[context] + held[context] / total[context] * lower

    return probability if texts else None


def brute(rows, trusted):
    """Nats per character of each (doc_id, text, lang)."""
    out = []
    models, alphabet = {}, defaultdict(set)
    for _, text, lang in rows:
        alphabet[lang or ""].update(text or "")
    for lang in alphabet:
        for fold in (0, 1):
            texts = [t for i, t, g in rows if i in trusted and (g or "") == lang and t and p.fold_of(t) == fold]
            models[lang, fold] = train(texts, len(alphabet[lang]))
    for _, text, lang in rows:
        model = models[lang or "", 1 - p.fold_of(text)] if text else None
        if not model:
            out.append(None)
            continue
        padded = p.PAD * (p.ORDER - 1) + text
        out.append(-sum(math.log(model(padded[i : i + p.ORDER])) for i in range(len(text))) / len(text))
    return out


def fixture(spark):
    rng = random.Random(12)
    rows = [(i, prose(rng, rng.randrange(1, 30)), rng.choice(["en", "fr", None])) for i in range(40)]
    rows += [(50, "ÄÖ %%% 123 " * 4, "en"), (51, None, "en"), (52, "", "fr"), (53, "no model", "xx"), (54, "x", "en"), (3, rows[3][1], rows[3][2]), (None, "the house", "en")]
    labels = [(i, 1 if i % 3 else 0, 0) for i in range(0, 36)] + [(4, 1, 1), (5, 0, 0), (7, None, 0), (None, 1, 0)]
    trusted = {i for i in range(36) if i % 3} - {4, 5}
    docs = spark.createDataFrame([(i, t, g, "s", 0) for i, t, g in rows], DOCS).selectExpr("*", "1 as c0", "'z' as gram")
    return rows, trusted, docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("way", ["broadcast", "join", "small chunks"])
def test_scores_equal_brute_force(spark, monkeypatch, way):
    rows, trusted, docs, labels = fixture(spark)
    if way == "small chunks":
        monkeypatch.setattr(p, "CHUNK", 16)
        monkeypatch.setattr(p, "HELD", 10)
    marked = p.flagged(docs, labels)
    scored = p.trained(marked, 0 if way == "join" else p.MAX_GRAMS)(marked).collect()
    got = {(r.doc_id, r.text): r[p.NATS] for r in scored}
    assert len(scored) == len(rows)
    for (i, text, _), want in zip(rows, brute(rows, trusted)):
        assert got[i, text] == (None if want is None else pytest.approx(want, abs=1e-5)), i


def test_limits_are_quantiles_of_trusted_documents(spark):
    rows, trusted, docs, labels = fixture(spark)
    marked = p.flagged(docs, labels)
    scored = p.trained(marked)(marked)
    scored = p.with_limits(scored, p.limits(scored)).collect()
    scored = [r for r in scored if r[p.TRUSTED] and r[p.NATS] is not None]
    for lang in ("en", "fr", ""):
        mine = [r for r in scored if (r.lang or "") == lang]
        n = [len(r.text) for r in mine]
        usual = sum(r[p.NATS] * k for r, k in zip(mine, n)) / sum(n)
        mixed = sorted(math.ceil((r[p.NATS] * k + usual * p.PRIOR) / (k + p.PRIOR) / p.STEP - 1e-9) for r, k in zip(mine, n))
        want = mixed[math.ceil(len(mixed) * p.QUANTILE - 1e-9) - 1] * p.STEP + p.MARGIN
        assert mine[0][p.LIMIT] == pytest.approx(want, abs=1.5 * p.STEP)


def test_junk_goes_and_good_documents_stay(spark):
    rng = random.Random(2)
    good = [(i, prose(rng, 40), "en", "s", 0) for i in range(120)]
    junk = [(1000 + i, prose(rng, 30).upper().replace(" ", "%%% "), "en", "s", 0) for i in range(10)]
    docs = spark.createDataFrame(good + junk, DOCS)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 120, 2)], "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in p.keep_good(docs, labels).collect()}
    assert len(kept & set(range(120))) >= 119 and not kept & set(range(1000, 1010))
    judged = {r.doc_id: r.kept for r in p.judge(docs, labels).collect()}
    assert {i for i, k in judged.items() if k} == kept


@pytest.mark.parametrize("max_grams", [p.MAX_GRAMS, 0])
def test_repeated_words_go_and_one_odd_trusted_text_sets_no_limit(spark, max_grams):
    rng = random.Random(14)
    good = [(i, prose(rng, 60), "en", "s", 0) for i in range(150)]
    odd = [(500, prose(rng, 60).upper().replace(" ", "%% "), "en", "s", 0)]
    repeated = [(1000 + i, " ".join([prose(rng, 1)] * 40 + [prose(rng, 1)] * 40), "en", "s", 0) for i in range(10)]
    junk = [(2000 + i, prose(rng, 60).upper().replace(" ", "%% "), "en", "s", 0) for i in range(10)]
    docs = spark.createDataFrame(good + odd + repeated + junk, DOCS)
    labels = spark.createDataFrame([(i, 1, 0) for i in [*range(120), 500]], "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in p.judge(docs, labels, max_grams).where("kept").collect()}
    assert len(kept & set(range(150))) >= 145 and not kept & set(range(500, 3000))


def test_odd_rows(spark, odd_docs, no_docs, labels):
    kept = p.keep_good(odd_docs, labels)
    assert kept.columns == odd_docs.columns
    texts = [r.text for r in kept.collect()]
    assert None not in texts and "" not in texts
    assert p.judge(no_docs, labels).count() == 0
    assert p.judge(odd_docs, labels.limit(0)).where("kept").count() == odd_docs.where("length(text) > 0").count()


def test_counting_holds_back_few_bytes():
    """As Python strings, tuples and lists the n-grams of the long text took some hundred megabytes."""
    rng = random.Random(5)
    letters = [chr(0x4E00 + i) for i in range(5000)]
    texts = ["".join(rng.choices(letters, k=900_000)), "ab " * 500, "a\0b\0\0", "\U0001f600 \u00e9t\u00e9"]
    rows = pd.DataFrame({"text": [*texts, *texts[1:], None, ""], "lang": "en", p.TRUSTED: True})
    rows.loc[len(texts) :, "lang"] = "fr"
    tracemalloc.start()
    try:
        counted = p._count(iter([rows]))
        first = next(counted)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 150 << 20
    found = pd.concat([first, *counted]).groupby(["lang", "gram"]).sum()
    for lang, own in (("en", texts), ("fr", texts[1:])):
        expected = [Counter(), Counter()]
        for text in own:
            padded = p.PAD * (p.ORDER - 1) + text
            expected[p.fold_of(text)].update(padded[i : i + p.ORDER] for i in range(len(text)))
        for fold in (0, 1):
            counts = found.loc[lang][f"c{fold}"]
            assert counts[counts > 0].to_dict() == expected[fold]


def test_each_step_scores_once(spark, odd_docs, labels, monkeypatch):
    """A second evaluation takes a second set of Python workers, which stay beside all later stages."""
    plans, store = {}, p.stored

    def watched(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython")
        return store(df, name)

    monkeypatch.setattr(p, "stored", watched)
    kept = p.keep_good(odd_docs, labels)
    assert plans["trusted"] == 1
    assert kept._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
