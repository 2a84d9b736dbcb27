import random
import re

from flowloom.llm import decontaminate as d
from tests.llm.conftest import DOCS, prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(text, items, size):
    w, hit, found = words(text), set(), set()
    for name, item in items:
        iw = words(item)
        for s in range(max(1, len(iw) - size + 1)) if iw else ():
            win = iw[s : s + size]
            for p in range(len(w) - len(win) + 1):
                if w[p : p + len(win)] == win:
                    hit.update(range(p, p + len(win)))
                    found.add("" if name is None else str(name))
    return len(w), len(hit), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(w)


def cases(spark):
    rng = random.Random(2)
    items = [(1, prose(rng, 40)), (2, prose(rng, 13)), (3, "Rare, short item"), (4, "stone"), (5, None), (6, " ,. "), (None, prose(rng, 20)), (10, "É日 one")]
    items += [(7, items[0][1]), (1, items[0][1])]
    texts = [None, "", "!!", items[0][1], "x " * 300 + items[0][1][:-5].upper(), prose(rng, 50) + " " + items[1][1] + ". " + prose(rng, 5)]
    texts += ["rare SHORT-item rare short item " + prose(rng, 500), "Éa é日 É日ONE É日 one", items[6][1] + items[6][1], prose(rng, 3000)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)] + [(3, texts[3], "en", "s", 0)], DOCS)
    bench = spark.createDataFrame(items, "item_id long, text string")
    return texts, items, docs, bench


def test_equal_to_brute_force(spark):
    texts, items, docs, bench = cases(spark)
    for size, block in ((13, 200_000), (13, 9), (5, 3)):
        got = d.find(docs.selectExpr("*", "1 as hits", "2 as items", "3 as n_words"), bench, size, block).collect()
        assert len(got) == len(texts) + 1
        for r in got:
            assert (r.n_words, r.n_hit, r.items, r.contaminated) == brute(texts[r.doc_id], items, size), r.doc_id
            assert r.n_items == len(r.items)


def test_dropping_keeps_clean_rows_whole(spark, odd_docs):
    texts, items, docs, bench = cases(spark)
    kept = d.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, t in [*enumerate(texts), (3, texts[3])] if not brute(t, items, 13)[3])
    odd = d.drop_contaminated(odd_docs, bench.limit(0))
    assert odd.columns == odd_docs.columns and odd.count() == odd_docs.count()


def test_empty_tables(spark, no_docs, odd_docs):
    _, _, docs, bench = cases(spark)
    assert d.find(no_docs, bench).count() == 0
    assert {r.contaminated for r in d.find(odd_docs, bench.limit(0)).collect()} == {False}
