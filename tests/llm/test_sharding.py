import zlib

from flowloom.llm import sharding
from tests.llm.conftest import DOCS


def rows_of(spark, docs, shards, **more):
    return [r.asDict() for r in sharding.shard(docs, shards, **more).collect()]


def brute(texts, shards):
    sizes = {}
    for t in texts:
        sizes[t or ""] = sizes.get(t or "", 0) + len((t or "").encode()) + 16
    loads = [0] * shards
    for size in sorted(sizes.values(), reverse=True):
        loads[loads.index(min(loads))] += size
    return sorted(loads)


def check(rows, docs):
    want = {}
    for d in docs.select("doc_id", "text").collect():
        raw = (d.text or "").encode()
        want.setdefault((d.doc_id, len(raw) + 16, zlib.crc32(raw)), []).append(1)
    got = {}
    for r in rows:
        got.setdefault((r["doc_id"], r["size"], r["text_crc32"]), []).append(1)
    assert got == want
    for shard in {r["shard"] for r in rows}:
        slots = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    homes = {}
    for r in rows:
        homes.setdefault(r["text_crc32"], set()).add(r["shard"])
    assert all(len(x) == 1 for x in homes.values())


def loads_of(rows, shards):
    loads = [0] * shards
    for r in rows:
        loads[r["shard"]] += r["size"]
    return sorted(loads)


def test_loads_are_those_of_the_schedule(spark):
    docs = spark.createDataFrame([(i, "ab" * (i % 37), "en", "s", 0) for i in range(300)], DOCS)
    rows = rows_of(spark, docs, 7)
    check(rows, docs)
    assert loads_of(rows, 7) == brute([r.text for r in docs.collect()], 7)


def test_bundles_of_small_groups_are_near_equal(spark):
    docs = spark.createDataFrame([(i, f"text {i}" * (1 + i % 5), "en", "s", 0) for i in range(3000)], DOCS)
    rows = rows_of(spark, docs, 4, units=20)
    check(rows, docs)
    loads = loads_of(rows, 4)
    assert loads[-1] - loads[0] < 0.05 * sum(loads)


def test_odd_rows_and_hot_group(spark, odd_docs):
    rows = rows_of(spark, odd_docs, 3)
    check(rows, odd_docs)
    assert {r["text_crc32"] for r in rows if r["doc_id"] == 0} == {0}


def test_empty_table(spark, no_docs):
    assert rows_of(spark, no_docs, 3) == []
