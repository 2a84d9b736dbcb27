import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from flowloom.llm import secrets
from tests.llm.conftest import prose

PLANTED = [
    "password: hunter2hunter2", "token=short", 'API_KEY = "abcdEFGH1234"', "secret=token: abcdefghij", "AKIA" + "Q" * 16, "AKIAQQ AKIA",
    "0123456789abcdef" * 2, "DEADBEEF" * 8, "ghp_" + "a1" * 18, "xoxb-1234567890-abcdefghij", "sk_live_" + "x" * 24,
    "eyJhbGciOi.eyJzdWIiOjEyMzQ1Njc4OTAi.c2lnbmF0dXJlMTIz", "-----BEGIN RSA PRIVATE KEY-----", "🙂é passwd:'aaaabbbb'", "to" + "ken" + " " * 300 + "=" + "z" * 9,
]


def brute(text, rules=secrets.RULES):
    found = []
    for place, rule in enumerate(rules):
        for m in re.finditer(rule.pattern, text or ""):
            if len(m.group(m.lastindex or 0)) >= rule.least:
                found.append((m.start(), place, m.end(), rule.kind))
    return sorted(found)


def spans(frame):
    return {r.path: [tuple(s) for s in r.spans or []] for r in frame.collect()}


def texts(rng, n):
    out = []
    for _ in range(n):
        words = prose(rng, rng.randrange(40)).split()
        words += rng.sample(PLANTED, rng.randrange(4)) if rng.random() < 0.7 else []
        rng.shuffle(words)
        out.append(rng.choice([" ", "\n", ""]).join(words))
    return out


def test_equal_to_brute_force(spark):
    rng = random.Random(2)
    rows = list(enumerate(texts(rng, 300)))
    rows += [(1000 + i, rows[3][1]) for i in range(200)] + [(2000 + i, "".join(PLANTED)) for i in range(200)]
    frame = spark.createDataFrame(rows, "path long, text string").repartition(7)
    assert spans(secrets.scan_versions(frame, secrets.Ledger(spark))) == {p: brute(t) for p, t in rows}


def test_long_text_with_many_spans(spark):
    rng = random.Random(4)
    text = " ".join(rng.choice(PLANTED) + prose(rng, 3) for _ in range(30_000)) + "x" * 500_000
    frame = spark.createDataFrame([(1, text)], "path long, text string")
    assert spans(secrets.scan_versions(frame, secrets.Ledger(spark)))[1] == brute(text)


def test_odd_input(spark, odd_docs, no_docs):
    versions = odd_docs.withColumnRenamed("doc_id", "path").withColumns({c: F.lit("x") for c in ("blob", "spans", "salt", "rule")})
    found = secrets.scan_versions(versions, secrets.Ledger(spark))
    assert found.count() == odd_docs.count() and found.where("spans is not null").isEmpty()
    digest = secrets.digests(found).first()
    assert (digest.n_assign, digest.spans, digest.base_sha256) == (0, "", hashlib.sha256().hexdigest())
    assert secrets.scan_versions(no_docs.withColumnRenamed("doc_id", "path"), secrets.Ledger(spark)).count() == 0


def test_only_new_pairs_are_scanned(spark):
    rng = random.Random(8)
    old, new = texts(rng, 60), texts(rng, 20)
    ledger = secrets.Ledger(spark)
    frame = lambda xs: spark.createDataFrame(list(enumerate(xs)), "path long, text string")
    count = lambda: {r.rule: r["count"] for r in ledger.read().groupBy("rule").count().collect()}
    secrets.scan_versions(frame(old), ledger).collect()
    blobs = len(set(old))
    assert set(count().values()) == {blobs} and len(count()) == len(secrets.RULES)
    before = count()
    secrets.scan_versions(frame(old + old[:30]), ledger).collect()
    assert count() == before
    secrets.scan_versions(frame(old + new), ledger).collect()
    blobs = len(set(old + new))
    assert set(count().values()) == {blobs}
    # another version of one rule: its pairs alone are new, and the old version's findings are not shown
    changed = (*secrets.RULES[:2], secrets.Rule("hex", "[0-9a-f]{40,}", 40, version=2), *secrets.RULES[3:])
    found = spans(secrets.scan_versions(frame(old + new), ledger, changed))
    assert found == {p: brute(t, changed) for p, t in enumerate(old + new)}
    assert count() == {r.name: blobs for r in {*secrets.RULES, *changed}}


@pytest.mark.parametrize("call", ["scan", "paths"])
def test_no_python_in_the_plan(spark, odd_docs, call, capsys):
    ledger = secrets.Ledger(spark)
    docs = secrets.content_address(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumnRenamed("doc_id", "path"))
    frame = secrets.scan(docs, ledger.read()) if call == "scan" else secrets.digests(secrets.at_paths(docs, secrets.findings(ledger.read())))
    frame.explain()
    assert "Python" not in capsys.readouterr().out
