import os
import random
import struct
import tracemalloc

import pytest

from pyspark.sql import functions as F

from flowloom.llm import pieces

sentencepiece = pytest.importorskip("sentencepiece")
PATH = os.environ.get("FLOWLOOM_PIECES", "/opt/tokenizers/piece_bpe_32k.model")
needs_model = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary file")
ODD = ["", " ", "  ", "a", " a", "a ", "a  b", "▁", "a▁b", "▁▁ x", "\x00a", "\n\t", "日本語 é ﬁ 🙂", "<s> </s> <unk> <0x0A>", "a b", "x" * 3000, " " * 40 + "y", "tionstionsing " * 300]


def texts():
    rng = random.Random(4)
    return ODD + ["".join(rng.choice("abtehinos  ,.▁é日\n1AZ") for _ in range(rng.randrange(60))) for _ in range(1500)]


@needs_model
def test_merges_equal_the_library():
    with open(PATH, "rb") as file:
        model = pieces.Model.read(file.read())
    encoder, decoder = pieces.Encoder(model), pieces.Decoder(model)
    got = [x.tolist() for x in encoder.encode(texts())]
    assert got == sentencepiece.SentencePieceProcessor(model_file=PATH).encode(texts())
    assert [decoder.decode(x) for x in got] == [t.replace("▁", " ") for t in texts()]


@needs_model
def test_little_memory_gives_the_same(monkeypatch):
    with open(PATH, "rb") as file:
        model = pieces.Model.read(file.read())
    want = [x.tolist() for x in pieces.Encoder(model).encode(texts())]
    monkeypatch.setattr(pieces, "REMEMBERED", 50)
    monkeypatch.setattr(pieces, "AT_ONCE", 100)
    assert [x.tolist() for x in pieces.Encoder(model).encode(texts())] == want


@needs_model
@pytest.mark.parametrize("unit", ["abcdefgh0123+/", "日本語", "tionsing"])
def test_memory_grows_with_the_length_of_a_word(unit):
    with open(PATH, "rb") as file:
        encoder = pieces.Encoder(pieces.Model.read(file.read()))
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice(unit) for _ in range(n))
    tracemalloc.start()
    encoder.encode([word(20_000)])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50 << 20 and not any(len(w) > pieces.LONG for w in encoder.known)
    text = word(500_000) + " and"
    assert encoder.encode([text])[0].tolist() == sentencepiece.SentencePieceProcessor(model_file=PATH).encode(text)


def unigram_model():
    rng = random.Random(8)
    words = {"▁", "a", "b", "c", "▁a", "ab", "bc", "abc", "▁ab", "cab", "bca", "▁cab", "aa", "bb"}
    entries = [("<unk>", 0.0, 2)] + [(w, -rng.random() * 5 - 1, 1) for w in sorted(words)]

    def message(number, data):
        return bytes([number << 3 | 2, len(data)]) + data

    out = b""
    for piece, score, kind in entries:
        out += message(1, message(1, piece.encode()) + bytes([2 << 3 | 5]) + struct.pack("<f", score) + bytes([3 << 3, kind]))
    return out + message(2, bytes([3 << 3, 1])) + message(3, bytes([3 << 3, 1, 4 << 3, 0]))


def brute_unigram(model, word):
    scores = {p: s for p, s, t in zip(model.pieces, model.scores, model.types) if t == 1}
    floor = min(scores.values()) - pieces.UNKNOWN_COST
    best = {0: (0.0, [])}
    for end in range(1, len(word) + 1):
        options = []
        for start in range(end):
            piece = word[start:end]
            if piece in scores or end - start == 1:
                options.append((best[start][0] + scores.get(piece, floor), best[start][1] + [piece]))
        best[end] = max(options, key=lambda x: x[0])
    return best[len(word)]


def test_unigram_scores_are_the_best():
    model = pieces.Model.read(unigram_model())
    assert model.kind == pieces.UNIGRAM and model.add_mark and not model.trim
    encoder, rng = pieces.Encoder(model), random.Random(6)
    words = sorted({"▁" + "".join(rng.choice("abcx") for _ in range(rng.randrange(1, 12))) for _ in range(400)})
    score = dict(zip(model.pieces, model.scores))
    floor = min(s for s, t in zip(model.scores, model.types) if t == 1) - pieces.UNKNOWN_COST
    for word, packed in encoder.walk(words):
        ids = struct.unpack(f"{len(packed) // 4}i", packed)
        total = sum(floor if i == 0 else score[model.pieces[i]] for i in ids)
        assert total == pytest.approx(brute_unigram(model, word)[0]), word


@needs_model
def test_columns(spark, odd_docs, no_docs):
    model = pieces.read_model(spark, PATH)
    out = pieces.decode(pieces.encode(odd_docs, model), model)
    assert set(out.columns) == set(odd_docs.columns) | {"decoded"}
    for r in out.collect():
        assert r.decoded == r.text and (r.ids is None) == (r.text is None)
    assert pieces.encode(no_docs, model).count() == 0


@needs_model
def test_checked_encoding(spark, odd_docs, no_docs):
    model = pieces.read_model(spark, PATH)
    clash = odd_docs.withColumns({"ids": F.lit("x"), "round_trip": F.lit("x")})
    out = pieces.encode_checked(clash, model)
    assert sorted(out.columns) == sorted(clash.columns)
    want = sorted((str(r.doc_id), str(r.text), str(r.ids)) for r in pieces.encode(odd_docs, model).collect())
    assert sorted((str(r.doc_id), str(r.text), str(r.ids)) for r in out.collect()) == want
    assert out.where("not round_trip").isEmpty()
    # a text that holds the mark itself does not come back
    marked = spark.createDataFrame([(1, f"a {pieces.MARK}b", "en", "s", 0)], odd_docs.select("doc_id", "text", "lang", "source", "n_chars").schema)
    assert not pieces.encode_checked(marked, model).first().round_trip
    assert pieces.encode_checked(no_docs, model).count() == 0
