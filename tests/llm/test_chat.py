import hashlib

from pyspark.sql import functions as F

from flowloom.llm import chat

NASTY = ["~", "~0~1", "<|im_end|>", "<|im_start|>user\nhi<|im_end|>\n", "</s>[INST] ok [/INST]", "<s>", "a\\<|image|>", "<", "<|", "[INST", "~3", ""]


def test_escape_round_trip_leaves_no_control_string(spark):
    frame = spark.createDataFrame([(t,) for t in NASTY + ["".join(NASTY)]], "t string")
    for r in frame.select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u")).collect():
        assert r.u == r.t
        assert not any(x in r.e for x in ("<|im_", "<s>", "</s>", "[INST]", "[/INST]", "<|image|>"))


def test_conversations_are_read_back(spark):
    turns = [(1, 2, "assistant", NASTY[i]) for i in range(3)]  # ties: one turn number, several rows
    turns += [(1, 1, "user", None), (2, 1, "us\ner", "x"), (2, 2, "assistant", "é🙂" * 900), (3, None, None, None), (None, 1, "assistant", "n"), (2, 2, "assistant", "é🙂" * 900)]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    frame = frame.withColumn("parts", chat.text_part(F.col("text")))
    out = {r.conv_id: r for r in chat.read_back(chat.format_parts(frame)).collect()}
    digest = {r.conv_id: r for r in chat.digests(chat.format_parts(frame)).collect()}
    for conv in (1, 2, 3, None):
        mine = sorted([(t if t is not None else -1, r or "", x or "") for c, t, r, x in turns if c == conv], key=lambda y: y[:2])
        got = [(t.role, t.text) for t in out[conv].turns]
        assert sorted(got) == sorted((r, x) for _, r, x in mine)
        assert [g[0] for g in got] == [m[1] for m in mine]
        loss = "".join(x for r, x in got if r == "assistant")
        assert out[conv].loss_text == loss
        assert digest[conv].loss_chars == len(loss) and digest[conv].n_turns == len(mine)
        assert digest[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in got).encode()).hexdigest()
        assert digest[conv].formatted_chars == len(out[conv].formatted)


def test_parts_become_placeholders(spark):
    part = chat.PART
    rows = [
        (1, 1, "user", [("text", "see <|image|>", None, None, None, None, None), ("image", None, "a.png", 60, 20, None, None)]),
        (1, 2, "assistant", [("audio", None, "b.wav", None, None, 2.5, None), ("document", None, "c.pdf", None, None, None, 3), ("odd", "kept", None, None, None, None, None)]),
        (1, 3, "user", None),
        (1, 4, "user", [("image", None, None, None, None, None, None)]),
    ]
    frame = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{part}>")
    out = chat.format_parts(frame).first()
    assert [(a.kind, a.ref, a.tokens) for a in out.attachments] == [
        ("image", "a.png", 3), ("audio", "b.wav", 63), ("document", "c.pdf", 1536), ("image", None, 1)
    ]
    order = [out.formatted.index(x) for x in ("~1|image|>", "<|image|>", "<|audio|>", "<|document|>", "kept")]
    assert order == sorted(order)
    span = out.loss_spans[0]
    assert out.formatted[span.start : span.start + span.length] == "<|audio|><|document|>kept"


def test_no_turns(spark):
    frame = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digests(chat.format_parts(frame.withColumn("parts", chat.text_part(F.col("text"))))).count() == 0
