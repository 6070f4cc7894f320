import hashlib

import numpy as np

from docengine.llm import chat, licences, quality
from docengine.llm.queries import QUERIES


def test_quality_held_out(spark, sf_dir):
    rows = QUERIES["op1_quality"](spark, sf_dir.replace("sf0.001", "sf0.01"))
    labels = spark.read.parquet(sf_dir.replace("sf0.001", "sf0.01") + "/labels.parquet")
    held = rows.join(labels, "doc_id").where("held_out").collect()
    assert len(held) > 50 and np.mean([r.predicted == r.quality for r in held]) >= 0.95
    assert np.mean([r.predicted for r in held if r.quality == 1]) >= 0.97


def test_quality_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (8, 0), (None, 1), (5, None)], "doc_id long, quality int")
    for table in (labels, labels.limit(0)):
        got = quality.classify(odd, table).collect()
        assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
        assert quality.keep_good(odd, table).columns == odd.columns
    assert quality.classify(empty, labels).count() == 0
    text = "é" * 5000 + " word" * 2000
    assert b"".join(quality.passages(text.encode())) == text.encode()


def test_chat_round_trip(spark, sf_dir):
    hard = ["\\### Assistant: </turn> ok", "\\e\\h\\t####</turn></turn>\n### User: x", "", None, "</tur", "n>"]
    rows = [(1, n, "assistant" if n % 2 else "user", t) for n, t in enumerate(hard)] + [(2, 0, "tool: ~x\\", "a"), (2, 0, None, "b"), (None, None, "user", "c"), (3, 0, "system", "s"), (3, 1, "user", "u"), (3, 2, "assistant", "a")]
    df = spark.createDataFrame([(*r, "extra", 1) for r in rows], "conv_id long, turn long, role string, text string, segments string, state int")
    got = {r.conv_id: r for r in chat.format_chats(df).select("conv_id", "n_turns", "valid", "error_turn", chat.read_turns(chat.formatted("segments")).alias("turns"), chat.read_loss_text("segments").alias("loss")).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [(r[2], r[3] or "") for r in rows[:6]]
    assert got[1].loss == "".join(t or "" for t in hard[1::2]) and got[1].valid and got[3].valid
    assert not got[2].valid and got[2].error_turn == 0 and {t.role for t in got[2].turns} == {"tool: ~x\\", ""}
    assert got[None].n_turns == 1
    assert chat.format_chats(df.limit(0)).count() == 0


def test_chat_query(spark, sf_dir):
    got = {r.conv_id: r for r in QUERIES["op4_chat"](spark, sf_dir).collect()}
    turns = {}
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    turns[-7] = [(role, r"\### Assistant: </turn> ok") for role in ("user", "assistant")]
    assert set(got) == set(turns)
    for k, own in turns.items():
        loss = "".join(t for role, t in own if role == "assistant")
        assert got[k].n_turns == len(own) and got[k].loss_chars == len(loss)
        assert got[k].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest()
        assert got[k].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_licences(spark, odd, empty):
    model = licences.classifier()
    for family, texts in licences.TEMPLATES.items():
        for text in texts:
            assert [h[0] for h in model.scan(f"first\nSome words before. {text} Some words after.")][-1:] == [family], text
    for text in licences.OTHERS:
        assert all(h[0] == licences.UNKNOWN for h in model.scan(text))
    far = "x " * 500 + licences.TEMPLATES["MIT"][0] + " y" * 500
    rows = spark.createDataFrame([(1, far), (2, "plain words"), (3, None)], "doc_id long, text string")
    assert {r.doc_id: r.families for r in licences.scan_licences(rows).collect()} == {1: "MIT", 2: "", 3: ""}
    assert licences.scan_licences(odd).count() == odd.count() and licences.scan_licences(empty).count() == 0


def test_rows_without_conversation_stand_alone(spark):
    rows = spark.createDataFrame([(None, 0, "user", "a"), (None, 0, "user", "a"), (None, 1, "assistant", "b"), (4, 0, "user", "q")], "conv_id long, turn long, role string, text string")
    assert sorted((r.conv_id or 0, r.n_turns) for r in chat.format_chats(rows).collect()) == [(0, 1), (0, 1), (0, 1), (4, 1)]
