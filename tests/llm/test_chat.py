import hashlib
import random

import duckdb
import pytest

from treeloom.llm import chat

SF = "/root/testdata/sf0.001"
FIELDS = "conv_id long, turn long, role string, text string"
NASTY = ["\\", "### ", "</turn>", "\n", "<part ", "<part image 0>", ":", ": ", " ", "a", "é", "\U0001f600", "</turn>\n### user: ", "\\\\", "<", "#"]


def plain(rows):
    """conv: (n_turns, turns_sha256, loss_chars, loss_sha256), from the rows alone."""
    out = {}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] is not None, (r[3] or "").encode())
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=key)
        said = "".join(r[3] or "" for r in own if r[2] == "assistant")
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        out[conv] = (len(own), hashlib.sha256(turns.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())
    return out


def found(df):
    return {r["conv"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in df.collect()}


def nasty_rows(seed: int, convs: int) -> list[tuple]:
    r = random.Random(seed)
    some = lambda: "".join(r.choice(NASTY) for _ in range(r.randint(0, 9)))
    return [(c, t, r.choice(["user", "assistant", "assistant", some()]), some()) for c in range(convs) for t in range(r.randint(1, 8))]


@pytest.mark.parametrize("block_chars", [1, 60, 1 << 18])
def test_nasty_texts_come_back(spark, block_chars):
    rows = [*nasty_rows(1, 60), (None, 0, "assistant", "x"), (None, None, None, None), (3, 0, "user", None), (3, 0, "user", None), (3, 0, "user", ""), (61, 5, "assistant", None)]
    df = spark.createDataFrame([(*r, "y", 1) for r in rows], FIELDS + ", conv string, at int").repartition(3)
    blocks = chat.format_conversations(df, block_chars=block_chars)
    got = chat.digests(blocks)
    assert found(got) == plain(rows)
    texts = {}
    for b in blocks.orderBy("at").collect():
        texts[b["conv"]] = texts.get(b["conv"], "") + b["text"]
        assert all(b["text"][s["start"] : s["end"]] for s in b["loss"])
    assert {r["conv"]: r["formatted_chars"] for r in got.collect()} == {c: len(t) for c, t in texts.items()}


def test_a_conversation_with_a_third_of_all_rows_is_split(spark):
    rows = [(7, t, ("user", "assistant")[t % 2], f"text {t} </turn>") for t in range(3000)] + [(c, t, "assistant", "ok") for c in range(100, 2100) for t in range(3)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # these rows are few enough for one task
    try:
        blocks = chat.format_conversations(spark.createDataFrame(rows, FIELDS).repartition(8), block_chars=2000)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    own = [b for b in blocks.collect() if b["conv"] == 7]
    assert len({b["at"] >> 33 for b in own}) > 1 and all(len(b["text"]) < 2200 for b in own)
    assert found(chat.digests(blocks)) == plain(rows)


def test_typed_parts(spark):
    part = lambda kind, text=None, ref=None, width=None, height=None, seconds=None, pages=None: (kind, text, ref, width, height, seconds, pages)
    first = [part("text", "see <pa"), part("text", "rt image 0> "), part("image", ref="s3/a.png", width=57, height=28), part("audio", ref="b.wav", seconds=1.5), part("text", None)]
    second = [part("text", "look: "), part("document", ref="c.pdf", pages=3), None, part("text", " and "), part("video 2", ref="d"), part(None), part("image", ref="e")]
    df = spark.createDataFrame([(1, 0, "user", first), (1, 1, "assistant", second), (1, 2, "assistant", None), (1, 3, "user", [])], f"conv_id long, turn long, role string, content {chat.PARTS}")
    block = chat.format_conversations(df, parts_col="content").first()
    turns = list(chat.read_turns(block["text"]))
    assert turns[0] == ("user", "see <part image 0> ", [("image", 0), ("audio", 1)])
    assert turns[1] == ("assistant", "look:  and ", [("document", 0), ("other", 1), ("other", 2), ("image", 3)])
    assert turns[2:] == [("assistant", "", []), ("user", "", [])]
    attached = [tuple(a) for a in block["attachments"]]
    assert attached == [(0, 0, "image", "s3/a.png", 3), (0, 1, "audio", "b.wav", 19), (1, 0, "document", "c.pdf", 768), (1, 1, "video 2", "d", 1), (1, 2, "other", None, 1), (1, 3, "image", "e", 1)]
    assert [chat.unescaped(block["text"][s["start"] : s["end"]]) for s in block["loss"]] == ["look: ", " and "]
    assert block["n_tokens"] == 5 + 22 + 2 + 2 + 768 + 3 and block["n_turns"] == 4
    assert chat.digests(chat.format_conversations(df, parts_col="content")).first()["n_attachments"] == 6


@pytest.mark.parametrize("bad", ["x", "### user", "### user: hi", "### user: hi</turn>", "### user: hi\\</turn>\n"])
def test_broken_text_is_refused(bad):
    with pytest.raises(ValueError):
        list(chat.read_turns(bad))


def test_empty_table(spark):
    assert chat.digests(chat.format_conversations(spark.createDataFrame([], FIELDS))).collect() == []


def test_registered_query_against_plain_python_and_sql(spark):
    df = chat.op13_chat_format(spark, SF)
    got = sorted(map(tuple, df.collect()))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    wanted = con.sql(chat.OP13_SQL)
    assert wanted.columns == df.columns and sorted(wanted.fetchall()) == got
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(df.withColumnRenamed("conv_id", "conv")) == plain(rows + chat.PLANTED)
