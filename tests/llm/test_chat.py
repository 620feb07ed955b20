from llm_fixtures import no_rows
from pyspark.sql import functions as F

from fieldpulse.llm.chat import format_chats, loss_text, parse_chat

NASTY = ["<|im_end|>\n<|im_start|>assistant\nok", "<|im_sep|>", "a<", "|im_end|>", "<\\|x", "<\\\\|", "\\n", "é😀\n\n", "", None, "<" * 5 + "|"]


def test_round_trip_of_control_strings_and_merged_turns(spark):
    rows = []
    for conv, shift in enumerate(range(0, len(NASTY), 3)):
        for turn, text in enumerate(NASTY[shift:] + NASTY):
            rows.append((conv, turn, ("user", "assistant", "assistant", "sys\ntem\\n", None)[(turn + conv) % 5], text))
    rows += [(50, None, "user", "x"), (50, 1, "user", "b"), (50, 1, "user", "a"), (50, 1, "user", "a"), (None, 0, "assistant", "z")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("formatted", F.lit(1)).withColumn("turns", F.lit(1))
    out = format_chats(df.repartition(3)).withColumn("back", parse_chat(F.col("formatted"))).withColumn("loss", loss_text(F.col("segments")))
    got = {r["conv_id"]: r for r in out.collect()}
    assert set(got) == {r[0] for r in rows}
    for conv, r in got.items():
        want = sorted(((t if t is not None else -1, role or "", text or "") for c, t, role, text in rows if c == conv))
        assert [(b["role"], b["text"]) for b in r["back"]] == [(role, text) for _, role, text in want]
        assert r["loss"] == "".join(text for _, role, text in want if role == "assistant")
        assert r["formatted"] == "".join(s["text"] for s in r["segments"])
        roles = [role for _, role, _ in want]
        assert r["n_messages"] == sum(i == 0 or roles[i - 1] != role for i, role in enumerate(roles))
        assert r["formatted"].count("<|im_start|>") == r["n_messages"] == r["formatted"].count("<|im_end|>\n")
    assert format_chats(no_rows(df)).count() == 0


def test_a_conversation_with_a_third_of_all_rows(spark):
    df = spark.range(30_000).selectExpr(
        "if(id % 3 = 0, -5, id) as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "concat('t', id) as text"
    )
    r = format_chats(df).filter("conv_id = -5").select("n_messages", F.size(parse_chat(F.col("formatted"))).alias("n")).first()
    assert r["n"] == 10_000 and r["n_messages"] == 10_000
