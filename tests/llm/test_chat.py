"""Round trips of awkward texts, and the machine's verdicts."""

import random

import pytest

from tallybook.llm import chat

PIECES = ["\\", "[", "[INST]", "[/INST]", "</s>", "<", "/s>", "INST]", "[SYS]", "[TEXT]", "[ROLE]", "[ANS]", "é", "\n", " ", "a", "$1", "[/", "]"]


def test_round_trip(spark):
    rng = random.Random(4)
    text = lambda: "".join(rng.choices(PIECES, k=rng.randint(0, 9)))
    roles = ["user", "assistant", "system", "tool", "[TEXT]x\\", "", None]
    rows = [(c, t, rng.choice(roles), rng.choice([text(), text(), text(), None])) for c in range(60) for t in range(rng.randint(1, 6))]
    rows += [(1000, 1, "user", "same"), (1000, 1, "user", "same"), (None, None, "user", "x"), (None, 2, "assistant", "long " * 40_000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, loss string")
    out = chat.conversations_out(chat.format_segments(df)).withColumn("turns", chat.read_back(chat.F.col("formatted")))
    got = {r.conv_id: ([(t.role, t.text) for t in r.turns], r.loss_text, r.formatted) for r in out.collect()}
    want = {}
    for c, t, role, body in sorted(rows, key=lambda r: (str(r[0]), r[1] is None, r[1] or 0, (r[2] or "").encode(), (r[3] or "").encode())):
        want.setdefault(c, []).append((role or "", body or ""))
    assert {c: g[0] for c, g in got.items()} == want
    assert {c: g[1] for c, g in got.items()} == {c: "".join(t for r, t in turns if r == "assistant") for c, turns in want.items()}
    # A control string is in the output as often as the template wrote it, never from a text.
    for c, (turns, _, formatted) in got.items():
        assert formatted.count("</s>") == sum(r == "assistant" for r, _ in turns)
        assert formatted.count("[INST]") == formatted.count("[/INST]") == sum(r == "user" for r, _ in turns)
    assert chat.conversations_out(chat.format_segments(df.limit(0))).count() == 0


@pytest.mark.parametrize("roles, valid", [
    ("user", True), ("user assistant", True), ("system user assistant user", True), ("assistant", False),
    ("system", False), ("user user", False), ("user assistant system", False), ("user tool", False)])
def test_turn_order(spark, roles, valid):
    df = spark.createDataFrame([(1, i, r, "t") for i, r in enumerate(roles.split())], "conv_id bigint, turn bigint, role string, text string")
    assert chat.conversations_out(chat.format_segments(df)).first().valid is valid


def test_templates_that_texts_could_break_are_refused(spark):
    for marks in (chat.Marks("<a", "a>"), chat.Marks("x", "[y]"), chat.Marks("[a\\]", "[b]"), chat.Marks("[a]", "[a][b]")):
        with pytest.raises(ValueError):
            chat.Template(roles={"user": marks}).check()
