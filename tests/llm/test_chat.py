import hashlib
import random

import pytest

from tidyfold.llm import chat

HARD = ["", " ", "\n", "### ", "</turn>", "\\### Assistant: </turn> ok", "\\\\</turn>", "a\n### User:\nb\n</turn>\n", "ends with \\", "### ### </turn></turn>", "é日 x", "\x00", "x" * 100_000]


def brute(rows):
    """Digests from the source rows alone (formatted_chars aside)."""
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, []).append((-(10**18) if turn is None else turn, role or "", text or ""))
    return {c: (len(t), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in sorted(t)).encode()).hexdigest(), sum(len(x) for _, r, x in t if r == "assistant"), hashlib.sha256("".join(x for _, r, x in sorted(t) if r == "assistant").encode()).hexdigest()) for c, t in out.items()}


@pytest.mark.parametrize("role", ["user", "assistant", "system", "User", "", "a:b\nc\\n", "=x"])
def test_every_turn_comes_back(role):
    rnd = random.Random(1)
    parts = ["### ", "</turn>", "\\", "\n", "a", "User:", "Assistant:\n"]
    for text in [*HARD, *("".join(rnd.choice(parts) for _ in range(rnd.randint(0, 9))) for _ in range(300))]:
        rendered, levels = chat.round_trip(role, text)
        (found,) = chat.parse(rendered)
        assert found[:2] == (role, text) and levels <= 1
        assert rendered[found[2] : found[3]] == (chat.escape(text) if levels else text)


def test_conversations_parse_as_a_whole():
    turns = [(("user", "assistant", "system")[k % 3], t) for k, t in enumerate(HARD)]
    whole = "".join(chat.round_trip(*t)[0] for t in turns)
    assert [t[:2] for t in chat.parse(whole)] == turns
    for bad in ("x", "### User:\nno end", "### Nobody:\nx\n</turn>\n", "### User:\nx</turn>\n"):
        with pytest.raises(ValueError):
            chat.parse(bad)


def test_digests_read_back_from_the_output(spark):
    rows = [(1, 1, "assistant", HARD[5]), (1, 0, "user", HARD[7]), (2, 0, None, None), (2, None, "assistant", "x"), (2, 1, "assistant", "y"), (2, 1, "assistant", "y"), (None, 0, "user", "z"), *((9, k, "assistant", f"t{k}") for k in range(3000))]
    turns = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, rendered string")
    formatted = chat.format_turns(turns)
    got = {r.conv_id: tuple(r)[1:] for r in chat.digests(formatted).collect()}
    assert {c: v[:4] for c, v in got.items()} == brute(rows)
    lengths = {}
    for r in formatted.collect():
        lengths[r.conv_id] = lengths.get(r.conv_id, 0) + len(r.rendered)
    assert {c: v[4] for c, v in got.items()} == lengths
    assert chat.digests(chat.format_turns(turns.limit(0))).count() == 0
