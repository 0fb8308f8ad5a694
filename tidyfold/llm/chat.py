"""Chat formatting by grammar round trip.

A turn is rendered as

    ### <Role>:\n<text>\n</turn>\n

and a conversation is its turns in order. The grammar is deterministic: a line
of a control string without a backslash before it is a mark, one with k > 0
backslashes is content with k - 1. Each turn is rendered as it is, parsed again
and compared with its source; where the two differ, the conflicting control
strings of its text get one backslash more and the turn is parsed again, until
it comes back identical. Since a rendered turn is parsed on its own and ends
with its mark, turns that round trip also do so when they are concatenated.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tidyfold.llm.common import table

OPEN, CLOSE = "### ", "</turn>"
NAMES = {"user": "User", "assistant": "Assistant", "system": "System", "tool": "Tool"}
ROLES = {v: k for k, v in NAMES.items()}
_CONTROL = re.compile(r"(\\*)(### |</turn>)")
_HEADER = re.compile(r"### ([^:\n]*):\n")
_QUOTE = str.maketrans({"\\": "\\\\", ":": "\\c", "\n": "\\n"})
_UNQUOTE = {"\\\\": "\\", "\\c": ":", "\\n": "\n"}

RENDERED = "conv_id long, turn long, role string, rendered string, text_start int, text_end int, levels int"
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(text: str) -> str:
    """One backslash more before every control string, however many it has."""
    return _CONTROL.sub(r"\\\1\2", text)


def render(role: str, text: str) -> str:
    """One turn; roles other than the known ones are marked by '=' and quoted."""
    name = NAMES.get(role) or "=" + role.translate(_QUOTE)
    return f"{OPEN}{name}:\n{text}\n{CLOSE}\n"


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """The turns of a formatted conversation: role, text, and the bounds of the text as it is written there.

    A string that isn't in the grammar raises ValueError.
    """
    turns, at = [], 0
    while at < len(formatted):
        header = _HEADER.match(formatted, at)
        if header is None:
            raise ValueError(f"no header at {at}")
        name = header[1]
        role = ROLES.get(name)
        if role is None:
            if not name.startswith("="):
                raise ValueError(f"unknown role {name!r}")
            role = re.sub(r"\\[\\cn]", lambda m: _UNQUOTE[m[0]], name[1:])
        start = header.end()
        for mark in _CONTROL.finditer(formatted, start):
            if not mark[1]:
                break
        else:
            raise ValueError("a turn without an end")
        end = mark.start()
        if mark[2] != CLOSE or formatted[end - 1] != "\n" or end - 1 < start or formatted[mark.end() : mark.end() + 1] != "\n":
            raise ValueError(f"a mark out of place at {end}")
        turns.append((role, _CONTROL.sub(lambda m: m[1][1:] + m[2], formatted[start : end - 1]), start, end - 1))
        at = mark.end() + 1
    return turns


def recovered(formatted: str) -> list[tuple[str, str]] | None:
    try:
        return [t[:2] for t in parse(formatted)]
    except ValueError:
        return None


def round_trip(role: str, text: str) -> tuple[str, int]:
    """The rendered turn that parses back to (role, text), and how often its text was escaped for that."""
    inner, levels = text, 0
    while recovered(rendered := render(role, inner)) != [(role, text)]:
        if levels > 1:
            raise ValueError("the turn doesn't come back identical")
        inner, levels = escape(inner), levels + 1
    return rendered, levels


def format_turns(turns: DataFrame) -> DataFrame:
    """Each row of (conv_id, turn, role, text) rendered, with the code points that bound its text in `rendered`.

    Null role or text counts as empty. Other columns are left out. A repeated
    row is a turn of its own.
    """

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out = {k: [] for k in ("rendered", "text_start", "text_end", "levels")}
            roles = [r or "" for r in part.column(2).to_pylist()]
            for role, text in zip(roles, part.column(3).to_pylist()):
                rendered, levels = round_trip(role, text or "")
                _, _, start, end = parse(rendered)[0]
                for k, v in (("rendered", rendered), ("text_start", start), ("text_end", end), ("levels", levels)):
                    out[k].append(v)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(roles, pa.string()), pa.array(out["rendered"], pa.string()), *(pa.array(out[k], pa.int32()) for k in ("text_start", "text_end", "levels"))],
                names=["conv_id", "turn", "role", "rendered", "text_start", "text_end", "levels"],
            )

    columns = [F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string")]
    return turns.select(*columns).mapInArrow(work, RENDERED)


def digests(rendered: DataFrame) -> DataFrame:
    """What the formatted conversations say when they are parsed: one row per conversation.

    Turns stand by turn (null first), then role and text. A conversation's rows
    stream through one task in that order; only hash states are held, so a
    conversation of any length takes constant memory. (A digest of a whole
    conversation is sequential: it can't be split.)
    """

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, out = None, None, []

        def closed() -> dict:
            n, whole, chars, loss, length = state
            return {"conv_id": now, "n_turns": n, "turns_sha256": whole.hexdigest(), "loss_chars": chars, "loss_sha256": loss.hexdigest(), "formatted_chars": length}

        schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
        for part in parts:
            for conv, formatted in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                if state is None or conv != now:
                    if state is not None:
                        out.append(closed())
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[4] += len(formatted)
                for role, text, _, _ in parse(formatted):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                    if role == "assistant":
                        state[2] += len(text)
                        state[3].update(text.encode())
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if state is not None:
            yield pa.RecordBatch.from_pylist([closed()], schema)

    order = ["conv_id", "turn", "role", "rendered"]
    return rendered.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "rendered").mapInArrow(work, DIGEST)


def op1_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations and conversation -7, whose two turns both hold the template's own marks."""
    hard = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([Row(conv_id=-7, turn=k, role=r, text=hard) for k, r in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return digests(format_turns(turns))


#: A turn's text gets one backslash per control string in it; marks and name are as long in every turn of a role.
SQL = f"""WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, k, CASE k WHEN 0 THEN 'user' ELSE 'assistant' END, '\\### Assistant: </turn> ok' FROM range(2) t(k)),
sized AS (SELECT *, len(text) + (len(text) - len(replace(text, '{OPEN}', ''))) // {len(OPEN)} + (len(text) - len(replace(text, '{CLOSE}', ''))) // {len(CLOSE)} + {len(OPEN) + len(CLOSE) + 4}
    + CASE WHEN role IN ('user', 'assistant', 'system', 'tool') THEN len(role) ELSE 1 + len(replace(replace(replace(role, '\\', '\\\\'), ':', '\\c'), chr(10), '\\n')) END AS chars FROM turns),
joined AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS whole,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '') AS loss, sum(chars)::BIGINT AS formatted_chars FROM sized GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, len(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM joined"""
