"""Bring chat records of any layout into turns and format them with a loss mask.

A record's schema fingerprint is the hash of its nested field paths, as far as a
declared layout knows them (other fields don't matter). It selects a declarative
mapping, which says where roles and texts lie. Formatting writes one chunk per
turn: ``<|im_start|>role\\ntext<|im_end|>\\n``. Control strings inside roles and
texts get a backslash after their first character and backslashes are doubled, so
no control string stands in a text and reading back is exact.

A conversation's output is the chunks of its turns in order. They stay rows, so a
conversation of any length is formatted and read back as a stream.

Defined results: a null role or text is empty; a record that no layout fits (or
that is no JSON object) keeps its row, with a null layout and no turns; rows of a
null conversation id form one conversation; rows that share a turn number follow
by chunk; repeated rows are turns of their own.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

#: Fixed values of the format.
START, END, BREAK = "<|im_start|>", "<|im_end|>", "\n"
CONTROL = (START, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant"}
LEARNED_ROLE = "assistant"


# ---- layouts ---------------------------------------------------------------


@dataclass(frozen=True)
class Turn:
    """Where one turn, or each turn of the list at ``each``, has its text and role.

    ``role_from`` names a field; ``role`` is fixed. An ``also`` field is put
    below the text. ``optional`` leaves the turn out where its text is missing.
    """

    text: str
    role: str = ""
    role_from: str | None = None
    each: str | None = None
    also: str | None = None
    optional: bool = False
    names: dict = field(default_factory=dict, hash=False)


@dataclass(frozen=True)
class Layout:
    name: str
    needs: frozenset[str]
    may: frozenset[str]
    turns: tuple[Turn, ...]


_SYSTEM = Turn("system", role="system", optional=True)


def _layout(name: str, needs: str, may: str, *turns: Turn) -> Layout:
    return Layout(name, frozenset(needs.split()), frozenset(may.split()), turns)


LAYOUTS = (
    _layout("messages", "messages[].role messages[].content", "system",
            _SYSTEM, Turn("content", role_from="role", each="messages")),
    _layout("dialogue", "conversations[].from conversations[].value", "system",
            _SYSTEM, Turn("value", role_from="from", each="conversations", names=ROLE_NAMES)),
    _layout("instruction", "instruction output", "input system",
            _SYSTEM, Turn("instruction", role="user", also="input"), Turn("output", role="assistant")),
    _layout("response", "prompt response", "system",
            _SYSTEM, Turn("prompt", role="user"), Turn("response", role="assistant")),
    _layout("completion", "prompt completion", "system",
            _SYSTEM, Turn("prompt", role="user"), Turn("completion", role="assistant")),
    _layout("question", "question answer", "system",
            _SYSTEM, Turn("question", role="user"), Turn("answer", role="assistant")),
    _layout("turn", "", "role text", Turn("text", role_from="role")),
)

KNOWN = frozenset().union(*(x.needs | x.may for x in LAYOUTS))


def field_paths(value, path: str = "") -> set[str]:
    """Paths of all non-null leaves; list elements share the path ``[]``."""
    if isinstance(value, dict):
        inner = [field_paths(v, f"{path}.{k}" if path else k) for k, v in value.items()]
    elif isinstance(value, list):
        inner = [field_paths(v, f"{path}[]") for v in value]
    else:
        return set() if value is None else {path}
    return set().union(*inner)


def schema_fingerprint(paths) -> str:
    """Hash of the paths that any layout knows."""
    return hashlib.sha256("\n".join(sorted(KNOWN.intersection(paths))).encode()).hexdigest()[:16]


def _mappings() -> dict[str, Layout]:
    """Each layout under the fingerprint of every set of fields it allows."""
    out: dict[str, Layout] = {}
    for x in LAYOUTS:
        for n in range(len(x.may) + 1):
            for extra in itertools.combinations(sorted(x.may), n):
                out.setdefault(schema_fingerprint(x.needs | set(extra)), x)
    return out


MAPPINGS = _mappings()


def _string(value) -> str:
    if value is None:
        return ""
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def record_turns(record: str | None) -> tuple[str | None, list[tuple[str, str]]]:
    """Layout name and ``(role, text)`` turns of a JSON record."""
    try:
        value = json.loads(record or "")
    except ValueError:
        return None, []
    if not isinstance(value, dict):
        return None, []
    paths = field_paths(value)
    layout = MAPPINGS.get(schema_fingerprint(paths))
    # Without any known field only an empty record is a turn, one of null role and text.
    if layout is None or (paths and not KNOWN.intersection(paths)):
        return None, []
    turns = []
    for rule in layout.turns:
        for item in value.get(rule.each) or [] if rule.each else [value]:
            item = item if isinstance(item, dict) else {}
            if rule.optional and item.get(rule.text) is None:
                continue
            text = _string(item.get(rule.text))
            if rule.also and item.get(rule.also):
                text += "\n" + _string(item[rule.also])
            role = _string(item.get(rule.role_from)) if rule.role_from else rule.role
            turns.append((rule.names.get(role, role), text))
    return layout.name, turns


# ---- template --------------------------------------------------------------

_CONTROL = re.compile("|".join(re.escape(x) for x in sorted(CONTROL, key=len, reverse=True)))


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The chunk of a turn and the part of it under the loss mask, in code points."""
    # The role ends at the first line break, so its own ones are written as \n.
    head = START + escape(role).replace("\n", "\\n") + BREAK
    body = escape(text)
    at = len(head)
    span = (at, at + len(body)) if role == LEARNED_ROLE else (at, at)
    return head + body + END + BREAK, *span


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """``(role, text)`` turns read back from formatted output."""
    turns, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(START, at):
            raise ValueError(f"no turn begins at {at}")
        line = formatted.index(BREAK, at)
        end = formatted.index(END, line)
        role = re.sub(r"\\(\\|n)?", lambda m: {"n": "\n", "\\": "\\"}.get(m[1], ""),
                      formatted[at + len(START) : line])
        turns.append((role, unescape(formatted[line + 1 : end])))
        at = end + len(END) + len(BREAK)
    return turns


# ---- tables ----------------------------------------------------------------

_FORMATTED = pa.schema(
    [("conv_id", pa.int64()), ("turn", pa.int64()), ("part", pa.int64()), ("layout", pa.string()),
     ("chunk", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64())]
)


def _format_batches(batches):
    for batch in batches:
        rows = []
        for conv, turn, record in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            layout, turns = record_turns(record)
            rows += [(conv, turn, i, layout, *format_turn(*t)) for i, t in enumerate(turns)] or [
                (conv, turn, 0, layout, "", 0, 0)
            ]
        columns = zip(*rows, strict=True) if rows else [()] * len(_FORMATTED)
        arrays = [pa.array(c, f.type) for c, f in zip(columns, _FORMATTED, strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, schema=_FORMATTED)


def format_records(records: DataFrame) -> DataFrame:
    """One chunk per turn of ``records(conv_id, turn, record)``.

    ``record`` is a JSON object of any known layout: a whole conversation or one
    turn of it. ``turn`` orders the records of a conversation, ``part`` the turns
    of a record. ``loss_start`` and ``loss_end`` count code points of the chunk.
    """
    return records.select("conv_id", "turn", "record").mapInArrow(
        _format_batches, from_arrow_schema(_FORMATTED)
    )


def turn_records(conversations: DataFrame) -> DataFrame:
    """Rows ``(conv_id, turn, role, text)`` as records of one turn each."""
    return conversations.select(
        "conv_id", "turn", F.to_json(F.struct("role", "text")).alias("record")
    )


_DIGESTS = pa.schema(
    [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
     ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
)


def _digest_batches(batches):
    started, conv = False, None
    turns = loss = None
    n = loss_chars = chars = 0
    done: list[tuple] = []

    def flush():
        if started:
            done.append((conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))

    def batch_of_done():
        columns = zip(*done, strict=True) if done else [()] * len(_DIGESTS)
        arrays = [pa.array(c, f.type) for c, f in zip(columns, _DIGESTS, strict=True)]
        done.clear()
        return pa.RecordBatch.from_arrays(arrays, schema=_DIGESTS)

    for batch in batches:
        for key, chunk, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if not started or key != conv:
                flush()
                started, conv = True, key
                turns, loss, n, loss_chars, chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            chars += len(chunk)
            for role, text in parse_turns(chunk):
                turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                n += 1
            masked = unescape(chunk[a:b])
            loss.update(masked.encode("utf-8", "surrogatepass"))
            loss_chars += len(masked)
        yield batch_of_done()
    flush()
    yield batch_of_done()


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """Turns, masked text and length of each conversation, read back from its chunks.

    A digest needs a conversation's chunks in order; they pass through the task as
    a sorted stream and are never held together.
    """
    ordered = (
        formatted.select("conv_id", "turn", "part", "chunk", "loss_start", "loss_end")
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "part", "chunk")
    )
    return ordered.select("conv_id", "chunk", "loss_start", "loss_end").mapInArrow(
        _digest_batches, from_arrow_schema(_DIGESTS)
    )


_ESCAPED = r"regexp_replace(replace({}, '\', '\\'), '(<)(\|im_start\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|<SYS>>|</SYS>>)|(\[)(/?INST\])', '\1\3\\\2\4', 'g')"

#: DuckDB's form of the query over ``conversations``.
CHAT_SQL = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), f AS (
  SELECT *, CASE WHEN role = 'assistant' THEN text ELSE '' END AS loss,
    '<|im_start|>' || {_ESCAPED.format("role")} || chr(10) || {_ESCAPED.format("text")} || '<|im_end|>' || chr(10) AS chunk
  FROM c
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, chunk)) AS turns_sha256,
  sum(length(loss))::BIGINT AS loss_chars,
  sha256(string_agg(loss, '' ORDER BY turn, chunk)) AS loss_sha256,
  sum(length(chunk))::BIGINT AS formatted_chars
FROM f GROUP BY conv_id
"""
