"""Chat formatting: a template is a black box, and turns are located by rendering successive prefixes."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haruspex.llm import common as C

Turn = tuple[str, str]  # role, text
Template = Callable[[list[Turn]], str]

#: Turns, up to twice as many, that are rendered before a turn to find its span, if the template
#: is declared turn-local; for any other, all turns from the conversation's start are.
CONTEXT = 16

END = "</turn>"
_NAMES = {"user": "User", "assistant": "Assistant", "system": "System", "tool": "Tool"}
_ROLES = {v: k for k, v in _NAMES.items()}
_CONTROL = re.compile(r"\\|###|</turn>")


def escape(text: str) -> str:
    r"""A backslash before each backslash and control string."""
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(\\|###|</turn>)", r"\1", text)


def _header(role: str) -> str:
    name = _NAMES.get(role) or "=" + re.sub(r"[\\:\n]", lambda m: "\\" + ("n" if m[0] == "\n" else m[0]), role)
    return f"### {name}: "


def default_template(turns: list[Turn]) -> str:
    """``### Role: text</turn>`` and a line break for each turn."""
    return "".join(f"{_header(r)}{escape(t)}{END}\n" for r, t in turns)


def parse_turn(span: str) -> Turn:
    """Role and text of one turn as ``default_template`` renders it."""
    m = re.match(r"### ((?:[^\\:]|\\.)*): ", span, re.S)
    if not m or not span.endswith(END + "\n"):
        raise ValueError("not a rendered turn")
    name = m[1]
    role = re.sub(r"\\(.)", lambda x: "\n" if x[1] == "n" else x[1], name[1:], flags=re.S) if name.startswith("=") else _ROLES[name]
    return role, unescape(span[m.end() : -len(END) - 1])


class RewritesHistory(ValueError):
    """A template's rendering of more turns doesn't start with its rendering of fewer."""


def _probed(past: list[Turn], role: str, template: Template, before: str) -> tuple[str, str]:
    """What a turn's span has before and behind its text, by rendering the turn with other texts."""
    one, two, none = (template([*past, (role, t)]) for t in ("a", "b", ""))
    at = next((i for i, (x, y) in enumerate(zip(one, two)) if x != y), None)
    if at is None or not one.startswith(before) or len(one) != len(none) + 1 or not none.startswith(before):
        raise RewritesHistory(f"turn {len(past)}: its text isn't rendered once, in place")
    return none[len(before) : at], none[at:]


def turn_spans(turns: Iterator[Turn], template: Template, context: int | None = None) -> Iterator[tuple[Turn, str, tuple[int, int]]]:
    """Each turn with the characters that it adds to the output, and where its escaped text lies in them.

    Renders the turns so far, without and with the new one; what the second
    output has beyond the first is the turn's span.  If the second doesn't start
    with the first, the template rewrites history.  The text's place is found by
    rendering the turn with other texts and comparing.

    ``context`` is for templates whose output is each turn's own, in order: ``context`` to
    twice as many turns are rendered before one, and what surrounds a text is probed again only where
    a turn of the same role was surrounded otherwise.  That this is so is not believed: after
    1, 2, 4, 8, ... turns and at the end the whole prefix is rendered and compared with the
    spans so far, and an output that differs rewrites history.  So a conversation of n turns costs
    about 2 n turns' rendering for the prefixes and ``1.5 * context * n`` for the windows, and its turns are held.
    """
    past: list[Turn] = []
    every: list[Turn] = []
    spans: list[str] = []
    around: dict[str, tuple[str, str]] = {}
    joined, length, due = hashlib.sha256(), 0, 1
    before = template([])
    if context is not None and before:
        raise RewritesHistory("a turn-local template renders nothing for no turns")

    def compare() -> None:
        whole = template(list(every))
        if len(whole) != length or hashlib.sha256(whole.encode("utf-8", "surrogatepass")).digest() != joined.digest():
            raise RewritesHistory(f"the first {len(every)} turns aren't rendered as their spans")

    for role, text in turns:
        if context is not None and len(past) >= 2 * context:
            past, spans = past[-context:], spans[-context:]
            before = template(past)
            if before != "".join(spans):
                raise RewritesHistory("the template isn't turn-local")
        now = template([*past, (role, text)])
        if not now.startswith(before):
            raise RewritesHistory(f"turn {len(past)} changes what was rendered before")
        span = now[len(before) :]
        head, tail = around.get(role) or _probed(past, role, template, before)
        fits = lambda: len(span) >= len(head) + len(tail) and span.startswith(head) and span.endswith(tail)  # noqa: E731, B023
        if not fits() and role in around:
            head, tail = _probed(past, role, template, before)
        if not fits():
            raise RewritesHistory(f"turn {len(past)}: what surrounds the text depends on it")
        if context is not None:
            around[role] = head, tail
            every.append((role, text))
            spans.append(span)
            joined.update(span.encode("utf-8", "surrogatepass"))
            length += len(span)
        yield (role, text), span, (len(head), len(span) - len(tail))
        past.append((role, text))
        before = now
        if context is not None and len(every) == due:
            compare()
            due *= 2
    if len(every) != due // 2:
        compare()


class _Digest:
    """What is read back from a conversation's output, turn by turn, in bounded memory."""

    def __init__(self) -> None:
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = 0

    def add(self, role: str, text: str, span: str, where: tuple[int, int]) -> None:
        self.n += 1
        self.chars += len(span)
        self.turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        if role == "assistant":
            shown = unescape(span[where[0] : where[1]])
            self.loss_chars += len(shown)
            self.loss.update(shown.encode("utf-8", "surrogatepass"))


_FIELDS = [
    ("rewrites", T.BooleanType()), ("n_turns", T.LongType()), ("turns_sha256", T.StringType()), ("loss_chars", T.LongType()),
    ("loss_sha256", T.StringType()), ("formatted_chars", T.LongType()), ("error", T.StringType()),
]


def format_conversations(turns: DataFrame, template: Template = default_template, turn_local: bool | None = None, parse: Callable[[str], Turn] = parse_turn) -> DataFrame:
    """One row for each conversation, read back from its formatted output.

    Rows are dealt by conversation and sorted by turn, and each task streams
    through its rows.  For a template declared ``turn_local`` (by default only
    ``default_template`` is) it renders windows, and whole prefixes at doubling
    turns (``turn_spans``): time in proportion to the conversation.  For others it
    renders all prefixes, in time that grows with its square.  A template is a
    function of all turns, so a conversation's turns are held by one task.
    ``parse`` reads a turn's role and text back from its span.

    * A conversation whose rendering rewrites history: ``rewrites`` is true and all
      else null.  One for which the template or ``parse`` raises anything else: ``error``
      says what, and all else is null.  The other conversations aren't touched by it.
    * Null text or role: empty.  Null turn: after the others.  Null conversation: one of its own.
    * Equal turn numbers: by role, then text, both by code point; repeated rows are repeated turns.
    * Other columns aren't read.  Empty input: empty result.
    """
    C.small_batches(turns.sparkSession)
    context = CONTEXT if (template is default_template if turn_local is None else turn_local) else None
    key = turns.schema["conv_id"].dataType
    schema = T.StructType([T.StructField("conv_id", key)] + [T.StructField(n, t) for n, t in _FIELDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from itertools import groupby

        from pyspark.sql.pandas.types import to_arrow_schema

        def rows():
            for b in batches:
                yield from zip(*(b.column(i).to_pylist() for i in range(3)))

        out: list[tuple] = []
        arrow = to_arrow_schema(schema)
        pack = lambda: pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], arrow.field(i).type) for i in range(len(arrow))], schema=arrow)
        for conv, of in groupby(rows(), key=lambda r: r[0]):
            d = _Digest()
            try:
                for _, span, where in turn_spans(((r, t) for _, r, t in of), template, context):
                    d.add(*parse(span), span, where)
                made = (False, d.n, d.turns.hexdigest(), d.loss_chars, d.loss.hexdigest(), d.chars, None)
            except RewritesHistory:
                made = (True, *[None] * 6)
            except Exception as e:  # the template's or parse's own, whatever it is: they are black boxes
                made = (*[None] * 6, f"{type(e).__name__}: {e}")
            out.append((conv, *made))
            if len(out) >= 1000:
                yield pack()
                out.clear()
        if out:
            yield pack()

    named = turns.select("conv_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "turn")
    dealt = named.repartition(C.partitions(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_last(), "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(run, schema)


#: DuckDB SQL of ``op5_chat_format``.
SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
f AS (
  SELECT *, '### ' || CASE role WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant' WHEN 'system' THEN 'System' WHEN 'tool' THEN 'Tool'
    ELSE '=' || replace(replace(replace(role, '\', '\\'), ':', '\:'), chr(10), '\n') END || ': '
    || regexp_replace(text, '(\\|###|</turn>)', '\\\1', 'g') || '</turn>' || chr(10) AS shown FROM t)
SELECT conv_id, false AS rewrites, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(shown)) AS BIGINT) AS formatted_chars, CAST(NULL AS VARCHAR) AS error
FROM f GROUP BY conv_id
"""


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = C.load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, k, r, "\\### Assistant: </turn> ok") for k, r in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    return format_conversations(turns.unionByName(probe))
