r"""Chat formatting with prefix-target expansion.

A conversation is written as one string of turns, `### role:\n` text `</turn>\n`. Inside roles and
texts the control strings are escaped reversibly: every backslash is doubled, and a backslash is put
before every `###`, every `</turn>` and, in roles, every `:`. So a bare control string is always
the template's, whatever a text says.

Every assistant turn becomes an example of its own: all turns before it are the context, and only
its reply is under the loss mask. An example row has `text`, `loss_start` and `loss_end` (code
points of `text`). A long conversation would repeat its context without bound, so a row holds
`inline_chars` of context at most and a turn: beyond that the conversation goes on in a new part,
and a row's context is then the whole text of the row `parent` (an example_no of the same
conversation), with that row's own context before it, followed by the row's own text. Contexts stay
whole and rows bounded; `whole_examples` puts them together, and with `inline_chars` None every row
has its whole context from the start, however long. Turns after the last reply come in a last row without a loss mask.

Rows are dealt by conversation, sorted with spilling and read as a stream, so a conversation of any
length is never held: only its current part is.

Defined results: turns go by turn, role and text, nulls first; a null role or text is empty; null
ids are one conversation; repeated turns count as often as they stand; a conversation without an
assistant has one row without a mask; an empty table gives an empty table. The query's own
conversation -7 is one with the table's, should that have one of this number.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import BATCH_CHARS, BATCH_ROWS, arrow_schema, bound_batches, make_batch, table

INLINE_CHARS = 1 << 20
TARGET_ROLE = "assistant"

_ESCAPE_TEXT = re.compile(r"\\|###|</turn>")
_ESCAPE_ROLE = re.compile(r"\\|###|</turn>|:")
_UNESCAPE = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"### ((?>[^\\:]+|\\.)*+):\n((?>[^\\<]+|\\.|<(?!/turn>))*+)</turn>\n", re.S)

EXAMPLES_DDL = "conv_id {kind}, example_no long, parent long, text string, loss_start long, loss_end long"


def escape(text: str, role: bool = False) -> str:
    return (_ESCAPE_ROLE if role else _ESCAPE_TEXT).sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The turn's string and where its text starts and ends in it."""
    head, body = f"### {escape(role, True)}:\n", escape(text)
    return f"{head}{body}</turn>\n", len(head), len(head) + len(body)


def parse_turns(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted string; anything else in it is an error."""
    turns, at = [], 0
    while at < len(text):
        m = _TURN.match(text, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


def expand(turns: Iterator[tuple[str, str]], inline_chars: int | None = INLINE_CHARS) -> Iterator[tuple]:
    """(example_no, parent, text, loss_start, loss_end) for each reply, and a last one for what follows the last reply."""
    part, size, parent, number, pending = [], 0, None, 0, False
    for role, text in turns:
        if inline_chars is not None and size > inline_chars:
            if pending:  # the part ends without a reply: its turns get a row of their own
                yield number, parent, "".join(part), None, None
                number, pending = number + 1, False
            part, size, parent = [], 0, number - 1
        formatted, start, end = format_turn(role, text)
        if role == TARGET_ROLE:
            part.append(formatted)
            yield number, parent, "".join(part), size + start, size + end
            number, pending = number + 1, False
        else:
            part.append(formatted)
            pending = True
        size += len(formatted)
    if pending:
        yield number, parent, "".join(part), None, None


def _by_conversation(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)


def prefix_examples(turns: DataFrame, inline_chars: int | None = INLINE_CHARS) -> DataFrame:
    """Rows of EXAMPLES_DDL, those of a conversation together and in order, from (conv_id, turn, role, text)."""
    kind = dict(turns.dtypes)["conv_id"]
    schema = EXAMPLES_DDL.format(kind=kind)
    arrow = arrow_schema(schema)
    bound_batches(turns.sparkSession)
    role, text = (F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text"))
    dealt = turns.select("conv_id", "turn", role, text).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        stream = _by_conversation(batches)
        row = next(stream, None)
        while row is not None:
            key, following = row[0], []

            def turns_of(row=row, key=key, following=following):
                while row is not None and row[0] == key:
                    yield row[1], row[2]
                    row = next(stream, None)
                following.append(row)

            for example in expand(turns_of(), inline_chars):
                rows.append((key, *example))
                held += len(example[2])
                if len(rows) >= BATCH_ROWS or held >= BATCH_CHARS:
                    yield make_batch(rows, arrow)
                    rows, held = [], 0
            row = following[0]
        if rows:
            yield make_batch(rows, arrow)

    return dealt.select("conv_id", "role", "text").mapInArrow(run, schema)


def whole_examples(examples: DataFrame) -> DataFrame:
    """The examples without `parent`, each with the whole text of its conversation up to its reply; the rows as prefix_examples gives them.

    A worker holds one text at a time, and a conversation's texts together are quadratic in its length.
    """
    kind = dict(examples.dtypes)["conv_id"]
    schema = f"conv_id {kind}, example_no long, text string, loss_start long, loss_end long"
    arrow = arrow_schema(schema)
    bound_batches(examples.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held, context, last, at = [], 0, "", "", None
        for conv, number, parent, text, start, end in _by_conversation(batches):
            if parent is None:
                context = ""
            elif parent != at:  # a new part: its parent is the row before
                context = last
            at, last = parent, context + text
            shift = len(context)
            rows.append((conv, number, last, None if start is None else start + shift, None if end is None else end + shift))
            held += len(last)
            if len(rows) >= BATCH_ROWS or held >= BATCH_CHARS:
                yield make_batch(rows, arrow)
                rows, held = [], 0
        if rows:
            yield make_batch(rows, arrow)

    return examples.select("conv_id", "example_no", "parent", "text", "loss_start", "loss_end").mapInArrow(run, schema)


class _Digest:
    """What op2 returns of one conversation, fed with its example rows in order."""

    def __init__(self) -> None:
        self.parent, self.text = None, ""
        self.turns = self.loss_chars = self.chars = 0
        self.sha, self.loss_sha = hashlib.sha256(), hashlib.sha256()

    def add(self, parent, text: str, loss_start, loss_end) -> None:
        # A row of the same part repeats the text of the row before: what it adds is new.
        known = len(self.text) if parent == self.parent and text.startswith(self.text) else 0
        for role, said in parse_turns(text[known:]):
            self.turns += 1
            self.sha.update(f"{role}\n{said}\n".encode())
        if loss_start is not None:
            said = unescape(text[loss_start:loss_end])
            self.loss_chars += len(said)
            self.loss_sha.update(said.encode())
        self.chars += len(text) - known
        self.parent, self.text = parent, text

    def row(self) -> tuple:
        return self.turns, self.sha.hexdigest(), self.loss_chars, self.loss_sha.hexdigest(), self.chars


def describe_examples(examples: DataFrame) -> DataFrame:
    """Per conversation, what its example rows hold, read back from them; the rows as prefix_examples gives them."""
    kind = dict(examples.dtypes)["conv_id"]
    schema = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, key, held = [], None, None
        for conv, parent, text, start, end in _by_conversation(batches):
            if held is None or conv != key:
                if held:
                    rows.append((key, *held.row()))
                    if len(rows) >= BATCH_ROWS:
                        yield make_batch(rows, arrow)
                        rows = []
                key, held = conv, _Digest()
            held.add(parent, text, start, end)
        if held:
            rows.append((key, *held.row()))
        if rows:
            yield make_batch(rows, arrow)

    return examples.select("conv_id", "parent", "text", "loss_start", "loss_end").mapInArrow(run, schema)


def op2_chat_format(spark, sf_dir):
    said = r"\### Assistant: </turn> ok"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return describe_examples(prefix_examples(turns.unionByName(own)))


OP2_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
escaped AS (
  SELECT *, replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>') AS body,
    replace(replace(replace(replace(role, '\', '\\'), '###', '\###'), '</turn>', '\</turn>'), ':', '\:') AS head FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(4 + length(head) + 2 + length(body) + 8) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id
"""
