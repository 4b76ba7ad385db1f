"""Chat formatting of typed content parts, with a loss mask, and the reader of what was formatted.

A visitor flattens a message's parts: texts are escaped, images, audio and documents become placeholders numbered in order, whose
reference and number of tokens after expansion go to the attachments. A turn is `### role: ...</turn>` and a line end. Control
strings within texts and roles get a backslash, backslashes are doubled, so every text can be read back.

Rows are dealt by ranges of conversation and turn and sorted, and each task joins its turns to blocks of `block_chars` characters at
least, so a conversation that holds a third of all rows is formatted by many tasks and no task holds more than a block and a message. Blocks carry
their order (`at`) and the spans under the loss mask in code points; placeholders are not under it. A conversation of one block inside
its task is whole (`whole`). Digests need a conversation's blocks in order: the others are sorted and read as a stream, of which one
block at a time is held.

Defined cases: a null text or null parts count as empty, a null role as an empty string, rows with null ids are one conversation. Turns with
one number come by role, then by the order of their parts, nulls first, and repeated rows are turns like any others. Adjacent text parts become
one. Parts of an unknown kind are attachments of one token; null parts are skipped. An empty table gives no rows. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Collection, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.llm.common import bound_batches, materialize, slices, table

HEADER, AFTER_ROLE, END, PLACEHOLDER = "### ", ": ", "</turn>\n", "<part "
_CONTROL = re.compile(r"\\|### |</turn>|<part ")
_ROLE_CONTROL = re.compile(r"\\|### |</turn>|<part |:")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_ROLE_END = re.compile(r"\\.|: ", re.DOTALL)
_BODY = re.compile(r"\\.|</turn>\n|<part ([^ >]*) (\d+)>", re.DOTALL)
_PLAIN_KIND = re.compile(r"[^ >\\]+")
BLOCK_CHARS = 1 << 18
PARTS = "array<struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"


def escaped(text: str, control: re.Pattern = _CONTROL) -> str:
    return control.sub(lambda m: "\\" + m[0], text)


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


class Expansion(NamedTuple):
    """Tokens that parts become in the end: an image's tiles, audio by the second, documents by the page, texts by their bytes."""

    tile: int = 28
    audio_rate: float = 12.5
    page_tokens: int = 256
    text_bytes: int = 4


class Attachment(NamedTuple):
    number: int  # within its turn
    kind: str
    ref: str | None
    n_tokens: int


class Flattener:
    """Visits the parts of one message in order; `pieces` alternates escaped texts (True) and placeholders (False)."""

    def __init__(self, expansion: Expansion = Expansion()):
        self.expansion = expansion
        self.pieces: list[tuple[bool, str]] = []
        self.attachments: list[Attachment] = []
        self.n_tokens = 0
        self._text: list[str] = []

    def visit(self, part: dict) -> None:
        getattr(self, f"visit_{part['kind']}" if part["kind"] in ("text", "image", "audio", "document") else "visit_other")(part)

    def visit_text(self, part: dict) -> None:
        self._text.append(part["text"] or "")

    def visit_image(self, part: dict) -> None:
        across, down = (max(1, -(-(part[k] or 0) // self.expansion.tile)) for k in ("width", "height"))
        self._attach(part, across * down)

    def visit_audio(self, part: dict) -> None:
        self._attach(part, max(1, math.ceil((part["seconds"] or 0) * self.expansion.audio_rate)))

    def visit_document(self, part: dict) -> None:
        self._attach(part, max(1, part["pages"] or 0) * self.expansion.page_tokens)

    def visit_other(self, part: dict) -> None:
        self._attach(part, 1)

    def _attach(self, part: dict, tokens: int) -> None:
        self._end_text()
        kind = part["kind"] or "other"
        number = len(self.attachments)
        self.pieces.append((False, f"{PLACEHOLDER}{kind if _PLAIN_KIND.fullmatch(kind) else 'other'} {number}>"))
        self.attachments.append(Attachment(number, kind, part["ref"], tokens))
        self.n_tokens += tokens

    def _end_text(self) -> None:
        text = "".join(self._text)
        self._text.clear()
        if text:
            self.pieces.append((True, escaped(text)))
            self.n_tokens += -(-len(text.encode("utf-8", "surrogatepass")) // self.expansion.text_bytes)

    def done(self) -> Flattener:
        self._end_text()
        return self


def flattened(parts: list[dict | None] | None, expansion: Expansion = Expansion()) -> Flattener:
    visitor = Flattener(expansion)
    for part in parts or ():
        if part is not None:
            visitor.visit(part)
    return visitor.done()


class Turn(NamedTuple):
    """A turn as read back: its text without placeholders, and the kinds and numbers of these."""

    role: str
    text: str
    placeholders: list[tuple[str, int]]


def read_turns(formatted: str) -> Iterator[Turn]:
    """The turns of formatted text, unescaped."""
    at = 0
    while at < len(formatted):
        if not formatted.startswith(HEADER, at):
            raise ValueError(f"no turn begins at {at}")
        role_end = next((m for m in _ROLE_END.finditer(formatted, at + len(HEADER)) if m[0] == AFTER_ROLE), None)
        if role_end is None:
            raise ValueError(f"the role at {at} does not end")
        role, begin = unescaped(formatted[at + len(HEADER) : role_end.start()]), role_end.end()
        texts, placeholders = [], []
        for m in _BODY.finditer(formatted, begin):
            if m[0][0] == "\\":
                continue
            texts.append(formatted[begin : m.start()])
            begin = m.end()
            if m[0] == END:
                break
            placeholders.append((m[1], int(m[2])))
        else:
            raise ValueError(f"the turn at {at} does not end")
        yield Turn(role, unescaped("".join(texts)), placeholders)
        at = begin


_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
_ATTACHMENT = pa.struct([("turn", pa.int64()), ("number", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("n_tokens", pa.int64())])
_BLOCK = "text string, loss array<struct<start:bigint,end:bigint>>, attachments array<struct<turn:bigint,number:int,kind:string,ref:string,n_tokens:bigint>>, n_turns long, n_tokens long, whole boolean"
_NAMES = ["conv", "text", "loss", "attachments", "n_turns", "n_tokens", "whole"]


class _Block:
    def __init__(self):
        self.text: list[str] = []
        self.loss: list[tuple[int, int]] = []
        self.attachments: list[tuple] = []
        self.n_turns = self.n_tokens = self.size = 0

    def put(self, text: str) -> None:
        self.text.append(text)
        self.size += len(text)

    def add(self, turn: int | None, role: str, flat: Flattener, loss_roles: Collection[str]) -> None:
        self.put(f"{HEADER}{escaped(role, _ROLE_CONTROL)}{AFTER_ROLE}")
        for is_text, piece in flat.pieces:
            if is_text and role in loss_roles:
                self.loss.append((self.size, self.size + len(piece)))
            self.put(piece)
        self.put(END)
        self.attachments += [(turn, *a) for a in flat.attachments]
        self.n_turns += 1
        self.n_tokens += flat.n_tokens

    def row(self) -> tuple:
        return "".join(self.text), self.loss, [dict(zip(("turn", "number", "kind", "ref", "n_tokens"), a, strict=True)) for a in self.attachments], self.n_turns, self.n_tokens


def text_parts(text: Column) -> Column:
    """A text as its message's only part."""
    return F.array(F.named_struct(F.lit("kind"), F.lit("text"), F.lit("text"), F.coalesce(text, F.lit("")))).cast("array<struct<kind:string,text:string>>")


def format_conversations(
    messages: DataFrame,
    *,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    parts_col: str | None = None,
    loss_roles: Collection[str] = ("assistant",),
    expansion: Expansion = Expansion(),
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """conv, at, text, loss, attachments, n_turns, n_tokens, whole: the written blocks of all conversations; a conversation's text is that of its blocks by `at`.

    parts_col is a column of PARTS; without it a message is the text of text_col.
    """
    bound_batches(messages.sparkSession)
    parts = F.col(parts_col).cast(PARTS) if parts_col else F.col(text_col)
    rows = messages.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), parts.alias("parts"))
    conv_type = rows.schema["conv"].dataType.simpleString()

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, now, kind = _Block(), None, pa.null()  # now: (conversation,) of the block
        n_convs = n_blocks = 0

        def out(whole: bool) -> pa.RecordBatch:
            text, loss, attachments, n_turns, n_tokens = block.row()
            columns = [pa.array([now[0]], kind), pa.array([text]), pa.array([[{"start": a, "end": b} for a, b in loss]], pa.list_(_SPAN)), pa.array([attachments], pa.list_(_ATTACHMENT))]
            return pa.RecordBatch.from_arrays([*columns, pa.array([n_turns], pa.int64()), pa.array([n_tokens], pa.int64()), pa.array([whole])], names=_NAMES)

        for batch in slices(batches):
            kind = batch.column(0).type
            for conv, turn, role, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != (conv,):
                    if now is not None:
                        yield out(n_convs > 1 and n_blocks == 0)  # a task's first and last conversation may go on elsewhere
                    block, now, n_blocks = _Block(), (conv,), 0
                    n_convs += 1
                elif block.size >= block_chars:
                    yield out(False)
                    block = _Block()
                    n_blocks += 1
                content = content if parts_col else [{"kind": "text", "text": content}]
                block.add(turn, role, flattened(content, expansion), loss_roles)
        if now is not None:
            yield out(False)

    dealt = rows.repartitionByRange(F.col("conv").asc(), F.col("turn").asc()).sortWithinPartitions("conv", "turn", "role", "parts")
    blocks = dealt.mapInArrow(join, f"conv {conv_type}, {_BLOCK}").withColumn("at", F.monotonically_increasing_id())
    return materialize(blocks, "chat-blocks")


_DIGESTS = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, n_attachments long"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for the blocks of each conversation, which come one after the other."""
    names = ["conv", *(f.split()[0] for f in _DIGESTS.split(", "))]
    now, out, kind, state = None, [], pa.null(), None

    def row() -> tuple:
        return now[0], state["n"], state["turns"].hexdigest(), state["chars"], state["loss"].hexdigest(), state["all"], state["tokens"], state["attached"]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        types = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        columns = zip(*rows, strict=True) if rows else [()] * len(types)
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)

    for batch in slices(batches, 64):
        kind = batch.column(0).type
        for conv, text, loss, n_tokens, n_attachments in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now != (conv,):
                if now is not None:
                    out.append(row())
                now, state = (conv,), {"n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "all": 0, "tokens": 0, "attached": 0}
            for turn in read_turns(text):
                state["turns"].update(f"{turn.role}\n{turn.text}\n".encode("utf-8", "surrogatepass"))
                state["n"] += 1
            for span in loss:
                under = unescaped(text[span["start"] : span["end"]])
                state["loss"].update(under.encode("utf-8", "surrogatepass"))
                state["chars"] += len(under)
            state["all"] += len(text)
            state["tokens"] += n_tokens
            state["attached"] += n_attachments
        yield batch_of(out)
        out = []
    if now is not None:
        yield batch_of([row()])


def digests(blocks: DataFrame) -> DataFrame:
    """conv and what is read back from its blocks: turns, loss text, sizes and their digests."""
    columns = ["conv", "text", "loss", "n_tokens", F.size("attachments").cast("long").alias("n_attachments")]
    fields = f"conv {blocks.schema['conv'].dataType.simpleString()}, {_DIGESTS}"
    single = blocks.where("whole").select(*columns).mapInArrow(_digests, fields)
    rest = blocks.where("not whole").repartition("conv").sortWithinPartitions("conv", "at").select(*columns).mapInArrow(_digests, fields)
    return single.unionByName(rest)


#: The contract's own conversation.
PLANTED = [(-7, turn, role, "\\### Assistant: </turn> ok") for turn, role in enumerate(("user", "assistant"))]


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    messages = given.unionByName(spark.createDataFrame(PLANTED, "conv_id long, turn long, role string, text string"))
    return digests(format_conversations(messages)).withColumnRenamed("conv", "conv_id")


_SQL_ESCAPED = "regexp_replace({0}, '(\\\\|### |</turn>|<part {1})', '\\\\\\1', 'g')"
OP13_SQL = f"""
WITH m AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '\\### Assistant: </turn> ok' FROM range(2) t(i)),
x AS (
  SELECT *, CASE WHEN role = 'assistant' THEN text ELSE '' END AS said,
    {len(HEADER + AFTER_ROLE + END)} + length({_SQL_ESCAPED.format("role", "|:")}) + length({_SQL_ESCAPED.format("text", "")}) AS size
  FROM m)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  sum(length(said))::BIGINT AS loss_chars, sha256(string_agg(said, '' ORDER BY turn, role, text)) AS loss_sha256, sum(size)::BIGINT AS formatted_chars,
  sum((octet_length(encode(text)) + 3) // 4)::BIGINT AS n_tokens, 0::BIGINT AS n_attachments
FROM x GROUP BY conv_id
"""
