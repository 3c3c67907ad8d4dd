"""Chat formatting with a template treated as a black box.

The conversation is rendered for every prefix of its turns. If the render of k turns starts with the render
of k - 1, what was added is the span of turn k; if not, the template rewrites history, and the
conversation is reported with the first turn that does so. Within a span, the text of the turn is located
by rendering the prefix once more with another text in that turn: what the two renders share at
both ends belongs to the template, what lies between is the text as the template wrote it.

Control strings that occur inside texts are escaped reversibly: ESCAPE stands before each character that
would begin one, and before itself.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import arrow_schema, map_arrow, table

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

# The marks of the default template. No text keeps one of them unescaped.
OPEN, BREAK, CLOSE = "<|turn|>", "<|text|>", "<|end|>"
#: Control strings of common templates, escaped in texts as well, so that no reader takes them for marks.
FOREIGN = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
ESCAPE = "\\"
#: Rows and characters that leave a worker together, at most.
SLICE_ROWS, SLICE_CHARS = 512, 4_000_000
_CONTROL = (OPEN, BREAK, CLOSE, *FOREIGN)


def escape(text: str) -> str:
    """The escape character doubled, and one put after the first character of every control string."""
    return _escape_short(text) if len(text) <= 2048 else _escape(text)


def _escape(text: str) -> str:
    text = text.replace(ESCAPE, ESCAPE * 2)
    for c in _CONTROL:
        text = text.replace(c, c[0] + ESCAPE + c[1:])
    return text


#: Prefixes are rendered again and again; the bound is 4,096 texts of 2,048 characters.
_escape_short = functools.lru_cache(maxsize=4096)(_escape)


def unescape(text: str) -> str:
    """Undoes escape: of a pair of escape characters one stays, a single one goes."""
    if ESCAPE not in text:
        return text
    return ESCAPE.join(part.replace(ESCAPE, "") for part in text.split(ESCAPE * 2))


def template(turns: list[Turn]) -> str:
    """The default template: a mark, the role, a mark, the text, a mark; roles and texts are escaped."""
    return "".join(f"{OPEN}{escape(role)}{BREAK}{escape(text)}{CLOSE}" for role, text in turns)


@dataclass
class Rendered:
    text: str
    #: (start, end) of each turn, and of its text within; code points. Empty from the turn on that rewrites history.
    turns: list[tuple[int, int]]
    texts: list[tuple[int, int]]
    #: First turn whose addition changed what was rendered before; None if there is none.
    rewrites_at: int | None


def _common(a: str, b: str) -> int:
    """Length of the common start of a and b, by halving: comparisons of slices, not of characters."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def render(turns: list[Turn], make: Template = template, probes: tuple[str, str] = ("x", "yy")) -> Rendered:
    """Renders the prefixes one after the other and compares each with the one before."""
    spans: list[tuple[int, int]] = []
    texts: list[tuple[int, int]] = []
    before = make([])
    for k in range(1, len(turns) + 1):
        own = make(turns[:k])
        if not own.startswith(before):
            return Rendered(make(turns), spans, texts, k - 1)
        start = len(before)
        # two probes that share no character show where the template's own part of the span ends and begins
        role = turns[k - 1][0]
        one, two = (make([*turns[: k - 1], (role, p)])[start:] for p in probes)
        head = _common(one, two)
        tail = _common(one[head:][::-1], two[head:][::-1])
        spans.append((start, len(own)))
        texts.append((start + head, len(own) - tail))
        before = own
    return Rendered(before, spans, texts, None)


def read_back(text: str) -> list[Turn]:
    """The turns of a text made by the default template."""
    out = []
    for part in text.split(OPEN)[1:]:
        role, _, rest = part.removesuffix(CLOSE).partition(BREAK)
        out.append((unescape(role), unescape(rest)))
    return out


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[Turn]]]:
    """Conversations one after the other, from rows (conv_id, role, text) in order of conversation and turn."""
    key, turns = None, []
    for batch in batches:
        for conv, role, text in zip(*(c.to_pylist() for c in batch.columns)):
            if turns and conv != key:
                yield key, turns
                turns = []
            key = conv
            turns.append((role, text))
    if turns:
        yield key, turns


def _batches(rows: Iterator[tuple[int, tuple]], schema: str) -> Iterator[pa.RecordBatch]:
    """Record batches of rows (characters, values), each of SLICE_ROWS and SLICE_CHARS at most, but one row at least."""
    shape = arrow_schema(schema)
    held, size = [], 0
    for chars, values in rows:
        if held and (len(held) >= SLICE_ROWS or size + chars > SLICE_CHARS):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), shape)], schema=shape)
            held, size = [], 0
        held.append(values)
        size += chars
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), shape)], schema=shape)


def format_conversations(rows: DataFrame, make: Template = template) -> DataFrame:
    """One row per conversation: conv_id, formatted, turn_spans, text_spans, roles, rewrites_at.

    rows: conv_id, turn, role, text. Turns are ordered by turn (null first), then role, then text; repeated rows are
    turns of their own; null role or text counts as empty; rows with a null conv_id are one conversation.
    Other columns are ignored; an empty table gives no rows. Spans are arrays of starts and ends, in code points.
    A task holds one conversation at a time.
    """
    schema = "conv_id long, formatted string, turn_spans array<long>, text_spans array<long>, roles array<string>, rewrites_at long"
    flat = lambda spans: [x for s in spans for x in s]

    def one(conv: int | None, turns: list[Turn]) -> tuple[int, tuple]:
        made = render(turns, make)
        return len(made.text), (conv, made.text, flat(made.turns), flat(made.texts), [r for r, _ in turns], made.rewrites_at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches((one(conv, turns) for conv, turns in _conversations(batches)), schema)

    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    own = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), blank("role"), blank("text"))
    ordered = own.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return map_arrow(ordered.select("conv_id", "role", "text"), run, schema)


def digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all read from the formatted text and its spans."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def one(conv: int | None, text: str, spans: list[int]) -> tuple[int, tuple]:
        turns = read_back(text)
        loss = "".join(unescape(text[a:b]) for (role, _), a, b in zip(turns, spans[::2], spans[1::2]) if role == "assistant")
        told = "".join(f"{role}\n{said}\n" for role, said in turns)
        return 0, (conv, len(turns), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches((one(*row) for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns))), schema)

    return map_arrow(formatted.select("conv_id", "formatted", "text_spans"), run, schema)


def op3_chat_format(spark, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return digests(format_conversations(rows.unionByName(extra)))
