"""Chat formatting by incremental black-box rendering.

The template is any function from turns to a string. Each prefix of a
conversation is rendered; where the output for one more turn starts with the
output before it, the new part is that turn's span. A template that changes
what it has already written is detected and reported, and gets no spans.
Inside a span the turn's own text is located by rendering the turn again with a
marker in place of the text.

The template here marks turns with control strings and escapes those strings
inside texts, reversibly: every ``<|`` in a text becomes ``<\\|`` and every
backslash run before a ``|`` grows by one.

Edge cases: a null text or role is empty; rows of one conversation are put in
order of turn, then role, then text, so repeated turns have a fixed order; a
null conversation id is a conversation of its own; an empty table gives none;
other columns, of whatever name, are not read.

Cost: a task holds the turns of one conversation, two of its renderings and up
to 8 MB of results, so its memory is about four times the longest conversation.
As every prefix is rendered, a conversation of n turns costs n renderings; a
conversation can't be split without knowing the template.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

START, END, BREAK = "<|im_start|>", "<|im_end|>", "<|br|>"
ESCAPE = re.compile(r"<(\\*)\|")
UNESCAPE = re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    r"""``<|`` to ``<\|``, ``<\|`` to ``<\\|`` and so on: no control string is left in the text."""
    return ESCAPE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return UNESCAPE.sub(r"<\1|", text)


def chatml(turns: list[Turn]) -> str:
    # A line break in a role is written as a control string, which no escaped text holds.
    return "".join(f"{START}{escape(role).replace(chr(10), BREAK)}\n{escape(text)}{END}\n" for role, text in turns)


class RewritesHistory(ValueError):
    """The template's output for more turns does not start with its output for fewer."""


def turn_spans(turns: list[Turn], template: Template) -> tuple[str, list[tuple[int, int]]]:
    """The full rendering, and each turn's span in it, from renderings of successive prefixes."""
    spans, before = [], template([])
    for n in range(1, len(turns) + 1):
        now = template(turns[:n])
        if not now.startswith(before):
            raise RewritesHistory(f"turn {n} changes what was written before")
        spans.append((len(before), len(now)))
        before = now
    return before, spans


def text_span(turn: Turn, template: Template, span: tuple[int, int], rendered: str) -> tuple[int, int]:
    """Where the turn's text stands within its span.

    The turn is rendered without text and with a marker as its text: what
    stands before the marker and after it is the turn's frame, and the span has
    to begin and end with it.
    """
    bare = template([(turn[0], "")])
    marker = next(m for m in (chr(c) for c in range(1, 0x10000)) if m not in bare)
    framed, empty = template([(turn[0], marker)]), len(template([]))
    at = framed.find(marker)
    if at < 0 or len(framed) != len(bare) + 1:
        raise RewritesHistory("the template drops or changes texts")
    lead, tail = framed[empty:at], framed[at + 1 :]
    start, end = span
    if not (rendered.startswith(lead, start) and rendered.endswith(tail, start, end) and end - start >= len(lead) + len(tail)):
        raise RewritesHistory("the frame of a turn depends on what stands before it")
    return start + len(lead), end - len(tail)


def render(turns: list[Turn], template: Template = chatml) -> dict:
    """The formatted conversation, its turn and text spans, and the loss mask (assistant texts)."""
    full, spans = turn_spans(turns, template)
    texts = [text_span(turn, template, span, full) for turn, span in zip(turns, spans, strict=True)]
    return {"formatted": full, "spans": spans, "texts": texts, "loss": [t for t, (role, _) in zip(texts, turns, strict=True) if role == "assistant"]}


TURN = re.compile(re.escape(START) + r"(.*?)\n(.*?)" + re.escape(END) + r"\n", re.DOTALL)


def read_back(formatted: str) -> list[Turn]:
    """Turns from the formatted text alone."""
    return [(unescape(m[1].replace(BREAK, "\n")), unescape(m[2])) for m in TURN.finditer(formatted)]


def _digest(turns: list[Turn]) -> str:
    return hashlib.sha256("".join(f"{role}\n{text}\n" for role, text in turns).encode()).hexdigest()


FORMATTED = "conv_id long, formatted string, span_starts array<int>, span_ends array<int>, loss_starts array<int>, loss_ends array<int>, rewrites_history boolean"


def format_conversations(conversations: DataFrame, template: Template = chatml) -> DataFrame:
    """One row per conversation: formatted text, turn spans, loss mask spans (code points).

    Turns come together by hash of the conversation and are sorted in the
    partition, so a task holds one conversation at a time.
    """
    cols = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    sorted_turns = cols.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def finished(conv_id: int | None, turns: list[Turn]) -> dict:
        try:
            made = render(turns, template)
        except RewritesHistory:
            made = {"formatted": template(turns), "spans": [], "loss": [], "rewrites": True}
        return {
            "conv_id": conv_id,
            "formatted": made["formatted"],
            "span_starts": [s for s, _ in made["spans"]],
            "span_ends": [e for _, e in made["spans"]],
            "loss_starts": [s for s, _ in made["loss"]],
            "loss_ends": [e for _, e in made["loss"]],
            "rewrites_history": made.get("rewrites", False),
        }

    schema = pa.schema(
        [("conv_id", pa.int64()), ("formatted", pa.string())]
        + [(n, pa.list_(pa.int32())) for n in ("span_starts", "span_ends", "loss_starts", "loss_ends")]
        + [("rewrites_history", pa.bool_())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, turns, made, size = None, [], [], 0
        for batch in batches:
            for conv_id, role, text in zip(batch["conv_id"].to_pylist(), batch["role"].to_pylist(), batch["text"].to_pylist(), strict=True):
                if turns and conv_id != key:
                    made.append(finished(key, turns))
                    size, turns = size + len(made[-1]["formatted"]), []
                    if size > 8_000_000:
                        yield pa.RecordBatch.from_pylist(made, schema)
                        made, size = [], 0
                key = conv_id
                turns.append((role, text))
        if turns:
            made.append(finished(key, turns))
        if made:
            yield pa.RecordBatch.from_pylist(made, schema)

    return sorted_turns.mapInArrow(run, FORMATTED)


def summarize_formatted(formatted: DataFrame) -> DataFrame:
    """Counts and digests that are read back from the formatted text and the loss mask alone."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv_id, text, starts, ends in zip(*(batch[c].to_pylist() for c in ("conv_id", "formatted", "loss_starts", "loss_ends")), strict=True):
                turns = read_back(text)
                loss = "".join(unescape(text[s:e]) for s, e in zip(starts, ends, strict=True))
                rows.append((conv_id, len(turns), _digest(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return formatted.select("conv_id", "formatted", "loss_starts", "loss_ends").mapInArrow(run, schema)
