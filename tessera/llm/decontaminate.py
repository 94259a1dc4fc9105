"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are compared as lower-case words joined by single spaces. An
item of length L may differ by ``e`` edits, ``ERROR_SHARE`` of L, about one
changed word in a question of two lines; it is cut into e + 1 pieces, so
wherever it occurs with at most e edits one piece occurs unchanged. All pieces
are searched at once with an Aho-Corasick automaton; each hit fixes a diagonal,
and the window around it is verified with Myers' bit-parallel edit distance over
the whole item. An item too short for a single edit is one piece, and occurs
where its words stand as they are, as whole words.

The benchmark is a stated query set. It is read in blocks of at most
``BLOCK_CHARS`` characters, whatever its size; each block is one map over all
documents without a shuffle, and a worker builds the block's automaton once.

Edge cases: null or empty texts and items without words match nothing; every
other item is searched, however short (``least_words`` leaves items of fewer
words out, on demand); null ids pass through; repeated documents or items give
repeated rows; texts of any length are searched as a whole; other columns, of
whatever name, are not read. Rows of the result are (doc_id, item_id, distance,
allowed), distance the least over the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.spans import freed
from tessera.session import bound_batches

ERROR_SHARE, BLOCK_CHARS = 0.08, 8_000_000
WORDS = re.compile(r"\w+")
MATCHES = "doc_id long, item_id long, distance int, allowed int"


def normalize(text: str | None) -> str:
    return " ".join(WORDS.findall((text or "").lower()))


def allowed_errors(length: int, share: float = ERROR_SHARE) -> int:
    return int(length * share)


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """The item in errors + 1 parts of nearly equal length, with their offsets."""
    cuts = [len(item) * i // (errors + 1) for i in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Pattern:
    """Myers' bit vectors of one item, for the least distance to any part of a text."""

    def __init__(self, item: str):
        self.length = len(item)
        self.masks: dict[str, int] = {}
        for i, c in enumerate(item):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def least_distance(self, text: str) -> int:
        full, top = (1 << self.length) - 1, 1 << (self.length - 1)
        plus, minus, score, least, masks = full, 0, self.length, self.length, self.masks
        for c in text:
            eq = masks.get(c, 0)
            vertical = eq | minus
            horizontal = (((eq & plus) + plus) ^ plus) | eq
            up = minus | (full & ~(horizontal | plus))
            down = plus & horizontal
            if up & top:
                score += 1
            elif down & top:
                score -= 1
                if score < least:
                    least = score
            up, down = up << 1 & full, down << 1 & full
            plus = down | (full & ~(vertical | up))
            minus = up & vertical
        return least


class Matcher:
    """The automaton over the pieces of a block of items."""

    def __init__(self, items: list[tuple[int | None, str]], share: float, least_words: int):
        self.items = [(i, n) for i, n in ((i, normalize(t)) for i, t in items) if n and n.count(" ") + 1 >= least_words]
        self.errors = [allowed_errors(len(n), share) for _, n in self.items]
        self.patterns: dict[int, Pattern] = {}
        where: dict[str, list[tuple[int, int]]] = {}
        for at, (_, item) in enumerate(self.items):
            for offset, part in pieces(item, self.errors[at]):
                where.setdefault(part, []).append((at, offset))
        self.automaton = ahocorasick.Automaton()
        for part, places in where.items():
            self.automaton.add_word(part, (len(part), places))
        if where:
            self.automaton.make_automaton()

    def find(self, text: str) -> dict[int, int]:
        """Least distance of each item that occurs, by its place in the block."""
        if not self.items:
            return {}
        found: dict[int, int] = {}
        seen: set[tuple[int, int]] = set()
        for end, (length, places) in self.automaton.iter(text):
            for at, offset in places:
                start = end + 1 - length - offset
                if found.get(at) == 0 or (at, start) in seen:
                    continue
                seen.add((at, start))
                item, errors = self.items[at][1], self.errors[at]
                if start >= 0 and text.startswith(item, start):
                    if errors or text[max(0, start - 1) : start] in ("", " ") and text[start + len(item) : start + len(item) + 1] in ("", " "):
                        found[at] = 0
                elif errors:
                    if at not in self.patterns:
                        self.patterns[at] = Pattern(item)
                    distance = self.patterns[at].least_distance(text[max(0, start - errors) : max(0, start + len(item) + errors)])
                    if distance <= errors and distance < found.get(at, errors + 1):
                        found[at] = distance
        return found


_matchers: dict[str, Matcher] = {}


def _matcher(block_id: str, items, share: float, least_words: int) -> Matcher:
    """The block's matcher, built once per Python worker; only the last block is kept."""
    if block_id not in _matchers:
        _matchers.clear()
        _matchers[block_id] = Matcher(items, share, least_words)
    return _matchers[block_id]


def _blocks(benchmark: DataFrame, block_chars: int) -> Iterator[list[tuple[int | None, str]]]:
    block, size = [], 0
    for row in benchmark.select("item_id", "text").filter(F.col("text").isNotNull()).toLocalIterator():
        if block and size + len(row["text"]) > block_chars:
            yield block
            block, size = [], 0
        block.append((None if row["item_id"] is None else int(row["item_id"]), row["text"]))
        size += len(row["text"])
    if block:
        yield block


def find_leaks(docs: DataFrame, benchmark: DataFrame, share: float = ERROR_SHARE, least_words: int = 1, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document and benchmark item that occurs in it within its error budget."""
    spark = docs.sparkSession
    bound_batches(spark)
    texts, out = docs.select(F.col("doc_id").cast("long"), "text"), None
    for block in _blocks(benchmark, block_chars):
        shipped = spark.sparkContext.broadcast(block)  # at most block_chars characters, one longer item at the most

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(f"{share} {least_words} {hash(tuple(shipped.value))}", shipped.value, share, least_words)
            for batch in batches:
                rows = []
                for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                    if text:
                        rows += [(doc_id, matcher.items[at][0], d, matcher.errors[at]) for at, d in sorted(matcher.find(normalize(text)).items())]
                if rows:
                    types = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), types, strict=True)], names=["doc_id", "item_id", "distance", "allowed"])

        part = texts.mapInArrow(lambda it, run=run: freed(run(it)), MATCHES)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], MATCHES) if out is None else out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, share: float = ERROR_SHARE, least_words: int = 1, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark item.

    One pass over the texts per block; the verdict is made on the row itself,
    so nothing is joined back and repeated or null ids do no harm. All columns
    pass through; only ``text`` is looked at.
    """
    schema, kept = docs.schema, docs
    bound_batches(docs.sparkSession)
    for block in _blocks(benchmark, block_chars):
        shipped = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(f"{share} {least_words} {hash(tuple(shipped.value))}", shipped.value, share, least_words)
            for batch in batches:
                yield batch.filter(pa.array([not (t and matcher.find(normalize(t))) for t in batch["text"].to_pylist()], pa.bool_()))

        kept = kept.mapInArrow(lambda it, run=run: freed(run(it)), schema)
    return kept
