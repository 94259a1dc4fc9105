"""Substring dedup by relative Lempel-Ziv parsing.

Every text is factored against the whole corpus as its reference, in blocks. A
window of ``window`` words belongs to the block of its anchor, the smallest hash
among its ``GRAM``-word grams, so equal windows always meet in one block,
wherever they stand. Consecutive windows of one anchor are a *phrase*; the
phrases tile the text. A block indexes the phrases of all texts as a suffix
array and parses each greedily: from its first window that occurs elsewhere it
takes the longest match with any other place, as a *factor* (text, start,
length; source text, source start), then goes on. A factor of n windows is
n + window - 1 words long, so all factors are long enough to be duplicate spans.

Boundaries: plain parsing would go on at the word after a factor and overlook a
copy that starts inside it and ends in the next one, from another reference. So
the parse goes on at the factor's next *window*: each window that straddles the
boundary of two factors is looked up, and likewise between two phrases, as each
window is in one phrase.

Confirmation: a factor's words are digested where its source stands, and the
span is only removed if its own words have that digest. So a collision of the
48-bit window hashes never removes a word (it may hide another source of the
same window from its parse, with a chance of 2 ** -48 a pair).

How it is spread: equal texts are brought together first, so a text that occurs
ten thousand times is indexed once. Each map task parses its own batch, and
sends only phrases with a window that it has not sent before. An anchor with
more than ``HOT`` phrases in one batch is hot: its windows are dealt out by
their own hashes, in a second round, and a marker tells its block to pass on
what came from other batches. Blocks are read in anchor order as a stream, with
the distinct windows of one anchor in memory. As a source is a neighbour in the
suffix array, no place is the source of more than two factors a batch.

Edge cases: a null text has no words; ids may be null or repeated, and repeated
rows are occurrences of their own; texts shorter than a window keep all words;
an empty table gives an empty result; other columns, of whatever name, are not
read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.spans import freed
from tessera.session import bound_batches

WINDOW, GRAM = 35, 8
BATCH_BYTES = 6_000_000
CARRY_ROWS = 4096
HOT = 64
BASE = np.uint64(0x9E3779B97F4A7C15)
PLACE_BITS = 28
#: A phrase, or (no windows) a factor, or (no class) the mark of a hot anchor; ``single`` rows are for the second round.
PHRASES = "anchor long, cls binary, start int, n int, windows binary, source binary, source_start int, single boolean"
FACTORS = "cls binary, start int, n int, source binary, source_start int"
NAMES = [x.split(" ")[0] for x in PHRASES.split(", ")]
FACTOR_NAMES = NAMES[1:4] + NAMES[5:7]
TOP48 = np.uint64(0xFFFFFFFFFFFF0000)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def gram_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Polynomial hash of every run of ``length`` word hashes, by doubling."""
    out, done, power, part, size = None, 0, BASE, words, 1
    rest = length
    with np.errstate(over="ignore"):
        while rest:
            if rest & 1:
                if out is None:
                    out, done = part, size
                else:
                    n = len(words) - done - size + 1
                    out = out[:n] * power + part[done : done + n]
                    done += size
            rest >>= 1
            if rest:
                n = len(words) - 2 * size + 1
                part = part[:n] * power + part[size : size + n]
                power, size = power * power, size * 2
    return out


def sliding_min(keys: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        keys = np.minimum(keys[:-size], keys[size:])
        size *= 2
    rest = width - size
    return np.minimum(keys[: len(keys) - rest], keys[rest:]) if rest else keys


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def runs_of(flags: np.ndarray, group: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the set flags, and for each the end (among them) of its stretch of consecutive places of one group."""
    at = np.flatnonzero(flags)
    if not len(at):
        return at, at
    g, p = group[at], place[at]
    heads = np.flatnonzero(np.append(True, (g[1:] != g[:-1]) | (p[1:] != p[:-1] + 1)))
    ends = np.append(heads[1:], len(at))
    return at, np.repeat(ends, ends - heads)


def factors(keys: np.ndarray, group: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Greedy factors of windows: (first window, number of windows, source window), and the first window of each kind.

    ``keys`` tell windows apart; ``place`` is the start of each in its ``group``,
    a stretch of text. Windows that occur once are literals. The others are
    sorted as suffixes of their stretches, by doubling ranks; the longest match
    of each is with a neighbour in that order.
    """
    _, first, names, counts = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    at, end = runs_of(counts[names] >= 2, group, place)
    n = len(at)
    if not n:
        return at, at, at, first
    here, ranks, step = np.arange(n), [names[at]], 1
    longest = int((end - here).max())
    while step < longest:
        old = ranks[-1].astype(np.int64)
        after = np.where(here + step < end, old[np.minimum(here + step, n - 1)] + 1, 0)
        ranks.append(np.unique(old * (n + len(counts) + 1) + after, return_inverse=True)[1])
        step *= 2
    order = np.argsort(ranks[-1], kind="stable")
    x, y = order[:-1], order[1:]
    common = np.zeros(n - 1, dtype=np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        size, rank = 1 << level, ranks[level]
        fits = (x + common + size <= end[x]) & (y + common + size <= end[y])
        same = rank[np.minimum(x + common, n - 1)] == rank[np.minimum(y + common, n - 1)]
        common += np.where(fits & same, size, 0)
    length, source = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    length[y], source[y] = common, x
    better = common > length[x]
    length[x[better]], source[x[better]] = common[better], y[better]
    cur, found = np.flatnonzero(np.append(True, end[1:] != end[:-1])), []
    while len(cur):
        found.append(cur)
        cur = cur + length[cur]
        cur = cur[(cur < n) & (end[np.minimum(cur, n - 1)] == end[np.maximum(found[-1], 0)])]
    cur = np.sort(np.concatenate(found))
    return at[cur], length[cur], at[source[cur]], first


def window_keys(high: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Window identity from the high 48 bits of its hash and its anchor."""
    with np.errstate(over="ignore"):
        return (high & TOP48) + mix(anchor.astype(np.uint64))


def binaries(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """The high 48 bits of ``values``, so many to a row."""
    packed = np.ascontiguousarray(np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, 2:])
    offsets = (np.append(0, np.cumsum(lengths)) * 6).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(packed.tobytes())])


def singles(key: np.ndarray, high: np.ndarray, names: pa.Array, start: np.ndarray) -> pa.RecordBatch:
    """Windows one by one, dealt out by their own identity."""
    n = len(key)
    spread = mix(key).astype(np.int64)
    columns = [pa.array(spread), names, pa.array(start.astype(np.int32)), pa.array(np.ones(n, np.int32)), binaries(high, np.ones(n, np.int64)), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int32()), pa.array(np.ones(n, bool))]
    return pa.RecordBatch.from_arrays(columns, names=NAMES)


def factor_rows(key: np.ndarray, names: pa.Array, sources: pa.Array, start: np.ndarray, n: np.ndarray, source_start: np.ndarray) -> pa.RecordBatch:
    i32 = lambda x: pa.array(x.astype(np.int32))
    columns = [pa.array(key.astype(np.int64)), names, i32(start), i32(n), pa.nulls(len(n), pa.binary()), sources, i32(source_start), pa.array(np.zeros(len(n), bool))]
    return pa.RecordBatch.from_arrays(columns, names=NAMES)


def phrases(keys: list[bytes], texts: list[np.ndarray], window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> Iterator[pa.RecordBatch]:
    """What a batch of texts (word hashes) sends: its own factors, phrases with new windows, windows and marks of hot anchors."""
    pairs = [(k, t) for k, t in zip(keys, texts, strict=True) if len(t) >= window]
    if not pairs:
        return
    words = np.concatenate([t for _, t in pairs])
    ends = np.cumsum([len(t) for _, t in pairs])
    begins = ends - np.array([len(t) for _, t in pairs])
    inside = np.ones(len(words) - window + 1, dtype=bool)
    for end in ends[:-1]:
        inside[end - window + 1 : end] = False
    starts = np.flatnonzero(inside)
    with np.errstate(over="ignore"):
        grams = mix(gram_hashes(words, gram))
        full = mix(gram_hashes(words, window))[starts]
        ranks = (grams >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | np.arange(len(grams), dtype=np.uint64)
    anchor = (sliding_min(ranks, window - gram + 1)[: len(inside)] & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)[starts]
    names = pa.array([k for k, _ in pairs], pa.binary())
    owner = np.searchsorted(ends, starts, side="right")
    place = starts - begins[owner]
    which, length, source, first = factors(full, owner, place)
    if len(which):
        yield factor_rows(full[which], names.take(pa.array(owner[which])), names.take(pa.array(owner[source])), place[which], length, place[source])
    # A phrase is sent if one of its windows is the first of its kind here; the others' factors are known.
    heads = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
    lengths = np.diff(np.append(heads, len(starts)))
    is_first = np.zeros(len(full), dtype=bool)
    is_first[first] = True
    send = np.add.reduceat(is_first, heads) > 0
    value = grams[anchor[heads]]
    _, group, times = np.unique(value[send], return_inverse=True, return_counts=True)
    burning = np.zeros(len(heads), dtype=bool)
    burning[np.flatnonzero(send)] = times[group] > hot
    cold = send & ~burning
    if cold.any():
        rows, some = heads[cold], np.repeat(cold, lengths)
        n, m = len(rows), lengths[cold]
        columns = [pa.array(value[cold].astype(np.int64)), names.take(pa.array(owner[rows])), pa.array(place[rows].astype(np.int32)), pa.array(m.astype(np.int32)), binaries(full[some], m), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int32()), pa.array(np.zeros(n, bool))]
        yield pa.RecordBatch.from_arrays(columns, names=NAMES)
    if burning.any():
        some = np.flatnonzero(np.repeat(burning, lengths) & is_first)
        own = np.repeat(value, lengths)[some]
        yield singles(window_keys(full[some], own), full[some], names.take(pa.array(owner[some])), place[some])
        marks = np.unique(value[burning]).astype(np.int64)
        n = len(marks)
        yield pa.RecordBatch.from_arrays([pa.array(marks), pa.nulls(n, pa.binary()), *(pa.array(np.zeros(n, np.int32)) for _ in "ab"), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int32()), pa.array(np.zeros(n, bool))], names=NAMES)


def unpacked(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows of phrases: row of each, its start, the high bits of its hash, its identity."""
    lengths = rows["n"].to_numpy().astype(np.int64)
    raw = np.zeros((lengths.sum(), 8), dtype=np.uint8)
    raw[:, 2:] = np.frombuffer(b"".join(rows["windows"].to_pylist()), dtype=np.uint8).reshape(-1, 6)
    row = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + rows["start"].to_numpy().astype(np.int64)[row]
    high = raw.view("<u8").reshape(-1)
    return row, place, high, window_keys(high, rows["anchor"].to_numpy()[row])


def parsed(rows: pa.RecordBatch) -> tuple[pa.RecordBatch | None, np.ndarray]:
    """Factors of the phrases of one or more anchors, and the rows that hold the first of each window."""
    anchors = rows["anchor"].to_numpy()
    _, inverse, counts = np.unique(anchors, return_inverse=True, return_counts=True)
    shared = np.flatnonzero(counts[inverse] >= 2)
    if not len(shared):
        return None, np.arange(len(anchors))
    some = rows.take(pa.array(shared))
    row, place, _, keys = unpacked(some)
    which, length, source, first = factors(keys, row, place)
    found = factor_rows(place[which], some["cls"].take(pa.array(row[which])), some["cls"].take(pa.array(row[source])), place[which], length, place[source])
    return found.select(FACTOR_NAMES), shared[np.unique(row[first])]


def _index_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Phrases in anchor order to factors, as a stream; hot anchors and windows for the second round are left out."""
    carry, burning = None, None
    for batch in batches:
        known = pc.and_(pc.is_null(batch["windows"]), pc.is_valid(batch["cls"]))
        if pc.any(known).as_py():
            yield batch.filter(known).select(FACTOR_NAMES)
        rows, burning = _without_hot(batch, burning)
        if carry is not None and carry.num_rows:
            rows = pa.Table.from_batches([carry, rows]).combine_chunks().to_batches()[0]
        if not rows.num_rows:
            continue
        anchors = rows["anchor"].to_numpy()
        complete = int(np.searchsorted(anchors, anchors[-1]))
        if complete:
            found, _ = parsed(rows.slice(0, complete))
            if found is not None and found.num_rows:
                yield found
        carry = rows.slice(complete)
        if carry.num_rows > CARRY_ROWS:
            found, needed = parsed(carry)
            if found is not None and found.num_rows:
                yield found
            carry = carry.take(pa.array(needed))
    if carry is not None and carry.num_rows:
        found, _ = parsed(carry)
        if found is not None and found.num_rows:
            yield found


def _hot_rows(batch: pa.RecordBatch, burning: int | None) -> tuple[np.ndarray, int | None]:
    """Which rows are phrases of hot anchors, whose marks stand before them, and the last hot anchor."""
    anchors = batch["anchor"].to_numpy()
    marks = anchors[pc.is_null(batch["cls"]).to_numpy(zero_copy_only=False)]
    every = marks if burning is None else np.append(marks, burning)
    phrase = pc.and_(pc.is_valid(batch["windows"]), pc.invert(batch["single"])).to_numpy(zero_copy_only=False)
    return np.isin(anchors, every) & phrase, (int(marks[-1]) if len(marks) else burning)


def _without_hot(batch: pa.RecordBatch, burning: int | None) -> tuple[pa.RecordBatch, int | None]:
    hot, burning = _hot_rows(batch, burning)
    plain = pc.and_(pc.is_valid(batch["windows"]), pc.invert(batch["single"])).to_numpy(zero_copy_only=False)
    return batch.filter(pa.array(plain & ~hot)), burning


def _pass_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For the second round: single windows as they are, and the phrases of hot anchors as single windows."""
    burning = None
    for batch in batches:
        if pc.any(batch["single"]).as_py():
            yield batch.filter(batch["single"])
        hot, burning = _hot_rows(batch, burning)
        if hot.any():
            rows = batch.filter(pa.array(hot))
            row, place, high, keys = unpacked(rows)
            yield singles(keys, high, rows["cls"].take(pa.array(row)), place)


def _second_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Single windows as phrases of one window."""
    return _index_block(b.set_column(7, "single", pa.array(np.zeros(b.num_rows, bool))) for b in batches)


def digested(words: list[bytes], start: int, end: int) -> int:
    return xxhash.xxh3_64_intdigest(b" ".join(words[start:end])) >> 1


def kept_words(text: bytes, copies: int, spans: list[dict] | None, window: int) -> tuple[int, list[bytes]]:
    """Number of words, and the words in no confirmed factor."""
    words = text.split()
    if copies > 1 and len(words) >= window:
        return len(words), []
    if not spans:
        return len(words), words
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    for s in spans:
        end = s["start"] + s["n"] + window - 1
        if digested(words, s["start"], end) == s["digest"]:
            edge[s["start"]] += 1
            edge[end] -= 1
    keep = np.cumsum(edge[:-1]) == 0
    return len(words), [words[i] for i in np.flatnonzero(keep)]


def dedup_substrings(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, with_text: bool = False, hot: int = HOT) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept_text, if asked for), one row per row of ``docs``."""
    bound_batches(docs.sparkSession)
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # Never null, so that no join adds a filter and all uses of ``texts`` share one shuffle.
    keyed = keyed.withColumn("cls", F.coalesce(F.unhex(F.md5("text")), F.lit(b"")))
    texts = keyed.groupBy("cls").agg(F.first("text").alias("text"), F.count("*").alias("copies"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, some, size = [], [], 0
        for batch in batches:
            for key, text in zip(batch["cls"], batch["text"].cast(pa.binary()), strict=True):
                hashes = word_hashes(text.as_py().split())
                keys.append(key.as_py())
                some.append(hashes)
                size += 8 * len(hashes)
                if size > BATCH_BYTES:
                    yield from phrases(keys, some, window, gram, hot)
                    keys, some, size = [], [], 0
        yield from phrases(keys, some, window, gram, hot)

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, asked in zip(batch["text"].cast(pa.binary()), batch["asked"], strict=True):
                words = text.as_py().split()
                out += [(a["cls"], a["start"], a["n"], digested(words, a["source_start"], a["source_start"] + a["n"] + window - 1)) for a in asked.as_py()]
            if out:
                types = (pa.binary(), pa.int32(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), types, strict=True)], names=["cls", "start", "n", "digest"])

    sent = texts.mapInArrow(lambda it: freed(cut(it)), PHRASES).repartition("anchor").sortWithinPartitions("anchor", "n")
    spread = sent.mapInArrow(lambda it: freed(_pass_on(it)), PHRASES).repartition("anchor").sortWithinPartitions("anchor")
    found = sent.mapInArrow(lambda it: freed(_index_block(it)), FACTORS).unionByName(spread.mapInArrow(lambda it: freed(_second_round(it)), FACTORS))
    asked = found.groupBy("source").agg(F.collect_list(F.struct("cls", "start", "n", "source_start")).alias("asked")).withColumnRenamed("source", "cls")
    # With all columns of ``texts``, so that its one shuffle serves here, too.
    spans = texts.join(asked, "cls").select("text", "copies", "asked").mapInArrow(lambda it: freed(confirm(it)), "cls binary, start int, n int, digest long")
    spans = spans.groupBy("cls").agg(F.collect_list(F.struct("start", "n", "digest")).alias("spans"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, text, copies, some in zip(*(batch[c] for c in ("cls", "text", "copies", "spans")), strict=True):
                n, words = kept_words(text.as_py().encode(), copies.as_py(), some.as_py(), window)
                kept = b" ".join(words)
                rows.append((key.as_py(), n, n - len(words), hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None))
            types = (pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, types, strict=True)], names=["cls", "n_words", "n_removed", "kept_sha256", "kept_text"])

    done = texts.join(spans, "cls", "left").mapInArrow(lambda it: freed(keep(it)), "cls binary, n_words long, n_removed long, kept_sha256 string, kept_text string")
    out = keyed.select("doc_id", "cls").join(done, "cls").drop("cls")
    return out if with_text else out.drop("kept_text")
