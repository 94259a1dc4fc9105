"""Token ids in seekable files of independent zstandard frames.

File format, one file per shard, documents in ascending id order:

* data frames: each an independent zstandard frame (with its own content size
  and checksum) of the little-endian unsigned 32-bit ids of whole documents;
* a skippable frame with the document index: id, frame, first id within the
  frame, number of ids, and whether the id is null;
* a skippable frame with the seek table of the public zstandard seekable
  format: for each data frame its compressed size, its raw size and the low 32
  bits of the XXH64 of its raw bytes, then the number of frames and the magic.

A reader takes the footer, then the index, and decompresses only the frames
that hold the documents asked for, each checked against its checksum.

Documents are range-partitioned by id (repeated ids are spread by a hash of the
text), so shards are in order and a task writes one shard as a stream: to a
temporary name first, then moved, so a repeated task leaves one whole file. The
manifest has one row per shard; prefix sums over it give each document's place
among all ids.

Edge cases: a null text is empty and gives the end id alone; null ids come
first; repeated ids stay together, ordered by a hash of their text; an empty
table writes no shard and reads back as an empty result.
"""

from __future__ import annotations

import functools
import os
import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.spans import freed
from tessera.session import bound_batches, shared_path

END_ID = 2
FRAME_BYTES = 64 * 1024
CACHE_PIECES = 100_000

# Where the pre-tokenizer may be cut, for Arrow's regular expressions. Blanks as Unicode has them.
MARK, BLANK = "\x1f", r"\s\v\x{85}\pZ"
UNASSIGNED = r"[^\pL\pN\pM\pP\pS\pZ\pC]"
CUT = rf"[{BLANK}][^{BLANK}\pL\pN]+|[{BLANK}][^{BLANK}]|[^{BLANK}\pL\pN]{{2,}}|[^{BLANK}\pL\pN']"

# Fixed values of the zstandard seekable format.
SKIPPABLE_INDEX, SKIPPABLE_SEEK, SEEK_MAGIC = 0x184D2A5D, 0x184D2A5E, 0x8F92EAB1
CHECKSUM_FLAG = 0x80
ENTRY, FOOTER, HEADER = struct.Struct("<III"), struct.Struct("<IBI"), struct.Struct("<II")
INDEX = struct.Struct("<qIIIB")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Byte-level BPE of whole texts as little-endian 32-bit ids, as the library gives them.

    The pre-tokenizer never joins a letter or digit to a mark after it, nor
    anything to the last blank of a run before a word. So Arrow cuts a batch of
    texts there, in one pass; each distinct piece of the batch is encoded once
    (a single apostrophe, which may start a contraction, stays with its word).
    Pieces seen before come from a cache of two generations. New words, each
    with a space before it, go to the library as one text, and the ids are told
    apart by the tokens that start with a space. Texts with strings of special
    tokens, or characters that the two Unicode tables may class differently,
    are encoded whole.
    """

    def __init__(self, path: str, cache_pieces: int = CACHE_PIECES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; the library would start a thread for each of the machine
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.starts = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.starts[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True
        special = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = "|".join([UNASSIGNED, MARK, *special])
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}  # the generation before; what is used again moves on
        self.cache_pieces = cache_pieces

    def _plain(self, texts: list[str]) -> list[bytes]:
        made = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(m.ids, dtype="<u4").tobytes() for m in made]

    def _learnt(self, pieces: list[str]) -> list[bytes]:
        """The ids of new pieces; words with a space before them are encoded together."""
        words = pc.match_substring_regex(pa.array(pieces, pa.large_string()), rf"\A [^{BLANK}]+\z").to_numpy(zero_copy_only=False).tolist()
        others = iter(self._plain([p for p, word in zip(pieces, words, strict=True) if not word]))
        many = [p for p, word in zip(pieces, words, strict=True) if word]
        groups, told = [many[i : i + 256] for i in range(0, len(many), 256)], []
        for group, one in zip(groups, self.tokenizer.encode_batch_fast(list(map("".join, groups)), add_special_tokens=False), strict=True):
            ids = np.array(one.ids, dtype="<u4")
            cuts = (4 * np.flatnonzero(self.starts[ids])).tolist()
            if len(cuts) == len(group):
                raw = ids.tobytes()
                told += [raw[s:e] for s, e in zip(cuts, [*cuts[1:], len(raw)], strict=True)]
            else:
                told += self._plain(group)
        told = iter(told)
        return [next(told if word else others) for word in words]

    def _known(self, pieces: list[str]) -> list[bytes]:
        if len(self.young) > self.cache_pieces:
            self.young, self.old = {}, self.young
        found = list(map(self.young.get, pieces))
        missing = [p for p, ids in zip(pieces, found, strict=True) if ids is None]
        if missing:
            again = list(map(self.old.get, missing))
            new = [p for p, ids in zip(missing, again, strict=True) if ids is None]
            if new:
                learnt = iter(self._learnt(new))
                again = [next(learnt) if ids is None else ids for ids in again]
            self.young.update(zip(missing, again, strict=True))
            rest = iter(again)
            found = [next(rest) if ids is None else ids for ids in found]
        return found

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text; null texts are empty."""
        texts = texts.cast(pa.large_string()).fill_null("")
        whole = pc.match_substring_regex(texts, self.whole)
        if pc.any(whole).as_py():
            odd, rest = iter(self._plain(texts.filter(whole).to_pylist())), iter(self.encode(texts.filter(pc.invert(whole))))
            return [next(odd if w else rest) for w in whole.to_pylist()]
        parts = pc.split_pattern(pc.replace_substring_regex(texts, CUT, f"{MARK}\\0"), MARK)
        coded = parts.values.dictionary_encode()
        found = self._known(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        pool, begin = np.frombuffer(b"".join(found), dtype="<u4"), np.cumsum(size) - size
        which = coded.indices.to_numpy()
        n = size[which]
        ends = np.cumsum(n)
        raw = pool[np.repeat(begin[which] - ends + n, n) + np.arange(n.sum())].tobytes()
        bounds = (4 * np.append(0, ends)[parts.offsets.to_numpy()]).tolist()
        return [raw[s:e] for s, e in zip(bounds, bounds[1:], strict=False)]


@functools.lru_cache(maxsize=2)
def encoder_for(path: str) -> Encoder:
    """One encoder per Python worker, so its cache serves all tasks of the worker."""
    return Encoder(path)


class FrameWriter:
    """Writes one shard to a binary stream."""

    def __init__(self, out, frame_bytes: int = FRAME_BYTES):
        self.out, self.frame_bytes = out, frame_bytes
        self.packer = zstandard.ZstdCompressor(level=3, write_checksum=True, write_content_size=True)
        self.waiting: list[bytes] = []
        self.raw = self.n_tokens = 0
        self.seek: list[bytes] = []
        self.index: list[bytes] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if self.waiting and self.raw + len(ids) > self.frame_bytes:  # a long document has a frame of its own
            self._flush()
        self.index.append(INDEX.pack(doc_id or 0, len(self.seek), self.raw // 4, len(ids) // 4, doc_id is None))
        self.waiting.append(ids)
        self.raw += len(ids)
        self.n_tokens += len(ids) // 4
        if self.raw >= self.frame_bytes:
            self._flush()

    def _flush(self) -> None:
        raw = b"".join(self.waiting)
        frame = self.packer.compress(raw)
        self.out.write(frame)
        self.seek.append(ENTRY.pack(len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.waiting, self.raw = [], 0

    def close(self) -> None:
        if self.waiting:
            self._flush()
        index = self.packer.compress(b"".join(self.index))
        self.out.write(HEADER.pack(SKIPPABLE_INDEX, len(index)) + index)
        table = b"".join(self.seek) + FOOTER.pack(len(self.seek), CHECKSUM_FLAG, SEEK_MAGIC)
        self.out.write(HEADER.pack(SKIPPABLE_SEEK, len(table)) + table)


class FrameReader:
    """Reads documents of one shard from a seekable stream; decompresses only frames that are asked for."""

    def __init__(self, stream):
        self.stream = stream
        self.unpacker = zstandard.ZstdDecompressor()
        size = stream.seek(0, 2)
        size = stream.tell() if size is None else size
        frames, flag, magic = FOOTER.unpack(self._at(size - FOOTER.size, FOOTER.size))
        if magic != SEEK_MAGIC or not flag & CHECKSUM_FLAG:
            raise ValueError("no seek table with checksums at the end of the file")
        table = self._at(size - FOOTER.size - frames * ENTRY.size, frames * ENTRY.size)
        self.frames, at = [], 0
        for packed, raw, check in ENTRY.iter_unpack(table):
            self.frames.append((at, packed, raw, check))
            at += packed
        kind, length = HEADER.unpack(self._at(at, HEADER.size))
        if kind != SKIPPABLE_INDEX:
            raise ValueError("no document index after the last frame")
        index = self.unpacker.decompress(self._at(at + HEADER.size, length))
        self.documents = [(None if null else doc_id, frame, start, n) for doc_id, frame, start, n, null in INDEX.iter_unpack(index)]

    def _at(self, start: int, length: int) -> bytes:
        self.stream.seek(start)
        return self.stream.read(length)

    def frame(self, number: int) -> bytes:
        at, packed, size, check = self.frames[number]
        raw = self.unpacker.decompress(self._at(at, packed), max_output_size=size)
        if len(raw) != size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {number} does not match its checksum")
        return raw

    def read(self, wanted: Iterable[int | None] | None = None) -> Iterator[tuple[int | None, int, bytes]]:
        """(id, place of its first token in the shard, ids) of the documents asked for, or of all."""
        wanted, now, raw, place = None if wanted is None else set(wanted), None, b"", 0
        for doc_id, frame, start, n in self.documents:
            if wanted is None or doc_id in wanted:
                if frame != now:
                    now, raw = frame, self.frame(frame)
                yield doc_id, place, raw[4 * start : 4 * (start + n)]
            place += n


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


MANIFEST = "shard int, path string, n_docs long, n_tokens long"


def write_token_frames(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = END_ID, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """Write all documents below ``folder`` (a URI that all executors reach), and the manifest of the shards, which is returned."""
    tokenizer, ending = tokenizer or default_tokenizer(), struct.pack("<I", end_id)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        shard, path = task.partitionId(), ""
        store, base = _open(folder)
        writer, encoder, out, n_docs, part = None, None, None, 0, ""
        for batch in batches:
            if writer is None:
                store.create_dir(base, recursive=True)
                path = f"{base}/shard-{shard:06d}.zst"
                part = f"{base}/_part-{shard:06d}-{task.taskAttemptId()}"
                out = store.open_output_stream(part)
                writer, encoder = FrameWriter(out, frame_bytes), encoder_for(tokenizer)
            for doc_id, coded in zip(batch["doc_id"].to_pylist(), encoder.encode(batch["text"]), strict=True):
                writer.add(doc_id, coded + ending)
            n_docs += batch.num_rows
        if writer is not None:
            writer.close()
            out.close()
            store.move(part, path)
            row = [[shard], [f"{folder}/shard-{shard:06d}.zst"], [n_docs], [writer.n_tokens]]
            types = [pa.int32(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types, strict=True)], names=["shard", "path", "n_docs", "n_tokens"])

    bound_batches(docs.sparkSession)
    ordered = docs.select("doc_id", "text", F.xxhash64("text").alias("_tie")).repartitionByRange(F.col("doc_id").asc_nulls_first(), F.col("_tie"))
    ordered = ordered.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "_tie").select("doc_id", "text")
    ordered.mapInArrow(lambda it: freed(write(it)), MANIFEST).write.mode("overwrite").parquet(f"{folder}/manifest.parquet")
    return token_manifest(docs.sparkSession, folder)


def token_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest of what was written below ``folder``: a row per shard, with its path and counts."""
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest.parquet")


def read_token_frames(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """doc_id, start (among the ids of all documents), n_tokens and crc32 of the ids, from the files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(batch["path"].to_pylist(), batch["first"].to_pylist(), strict=True):
                store, inside = _open(path)
                with store.open_input_file(inside) as stream:
                    rows = [(doc_id, first + place, len(ids) // 4, zlib.crc32(ids)) for doc_id, place, ids in FrameReader(stream).read()]
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("first", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).select("path", "first")
    shards = max(1, min(manifest.count(), 20_000))
    return placed.repartition(shards).mapInArrow(lambda it: freed(read(it)), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_frames(docs: DataFrame, tokenizer: str | None = None, folder: str | None = None) -> DataFrame:
    """Write all documents in the format, then describe each from the files."""
    spark = docs.sparkSession
    return read_token_frames(spark, write_token_frames(docs, folder or shared_path(spark, "token-frames"), tokenizer))
