"""N-gram Jaccard join with adaptive multi-match prefixes.

A text's set is its distinct word shingles. Texts with equal sets are one class.
Two classes link when intersection over union reaches the threshold; the result
is exact, up to 56-bit shingle hashes: two texts of 500 shingles each have two
different ones alike with a chance of 4e-12, and then seem to share one more.

1. *Frequencies.* Shingles are packed by hash bucket, as arrays, and counted
   exactly. A batch sends each shingle once, with its class, or with how many
   of its classes have it; so a shingle that all texts have costs its bucket
   one entry per batch. A shingle of one class only can never match, so just
   the shared ones go on, each with a logarithm of its frequency in its top
   bits: sorting a set then sorts it from rare to frequent. Sets whose shared
   part is too small to reach the threshold with anything are done.
2. *Prefixes.* With overlap at least t needed, two sets share l of the first
   n - t + l shingles in that order. For each set, l is chosen by estimated cost:
   a longer prefix scans more of the index but asks for more shared prefix
   shingles, so fewer candidates are verified. A pair must share the smaller of
   its two l.
3. *Hubs.* Links within large groups of near copies would be quadratic in
   number. So each set is first verified against the most central set among
   those with which it shares prefix shingles, a linear number of pairs; their
   components are found.
4. *Rest.* Prefixes are joined for pairs in different components only, and only
   at a shingle that can be the last one shared within both prefixes, given how
   much overlap the sizes ask for. Those with enough shared prefix shingles are
   verified. No link between components is missed, and a link inside one would
   not change it.

Edge cases: a null or empty text has an empty set and is linked with nothing; a
text of fewer words than a shingle is one shingle, its whole sequence; ids may
be null (a component of null ids only has a null id) or repeated; equal texts
are one class however often they occur; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.llm.spans import freed
from tessera.session import bound_batches, materialize, scratch

MAX_MATCH, VERIFY_COST = 6, 0.1
BATCH_BYTES, BATCH_DOCS, BUCKET_BYTES, HELD = 6_000_000, 100_000, 6_000_000, 500_000
LOW = 48
#: In place of a class: several of the batch; so many of such shingles go together.
APART = 16_384
SEVERAL = np.uint16(0xFFFF)
#: Schemas, for ids of any type.
PACKED = "bucket int, batch long, idx int, cls binary, n int, doc_ids array<{}>, packed binary"
PARTS = "batch long, idx int, cls binary, n int, doc_ids array<{}>, packed binary"
SETS = "cls binary, n int, doc_ids array<{}>, tokens array<long>"
PREFIXES = "cls binary, need int, s0 long, s1 long, prefix array<long>"


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: bytes, k: int) -> np.ndarray:
    """Sorted distinct 56-bit hashes of the text's shingles."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    width = min(k, len(words))
    n = len(words) - width + 1
    rolled = np.full(n, width, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):
            rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + n]
    return np.unique(mix(rolled) >> np.uint64(8))


def _pack(batch: int, keys: dict[bytes, int], docs: list[list], sets: list[np.ndarray], bits: int, id_type: pa.DataType) -> pa.RecordBatch:
    """One row per class of the batch, one per bucket with the batch's shingles in it, and some with the classes of those that several have."""
    counts = [len(s) for s in sets]
    tokens = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets), dtype=np.uint16), counts)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    heads = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1])) if len(tokens) else np.zeros(0, dtype=np.int64)
    having = np.diff(np.append(heads, len(tokens)))
    several = having > 1
    apart = owner[np.repeat(several, having)]
    named = np.where(several, SEVERAL, owner[heads])
    tokens = tokens[heads]
    bucket = (tokens >> np.uint64(56 - bits)).astype(np.int32)
    cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, dtype=np.int64)
    low = np.ascontiguousarray(tokens & np.uint64((1 << LOW) - 1)).view(np.uint8).reshape(-1, 8)[:, :6]
    packed = []
    for i, j in zip(cuts, np.append(cuts[1:], len(tokens)), strict=False):
        packed.append(np.uint32(j - i).tobytes() + named[i:j].tobytes() + low[i:j].tobytes() + having[i:j][several[i:j]].astype(np.uint32).tobytes())
    shared, times = tokens[several], having[several].astype(np.uint32)
    ends, k = np.cumsum(times), 0
    for i in range(0, len(shared), APART):
        j = min(i + APART, len(shared))
        packed.append(np.uint32(j - i).tobytes() + shared[i:j].tobytes() + times[i:j].tobytes() + apart[ends[i] - times[i] : ends[j - 1]].tobytes())
        k += 1
    n, m = len(keys), len(packed)
    # Rows that only pass through go to any bucket, the same ones if the task runs again.
    spread = (np.arange(n + k) + 977 * batch) % (1 << bits)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate([spread[:n], bucket[cuts], spread[n:]]).astype(np.int32)),
            pa.array(np.full(n + m, batch, dtype=np.int64)),
            pa.array(np.concatenate([np.arange(n), np.full(m - k, -1), np.full(k, -2)]).astype(np.int32)),
            pa.array([*keys, *[None] * m], pa.binary()),
            pa.array([*counts, *[None] * m], pa.int32()),
            pa.array([*docs, *[None] * m], pa.list_(id_type)),
            pa.array([*[None] * n, *packed], pa.binary()),
        ],
        names=["bucket", "batch", "idx", "cls", "n", "doc_ids", "packed"],
    )


def _shingled(batches: Iterator[pa.RecordBatch], k: int, bits: int) -> Iterator[pa.RecordBatch]:
    keys, docs, sets, size, rows = {}, [], [], 0, 0
    # Numbered by task and flush: equal texts in two tasks must not share a number, and a task run again repeats its own.
    number = TaskContext.get().partitionId() << 32
    id_type = pa.int64()
    for batch in batches:
        id_type = batch.schema.field("doc_id").type
        for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].cast(pa.binary()).to_pylist(), strict=True):
            tokens = shingle_set(text or b"", k)
            key = xxhash.xxh3_128_digest(tokens.tobytes())
            rows += 1
            if key in keys:
                docs[keys[key]].append(doc_id)
            else:
                keys[key] = len(keys)
                docs.append([doc_id])
                sets.append(tokens)
                size += 8 * len(tokens)
            if size > BATCH_BYTES or len(keys) >= 65_000 or rows >= BATCH_DOCS:
                yield _pack(number, keys, docs, sets, bits, id_type)
                keys, docs, sets, size, rows, number = {}, [], [], 0, 0, number + 1
    if keys:
        yield _pack(number, keys, docs, sets, bits, id_type)


def _shared(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Bucket by bucket: shingles that occur in more than one set, with their frequency, by class of the batch."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    now, rows, ids_type = None, [], pa.list_(pa.int64())

    def counted() -> None:
        if len(rows) == 0:
            return
        sizes = [int(np.frombuffer(p, dtype=np.uint32, count=1)[0]) for _, p in rows]
        owner = np.concatenate([np.frombuffer(p, dtype=np.uint16, count=s, offset=4) for (_, p), s in zip(rows, sizes, strict=True)])
        raw = np.zeros((len(owner), 8), dtype=np.uint8)
        raw[:, :6] = np.concatenate([np.frombuffer(p, dtype=np.uint8, count=6 * s, offset=4 + 2 * s).reshape(-1, 6) for (_, p), s in zip(rows, sizes, strict=True)])
        low = raw.view("<u8").reshape(-1)
        weight = np.ones(len(owner))
        weight[owner == SEVERAL] = np.concatenate([np.frombuffer(p, dtype=np.uint32, offset=4 + 8 * s) for (_, p), s in zip(rows, sizes, strict=True)])
        batch = np.repeat(np.array([b for b, _ in rows], dtype=np.int64), sizes)
        _, inverse = np.unique(low, return_inverse=True)
        df = np.bincount(inverse, weight)[inverse]
        keep = np.flatnonzero(df >= 2)
        if len(keep):
            rank = np.minimum(127, np.floor(4 * np.log2(df[keep]))).astype(np.int64)
            # The low 48 bits hold all but the bucket's bits of a token when a bucket has eight bits or more.
            token = (np.int64(now) << (56 - bits)) | (low[keep].astype(np.int64) & ((1 << (56 - bits)) - 1))
            held.append((batch[keep], owner[keep], (rank << 56) | token))

    def flushed() -> pa.RecordBatch | None:
        """One row per batch: owners and shared shingles found so far."""
        if not held:
            return None
        batch, owner, token = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        order = np.argsort(batch, kind="stable")
        batch, owner, token = batch[order], owner[order], token[order]
        cuts = np.flatnonzero(np.append(True, batch[1:] != batch[:-1]))
        packed = [owner[i:j].tobytes() + token[i:j].tobytes() for i, j in zip(cuts, np.append(cuts[1:], len(token)), strict=True)]
        n = len(cuts)
        return pa.RecordBatch.from_arrays(
            [pa.array(batch[cuts]), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, ids_type), pa.array(packed, pa.binary())],
            names=["batch", "idx", "cls", "n", "doc_ids", "packed"],
        )

    for b in batches:
        ids_type = b.schema.field("doc_ids").type
        passing = pc.not_equal(b["idx"], -1)  # classes, and the owners of what several have, only pass through
        if pc.any(passing).as_py():
            yield b.filter(passing).select(["batch", "idx", "cls", "n", "doc_ids", "packed"])
        rest = b.filter(pc.invert(passing))
        for bucket, batch, packed in zip(rest["bucket"].to_pylist(), rest["batch"].to_pylist(), rest["packed"].to_pylist(), strict=True):
            if bucket != now:
                counted()
                now, rows = bucket, []
                if sum(len(t) for _, _, t in held) > HELD and (made := flushed()) is not None:
                    yield made
            rows.append((batch, packed))
    counted()
    if (made := flushed()) is not None:
        yield made


def _assembled(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Parts in batch order to one row per class; sets that can't reach the threshold with anything keep no shingles."""

    def done(classes: list[dict], parts: list[bytes], apart: list[bytes]) -> pa.RecordBatch:
        classes = sorted(classes, key=lambda c: c["idx"])
        if [c["idx"] for c in classes] != list(range(len(classes))):
            raise RuntimeError(f"batch {now} repeats or lacks classes: was it packed twice from rows in another order?")
        sizes = [len(p) // 10 for p in parts]
        owner = np.concatenate([np.frombuffer(p, dtype=np.uint16, count=k) for p, k in zip(parts, sizes, strict=True)]) if parts else np.zeros(0, np.uint16)
        token = np.concatenate([np.frombuffer(p[2 * k :], dtype=np.int64) for p, k in zip(parts, sizes, strict=True)]) if parts else np.zeros(0, np.int64)
        several, mask = owner == SEVERAL, (1 << 56) - 1
        ranked = token[several]
        ranked = ranked[np.argsort(ranked & mask)]
        heads = [int(np.frombuffer(p, dtype=np.uint32, count=1)[0]) for p in apart]
        named = np.concatenate([np.zeros(0, np.int64), *[np.frombuffer(p, dtype=np.int64, count=m, offset=4) for p, m in zip(apart, heads, strict=True)]])
        having = np.concatenate([np.zeros(0, np.uint32), *[np.frombuffer(p, dtype=np.uint32, count=m, offset=4 + 8 * m) for p, m in zip(apart, heads, strict=True)]])
        who = np.concatenate([np.zeros(0, np.uint16), *[np.frombuffer(p, dtype=np.uint16, offset=4 + 12 * m) for p, m in zip(apart, heads, strict=True)]])
        order = np.argsort(named, kind="stable")
        if not np.array_equal(ranked & mask, named[order]):
            raise RuntimeError(f"batch {now} lacks shingles that several of its classes have")
        rank = np.empty_like(named)
        rank[order] = ranked
        owner, token = np.append(owner[~several], who), np.append(token[~several], np.repeat(rank, having))
        if len(owner) and owner.max() >= len(classes):
            raise RuntimeError(f"batch {now} has shingles of classes that it lacks")
        order = np.lexsort((token, owner))
        owner, token = owner[order], token[order]
        bounds = np.searchsorted(owner, np.arange(len(classes) + 1))
        sets = [token[i:j] if 0 < 100 * (j - i) >= percent * c["n"] else None for c, i, j in zip(classes, bounds, bounds[1:], strict=False)]
        return pa.RecordBatch.from_arrays(
            [pa.array([c["cls"] for c in classes], pa.binary()), pa.array([c["n"] for c in classes], pa.int32()), pa.array([c["doc_ids"] for c in classes], ids_type), pa.array(sets, pa.list_(pa.int64()))],
            names=["cls", "n", "doc_ids", "tokens"],
        )

    now, classes, parts, apart, ids_type = None, [], [], [], pa.list_(pa.int64())
    for b in batches:
        packed, ids_type = b["packed"], b.schema.field("doc_ids").type
        for i, (batch, idx) in enumerate(zip(b["batch"].to_pylist(), b["idx"].to_pylist(), strict=True)):
            if batch != now and (classes or parts or apart):
                yield done(classes, parts, apart)
                classes, parts, apart = [], [], []
            now = batch
            if idx == -2:
                apart.append(packed[i].as_py())
            elif packed[i].is_valid:
                parts.append(packed[i].as_py())
            else:
                classes.append({c: b[c][i].as_py() for c in ("idx", "cls", "n", "doc_ids")})
    if classes or parts or apart:
        yield done(classes, parts, apart)


def class_sets(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """cls, n, doc_ids and tokens (shared shingles, rare ones first; null where too few to link), per class and batch."""
    bound_batches(docs.sparkSession)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(10, (int(total) // BUCKET_BYTES).bit_length())
    kind = docs.schema["doc_id"].dataType.simpleString()
    packed = docs.select("doc_id", "text").mapInArrow(lambda it: freed(_shingled(it, k, bits)), PACKED.format(kind))
    parts = packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lambda it: freed(_shared(it, bits)), PARTS.format(kind))
    sets = parts.repartition("batch").sortWithinPartitions("batch").mapInArrow(lambda it: freed(_assembled(it, percent)), SETS.format(kind))
    return materialize(sets, "shingle-sets")


def choose_need(df: np.ndarray, m: int, t: int, n: int, max_match: int = MAX_MATCH) -> int:
    """How many shared prefix shingles to ask for: the cheapest by estimated scan and verification cost."""
    reach = np.cumsum(df - 1)
    best, cost = 1, np.inf
    for need in range(1, min(max_match, t) + 1):
        scanned = reach[min(m, m - t + need) - 1]
        total = scanned * (1 + VERIFY_COST * n / need)
        if total < cost:
            best, cost = need, total
    return best


def _prefixes(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Prefix of each set, the matches it asks for, and 128 bits of signature: a bit for each shingle of the prefix."""
    for batch in batches:
        needs, prefixes = [], []
        signs = np.zeros((batch.num_rows, 2), dtype=np.uint64)
        for i, (n, tokens) in enumerate(zip(batch["n"].to_pylist(), batch["tokens"], strict=True)):
            tokens = tokens.values.to_numpy()
            m, t = len(tokens), -(-percent * n // 100)
            needs.append(choose_need(2.0 ** ((tokens >> 56) / 4), m, t, n))
            prefix = tokens[: min(m, m - t + needs[-1])]
            prefixes.append(prefix)
            np.bitwise_or.at(signs[i], (prefix >> 6) & 1, np.uint64(1) << (prefix & 63).astype(np.uint64))
        columns = [batch["cls"], pa.array(needs, pa.int32()), *(pa.array(signs[:, k].astype(np.int64)) for k in (0, 1)), pa.array(prefixes, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["cls", "need", "s0", "s1", "prefix"])


def verified(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sets reach the threshold."""
    left = classes.select(F.col("cls").alias("a"), F.col("n").alias("n_a"), F.col("tokens").alias("t_a"))
    right = classes.select(F.col("cls").alias("b"), F.col("n").alias("n_b"), F.col("tokens").alias("t_b"))
    both = pairs.join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("t_a", "t_b")).cast("long")
    return both.filter((100 + percent) * shared >= percent * (F.col("n_a") + F.col("n_b"))).select("a", "b")


def links(classes: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Verified links that connect all components, and the components' (node, root)."""
    prefixes = materialize(classes.mapInArrow(lambda it: freed(_prefixes(it, percent)), PREFIXES), "prefixes")
    with scratch(classes.sparkSession) as result:  # postings go once they have their roots
        sized = classes.select("cls", "n", F.size("tokens").alias("m"))
        ends = prefixes.withColumns({"length": F.size("prefix"), "last": F.element_at("prefix", -1)})
        postings = ends.select("cls", "length", "last", "s0", "s1", F.posexplode("prefix").alias("pos", "token")).join(sized, "cls")
        postings = materialize(postings, "postings")
        hubs = postings.groupBy("token").agg(F.min(F.struct(F.col("n") - F.col("m"), "cls"))["cls"].alias("hub"), F.count("*").alias("df"))
        met = postings.join(hubs.filter("df > 1"), "token").filter("cls <> hub").groupBy("cls", "hub").agg(F.count("*").alias("shared"))
        nearest = met.groupBy("cls").agg(F.max(F.struct("shared", "hub"))["hub"].alias("hub"))
        found = result(verified(nearest.select(F.col("cls").alias("a"), F.col("hub").alias("b")), classes, percent), "hub-links")
        roots = components(found)
        placed = postings.join(roots, F.col("cls") == F.col("node"), "left").withColumn("root", F.coalesce("root", "cls")).drop("node")
        placed = result(placed, "placed-postings")
    open_tokens = placed.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("token")
    some = materialize(placed.join(open_tokens, "token"), "open-postings")
    most = some.groupBy("token", "root").agg(F.count("*").alias("k")).groupBy("token").agg(F.max_by("root", F.struct("k", "root")).alias("most"))
    some = materialize(some.join(most, "token"), "open-postings")
    x, y = some.filter("root <> most").alias("x"), some.alias("y")
    # Overlap to be reached, and what the set whose prefix ends first can still share after its prefix: the rest has
    # to be shared within the prefixes, so the last shingle shared there stands at least that far in both.
    asked = f"{percent} * (x.n + y.n)"
    after = "if(x.last <= y.last, x.m - x.length, y.m - y.length)"
    able = f"x.token = y.token AND x.root <> y.root AND (y.root = y.most OR x.cls < y.cls) AND 100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)"
    able += f" AND {100 + percent} * (least(x.pos, y.pos) + 1 + {after}) >= {asked}"
    able += f" AND {100 + percent} * (least(x.pos, y.pos) + 1 + least(x.m - x.pos - 1, y.m - y.pos - 1)) >= {asked}"
    # A bit that only one signature has is a shingle that only that prefix has.
    only = "{0}.length - bit_count({0}.s0 & ~{1}.s0) - bit_count({0}.s1 & ~{1}.s1)"
    able += f" AND {100 + percent} * (least({only.format('x', 'y')}, {only.format('y', 'x')}) + {after}) >= {asked}"
    pairs = x.join(y, F.expr(able)).select(F.expr("least(x.cls, y.cls)").alias("a"), F.expr("greatest(x.cls, y.cls)").alias("b")).distinct()
    rest = verified(multi_matched(materialize(pairs, "candidates"), prefixes), classes, percent)
    every = materialize(found.union(rest), "links")
    return every, components(every)


def multi_matched(pairs: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Pairs that share as many prefix shingles as the smaller of their two asks."""
    left = prefixes.select(F.col("cls").alias("a"), F.col("need").alias("need_a"), F.col("prefix").alias("p_a"))
    right = prefixes.select(F.col("cls").alias("b"), F.col("need").alias("need_b"), F.col("prefix").alias("p_b"))
    both = pairs.join(left, "a").join(right, "b")
    return both.filter(F.size(F.array_intersect("p_a", "p_b")) >= F.least("need_a", "need_b")).select("a", "b")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest id reachable by links, one row per row of ``docs``."""
    with scratch(docs.sparkSession) as result:
        sets = class_sets(docs, k, percent)
        eligible = sets.filter("tokens IS NOT NULL").groupBy("cls").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens"))
        _, roots = links(materialize(eligible, "classes"), percent)
        own = materialize(sets.filter("n > 0").groupBy("cls").agg(F.min(F.array_min("doc_ids")).alias("own_id")), "class-ids")
        linked = materialize(own.join(roots, F.col("cls") == F.col("node")).select("cls", "root", "own_id"), "linked-classes")
        # Written before they are joined, so that a component or class with very many rows can be split.
        least = materialize(linked.groupBy("root").agg(F.min("own_id").alias("least_id")), "least-ids")
        linked = linked.join(least, "root").select("cls", "least_id")
        placed = materialize(own.join(linked, "cls", "left").select("cls", F.coalesce("least_id", "own_id").alias("least_id")), "placed-classes")
        rows = sets.select("cls", "n", "doc_ids").join(placed, "cls", "left").select("n", "least_id", F.explode("doc_ids").alias("doc_id"))
        component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("least_id"))
        return result(rows.select("doc_id", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id")), "components")


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component: the smallest id, then the smallest row key; a null id only if there is no other.

    Rows are told apart by 128 bits of hash of all their values (maps left out),
    so ids may be repeated or null, and rows equal in all values are one. Rows
    without words are linked with nothing and all stay; an empty table gives an
    empty result. Rows are carried as one struct, so columns may have any name.
    ``docs`` is read several times and has to give the same rows.
    """
    names = [f.name for f in docs.schema if "map<" not in f.dataType.simpleString()]
    # A null leaves the hash as it is, so each value goes with whether it is null.
    values = [x for c in names for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))]
    key = F.unhex(F.format_string("%016x%016x", F.xxhash64(*values), F.xxhash64(F.lit("second"), *values)))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key.alias("key"), "text", F.col("doc_id").alias("id"))
    has_words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    worded = keyed.filter(has_words)
    found = near_duplicates(worded.select(F.col("key").alias("doc_id"), "text"), k, percent).select(F.col("doc_id").alias("key"), "component_id").distinct()
    order = F.struct(F.col("id").isNull(), "id", "key")
    kept = found.join(worded.select("id", "key"), "key").groupBy("component_id").agg(F.min(order)["key"].alias("key")).select("key")
    one = worded.select("row", "key").join(kept, "key", "left_semi").dropDuplicates(["key"]).select("row")
    return one.unionByName(keyed.filter(~has_words).select("row")).select("row.*")
