"""Exact dedup of batches against immutable snapshots, screened by static binary-fuse filters.

Texts are equal when they are identical after each run of white space is
replaced by one space. A snapshot is written once: its exact buckets, one row
per text (SHA-256 digest, smallest id, number of rows), and one binary-fuse
filter per bucket. For a new batch:

1. *New-batch duplicates* are grouped by digest, with partial sums, so a group
   of any size is a row per task before it is shuffled.
2. *Screening.* Each digest of the batch goes to its bucket and is tested
   against the filters of all earlier snapshots there. Most new texts end here.
3. *Exact buckets.* Only positives are joined with the snapshots' digests; a
   false positive finds nothing. The rest of the batch is the next snapshot.
4. *Byte checks.* The texts of all groups of two or more rows, from whatever
   snapshot, are compared byte by byte: per group the smallest and the largest
   text, found with partial aggregation, have to be one. Two texts with one
   digest raise an error, as nothing that names texts by digest could hold them.

The result does not depend on how the rows are dealt to batches.

Edge cases: a null text counts as empty; empty texts are a group like any other;
the row with the smallest id stays, a null id only where the group has no other;
of rows equal in id and text just one stays; an empty table gives an empty
result. Only id and text are read, so other columns may have any name. Texts
are hashed in the JVM and shuffled once, for the byte checks. Buckets hold about ``KEYS`` digests, which bounds a filter's memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.fuse_filter import build, may_contain
from tessera.llm.repeats import repeat_rows
from tessera.session import materialize, scratch

#: Digests in a bucket, and the fewest buckets of a snapshot.
KEYS, BUCKETS = 200_000, 16


def normalised(text: Column) -> Column:
    """The text with one space for each run of white space; empty for null."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def sha256(text: Column) -> Column:
    """SHA-256 of the UTF-8 bytes, as 32 bytes."""
    return F.unhex(F.sha2(text, 256))


@dataclass(frozen=True)
class Snapshot:
    """Written tables: ``buckets`` (digest, keep_id, n) and ``filters`` (bucket, filter) of ``parts`` buckets."""

    buckets: DataFrame
    filters: DataFrame
    parts: int


def _keyed(digests: DataFrame, parts: int) -> DataFrame:
    """key, the 64 bits that filters know a digest by, and bucket."""
    key = F.xxhash64("digest")
    return digests.withColumn("key", key).withColumn("bucket", F.pmod(F.shiftrightunsigned(key, 32), F.lit(parts)).cast("int"))


def _filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (bucket, key) to one filter per bucket."""
    now, held = None, []

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([build(np.concatenate(held))], pa.binary())], names=["bucket", "filter"])

    for batch in batches:
        buckets, keys = batch["bucket"].to_numpy(), batch["key"].to_numpy()
        cuts = np.flatnonzero(np.append(True, buckets[1:] != buckets[:-1]))
        for i, j in zip(cuts, np.append(cuts[1:], len(buckets)), strict=True):
            if j > i and buckets[i] != now:
                if held:
                    yield made()
                now, held = int(buckets[i]), []
            held.append(keys[i:j])
    if held:
        yield made()


def snapshot(groups: DataFrame, parts: int) -> Snapshot:
    """An immutable snapshot of (digest, keep_id, n): exact buckets and their filters, both written."""
    buckets = materialize(groups, "dedup-buckets")
    keys = _keyed(buckets.select("digest"), parts).select("bucket", "key")
    filters = keys.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_filters, "bucket int, filter binary")
    return Snapshot(buckets, materialize(filters, "dedup-filters"), parts)


def _screened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per bucket, filters first, then digests: those that some filter may hold."""
    now, filters = None, []
    for batch in batches:
        buckets = batch["bucket"].to_numpy()
        cuts = np.flatnonzero(np.append(True, buckets[1:] != buckets[:-1]))
        for i, j in zip(cuts, np.append(cuts[1:], len(buckets)), strict=True):
            if j == i:
                continue
            part = batch.slice(i, j - i)
            if buckets[i] != now:
                now, filters = buckets[i], []
            filters += part["filter"].drop_null().to_pylist()
            asked = part.filter(pc.is_valid(part["digest"]))
            if asked.num_rows and filters:
                keys = asked["key"].to_numpy()
                hit = np.logical_or.reduce([may_contain(f, keys) for f in filters])
                if hit.any():
                    yield asked.filter(pa.array(hit)).select(["digest"])


def screen(digests: DataFrame, snapshots: list[Snapshot]) -> DataFrame:
    """The digests, each given once, that some snapshot may hold; all that one does hold are among them."""
    parts = {s.parts for s in snapshots}
    if len(parts) != 1:
        raise ValueError("snapshots have to be of the same number of buckets")
    asked = _keyed(digests.select("digest"), parts.pop()).select("bucket", F.lit(None).cast("binary").alias("filter"), "digest", "key")
    for s in snapshots:
        asked = asked.unionByName(s.filters, allowMissingColumns=True)
    order = [F.col("bucket"), F.col("digest").isNotNull()]
    return asked.repartition("bucket").sortWithinPartitions(*order).mapInArrow(_screened, "digest binary")


def split_batch(groups: DataFrame, snapshots: list[Snapshot]) -> tuple[DataFrame, DataFrame]:
    """Groups of a batch (digest, keep_id, n): those whose text a snapshot has, and the new ones."""
    if not snapshots:
        return groups.limit(0), groups
    held = snapshots[0].buckets.select("digest")
    for s in snapshots[1:]:
        held = held.union(s.buckets.select("digest"))
    found = materialize(screen(groups, snapshots).join(held, "digest", "left_semi"), "dedup-found")
    return groups.join(found, "digest", "left_semi"), groups.join(found, "digest", "left_anti")


def check_bytes(texts: DataFrame, digests: DataFrame) -> DataFrame:
    """(digest, text) rows of the given digests, compared: one row per digest; raises where two texts share one.

    The texts in question are written before they are grouped, so a join
    partition that one group fills can be split, and the group is then a row
    per task. The join is a merge at every size: no plan depends on how few
    groups there are.
    """
    asked = materialize(texts.join(digests.hint("merge"), "digest", "left_semi"), "dedup-texts")
    ends = asked.groupBy("digest").agg(F.min("text").alias("a"), F.max("text").alias("b"))
    alike = F.when(F.col("a") == F.col("b"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("two texts have the digest "), F.hex("digest"))).cast("boolean"))
    return ends.select("digest", alike.alias("alike"))


def dedup(docs: DataFrame, batches: int = 3, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per row of ``docs``.

    ``docs`` is taken as ``batches`` successive batches by ranges of its ids,
    each screened against the snapshots of those before.
    """
    texts = docs.select("doc_id", normalised(F.col("text")).alias("text"))
    texts = texts.withColumn("digest", digest(F.col("text")))
    with scratch(docs.sparkSession) as result:
        steps = [i / batches for i in range(1, batches)]
        bounds = (docs.agg(F.percentile_approx("doc_id", steps)).first()[0] if steps else None) or []
        later = [(F.col("doc_id") > b).cast("int") for b in bounds]
        number = F.coalesce(sum(later, F.lit(0)), F.lit(batches - 1))  # a null id comes last
        rows = materialize(texts.groupBy("digest", "doc_id").agg(F.count("*").alias("copies")).withColumn("batch", number), "dedup-rows")
        parts = max(BUCKETS, -(-rows.count() // (batches * KEYS)))
        snapshots, repeated = [], []
        for b in range(batches):
            groups = rows.filter(F.col("batch") == b).groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.sum("copies").alias("n"))
            known, new = split_batch(materialize(groups, "dedup-groups"), snapshots)
            repeated.append(known)
            snapshots.append(snapshot(new, parts))
        every = snapshots[0].buckets
        for part in [s.buckets for s in snapshots[1:]] + repeated[1:]:
            every = every.unionByName(part)
        merged = every.groupBy("digest").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
        several = materialize(merged.filter("group_size > 1"), "dedup-several")
        checked = check_bytes(texts.select("digest", "text"), several.select("digest"))
        several = materialize(several.join(checked, "digest").filter("alike").select("digest", "keep_id", "group_size"), "dedup-checked")
        placed = rows.select("digest", "doc_id", "copies").join(several, "digest", "left")
        placed = placed.select("digest", "doc_id", "copies", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"))
        placed = result(placed, "dedup-placed")
    each = repeat_rows(placed, "copies", "copy")
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 0)
    return each.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def keep_unique(docs: DataFrame, batches: int = 3) -> DataFrame:
    """``docs`` with the one row of each group that stays, all its columns as they were.

    Of rows equal in id and text any one stays; a null id stays where its group has no other id.
    """
    stay = dedup(docs, batches).filter("kept").select(F.col("doc_id").alias("_stay_id"), F.unhex("text_sha256").alias("_stay_digest"))
    names = docs.columns
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), sha256(normalised(F.col("text"))).alias("digest"), F.col("doc_id").alias("id"))
    same = F.col("digest") == F.col("_stay_digest"), F.col("id").eqNullSafe(F.col("_stay_id"))
    return inner.join(stay, [*same], "left_semi").dropDuplicates(["digest", "id"]).select("row.*")
