"""Merkle manifest of a dataset, with leaf places from ranks in merged bitmaps.

Each row is a leaf; leaves of a source stand in the order of their ids, and each
run of 16 nodes becomes one until a source has one node; the sources' nodes,
in the order of their names, are reduced likewise. No leaf is ever sorted:

1. *Bitmaps.* Per source, ids are merged to 64-bit words of set bits
   (``bit_or``, with partial aggregation), and only words that have a bit exist,
   so a bitmap is as small as its ids are many, whatever their range. A repeated
   id has its further rows in a short list beside the word.
2. *Directories.* Counts of words are summed over 1,024 words, these again over
   1,024, and so on; each level knows how many rows stand before it within its
   parent. No window has more than 1,024 rows, however large a source is.
3. *Rank.* A row's place is what stands before its word, and the bits below its
   own. Rows of one id (and those without an id, which come first) are ranked
   the same way by stretches of their leaf's bits; equal rows take places in a
   row.
4. *Levels.* A node goes to the slot array ``place / 16``; each array of up to
   16 digests gives the node of the next level. Siblings then go down from the
   root, level by level: a run's siblings are joined to its parent's path once,
   so no path is looked up leaf by leaf.

Digests are kept as 32 bytes and hashed as their hex text. A path is a list of
what stands left and right of a node, from its own level up to the root. Its
length grows with the logarithm of the rows.

Edge cases: a null is written ``-``; a null id or source comes first; rows that
repeat an id stand in the order of their leaves; a source with one row is its
leaf; one source alone is the root; an empty table gives an empty result. Other
columns may have any name. Tables in between are deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.repeats import numbered, repeat_rows
from tessera.session import materialize, scratch

#: Nodes in a run, and children of a directory entry as a power of two.
RUN, STEP = 16, 10
#: Bits of a leaf in one stretch of the order within an id.
STRETCH = 56
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _hash(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    """Digest of a row's five values, each with its length before it."""
    return _hash(F.concat(*(_field(c) for c in (doc_id, source, lang, n_chars, text))))


def _leaves(docs: DataFrame) -> DataFrame:
    """src, doc_id, leaf, forged (the leaf after tampering, if the row is one to tamper with), copies."""
    rest = F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    each = docs.select(
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("src"), "doc_id",
        leaf_of(*rest, F.col("text")).alias("leaf"),
        F.when(tampered, leaf_of(*rest, F.translate("text", UPPER, LOWER))).alias("forged"),
    )
    return each.groupBy("src", "doc_id", "leaf", "forged").agg(F.count("*").alias("copies"))


def _directory(words: DataFrame) -> DataFrame:
    """(src, slot, word, n) to how many rows stand before each word in its (src, slot)."""
    lo, hi = words.agg(F.min("word"), F.max("word")).first()
    levels, shift = [words.select("src", "slot", F.col("word").alias("at"), "n")], 0
    while (hi >> shift) - (lo >> shift) >= 1 << STEP:
        shift += STEP
        below = levels[-1]
        levels.append(below.groupBy("src", "slot", F.shiftright("at", STEP).alias("at")).agg(F.sum("n").alias("n")))
    top = Window.partitionBy("src", "slot").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    known = levels[-1].withColumn("before", F.coalesce(F.sum("n").over(top), F.lit(0)))
    inside = Window.partitionBy("src", "slot", "up").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    for level in reversed(levels[:-1]):
        parents = known.select("src", "slot", F.col("at").alias("up"), F.col("before").alias("outer"))
        within = level.withColumn("up", F.shiftright("at", STEP)).withColumn("inner", F.coalesce(F.sum("n").over(inside), F.lit(0)))
        known = within.join(parents, ["src", "slot", "up"]).select("src", "slot", "at", "n", (F.col("inner") + F.col("outer")).alias("before"))
    return known.select("src", "slot", F.col("at").alias("word"), "before")


def ranked(rows: DataFrame, key: Column) -> DataFrame:
    """Rows of each (src, slot) to the slot that ``key`` gives them there, and whether others (``tied``) have the same.

    ``rows`` is a written table with ``copies``; a row counts that many times.
    """
    keyed = rows.withColumn("_key", key).withColumns({"word": F.shiftright("_key", 6), "bit": F.col("_key").bitwiseAND(63).cast("int")})
    by_key = keyed.groupBy("src", "slot", "word", "bit").agg(F.sum("copies").alias("n"))
    one = F.lit(1).cast("long")
    further = F.when(F.col("n") > 1, F.struct("bit", (F.col("n") - 1).alias("n")))
    words = by_key.groupBy("src", "slot", "word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"), F.sum("n").alias("n"), F.collect_list(further).alias("further"))
    words = materialize(words, "merkle-words")
    if words.isEmpty():
        return rows.withColumn("tied", F.lit(False))
    words = words.join(_directory(words), ["src", "slot", "word"]).drop("n")
    found = keyed.join(materialize(words, "merkle-ranks"), ["src", "slot", "word"])
    lower = F.bit_count(F.col("bits").bitwiseAND(F.expr("~shiftleft(-1L, bit)"))).cast("long")
    more = F.aggregate(F.filter("further", lambda e: e["bit"] < F.col("bit")), F.lit(0).cast("long"), lambda acc, e: acc + e["n"])
    own = F.aggregate(F.filter("further", lambda e: e["bit"] == F.col("bit")), one, lambda acc, e: acc + e["n"])
    placed = found.withColumn("tied", own > F.col("copies")).withColumn("slot", F.col("slot") + F.col("before") + lower + more)
    return placed.select(*rows.columns, "tied")


def _stretch(k: int) -> Column:
    digits = STRETCH // 4
    return F.conv(F.substring(F.hex("leaf"), 1 + k * digits, digits), 16, 10).cast("long")


def placed_leaves(leaves: DataFrame) -> DataFrame:
    """Leaves with their slot in the source: by id, equal ids by leaf, equal rows one after another."""
    zero = F.lit(0).cast("long")
    nulls = materialize(leaves.filter("doc_id IS NULL").groupBy("src").agg(F.sum("copies").alias("nulls")), "merkle-nulls")
    if nulls.isEmpty():
        done = materialize(ranked(leaves.withColumn("slot", zero), F.col("doc_id")), "merkle-placed")
    else:
        with_id = leaves.filter("doc_id IS NOT NULL").join(nulls, "src", "left").withColumn("slot", F.coalesce("nulls", zero)).drop("nulls")
        first = ranked(materialize(with_id, "merkle-known"), F.col("doc_id"))
        without = leaves.filter("doc_id IS NULL").withColumns({"slot": zero, "tied": F.lit(True)})
        done = materialize(first.unionByName(without), "merkle-placed")
    k = 0
    while (k + 1) * STRETCH <= 256 and not (ties := done.filter("tied")).isEmpty():
        finer = ranked(materialize(ties.drop("tied"), "merkle-ties"), _stretch(k))
        done = materialize(done.filter("NOT tied").unionByName(finer), "merkle-placed")
        k += 1
    each = repeat_rows(done.drop("tied"), "copies", "copy")
    return each.withColumn("slot", F.col("slot") + F.col("copy")).drop("copy", "copies")


def _runs(nodes: DataFrame, *extra: str) -> DataFrame:
    """(src, n, slot, digest) to slot arrays: members by place, and the node that they make."""
    member = F.struct((F.col("slot") % RUN).alias("place"), "digest", *extra)
    runs = nodes.groupBy("src", "n", F.expr(f"slot DIV {RUN}").alias("run")).agg(F.sort_array(F.collect_list(member)).alias("members"))
    hexes = F.transform("members", lambda m: _hex(m["digest"]))
    node = F.when(F.col("n") == 1, F.col("members")[0]["digest"]).otherwise(_hash(F.array_join(hexes, "")))
    return runs.withColumn("node", node)


def _levels(first: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """All levels of the trees above the runs given, and (src, digest) of their tops."""
    top_of = [F.col("src"), F.col("node").alias("digest")]
    levels, tops = [first], first.filter(f"n <= {RUN}").select(*top_of)
    while True:
        next_n = F.expr(f"(n + {RUN - 1}) DIV {RUN}")
        nodes = levels[-1].filter(f"n > {RUN}").select("src", next_n.alias("n"), F.col("run").alias("slot"), F.col("node").alias("digest"))
        above = materialize(_runs(nodes), "merkle-level")
        if above.isEmpty():
            return levels, tops
        levels.append(above)
        tops = tops.union(above.filter(f"n <= {RUN}").select(*top_of))


def _sides(runs: DataFrame, paths: DataFrame, *keep: str) -> DataFrame:
    """Members of the runs with their path: what stands left and right in the run, then the path of the run's node."""
    hexes = F.transform("members", lambda m: _hex(m["digest"]))
    joined = runs.join(paths, ["src", "run"]).withColumn("hexes", hexes)
    each = joined.select("src", "n", "run", *keep, "path", "hexes", F.posexplode("members").alias("pos", "member"))
    left = F.unhex(F.array_join(F.slice("hexes", 1, F.col("pos")), ""))
    right = F.unhex(F.array_join(F.slice("hexes", F.col("pos") + 2, RUN), ""))
    path = F.when(F.col("n") == 1, F.col("path")).otherwise(F.concat(F.array(F.struct(left.alias("left"), right.alias("right"))), "path"))
    return each.withColumn("path", path).withColumn("slot", F.col("run") * RUN + F.col("pos"))


def _down(levels: list[DataFrame], tops: DataFrame, *keep: str) -> DataFrame:
    """Paths of the lowest runs' nodes. ``tops``: src, path and the columns to keep of the nodes without a parent."""
    paths = None
    for level in reversed(levels):
        mine = level.filter(f"n <= {RUN}").select("src", "run").join(tops, "src")
        if paths is not None:
            mine = mine.unionByName(materialize(paths, "merkle-paths"))
        if level is levels[0]:
            return materialize(mine, "merkle-paths")
        paths = _sides(level, mine, *keep).select("src", F.col("slot").alias("run"), "path", *keep)


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: one row per row of ``docs``, digests in hex.

    The folded root is recomputed from the proof and the row as it is after
    tampering (every row whose id's CRC-32 five divides is tampered with).
    """
    with scratch(docs.sparkSession) as result:
        leaves = placed_leaves(materialize(_leaves(docs), "merkle-leaves"))
        sizes = materialize(leaves.groupBy("src").agg(F.count("*").alias("n")), "merkle-sizes")
        if sizes.isEmpty():
            empty = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
            return docs.sparkSession.createDataFrame([], empty)
        nodes = leaves.join(sizes, "src").withColumnRenamed("leaf", "digest")
        lowest = result(_runs(nodes, "doc_id", "forged"), "merkle-runs")
        levels, subroots = _levels(lowest)
        sources = numbered(materialize(subroots, "merkle-subroots"), F.col("src"), "slot")
        top = sources.select(F.lit("").alias("src"), F.lit(sizes.count()).cast("long").alias("n"), "slot", "digest", F.col("src").alias("source"))
        top_runs = materialize(_runs(top, "source"), "merkle-runs")
        top_levels, roots = _levels(top_runs)
        root = roots.first()["digest"]
        no_path = F.array().cast("array<struct<left: binary, right: binary>>")
        top_paths = _down(top_levels, roots.select("src", no_path.alias("path")))
        above = _sides(top_runs, top_paths).select(F.col("member.source").alias("src"), "path", F.col("member.digest").alias("subroot"))
        paths = result(_down(levels, materialize(above, "merkle-subpaths"), "subroot"), "merkle-paths")
    rows = _sides(lowest, paths, "subroot").select(F.col("member.doc_id").alias("doc_id"), F.col("member.digest").alias("leaf"), F.col("member.forged").alias("forged"), "subroot", "path")
    proof = F.sha2(F.array_join(F.transform("path", lambda p: F.lower(F.concat(F.hex(p["left"]), F.hex(p["right"])))), ""), 256)
    start = _hex(F.coalesce("forged", "leaf"))
    folded = F.aggregate("path", start, lambda node, p: F.sha2(F.concat(F.lower(F.hex(p["left"])), node, F.lower(F.hex(p["right"]))), 256))
    whole = F.lit(root.hex())
    out = rows.select("doc_id", _hex(F.col("leaf")).alias("leaf"), _hex(F.col("subroot")).alias("subroot"), whole.alias("root"), proof.alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
