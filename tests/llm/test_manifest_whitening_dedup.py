"""Merkle manifest, whitening and exact dedup against brute force, with edge cases and hot keys."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tessera.llm import exact_dedup, fuse_filter, merkle, mixing, repeats, whitening
from tessera.session import materialize
from tests.llm.test_llm import SCHEMA, prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def rows():
    """Null and repeated ids, sources and texts, a source of one row, far ids, a long text, clashing columns."""
    out = [(i, f"Text {i % 40}\n\tand  more {i % 7}", "en", ("web", "book", None, "ünï")[i % 4], i, 0, "x") for i in range(300)]
    out += [(7, "another Text", "en", "web", 1, 0, "x"), (7, "third Text", None, "web", None, 0, "x"), (7, "third Text", None, "web", None, 0, "x")]
    out += [(None, t, "en", "web", 2, 0, "x") for t in ("b", "a", None, "a")] + [(None, "", "en", None, 2, 0, "x")]
    out += [(-(1 << 62), "Far", "en", "web", 1, 0, "x"), ((1 << 62) + 5, "far", "en", "web", 1, 0, "x"), (900, None, "en", "alone", None, 0, "x"), (901, "", "en", "web", 0, 0, "x"), (902, prose(1, 20000), "en", "web", 1, 0, "x")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    # Columns with the operators' own names.
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("src", "slot", "leaf", "digest", "row", "bit", "copies", "batch", "kept", "n")})
    return materialize(df.repartition(3), "docs")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def key(row):
    return [(v is not None, v if v is not None else 0) for v in row]


# 11


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_manifest(rows):
    def leaf(r, text):
        return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], text)))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([digest("".join(out[-1][i : i + 16])) for i in range(0, len(out[-1]), 16)])
        return out

    def path(tree, i):
        for level in tree[:-1]:
            start = i // 16 * 16
            yield "".join(level[start:i]), "".join(level[i + 1 : start + 16])
            i //= 16

    by = defaultdict(list)
    for r in rows:
        tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[1] is not None
        by[r[3]].append((r[0], leaf(r, r[1]), leaf(r, r[1].translate(LOWER)) if tampered else leaf(r, r[1])))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        by[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[s] = levels([x[1] for x in by[s]])
    top = levels([trees[s][-1][0] for s in names])
    out = []
    for j, s in enumerate(names):
        for i, (doc_id, own, forged) in enumerate(by[s]):
            steps, node = [*path(trees[s], i), *path(top, j)], forged
            for left, right in steps:
                node = digest(left + node + right)
            out.append((doc_id, own, trees[s][-1][0], top[-1][0], digest("".join(a + b for a, b in steps)), node, node == top[-1][0]))
    return out


def test_manifest_matches_brute_force(docs, rows):
    got = [tuple(r) for r in merkle.manifest(docs).collect()]
    assert sorted(got, key=key) == sorted(brute_manifest(rows), key=key)
    assert {r[6] for r in got} == {True, False}


def test_manifest_of_one_source_one_row_and_none(spark, empty):
    one = spark.createDataFrame([(1, "A", "en", "s", 1, 0, "x")], SCHEMA)
    got = merkle.manifest(one).collect()
    assert len(got) == 1 and got[0]["root"] == got[0]["subroot"] == got[0]["leaf"] and got[0]["proof_sha256"] == digest("")
    assert merkle.manifest(empty).count() == 0 and merkle.manifest(empty).columns == merkle.manifest(one).columns


def test_manifest_of_one_hot_id(spark):
    """All rows have one id: they are ranked by their leaves, equal ones one after another."""
    rows = [(5, f"t{i % 100}", "en", "hot", 1, 0, "x") for i in range(400)]
    got = [tuple(r) for r in merkle.manifest(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(got, key=key) == sorted(brute_manifest(rows), key=key)


def test_no_window_of_the_manifest_holds_a_source(spark):
    """A source of 50,000 rows: directory windows have at most 1,024 rows."""
    words = spark.range(50_000).select(F.lit("=hot").alias("src"), F.lit(0).cast("long").alias("slot"), (F.col("id") * 3).alias("word"), F.lit(2).cast("long").alias("n"))
    words = materialize(words, "words")
    found = merkle._directory(words).orderBy("word").collect()
    assert [r["before"] for r in found] == [2 * i for i in range(50_000)]
    plan = merkle._directory(words)._jdf.queryExecution().executedPlan().toString()
    assert "up#" in plan.split("Window", 1)[1]


def test_repeats_and_numbers(spark):
    df = materialize(spark.createDataFrame([("a", 1), ("b", 10_000), ("c", 2)], "k string, n long"), "repeats")
    got = repeats.repeat_rows(df, "n", "i").groupBy("k").agg(F.count("*").alias("n"), F.count_distinct("i").alias("d"), F.max("i").alias("m")).collect()
    assert {r["k"]: (r["n"], r["d"], r["m"]) for r in got} == {"a": (1, 1, 0), "b": (10_000, 10_000, 9_999), "c": (2, 2, 1)}
    numbered = repeats.numbered(spark.range(5000).select((F.col("id") * 7919 % 5000).alias("v")), F.col("v"), "i").collect()
    assert all(r["v"] == r["i"] for r in numbered) and len(numbered) == 5000


# 12


def brute_white(vectors, wanted=16):
    ids = [i for i, e in vectors if e is not None and len(e) and all(v is not None and np.isfinite(v) for v in e)]
    x = np.array([np.floor(64 * np.array(e, dtype=float)) for i, e in vectors if i in ids and e is not None]).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = (n * fit - sums) / n
    values, vecs = np.linalg.eigh(centred.T @ centred / n)
    values, vecs = values[::-1], vecs[:, ::-1]
    k = min(wanted, int((values > values[0] * 1e-16).sum()))
    return ids, n, ((n * x - sums) ** 2).sum(axis=1), ((n * x - sums) / n) @ vecs[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum()


def check_white(spark, vectors, block, k):
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumns({"x": F.lit(1), "n": F.lit(2), "component": F.lit(3)})
    got = sorted(whitening.whiten(df, block=block).collect(), key=lambda r: (r["vec_id"], r["component"]))
    ids, n, deviation, white, explained = brute_white(vectors)
    assert len(got) == len(ids) * k and {r["n"] for r in got} == {n}
    mine = np.array([r["whitened"] for r in got]).reshape(-1, k)
    order = np.argsort(ids)
    white = white[order][:, :k]
    assert np.abs(mine - white * np.sign((mine * white).sum(axis=0))).max() < 1e-8
    assert [r["deviation"] for r in got[::k]] == deviation[order].tolist()
    assert np.allclose([r["explained"] for r in got[:k]], explained[:k], rtol=1e-9)
    assert got[0]["identity_error"] < 1e-9


@pytest.mark.parametrize("block", [1, 5, 16])
def test_whitening_matches_eigenvectors(spark, block):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((120, 24)) * np.linspace(1, 3, 24)
    vectors = [(i, base[i % 100].tolist()) for i in range(120)]  # twenty are repeated: the fit list has them once
    vectors += [(500, None), (501, [1.0, None] * 12), (502, [float("inf")] * 24), (503, [float("nan")] * 24), (504, []), (505, [1.0] * 7)]
    check_white(spark, [v for v in vectors if v[0] != 505], block, 16)
    some = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    assert whitening.whiten(some, block=block).filter("vec_id >= 500").count() == 0


def test_whitening_ends_early_on_a_falling_spectrum(spark):
    rng = np.random.default_rng(5)
    vectors = [(i, (1000 * np.exp(-np.arange(150) / 4) * rng.standard_normal(150)).tolist()) for i in range(400)]
    check_white(spark, vectors, 16, 16)


def test_whitening_of_few_flat_and_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).count() == 0
    rank = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0, 0.0]), (2, [3.0, 2.0, 0.0]), (3, [9.0, 2.0, 0.0])], schema)).collect()
    assert len(rank) == 3 and {r["component"] for r in rank} == {1} and np.isclose(sum(r["whitened"] ** 2 for r in rank) / 3, 1.0)
    huge = whitening.whiten(spark.createDataFrame([(1, [1e30, 0.0]), (2, [-1e30, 1.0])], schema)).collect()
    assert len(huge) == 2 and {r["deviation"] for r in huge} == {None}


# 13


def brute_dedup(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "")].append(r[0])
    out = []
    for text, ids in groups.items():
        keep, kept = min((i for i in ids if i is not None), default=None), False
        for i in ids:
            mine = i == keep and not kept
            kept = kept or mine
            out.append((i, keep, len(ids), mine, digest(text)))
    return out


@pytest.mark.parametrize("batches", [1, 2, 3, 7])
def test_dedup_does_not_depend_on_batches(docs, rows, batches):
    got = [tuple(r) for r in exact_dedup.dedup(docs, batches).collect()]
    assert sorted(got, key=key) == sorted(brute_dedup(rows), key=key)


def test_dedup_of_hot_and_empty_tables(spark, empty):
    rows = [(i % 3, "all  the same", "en", "s", 1, 0, "x") for i in range(9000)] + [(9, None, "en", "s", 1, 0, "x")]
    got = [tuple(r) for r in exact_dedup.dedup(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(got, key=key) == sorted(brute_dedup(rows), key=key)
    assert exact_dedup.dedup(empty).count() == 0 and exact_dedup.keep_unique(empty).count() == 0


def test_keep_unique_keeps_columns_and_one_row_of_each_text(docs, rows):
    got = exact_dedup.keep_unique(docs)
    assert got.columns == docs.columns
    texts = [re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "") for r in got.collect()]
    assert len(texts) == len(set(texts)) == len({re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "") for r in rows})


def test_two_texts_with_one_digest_are_told(spark):
    rows = [(1, "one", "en", "s", 1, 0, "x"), (2, "two", "en", "s", 1, 0, "x")]
    with pytest.raises(PySparkException, match="two texts have the digest"):
        exact_dedup.dedup(spark.createDataFrame(rows, SCHEMA), digest=lambda text: F.unhex(F.lpad(F.hex(F.length(text)), 64, "0"))).collect()


def test_screening_lets_new_digests_end(spark):
    """All that a snapshot has is found, and of what it has not, next to nothing goes on to the exact buckets."""
    made = lambda lo, hi: spark.range(lo, hi).select(F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest"), F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("n"))
    snapshots = [exact_dedup.snapshot(made(0, 20_000), 16), exact_dedup.snapshot(made(20_000, 30_000), 16)]
    asked = materialize(made(25_000, 60_000), "asked")
    positives = exact_dedup.screen(asked, snapshots).count()
    assert 5_000 <= positives < 5_000 + 30
    known, new = exact_dedup.split_batch(asked, snapshots)
    assert (known.count(), new.count()) == (5_000, 30_000)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 17, 1000, 30_000])
def test_fuse_filter(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 2**63, n, dtype=np.int64)
    made = fuse_filter.build(np.concatenate([keys, keys[: n // 2]]))
    assert fuse_filter.may_contain(made, keys).all() and made == fuse_filter.build(keys[::-1])
    others = rng.integers(-(2**63), 0, 100_000, dtype=np.int64)
    assert fuse_filter.may_contain(made, others).mean() < 1e-3
    assert n < 1000 or len(made) * 8 / n < 24


# names in the pipeline's stages


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    import corpus_pipeline

    names = ("size", "taken", "target", "source_size", "_key", "_rest", "_cut_key", "_copy", "row", "key", "id", "component_id", "_row")
    rows = [(i, prose(i // 2, 60), "en", ("a", "b")[i % 2], 1, *[str(i)] * len(names)) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names))
    one = corpus_pipeline.near_duplicates(spark, docs, "")
    mixed = mixing.mixed(one)
    assert one.columns == mixed.columns == docs.columns
    assert sorted(r["doc_id"] for r in one.collect()) == list(range(0, 20, 2))
    assert all(r[n] == str(r["doc_id"]) for r in mixed.collect() for n in names)


def test_token_files_have_an_address(spark, tmp_path):
    pytest.importorskip("tokenizers")
    import corpus_pipeline
    from tessera.llm import token_frames

    docs = spark.createDataFrame([(i, prose(i, 30), "en", "a", 1) for i in range(10)], "doc_id long, text string, lang string, source string, n_chars long")
    made = corpus_pipeline.tokens(spark, docs, "", f"file://{tmp_path}/tokens").collect()
    manifest = token_frames.token_manifest(spark, f"file://{tmp_path}/tokens").collect()
    assert sum(r["n_docs"] for r in manifest) == 10 and sum(r["n_tokens"] for r in manifest) == sum(r["n_tokens"] for r in made)
    assert all((tmp_path / "tokens" / r["path"].rsplit("/", 1)[1]).exists() for r in manifest)
