"""The corpus pipeline on a small corpus: every stage against brute force on its own input, and the whole run."""

import struct
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.test_llm import brute_components, brute_leaks, prose

pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = np.random.default_rng(3)
    item = prose(900, 40)
    rows, labels = [], []

    def add(doc_id, text, source="web", quality=None):
        rows.append((doc_id, text, "en", source, len(text or "")))
        if quality is not None and doc_id is not None:
            labels.append((doc_id, quality, 0))

    for i in range(160):
        good = i % 2 == 0
        text = ". ".join(prose(i * 10 + j, 12).capitalize() for j in range(5)) + "." if good else " ".join(rng.choice(["###", "BUY!!!", "$$$", "click", "|||", "@@"], 40))
        add(i, text, ("web", "book", None)[i % 3], int(good))
    base = rows[0][1].split()
    add(500, " ".join(base), "book")  # a copy
    add(501, " ".join([*base[:30], "changed", *base[31:]]), "book")  # a near copy
    add(2, rows[4][1].replace("alpha", "alpaca") + " " + rows[8][1], "web")  # an id that is taken, another text
    add(None, rows[10][1], "web")  # a copy without an id
    add(None, ". ".join(prose(7000 + j, 12).capitalize() for j in range(6)) + ".", "web")
    add(600, rows[12][1] + " " + item, "web")  # a leak
    add(601, None, "web")
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality long, toxic long").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, "nowhere to be found in this corpus at all")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def texts(df):
    return Counter((r["doc_id"], r["text"], r["source"]) for r in df.collect())


def test_stages_match_brute_force(spark, corpus):
    from tokenizers import Tokenizer

    from tessera.llm import mixing, quality_fm, token_frames

    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    machine = quality_fm.fit(docs, spark.read.parquet(f"{corpus}/labels.parquet"))
    columns = docs.columns

    before = docs.collect()
    good = corpus_pipeline.quality(spark, docs, corpus)
    want = Counter((r["doc_id"], r["text"], r["source"]) for r in before if machine.score(*quality_fm.featurize(r["text"], {})) >= 0.7)
    assert good.columns == columns and texts(good) == want and sum(want.values()) >= 80

    rows = [(r["doc_id"], r["text"], r["source"]) for r in good.collect()]
    one = corpus_pipeline.near_duplicates(spark, good, corpus)
    # Rows by place, so that repeated and null ids are told apart.
    groups = {}
    for (place, _, least), row in zip(brute_components([(i, r[1]) for i, r in enumerate(rows)], 5, 80), rows, strict=True):
        groups.setdefault(least, []).append(row)
    kept = texts(one)
    assert one.columns == columns and sum(kept.values()) == len(groups)
    for group in groups.values():
        ids = [r[0] for r in group if r[0] is not None]
        assert sum(kept[r] for r in set(group)) == 1 and any(kept[r] and r[0] == (min(ids) if ids else None) for r in group)

    rows = [(r["doc_id"], r["text"], r["source"]) for r in one.collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{corpus}/benchmark.parquet").collect()]
    clean = corpus_pipeline.decontaminate(spark, one, corpus)
    leaks = {(d, t) for d, t, _ in rows if brute_leaks([(d, t)], items)}
    assert leaks and texts(clean) == Counter(r for r in rows if r[:2] not in leaks)

    mixed = corpus_pipeline.source_mix(spark, clean, corpus)
    taken = mixing.mix(clean).collect()
    want = Counter()
    for r in taken:
        want[r["doc_id"], r["text"], r["source"]] += int(r["taken"] / r["size"] + 0.5) if r["size"] else 0
    assert mixed.columns == columns and texts(mixed) == +want

    library = Tokenizer.from_file(token_frames.default_tokenizer())
    got = sorted(corpus_pipeline.tokens(spark, mixed, corpus).collect(), key=lambda r: r["start"])
    ids = [(r["doc_id"], [*library.encode(r["text"] or "", add_special_tokens=False).ids, 2]) for r in mixed.collect()]
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == Counter((d, len(x), zlib.crc32(struct.pack(f"<{len(x)}I", *x))) for d, x in ids)
    assert [r["start"] for r in got] == np.cumsum([0, *[r["n_tokens"] for r in got]])[:-1].tolist()
    order = [(r["doc_id"] is not None, r["doc_id"] or 0) for r in got]
    assert order == sorted(order)


def test_the_whole_run(spark, corpus):
    out = corpus_pipeline.run(spark, corpus).collect()
    ids = {r["doc_id"] for r in out}
    assert 600 not in ids and not ids & {1, 3, 5} and not ids & {500, 501} and {0, 4, 8} & ids
