"""The stages one by one against plain Python versions of what each decides."""

import random

import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402

from tallyworks.llm.simhash import fingerprint  # noqa: E402


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rnd = random.Random(9)
    vocab = [f"{a}{b}{c}" for a in "bdfglmprst" for b in "aeiou" for c in ("n", "r", "st", "lk")]
    docs, labels = [], []
    for i in range(600):
        t = " ".join(rnd.choice(vocab) for _ in range(rnd.randint(30, 120)))
        bad = i % 7 == 0
        if bad:
            t = "horrid " + t + " horrid despicable " + rnd.choice(vocab)
        if i % 3 == 0:
            t += "\nAll rights reserved"
        docs.append((i, t, "en", ["a", "a", "a", "b", "c"][i % 5], len(t)))
        labels.append((i, 1, int(bad)))
    docs += [(700 + k, docs[1][1], "en", "b", docs[1][4]) for k in range(20)] + [(800, docs[2][1] + " extra", "en", "a", 5), (801, None, None, None, None), (802, "", "en", "c", 0), (1, docs[1][1], "en", "a", docs[1][4])]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, docs


def test_stages(spark, tables):
    path, docs = tables
    toxic, lines, near, mix, pack = (f for _, f in corpus_pipeline.STAGES)
    have = spark.read.parquet(f"{path}/documents.parquet")
    columns = have.columns
    one = toxic(spark, have, path)
    assert one.columns == columns
    kept = [d for d in docs if "horrid" not in (d[1] or "")]
    assert sorted(r.doc_id for r in one.collect()) == sorted(d[0] for d in kept)
    two = lines(spark, one, path)
    assert two.columns == columns
    rows = {r.doc_id: r for r in two.collect()}
    assert not any("All rights" in (r.text or "") for r in rows.values()) and all((r.n_chars == len(r.text)) if r.text is not None else r.n_chars is None for r in rows.values())
    three = near(spark, two, path)
    assert three.columns == columns
    fps = {i: fingerprint(r.text) for i, r in rows.items()}
    comp = {i: i for i in fps}
    changed = True
    while changed:
        changed = False
        for i in fps:
            for j in fps:
                if comp[j] < comp[i] and (fps[i] ^ fps[j]).bit_count() <= 3:
                    comp[i], changed = comp[j], True
    assert sorted(r.doc_id for r in three.collect()) == sorted(set(comp.values()))
    four = mix(spark, three, path)
    assert four.columns == columns and {r.doc_id for r in four.collect()} <= set(comp.values())
    five = pack(spark, four, path)
    got = five.toPandas()
    assert len(got[got.piece == 0]) == four.count()
    assert got.groupby("sequence_id")["length"].sum().max() <= 2048


def test_run(spark, tables):
    """run gives the pieces of what the stages, applied one by one, keep: each document as often as the mix takes it, with its own ids."""
    import zlib
    from collections import Counter

    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    path, _ = tables
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path)
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for r in docs.collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids + [0]
        for k, s in enumerate(range(0, len(ids), 2048)):
            want[r.doc_id, k, s, len(ids[s:s + 2048]), zlib.crc32(np.array(ids[s:s + 2048], "<u4").tobytes())] += 1
    got = corpus_pipeline.run(spark, path).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:i]) for i in range(len(places))] and sum(n for _, n in places) <= 2048


@pytest.mark.parametrize("empty", ["documents", "labels", "both"])
def test_empty_tables(spark, tables, tmp_path, empty):
    path, _ = tables
    for name in ("documents", "labels"):
        df = spark.read.parquet(f"{path}/{name}.parquet")
        (df.limit(0) if empty in (name, "both") else df.limit(50)).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert (got.count() == 0) == (empty != "labels") and "sequence_id" in got.columns


def test_rows_of_one_id_and_other_texts_all_stay(spark):
    from tallyworks.llm import simhash

    a, b = "one two three four five six seven", "an altogether different text of some words"
    rows = [(1, a, "x", "s", 1), (1, b, "x", "s", 1), (2, a, "x", "s", 1), (1, a, "x", "s", 1), (None, a, "x", "s", 1)]
    kept = simhash.without_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted([(1, a), (1, b), (None, a)], key=str)


@pytest.mark.parametrize("k", [0, 2, 4])
def test_stages_hand_texts_to_python_in_small_batches(spark, tables, k):
    """After a stage is called, its job gets 30 MB of texts in batches of some 4 MB, not in one; a user's size and the session after run stay."""
    from pyspark.sql import functions as F

    def sizes(batches):
        for b in batches:
            yield b[["doc_id"]].iloc[:1].assign(n=int(b["text"].str.len().sum()))

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    path, _ = tables
    own = spark.conf.get(key, None)
    try:
        spark.conf.unset(key)
        corpus_pipeline.STAGES[k][1](spark, spark.read.parquet(f"{path}/documents.parquet"), path)
        long = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 2000).alias("text"))
        got = long.mapInPandas(sizes, "doc_id long, n long").agg(F.max("n").alias("most"), F.count("n").alias("batches")).first()
        assert got["most"] < 5_000_000 and got["batches"] >= 7
        spark.conf.set(key, "9m")
        corpus_pipeline.STAGES[k][1](spark, spark.read.parquet(f"{path}/documents.parquet"), path)
        assert spark.conf.get(key) == "9m"
    finally:
        spark.conf.unset(key) if own is None else spark.conf.set(key, own)


def test_run_leaves_the_size_of_batches_as_it_was(spark, tables):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    corpus_pipeline.run(spark, tables[0])
    assert spark.conf.get(key, None) == before
