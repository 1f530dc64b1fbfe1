"""The stages of the pipeline on planted and awkward documents, each against a slow form of itself; and rows without ids."""

import os
import zlib
from collections import Counter

import duckdb
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_brute import components_of, same, tokenizer, words

import corpus_pipeline
from cucurbit.llm import bpe, jaccard_join, media, packing, passages, quality, sharding, suffix_dedup, token_counts, toxicity
from cucurbit.llm.common import saved, shared_dir

#: Names that operators use, as columns of the documents.
CLASHES = ["failed", "n_words", "score", "predicted", "held_out", "__k", "__c", "__text", "__spans", "__row", "__words", "number", "length", "component_id", "n_shingles", "k", "j"]


def planted():
    """Ids from 100,000 on: texts with all that the stages look for."""
    base, shared = words(120, 31), words(70, 32)
    near = list(base)
    near[60] = "changed"
    texts = {
        100_000: " ".join(base), 100_001: " ".join(base), 100_002: " ".join(near), 100_003: None, 100_004: "", 100_005: "too short", 100_006: "again and again " * 60,
        100_007: " ".join(words(60, 33) + shared + words(60, 34)), 100_008: " ".join(words(80, 35) + shared + words(50, 36)), 100_009: " ".join(words(30_000, 37)), 100_010: " \n ".join(words(40, 38)),
    }
    return list(texts.items())


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    own = spark.createDataFrame([(k, t, "en", "web", None if t is None else len(t)) for k, t in planted()], "doc_id long, text string, lang string, source string, n_chars long")
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").unionByName(own)
    twice = rows.unionByName(rows.where("doc_id in (100010, 5)")).unionByName(rows.where("doc_id = 100010").withColumn("doc_id", F.lit(None).cast("long")).withColumn("text", F.lit(" ".join(words(45, 39)))))
    return saved(twice.select("*", *(F.lit("mine").alias(c) for c in CLASHES)))


def stage(spark, name, docs, sf_dir):
    out = saved(dict(corpus_pipeline.STAGES)[name](spark, docs, sf_dir))
    if name != "best_fit_packing":
        assert out.columns == docs.columns
        kept = [c for c in docs.columns if c not in ("text", "n_chars")]
        assert out.select(kept).exceptAll(docs.select(kept)).isEmpty()
    return out


def keys(frame):
    return Counter(r.doc_id for r in frame.select("doc_id").collect())


def test_stages(spark, docs, sf_dir):
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").where("doc_id is not null").dropDuplicates().toPandas())
    judged = con.execute(quality.oracle_sql()).df()
    clean = stage(spark, "quality_rules", docs, sf_dir)
    good = set(judged.doc_id[judged.kept])
    want = Counter({k: n for k, n in keys(docs).items() if k is None or k in good})
    assert keys(clean) == want and not {100_003, 100_004, 100_005, 100_006} & set(want) and {100_000, 100_009, None} <= set(want)

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    bad = {r.doc_id for r in toxicity.toxicity(clean.select("doc_id", "text"), labels).where("predicted = 1").collect()}
    mild = stage(spark, "toxicity", clean, sf_dir)
    assert keys(mild) == Counter({k: n for k, n in keys(clean).items() if k not in bad})

    rows = [(r.doc_id, r.text) for r in mild.collect()]
    least = {k: c for k, _, c in components_of([r for r in rows if r[0] is not None])}  # ids of several texts are in the test below
    alone = stage(spark, "ngram_jaccard_join", mild, sf_dir)
    assert keys(alone) == Counter({None: 1} | {k: 1 for k in least if least[k] == k})
    assert 100_000 in keys(alone) and not {100_001, 100_002} & set(keys(alone))

    cut = stage(spark, "substring_dedup", alone, sf_dir)
    before, after = ({r.doc_id: r for r in x.collect()} for x in (alone, cut))
    shared = " ".join(words(70, 32)[3:-3])
    assert sorted([shared in after[100_007].text, shared in after[100_008].text]) == [False, True]
    told = {r.doc_id: r.n_removed for r in passages.passage_report(alone)[1].collect()}
    for k, r in after.items():
        assert len(r.text.split()) == len(before[k].text.split()) - told[k] and r.n_chars == len(r.text)
        if not told[k]:
            assert r.text == before[k].text

    own, want = tokenizer("word_bpe_49k.json"), []
    for k, r in after.items():
        ids = [*own.encode(r.text or "", add_special_tokens=False).ids, 0]
        want += [(k, p, at, len(part := ids[at : at + 2048]), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))) for p, at in enumerate(range(0, len(ids), 2048))]
    packed = stage(spark, "best_fit_packing", cut, sf_dir).collect()
    same([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed], want)
    used = Counter()
    for r in packed:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 2048 and len(used) <= 1.05 * -(-sum(used.values()) // 2048) + 1


def test_one_id_on_several_texts(spark, sf_dir):
    """What goes is told by row: a text that is like no other stays, whatever its id's other texts are like."""
    a, z, q, b = (" ".join(words(80, k)) for k in (51, 52, 53, 54))
    rows = [(3, a, 1), (5, a, 2), (5, z, 3), (9, q, 4), (9, q, 4), (None, a, 5), (None, b, 6), (None, b, 7), (4, None, 8), (4, None, 8), (5, "", 9), (2, z + " more", 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __id int")
    kept = corpus_pipeline.near_duplicates(spark, docs, sf_dir)
    assert kept.columns == docs.columns
    found = Counter((r.doc_id, r.text) for r in kept.collect())
    assert found == Counter({(3, a): 1, (2, z + " more"): 1, (9, q): 1, (None, b): 1, (4, None): 2, (5, ""): 1})
    # Without the document of id 2, the text under id 5 is like no other.
    again = corpus_pipeline.near_duplicates(spark, docs.where("doc_id is null or doc_id <> 2"), sf_dir)
    assert {(3, a), (5, z), (9, q), (None, b)} <= {(r.doc_id, r.text) for r in again.collect()}


def test_empty_documents(spark, docs, sf_dir):
    own = docs.where("false")
    for name, _ in corpus_pipeline.STAGES:
        own = stage(spark, name, own, sf_dir)
        assert own.count() == 0


def test_run(spark, sf_dir):
    """Of all tables on the way only the result's is left."""
    folder = f"{shared_dir(spark).removeprefix('file://')}/tables"
    there = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    found = corpus_pipeline.run(spark, sf_dir)
    assert found.count() and found.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").isEmpty()
    assert {f"{folder}/{x}" for x in set(os.listdir(folder)) - there} == {found.saved_at.removeprefix("file://")}


def test_rows_without_ids(spark):
    long = " ".join(words(80, 40))
    rows = [(None, long), (None, long), (3, long), (None, None), (None, "a b"), (7, " ".join(words(60, 41)))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    ids = Counter(k for k, _ in rows)
    bpe_path, count_path = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
    labels = spark.createDataFrame([(3, 1), (7, 0), (None, 1)], "doc_id long, toxic int")
    for out in (
        quality.ledger(frame), toxicity.toxicity(frame, labels), bpe.bpe_digests(frame, bpe_path), token_counts.token_counts(frame, count_path), media.media_features(frame),
        sharding.place(frame, ["doc_id"], {"a": 1, "b": 1}, 101), packing.pack_documents(frame, bpe_path), passages.without_passages(frame),
    ):
        assert keys(out) == ids
    assert {r.held_out for r in toxicity.toxicity(frame, labels).where("doc_id is null").collect()} == {False}
    linked = sorted(((r.doc_id or 0, r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(frame).collect()), key=str)
    # The least id of a component is that of rows that have one.
    assert linked == sorted([(0, 76, 3), (0, 76, 3), (3, 76, 3), (0, 0, None), (0, 1, None), (7, 56, 7)], key=str)
    gone = Counter((r.doc_id, r.n_removed == r.n_bytes and r.n_bytes > 0) for r in suffix_dedup.dedup_substrings(frame).collect())
    assert gone == Counter({(None, True): 2, (3, True): 1, (None, False): 2, (7, False): 1})
    # Rows alike in id and text are one row's copies: all but the least by id and hash give up their words.
    report = passages.passage_report(frame)[1].where("n_words = 80").collect()
    assert len(report) == 3 and all(r.n_repeated == 80 for r in report) and sum(r.n_removed == 80 for r in report) >= 1
    pd.testing.assert_frame_equal(frame.limit(0).toPandas(), passages.without_passages(frame.limit(0)).toPandas())
