"""Shards, manifests, sources, sinks, streams and jobs, written and read again."""

import gzip
import json
import math
import os

import pytest
import zstandard
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cucurbit import jobs
from cucurbit.functions import registry
from cucurbit.operators import model
from cucurbit.plans import embed, preprocess
from cucurbit.sources import encodings, molecules, shards
from cucurbit.streaming import embed as streams
from cucurbit.types import SHARD_ROW, Losses, Model, Preprocessing, QualityFilter

#: Fixed value: the packed id of ZINC000000000001_1.
ZINC_ID = 0x8001000000000001
TINY = Model(fingerprint_size=64, latent_width=4, hidden_widths=(8,), losses=Losses(candidates=2))


def stored(spark, rows, width=18):
    """Rows of id, indices, counts and split, by place."""
    full = [(cid, i, c, [0.0] * width, s, k) for k, (cid, i, c, s) in enumerate(rows)]
    return spark.createDataFrame(full, f"{SHARD_ROW}, row_idx long")


def manifest_of(parts, size=4096):
    return {"shards": parts, "row_count": sum(s["row_count"] for s in parts), "bit_counts": [], "preprocessing": {"fingerprint_size": size}}


# -- shards -------------------------------------------------------------------------------------------


def test_range_of_a_shard(spark, tmp_path):
    four = [(1000 + i, [i + 1, i + 11], [i + 2, i + 3], "train" if i % 2 == 0 else "validation") for i in range(4)]
    folder = str(tmp_path / "rows")
    parts = shards.write_shards(stored(spark, four), folder)
    assert [(s["shard_id"], s["row_count"], s["nnz"]) for s in parts] == [(0, 4, 8)]
    manifest = manifest_of(parts)
    got = shards.read_range(spark, folder, manifest, 0, 1, 3).orderBy("row_in_shard").collect()
    assert [(r.cid, r.indices, r.counts, r.split) for r in got] == [(1001, [2, 12], [3, 4], "validation"), (1002, [3, 13], [4, 5], "train")]
    assert shards.read_range(spark, folder, manifest, 0, 2, 2).count() == 0
    for bad in ((3, 5), (3, 2), (-1, 2)):
        with pytest.raises(shards.ShardError):
            shards.read_range(spark, folder, manifest, 0, *bad)
    with pytest.raises(shards.ShardError):
        shards.read_range(spark, folder, manifest, 1, 0, 1)
    everything = shards.read_shards(spark, folder, manifest)
    assert shards.row_at(everything, 0, 3).first().cid == 1003 and shards.row_at(everything, 0, 4).first() is None
    assert {r.cid for r in shards.of_split(everything, "train").collect()} == {1000, 1002}


def test_range_reaches_the_scan(spark, tmp_path):
    folder = str(tmp_path / "rows")
    parts = shards.write_shards(stored(spark, [(i, [1], [1], "train") for i in range(50)]), folder, rows_per_shard=20)
    assert [(s["shard_id"], s["row_count"]) for s in parts] == [(0, 20), (1, 20), (2, 10)]
    own = shards.read_range(spark, folder, manifest_of(parts), 1, 5, 9)
    assert sorted(r.cid for r in own.collect()) == [25, 26, 27, 28]
    plan = own._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(row_in_shard,5)" in plan and "PartitionFilters: [isnotnull(shard_id" in plan


@pytest.mark.parametrize(
    "row, says",
    [
        ((1, [3, 9], [1], "train"), "lengths"),
        ((1, [4096], [1], "train"), "an index is not below 4096"),
        ((1, [3], [65536], "train"), "a count is not from 0 to 65535"),
        ((1, [3], [1], "test"), "bad split"),
    ],
)
def test_rows_that_break_the_format(spark, tmp_path, row, says):
    with pytest.raises(PySparkException, match=says):
        shards.write_shards(stored(spark, [row]), str(tmp_path / "rows"))
    with pytest.raises(PySparkException, match="descriptors are not 18"):
        shards.write_shards(stored(spark, [(1, [3], [1], "train")], 3), str(tmp_path / "other"))


def test_split_bytes(spark):
    frame = spark.createDataFrame([("train", 0), ("validation", 1)], "s string, b int")
    assert [tuple(r) for r in frame.select(shards.split_byte(F.col("s")), shards.split_name(F.col("b"))).collect()] == [(0, "train"), (1, "validation")]
    for bad in (shards.split_byte(F.lit("x")), shards.split_name(F.lit(7))):
        with pytest.raises(PySparkException):
            frame.select(bad).collect()


def test_empty_shard(spark):
    none = shards.empty(spark)
    assert none.count() == 0
    told = shards.violations(none).first()
    assert [told[c] for c in ("lengths", "indices", "descriptors", "splits")] == [0, 0, 0, 0]
    with pytest.raises(shards.ShardError):
        shards.shard_paths("/x", {"shards": []})
    assert shards.shard_paths("/x/", {"shards": [{"path": "rows/shard_id=0"}, {"path": "/y/z"}, {"path": "s3://b/z"}]}) == ["/x/rows/shard_id=0", "/y/z", "s3://b/z"]


def test_shape(spark):
    with pytest.raises(shards.ShardError):
        shards.check_shape(manifest_of([], 4096), TINY)
    shards.check_shape(manifest_of([], 64), TINY)


# -- the cache ----------------------------------------------------------------------------------------


def records(spark):
    rows = [("702", "CCO"), ("703", "("), ("704", "O"), ("not-a-cid", "CC"), ("705", "c1ccccc1"), ("706", "CC(=O)O")]
    return molecules.dataset_records(spark.createDataFrame(rows, "record_id string, smiles string"), "pubchem-smiles")


def test_cache_round_trip(spark, tmp_path):
    config = Preprocessing(fingerprint_size=64, quality=QualityFilter(min_heavy_atoms=2))
    folder = str(tmp_path / "cache")
    manifest = preprocess.write_cache(preprocess.process(records(spark), config), folder, "pubchem-smiles", config, rows_per_shard=2)
    assert (manifest["row_count"], manifest["skipped_count"], manifest["error_count"]) == (3, 1, 2)
    assert [s["row_count"] for s in manifest["shards"]] == [2, 1]
    again = preprocess.read_manifest(spark, f"{folder}/manifest.json")
    assert again == manifest and preprocess.reusable(again, "pubchem-smiles", config)
    assert not preprocess.reusable(again, "zinc20-smiles", config) and not preprocess.reusable(again, "pubchem-smiles", Preprocessing(radius=3, fingerprint_size=64, quality=config.quality))
    rows = shards.read_shards(spark, folder, again)
    assert [r.cid for r in rows.orderBy("shard_id", "row_in_shard").collect()] == [702, 705, 706]
    assert not [f for f in os.listdir(folder) if f.startswith("_stage")]
    filled = preprocess.backfilled(spark, folder, again | {"bit_counts": []})
    assert filled["bit_counts"] == manifest["bit_counts"] and sum(manifest["bit_counts"]) == sum(s["nnz"] for s in manifest["shards"])
    assert preprocess.bit_frequencies(filled) == [n / 3 for n in manifest["bit_counts"]]
    assert preprocess.bit_frequencies(preprocess.empty_manifest("x", config)) is None


def test_places(spark, monkeypatch):
    """Each once, by source, however small the buckets."""
    rows = [(cid, [1], [1], part) for part, n in ((0, 40), (1, 25)) for cid in range(100 * part, 100 * part + n)] + [(7, [1], [1], 0)]
    frame = spark.createDataFrame(rows, "cid long, indices array<int>, counts array<int>, part int")
    for numbered in (1_000_000, 6):
        monkeypatch.setattr(preprocess, "NUMBERED", numbered)
        got = preprocess.with_places(frame, "part").collect()
        assert sorted(r.row_idx for r in got) == list(range(66)) and all((r.row_idx < 41) == (r.cid < 100) for r in got)
    assert [r.row_idx for r in preprocess.with_places(frame.where("false"), "part").collect()] == []


def test_bit_frequencies(spark, tmp_path):
    folder = str(tmp_path / "rows")
    parts = shards.write_shards(stored(spark, [(1, [3, 9], [1, 1], "train"), (2, [3, 100], [1, 1], "train"), (3, [9], [1], "train")]), folder, rows_per_shard=2)
    manifest = preprocess.backfilled(spark, folder, manifest_of(parts))
    f = preprocess.bit_frequencies(manifest)
    assert [round(f[i], 6) for i in (3, 9, 100, 0)] == [0.666667, 0.666667, 0.333333, 0.0]


def test_empty_cache(spark, tmp_path):
    config = Preprocessing(fingerprint_size=64)
    none = preprocess.process(records(spark).where("false"), config)
    manifest = preprocess.write_cache(none, str(tmp_path / "cache"), "pubchem-smiles", config)
    assert manifest["shards"] == [] and manifest["row_count"] == 0 and manifest["bit_counts"] == [0] * 64


def test_manifest_path(spark, tmp_path):
    there = tmp_path / "m.json"
    there.write_text("{}")
    assert preprocess.manifest_path(spark, str(tmp_path)) == (f"{tmp_path}/manifest.json", str(tmp_path))
    assert preprocess.manifest_path(spark, f"{tmp_path}/new") == (f"{tmp_path}/new/manifest.json", f"{tmp_path}/new")
    assert preprocess.manifest_path(spark, str(there)) == (str(there), None)


# -- sources ------------------------------------------------------------------------------------------


def texts(frame):
    return [r.smiles for r in frame.collect()]


def test_smi(spark, tmp_path):
    (tmp_path / "a.smi").write_text("CCO\n\n# a comment\n  c1ccccc1\tbenzene \nCC.O\n")
    assert texts(molecules.read_molecules(spark, f"{tmp_path}/a.smi")) == ["CCO", "c1ccccc1", "CC.O"]
    assert texts(molecules.read_stdin(spark, ["CCO x\n", "\n", "#\n"])) == ["CCO"]


def test_delimited(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("name\tsmiles\nx\t CCO \ny\t\nz\tCC\n")
    (tmp_path / "a.csv").write_text('smiles,note\n"CCO","a ""quoted"" note, of two\nlines"\nCC,x\n')
    (tmp_path / "none.csv").write_text("Smiles,b\nC,1\n")
    (tmp_path / "ragged.csv").write_text("smiles,b\nC,1\nCC\n")
    assert texts(molecules.read_molecules(spark, f"{tmp_path}/a.tsv")) == ["CCO", "CC"]
    assert texts(molecules.read_molecules(spark, f"{tmp_path}/a.csv")) == ["CCO", "CC"]
    with pytest.raises(ValueError, match="no column"):
        molecules.read_molecules(spark, f"{tmp_path}/none.csv")
    with pytest.raises(Exception, match="(?s)MALFORMED"):
        molecules.read_molecules(spark, f"{tmp_path}/ragged.csv").collect()


@pytest.mark.parametrize("name, pack", [("a.mgf", bytes), ("a.mgf.gz", gzip.compress), ("a.mgf.zst", lambda x: zstandard.compress(x))])
def test_mgf(spark, tmp_path, name, pack):
    (tmp_path / name).write_bytes(pack(b"BEGIN IONS\nSMILES=CCO\n1 2\nEND IONS\n\nBEGIN IONS\nTITLE=x\nEND IONS\nBEGIN IONS\nSMILES=CC\nEND IONS\n"))
    assert texts(molecules.read_molecules(spark, f"{tmp_path}/{name}")) == ["CCO", "CC"]


def test_datasets(spark, tmp_path):
    (tmp_path / "p.tsv").write_text("702\tCCO\nx\tCC\n")
    got = molecules.read_pubchem(spark, f"{tmp_path}/p.tsv").collect()
    assert [(r.stable_id, r.status) for r in got] == [(702, "ok"), (None, "error")] and "bad record id" in got[1].error
    for i in (1, 2, 3):
        (tmp_path / f"chunk-{i}.smi").write_text(f"C{'C' * i} ZINC{i}_1\n")
    assert sorted(r.record_id for r in molecules.read_zinc20(spark, str(tmp_path), 2, 3, "chunk-{}.smi").collect()) == ["ZINC2_1", "ZINC3_1"]
    with pytest.raises(ValueError):
        molecules.read_zinc20(spark, str(tmp_path), 0, 3)
    assert molecules.chunk_range("3") == (3, 3) and molecules.chunk_range("1..=5") == (1, 5) and molecules.chunk_range("2-4") == (2, 4)
    for bad in ("0-2", "5-2", "1-21", "x"):
        with pytest.raises(ValueError):
            molecules.chunk_range(bad)
    assert molecules.source_label(["zinc20", "pubchem"], (1, 5)) == "pubchem-smiles + zinc20-smiles chunks 1..=5"
    for bad in ((["pubchem", "pubchem"],), (["x"],), (["pubchem"], (1, 2))):
        with pytest.raises(ValueError):
            molecules.source_label(*bad)


def test_extensions(spark):
    assert [molecules.compound_extension(p) for p in ("a.SMI", "x/a.mgf.gz", "a.mgf.zstd", "noext", "a.b.csv")] == ["smi", "mgf.gz", "mgf.zstd", "", "csv"]
    for bad in ("a.txt", "noext", "a.gz"):
        with pytest.raises(ValueError):
            molecules.read_molecules(spark, bad)


# -- sinks --------------------------------------------------------------------------------------------


def rows_of(spark):
    return spark.createDataFrame([("C,C", 0.5, 0.25, float("nan"), [1.0, -2.0, 0.125])], "smiles string, count_tanimoto float, binary_tanimoto float, log_mse float, latent array<float>").coalesce(1)


def part_text(folder):
    return "".join(open(os.path.join(folder, f)).read() for f in sorted(os.listdir(folder)) if f.startswith("part"))


def test_text_sinks(spark, tmp_path, capsys):
    encodings.write_encodings(rows_of(spark).na.fill(0.75), f"{tmp_path}/o.tsv", 3)
    head, line = part_text(tmp_path / "o.tsv").splitlines()
    assert head.split("\t") == ["smiles", "count_tanimoto", "binary_tanimoto", "log_mse", "latent_0", "latent_1", "latent_2"]
    assert line.split("\t") == ["C,C", "0.5000000", "0.2500000", "0.7500000", "1.0000000", "-2.0000000", "0.1250000"]
    encodings.write_encodings(rows_of(spark), f"{tmp_path}/o.csv", 3)
    assert part_text(tmp_path / "o.csv").splitlines()[1].startswith('"C,C",0.5000000')
    encodings.write_encodings(rows_of(spark), "-", 3)
    assert capsys.readouterr().out.splitlines()[1].startswith("C,C\t0.5000000")
    encodings.write_encodings(rows_of(spark), f"{tmp_path}/o.jsonl", 3)
    text = part_text(tmp_path / "o.jsonl")
    assert list(json.loads(text)) == ["smiles", "count_tanimoto", "binary_tanimoto", "log_mse", "latent"] and json.loads(text)["log_mse"] is None


@pytest.mark.parametrize("name, codec", [(None, "SNAPPY"), ("none", "UNCOMPRESSED"), ("uncompressed", "UNCOMPRESSED"), ("zstd", "ZSTD"), ("gzip", "GZIP")])
def test_parquet_sink(spark, tmp_path, name, codec):
    import pyarrow.parquet as pq

    encodings.write_encodings(rows_of(spark), f"{tmp_path}/o.parquet", 3, name)
    assert spark.read.parquet(f"{tmp_path}/o.parquet").first().latent == [1.0, -2.0, 0.125]
    file = next(f for f in os.listdir(tmp_path / "o.parquet") if f.endswith(".parquet"))
    assert pq.ParquetFile(tmp_path / "o.parquet" / file).metadata.row_group(0).column(0).compression == codec


def test_bad_sinks(spark, tmp_path):
    with pytest.raises(ValueError):
        encodings.write_encodings(rows_of(spark), f"{tmp_path}/o.parquet", 3, "lz9")
    with pytest.raises(ValueError):
        encodings.write_encodings(rows_of(spark), f"{tmp_path}/o.xml", 3)
    for kind in ("tsv", "parquet"):
        with pytest.raises(PySparkException):
            encodings.write_encodings(rows_of(spark), f"{tmp_path}/w.{kind}", 4)


# -- streams, embedding and jobs ----------------------------------------------------------------------


def test_stream_equals_batch(spark, tmp_path):
    os.makedirs(tmp_path / "in")
    (tmp_path / "in" / "a.smi").write_text("CCO\n# x\n(\nc1ccccc1\n")
    (tmp_path / "in" / "b.smi").write_text("CC(=O)O x\n")
    weights = model.initial_weights(TINY)
    streams.stream_embed(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/check", weights, TINY).awaitTermination()
    got = {r.smiles: list(r.latent) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {r.smiles: list(r.latent) for r in embed.embed(molecules.read_smi(spark, f"{tmp_path}/in"), weights, TINY).collect()}
    assert got == want and set(got) == {"CCO", "c1ccccc1", "CC(=O)O"}
    bits = streams.stream_bit_counts(spark, f"{tmp_path}/in", TINY)
    q = bits.writeStream.format("memory").queryName("bits").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    want = embed.fingerprinted(molecules.read_smi(spark, f"{tmp_path}/in"), TINY).select(F.explode("indices").alias("idx")).groupBy("idx").count()
    assert sorted(map(tuple, spark.table("bits").collect())) == sorted(map(tuple, want.collect()))


def test_embed_keeps_rows_and_keys(spark):
    rows = spark.createDataFrame([(5, "CCO"), (1, "("), (9, "CC")], "k long, smiles string")
    weights = model.initial_weights(TINY)
    got = {r.k: r for r in embed.embed_all(rows, weights, TINY, "k").collect()}
    assert set(got) == {1, 5, 9} and got[1].latent is None and len(got[5].latent) == 4 and got[9].smiles == "CC"
    assert [r.k for r in embed.skipped(rows, ("k",)).collect()] == [1]
    none = embed.embed(rows.where("false").select("smiles"), weights, TINY)
    assert none.count() == 0


def quoted_text(n):
    """Rows of a name, a SMILES and a note, with line ends, separators and quotes in quoted fields, and quotes in unquoted ones."""
    import random

    r, out = random.Random(n), []
    for k in range(n):
        note = r.choice(["plain", 'two\nlines', 'a "quoted" word', "comma, here", "\n\n", 'ends with "', '"', "x\ny\nz,\n", ""])
        raw = r.choice([None, None, None, f'5" pipe {k}', f'a"b"c{k}'])
        out.append((f"n{k}", "C" * (1 + k % 9), raw or '"' + note.replace('"', '""') + '"'))
    return "name,smiles,note\n" + "\n".join(",".join(x) for x in out) + "\n", [x[1] for x in out]


@pytest.mark.parametrize("n", [1, 40, 2500])
def test_quoted_line_ends_in_many_tasks(spark, tmp_path, n):
    """What a csv reader gives in one piece, read in many splits that begin anywhere."""
    import csv
    import io

    os.makedirs(tmp_path / "in.csv")
    texts = [quoted_text(n), quoted_text(n + 1)]
    for name, (text, _) in zip("ab", texts, strict=True):
        (tmp_path / "in.csv" / f"{name}.csv").write_text(text)
    want = [r["smiles"] for text, _ in texts for r in csv.DictReader(io.StringIO(text, newline=""))]
    assert want == [s for _, own in texts for s in own]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        got = [r.smiles for r in molecules.in_order(molecules.read_delimited(spark, f"{tmp_path}/in.csv", ",", places=True)).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == want


def test_bad_quoted_files(spark, tmp_path):
    (tmp_path / "ragged.csv").write_text('a,smiles\n"x\ny",C\n1,CC,3\n')
    (tmp_path / "open.csv").write_text('a,smiles\n1,C\n"never closed,CC\n2,O\n')
    (tmp_path / "crlf.csv").write_text('a,smiles\r\n"x\r\ny",C\r\n2,O\r\n', newline="")
    for name, what in (("ragged", "MALFORMED"), ("open", "left open")):
        with pytest.raises(Exception, match=f"(?s){what}"):
            molecules.read_delimited(spark, f"{tmp_path}/{name}.csv", ",").collect()
    assert [r.smiles for r in molecules.in_order(molecules.read_delimited(spark, f"{tmp_path}/crlf.csv", ",", places=True)).collect()] == ["C", "O"]


def test_input_order(spark, tmp_path):
    """Two files in many splits come out as they are written, with what can't be read left out."""
    many = [["C" * (1 + (7 * k + f) % 40) + "O" * (k % 3) if k % 11 else "(" for k in range(3000)] for f in (0, 1)]
    os.makedirs(tmp_path / "in.smi")
    for f, lines in enumerate(many):
        (tmp_path / "in.smi" / f"{'ba'[f]}.smi").write_text("\n".join(lines) + "\n")
    want = [s for s in many[1] + many[0] if s != "("]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        read = molecules.read_molecules(spark, f"{tmp_path}/in.smi", places=True)
        assert read.rdd.getNumPartitions() > 8
        rows = embed.embed(molecules.in_order(read), model.initial_weights(TINY), TINY)
        encodings.write_encodings(rows, f"{tmp_path}/out.tsv", 4)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    got = [x.split("\t")[0] for x in part_text(tmp_path / "out.tsv").splitlines() if not x.startswith("smiles\t")]
    assert got == want
    (tmp_path / "t.csv").write_text("a,smiles\n1,CC\n2,O\n")
    assert [r.smiles for r in molecules.in_order(molecules.read_molecules(spark, f"{tmp_path}/t.csv", places=True)).collect()] == ["CC", "O"]
    rows.select("smiles").write.parquet(f"{tmp_path}/t.parquet")
    assert [r.smiles for r in molecules.in_order(molecules.read_molecules(spark, f"{tmp_path}/t.parquet", places=True)).collect()] == want
    assert [r.smiles for r in molecules.in_order(molecules.read_stdin(spark, ["N x", "C", "O"], places=True)).collect()] == ["N", "C", "O"]


def test_jobs(spark, tmp_path, capsys):
    lines = [f"{702 + i}\t{s}" for i, s in enumerate(["CCO", "CCN", "CCC", "c1ccccc1", "CC(=O)O", "(", "C#N", "CCCl", "CCBr", "OCCO", "c1ccncc1", "CCS"] * 4)]
    (tmp_path / "p.tsv").write_text("\n".join(lines) + "\n")
    args = [f"{tmp_path}/cache", f"{tmp_path}/run", "--datasets", "pubchem", "--pubchem", f"{tmp_path}/p.tsv", "--fingerprint-size", "64", "--latent-width", "4", "--hidden-widths", "8", "--batch-size", "10", "--tanimoto-ranking-candidates", "3", "--learning-rate", "0.01", "--metric-every", "2", "--replicas", "2"]
    told = jobs.main(["train", *args, "--epochs", "3"])
    losses = [e["train"]["total"] for e in told["epochs"]]
    assert losses[-1] < losses[0] and all(math.isfinite(x) for x in losses) and told["epochs"][0]["train"]["valid_pairs"] > 0
    state = json.loads((tmp_path / "run" / "state.json").read_text())
    # Each batch is a step, and the metrics are those of step 1 and the even ones.
    per_epoch = told["epochs"][0]["train"]["batches"]
    assert per_epoch >= 4 and state["completed_epoch"] == 3 and state["optimizer_steps"] == 3 * per_epoch == told["steps"]
    more = jobs.main(["train", *args, "--epochs", "1", "--resume"])
    assert more["steps"] == 4 * per_epoch
    assert more["epochs"][0]["epoch"] == 4 and more["epochs"][0]["train"]["total"] < losses[0]
    assert "using_cached_manifest" in capsys.readouterr().out
    (tmp_path / "in.smi").write_text("CCO\n(\nCC(=O)O\n")
    assert jobs.main(["embed", f"{tmp_path}/in.smi", f"{tmp_path}/out.parquet", "--checkpoint", f"{tmp_path}/run"]) == {"skipped": 1}
    assert spark.read.parquet(f"{tmp_path}/out.parquet").count() == 2
    jobs.main(["embed", f"{tmp_path}/in.smi", f"{tmp_path}/out.tsv", "--checkpoint", f"{tmp_path}/run", "--batch-size", "1"])
    assert len(part_text(tmp_path / "out.tsv").splitlines()) == 3
    for bad in (["train", "a", "b", "--epochs", "0"], ["embed", "a", "b"], ["train", "a", "b", "--ecfp-radius", "0"], ["train", "a", "b", "--zinc20-chunks", "0-3"]):
        with pytest.raises((SystemExit, ValueError)):
            jobs.main(bad)


def test_sql_names(spark):
    assert set(registry.register(spark)) == {"count_tanimoto", "binary_tanimoto", "smiles_descriptors", "stable_molecule_id", "split_for_id"}
    got = spark.sql("SELECT count_tanimoto(array(0, 2), array(2, 1), array(0, 1, 2), array(1, 3, 1)) AS c, binary_tanimoto(array(0, 2), array(0, 1)) AS b, count_tanimoto(CAST(array() AS ARRAY<INT>), CAST(array() AS ARRAY<INT>), CAST(array() AS ARRAY<INT>), CAST(array() AS ARRAY<INT>)) AS e").first()
    assert abs(got.c - 1 / 3) < 1e-9 and abs(got.b - 1 / 3) < 1e-9 and got.e == 1.0
    got = spark.sql("SELECT stable_molecule_id('pubchem-smiles', '702') AS p, split_for_id(702, 100) AS s, stable_molecule_id('zinc20-smiles', 'ZINC000000000001_1') AS z, smiles_descriptors('CCO').molecular_mass AS m, smiles_descriptors('(').carbon_count AS n").first()
    assert got.p == 702 and got.s == "train" and got.z % (1 << 64) == ZINC_ID and abs(got.m - 46.069) < 0.01 and got.n is None
