"""From records to stored rows: parse, descriptors, quality filter, fingerprint, split, manifest."""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import chem
from ..functions.ids import split_for_id
from ..operators.vectors import bit_counts
from ..sources.shards import read_shards, write_shards
from ..types import Preprocessing

MANIFEST_VERSION = 2
#: Rows of a source that one task numbers, on average.
NUMBERED = 1_000_000


def process(records: DataFrame, config: Preprocessing) -> DataFrame:
    """records: as dataset_records gives them.  Adds descriptors, fingerprint, split; status is ok, skipped or error.

    The graph is computed once a row: the parser is marked as not deterministic, so that no filter repeats it.
    """
    parsed = records.withColumn("graph", F.when(F.col("status") == "ok", chem.molecule_graph(F.col("smiles"))))
    described = parsed.withColumn("descriptors", F.when(F.col("graph").isNotNull(), chem.descriptors(F.col("graph"))))
    failed = F.col("graph.error").isNotNull()
    status = F.when(F.col("status") == "error", "error").when(failed, "error").when(~config.quality.accepts(F.col("descriptors")), "skipped").otherwise("ok")
    error = F.coalesce("error", F.when(failed, F.concat_ws(":", "dataset_id", "record_id", F.concat(F.lit(" "), F.col("graph.error")))))
    routed = described.withColumn("status", status).withColumn("error", error)
    split = F.when(F.col("status") == "ok", split_for_id(F.col("stable_id"), config.validation_permille))
    # Rows that go no further keep no graph, so no fingerprint is made for them.
    kept = routed.withColumn("graph", F.when(F.col("status") == "ok", F.col("graph"))).withColumn("split", split)
    done = chem.counted_fingerprint(kept, radius=config.radius, size=config.fingerprint_size)
    return done.withColumn("fingerprint", F.when(F.col("status") == "ok", F.col("fingerprint"))).drop("graph")


def shard_rows(processed: DataFrame, *keep: str) -> DataFrame:
    ok = processed.where("status = 'ok'")
    return ok.select(F.col("stable_id").alias("cid"), "fingerprint.indices", "fingerprint.counts", chem.regression_targets(F.col("descriptors")).alias("descriptor_targets"), "split", *keep)


def with_places(rows: DataFrame, part: str, to: str = "row_idx") -> DataFrame:
    """Adds each row's place: by ``part`` (a number), and in it by buckets of ids and by the id; ``part`` goes.

    Rows are numbered within buckets of about ``NUMBERED`` rows, and the rows before a bucket are summed
    over the buckets, so no task sorts a whole source.  ``rows`` is read three times, so it should be a stored table.
    """
    buckets = max(1, -(-rows.count() // NUMBERED))
    dealt = rows.withColumn("__bucket", F.pmod(F.xxhash64("cid"), F.lit(buckets)))
    own = Window.partitionBy(part, "__bucket").orderBy("cid", F.xxhash64("indices", "counts"))
    before = Window.orderBy(part, "__bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy(part, "__bucket").agg(F.count("*").alias("__n"))
    offsets = sizes.select(part, "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    placed = dealt.withColumn("__rn", F.row_number().over(own) - 1).join(offsets, [part, "__bucket"])
    return placed.withColumn(to, F.col("__rn") + F.col("__before")).drop("__rn", "__before", "__bucket", part)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One file, in any store that Spark can write to."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(at, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at)


def is_folder(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return store.exists(at) and store.getFileStatus(at).isDirectory()


def manifest_path(spark: SparkSession, shards: str) -> tuple[str, str | None]:
    """The manifest's path and the folder of the cache: of a folder, or a path where nothing is, the manifest in it; a file is the manifest itself, and no cache is written."""
    if not exists(spark, shards) or is_folder(spark, shards):
        return f"{shards.rstrip('/')}/manifest.json", shards
    return shards, None


def bit_count_list(rows: DataFrame, size: int) -> list[int]:
    """Rows by bin, for all bins."""
    found = {r.idx: r.bit_count for r in bit_counts(rows.select(F.explode("indices").alias("idx"))).collect()}
    return [found.get(i, 0) for i in range(size)]


def empty_manifest(source: str, config: Preprocessing) -> dict:
    return {
        "manifest_version": MANIFEST_VERSION,
        "source": source,
        "preprocessing": asdict(config),
        "shards": [],
        "row_count": 0,
        "skipped_count": 0,
        "error_count": 0,
        "bit_counts": [0] * config.fingerprint_size,
    }


def write_cache(processed: DataFrame, folder: str, source: str, config: Preprocessing, rows_per_shard: int = 10_000_000, part: str | None = None) -> dict:
    """Shards of the rows that are ok, and manifest.json beside them.

    ``part``: a column with the number of a row's source, in whose order places are given; one source without it.
    Molecules are parsed once: into a Parquet stage, with the rows by status counted on the way.
    """
    spark = processed.sparkSession
    told = Observation()
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("ok", "skipped", "error")]
    stage = f"{folder.rstrip('/')}/_stage-{uuid.uuid4().hex}"
    numbered = processed.observe(told, *counts).withColumn("__part", F.col(part) if part else F.lit(0))
    shard_rows(numbered, "__part").write.parquet(stage)
    shards = write_shards(with_places(spark.read.parquet(stage), "__part"), f"{folder}/rows", config.fingerprint_size, len(chem.DESCRIPTORS), rows_per_shard, "overwrite")
    at = spark._jvm.org.apache.hadoop.fs.Path(stage)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
    manifest = empty_manifest(source, config) | {
        "shards": [s | {"path": f"rows/{s['path']}"} for s in shards],
        "row_count": sum(s["row_count"] for s in shards),
        "skipped_count": told.get["skipped"],
        "error_count": told.get["error"],
    }
    if shards:
        manifest["bit_counts"] = bit_count_list(read_shards(spark, folder, manifest), config.fingerprint_size)
    write_text(spark, f"{folder}/manifest.json", json.dumps(manifest, indent=2))
    return manifest


def read_manifest(spark: SparkSession, path: str) -> dict:
    """path: of the manifest.  Keys that older ones lack take their defaults."""
    manifest = json.loads(spark.read.text(path, wholetext=True).first()[0])
    return {"bit_counts": [], "skipped_count": 0, "error_count": 0} | manifest


def backfilled(spark: SparkSession, folder: str, manifest: dict) -> dict:
    """The manifest with its bit counts, from a scan of all shards if it has none."""
    if manifest["bit_counts"]:
        return manifest
    return manifest | {"bit_counts": bit_count_list(read_shards(spark, folder, manifest), manifest["preprocessing"]["fingerprint_size"])}


def reusable(manifest: dict, source: str, config: Preprocessing) -> bool:
    """Whether a stored table was made from this source with this configuration, filter and radius included."""
    return manifest.get("manifest_version") == MANIFEST_VERSION and manifest.get("source") == source and manifest.get("preprocessing") == json.loads(json.dumps(asdict(config)))


def bit_frequencies(manifest: dict) -> list[float] | None:
    """None for an empty table or one without counts."""
    if not manifest["row_count"] or not manifest["bit_counts"]:
        return None
    return [n / manifest["row_count"] for n in manifest["bit_counts"]]
