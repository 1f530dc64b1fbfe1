"""Molecule files as DataFrames with a ``smiles`` column, and dataset records."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ids import record_status, stable_molecule_id

STDIN = ("-", "/dev/stdin")


def compound_extension(path: str) -> str:
    """The lower-case extension; compressed MGF keeps both parts."""
    name = path.rstrip("/").rsplit("/", 1)[-1].lower()
    parts = name.split(".")
    if len(parts) < 2:
        return ""
    if parts[-1] in ("gz", "gzip", "zst", "zstd") and len(parts) > 2:
        return ".".join(parts[-2:])
    return parts[-1]


def trim(c: Column) -> Column:
    return F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def smi_lines(lines: DataFrame, column: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """Trimmed lines without blank and # lines; the first word is the SMILES, beside the columns to keep."""
    kept = lines.select(*keep, trim(F.col(column)).alias("__line")).where((F.col("__line") != "") & ~F.col("__line").startswith("#"))
    return kept.select(*keep, F.split("__line", r"\s+", 2)[0].alias("smiles"))


#: Where a row was read: its file, the start of the split, and a number that ascends within the split.
PLACE = ("place_file", "place_split", "place_row")


def with_places(rows: DataFrame, of_files: bool = True) -> DataFrame:
    """rows as a reader gives them, with PLACE."""
    file, split = (F.col("_metadata.file_path"), F.col("_metadata.file_block_start")) if of_files else (F.lit(""), F.lit(0).cast("long"))
    return rows.select("*", file.alias(PLACE[0]), split.alias(PLACE[1]), F.monotonically_increasing_id().alias(PLACE[2]))


def in_order(rows: DataFrame) -> DataFrame:
    """rows with PLACE, ranged and sorted by it, without it: files by path, and each as it is written, however it was split.

    What follows should be narrow, as an embedding is: partitions, and so part files, then keep this order.
    """
    return rows.orderBy(*PLACE).drop(*PLACE)


def read_smi(spark: SparkSession, path: str, places: bool = False) -> DataFrame:
    lines = spark.read.text(path)
    return smi_lines(with_places(lines), keep=PLACE) if places else smi_lines(lines)


def read_stdin(spark: SparkSession, lines: Iterable[str] | None = None, places: bool = False) -> DataFrame:
    """Lines that the driver's standard input holds."""
    rows = spark.createDataFrame([(x.rstrip("\n"),) for x in (lines if lines is not None else sys.stdin)], "value string")
    return smi_lines(with_places(rows, False), keep=PLACE) if places else smi_lines(rows)


def quoted_records(lines: DataFrame, sep: str) -> DataFrame:
    """lines: value, without its line end, and PLACE.  The records they make, as value with the PLACE of their first line.

    A line ends a record or leaves a quoted field open, depending on whether it begins inside one: it
    keeps that state, turns it or ends in one of the two whatever came before.  Such steps add up, so
    each split is read by itself, its lines from the last fixed state on by the parity of turns, and the
    splits of a file are added up in a row for each.  Only lines of records of several are grouped.
    A quoted field that a file leaves open is an error.
    """
    file, split, row = PLACE
    d = "\\t" if sep == "\t" else re.escape(sep)
    rest = f'[^"]*+(?:""[^"]*+)*+"[^{d}]*+'
    field = f'(?:"{rest}|[^"{d}][^{d}]*+|)'
    ends = {k: F.col("value").rlike(f"^{head}(?:{d}{field})*+$") for k, head in (("__from_start", field), ("__from_open", rest))}
    turn = (~F.col("__from_start") & F.col("__from_open")).cast("int")
    fixed = F.when(F.col("__from_start") == F.col("__from_open"), (~F.col("__from_start")).cast("int"))
    own = Window.partitionBy(file, split).orderBy(row)
    so_far, before = own.rowsBetween(Window.unboundedPreceding, 0), own.rowsBetween(Window.unboundedPreceding, -1)
    marked = lines.withColumns(ends).withColumns({"__turn": turn, "__fixed": fixed}).withColumn("__turns", F.sum("__turn").over(so_far))
    at_fixed = F.when(F.col("__fixed").isNotNull(), F.struct(F.col("__fixed").alias("state"), F.col("__turns").alias("turns")))
    marked = marked.withColumn("__known", F.last(at_fixed, ignorenulls=True).over(before))

    def state(known: Column, turns: Column, incoming: Column) -> Column:
        """Whether a quoted field is open, after so many turns in all and the last fixed state before."""
        return F.pmod(F.when(known.isNull(), incoming + turns).otherwise(known["state"] + turns - known["turns"]), F.lit(2))

    # Of each split, what it does to the state that it begins with.
    sums = marked.groupBy(file, split).agg(F.max_by("__turns", row).alias("__turn"), F.max_by(F.coalesce(at_fixed, "__known"), row).alias("__last"))
    by_file = Window.partitionBy(file).orderBy(split)
    earlier = by_file.rowsBetween(Window.unboundedPreceding, -1)
    # A split with a fixed state ends in one; the others turn it so many times.
    sums = sums.withColumn("__end", F.when(F.col("__last").isNotNull(), F.pmod(F.col("__last.state") + F.col("__turn") - F.col("__last.turns"), F.lit(2))))
    sums = sums.withColumn("__total", F.sum("__turn").over(by_file.rowsBetween(Window.unboundedPreceding, 0)))
    end = F.when(F.col("__end").isNotNull(), F.struct(F.col("__end").alias("state"), F.col("__total").alias("turns")))
    sums = sums.withColumn("__incoming", state(F.last(end, ignorenulls=True).over(earlier), F.coalesce(F.sum("__turn").over(earlier), F.lit(0)), F.lit(0)))
    joined = marked.join(sums.select(file, split, "__incoming"), [file, split])
    joined = joined.withColumn("__open", state(F.col("__known"), F.col("__turns") - F.col("__turn"), F.col("__incoming")))
    joined = joined.withColumn("__after", F.when(F.col("__open") == 1, ~F.col("__from_open")).otherwise(~F.col("__from_start")))
    # What is asked of records must not be asked of lines that make none: a column that isn't deterministic holds filters back.
    held = lambda c: F.when(F.monotonically_increasing_id() >= 0, c).alias("value")
    single = joined.where("__open = 0 AND NOT __after").select(held(F.col("value")), *PLACE)
    several = joined.where("__open = 1 OR __after")
    # The first line of each line's record: in its split, or the last one of the splits before.
    several = several.withColumn("__first", F.last(F.when(F.col("__open") == 0, F.struct(split, row)), ignorenulls=True).over(Window.partitionBy(file).orderBy(split, row).rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.array_sort(F.collect_list(F.struct(split, row, "value", "__after")))
    records = several.groupBy(file, "__first").agg(parts.alias("__lines"))
    whole = F.when(F.element_at("__lines", -1)["__after"], F.raise_error(F.concat(F.lit("a quoted field is left open in "), F.col(file)))).otherwise(F.array_join("__lines.value", "\n"))
    return single.unionByName(records.select(held(whole.cast("string")), file, F.col(f"__first.{split}").alias(split), F.col(f"__first.{row}").alias(row)))


def read_delimited(spark: SparkSession, path: str, sep: str, smiles_column: str = "smiles", multi_line: bool = True, places: bool = False) -> DataFrame:
    """A file with a header; the column's name must match exactly, and rows of another width are errors.

    Line ends inside quotes are part of a field; a file is read in many tasks all the same, and rows come
    in its order.  ``multi_line=False`` says that there are none, and spares the shuffles that this takes.
    """
    header = spark.read.option("header", False).option("sep", sep).option("quote", '"').option("escape", '"').csv(path).first()
    names = [] if header is None else list(header)
    if smiles_column not in names:
        raise ValueError(f"{path} has no column {smiles_column!r}")
    at = names.index(smiles_column)
    schema = ", ".join(f"c{i} string" for i in range(len(names)))
    if multi_line:
        lines = with_places(spark.read.option("lineSep", "\n").text(path))
        records = quoted_records(lines, sep).withColumn("value", F.regexp_replace("value", "\r$", ""))
        # The first record of a file is its header.
        heads = records.where(F.col(PLACE[1]) == 0).groupBy(PLACE[0]).agg(F.min(PLACE[2]).alias("__head"))
        body = records.join(heads, PLACE[0]).where(~((F.col(PLACE[1]) == 0) & (F.col(PLACE[2]) == F.col("__head"))) & (F.trim("value") != ""))
        parsed = F.from_csv("value", schema, {"sep": sep, "quote": '"', "escape": '"', "mode": "FAILFAST"})
        rows = body.select(*PLACE, parsed.alias("__c")).select(*PLACE, "__c.*")
    else:
        rows = spark.read.schema(schema).csv(path, header=True, sep=sep, mode="FAILFAST", quote='"', escape='"', enforceSchema=True)
        rows = with_places(rows) if places else rows
    # All columns are kept until here: with one pruned, ragged rows would pass.
    value = F.when(F.struct(*(f"c{i}" for i in range(len(names)))).isNotNull(), trim(F.col(f"c{at}")))
    known = places or multi_line
    out = rows.select(*(PLACE if known else ()), value.alias("smiles")).where(F.col("smiles").isNotNull() & (F.col("smiles") != ""))
    return in_order(out) if multi_line and not places else out


def read_mgf(spark: SparkSession, path: str, places: bool = False) -> DataFrame:
    """The SMILES= value of each record that has one; compressed files are read as they are."""
    records = spark.read.option("lineSep", "END IONS").text(path)
    found = F.regexp_extract("value", r"(?m)^SMILES=(.*?)\r?$", 1)
    records = with_places(records) if places else records
    return records.where(F.col("value").contains("BEGIN IONS")).select(*(PLACE if places else ()), found.alias("smiles")).where(F.col("smiles") != "")


def read_molecules(spark: SparkSession, path: str, smiles_column: str = "smiles", places: bool = False) -> DataFrame:
    """By the path's extension; unknown ones are errors.  With ``places``, each row's PLACE beside it."""
    if path in STDIN:
        return read_stdin(spark, places=places)
    kind = compound_extension(path)
    if kind in ("smi", "smiles"):
        return read_smi(spark, path, places)
    if kind in ("csv", "tsv"):
        return read_delimited(spark, path, "," if kind == "csv" else "\t", smiles_column, places=places)
    if kind == "mgf" or kind.startswith("mgf."):
        return read_mgf(spark, path, places)
    if kind == "parquet":
        rows = spark.read.parquet(path)
        rows = with_places(rows) if places else rows
        return rows.select(*(PLACE if places else ()), F.col(smiles_column).alias("smiles"))
    raise ValueError(f"no reader for {path!r}")


def dataset_records(rows: DataFrame, dataset: str) -> DataFrame:
    """rows: record_id, smiles.  Adds dataset_id, stable_id, status and, for ids that can't be read, an error."""
    name = F.lit(dataset)
    status = record_status(name, F.col("record_id"))
    out = rows.withColumn("dataset_id", name).withColumn("status", status)
    error = F.when(F.col("status") == "error", F.concat_ws(":", "dataset_id", "record_id", F.lit(" bad record id")))
    return out.withColumn("stable_id", F.when(F.col("status") == "ok", stable_molecule_id(name, F.col("record_id")))).withColumn("error", error).select("dataset_id", "record_id", "stable_id", "smiles", "status", "error")


def read_pubchem(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated dump of record id and SMILES, compressed or not."""
    return dataset_records(spark.read.csv(path, sep="\t", schema="record_id string, smiles string", mode="FAILFAST"), "pubchem-smiles")


def read_zinc20(spark: SparkSession, folder: str, first: int = 1, last: int = 20, chunk: str = "chunk={}") -> DataFrame:
    """Chunks first to last of 20, of SMILES and record id; ``chunk`` names the folder or file of one, and others are not read."""
    if not 1 <= first <= last <= 20:
        raise ValueError(f"chunks must be within 1 to 20: {first} to {last}")
    paths = [f"{folder.rstrip('/')}/{chunk.format(i)}" for i in range(first, last + 1)]
    return dataset_records(spark.read.csv(paths, sep=" ", schema="smiles string, record_id string", mode="FAILFAST"), "zinc20-smiles")


def chunk_range(text: str) -> tuple[int, int]:
    """'3', '1-5' or '1..=5', within 1 to 20."""
    first, _, last = text.replace("..=", "-").partition("-")
    try:
        low, high = int(first), int(last or first)
    except ValueError:
        raise ValueError(f"no chunk range: {text!r}") from None
    if not 1 <= low <= high <= 20:
        raise ValueError(f"chunks must be within 1 to 20: {text!r}")
    return low, high


def source_label(datasets: list[str], chunks: tuple[int, int] | None = None) -> str:
    """How a manifest names its sources; a dataset that is named twice, or chunks without ZINC20, are errors."""
    for d in datasets:
        if d not in ("pubchem", "zinc20"):
            raise ValueError(f"no dataset {d!r}")
        if datasets.count(d) > 1:
            raise ValueError(f"dataset {d!r} is named twice")
    if chunks and "zinc20" not in datasets:
        raise ValueError("chunks are of zinc20, which isn't among the datasets")
    first, last = chunks or (1, 20)
    names = {"pubchem": "pubchem-smiles", "zinc20": f"zinc20-smiles chunks {first}..={last}"}
    return " + ".join(names[d] for d in ("pubchem", "zinc20") if d in datasets)


def union_sources(*parts: DataFrame) -> DataFrame:
    """All rows, with the number of their source."""
    if not parts:
        raise ValueError("no source")
    out = parts[0].withColumn("source_ord", F.lit(0))
    for i, p in enumerate(parts[1:], 1):
        out = out.unionByName(p.withColumn("source_ord", F.lit(i)))
    return out
