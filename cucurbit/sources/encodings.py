"""Writers of encodings: smiles, three measures and the latent vector."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMPRESSIONS = {None: "snappy", "snappy": "snappy", "none": "none", "uncompressed": "none", "zstd": "zstd", "gzip": "gzip"}
MEASURES = ["count_tanimoto", "binary_tanimoto", "log_mse"]


def text_columns(encodings: DataFrame, width: int) -> DataFrame:
    """Seven decimals, the latent vector as latent_0 on; another width is an error."""
    latent = F.when(F.size("latent") == width, F.col("latent")).otherwise(F.raise_error(F.concat(F.lit(f"latent width is not {width}: "), F.size("latent"))))
    checked = encodings.withColumn("__latent", latent)
    number = lambda c: F.format_string("%.7f", c.cast("double"))
    return checked.select("smiles", *(number(F.col(m)).alias(m) for m in MEASURES), *(number(F.get("__latent", F.lit(i))).alias(f"latent_{i}") for i in range(width)))


def json_columns(encodings: DataFrame) -> DataFrame:
    """Values that are no finite number are null."""
    clean = lambda c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
    return encodings.select("smiles", *(clean(F.col(m)).alias(m) for m in MEASURES), F.transform("latent", clean).alias("latent"))


def write_encodings(encodings: DataFrame, path: str, latent_width: int, compression: str | None = None, mode: str = "errorifexists") -> None:
    """By the path's extension, as a folder of part files; '-' prints tab-separated rows."""
    if path in ("-", "/dev/stdout"):
        rows = text_columns(encodings, latent_width)
        print("\t".join(rows.columns))
        for r in rows.toLocalIterator():
            print("\t".join(r))
        return
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    if kind in ("csv", "tsv"):
        text_columns(encodings, latent_width).write.mode(mode).csv(path, header=True, sep="," if kind == "csv" else "\t", escape='"')
    elif kind == "jsonl":
        json_columns(encodings).write.mode(mode).option("ignoreNullFields", False).json(path)
    elif kind == "parquet":
        if compression not in COMPRESSIONS:
            raise ValueError(f"unknown compression {compression!r}")
        checked = encodings.withColumn("latent", F.when(F.size("latent") == latent_width, F.col("latent")).otherwise(F.raise_error(F.lit("latent width differs"))))
        checked.write.mode(mode).option("compression", COMPRESSIONS[compression]).parquet(path)
    else:
        raise ValueError(f"no writer for {path!r}")
