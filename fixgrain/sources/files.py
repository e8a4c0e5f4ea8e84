"""File sources and sinks, offline and with explicit schemas."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType


def strings(*names: str) -> StructType:
    return StructType([StructField(n, StringType()) for n in names])


def read_csv(spark: SparkSession, paths: str | list[str], columns: tuple[str, ...]) -> DataFrame:
    """CSV with a header, quoted line breaks and cells of up to 8 MiB; the source file is kept for ordering."""
    reader = spark.read.schema(strings(*columns)).option("maxCharsPerColumn", 8 * 1024 * 1024)
    rows = reader.csv(paths, header=True, multiLine=True, quote='"', escape='"', encoding="UTF-8", enforceSchema=False)
    return rows.select("*", F.input_file_name().alias("_file"))


def read_json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON array or object a file."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def array_elements(text: str | None) -> list[str]:
    """The elements, as JSON, of arrays that follow each other in a text; signs inside strings are no borders."""
    decoder = json.JSONDecoder()
    out, at = [], 0
    text = (text or "").strip()
    while at < len(text):
        value, at = decoder.raw_decode(text, at)
        out += [json.dumps(x, ensure_ascii=False) for x in (value if isinstance(value, list) else [value])]
        while at < len(text) and text[at].isspace():
            at += 1
    return out


def read_joined_arrays(spark: SparkSession, path: str, element: str) -> DataFrame:
    """Files of JSON arrays that follow each other without a separator; broken text raises."""
    pieces = F.pandas_udf(lambda texts: texts.map(array_elements), ArrayType(StringType()))
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(pieces("value")).alias("piece")).select(F.from_json("piece", element).alias("r")).select("r.*")


def csv_files(spark: SparkSession, folders: list[str]) -> list[str]:
    """Paths of the CSV files of the folders, in order of folder and name; folders that do not exist are skipped."""
    jvm = spark._jvm
    out = []
    for folder in folders:
        root = jvm.org.apache.hadoop.fs.Path(folder)
        fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(root):
            names = [str(f.getPath().toString()) for f in fs.listStatus(root) if f.isFile()]
            out += sorted(n for n in names if n.endswith(".csv"))
    return out


def read_csv_folders(spark: SparkSession, folders: list[str], columns: tuple[str, ...]) -> DataFrame:
    """All rows of the folders' CSV files, with ``_order``, the place of their file in the order of csv_files. No file gives no rows."""
    paths = csv_files(spark, folders)
    if not paths:
        return spark.createDataFrame([], strings(*columns)).select("*", F.lit("").alias("_file"), F.lit(0).alias("_order"))
    rows = read_csv(spark, paths, columns)
    ends = F.array(*(F.lit(p.rstrip("/").split("/")[-2] + "/" + p.split("/")[-1]) for p in paths))
    own = F.concat_ws("/", F.element_at(F.split("_file", "/"), -2), F.element_at(F.split("_file", "/"), -1))
    return rows.withColumn("_order", F.array_position(ends, own).cast("int"))


def load_findings(spark: SparkSession, path: str, with_alias: bool = True) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows.withColumn("source", F.col("source_platform")) if with_alias and "source" not in rows.columns else rows


def write_parquet(df: DataFrame, path: str, codec: str = "zstd") -> None:
    df.write.option("compression", codec).mode("overwrite").parquet(path)


def replace_parquet(df: DataFrame, path: str) -> None:
    """Overwrite a table that the rows may come from.

    Written aside first; then the old table is renamed, the new one takes its place and the old one
    is deleted, so that one of both is whole at any time. If the second rename fails the old one is put back.
    """
    spark = df.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path
    target, aside, before = (place(path.rstrip("/") + end) for end in ("", ".new", ".old"))
    write_parquet(df, aside.toString())
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(before, True)
    had = fs.exists(target)
    if had and not fs.rename(target, before):
        raise OSError(f"could not rename {target.toString()}")
    if not fs.rename(aside, target):
        if had:
            fs.rename(before, target)
        raise OSError(f"could not rename {aside.toString()}")
    fs.delete(before, True)


def write_csv(df: DataFrame, path: str, columns: tuple[str, ...] | None = None) -> None:
    rows = df if columns is None else df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in columns))
    rows.write.mode("overwrite").csv(path, header=True, quote='"', escape='"', emptyValue="")


PREVIEW = ("source_platform", "label", "root_cause", "attack_path", "severity", "severity_estimated", "authority_tier", "title", "source_url")


def preview(df: DataFrame, columns: tuple[str, ...] = PREVIEW, title: int = 70) -> DataFrame:
    """Those of the columns that exist, titles cut."""
    kept = df.select(*(c for c in columns if c in df.columns))
    return kept.withColumn("title", F.substring("title", 1, title)) if "title" in kept.columns else kept


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def write_manifest(df: DataFrame, path: str, domain: str, report: dict) -> dict:
    """A JSON file with the domain, row count, columns and report of a table; gives its content."""
    content = {"domain": domain, "n_rows": df.count(), "schema": df.columns, "build": report}
    _write_text(df.sparkSession, path, json.dumps(content, indent=2, ensure_ascii=False))
    return content


def publish(df: DataFrame, root: str, by: str = "domain") -> None:
    """Replace only the partitions that the rows are of."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(root)


def valid_names(target: str, domain: str, owners: tuple[str, ...]) -> None:
    """Raise unless target is owner/name of an allowed owner and domain is in lower-case words joined by hyphens."""
    if not re.fullmatch(r"[\w.-]+/[\w.-]+", target):
        raise ValueError(f"not an owner and a name: {target}")
    if target.split("/")[0] not in owners:
        raise ValueError(f"owner not allowed: {target}")
    if not re.fullmatch(r"[a-z0-9]+(?:-[a-z0-9]+)*", domain):
        raise ValueError(f"not a domain: {domain}")


def stage(df: DataFrame, root: str, domain: str, report: dict, readme: str, dry_run: bool = False) -> list[str]:
    """The tree ``<root>/<domain>/`` of train.parquet, manifest.json and README.md; gives its paths.

    Only this domain's folder is replaced. A dry run writes nothing.
    """
    folder = f"{root.rstrip('/')}/{domain}"
    paths = [f"{folder}/train.parquet", f"{folder}/manifest.json", f"{folder}/README.md"]
    if not dry_run:
        replace_parquet(df, paths[0])
        write_manifest(df, paths[1], domain, report)
        _write_text(df.sparkSession, paths[2], readme)
    return paths
