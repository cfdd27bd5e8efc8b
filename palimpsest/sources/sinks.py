"""Writers: fixed field lists, class buckets, manifests; published as a whole or not at all."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .folder import delete

BUCKETS = ("canonical", "stale", "unknown", "error_block")


def project(df: DataFrame, fields: list[str]) -> DataFrame:
    """The fields in order as strings; one that is missing, or null, is empty."""
    return df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit("") for c in fields)).toDF(*fields)


def distinct_destinations(paths: list[str]) -> None:
    if len({p.rstrip("/") for p in paths}) < len(paths):
        raise ValueError("two outputs have one destination")


def write_buckets(df: DataFrame, path: str) -> None:
    """One folder per class; a class outside BUCKETS fails the write."""
    known = F.when(F.col("classification").isin(*BUCKETS), F.col("classification")).otherwise(F.raise_error(F.lit("unknown class")).cast("string"))
    df.withColumn("classification", known).write.partitionBy("classification").parquet(path)


#: What the gates of stale rows say; rows whose class is final without them have none.
GATE_COLUMNS = ("validation_status", "expected_nbits", "rejection_reason")


def classifier_outputs(rows: DataFrame, columns: list[str]) -> dict[str, DataFrame]:
    """The five tables of a classifier: a table for each class, ``validated`` with the stale rows that are VALID, in ``columns`` (those that are missing are empty), error blocks with
    the rules that they break. Gate columns of canonical and unknown rows are blank. An unknown class fails the write."""
    checked = rows.withColumn("classification", F.when(F.col("classification").isin(*BUCKETS), F.col("classification")).otherwise(F.raise_error(F.lit("unknown class")).cast("string")))
    final = F.col("classification").isin("canonical", "unknown")
    for c in GATE_COLUMNS:
        if c in checked.columns:
            checked = checked.withColumn(c, F.when(final, F.lit(None).cast(checked.schema[c].dataType)).otherwise(F.col(c)))
    told = {b: checked.where(F.col("classification") == b) for b in BUCKETS}
    told["validated"] = told["stale"].where("validation_status = 'VALID'")
    with_rules = columns if "rules_violated" in columns else [*columns, "rules_violated"]
    return {name: project(df, with_rules if name == "error_block" else columns) for name, df in told.items()}


def classifier_counts(rows: DataFrame) -> DataFrame:
    """One row: rows of each class, valid ones, rejections by the class they went to, and stale rows whose validation is open."""
    c, s = F.col("classification"), F.coalesce(F.col("validation_status"), F.lit(""))
    rejected = F.startswith(s, F.lit("REJECTED"))
    counts = {b: c == b for b in BUCKETS} | {"valid": (c == "stale") & (s == "VALID"), "rejected": rejected} | {f"rejected_{b}": rejected & (c == b) for b in ("stale", "error_block", "unknown")} | {"validation_unknown": (c == "stale") & F.startswith(s, F.lit("UNKNOWN"))}
    return rows.agg(*(F.count_if(v).alias(k) for k, v in counts.items()))


def manifest(df: DataFrame) -> DataFrame:
    """(chain, counts): row counts per class as a JSON object with sorted keys."""
    counts = df.groupBy("chain", "classification").agg(F.count(F.lit(1)).alias("n"))
    entries = F.array_sort(F.collect_list(F.struct("classification", "n")))
    return counts.groupBy("chain").agg(F.to_json(F.map_from_entries(entries)).alias("counts"))


def split_views(df: DataFrame, column: str, path: str) -> None:
    """A copy of each row under every name in a delimited column; names that are no plain words are refused."""
    one = df.withColumn("view", F.explode(F.split(column, "\\|")))
    safe = F.when(F.col("view").rlike("^[A-Za-z0-9_-]+$"), F.col("view")).otherwise(F.raise_error(F.lit("unsafe name")).cast("string"))
    one.withColumn("view", safe).write.partitionBy("view").parquet(path)


VIEW = r"view=[^/]+"


def replace_views(df: DataFrame, column: str, path: str) -> None:
    """``split_views`` in place of the views that stand at ``path``: only a folder that holds nothing but views is replaced, and a failure leaves it as it is."""
    spark = df.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(at):
        names = [(f.getPath().getName(), f.isDirectory()) for f in fs.listStatus(at)]
        strange = [n for n, folder in names if not (re.fullmatch(VIEW, n) and folder or n == "_SUCCESS")]
        if not fs.getFileStatus(at).isDirectory() or strange:
            raise ValueError(f"{path} holds what no view is: {', '.join(sorted(strange)[:3])}")
    staging = f"{path}.{uuid.uuid4().hex}"
    try:
        split_views(df, column, staging)
    except BaseException:
        delete(spark, staging)
        raise
    _renamed(spark, staging, path)


def publish(df: DataFrame, staging: str, final: str) -> None:
    """Written aside, then renamed through the file system of the path, so that readers see the old or the new whole."""
    df.write.mode("overwrite").parquet(staging)
    _renamed(df.sparkSession, staging, final)


def _renamed(spark: SparkSession, staging: str, final: str) -> None:
    """The folder ``staging`` under the name ``final``, in place of one that has it; if that fails, the old one has it again."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    source, target = hadoop.Path(staging), hadoop.Path(final)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    old = hadoop.Path(final + ".old")
    fs.delete(old, True)
    if fs.exists(target):
        fs.rename(target, old)
    if not fs.rename(source, target):
        if fs.exists(old):
            fs.rename(old, target)
        raise OSError(f"could not publish {final}")
    fs.delete(old, True)


MANUAL = "<!-- manual -->"


def report_lines(table: DataFrame, columns: list[str], prior: str = "") -> DataFrame:
    """(line): the rows of a small summary as a table in Markdown, and the part of the report before that was written by hand."""
    head = "| " + " | ".join(columns) + " |"
    cell = lambda c: F.col(c).cast("string")
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, columns)), F.lit(" |"))
    kept = [x for x in prior.partition(MANUAL)[2].split("\n") if x]
    fixed = table.sparkSession.createDataFrame([(x,) for x in (head, *kept)], "line string")
    return fixed.unionByName(table.select(row.alias("line")))


def write_complete_or_partial(rows: DataFrame, path: str) -> None:
    """Chains whose rows are all verified go to ``path``; the others, whole, to its sibling for partial runs."""
    open_chains = rows.groupBy("chain").agg((F.count_if(F.col("verification") == "") > 0).alias("open"))
    told = rows.join(open_chains, "chain")
    told.where("not open").drop("open").write.parquet(path)
    told.where("open").drop("open").write.parquet(path + ".partial")
