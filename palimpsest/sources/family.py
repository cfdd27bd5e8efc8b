"""A family of tables published at once: readers see all of the old ones or all of the new ones, and can prove that what they read is what was published.

    root/CURRENT                   names the version that holds
    root/versions/<id>/<table>     Parquet files
    root/versions/<id>/_contract   a row for each file (table, file, bytes, sha256), and one for each table (rows; no file)

In the first phase all tables are written aside, counted in the same pass, and compared with what is published. In the second, one rename puts
the pointer in place. Whatever fails before that leaves the old family as it was, and what was written is removed.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .folder import delete

POINTER, CONTRACT = "CURRENT", "_contract"
CONTRACT_SCHEMA = "table string, file string, bytes long, sha256 string, rows long"


@dataclass(frozen=True)
class Floor:
    """What a new table may not fall below: the published rows of each ``kind``, and the published rows' ``identity``, each as often as it stood there."""

    identity: tuple[str, ...]
    kind: str | None = None


def _files(spark: SparkSession, folder: str, tables: list[str]) -> DataFrame:
    """(table, file, bytes, sha256) of the tables' data files under ``folder``."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet")
    found = read.load([f"{folder}/{t}" for t in tables])
    at = F.substring_index("path", folder.rstrip("/").rpartition("/")[2] + "/", -1)
    return found.select(F.substring_index(at, "/", 1).alias("table"), F.substring(at, F.locate("/", at) + 1, F.length(at)).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def _path(spark: SparkSession, name: str):  # noqa: ANN202
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)


def current(spark: SparkSession, root: str) -> str | None:
    """The folder of the version that holds; None if nothing is published."""
    at = _path(spark, f"{root}/{POINTER}")
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return f"{root}/versions/{spark.read.text(f'{root}/{POINTER}').first()[0]}" if store.exists(at) else None


def _point(spark: SparkSession, root: str, version: str) -> None:
    """One rename, which replaces the pointer as a whole."""
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    aside, target = _path(spark, f"{root}/{POINTER}.{version}"), _path(spark, f"{root}/{POINTER}")
    out = aside.getFileSystem(conf).create(aside, True)
    out.write(bytearray(version.encode()))
    out.close()
    over = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = hadoop.Options.Rename.OVERWRITE
    hadoop.FileContext.getFileContext(target.toUri(), conf).rename(aside, target, over)


def lacking(old: DataFrame, new: DataFrame, identity: tuple[str, ...]) -> DataFrame:
    """``identity`` and ``n``: how many rows of the old table the new one lacks, as multisets. Each side is counted before they meet."""
    count = lambda df, name: df.groupBy(*(F.col(f"`{c}`") for c in identity)).agg(F.count(F.lit(1)).alias(name))
    a, b = count(old, "_old").alias("a"), count(new, "_new").alias("b")
    same = F.lit(True)
    for c in identity:
        same = same & F.col(f"a.`{c}`").eqNullSafe(F.col(f"b.`{c}`"))
    n = F.col("_old") - F.coalesce("_new", F.lit(0))
    return a.join(b, same, "left").where(n > 0).select(*(F.col(f"a.`{c}`") for c in identity), n.alias("n"))


def floor_report(old: DataFrame, new: DataFrame, floor: Floor) -> DataFrame:
    """(kind, published, staged, lacking): rows of each kind before and now, and published identities that are missing. A floor is broken where staged is less than
    published or anything is lacking."""
    kind = F.lit("") if floor.kind is None else F.coalesce(F.col(f"`{floor.kind}`").cast("string"), F.lit(""))
    count = lambda df, name: df.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias(name))
    keys = tuple(dict.fromkeys([*floor.identity, *([floor.kind] if floor.kind else [])]))
    gone = lacking(old, new, keys).groupBy(kind.alias("kind")).agg(F.sum("n").alias("lacking"))
    both = count(old, "published").join(count(new, "staged"), "kind", "full").join(gone, "kind", "left")
    return both.select("kind", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("published", "staged", "lacking")))


def publish_family(tables: dict[str, DataFrame], root: str, floors: dict[str, Floor] | None = None, kept: int = 2) -> str:
    """Publishes ``tables`` and returns the folder of their version; the last ``kept`` versions stay for those who still read them. A table that is published may not be
    left out. A broken floor, or any failure, publishes nothing."""
    spark = next(iter(tables.values())).sparkSession
    version = uuid.uuid4().hex
    folder, before = f"{root}/versions/{version}", current(spark, root)
    try:
        counted = {}
        for name, df in tables.items():
            counted[name] = Observation(name)
            df.observe(counted[name], F.count(F.lit(1)).alias("rows")).write.option("compression", "zstd").parquet(f"{folder}/{name}")
        if before:
            old = {r["table"] for r in spark.read.schema(CONTRACT_SCHEMA).json(f"{before}/{CONTRACT}").where("file is null").collect()}
            if old - set(tables):
                raise ValueError(f"published before and missing now: {', '.join(sorted(old - set(tables)))}")
            for name, floor in (floors or {}).items():
                if name in old:
                    told = floor_report(spark.read.parquet(f"{before}/{name}"), spark.read.parquet(f"{folder}/{name}"), floor)
                    broken = told.where("staged < published or lacking > 0").orderBy("kind").limit(5).collect()
                    if broken:
                        raise ValueError(f"{name} falls below what is published: " + "; ".join(f"{r['kind']}: {r['staged']} of {r['published']} rows, {r['lacking']} missing" for r in broken))
        rows = [(n, None, None, None, o.get["rows"]) for n, o in counted.items()]
        contract = _files(spark, folder, list(tables)).withColumn("rows", F.lit(None).cast("long")).unionByName(spark.createDataFrame(rows, CONTRACT_SCHEMA))
        contract.write.json(f"{folder}/{CONTRACT}")
        _point(spark, root, version)
    except BaseException:
        delete(spark, folder)
        raise
    _forget(spark, root, [folder, *([before] if before else [])][:kept])
    return folder


def _forget(spark: SparkSession, root: str, stay: list[str]) -> None:
    at = _path(spark, f"{root}/versions")
    for found in at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at):
        name = found.getPath().getName()
        if name not in {s.rpartition("/")[2] for s in stay}:
            delete(spark, f"{root}/versions/{name}")


def read_family(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The published tables by name, after every file's bytes have been compared with the contract; one that is missing, added or changed fails the read."""
    folder = current(spark, root)
    if folder is None:
        raise ValueError(f"nothing is published under {root}")
    contract = spark.read.schema(CONTRACT_SCHEMA).json(f"{folder}/{CONTRACT}")
    names = sorted(r["table"] for r in contract.where("file is null").collect())
    there = _files(spark, folder, names).select("table", "file", F.col("bytes").alias("_bytes"), F.col("sha256").alias("_sha256"))
    told = contract.where("file is not null").join(there, ["table", "file"], "full")
    wrong = told.where("not (bytes <=> _bytes and sha256 <=> _sha256)").select("table", "file").orderBy("table", "file").limit(3).collect()
    if wrong:
        raise ValueError("not as published: " + ", ".join(f"{r['table']}/{r['file']}" for r in wrong))
    return {name: spark.read.parquet(f"{folder}/{name}") for name in names}
