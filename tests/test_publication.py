"""Families of tables, their floors and contracts, discovery, and evidence rows: what must fail."""

from __future__ import annotations

import pytest

from palimpsest.operators import evidence_rows as V
from palimpsest.sources import family
from palimpsest.sources.discovery import listing, sources
from palimpsest.sources.family import Floor, current, floor_report, lacking, publish_family, read_family


def table(spark, *rows):
    return spark.createDataFrame(list(rows), "id long, kind string")


def ids(spark, root) -> dict[str, list[int]]:
    return {n: sorted(r["id"] for r in df.collect()) for n, df in read_family(spark, root).items()}


def test_all_or_nothing(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/family"
    with pytest.raises(ValueError, match="nothing is published"):
        read_family(spark, root)
    one = {"a": table(spark, (1, "x"), (2, "x")), "b": table(spark, (3, "y"))}
    publish_family(one, root)
    old = {"a": [1, 2], "b": [3]}
    assert ids(spark, root) == old
    two = {"a": table(spark, (1, "x"), (2, "x"), (4, "x")), "b": table(spark, (3, "y"), (5, "z"))}
    broken = spark.range(3).selectExpr("id", "if(id = 2, raise_error('in the second table'), 'y') as kind")
    with pytest.raises(Exception, match="in the second table"):
        publish_family({"a": two["a"], "b": broken}, root)
    assert ids(spark, root) == old
    point = family._point
    monkeypatch.setattr(family, "_point", lambda *a: (_ for _ in ()).throw(OSError("before the pointer")))
    with pytest.raises(OSError, match="before the pointer"):
        publish_family(two, root)
    assert ids(spark, root) == old and len(list((tmp_path / "family" / "versions").iterdir())) == 1
    monkeypatch.setattr(family, "_point", point)
    with pytest.raises(ValueError, match="missing now: b"):
        publish_family({"a": two["a"]}, root)
    publish_family(two, root)
    assert ids(spark, root) == {"a": [1, 2, 4], "b": [3, 5]}
    for _ in range(3):
        publish_family(two, root)
    assert len(list((tmp_path / "family" / "versions").iterdir())) == 2


def test_readers_keep_the_version_they_read(spark, tmp_path):
    root = f"file://{tmp_path}/family"
    publish_family({"a": table(spark, (1, "x"))}, root)
    held = read_family(spark, root)["a"]
    publish_family({"a": table(spark, (2, "x"))}, root)
    assert held.first()["id"] == 1 and ids(spark, root) == {"a": [2]}


@pytest.mark.parametrize("new,told", [
    ([(1, "x"), (2, "x"), (3, "y")], None),
    ([(1, "x"), (2, "x"), (3, "y"), (4, "y")], None),
    ([(1, "x"), (3, "y")], "x: 1 of 2 rows, 1 missing"),
    ([(1, "x"), (2, "x"), (9, "y")], "y: 1 of 1 rows, 1 missing"),
    ([(1, "x"), (1, "x"), (3, "y")], "x: 2 of 2 rows, 1 missing"),
    ([(1, "x"), (2, "y"), (3, "y")], "x: 1 of 2 rows, 1 missing"),
    ([], "x: 0 of 2 rows, 2 missing"),
])
def test_floors(spark, tmp_path, new, told):
    root = f"file://{tmp_path}/family"
    publish_family({"a": table(spark, (1, "x"), (2, "x"), (3, "y"))}, root)
    before = current(spark, root)
    floors = {"a": Floor(("id",), "kind")}
    if told is None:
        publish_family({"a": table(spark, *new)}, root, floors)
        assert current(spark, root) != before
    else:
        with pytest.raises(ValueError, match=told):
            publish_family({"a": table(spark, *new)}, root, floors)
        assert current(spark, root) == before


def test_nulls_and_repeats_in_floors(spark):
    old, new = table(spark, (None, None), (None, None), (1, "x")), table(spark, (None, None), (1, "x"))
    assert [tuple(r) for r in lacking(old, new, ("id", "kind")).collect()] == [(None, None, 1)]
    assert sorted(map(tuple, floor_report(old, new, Floor(("id",), "kind")).collect())) == [("", 2, 1, 1), ("x", 1, 1, 0)]


@pytest.mark.parametrize("fault", ["byte", "gone", "added"])
def test_contract(spark, tmp_path, fault):
    """One changed byte, a file that is gone, and one that was put beside the others fail the read, on a store without checksums of its own."""
    root = f"file://{tmp_path}/family"
    publish_family({"a": table(spark, (1, "x")), "b": table(spark, (2, "y"))}, root)
    folder = tmp_path / "family" / "versions" / current(spark, root).rpartition("/")[2]
    files = sorted((folder / "b").glob("*.parquet"))
    for side in (folder / "b").glob(".*.crc"):
        side.unlink()
    if fault == "byte":
        data = bytearray(files[0].read_bytes())
        data[len(data) // 2] ^= 1
        files[0].write_bytes(bytes(data))
    elif fault == "gone":
        files[0].unlink()
    else:
        (folder / "b" / "more.parquet").write_bytes(files[0].read_bytes())
    with pytest.raises(ValueError, match="not as published: b/"):
        read_family(spark, root)


def test_discovery(spark, tmp_path):
    """Precedence of places, of roots and of kinds; companions are found by themselves; a named path in an archive goes first; others don't count."""
    def put(*places):
        for p in places:
            (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / p).write_text("a\n")

    put("one/a/a_stale_blocks.csv", "one/a/classified/a_stale_blocks.csv", "data/a_stale_blocks.csv", "two/a/classified/a_canonical_blocks.csv", "data/a_canonical_blocks.csv")
    put("two/b_stale_blocks.csv/part-0.csv", "two/b_stale_blocks.csv/part-1.csv", "one/b/validated/b_validated_stales.csv", "data/validated-stales/c_validated_stales.csv", "data/c_validated_stales.csv", "data/deep/d_stale_blocks.csv", "data/e_unknown_blocks.csv")
    put("two/f/2026/all.csv", "one/f/classified/f_stale_blocks.csv", "one/stranger/classified/stranger_stale_blocks.csv")
    chains = spark.createDataFrame([(c,) for c in "abcdef"], "chain string")
    roots = [f"file://{tmp_path}/{r}" for r in ("one", "two", "data")]
    got = {(r["chain"], r["role"]): (r["path"] and r["path"].partition(f"{tmp_path}/")[2], r["source_kind"], r["provenance"]) for r in sources(chains, listing(spark, roots), roots[2], {"f": "2026/all.csv"}).collect()}
    assert got == {
        ("a", "primary"): ("one/a/classified/a_stale_blocks.csv", "full_inventory", "archive"),
        ("a", "canonical"): ("two/a/classified/a_canonical_blocks.csv", "canonical_blocks", "archive"),
        ("b", "primary"): ("two/b_stale_blocks.csv", "full_inventory", "archive"),
        ("c", "primary"): ("data/validated-stales/c_validated_stales.csv", "validated_stales", "repo-data"),
        ("d", "primary"): (None, "missing", ""),
        ("e", "primary"): (None, "missing", ""),
        ("e", "unknown"): ("data/e_unknown_blocks.csv", "full_inventory", "repo-data"),
        ("f", "primary"): ("one/f/classified/f_stale_blocks.csv", "full_inventory", "archive"),
    }


ROW = "chain string, btc_height string, btc_header_hash string, classification string, child_height string, child_block_hash string, child_block_time string, child_header_hex string, validation_status string"
H = "ab" * 32


def test_listing_of_roots_without_a_scheme(spark, tmp_path):
    """A root is as often told without its scheme, as Spark takes it: the paths below it are the same."""
    (tmp_path / "one" / "a" / "classified").mkdir(parents=True)
    (tmp_path / "one" / "a" / "classified" / "a_stale_blocks.csv").write_text("a\n")
    for root in (f"{tmp_path}/one", f"{tmp_path}/one/", f"file:{tmp_path}/one", f"file://{tmp_path}/one"):
        assert [r["path"] for r in listing(spark, [root]).collect()] == ["a/classified/a_stale_blocks.csv"]


def evidence(spark, *rows):
    return spark.createDataFrame([(*r, *[""] * (9 - len(r))) for r in rows], ROW)


def test_companions(spark):
    primary = evidence(spark, ("a", "5", H, "canonical"), ("a", "6", "", "canonical"), ("a", "5", H, "stale"))
    companion = evidence(spark, ("a", "5", H.upper(), "canonical"), ("a", "6", H, "canonical"), ("a", "5", H, "stale"), ("b", "5", H, "canonical"))
    got = sorted((r["chain"], r["btc_height"], r["btc_header_hash"], r["classification"]) for r in V.with_companions(primary, companion).collect())
    assert got == sorted([("a", "5", H, "canonical"), ("a", "6", "", "canonical"), ("a", "5", H, "stale"), ("a", "6", H, "canonical"), ("a", "5", H, "stale"), ("b", "5", H, "canonical")])
    unknown = evidence(spark, ("a", "", H, "unknown"))
    assert V.with_companions(primary, None, unknown).count() == 4
    with pytest.raises(Exception, match="and beside it"):
        V.with_companions(evidence(spark, ("a", "1", H, "unknown")), None, unknown).collect()


def test_identities_never_multiply_rows(spark):
    rows = evidence(spark, ("a", "5", H, "stale", "7"))
    kind = "chain string, btc_header_hash string, child_height string, child_block_hash string, child_block_time string, file int"
    two = spark.createDataFrame([("a", H, "7", "first", "1", 1), ("a", H, "7", "second", "2", 2), ("a", H, "7", "second", "2", 2)], kind)
    assert [(r["outcome"], r["child_block_hash"]) for r in V.hydrated(rows, two, ()).collect()] == [("hydrated", "second")]
    same = two.where("file = 2").drop("file")
    assert [(r["outcome"], r["child_block_hash"]) for r in V.hydrated(rows, same, ()).collect()] == [("hydrated", "second")]
    with pytest.raises(Exception, match="two identities"):
        V.hydrated(rows, two.drop("file"), ()).collect()


def test_the_strongest_verdict_counts(spark):
    rows = evidence(spark, ("a", "5", H, "unknown"), ("a", "5", "cd" * 32, "unknown"))
    verdicts = spark.createDataFrame([(H, "weak_btc_orphan"), (H, "strict_btc_orphan"), (H, "weak_btc_orphan"), ("cd" * 32, "excluded")], "btc_header_hash string, verdict string")
    observed = spark.createDataFrame([], "chain string, btc_header_hash string")
    assert [(r["btc_header_hash"], r["verdict"]) for r in V.admitted(rows, observed, verdicts).collect()] == [(H, "strict_btc_orphan")]


def test_headers_from_ordered_files(spark):
    """Files are taken until all wanted hashes are found; the last row counts, and a wrong header is never written."""
    from palimpsest.functions.hexbytes import display_hash
    from pyspark.sql import functions as F

    headers = [f"{i:02x}" * 80 for i in range(1, 5)]
    hashes = [r[0] for r in spark.createDataFrame([(i, h) for i, h in enumerate(headers)], "i int, h string").orderBy("i").select(display_hash(F.col("h"))).collect()]
    kind = "chain string, btc_header_hash string, btc_header_hex string"
    rows = spark.createDataFrame([("n", hashes[0], ""), ("n", hashes[1], ""), ("n", hashes[2], "kept"), ("m", hashes[0], ""), ("n", "short", "")], kind)
    said = lambda *c: {(r["chain"], r["btc_header_hash"]): (r["btc_header_hex"], r["header_outcome"]) for r in V.with_headers(rows, spark.createDataFrame(list(c), "hash string, header_hex string, ordinal int, place int"), "n").collect()}
    rest = {("n", hashes[2]): ("kept", "not a target"), ("m", hashes[0]): ("", "not a target"), ("n", "short"): ("", "not a target")}
    both = [(hashes[0].upper(), headers[0], 0, 1), (hashes[1], headers[1], 0, 2)]
    assert said(*both, (hashes[0], headers[3], 1, 1)) == rest | {("n", hashes[0]): (headers[0], "hydrated"), ("n", hashes[1]): (headers[1], "hydrated")}
    assert said(both[0], (hashes[0], headers[3], 1, 1)) == rest | {("n", hashes[0]): ("", "hash mismatch"), ("n", hashes[1]): ("", "missing")}
    assert said(both[0], (hashes[0], headers[3], 0, 0), both[1])[("n", hashes[0])] == (headers[0], "hydrated")


def shuffled(spark) -> int:
    """Bytes that the session's tasks have written for shuffles."""
    told = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(told.apply(i).totalShuffleWrite() for i in range(told.size()))


def test_only_targets_are_shuffled(spark):
    """Rows that no join can change are wide, and stay where they are."""
    from pyspark.sql import functions as F

    wide = F.concat(*(F.sha2(F.concat(F.col("id").cast("string"), F.lit(f"-{k}")), 512) for k in range(40)))
    texts = {"btc_header_hash": F.sha2(F.col("id").cast("string"), 256), "child_height": F.lit("7"), "classification": F.lit("stale"), "child_header_hex": F.lit(""), "child_block_time": F.lit("")}
    rows = spark.range(0, 2000, 1, 4).select(F.when(F.col("id") < 20, "a").otherwise("b").alias("chain"), *(v.alias(k) for k, v in texts.items()), F.lit("").alias("child_block_hash"), wide.alias("btc_header_hex"))
    identity = rows.where("chain = 'a'").select("chain", "btc_header_hash", "child_height", F.lit("found").alias("child_block_hash"), F.lit("1").alias("child_block_time"), F.lit(1).alias("file"))
    candidates = spark.createDataFrame([(H, "00" * 80, 0, 0)], "hash string, header_hex string, ordinal int, place int")
    told = {"outcome": V.hydrated(rows, identity, ()), "header_outcome": V.with_headers(rows.withColumn("btc_header_hex", F.when(F.col("chain") == "a", "").otherwise(F.col("btc_header_hex"))), candidates, "a")}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", 10_000)  # rows of a large table on the other side
    try:
        for name, df in told.items():
            start = shuffled(spark)
            seen = {(r["chain"], r[name]): r["n"] for r in df.withColumn("size", F.length("btc_header_hex")).groupBy("chain", name).agg(F.count("size").alias("n"), F.sum("size")).collect()}
            assert seen == {("a", "hydrated" if name == "outcome" else "missing"): 20, ("b", "not a target"): 1980}
            assert shuffled(spark) - start < 2_000_000  # of some ten million
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_null_child_hashes_stay_targets(spark):
    kind = "chain string, btc_header_hash string, child_height string, child_block_hash string, child_block_time string, file int"
    rows = evidence(spark, ("a", "5", H, "stale", "7"), ("a", "5", H, "stale", "8"), ("b", "5", H, "stale", "7"), ("a", "5", "short", "stale", "7"))
    rows = rows.selectExpr(*(f"if(child_height = '7', null, {c}) as {c}" if c == "child_block_hash" else c for c in rows.columns))
    identity = spark.createDataFrame([("a", H, "7", "told", "1", 1)], kind)
    got = sorted((r["chain"], r["btc_header_hash"], r["child_height"], r["outcome"]) for r in V.hydrated(rows, identity, ()).collect())
    assert got == sorted([("a", H, "7", "hydrated"), ("a", H, "8", "height_mismatch"), ("b", H, "7", "not a target"), ("a", "short", "7", "not a target")])


def test_export_leaves_what_it_published(spark):
    """Headers, sources and the table before publication are deleted once nothing reads them."""
    from pathlib import Path

    from palimpsest.plans.pipelines import p07_full_evidence
    from palimpsest.sources.folder import shared_folder

    folder = Path(shared_folder(spark).removeprefix("file://"))
    there = set(folder.iterdir())
    rows = p07_full_evidence(spark, "/root/testdata/sf0.001")
    assert {p.name.partition("-")[0] for p in set(folder.iterdir()) - there} == {"evidence"}
    assert rows.count() > 1000
