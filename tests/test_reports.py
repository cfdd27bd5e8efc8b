"""Reports, assembly, sinks and readers: rows that must fail, hot groups, and what a second run leaves."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions import hexbytes as X
from palimpsest.functions import parsers as P
from palimpsest.operators.assembly import assembled, upserted
from palimpsest.operators.legacy import standardised
from palimpsest.operators.reports import CONFLICT, EPOCH, MALFORMED, MIXED, anomalies, child_coverage
from palimpsest.sources import files, sinks


def test_a_group_of_all_rows(spark):
    """Every row is malformed alike: samples are the smallest ids, and no task gathers the group."""
    rows = spark.range(20_000).selectExpr("id", "'h' as hash", "if(id = 7, 'b', 'a') as prev", "'stale' as classification", "'x' as bits")
    got = {r["kind"]: r for r in anomalies(rows, F.lit("broken"), F.when(F.col("id") < 2, "y")).collect()}
    assert set(got) == {CONFLICT, MALFORMED, EPOCH} and got[CONFLICT]["variants"] == "a|b" and got[CONFLICT]["n"] == 20_000
    assert got[MALFORMED]["n"] == 20_000 and got[MALFORMED]["samples"] == "|".join(map(str, range(20))) and got[EPOCH]["samples"] == "0|1"


def test_nulls_are_no_contradiction(spark):
    rows = spark.createDataFrame([(1, "h", None, "stale", None), (2, "h", "p", None, "b"), (3, None, "p", "stale", "b"), (4, None, "q", "unknown", "b")], "id long, hash string, prev string, classification string, bits string")
    got = sorted((r["kind"], r["key"], r["variants"]) for r in anomalies(rows, F.lit(None).cast("string"), F.lit("b")).collect())
    assert got in ([], [(CONFLICT, None, "p|q"), (MIXED, None, "stale|unknown")])


@pytest.mark.parametrize("rows,status", [
    ([("a", "", "")], "not_applicable"),
    ([("a", "5", "5"), ("a", "7", "7")], "degenerate"),
    ([("a", "5", "5"), ("a", "7", "")], "incomplete"),
    ([("a", "5", "4"), ("a", "7", "7")], "non_degenerate"),
])
def test_coverage_status(spark, rows, status):
    got = child_coverage(spark.createDataFrame(rows, "chain string, child_block_time string, btc_time string"), ("child_block_time",), F.lit("gone")).first()
    assert got["delta_status"] == status and got["total_rows"] == len(rows)
    assert got["reasons"] == ('{"gone":1}' if status == "not_applicable" else "{}")


def test_assembly(spark):
    seeds = spark.createDataFrame([(1, "h1", None, "", "s", "committed"), (2, "h2", "own", "b", "s", "sweep:x"), (3, "h3", None, "", "s", None), (4, "h4", None, "", "s", "c")], "height long, hash string, header_hex string, expected_nbits string, script string, provenance string")
    groups = spark.createDataFrame([(1, "A", "n"), (4, "C", None)], "height long, source_group string, chain string")
    evidence = spark.createDataFrame([("n", 1, "h1", "e1", " 1d ", "es"), ("n", 1, "h1", "e1", " 1d ", "es"), ("m", 4, "h4", "wrong", "", "")], "chain string, height long, hash string, header_hex string, expected_nbits string, script string")
    upstream = spark.createDataFrame([(9, "h9", "u")], "height long, hash string, header_hex string")
    recovered = spark.createDataFrame([(3, "h3", "r3", "node")], "height long, hash string, header_hex string, source string")
    got = {r["height"]: (r["header_hex"], r["expected_nbits"], r["script"], r["provenance"], r["source_group"], r["error"]) for r in assembled(seeds, groups, evidence, upstream, recovered, ("sweep:",)).collect()}
    assert got == {
        1: ("e1", "1d", "es", "full-evidence:n", "A", None),
        2: ("own", "b", "s", "sweep:x", "self", None),
        3: ("r3", "", "s", "node", "D", None),
        4: (None, "", "s", "upstream", "C", "no header in upstream"),
    }
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    assert sorted(map(tuple, upserted(old, spark.createDataFrame([(2, "c"), (3, "d")], "k long, v string"), ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_assembly_of_rows_at_one_height(spark):
    """Groups that name hashes belong to one row each of a height."""
    seeds = spark.createDataFrame([(1, x, None, "", "s", "c") for x in ("g", "h", "i")], "height long, hash string, header_hex string, expected_nbits string, script string, provenance string")
    groups = spark.createDataFrame([(1, "g", "C", None), (1, "h", "B", "n")], "height long, hash string, source_group string, chain string")
    evidence = spark.createDataFrame([("n", 1, "h", "eh", "1d", "es")], "chain string, height long, hash string, header_hex string, expected_nbits string, script string")
    upstream = spark.createDataFrame([(1, "g", "ug"), (1, "h", "uh")], "height long, hash string, header_hex string")
    recovered = spark.createDataFrame([(1, "i", "ri", "node")], "height long, hash string, header_hex string, source string")
    got = sorted((r["hash"], r["header_hex"], r["source_group"]) for r in assembled(seeds, groups, evidence, upstream, recovered, ("sweep:",)).collect())
    assert got == [("g", "ug", "C"), ("h", "eh", "B"), ("i", "ri", "D")]


def test_classifier_outputs(spark):
    kind = "id long, classification string, validation_status string, expected_nbits string, rules_violated string"
    rows = spark.createDataFrame([(1, "canonical", "VALID", "b", "r"), (2, "stale", "VALID", "b", "r"), (3, "stale", "VALID: no", "b", "r"), (4, "unknown", "REJECTED: x", "b", "r"), (5, "error_block", "REJECTED: y", "b", "r")], kind)
    told = {n: sorted(map(tuple, df.collect())) for n, df in sinks.classifier_outputs(rows, ["id", "validation_status", "more"]).items()}
    assert told == {"canonical": [("1", "", "")], "stale": [("2", "VALID", ""), ("3", "VALID: no", "")], "unknown": [("4", "", "")], "error_block": [("5", "REJECTED: y", "", "r")], "validated": [("2", "VALID", "")]}
    counts = sinks.classifier_counts(rows).first().asDict()
    assert counts["rejected"] == 2 and counts["rejected_unknown"] == 1 and counts["rejected_error_block"] == 1 and counts["valid"] == 1
    with pytest.raises(Exception, match="unknown class"):
        sinks.classifier_outputs(spark.createDataFrame([(1, "near", "", "", "")], kind), ["id"])["stale"].collect()


def test_views_replace_views_only(spark, tmp_path):
    path = f"file://{tmp_path}/views"
    rows = lambda *names: spark.createDataFrame([(n,) for n in names], "source_chains string")
    sinks.replace_views(rows("a|b", "a"), "source_chains", path)
    sinks.replace_views(rows("b"), "source_chains", path)
    assert [p.name for p in (tmp_path / "views").glob("view=*")] == ["view=b"]
    with pytest.raises(Exception, match="unsafe name"):
        sinks.replace_views(rows("../x"), "source_chains", path)
    assert [p.name for p in (tmp_path / "views").glob("view=*")] == ["view=b"] and len(list(tmp_path.iterdir())) == 1
    (tmp_path / "views" / "notes.txt").write_text("mine")
    with pytest.raises(ValueError, match=r"notes\.txt"):
        sinks.replace_views(rows("c"), "source_chains", path)
    assert (tmp_path / "views" / "notes.txt").read_text() == "mine"


def test_readers_refuse(spark, tmp_path):
    def put(name: str, text: str) -> str:
        (tmp_path / name).write_text(text)
        return f"file://{tmp_path}/{name}"

    assert [tuple(r) for r in files.read_cache(spark, put("c1.json", '{"a": true, "b": null, "c": {"x": 1}}')).orderBy("key").collect()] == [("a", "present", None), ("b", "unknown", None), ("c", "present", '{"x":1}')]
    with pytest.raises(Exception, match="neither true"):
        files.read_cache(spark, put("c2.json", '{"a": 5}')).collect()
    kind = T.StructType.fromDDL("height bigint")
    assert files.read_json_list(spark, put("l1.json", '[{"height": 1}, {"height": 2}]'), kind).count() == 2
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_json_list(spark, put("l2.json", "[{broken"), kind).collect()
    spark.createDataFrame([(b"x" * 32, 1), (b"x" * 32, 2)], "hash binary, size bigint").write.parquet(f"{tmp_path}/census")
    with pytest.raises(Exception, match="no hash of its own"):
        files.read_census(spark, f"{tmp_path}/census").collect()
    (tmp_path / "blocks").mkdir()
    (tmp_path / "blocks" / "block_7.bin").write_bytes(b"seven")
    assert [(r["height"], bytes(r["content"])) for r in files.block_files(spark, f"file://{tmp_path}/blocks").collect()] == [(7, b"seven")]
    (tmp_path / "blocks" / "other.bin").write_bytes(b"")
    (tmp_path / "blocks" / "strange.bin").write_bytes(b"?")
    with pytest.raises(Exception, match="no height"):
        files.block_files(spark, f"file://{tmp_path}/blocks").collect()


@pytest.mark.parametrize("h,value,size,fault", [
    ("00", 0, 1, None), ("fc", 252, 1, None), ("fdfd00", 253, 3, None), ("fdfc00", 252, 3, "not the shortest form"), ("feffff0000", 65535, 5, "not the shortest form"), ("fe00000100", 65536, 5, None),
    ("ffffffffffffffffff", 2**64 - 1, 9, "above the maximum"), ("ff0000000001000000", 2**32, 9, None), ("fd00", None, None, "cut short"), ("", None, None, "cut short"),
])
def test_compact_sizes(spark, h, value, size, fault):
    got = spark.createDataFrame([(h,)], "h string").select(X.compact_size(F.col("h"), F.lit(2**40)).alias("s")).first()["s"]
    assert (got["value"], got["bytes"], got["fault"]) == (value, size, fault)


def test_ids_leave_out_the_witness():
    """The first coinbase of the main chain, and the same with a witness."""
    raw = bytes.fromhex("01000000010000000000000000000000000000000000000000000000000000000000000000ffffffff4d04ffff001d0104455468652054696d65732030332f4a616e2f32303039204368616e63656c6c6f72206f6e206272696e6b206f66207365636f6e64206261696c6f757420666f722062616e6b73ffffffff0100f2052a01000000434104678afdb0fe5548271967f1a67130b7105cd6a828e03909a67962e0ea1f61deb649f6bc3f4cef38c4f35504e51ec112de5c384df7ba0b8d578a4c702b6bf11d5fac00000000")
    told = P.parse_transaction(raw)
    assert told["txid"] == "4a5e1e4baab89f3a32518a88c31bc87f618f76673e2cc77ab2127b7afdeda33b"
    witness = raw[:4] + b"\0\1" + raw[4:-4] + b"\1\3abc" + raw[-4:]
    assert P.parse_transaction(witness)["txid"] == told["txid"] and P.parse_transaction(witness)["has_witness"]


def test_old_layouts_without_sense(spark):
    rows = spark.createDataFrame([("zz", None, "yesterday", "1.5", "x")], "parent_hash string, parent_prev string, parent_time string, parent_bits string, block string")
    assert tuple(standardised(rows, "decimal").first()) == ("",) * 5
    assert tuple(standardised(spark.createDataFrame([("00", 5)], "parent_header string, child_block long"), "header").first()) == ("", "", "", "", "5")
