"""Binary helpers on bytes built by hand, and faults that must be told."""

from __future__ import annotations

import hashlib
import struct

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import hexbytes as X
from palimpsest.functions import proofs as B
from palimpsest.operators.classifier import overwritten
from palimpsest.operators.claims import claim_failures, recovery_targets
from palimpsest.operators.evidence_rows import Source, bundle_fault, normalised
from palimpsest.operators.matching import lagged
from palimpsest.sources.files import authenticated, builder_rows, masked, split_frames
from palimpsest.sources.reference import refresh_reference
from palimpsest.sources.sinks import distinct_destinations

twice = lambda x: hashlib.sha256(hashlib.sha256(x).digest()).digest()


def transaction(script: bytes, witness: bool = False) -> bytes:
    ins = b"\x01" + bytes(32) + b"\xff" * 4 + bytes([len(script)]) + script + b"\xff" * 4
    outs = b"\x01" + struct.pack("<Q", 5000) + b"\x02\x6a\x00"
    return b"\x02\0\0\0" + (b"\0\x01" if witness else b"") + ins + outs + (b"\x01\x02ab" if witness else b"") + b"\x07\0\0\0"


@pytest.mark.parametrize("witness", [False, True])
def test_proof(witness):
    tx = transaction(b"\x03abc", witness)
    data = b"junk" + tx + bytes(32) + b"\x02" + b"A" * 32 + b"B" * 32 + struct.pack("<i", 3) + b"\0" + struct.pack("<i", -1) + b"H" * 80
    got = B.read_proof(data, 4)
    assert got["script"] == "03616263" and got["branch"] == ["41" * 32, "42" * 32] and (got["position"], got["chain_position"]) == (3, -1)
    assert got["txid"] == twice(transaction(b"\x03abc")).hex() and got["parent_header"] == "48" * 80 and got["size"] == len(data) - 4
    assert all(B.read_proof(data[:n], 4) is None for n in range(4, len(data), 7))


def test_tail_prefers_the_leftmost_place():
    out = lambda v, s: struct.pack("<Q", v) + bytes([len(s)]) + s
    tail = b"\xff" * 5 + out(1000, b"\x51") + out(2000, b"\x6a\x01a") + b"\0\0\0\0"
    assert [o["value"] for o in B.tail_of(tail)] == [1000, 2000]
    assert B.tail_of(b"\xff" * 40) is None and B.tail_of(b"") is None


def test_tail_outputs_above_one_block():
    """Six billion is more than a block pays: by default no such output is believed, with a larger limit it is."""
    out = lambda value, script: value.to_bytes(8, "little") + bytes([len(script)]) + script
    tail = b"\xff" * 5 + out(6_000_000_000, b"\x51" * 25) + out(7, b"\x6a") + bytes(4)
    assert [o["value"] for o in B.tail_of(tail, B.LARGE_VALUE)] == [6_000_000_000, 7]
    assert [o["value"] for o in B.tail_of(tail)] == [7]


def test_header_in_parts():
    graph, head, tail = b"fundsgraph", b"h" * 36, b"t" * 12
    told = twice(hashlib.sha256(graph[:5]).digest() + hashlib.sha256(graph[5:]).digest())[::-1]
    link = b"L" * 32
    root = twice(twice(b"before" + told + b"after") + link[::-1])
    data = head + b"\x06before\x05after\x01" + link + tail
    got = B.rebuild_header(data, graph, twice(head + root + tail)[::-1])
    assert got["split"] == 5 and got["header"] == (head + root + tail).hex()
    assert B.rebuild_header(data, graph, bytes(32)) is None and B.rebuild_header(data[:-1], graph, bytes(32)) is None


def test_batches():
    data = B.encode_batch({"b": 1, "a": "x"}, [b"one", b"two"])
    assert B.decode_batch(data) == {"metadata": '{"a":"x","b":1}', "headers": [b"one".hex(), b"two".hex()]}
    for bad in (data + b"x", b"X" + data[1:], data[:8] + b"\x09" + data[9:]):
        with pytest.raises(ValueError):
            B.decode_batch(bad)
    with pytest.raises(ValueError):
        B.encode_batch({}, [b""])


def test_frames_of_impossible_size():
    magic = bytes.fromhex("f9beb4d9")
    for size in (0, 8_000_001):
        with pytest.raises(ValueError, match="size"):
            list(split_frames(magic + size.to_bytes(4, "little") + b"abc", magic))
    assert masked(masked(b"hello world", b"\x01\x02\x03"), b"\x01\x02\x03") == b"hello world" and masked(b"", b"\x01") == b""


def test_find_on_borders_of_bytes(spark):
    rows = [("03e0a503fabe6d6d", "fabe6d6d", 4), ("0fabe6d6d0", "fabe6d6d", -1), ("", "aa", -1), ("aaaa", "aa", 0)]
    got = spark.createDataFrame(rows, "s string, n string, want int").select(X.find(F.col("s"), F.col("n")).alias("at"), "want").collect()
    assert all(r["at"] == r["want"] for r in got)


@pytest.mark.parametrize(("script", "want"), [("6a", None), ("6a4e04000000deadbeef", "deadbeef"), ("6a4e05000000deadbeef", None), ("6a51", ""), ("6a00", ""), ("6a4c", ""), ("6a4d0200beef", "beef"), ("51", None), ("6a02aa", None)])
def test_op_return(spark, script, want):
    assert spark.createDataFrame([(script,)], "s string").select(X.op_return_payload(F.col("s"))).first()[0] == want


def test_verdicts_overwrite(spark):
    rows = [("VALID", None, "VALID"), ("REJECTED: a", "UNKNOWN: b", "REJECTED: a"), ("REJECTED: a", "REJECTED: b", "REJECTED: b"), ("UNKNOWN: a", "UNKNOWN: b", "UNKNOWN: b"), ("VALID", "UNKNOWN: b", "UNKNOWN: b")]
    got = spark.createDataFrame(rows, "now string, next string, want string").select(overwritten(F.col("now"), F.col("next")).alias("got"), "want").collect()
    assert all(r["got"] == r["want"] for r in got)


def test_claims(spark):
    rows = [(["a", "b"], ["a", "b"], "a", []), (["a"], ["b"], "a", ["not proven: a", "not claimed: b"]), ([], ["b"], None, ["not claimed: b", "no rule claimed"]), (["a"], ["a"], "b", ["reason is not the first rule"])]
    got = spark.createDataFrame(rows, "c array<string>, d array<string>, r string, want array<string>").select(claim_failures(F.col("c"), F.col("d"), F.col("r")).alias("got"), "want").collect()
    assert all(r["got"] == r["want"] for r in got)


def test_child_bundles(spark):
    genesis = "01000000" + "00" * 32 + "3ba3edfd7a7b12b27ac72c3e67768f617fc81bc3888a51323a9fb8aa4b1e5e4a" + "29ab5f49ffff001d1dac2b7c"
    name = "000000000019d6689c085ae165831e934ff763ae46a2a6c172b3f1b60a8ce26f"
    rows = [(name, genesis, "1231006505", "1d00ffff", None), (name, genesis, "1", "1d00ffff", "child time differs from its header"), (name[::-1], genesis, "", "", "child header hashes to another block"), ("", "", "", "", None), (name, "zz", "", "", "malformed child header")]
    got = spark.createDataFrame(rows, "h string, x string, t string, b string, want string").select(bundle_fault(F.col("h"), F.col("x"), F.col("t"), F.col("b"), False).alias("got"), bundle_fault(F.col("h"), F.col("x"), F.col("t"), F.col("b"), True).alias("whole"), "want").collect()
    assert all(r["got"] == r["want"] for r in got) and got[3]["whole"] == "incomplete child bundle"


def test_evidence_of_a_normalised_table(spark):
    """A table that is already in the schema keeps its provenance when it is read again."""
    source = Source("alpha", "full_inventory", "here.csv", "full", "archive")
    first = normalised(spark.createDataFrame([("7", "orphan")], "source_row_number string, classification string"), source)
    again = normalised(first.drop("errors", "child_fault"), Source("alpha", "other", "there.csv", "x", "y")).first()
    assert (again["source_path"], again["provenance"], again["source_row_number"], again["classification"]) == ("here.csv", "archive", "7", "unknown")
    assert again["errors"] == ["missing_or_malformed_btc_header_hash"]


def test_targets_with_two_heights_fail(spark):
    rows = spark.createDataFrame([("c", "h", 1, "stale"), ("c", "h", 2, "stale")], "chain string, btc_header_hash string, child_height bigint, classification string")
    with pytest.raises(Exception, match="two child heights"):
        recovery_targets(rows).collect()


def test_coverage_of_files(spark):
    index = spark.createDataFrame([(1, "a"), (2, "b")], "height bigint, txid string")
    none = spark.createDataFrame([], "height bigint")
    for read, failures, text in (([(1, "a")], none, "missing"), ([(1, "x"), (2, "b")], none, "another txid"), ([(1, "a"), (2, "b"), (3, "c")], none, "isn't in the index")):
        with pytest.raises(Exception, match=text):
            authenticated(spark.createDataFrame(read, "height bigint, txid string"), index, failures).collect()


def test_epochs_must_stay_on_the_chain(spark, tmp_path):
    kind = "height bigint, bits string, hash string, time bigint"
    source = spark.createDataFrame([(0, "b", "h0", 1), (2016, "b", "h1", 2)], kind)
    kept = spark.createDataFrame([(0, "b", "other", 1)], kind)
    refresh_reference(spark, kept, f"file://{tmp_path}/reference", 2000)
    with pytest.raises(ValueError, match="not on the chain"):
        refresh_reference(spark, source, f"file://{tmp_path}/reference", 5000)


def test_rows_of_unknown_sources_fail(spark):
    for chains in ("chain1|chain1", "other"):
        with pytest.raises(Exception, match="malformed"):
            builder_rows(spark.createDataFrame([(chains,)], "source_chains string"), ("chain",)).collect()


def test_outputs_must_differ():
    with pytest.raises(ValueError):
        distinct_destinations(["a/b", "a/b/"])


def test_lagged_like_a_window(spark):
    from pyspark.sql import Window

    rows = spark.range(0, 300).select((F.col("id") % 3 == 0).alias("g"), (F.col("id") * 37 % 101).alias("k"), "id")
    want = rows.withColumn("before", F.lag("id", 4).over(Window.partitionBy("g").orderBy("k", "id")))
    got = lagged(rows, "g", ["k", "id"], 4, before="id")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
