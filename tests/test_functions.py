"""Vectors that are public knowledge, for functions whose SQL twin would share a mistake."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import hexbytes as X
from palimpsest.functions import parsers as P
from palimpsest.operators.matching import anti_exact, asof_backward
from palimpsest.sources.files import refuse_pointers, split_frames

GENESIS = "01000000" + "00" * 32 + "3ba3edfd7a7b12b27ac72c3e67768f617fc81bc3888a51323a9fb8aa4b1e5e4a" + "29ab5f49ffff001d1dac2b7c"
GENESIS_HASH = "000000000019d6689c085ae165831e934ff763ae46a2a6c172b3f1b60a8ce26f"


def test_genesis_header(spark):
    row = spark.createDataFrame([(GENESIS,)], "h string").select(X.header_fields(F.col("h")).alias("f")).select("f.*").first()
    assert row["hash"] == GENESIS_HASH and row["bits"] == "1d00ffff" and row["time"] == 1231006505 and row["nonce"] == 2083236893 and row["version"] == 1


def test_genesis_meets_its_target(spark):
    row = spark.createDataFrame([("1d00ffff", GENESIS_HASH)], "b string, h string").select(X.target(F.col("b")).alias("t"), X.meets(F.col("h"), X.target(F.col("b"))).alias("m")).first()
    assert row["t"] == "00000000ffff" + "0" * 52 and row["m"]


@pytest.mark.parametrize(("bits", "want"), [("03123456", "123456".rjust(64, "0")), ("02123456", "1234".rjust(64, "0")), ("01123456", "12".rjust(64, "0")), ("04923456", None), ("zz", None), ("23000001", "f" * 64), ("22000001", "01" + "0" * 62), ("20000000", "0" * 64)])
def test_targets(spark, bits, want):
    assert spark.createDataFrame([(bits,)], "b string").select(X.target(F.col("b"))).first()[0] == want


@pytest.mark.parametrize(("script", "want"), [("03a08601", 100000), ("00", 0), ("51", 1), ("60", 16), ("0164", 100), ("02ff00", 255), ("0181", -1), ("03a086", None), ("", None), ("4c03a08601", 100000), ("ff", None)])
def test_pushed_height(spark, script, want):
    assert spark.createDataFrame([(script,)], "s string").select(X.pushed_height(F.col("s"))).first()[0] == want


@pytest.mark.parametrize(("height", "want"), [(0, "00"), (16, "60"), (17, "0111"), (128, "028000"), (32768, "03008000"), (227931, "035b7a03"), (8388608, "0400008000")])
def test_push_prefix(spark, height, want):
    assert spark.createDataFrame([(height,)], "h long").select(X.push_prefix(F.col("h"))).first()[0] == want


def test_marker_between_bytes_is_no_marker(spark):
    row = spark.createDataFrame([("0fabe6d6d0" + "00" * 40,)], "s string").select(X.marker(F.col("s")).alias("m")).first()["m"]
    assert row["status"] == "absent"


def test_addresses():
    program = bytes.fromhex("751e76e8199196d454941c45d1b3a323f1433bd6")
    assert P.address_of(b"\x00\x14" + program) == "bc1qw508d6qejxtdg4y5r3zarvary0c5xw7kv8f3t4"
    assert P.address_of(b"\x76\xa9\x14" + bytes.fromhex("62e907b15cbf27d5425399ebf6f0fb50ebb88f18") + b"\x88\xac") == "1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa"
    assert P.script_of("bc1qw508d6qejxtdg4y5r3zarvary0c5xw7kv8f3t4") == "0014" + program.hex()
    assert P.script_of("1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa") == "76a91462e907b15cbf27d5425399ebf6f0fb50ebb88f1888ac"
    assert P.address_of(b"\x6a") is None and P.script_of("0OIl") is None


def test_compact_form():
    target = int("00000000ffff" + "0" * 52, 16)
    assert P.compact_of(target) == 0x1D00FFFF and P.target_of("1d00ffff") == target
    assert P.target_of("1d80ffff") is None and P.target_of("zz") is None and P.target_of("1d00fff") is None


def test_frames_mask_and_noise():
    magic, mask = bytes.fromhex("f9beb4d9"), b"\x01\x02\x03"
    data = b"xx" + magic + (3).to_bytes(4, "little") + b"abc" + b"y" + magic + (9).to_bytes(4, "little") + b"cut"
    assert [b for _, b in split_frames(data, magic)] == [b"abc"]
    masked = bytes(b ^ mask[i % 3] for i, b in enumerate(data))
    assert [b for _, b in split_frames(masked, magic, mask)] == [b"abc"]


def test_gate_must_be_sound(spark):
    rows = spark.createDataFrame([(1,)], "k long")
    for bad in ([], [(None,)], [(1,), (1,)]):
        with pytest.raises(ValueError, match="gate"):
            anti_exact(rows, spark.createDataFrame(bad, "k long"), ["k"])


def test_asof_large_table_as_small(spark):
    rows = spark.range(0, 500).select((F.col("id") * 3 - 20).alias("at"))
    table = spark.range(0, 120).select((F.col("id") * 11).alias("start"), (F.col("id") + 100).alias("v"))
    small = {r["at"]: r["v"] for r in asof_backward(rows, "at", table, "start").collect()}
    large = {r["at"]: r["v"] for r in asof_backward(rows, "at", table, "start", bound=1).collect()}
    assert small == large and small[-20] is None and small[1] == 100


def test_asof_of_hot_times_and_uneven_entries(spark):
    """Nine rows in ten lie at one time or after the last entry, entries stand close together and far apart, some twice; nulls meet nothing."""
    times = [*[5_000] * 400, *range(900_000, 900_400), *range(0, 6000, 50), None, None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(times)], "id long, at long")
    entries = [*range(1000, 1100), 4_999, 5_001, 800_000, 800_000]
    table = spark.createDataFrame([(s, f"v{s}") for s in entries] + [(None, "none")], "start long, v string")
    want = {i: max((s for s in entries if t is not None and s <= t), default=None) for i, t in enumerate(times)}
    for bound in (10_000, 1):
        got = asof_backward(rows, "at", table, "start", bound=bound).collect()
        assert len(got) == len(times) and {r["id"]: r["start"] for r in got} == want
        assert all(r["v"] == (None if r["start"] is None else f"v{r['start']}") for r in got)
    held = asof_backward(rows, "at", table, "start", bound=1)
    assert held.columns == ["id", "at", "start", "v"]


@pytest.mark.parametrize("text,want", [("10016001", f"{10_016_001:08x}"), ("386924253", f"{386_924_253:08x}"), ("65597843877", f"{65_597_843_877:x}"), ("x", None), ("1" * 19, None)])
def test_decimal_bits(spark, text, want):
    assert spark.range(1).select(X.bits_text(F.lit(text), F.lit(True)).alias("b")).first()["b"] == want


@pytest.mark.parametrize("h", ["", "0a", "0a1b", "00ff" * 80, "0A1b", "abc", "zz00", "é1", None])
def test_reversed_bytes(spark, h):
    """Malformed texts and upper case go as they always went: the pairs from the end."""
    want = None if h is None else "".join([h[max(0, i - 2) : i] for i in range(len(h), 0, -2)])
    assert spark.createDataFrame([(h,)], "h string").select(X.rev_any(F.col("h")).alias("r")).first()["r"] == want


def test_supplement_of_forks(spark, tmp_path):
    """Two events whose headers share a height, one with a supplement and one of the other's file."""
    from palimpsest.plans.relational import j14_supplement

    spark.sql("select id as event_id, timestamp_seconds(1700000000 + id) as ts, id as user_id, 'x' as event_type from values (2L), (180002L), (360001L) as v(id)").write.parquet(f"{tmp_path}/events.parquet")
    assert {r["id"]: r["graph"] for r in j14_supplement(spark, str(tmp_path)).collect()} == {2: 1_700_000_004, 180_002: 1_700_180_004, 360_001: None}


def test_pointer_is_refused(spark, tmp_path):
    (tmp_path / "x.csv").write_text("version https://git-lfs.github.com/spec/v1\noid sha256:0\n")
    with pytest.raises(ValueError, match="pointer"):
        refuse_pointers(spark, str(tmp_path / "x.csv"))


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_headers_are_generated_code(spark):
    """No function by name in the headers' columns: one of them takes a whole row's columns out of generated code."""
    from palimpsest.plans.evidence import headers

    assert "transform(" not in _plan(headers(spark, "/root/testdata/sf0.001"))


@pytest.mark.parametrize("h", ["", "0a", "0A1b", "00ff" * 80, None])
def test_turned_bytes(spark, h):
    want = None if h is None else bytes.fromhex(h)[::-1].hex()
    assert spark.createDataFrame([(h,)], "h string").select(X.turned(F.col("h")).alias("r")).first()["r"] == want


def test_retarget_finds_its_target_once(spark):
    from palimpsest.functions.retarget import compact_bits, scaled

    big = F.concat(F.lit("00ff"), F.sha2(F.col("id").cast("string"), 224))
    plan = _plan(spark.range(3).select(compact_bits(scaled(big, F.col("id") + 1, 7)).alias("x")))
    assert plan.count("sha2(") == 1


def test_addresses_both_ways():
    """Leading zeros, all versions and sizes; texts with a letter that no address has."""
    for version in range(17):
        for size in (2, 3, 20, 31, 32, 40):
            script = bytes([version and 0x50 + version, size]) + bytes(range(size))
            text = P.address_of(script)
            assert P.script_of(text) == P.script_of(text.upper()) == script.hex() and P.script_of(text[:-1] + "b") is None
    for zeros in range(21):
        body = bytes(zeros) + bytes(range(200, 220 - zeros))
        for script in (b"\x76\xa9\x14" + body + b"\x88\xac", b"\xa9\x14" + body + b"\x87"):
            assert P.script_of(P.address_of(script)) == script.hex()


def test_headers_are_made_once_on_all_cores(spark):
    """The classifier reads of a header what is claimed, and the events' few files don't set the number of tasks."""
    from palimpsest.operators.classifier import worked
    from palimpsest.plans import relational
    from palimpsest.plans.evidence import headers

    sf = "/root/testdata/sf0.001"
    h = headers(spark, sf, spread=True)
    assert h.rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
    assert "merkle_root" not in worked(h, "id")._jdf.queryExecution().optimizedPlan().toString()
    assert not [f for f in relational.f10_routing(spark, sf).inputFiles() if "events.parquet" in f]
