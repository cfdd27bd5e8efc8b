"""Next bits, validation in order, rows that wait, the reference that grows, block files: what must fail, and what a second run goes on from."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.functions import retarget, sqlnames
from palimpsest.functions.hexbytes import target
from palimpsest.functions.parsers import compact_of, target_of
from palimpsest.sources import blkdat
from palimpsest.sources.family import read_family
from palimpsest.sources.files import masked
from palimpsest.sources.reference import refresh_reference
from palimpsest.streaming.pending import settled
from palimpsest.streaming.validated import ACCEPTED, UNLINKED, UNORDERED, WRONG_BITS, Chain, Rules, validated

MAGIC = bytes.fromhex("f9beb4d9")


# --- bits ---


def test_scaled_and_compact(spark):
    rng = np.random.default_rng(3)
    rows = [(f"{int.from_bytes(rng.bytes(int(rng.integers(1, 33))), 'big'):064x}", int(rng.integers(1, 2**31)), int(rng.integers(1, 2**31))) for _ in range(300)]
    rows += [("f" * 64, 2**31 - 1, 1), ("0" * 64, 5, 3), ("0" * 63 + "1", 1, 2**31 - 1), ("0" * 58 + "800000", 1, 1), ("0" * 62 + "7f", 1, 1)]
    got = spark.createDataFrame(rows, "t string, a long, b long").select("t", "a", "b", retarget.scaled(F.col("t"), F.col("a"), F.col("b")).alias("q"), retarget.compact_bits(F.col("t")).alias("c")).collect()
    for r in got:
        assert int(r["q"], 16) == int(r["t"], 16) * r["a"] // r["b"] and len(r["q"]) == 77
        assert r["c"] == f"{compact_of(int(r['t'], 16)):08x}"


def test_next_bits_like_the_rules(spark):
    """The expression and the step of the stream agree in every era, at clamps and set heights; broken bits give none."""
    rng = np.random.default_rng(4)
    rules, rows = Rules(), []
    for height in [1, 2015, 2016, 48_384, 48_949, 48_950, 48_951, 48_960, 71_690, 71_699, 71_700, 71_701, 150_000, 260_499, 260_500]:
        for bits in ["1d00ffff", "1908cf19", "2000ffff", "207fffff", "1d80ffff", "0100ffff", "zz", "03000001"]:
            spans = [0, 36, 38, 40, 5_917, 6_000, 10**6, 10**8, int(rng.integers(1, 10**7))]
            rows += [(height, bits, 10**9, 10**9 - s) for s in spans]
    firsts = {e.back: F.col("first") for e in retarget.ERAS}
    got = spark.createDataFrame(rows, "height long, bits string, t long, first long").withColumn("n", retarget.next_bits(F.col("height"), F.col("bits"), F.col("t"), firsts)).collect()
    for r in got:
        back = next(e.back for e in retarget.ERAS if e.until is None or r["height"] < e.until)
        assert r["n"] == rules.next_bits(r["height"], r["bits"], [r["first"], *[0] * (back - 2), r["t"]]), r
    none = spark.range(1).select(retarget.next_bits(F.lit(0), F.lit("1d00ffff"), F.lit(1), firsts | {k: F.lit(1) for k in firsts}).alias("n")).first()
    assert none["n"] is None


def test_sql_functions_equal_expressions(spark):
    sqlnames.register(spark)
    bits = ["1d00ffff", "207fffff", "0300ffff", "02123456", "01003456", "00123456", "1d80ffff", "ff7fffff", "21000100", "220000ff", "zz", ""]
    got = spark.createDataFrame([(b,) for b in bits], "bits string").select("bits", F.expr("compact_target(bits)").alias("a"), target(F.col("bits")).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in got), got
    plan = spark.sql("SELECT header_hash(repeat('00', 80)) AS h")._jdf.queryExecution().optimizedPlan().toString()
    assert "header_hash" not in plan
    assert spark.sql("SELECT reversed_hex('0102ff')").first()[0] == "ff0201"


# --- ordered validation ---

STEADY = Rules((retarget.Era(None, 4, 4, 100, 1600, 300),), {})


def chain_rows(n: int, start: int = 0, name: str = "c") -> list[tuple]:
    return [(name, h, f"{name}{h}", f"{name}{h - 1}", 100 * h, "1d00ffff") for h in range(start, start + n)]


def judged(rows: list[tuple], chain: Chain, rules: Rules = STEADY) -> list[str]:
    columns = list(zip(*rows, strict=True))
    arrays = [np.array(columns[1]), *(np.array(c, object) for c in columns[2:4]), np.array(columns[4]), np.array(columns[5], object)]
    return chain.judged(*arrays, rules)


def test_refused_headers_leave_the_state():
    chain, rows = Chain(), chain_rows(12)
    assert judged(rows[:6], chain) == [ACCEPTED] * 6
    broken = [(*rows[6][:3], "other", *rows[6][4:]), *rows[7:9]]
    assert judged(broken, chain) == [UNLINKED, UNORDERED, UNORDERED]
    assert chain.height == 5
    wrong = [(*rows[6][:5], "1c7fffff"), rows[7]]
    assert judged(wrong, chain) == [WRONG_BITS, UNORDERED]
    assert judged(rows[4:], chain) == [UNORDERED] * 2 + [ACCEPTED] * 6 and chain.height == 11 and len(chain.times) == 4


@settings(max_examples=100, deadline=None)
@given(cuts=st.lists(st.integers(0, 60), max_size=6), late=st.integers(0, 59), bad=st.integers(0, 59))
def test_verdicts_do_not_depend_on_pages(cuts, late, bad):
    rows = chain_rows(60)
    rows[late] = (*rows[late][:4], rows[late][4] + 777, rows[late][5])
    rows[bad] = (*rows[bad][:3], "x", *rows[bad][4:])
    whole, chain, told = judged(rows, Chain()), Chain(), []
    for a, b in zip([0, *sorted(cuts)], [*sorted(cuts), 60], strict=True):
        told += judged(rows[a:b], chain) if a < b else []
    assert told == whole


def test_a_target_follows_the_times():
    """Headers that come twice as fast halve the target at the next change."""
    rules = Rules((retarget.Era(None, 4, 4, 1, 10**6, 300),), {})
    rows = [("c", h, f"c{h}", f"c{h - 1}", 50 * h, "1d00ffff") for h in range(4)]
    want = f"{compact_of(target_of('1d00ffff') * 150 // 300):08x}"
    rows.append(("c", 4, "c4", "c3", 200, want))
    assert judged(rows, Chain(), rules) == [ACCEPTED] * 5 and want == "1c7fff80"


def test_stream_goes_on_after_a_stop(spark, tmp_path):
    """A page with a broken link is refused; the corrected page, in a later run, is accepted from where the chain stood."""
    kind = "chain string, height long, hash string, prev string, t long, bits string"
    hot, other = chain_rows(30, name="hot"), chain_rows(10, name="d")
    bad = [(*hot[20][:3], "x", *hot[20][4:]), *hot[21:25]]
    run = lambda: validated(spark, f"{tmp_path}/in", f"{tmp_path}/checkpoint", f"{tmp_path}/out", STEADY)
    put = lambda rows: spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    put(hot[:20] + other[:5])
    put(bad)
    assert sorted((r["status"], r["height"]) for r in run().where("chain = 'hot' and height >= 20").collect()) == [(UNLINKED, 20), *((UNORDERED, h) for h in range(21, 25))]
    put(hot[20:] + other[5:])
    got = run().collect()
    assert len(got) == 45 and sum(r["status"] == ACCEPTED for r in got) == 40
    assert run().count() == 45
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")


def test_the_first_header_of_a_height_is_the_tip(spark, tmp_path):
    from palimpsest.streaming.tips import chain_tips

    kind = "chain string, height long, hash string, place long"
    rows = [("c", 7, "zz", 9), ("c", 7, "bb", 4), ("c", 7, "cc", 5), ("c", 6, "yy", 1)]
    for row in rows:
        spark.createDataFrame([row], kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    schema = spark.createDataFrame(rows, kind).schema
    got = chain_tips(spark, f"{tmp_path}/in", schema, f"{tmp_path}/checkpoint", f"{tmp_path}/out", files=1).collect()
    assert [tuple(r) for r in got] == [("c", 4, 7, "bb")]


# --- rows that wait ---


def test_rows_are_decided_once(spark, tmp_path):
    waiting = spark.createDataFrame([(i, 10 * i) for i in range(10)], "id long, t long")
    calls = []

    def decide(rows, known):
        last = known.agg(F.max("until")).first()[0]
        calls.append(rows.count())
        return rows.withColumn("verdict", F.when(F.col("t") <= last, F.lit(f"by {last}")))

    put = lambda until: spark.createDataFrame([(until,)], "until long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run = lambda: settled(spark, waiting, f"{tmp_path}/in", spark.createDataFrame([], "until long").schema, decide, str(tmp_path))
    put(30)
    decided, pending = run()
    assert decided.count() == 4 and pending.count() == 6
    put(35)
    put(70)
    decided, pending = run()
    assert sorted((r["id"], r["verdict"], r["refresh"]) for r in decided.collect()) == [*((i, "by 30", 0) for i in range(4)), *((i, "by 70", 2) for i in range(4, 8))]
    assert sorted(r["id"] for r in pending.collect()) == [8, 9] and calls == [10, 6, 6]
    put(1000)
    assert run()[1].count() == 0 and run()[1].count() == 0


# --- the reference ---


def source(spark, n: int, fork: int | None = None):
    return spark.createDataFrame([(h, f"b{h}", f"h{h}{'x' if fork is not None and h >= fork else ''}", h) for h in range(n)], "height long, bits string, hash string, time long")


def test_reference_keeps_and_refuses(spark, tmp_path):
    root = f"file://{tmp_path}/reference"
    first = refresh_reference(spark, source(spark, 100), root, 50, interval=10)
    assert sorted(r["height"] for r in first["headers"].collect()) == [0, 10, 20, 30, 40, 44]
    second = refresh_reference(spark, source(spark, 100), root, 86, interval=10)
    assert sorted((r["height"], r["refresh"]) for r in second["epochs"].collect()) == [(h, 1 if h <= 40 else 2) for h in range(0, 90, 10)]
    assert second["headers"].count() == 9
    before = sorted(map(tuple, second["epochs"].collect()))
    with pytest.raises(ValueError, match="kept hash at 80"):
        refresh_reference(spark, source(spark, 200, fork=80), root, 150, interval=10)
    with pytest.raises(ValueError, match="kept hash"):
        refresh_reference(spark, source(spark, 75), root, 150, interval=10)
    with pytest.raises(ValueError, match="below"):
        refresh_reference(spark, source(spark, 75), root, 3, interval=10)
    assert sorted(map(tuple, read_family(spark, root)["epochs"].collect())) == before
    again = refresh_reference(spark, source(spark, 100, fork=60), root, 58, interval=10)
    assert max(r["height"] for r in again["epochs"].collect()) == 50


# --- block files ---


def framed(blocks: list[bytes], noise: bytes = b"") -> bytes:
    return b"".join(noise + MAGIC + len(b).to_bytes(4, "little") + b for b in blocks)


def files(folder, blocks: dict[str, bytes], mask: bytes = b"") -> str:
    folder.mkdir()
    for name, data in blocks.items():
        (folder / name).write_bytes(masked(data, mask) if mask else data)
    return f"file://{folder}"


@pytest.mark.parametrize("step", [1, 7, 64, 1 << 20])
@pytest.mark.parametrize("mask", [b"", b"\x01\x02\x03\x04\x05\x06\x07"])
def test_ranges_read_each_frame_once(spark, tmp_path, step, mask):
    """Borders fall into frames, magics stand inside payloads, and other files lie beside."""
    rng = np.random.default_rng(8)
    blocks = [rng.bytes(int(n)) for n in rng.integers(1, 30, 12)] + [framed([b"inner", b"frame"]), b"x", MAGIC * 3]
    data = framed(blocks, b"\x00\xf9\xbe")
    root = files(tmp_path / "blocks", {"blk00000.dat": data, "blk00001.dat": framed([b"only"]), "blkindex.dat": b"no block", "blk00002.dat": b""}, mask)
    options = {"mask": mask.hex()} if mask else {}
    if step == 1:
        data_frames = list(blkdat.frames_in(blkdat.Bytes(pa_file(tmp_path / "blocks" / "blk00000.dat"), mask), 0, 1 << 40, MAGIC, 100, False))
        assert [b for _, b in data_frames] == blocks
        return
    got = blkdat.read_blocks(spark, root, MAGIC.hex(), rangeBytes=step, **options)
    rows = sorted((r["path"][-12:], r["offset"], bytes(r["block"])) for r in got.collect())
    assert [b for p, _, b in rows if p == "blk00000.dat"] == blocks and [b for p, _, b in rows if p == "blk00001.dat"] == [b"only"]
    assert got.rdd.getNumPartitions() >= -(-len(data) // step)


def pa_file(path):
    from pyarrow import fs

    return fs.LocalFileSystem().open_input_file(str(path))


@pytest.mark.parametrize("tail", [MAGIC + b"\0\0\0\0" + b"rest of it", MAGIC + b"\xff\0\0\0cut", MAGIC + b"\x07\0\0\0seven.."])
def test_bad_frames_fail_or_stop(spark, tmp_path, tail):
    data = framed([b"one", b"two"]) + tail + framed([b"three"])
    root = files(tmp_path / "blocks", {"blk0.dat": data, "blk1.dat": framed([b"four"])})
    most = {"most": 6}
    with pytest.raises(Exception, match="has a size of"):
        blkdat.read_blocks(spark, root, MAGIC.hex(), rangeBytes=8, **most).collect()
    got = blkdat.read_blocks(spark, root, MAGIC.hex(), rangeBytes=8, onBadFrame="stop", **most).collect()
    assert sorted(bytes(r["block"]) for r in got) == [b"four", b"one", b"two"]


def test_key_beside_the_files(spark, tmp_path):
    mask = bytes(range(1, 9))
    root = files(tmp_path / "blocks", {"blk0.dat": framed([b"secret"] * 5)}, mask)
    (tmp_path / "blocks" / "xor.dat").write_bytes(mask)
    assert {bytes(r["block"]) for r in blkdat.read_blocks(spark, root, MAGIC.hex(), rangeBytes=16).collect()} == {b"secret"}
    assert blkdat.read_blocks(spark, f"{root}/blk0.dat", MAGIC.hex(), mask="00").count() == 0


def test_small_ranges_share_a_task():
    """All ranges in their order, few tasks; a large range is alone."""
    sizes = [4096] * 1000 + [1 << 30] + [4096] * 3
    ranges = [blkdat.Range(str(n), 0, s, b"") for n, s in enumerate(sizes)]
    tasks = blkdat.dealt(ranges, blkdat.TASK)
    assert [r.path for t in tasks for r in t.ranges] == [r.path for r in ranges] and len(tasks) < 10
    assert [len(t.ranges) for t in tasks][-2:] == [1, 3] and blkdat.dealt([], 1) == []


def test_small_folders_have_many_tasks(tmp_path):
    """Ranges of some megabytes in all go to many tasks; of many ranges, each task has some."""
    root = files(tmp_path / "blocks", {f"blk{n}.dat": b"\0" * 100 for n in range(200)})
    read = lambda step: blkdat.BlockReader({"path": root, "magic": MAGIC.hex(), "rangeBytes": str(step)}).partitions()
    few, many = read(100), read(10)
    assert all(blkdat.SPREAD <= len(t) <= 2 * blkdat.SPREAD for t in (few, many))
    assert [sum(len(t.ranges) for t in tasks) for tasks in (few, many)] == [200, 2000]


def test_find_over_windows(tmp_path, monkeypatch):
    monkeypatch.setattr(blkdat, "WINDOW", 16)
    (tmp_path / "f").write_bytes(b"\0" * 29 + MAGIC + b"\0" * 40 + framed([b"end"]))
    data = blkdat.Bytes(pa_file(tmp_path / "f"), b"")
    assert data.find(MAGIC, 0) == 29 and data.find(MAGIC, 30) == 73 and data.find(MAGIC, 74) == -1
