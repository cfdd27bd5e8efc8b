"""Header chains validated in order, page by page, with the state of each chain kept between pages and between runs.

A header is accepted if it stands at the next height, names the last accepted header as the one before it, and has the bits that the
chain's rules ask for. One that isn't is refused, with the first reason, and leaves the state as it is: what follows it is out of order
until a header comes that fits. So the verdicts don't depend on how headers are dealt out to pages and batches, as long as these are in order.

What a header says by itself (hash, work, version) is cheap and parallel, and belongs before this step: only narrow rows come here, a page of each chain
at a time. The state of a chain is its tip and the times of the last headers that its rules look back on: 2,016 of them at most for the rules that
are built in.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.parsers import compact_of, target_of
from ..functions.retarget import ERAS, LIMIT, SET_BITS, Era
from .settings import held

STATE = "height long, hash string, bits string, times array<long>"
PAGE = "chain string, height long, hash string, prev string, t long, bits string"
VERDICTS = "chain string, height long, hash string, status string"
ACCEPTED, UNORDERED, UNLINKED, WRONG_BITS = "accepted", "out of order", "broken link", "bits mismatch"


@dataclass(frozen=True)
class Rules:
    eras: tuple[Era, ...] = ERAS
    set_bits: dict[int, str] = field(default_factory=lambda: dict(SET_BITS))
    limit: str = LIMIT

    @property
    def memory(self) -> int:
        return max(e.back for e in self.eras)

    def next_bits(self, height: int, bits: str, times: list[int]) -> str | None:
        """The bits that a header at ``height`` must have after one with ``bits``; ``times`` are those of the headers before it. As ``retarget.next_bits``, for one
        header."""
        if height in self.set_bits:
            return self.set_bits[height]
        era = next(e for e in self.eras if e.until is None or height < e.until)
        if height % era.every:
            return bits
        target, limit = target_of(bits), int(self.limit, 16)
        if len(times) < era.back or target is None or not 0 < target <= limit:
            return None
        span = max(era.low, min(era.high, times[-1] - times[-era.back]))
        return f"{compact_of(min(limit, target * span // era.divisor)):08x}"


@dataclass
class Chain:
    """The state of one chain: height, hash and bits of its tip, and its last times. Before the first header the height is -1."""

    height: int = -1
    hash: str = ""
    bits: str = ""
    times: list[int] = field(default_factory=list)

    def judged(self, height: np.ndarray, hashes: np.ndarray, prev: np.ndarray, t: np.ndarray, bits: np.ndarray, rules: Rules) -> list[str]:
        """The status of headers in their order; the state is brought forward. The first header of a chain is linked with nothing, and its bits are its own."""
        out, i, n = [UNORDERED] * len(height), 0, len(height)
        while i < n:
            there = np.flatnonzero(height[i:] == self.height + 1)
            if not len(there):
                break
            i += int(there[0])
            steps = np.flatnonzero(np.diff(height[i:]) != 1)
            end = i + int(steps[0]) + 1 if len(steps) else n
            before = np.r_[np.array([self.bits], object), bits[i : end - 1]]
            linked = prev[i:end] == np.r_[np.array([self.hash], object), hashes[i : end - 1]]
            times = [*self.times, *t[i:end].tolist()]
            known = len(self.times)
            fits = np.array([height[i + k] == 0 or bits[i + k] == rules.next_bits(int(height[i + k]), before[k], times[max(0, known + k - rules.memory) : known + k]) for k in range(end - i)], bool)
            if height[i] == 0:
                linked[0] = True
            wrong = np.flatnonzero(~(linked & fits))
            cut = int(wrong[0]) if len(wrong) else end - i
            out[i : i + cut] = [ACCEPTED] * cut
            if cut:
                last = i + cut - 1
                self.height, self.hash, self.bits = int(height[last]), hashes[last], bits[last]
                self.times = times[: known + cut][-rules.memory :]
            i += cut
            if len(wrong):
                out[i] = WRONG_BITS if linked[cut] else UNLINKED
                i += 1
        return out


class Validator(StatefulProcessor):
    def __init__(self, rules: Rules) -> None:
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("chain", STATE)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        page = pd.concat(list(rows), ignore_index=True).sort_values("height", kind="stable")
        chain = Chain()
        if self.state.exists():
            height, tip, bits, times = self.state.get()
            chain = Chain(int(height), tip, bits, [int(x) for x in times])
        columns = (page[c].to_numpy() for c in ("height", "hash", "prev", "t", "bits"))
        status = chain.judged(*columns, self.rules)
        self.state.update((chain.height, chain.hash, chain.bits, chain.times))
        yield pd.DataFrame({"chain": key[0], "height": page["height"].to_numpy(), "hash": page["hash"].to_numpy(), "status": status})

    def close(self) -> None:
        pass


def validated(spark: SparkSession, source: str, checkpoint: str, out: str, rules: Rules = Rules(), files: int = 1) -> DataFrame:
    """(chain, height, hash, status) of all headers in files under ``source`` (rows of PAGE), ``files`` at a time in order of their writing. A later call with the same
    checkpoint goes on from the state and reads new files only; a batch that runs again after a failure replaces its own output."""
    schema = T.StructType.fromDDL(PAGE)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    told = stream.groupBy("chain").transformWithStateInPandas(Validator(rules), T.StructType.fromDDL(VERDICTS), "append", "none")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    with held(spark):
        told.writeStream.outputMode("append").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(T.StructType.fromDDL(VERDICTS)).parquet(f"{out}/*")
