"""Operators that keep a value for each key over the batches of a stream, and give rows for each row that comes.

Rows of a key are taken in order within a batch; batches are taken as they come. A task holds a key's rows of one batch, so the
source's rate per trigger bounds it, and the state is one row a key. State lies in the checkpoint with the stream's
offsets: a stream that is started again goes on where it was.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.scores import regime
from . import jobs

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class RunningTotal(StatefulProcessor):
    """The sum of a key so far, after each of its rows. Amounts and sums are whole hundred-thousandths."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.total = handle.getValueState("total", "units long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known = self.total.get()
        own = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        own["units"] = own["units"].cumsum() + (known[0] if known else 0)
        self.total.update((int(own["units"].iloc[-1]),))
        yield own[["auction_id", "event_id", "units"]]

    def close(self) -> None:
        pass


class Cooldown(StatefulProcessor):
    """Changes of a run's kind that come at least `wait` microseconds after the last one that was let through."""

    def __init__(self, wait: int):
        self.wait = wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "kind string, changed long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known = self.state.get()
        current, changed = known if known else (None, None)
        own, out = pd.concat(list(rows)).sort_values("seq"), []
        for run, seq, at, kind in zip(own["run"], own["seq"], own["at"], own["kind"], strict=True):
            if current is None:
                current = kind
            elif kind != current and (changed is None or at - changed >= self.wait):
                out.append((run, seq, current, kind))
                current, changed = kind, int(at)
        self.state.update((current, changed))
        yield pd.DataFrame(out, columns=["run", "seq", "from_regime", "to_regime"])

    def close(self) -> None:
        pass


def to_files(stream: DataFrame, path: str) -> DataFrame:
    """jobs.to_files() with the state store that these operators need; the setting counts when a stream is started."""
    conf = stream.sparkSession.conf
    before = conf.get(PROVIDER)
    conf.set(PROVIDER, ROCKS)
    try:
        return jobs.to_files(stream, path)
    finally:
        conf.set(PROVIDER, before)


def _kept(rows: DataFrame, by: str, processor: StatefulProcessor, schema: str) -> DataFrame:
    return rows.groupBy(by).transformWithStateInPandas(processor, schema, "Append", "None")


def running_rows(amounts: DataFrame) -> DataFrame:
    """auction_id, event_id, total: one row for each row of the stream. Amounts count to 5 decimals; totals to 92 trillion."""
    units = (F.col("amount").cast("decimal(20,5)") * F.lit(100_000)).cast("long")
    rows = amounts.select("auction_id", "event_id", F.unix_micros("ts").alias("ts"), units.alias("units"))
    found = _kept(rows, "auction_id", RunningTotal(), "auction_id long, event_id long, units long")
    return found.select("auction_id", "event_id", F.expr("cast(cast(units as decimal(20,0)) * 0.00001 as double)").alias("total"))


def cooldown_changes(ticks: DataFrame, seconds: int) -> DataFrame:
    """run, seq, from_regime, to_regime of accepted changes. ticks: run (text), seq, ts (timestamp), cpu; rows without seq or ts are left out.

    A run's rows must not go back before those of earlier batches by seq. A null run is a run like any other.
    """
    rows = ticks.where("seq is not null and ts is not null").select("run", F.col("seq").cast("long").alias("seq"), F.unix_micros("ts").alias("at"), regime(F.col("cpu")).alias("kind"))
    return _kept(rows, "run", Cooldown(seconds * 1_000_000), "run string, seq long, from_regime string, to_regime string")
