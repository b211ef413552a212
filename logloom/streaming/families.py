"""Log families over a stream of lines: hint and rules per line as columns, tallies in keyed state, findings when a file ends.

A line gives its signals without state. What a family remembers of a file is a map of tallies (signal, entity, number: how
often, first line) in Spark's state store, under the key of file, family and lane; lines are dealt to lanes by their number,
so a hot file is not one task, and only tallies that a batch touches are read and written. A file is flushed when a row
says that it ends (line is null), or when its lane has seen no line for `idle` of event time: a timer, which each batch moves on. Until that timer, what still
comes for a file that has ended is flushed with its batch, so rows may arrive in any order.
Tallies add up, so a file that goes on after a flush only gives more of them, and operators.families.judged makes of all
of them together what the batch operator makes of the lines.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..operators import families

#: The parts that the lines of one file are dealt to.
LANES = 8
TALLIES = "file_id string, family string, signal string, entity string, value double, n long, first long"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Tallies(StatefulProcessor):
    """Counts the signals of a key (file, family, lane) until the file ends or falls silent."""

    def __init__(self, idle_ms: int) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("tallies", StructType().add("what", "string"), StructType().add("n", "long").add("first", "long"))
        self.ended = handle.getValueState("ended", StructType().add("ended", "boolean"))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        ends, latest = False, None
        for part in rows:
            ends |= bool(part["signal"].isna().any())
            at = part["at"].max()
            latest = at if latest is None else max(latest, at)
            told = part[part["signal"].notna()]
            for what, own in told.groupby(["signal", "entity", "value"], dropna=False):
                self._add(what, len(own), int(own["line_no"].min()))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int(latest.timestamp() * 1000) + self.idle_ms)
        if ends or self.ended.exists():
            self.ended.update((True,))
            yield from self._flushed(key)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.ended.clear()
        yield from self._flushed(key)

    def close(self) -> None:
        pass

    def _add(self, what: tuple, n: int, first: int) -> None:
        name = (json.dumps([None if pd.isna(x) else x for x in what]),)
        if self.held.containsKey(name):
            n0, first0 = self.held.getValue(name)
            n, first = n + n0, min(first, first0)
        self.held.updateValue(name, (n, first))

    def _flushed(self, key: tuple) -> Iterator[pd.DataFrame]:
        rows = [(key[0], key[1], *json.loads(what), n, first) for (what,), (n, first) in self.held.iterator()]
        self.held.clear()
        if rows:
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in TALLIES.split(", ")])
            yield out.astype({"value": "float64"})


def tallies(lines: DataFrame, names: tuple[str, ...] | None = None, idle: str = "15 minutes", late: str = "10 minutes", lanes: int = LANES) -> DataFrame:
    """lines: a stream of file_id, line_no, line, at (timestamp); a row without a line says that its file ends. Gives, at each
    flush, the tallies of operators.families.judged: append them to a table and judge that. Lines that come over `late`
    after later ones have passed are dropped, as the watermark says. Uses the RocksDB state store, which keeps timers."""
    spark = lines.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    chosen = families.chosen(names)
    lines = lines.withWatermark("at", late)
    told = families.signals(lines, chosen, "at")
    told = told.select("file_id", "family", F.pmod("line_no", F.lit(lanes)).cast("int").alias("lane"), "line_no", "signal", "entity", "value", "at")
    every = F.array(*[F.lit(f.name) for f in chosen])
    ends = lines.where("line is null").select("file_id", F.explode(every).alias("family"), "line_no", "at")
    ends = ends.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    rows = told.unionByName(ends, allowMissingColumns=True)
    seconds = spark.range(1).select(F.unix_seconds(F.timestamp_seconds(F.lit(0)) + F.expr(f"interval {idle}"))).first()[0]
    each = rows.groupBy("file_id", "family", "lane")
    return each.transformWithStateInPandas(Tallies(int(seconds * 1000)), TALLIES, "Append", "EventTime")
