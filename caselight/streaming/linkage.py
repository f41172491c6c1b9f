"""Linkage as a stream, with typed state that is of constant size for each anchor.

An anchor's state is what decides on later reports: the first report's values, whether another value was met for
each field, and the source hashes met (a map in the state store, never loaded whole). Reports of a
micro-batch are taken in the order of time and key, after those of earlier micro-batches. A timer ends an
anchor's state when no report came for ``idle``; reports ``late`` behind the newest are dropped. Both are
parameters.

Reports without an anchor are keyed by their hash, or by their own key. A hash is looked for among the reports
of its anchor: it covers the anchor's columns. State lives in RocksDB, which ``linked`` chooses for the session.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from caselight.functions.text import value_key
from caselight.operators.linkage import ANCHOR, FIELDS

LATE, IDLE = "365 days", timedelta(days=3650)
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
_OUT = "case_key long, relation string, changed string"


class Linker(StatefulProcessor):
    """Relations of an anchor's reports."""

    def __init__(self, fields: tuple[str, ...], idle: timedelta):
        self.fields, self.idle_ms = fields, int(idle.total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.anchor = handle.getValueState("anchor", "values array<string>, other array<boolean>, newest long")
        self.hashes = handle.getMapState("hashes", "hash string", "met boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        x = pd.concat(list(rows)).sort_values(["created_at", "case_key"])
        held = self.anchor.get() if self.anchor.exists() else None
        first, other, newest = (list(held[0]), list(held[1]), held[2]) if held else (None, [False] * len(self.fields), 0)
        relation, changed = [], []
        for row in x.to_dict("records"):
            values = [row[f] for f in self.fields]
            differ = [] if first is None else [f for f, v, a, o in zip(self.fields, values, first, other, strict=True) if v and (v != a or o)]
            copied = bool(row["source_hash"]) and self.hashes.containsKey((row["source_hash"],))
            relation.append("duplicate" if copied or (first is not None and not differ and row["anchored"]) else "new" if first is None or not row["anchored"] else "followup")
            changed.append(",".join(differ) if row["anchored"] else "")
            if first is None:
                first = values
            other = [o or v != a for o, v, a in zip(other, values, first, strict=True)]
            if row["source_hash"]:
                self.hashes.updateValue((row["source_hash"],), (True,))
        newest = max(newest, int(x["created_at"].max().timestamp() * 1000))
        self.anchor.update((first, other, newest))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(newest + self.idle_ms)
        yield pd.DataFrame({"case_key": x["case_key"], "relation": relation, "changed": changed})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.anchor.clear()
        self.hashes.clear()
        yield pd.DataFrame({"case_key": pd.Series(dtype="int64"), "relation": pd.Series(dtype=str), "changed": pd.Series(dtype=str)})

    def close(self) -> None:
        pass


def linked(stream: DataFrame, fields: tuple[str, ...] = FIELDS, late: str = LATE, idle: timedelta = IDLE) -> DataFrame:
    """``case_key, relation, changed`` of each report against those that came before it."""
    stream.sparkSession.conf.set(*PROVIDER)
    blank = F.lit("")
    filled = [F.coalesce(F.col("patient_token"), blank), value_key(F.col("medicine")), value_key(F.col("reaction"))]
    anchored = (filled[0] != "") & (filled[1] != "") & (filled[2] != "")
    hashed = F.coalesce("source_hash", blank)
    key = F.when(anchored, F.to_json(F.struct(*[c.alias(n) for c, n in zip(filled, ANCHOR, strict=True)]))).when(hashed != "", F.concat(F.lit("hash "), hashed)).otherwise(F.concat(F.lit("case "), F.col("case_key").cast("string")))
    rows = stream.withColumn("created_at", F.col("created_at").cast("timestamp")).withWatermark("created_at", late)
    keyed = rows.select(F.col("case_key").cast("long").alias("case_key"), "created_at", key.alias("key"), anchored.alias("anchored"), hashed.alias("source_hash"), *[value_key(F.col(f)).alias(f) for f in fields])
    return keyed.groupBy("key").transformWithStateInPandas(Linker(fields, idle), _OUT, "append", "EventTime")
