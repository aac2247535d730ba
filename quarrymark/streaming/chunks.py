"""Keyed state for a live transcript feed.

State is per (session, utterance), so a busy session spreads over its utterances.  Decisions use event time only: the stream's
own clock ends an utterance, never the clock of the machine.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quarrymark.config import CONTROLLER

# Row kinds of the feed.
CHUNK, END = "chunk", "end"

FEED = T.StructType(
    [
        T.StructField("session", T.LongType()),
        T.StructField("utterance", T.LongType()),
        T.StructField("kind", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("idx", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("ts", T.TimestampType()),
    ]
)

RESULT = T.StructType(
    [
        T.StructField("session", T.LongType()),
        T.StructField("utterance", T.LongType()),
        T.StructField("seq", T.LongType()),
        T.StructField("idx", T.IntegerType()),
        T.StructField("status", T.StringType()),
        T.StructField("text", T.StringType()),
    ]
)


class TranscriptFold(StatefulProcessor):
    """Applies every arrival to the utterance it belongs to and reports what it did.

    An utterance ends with its end row or after ``silence_ms`` of event time without a row.  Anything later comes out as
    ``rejected_finalized``: late data is a visible result.
    """

    def __init__(self, silence_ms: int = CONTROLLER.endpoint_ms) -> None:
        self.silence_ms = silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pieces = handle.getMapState("pieces", "idx int", "text string")
        self.mark = handle.getValueState("mark", "top int, ended boolean, timer long")

    def _mark(self) -> tuple[int, bool, int]:
        value = self.mark.get() if self.mark.exists() else None
        return (-1, False, 0) if value is None else (value[0], value[1], value[2])

    def _apply(self, top: int, idx: int, text: str) -> tuple[str, int]:
        if self.pieces.containsKey((idx,)):
            if self.pieces.getValue((idx,))[0] == text:
                return "duplicate", top
            self.pieces.updateValue((idx,), (text,))
            return "revision", top
        self.pieces.updateValue((idx,), (text,))
        if not text.strip():
            status = "empty"
        elif idx < top:
            status = "out_of_order"
        else:
            status = "gap" if idx > top + 1 else "accepted"
        return status, max(top, idx)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        top, ended, timer = self._mark()
        batch = pd.concat(list(rows)).sort_values("seq")
        out = []
        latest = 0
        for r in batch.itertuples(index=False):
            latest = max(latest, int(r.ts.value // 1_000_000))
            if r.kind == END:
                if not ended:
                    out.append((key[0], key[1], r.seq, None, "finalized", None))
                ended = True
            elif ended:
                out.append((key[0], key[1], r.seq, int(r.idx), "rejected_finalized", r.text))
            else:
                status, top = self._apply(top, int(r.idx), r.text)
                out.append((key[0], key[1], r.seq, int(r.idx), status, r.text))
        if timer:
            self.handle.deleteTimer(timer)
            timer = 0
        if ended:
            self.pieces.clear()
        else:
            timer = latest + self.silence_ms
            self.handle.registerTimer(timer)
        self.mark.update((top, ended, timer))
        yield pd.DataFrame(out, columns=RESULT.names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        top, ended, _ = self._mark()
        if not ended:
            self.pieces.clear()
            self.mark.update((top, True, 0))
            yield pd.DataFrame([(key[0], key[1], None, None, "finalized_by_silence", None)], columns=RESULT.names)

    def close(self) -> None:
        pass


def fold(feed: DataFrame, silence_ms: int = CONTROLLER.endpoint_ms, late: str = "10 seconds") -> DataFrame:
    """Status row of every arrival of a streaming feed (schema ``FEED``)."""
    return (
        feed.withWatermark("ts", late)
        .groupBy("session", "utterance")
        .transformWithStateInPandas(
            statefulProcessor=TranscriptFold(silence_ms),
            outputStructType=RESULT,
            outputMode="Append",
            timeMode="EventTime",
        )
    )


class OrderedRelease(StatefulProcessor):
    """Releases items of a stream in sequence.

    What has arrived is kept as runs of consecutive numbers.  The run that continues the released part goes out; a run behind a gap
    goes out once its oldest item has waited ``hold_ms`` of event time, and the gap before it is reported as one row (``seq`` to
    ``last``).  Repeats of released or held numbers are reported and dropped.  A stream without waiting items keeps two numbers.
    """

    columns = ("stream", "seq", "last", "item", "status")

    def __init__(self, hold_ms: int = 2000) -> None:
        self.hold_ms = hold_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "seq long", "item string, at long")
        self.place = handle.getValueState("place", "expected long, timer long")

    def _settle(self, stream: int, fresh: pd.DataFrame, now: int) -> pd.DataFrame:
        expected, timer = self.place.get() if self.place.exists() else (0, 0)
        held = pd.DataFrame(
            [(k[0], v[0], v[1], True) for k, v in self.waiting.iterator()], columns=["seq", "item", "at", "known"]
        )
        rows = pd.concat([held, fresh.assign(known=False)], ignore_index=True).astype({"seq": "int64", "at": "int64"})
        repeat = (rows["seq"] < expected) | rows["seq"].duplicated()
        again = rows[repeat].assign(status="duplicate", last=rows["seq"])
        rows = rows[~repeat].sort_values("seq").reset_index(drop=True)
        run = (rows["seq"].diff() != 1).cumsum()
        runs = rows.groupby(run).agg(first=("seq", "min"), end=("seq", "max"), at=("at", "min"))
        ripe = (runs["at"] + self.hold_ms <= now) | (runs["first"] == expected)
        # a run also goes out when a later one does, for order is kept
        out = ripe[::-1].cummax()[::-1] if len(ripe) else ripe
        # runs that directly follow the released part never wait for the clock, later ones only for their own
        gone = rows[run.map(out).astype(bool)] if len(rows) else rows
        before = runs["end"].shift(fill_value=expected - 1)[out] + 1 if len(runs) else runs["end"]
        gaps = pd.DataFrame({"seq": before, "last": runs["first"][out] - 1}) if len(runs) else pd.DataFrame(columns=["seq", "last"])
        gaps = gaps[gaps["seq"] <= gaps["last"]].assign(item=None, status="skipped")
        released = gone.assign(status="released", last=gone["seq"])
        for seq in gone.loc[gone["known"].astype(bool), "seq"]:
            self.waiting.removeKey((int(seq),))
        stay = rows[~rows["seq"].isin(gone["seq"])]
        for r in stay[~stay["known"].astype(bool)].itertuples(index=False):
            self.waiting.updateValue((int(r.seq),), (r.item, int(r.at)))
        if timer:
            self.handle.deleteTimer(timer)
        due = int(stay["at"].min()) + self.hold_ms if len(stay) else 0
        if due:
            self.handle.registerTimer(due)
        self.place.update((int(gone["seq"].max()) + 1 if len(gone) else expected, due))
        shown = pd.concat([x for x in (gaps, released, again) if len(x)] or [released])
        return shown.sort_values("seq", kind="stable").assign(stream=stream)[list(self.columns)]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        arrived = pd.concat(list(rows)).sort_values(["ts", "seq"])
        arrived["at"] = arrived["ts"].astype("datetime64[ms]").astype("int64")
        # the clock moves with the arrivals: each instant at which a held run may ripen is settled on its own
        for now, batch in arrived.groupby("at", sort=True):
            yield self._settle(key[0], batch[["seq", "item", "at"]], int(now))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        nothing = pd.DataFrame({"seq": pd.Series(dtype="int64"), "item": pd.Series(dtype=object), "at": pd.Series(dtype="int64")})
        yield self._settle(key[0], nothing, expiredTimerInfo.getExpiryTimeInMs())

    def close(self) -> None:
        pass


def ordered_release(items: DataFrame, hold_ms: int = 2000, late: str = "10 seconds") -> DataFrame:
    """(stream, seq, item, ts) -> (stream, seq, last, item, status)."""
    return (
        items.withWatermark("ts", late)
        .groupBy("stream")
        .transformWithStateInPandas(
            statefulProcessor=OrderedRelease(hold_ms),
            outputStructType="stream long, seq long, last long, item string, status string",
            outputMode="Append",
            timeMode="EventTime",
        )
    )


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Silence sessions per user of an event stream with (user_id, ts)."""
    return (
        events.withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", late)
        .groupBy("user_id", F.session_window("ts", gap).alias("w"))
        .agg(F.count(F.lit(1)).alias("n_events"))
        .select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_events")
    )
