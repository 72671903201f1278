"""Recognition sessions as stateful streams, and rolling usage statistics.

Events of a session: ``start`` (``page``: how many pages the document has, ``markdown``: the range asked for, if any),
``text`` (the text layer of a page), ``page`` (a result), ``fail``, ``skip``, ``finish`` and ``abort``. Two operators:

* The gate, under one key, knows the live sessions, ``MAX_LIVE`` at most. A start that finds as many evicts the oldest, and
  an eviction is one more event of that session. Its state is that many rows, whatever the stream; it sees starts and
  ends only, not pages.
* The assembler, by session, keeps a row for each page and layer. A finished session comes out as one document of all
  pages asked for, in order: a skipped page's comment wins over a result, that over the text layer, and a page without
  any keeps its marker. A session lives for 30 minutes from its start, whatever happens in it: events after that, after
  an eviction or without a session come out as ``late``. An event-time timer clears sessions that never finish.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

from ..operators.pages import parse_range
from ..operators.usage import COUNTERS, LARGEST, counters
from ..runtime import importable

#: Milliseconds that a session lives from its start, and how many live at once.
MAX_AGE_MS = 30 * 60 * 1000
MAX_LIVE = 32
OUTPUT = "session_id string, status string, markdown string, confidence double, failed_pages array<int>, skipped_pages array<int>"
EVICTED = "session_id string, seq long, ts timestamp, kind string"


def _millis(ts) -> int:
    return int(pd.Timestamp(ts).value // 1_000_000)


class GateProcessor(StatefulProcessor):
    """State: the live sessions and their starts. Comes out: an event for each session that had to make room."""

    def __init__(self, most: int = MAX_LIVE):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.live = handle.getMapState("live", "session_id string", "start_ms long, seq long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        live = {k[0]: (v[0], v[1]) for k, v in self.live.iterator()}
        before, out = set(live), []
        for e in pd.concat(list(rows)).sort_values("seq").itertuples(index=False):
            live.pop(e.session_id, None)
            if e.kind != "start":
                continue
            now = _millis(e.ts)
            live = {k: v for k, v in live.items() if now - v[0] < MAX_AGE_MS}
            while len(live) >= self.most:
                oldest = min(live, key=live.get)
                del live[oldest]
                out.append((oldest, e.seq, e.ts, "evict"))
            live[e.session_id] = (now, int(e.seq))
        for gone in before - set(live):
            self.live.removeKey((gone,))
        for k, v in live.items():
            self.live.updateValue((k,), v)
        if out:
            yield pd.DataFrame(out, columns=["session_id", "seq", "ts", "kind"])

    def close(self) -> None:
        pass


class SessionProcessor(StatefulProcessor):
    """State: ``head`` (start, pages asked for, sums of confidence), ``pages`` (text by page and layer), ``failed``."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", "start_ms long, targets array<int>, confidence double, results int")
        self.pages = handle.getMapState("pages", "page int, layer string", "markdown string")
        self.failed = handle.getListState("failed", "page int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        for e in pd.concat(list(rows)).sort_values("seq").itertuples(index=False):
            ms, page = _millis(e.ts), int(e.page) if pd.notna(e.page) else 0
            if e.kind == "start":
                self._clear()
                self.head.update((ms, [int(p) for p in e.targets], 0.0, 0))
                self.handle.registerTimer(ms + MAX_AGE_MS)
                continue
            if e.kind in ("abort", "evict"):
                self._clear()
                continue
            if not self.head.exists() or ms - self.head.get()[0] >= MAX_AGE_MS:
                self._clear()
                out.append((key[0], "late", None, None, [], []))
            elif e.kind == "finish":
                out.append((key[0], *self._document()))
                self._clear()
            elif e.kind == "text":
                self.pages.updateValue((page, "text"), ((e.markdown or "").strip(),))
            elif e.kind == "skip":
                self.pages.updateValue((page, "skip"), (f"<!-- OCR skipped (page {page}): {e.error} -->",))
            elif e.kind == "fail":
                self.pages.updateValue((page, "result"), (f"<!-- OCR failed (page {page}): {e.error} -->",))
                self.failed.appendValue((page,))
            elif e.kind == "page":
                self.pages.updateValue((page, "result"), (e.markdown or "",))
                if pd.notna(e.confidence):
                    start, targets, confidence, results = self.head.get()
                    self.head.update((start, targets, confidence + float(e.confidence), results + 1))
        if out:
            yield pd.DataFrame(out, columns=["session_id", "status", "markdown", "confidence", "failed_pages", "skipped_pages"])

    def _document(self) -> tuple:
        _, targets, confidence, results = self.head.get()
        found = {(k[0], k[1]): v[0] for k, v in self.pages.iterator()}
        texts = [next((found[p, layer] for layer in ("skip", "result", "text") if (p, layer) in found), "") for p in targets]
        markdown = "\n\n".join(f"<!-- Page {p} -->\n\n{text}" for p, text in zip(targets, texts, strict=True))
        return "finished", markdown, confidence / results if results else None, [f[0] for f in self.failed.get()], sorted(p for p, layer in found if layer == "skip")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The watermark is past the session's end: nothing that belongs to it can still come."""
        self._clear()
        yield from ()

    def _clear(self) -> None:
        if self.head.exists():
            self.handle.deleteTimer(self.head.get()[0] + MAX_AGE_MS)
        self.head.clear()
        self.pages.clear()
        self.failed.clear()

    def close(self) -> None:
        pass


def assemble_sessions(events: DataFrame, delay: str = "30 minutes", most: int = MAX_LIVE) -> DataFrame:
    """Finished and late sessions; ``events``: session_id, seq, ts, kind, page, markdown, confidence, error.

    ``seq`` orders events, of a session and of starts and ends among each other. A stream needs the RocksDB state store; a
    table of events works as well. Age is judged by event times. A session's state goes when it finishes, aborts or is
    evicted, or once the watermark, ``delay`` behind the latest event, is past its end; events later than the watermark
    are left out. A failed page stands in ``failed_pages`` as often as it failed.
    """
    # State stores, a table's too, are looked after by the session's stream manager, which begins when it is asked for.
    assert importable(events.sparkSession).streams is not None
    every = F.when(F.col("page") >= 1, F.sequence(F.lit(1), F.col("page"))).otherwise(F.array().cast("array<int>"))
    targets = F.when(F.col("kind") == "start", F.coalesce(parse_range(F.col("markdown"), F.col("page")), every))
    events = events.withColumn("targets", targets).withWatermark("ts", delay)
    gate = events.filter(F.col("kind").isin("start", "finish", "abort")).select(F.lit("all").alias("gate"), "session_id", "seq", "ts", "kind").groupBy("gate")
    evicted = gate.transformWithStateInPandas(statefulProcessor=GateProcessor(most), outputStructType=EVICTED, outputMode="Append", timeMode="EventTime", eventTimeColumnName="ts" if events.isStreaming else "")
    own = events.unionByName(evicted, allowMissingColumns=True).groupBy("session_id")
    return own.transformWithStateInPandas(statefulProcessor=SessionProcessor(), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime")


def paced(spark: SparkSession, path: str, schema: str, files: int = 1) -> DataFrame:
    """A stream of JSON files that takes at most ``files`` of them a batch, so that pages are pulled no faster than
    they are worked on."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(path)


class Progress(StreamingQueryListener):
    """Tells ``report`` (rows so far, batch) of a stream's progress, at most once every ``every`` seconds and at its end."""

    def __init__(self, report: Callable[[int, int], None], every: float = 0.25, clock: Callable[[], float] = time.monotonic):
        self.report, self.every, self.clock = report, every, clock
        self.rows, self.batch, self.told, self.at = 0, -1, -1, float("-inf")

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.rows, self.batch = self.rows + event.progress.numInputRows, event.progress.batchId
        if self.clock() - self.at >= self.every:
            self._tell()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if self.told != self.batch:
            self._tell()

    def _tell(self) -> None:
        self.at, self.told = self.clock(), self.batch
        self.report(self.rows, self.batch)


class PeriodProcessor(StatefulProcessor):
    """State: the day that is today, and the sums of each period. Midnight, by the watermark, is a timer."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.today = handle.getValueState("today", "day string")
        self.sums = handle.getMapState("sums", "period string", "sums array<long>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        days = pd.concat(list(rows)).groupby("date")[COUNTERS].sum().sort_index()
        for day, added in days.iterrows():
            if not self.today.exists() or day > self.today.get()[0]:
                self._roll(day)
            today = self.today.get()[0]
            for period, own in (("total", True), ("month", day[:7] == today[:7]), ("today", day == today)):
                if own:
                    self.sums.updateValue((period,), ([a + int(b) for a, b in zip(self._of(period), added, strict=True)],))
        yield self._told()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        day = str(pd.Timestamp(timerValues.getCurrentWatermarkInMs(), unit="ms").date())
        if day > self.today.get()[0]:
            self._roll(day)
            yield self._told()

    def _of(self, period: str) -> list[int]:
        return list(self.sums.getValue((period,))[0]) if self.sums.containsKey((period,)) else [0] * len(COUNTERS)

    def _roll(self, day: str) -> None:
        if self.today.exists():
            self.handle.deleteTimer(self._midnight(self.today.get()[0]))
            if self.today.get()[0][:7] != day[:7] and self.sums.containsKey(("month",)):
                self.sums.removeKey(("month",))
            if self.sums.containsKey(("today",)):
                self.sums.removeKey(("today",))
        self.today.update((day,))
        self.handle.registerTimer(self._midnight(day))

    @staticmethod
    def _midnight(day: str) -> int:
        return _millis(pd.Timestamp(day) + pd.Timedelta(days=1))

    def _told(self) -> pd.DataFrame:
        shown = [[p, *[n if c == "total_ms" else min(n, LARGEST) for c, n in zip(COUNTERS, self._of(p), strict=True)]] for p in ("total", "month", "today")]
        return pd.DataFrame(shown, columns=["period", *COUNTERS]).assign(day=self.today.get()[0])

    def close(self) -> None:
        pass


def usage_periods(log: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """A stream of the usage statistics: (period, ten counters, day) for total, month and today, whenever they change.

    ``log``: the usage log as a stream. Its days are its event times; today is the latest day that has come, or that the
    watermark, ``delay`` behind, has reached: then today, and with a new month the month, begin at zero. A line that comes
    late counts in the periods that its day lies in. One key, as there is one log.
    """
    importable(log.sparkSession)
    added = {c: F.coalesce(v, F.lit(0)).cast("long").alias(c) for c, v in counters().items()}
    own = log.withColumn("ts", F.to_timestamp("date")).withWatermark("ts", delay).select(F.lit("all").alias("log"), "ts", "date", *added.values())
    found = "period string, " + ", ".join(f"{c} long" for c in COUNTERS) + ", day string"
    return own.groupBy("log").transformWithStateInPandas(statefulProcessor=PeriodProcessor(), outputStructType=found, outputMode="Update", timeMode="EventTime")


def rolling_usage(log: DataFrame) -> DataFrame:
    """A stream of usage by day and kind (complete mode); ``log``: the usage log as a stream."""
    return log.groupBy("date", "kind").agg(F.sum("fileCount").alias("file_count"), F.sum("pageCount").alias("page_count"), F.sum("ocrPageCount").alias("ocr_page_count"), F.sum("totalMs").alias("total_ms"))


def windowed_events(events: DataFrame, width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Counts and sums by event-time window and type, with a watermark; an addition of this engine."""
    own = events.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w"), "event_type")
    return own.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("window_start"), "event_type", "n", "value")
