"""Stream operators with keyed state in the engine's state store: cooldown, CUSUM, count windows, fairness windows.

State is a value, a list or a timer per key, kept by the RocksDB provider and written per micro-batch, so a
stopped query goes on where it was. One key's rows of a micro-batch pass through one task; where a key sends
a large share of the traffic, the forms in ``detectors`` split its rows instead.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from fairspark.functions.numeric import count_if
from fairspark.operators import drift as dr
from fairspark.streaming.detectors import COOLDOWN_SECONDS, STRIDE, TEST_SIZE

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def drain(spark: SparkSession, out: DataFrame, root: str, prepare: Callable[[SparkSession], None] | None = None) -> StreamingQuery:
    """Run a stream over all that has arrived, append its rows below ``root/out`` and stop; repeat calls go on.

    The state store provider is set while the query starts and put back, as a query keeps the settings of
    its start.
    """
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        query = (
            out.writeStream.format("parquet").outputMode("append").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint")
            .trigger(availableNow=True).start()
        )
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)
    query.awaitTermination()
    return query


def dropped_late(query: StreamingQuery) -> int:
    """Rows that stateful operators of a finished query met behind the watermark (after partial aggregation)."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])


# Cooldown ------------------------------------------------------------------------


#: Waiting times in one element of the list state, so that the store is asked per block and not per alert.
HELD_BLOCK = 65_536


class CooldownProcessor(StatefulProcessor):
    """Keeps an alert if the last kept one of its key is at least ``seconds`` older, in event-time order.

    List state holds the alerts that the watermark has not reached, in blocks of ``HELD_BLOCK`` times, a timer wakes at the earliest of them,
    and value state holds the last kept time. When nothing waits, the timer wakes once the cooldown is over
    and removes the state, so quiet keys cost nothing.
    """

    def __init__(self, seconds: float):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "times binary")
        self.last = handle.getValueState("last", "t double, released double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        released = self.last.get()[1] if self.last.exists() else -np.inf
        new = np.unique(np.concatenate([pdf["t"].to_numpy(dtype=float) for pdf in rows]))
        new = new[new > released]
        if len(new):
            every = np.union1d(self._held(), new)
            self._hold(every)
            self._wake(float(every[0]))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() / 1000.0
        held = self._held()
        last = self.last.get()[0] if self.last.exists() else -np.inf
        due, rest = held[held <= now], held[held > now]
        kept, at = [], int(np.searchsorted(due, last + self.seconds))
        while at < len(due):
            last = float(due[at])
            kept.append(last)
            at = int(np.searchsorted(due, last + self.seconds))
        if len(rest):
            self._hold(rest)
        else:
            self.waiting.clear()
        if len(rest) or now < last + self.seconds:
            self.last.update((last, now))
            self._wake(float(rest[0]) if len(rest) else last + self.seconds)
        else:
            self.last.clear()
        if kept:
            yield pd.DataFrame({"feature": key[0], "t": kept})

    def _held(self) -> np.ndarray:
        blocks = [np.frombuffer(bytes(r[0]), float) for r in self.waiting.get()] if self.waiting.exists() else []
        return np.concatenate(blocks) if blocks else np.zeros(0)

    def _hold(self, times: np.ndarray) -> None:
        self.waiting.put([(times[i : i + HELD_BLOCK].tobytes(),) for i in range(0, len(times), HELD_BLOCK)])

    def _wake(self, seconds: float) -> None:
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t)
        self.handle.registerTimer(int(np.ceil(seconds * 1000.0)))

    def close(self) -> None:
        pass


def cooldown_stream(alerts: DataFrame, seconds: float = COOLDOWN_SECONDS, delay: str = "10 minutes") -> DataFrame:
    """Kept alerts ``feature, t`` (epoch seconds) of a stream ``feature, ts``, once the watermark has passed them.

    Alerts may arrive out of order within ``delay``; later ones are dropped by the engine. Equal times of a
    feature are one alert. Rows without a time or feature are left out.
    """
    rows = alerts.where("feature IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", delay)
    rows = rows.select("feature", "ts", (F.unix_micros("ts") / 1e6).alias("t"))
    return rows.groupBy("feature").transformWithStateInPandas(CooldownProcessor(seconds), "feature string, t double", "Append", "EventTime")


# CUSUM ---------------------------------------------------------------------------


class CusumProcessor(StatefulProcessor):
    """Two-sided CUSUM carried across micro-batches: value state ``g_pos, g_neg, n, last_seq, n_late``.

    Within a batch ``g`` comes from running sums and their running minimum, without a loop over rows.
    """

    def __init__(self, threshold: float, k: float, idle_ms: int | None):
        self.threshold, self.k, self.idle_ms = threshold, k, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("cusum", "g_pos double, g_neg double, n bigint, last_seq bigint, n_late bigint", self.idle_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        g_pos, g_neg, n, last, late = self.state.get() if self.state.exists() else (0.0, 0.0, 0, None, 0)
        batch = pd.concat(list(rows), ignore_index=True).sort_values("seq", kind="stable")
        fresh = batch if last is None else batch[batch["seq"] > last]
        late += len(batch) - len(fresh)
        if len(fresh):
            z = ((fresh["value"] - fresh["mu"]) / fresh["sd"]).to_numpy(dtype=float)
            out = {}
            for name, step, start in (("g_pos", z - self.k, g_pos), ("g_neg", -z - self.k, g_neg)):
                run = start + np.cumsum(step)
                out[name] = run - np.minimum(np.minimum.accumulate(run), 0.0)
            g_pos, g_neg, n, last = float(out["g_pos"][-1]), float(out["g_neg"][-1]), n + len(fresh), int(fresh["seq"].iloc[-1])
            statistic = np.maximum(out["g_pos"], out["g_neg"])
            status = np.where(statistic >= self.threshold, "drift", np.where(statistic >= self.threshold * 0.6, "warning", "none"))
            yield pd.DataFrame({"feature": key[0], "seq": fresh["seq"].to_numpy(), **out, "statistic": statistic, "status": status, "n_late": late})
        self.state.update((g_pos, g_neg, n, last, late))

    def close(self) -> None:
        pass


def cusum_stream(rows: DataFrame, fit: DataFrame, threshold: float = dr.CUSUM_THRESHOLD, k: float = dr.DRIFT_PARAMETER, idle_ms: int | None = None) -> DataFrame:
    """CUSUM of a stream ``feature, seq, value`` against ``fit`` (see ``drift.reference_fit``).

    Rows at or behind the last ``seq`` of their feature are late: dropped and counted in ``n_late``. With
    ``idle_ms`` the state of a feature that stays away so long expires. Null values are left out.
    """
    known = fit.where(F.col("status") == "fitted").select("feature", "mu", "sd")
    scored = rows.where("value IS NOT NULL").join(known, "feature").select("feature", "seq", "value", "mu", "sd")
    shape = "feature string, seq bigint, g_pos double, g_neg double, statistic double, status string, n_late bigint"
    mode = "ProcessingTime" if idle_ms else "None"
    return scored.groupBy("feature").transformWithStateInPandas(CusumProcessor(threshold, k, idle_ms), shape, "Append", mode)


# Count windows -------------------------------------------------------------------


class CountWindowProcessor(StatefulProcessor):
    """Windows of ``size`` rows every ``stride`` rows: list state holds the last rows, value state their number."""

    def __init__(self, size: int, stride: int):
        self.size, self.stride = size, stride

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.tail = handle.getListState("tail", "seq bigint, value double")
        self.seen = handle.getValueState("seen", "n bigint, last_seq bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, last = self.seen.get() if self.seen.exists() else (0, None)
        batch = pd.concat(list(rows), ignore_index=True).sort_values("seq", kind="stable")
        batch = batch if last is None else batch[batch["seq"] > last]
        if not len(batch):
            return
        held = list(self.tail.get()) if self.tail.exists() else []
        seq = np.concatenate([np.array([r[0] for r in held], dtype=np.int64), batch["seq"].to_numpy()])
        value = np.concatenate([np.array([r[1] for r in held], dtype=float), batch["value"].to_numpy(dtype=float)])
        first = n - len(held)  # rows before the held ones
        total = n + len(batch)
        # Windows that end in this batch.
        low = max(0, -(-(n + 1 - self.size) // self.stride))
        high = (total - self.size) // self.stride
        if high >= low:
            ids = np.arange(low, high + 1)
            start = ids * self.stride - first
            mean = [value[s : s + self.size].mean() for s in start]
            yield pd.DataFrame(
                {"feature": key[0], "window_id": ids, "n_rows": self.size, "mean": mean, "first_seq": seq[start], "last_seq": seq[start + self.size - 1]}
            )
        keep = min(len(seq), max(self.size - 1, 1))
        self.tail.put([(int(s), float(v)) for s, v in zip(seq[-keep:], value[-keep:])])
        self.seen.update((total, int(seq[-1])))

    def close(self) -> None:
        pass


def window_stream(rows: DataFrame, size: int = TEST_SIZE, stride: int = STRIDE) -> DataFrame:
    """Full count windows of a stream ``feature, seq, value``; a window is emitted by the batch that fills it.

    Rows at or behind the last ``seq`` of their feature are dropped. ``stride`` is at most ``size``.
    """
    if stride > size:
        raise ValueError("rows between windows would be lost from the state")
    shape = "feature string, window_id bigint, n_rows bigint, mean double, first_seq bigint, last_seq bigint"
    clean = rows.where("value IS NOT NULL").select("feature", "seq", "value")
    return clean.groupBy("feature").transformWithStateInPandas(CountWindowProcessor(size, stride), shape, "Append", "None")


# Fairness over event time --------------------------------------------------------


def group_cells(decisions: DataFrame, attributes: Sequence[str], window: str, slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Confusion counts per window, attribute and group of a stream or table with ``ts, y_true, y_pred``.

    All attributes share one stateful aggregation; a hot group is combined before the shuffle.
    """
    entries = F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("grp")) for a in attributes])
    rows = decisions.where("y_true IS NOT NULL AND y_pred IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", delay)
    rows = rows.select("ts", "y_true", "y_pred", F.inline(entries)).where("grp IS NOT NULL")
    span = F.window("ts", window, slide) if slide else F.window("ts", window)
    yes, hit = F.col("y_true") == 1, F.col("y_pred") == 1
    return rows.groupBy(span.alias("w"), "attribute", "grp").agg(
        F.count("*").alias("n"),
        F.sum("y_pred").alias("predicted"),
        count_if(yes & hit).alias("tp"),
        count_if(~yes & hit).alias("fp"),
        count_if(yes & ~hit).alias("fn"),
        count_if(~yes & ~hit).alias("tn"),
    )


def fairness_windows(decisions: DataFrame, attributes: Sequence[str], window: str = "1 day", slide: str | None = None, delay: str = "10 minutes", threshold: float = 0.1) -> DataFrame:
    """Demographic-parity and equalized-odds gaps per event-time window and attribute.

    Two stateful steps: watermarked group cells, and per window the spread of the groups' rates. Both are
    closed by the watermark, so the second one sees complete cells only; works on streams in append mode and
    on tables. Rates are rounded to six digits before their spread is taken; an empty denominator gives 0.
    Rows without label, prediction, time or group are left out.
    """
    cells = group_cells(decisions, attributes, window, slide, delay)
    rate = lambda top, *parts: F.bround(F.coalesce(F.try_divide(F.col(top), sum((F.col(p) for p in parts[1:]), F.col(parts[0]))), F.lit(0.0)), 6)
    rated = cells.select(
        "w", "attribute", "n", rate("predicted", "n").alias("rate"), rate("fp", "fp", "tn").alias("fpr"), rate("fn", "fn", "tp").alias("fnr")
    )
    # The end of a window tells it from all others, so windows of the slide's length regroup them.
    again = F.window(F.window_time("w"), slide or window)

    def spread(c: str) -> Column:
        return F.bround(F.max(c) - F.min(c), 6)

    gaps = rated.groupBy(again.alias("v"), "attribute").agg(
        F.min("w.start").alias("window_start"),
        F.max("w.end").alias("window_end"),
        F.count("*").alias("n_groups"),
        F.sum("n").alias("n"),
        spread("rate").alias("dp_gap"),
        spread("fpr").alias("fpr_gap"),
        spread("fnr").alias("fnr_gap"),
    )
    eo = F.greatest("fpr_gap", "fnr_gap")
    return gaps.select(
        "window_start", "window_end", "attribute", "n_groups", "n", "dp_gap", "fpr_gap", "fnr_gap", eo.alias("eo_gap"), ((F.col("dp_gap") <= threshold) & (eo <= threshold)).alias("is_fair")
    )
