"""Bars from streams of ticks.

Basic time bars are a watermarked window aggregation: a bar comes out once the
watermark has passed its end, ticks later than that are dropped. What depends on the
order of ticks (moves within a bar, threshold bars) can't aggregate as rows come: a key's
ticks wait in state by slices of time, and once the watermark has passed a slice, its
ticks are folded in order of (ts, trade_id) into a summary of a few numbers. So a bar once
given is final, and state is bounded by the lateness. State is RocksDB's, which the session
must name as its provider. ``open_bars`` reads it as a table: the bars not given yet.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..functions import ordered
from ..operators.bars import DAY_MS, interval_ms


def _span(interval: str) -> str:
    return f"{interval_ms(interval)} milliseconds"


def time_bars(trades: DataFrame, interval: str, *, late: str = "10 minutes", advanced: bool = False) -> DataFrame:
    """Streaming counterpart of operators.bars.time_bars. The advanced columns need the
    ticks in order, see ``ordered_time_bars``."""
    if advanced:
        return ordered_time_bars(trades, interval, late=late)
    t = trades.withWatermark("ts", late).withColumn("notional", F.col("price") * F.col("quantity"))
    order = F.struct("ts", "trade_id")
    bar = t.groupBy("symbol", F.window("ts", _span(interval)).alias("w")).agg(
        F.max("ts").alias("end_ts"),
        F.min_by("price", order).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", order).alias("close"),
        F.sum("quantity").alias("volume"),
        F.sum(F.when(~F.col("is_buyer_maker"), F.col("quantity")).otherwise(0.0)).alias("buy_volume"),
        F.sum("notional").alias("dollar_volume"),
        F.count("*").alias("tick_count"),
    )
    return bar.select(
        "symbol",
        F.unix_millis("w.start").alias("start_time_ms"),
        F.unix_millis("end_ts").alias("end_time_ms"),
        "open", "high", "low", "close", "volume", "buy_volume",
        (F.col("volume") - F.col("buy_volume")).alias("sell_volume"),
        F.coalesce(F.try_divide("dollar_volume", "volume"), F.lit(0.0)).alias("vwap"),
        "tick_count",
        "dollar_volume",
    )


def quote_bars(quotes: DataFrame, interval: str, *, late: str = "10 minutes") -> DataFrame:
    """Streaming counterpart of operators.bars.quote_bars."""
    q = quotes.withWatermark("ts", late).withColumn("mid", (F.col("best_bid_price") + F.col("best_ask_price")) / 2).withColumn("spread", F.col("best_ask_price") - F.col("best_bid_price"))
    bar = q.groupBy("symbol", F.window("ts", _span(interval)).alias("w")).agg(F.max("ts").alias("end_ts"), F.min_by("mid", "ts").alias("open"), F.max("mid").alias("high"), F.min("mid").alias("low"), F.max_by("mid", "ts").alias("close"), F.count("*").alias("tick_count"), F.avg("spread").alias("spread_mean"), F.coalesce(F.stddev_samp("spread"), F.lit(0.0)).alias("spread_std"), F.greatest(F.max("spread"), F.lit(0.0)).alias("spread_max"))
    return bar.select("symbol", F.unix_millis("w.start").alias("start_time_ms"), F.unix_millis("end_ts").alias("end_time_ms"), "open", "high", "low", "close", "tick_count", "spread_mean", "spread_std", "spread_max")


#: The state's format, of which a session names the provider.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: Amounts are whole numbers of this part, as the batch's decimals of 8 places.
_PART = 100_000_000
#: Lengths of slices in ms: each divides a day.
_SLICES = (1_000, 5_000, 10_000, 30_000, 60_000, 300_000, 600_000, 1_800_000, 3_600_000, 10_800_000, 21_600_000, DAY_MS)
_TICK = np.dtype([("us", "<i8"), ("id", "<i8"), ("price", "<f8"), ("quantity", "<f8"), ("maker", "?")])
_BAR = f"{ordered.BASIC}, {ordered.ADVANCED}, is_complete boolean"
_FOLD = f"{ordered.SCHEMA}, is_open boolean, bars long, run long, threshold long, day long, begin long, first_day long, first_threshold long, counted long"
_FIELDS = [f.split()[0] for f in _FOLD.split(", ")]


def _late_ms(late: str) -> int:
    m = re.fullmatch(r"\s*(\d+)\s*(second|minute|hour|day)s?\s*", late)
    if not m:
        raise ValueError(f"no lateness: {late!r}")
    return int(m[1]) * {"second": 1_000, "minute": 60_000, "hour": 3_600_000, "day": DAY_MS}[m[2]]


def _slice_ms(late: str) -> int:
    """About an eighth of the lateness, so that little more waits than must."""
    return max([s for s in _SLICES if s <= _late_ms(late) / 8], default=_SLICES[0])


@dataclass
class State:
    """A key's open bar and what its next ticks need to know. ``run`` is the amount in
    the bar that isn't full, ``counted`` the ms up to which ticks are folded or counted."""

    summary: np.ndarray | None = None
    bars: int = 0
    run: int = 0
    threshold: int = 0
    day: int | None = None
    begin: int | None = None
    first_day: int | None = None
    first_threshold: int = 0
    counted: int = -(1 << 62)

    def row(self) -> tuple:
        values = (np.zeros(len(ordered.FIELDS)) if self.summary is None else self.summary).tolist()
        return (*values, self.summary is not None, self.bars, self.run, self.threshold, self.day, self.begin, self.first_day, self.first_threshold, self.counted)

    @staticmethod
    def of(row: tuple | None) -> State:
        if row is None:
            return State()
        k = len(ordered.FIELDS)
        return State(np.array(row[:k], np.float64) if row[k] else None, *row[k + 1 :])


@dataclass(frozen=True)
class TimeFold:
    """One bar: the key's. Its row has the bar's edge and ``step``."""

    step: int

    def ready(self, state: State, days: dict[int, float], ticks: np.ndarray) -> bool:
        return True

    def add(self, key: tuple, state: State, days: dict[int, float], t: np.ndarray) -> list[tuple]:
        _, made = ordered.summaries(np.zeros(len(t), np.int64), t["us"] // 1000, t["price"], t["quantity"], t["price"] * t["quantity"], t["maker"])
        for s in made:
            state.summary = s if state.summary is None else ordered.merged(state.summary, s)
        return []

    def bar(self, key: tuple, state: State, complete: bool) -> tuple:
        symbol, edge = key
        return (symbol, edge // self.step, *ordered.columns(state.summary, edge), complete)

    def ends(self, key: tuple) -> int | None:
        return key[1] + self.step


@dataclass(frozen=True)
class ThresholdFold:
    """Bars that close at an amount: ``fixed``, or a day's own, the mean of the days before
    it over ``per_day``, as operators.bars.daily_thresholds has it. Until the first of those is
    known, ticks wait, or with ``drop`` go."""

    dollar: bool
    fixed: int = 0
    lookback: int = 10
    per_day: int = 50
    discard_days: int = 30
    drop: bool = False

    def _own(self, state: State, days: dict[int, float], day: int) -> int:
        """The threshold that the day's own past gives; 0 for none."""
        past = [days[d] for d in sorted(d for d in days if d < day)[-self.lookback :]]
        mean = sum(past) / len(past) / self.per_day if past and day > state.first_day + self.discard_days else 0.0
        return int((Decimal(repr(mean)) * _PART).quantize(Decimal(1), ROUND_HALF_UP)) if mean > 0 else 0

    def ready(self, state: State, days: dict[int, float], ticks: np.ndarray) -> bool:
        """Counts a slice's ticks; whether a threshold is known."""
        if self.fixed or not len(ticks):
            return True
        day = int(ticks["us"][0] // 1000 // DAY_MS)
        state.first_day = day if state.first_day is None else state.first_day
        amount = ticks["price"] * ticks["quantity"] if self.dollar else ticks["quantity"]
        days[day] = days.get(day, 0.0) + float(amount.sum())
        state.first_threshold = state.first_threshold or self._own(state, days, day)
        return bool(state.first_threshold) or self.drop

    def add(self, key: tuple, state: State, days: dict[int, float], t: np.ndarray) -> list[tuple]:
        t = t[t["price"] * t["quantity"] > 0]
        if not len(t):
            return []
        day = int(t["us"][0] // 1000 // DAY_MS)
        first = state.day != day
        if first and not self.fixed:
            own = self._own(state, days, day)
            if not own and not state.threshold and self.drop:
                return []
            state.threshold = own or state.threshold or state.first_threshold
            # Of the days, those that a later day's mean takes are kept.
            for d in sorted(d for d in days if d < day)[: -self.lookback]:
                del days[d]
        state.day, thr = day, self.fixed or state.threshold
        price, quantity, ms = t["price"], t["quantity"], t["us"] // 1000
        value = np.rint(price * quantity * 1e6) * 100 if self.dollar else np.rint(quantity * _PART)
        if value.sum() > 9e18:
            raise ValueError("amounts of a slice are too large for whole numbers of 64 bits")
        amount = value.astype(np.int64)
        hi = state.run + np.cumsum(amount)
        lo = hi - amount
        k0 = lo // thr
        if first:
            k0[0] = 0  # a bar that is open when the threshold changes goes on with the new one
        k1 = np.maximum(k0, (hi - 1) // thr)
        many = k1 - k0 + 1
        i = np.repeat(np.arange(len(t)), many)
        k = k0[i] + np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many)
        part = (np.minimum(hi[i], (k + 1) * thr) - np.where(k == k0[i], lo[i], k * thr)) / _PART
        sizes = (part / price[i], part) if self.dollar else (part, part * price[i])
        numbers, made = ordered.summaries(state.bars + k, ms[i], price[i], *sizes, t["maker"][i])
        last = np.flatnonzero(np.r_[k[1:] != k[:-1], True])
        full = hi[i][last] >= (k[last] + 1) * thr
        if state.summary is not None:
            made[0] = ordered.merged(state.summary, made[0])
        closed, state.summary = [], None
        for number, s, done in zip(numbers.tolist(), made, full.tolist()):
            if done:
                closed.append((*key, number, *ordered.columns(s, state.begin), True))
                state.begin = int(s[ordered.FIELDS.index("end")])
            else:
                state.summary = s
        state.bars += int(hi[-1] // thr)
        state.run = int(hi[-1] % thr)
        return closed

    def bar(self, key: tuple, state: State, complete: bool) -> tuple:
        return (*key, state.bars, *ordered.columns(state.summary, state.begin), complete)

    def ends(self, key: tuple) -> int | None:
        return None


def _folded(fold: TimeFold | ThresholdFold, key: tuple, state: State, days: dict[int, float], slices: dict[int, np.ndarray], upto: int, slice_ms: int) -> list[tuple]:
    """Folds the ``slices`` that end by ``upto``, in order; removes them. Slices for which
    no threshold is known yet stay."""
    closed = []
    for s in sorted(slices):
        end = (s + 1) * slice_ms
        if end > upto:
            break
        slices[s] = np.sort(slices[s], order=["us", "id"])
        if end > state.counted:
            state.counted = end
            known = fold.ready(state, days, slices[s])
        else:
            known = bool(state.first_threshold)
        if known:
            for earlier in sorted(x for x in slices if x <= s):
                closed += fold.add(key, state, days, np.sort(slices.pop(earlier), order=["us", "id"]))
    return closed


class _Waiting(StatefulProcessor):
    """Ticks wait by slice; timers at the slices' ends fold them."""

    def __init__(self, fold: TimeFold | ThresholdFold, slice_ms: int, schema: str):
        self.fold, self.slice_ms, self.names = fold, slice_ms, [c.split()[0] for c in schema.split(", ")]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "slice long", "ticks binary")
        self.state = handle.getValueState("bar", _FOLD)
        self.days = handle.getMapState("days", "day long", "total double")

    def _read(self) -> State:
        return State.of(tuple(self.state.get()) if self.state.exists() else None)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = self._read()
        if not self.state.exists():
            self.state.update(state.row())
            if (end := self.fold.ends(key)) is not None:
                self.handle.registerTimer(end)
        for frame in rows:
            t = np.empty(len(frame), _TICK)
            for name, column in zip(_TICK.names, ("us", "trade_id", "price", "quantity", "is_buyer_maker")):
                t[name] = frame[column].to_numpy()
            at = t["us"] // 1000 // self.slice_ms
            for s in np.unique(at).tolist():
                if (s + 1) * self.slice_ms <= state.counted:
                    continue  # later than allowed: its slice is folded
                held = self.waiting.getValue((s,))
                if held is None:
                    self.handle.registerTimer((s + 1) * self.slice_ms)
                self.waiting.updateValue((s,), (bytes(held[0]) + t[at == s].tobytes() if held else t[at == s].tobytes(),))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # The first timer of a trigger folds all that the watermark has passed; the others find it done.
        upto = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        state, end = self._read(), self.fold.ends(key)
        over = end is not None and end <= upto
        if not self.state.exists() or not over and state.counted > upto - self.slice_ms:
            return
        slices = {s: np.frombuffer(bytes(v[0]), _TICK) for (s,), v in self.waiting.iterator() if over or (s + 1) * self.slice_ms <= upto}
        days = {d: v[0] for (d,), v in self.days.iterator()}
        before, known = dict(days), list(slices)
        made = _folded(self.fold, key, state, days, slices, 1 << 62 if over else upto, self.slice_ms)
        if over and state.summary is not None:
            made.append(self.fold.bar(key, state, True))
        for s in known:
            if s not in slices:
                self.waiting.removeKey((s,))
        for d in before.keys() | days.keys():
            if d not in days:
                self.days.removeKey((d,))
            elif before.get(d) != days[d]:
                self.days.updateValue((d,), (days[d],))
        if over:
            state.summary = None
        self.state.update(state.row())
        if over:
            self.state.clear()
        if made:
            yield pd.DataFrame(made, columns=self.names)

    def close(self) -> None:
        pass


def _processed(trades: DataFrame, keys: list, fold: TimeFold | ThresholdFold, schema: str, late: str) -> DataFrame:
    spark = trades.sparkSession
    if spark.conf.get(PROVIDER[0], None) != PROVIDER[1]:
        raise ValueError("set {} to {}".format(*PROVIDER))
    t = trades.withWatermark("ts", late).select(*keys, "ts", F.unix_micros("ts").alias("us"), "trade_id", "price", "quantity", "is_buyer_maker")
    names = [c.split()[0] for c in schema.split(", ")][: len(keys)]
    return t.groupBy(*names[:1], *(["edge"] if len(keys) > 1 else [])).transformWithStateInPandas(_Waiting(fold, _slice_ms(late), schema), schema, "append", "EventTime")


def ordered_time_bars(trades: DataFrame, interval: str, *, late: str = "10 minutes") -> DataFrame:
    """Time bars with basic and advanced columns: a key is a symbol's bar, so a busy symbol
    is many keys."""
    step = interval_ms(interval)
    ms = F.unix_millis("ts")
    return _processed(trades, ["symbol", (ms - F.pmod(ms, F.lit(step))).alias("edge")], TimeFold(step), f"symbol string, bar_id long, {_BAR}", late)


def _fold_of(amount: str, threshold: float | str, lookback: int, bars_per_day: int, discard_months: int, before_first: str) -> ThresholdFold:
    if threshold == "auto":
        return ThresholdFold(amount == "dollar", 0, lookback, bars_per_day, 30 * discard_months, before_first == "drop")
    if threshold <= 0:
        raise ValueError("a threshold must be positive")
    return ThresholdFold(amount == "dollar", round(threshold * _PART))


def threshold_bars(trades: DataFrame, amount: str, threshold: float | str, *, late: str = "10 minutes", lookback: int = 10, bars_per_day: int = 50, discard_months: int = 1, before_first: str = "first") -> DataFrame:
    """Volume (``amount='volume'``) or dollar bars; closed bars only. ``threshold``: a
    number, or ``'auto'`` for each day's own from the days before it. Days before the first
    known threshold wait in state for it, or with ``before_first='drop'`` are left out. State
    per symbol is the open bar, the ticks of the time that may still be late, and the totals of
    ``lookback`` days."""
    fold = _fold_of(amount, threshold, lookback, bars_per_day, discard_months, before_first)
    return _processed(trades, ["symbol"], fold, f"symbol string, bar_id long, {_BAR}", late)


def open_bars(spark: SparkSession, checkpoint: str, fold: TimeFold | ThresholdFold, *, late: str = "10 minutes") -> DataFrame:
    """What a query of ``ordered_time_bars`` or ``threshold_bars`` has read and not given yet, as
    of its last finished trigger: per key the ticks that wait, folded on a copy of the open
    bar. Bars that these ticks close have is_complete true, but may still change."""
    read = lambda name: spark.read.format("statestore").option("stateVarName", name).load(checkpoint)
    state = read("bar").select("key.*", F.struct("value.*").alias("state"))
    keys = [c for c in state.columns if c != "state"]
    waiting = read("waiting").select("key.*", F.struct(F.col("user_map_key.slice").alias("slice"), F.col("user_map_value.ticks").alias("ticks")).alias("waiting"))
    days = read("days").select("key.*", F.struct(F.col("user_map_key.day").alias("day"), F.col("user_map_value.total").alias("total")).alias("day"))
    # A row per key, and per key and slice, and per key and day: all of them state, which is bounded by the lateness.
    every = state.unionByName(waiting, allowMissingColumns=True).unionByName(days, allowMissingColumns=True)
    schema, slice_ms = f"symbol string, bar_id long, {_BAR}", _slice_ms(late)
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def show(key: tuple, table: pa.Table) -> pa.Table:
        part = {c: [r for r in table[c].to_pylist() if r is not None] for c in ("state", "waiting", "day")}
        now = State.of(tuple(part["state"][0][f] for f in _FIELDS) if part["state"] else None)
        slices = {r["slice"]: np.frombuffer(r["ticks"], _TICK) for r in part["waiting"]}
        made = _folded(fold, tuple(k.as_py() for k in key), now, {r["day"]: r["total"] for r in part["day"]}, slices, 1 << 62, slice_ms)
        if now.summary is not None:
            made.append(fold.bar(tuple(k.as_py() for k in key), now, False))
        return pa.table([list(c) for c in zip(*made)] if made else [[]] * len(kinds), schema=kinds)

    return every.groupBy(*keys).applyInArrow(show, schema)
