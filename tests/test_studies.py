"""Flow features, robustness and capacity against plain versions."""

import datetime as dt
import math
import random
from statistics import fmean, pstdev

import pytest

from barloom.operators import flow, robustness

TICKS = "symbol string, ts timestamp, trade_id long, price double, quantity double, is_buyer_maker boolean"
DATA = "factor string, ts timestamp, symbol string, value double, ret_1 double, quantile int"
T0 = dt.datetime(2024, 1, 1)


def ticks(n, seed=0):
    rnd = random.Random(seed)
    at = T0
    rows = []
    for k in range(n):
        at += dt.timedelta(milliseconds=rnd.choice([0, 5, 1000, 60_000]))
        rows.append(("A", at, k, 100 + rnd.randint(-50, 50) / 10, float(rnd.randint(0, 9)), rnd.random() < 0.5))
    return rows


def test_flow_features_by_hand(spark):
    rows = ticks(60)
    got = flow.features(spark.createDataFrame(rows, TICKS), "1d").first()
    price, q, side = [r[3] for r in rows], [r[4] for r in rows], [-1 if r[5] else 1 for r in rows]
    r = [math.log(b / a) for a, b in zip(price, price[1:])]
    assert got.jump_ratio == pytest.approx(max(0, 1 - math.pi / 2 * sum(abs(a * b) for a, b in zip(r, r[1:])) / sum(x * x for x in r)))
    gaps = [(b[1] - a[1]).total_seconds() * 1000 for a, b in zip(rows, rows[1:])]
    assert got.burstiness == pytest.approx((pstdev(gaps) - fmean(gaps)) / (pstdev(gaps) + fmean(gaps)))
    runs = [1]
    for a, b in zip(side, side[1:]):
        if a == b:
            runs[-1] += 1
        else:
            runs.append(1)
    assert got.toxicity_run_max == max(runs) and got.toxicity_run_mean == pytest.approx(fmean(runs)) and got.toxicity_ratio == pytest.approx(max(runs) / 60)
    place = 0.9 * 59
    low = sorted(q)[int(place)]
    edge = low + (sorted(q)[int(place) + 1] - low) * (place - int(place))
    big = [k for k in range(60) if q[k] >= edge]
    assert got.whale_imbalance == pytest.approx(sum(side[k] * q[k] for k in big) / sum(q[k] for k in big))
    assert got.whale_impact == pytest.approx(sum(side[k] * (price[k] - price[k - 1]) for k in big if k) / sum(q[k] for k in big))


def test_flow_features_odd_rows(spark):
    one = [("A", T0, 1, 0.0, 0.0, False), ("B", T0, 1, 5.0, 2.0, True), ("B", T0, 2, 5.0, 2.0, True)]
    got = {r.symbol: r for r in flow.features(spark.createDataFrame(one, TICKS), "1h").collect()}
    assert (got["A"].jump_ratio, got["A"].burstiness, got["A"].whale_imbalance, got["A"].toxicity_run_max) == (None, None, None, 1)
    assert (got["B"].jump_ratio, got["B"].burstiness, got["B"].whale_imbalance, got["B"].toxicity_ratio) == (None, None, -1.0, 1.0)
    assert flow.features(spark.createDataFrame([], TICKS), "1h").count() == 0


def test_vpin_by_hand(spark):
    rows = ticks(300, 1)
    got = [r.vpin for r in flow.vpin(spark.createDataFrame(rows, TICKS), 20, buckets=5).orderBy("bar_id").collect()]
    units = [-1 if r[5] else 1 for r in rows for _ in range(int(r[4]))]
    share = [abs(sum(units[k : k + 20])) / 20 for k in range(0, len(units) - 19, 20)]
    assert got[:4] == [None] * 4 and got[4:] == pytest.approx([fmean(share[k - 4 : k + 1]) for k in range(4, len(share))])


def test_vpin_of_the_last_bucket_that_ended(spark):
    p = spark.createDataFrame([(T0 + dt.timedelta(hours=k), "A") for k in range(4)], "ts timestamp, symbol string")
    ms = int(T0.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
    b = spark.createDataFrame([("A", 0, ms + 3_600_000, 0.25), ("A", 1, ms + 3_700_000, 0.5)], "symbol string, bar_id long, end_time_ms long, vpin double")
    assert [r.vpin for r in flow.with_vpin(p, b, "1h").orderBy("ts").collect()] == [None, 0.5, 0.5, 0.5]


def panel(seed=0):
    rnd = random.Random(seed)
    return [("f", T0 + dt.timedelta(days=d), f"s{k}", x := rnd.random(), x * (1 if d % 2 else -1) + rnd.random() / 10, 1 + k % 3) for d in range(12) for k in range(9)]


def test_replicates_without_anything_dropped_are_the_base(spark):
    got = robustness.replicates(spark.createDataFrame(panel(), DATA), n=3, drop_dates=0.0, drop_symbols=0.0, delays=(1,)).collect()
    by = {(r.kind, r.replicate): (r.n_dates, round(r.mean_ic, 9), round(r.spread, 9)) for r in got}
    assert len({v for k, v in by.items() if k[0] != "delay"}) == 1 and len(by) == 1 + 3 + 3 + 1
    assert by["delay", 1][0] == 11


def test_replicates_drop_their_share_and_repeat(spark):
    df = spark.createDataFrame(panel(1), DATA)
    make = lambda seed: {(r.kind, r.replicate): r.n_dates for r in robustness.replicates(df, n=40, seed=seed).collect()}
    one = make(0)
    assert one == make(0) and one != make(1)
    assert 12 * 0.7 < fmean(one["dates", r] for r in range(1, 41)) < 12 * 0.9
    assert robustness.replicates(df.limit(0)).count() == 0


def test_stability_tells_the_share_of_equal_signs(spark):
    rows = [("f", "base", 0, 0.2)] + [("f", "dates", k, x) for k, x in enumerate((0.1, 0.3, -0.1, 0.5), 1)]
    r = robustness.stability(spark.createDataFrame(rows, "factor string, kind string, replicate int, mean_ic double")).first()
    assert (r.n, r.base_ic, r.low_ic, r.high_ic, r.same_sign) == (4, 0.2, -0.1, 0.5, 0.75)


def test_capacity_by_hand(spark):
    day = [T0, T0 + dt.timedelta(days=1)]
    w = spark.createDataFrame([("f", day[0], "A", 1.0), ("f", day[0], "B", -1.0), ("f", day[1], "A", 0.5), ("f", day[1], "A", 0.5), ("f", day[1], "C", -1.0)], "factor string, ts timestamp, symbol string, weight double")
    v = spark.createDataFrame([(day[0], "A", 100.0), (day[0], "B", 400.0), (day[1], "A", 300.0), (day[1], "B", 0.0)], "ts timestamp, symbol string, dollar_volume double")
    r = robustness.capacity(w, v, [100.0], impact=0.1, n=2).first()
    # Orders: A 1 of 100, B 1 of 400, then B back 1 of 200 (mean), C without a volume.
    assert (r.n_orders, r.n_unpriced, r.most, r.turnover) == (4, 1, 1.0, 2.0)
    assert r.participation == pytest.approx((1 + 0.25 + 0.5) / 3) and r.cost == pytest.approx(0.1 * (1 + 0.5 + math.sqrt(0.5)) / 2)
