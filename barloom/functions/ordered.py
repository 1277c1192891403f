"""Order-aware summaries of a bar's ticks that merge by time.

A summary holds what a bar's columns need of a run of ticks: first and last price and
time, first and last direction, counts of moves and reversals, the path, and moments of
prices, quantities and gaps. Summaries of two runs, the second after the first, merge to
that of both; so ticks can be folded as they become final, and the state is a few numbers.
"""

from __future__ import annotations

import math

import numpy as np

#: Fields of a summary; moments of x are their number, mean and sums of powers of the deviations.
FIELDS = (
    "n start end open high low close volume buy amount first_way last_way up down turns path "
    "price_mean price_2 price_3 price_4 size_mean size_2 most gap_n gap_mean gap_2"
).split()
_AT = {f: k for k, f in enumerate(FIELDS)}
#: As columns of a table; whole numbers below 2^53 are exact in doubles.
SCHEMA = ", ".join(f"{f} double" for f in FIELDS)


def summaries(bar: np.ndarray, ms: np.ndarray, price: np.ndarray, quantity: np.ndarray, amount: np.ndarray, maker: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bars, a row of FIELDS for each): ticks, or pieces of ticks, in order; those of a bar are neighbours."""
    if not len(bar):
        return bar, np.empty((0, len(FIELDS)))
    at = np.flatnonzero(np.r_[True, bar[1:] != bar[:-1]])
    n = np.diff(np.r_[at, len(bar)])
    own = np.repeat(np.arange(len(at)), n)
    inner = np.ones(len(bar), bool)
    inner[at] = False
    total = lambda x: np.add.reduceat(x, at)
    step = np.where(inner, np.diff(price, prepend=price[:1]), 0.0)
    way = np.sign(step)
    moved = np.flatnonzero(way)
    # Of each direction, the one before it in the same bar.
    turn = np.zeros(len(bar))
    same = own[moved[1:]] == own[moved[:-1]]
    turn[moved[1:]] = same & (way[moved[1:]] != way[moved[:-1]])
    first_way, last_way = np.zeros(len(at)), np.zeros(len(at))
    last_way[own[moved]] = way[moved]
    first_way[own[moved[::-1]]] = way[moved[::-1]]
    gap = np.where(inner, np.diff(ms, prepend=ms[:1]), -1).astype(np.float64)
    has = (gap >= 0).astype(np.float64)
    gap_n = total(has)
    mean, size, wait = total(price) / n, total(quantity) / n, total(gap * has) / np.maximum(gap_n, 1)
    d, e, g = price - mean[own], quantity - size[own], (gap - wait[own]) * has
    buys = np.where(maker, 0.0, quantity)
    columns = {
        "n": n, "start": np.minimum.reduceat(ms, at), "end": np.maximum.reduceat(ms, at), "open": price[at], "high": np.maximum.reduceat(price, at),
        "low": np.minimum.reduceat(price, at), "close": price[np.r_[at[1:], len(bar)] - 1], "volume": total(quantity), "buy": total(buys), "amount": total(amount),
        "first_way": first_way, "last_way": last_way, "up": total((step > 0) * 1.0), "down": total((step < 0) * 1.0), "turns": total(turn), "path": total(np.abs(step)),
        "price_mean": mean, "price_2": total(d**2), "price_3": total(d**3), "price_4": total(d**4), "size_mean": size, "size_2": total(e**2),
        "most": np.maximum.reduceat(quantity, at), "gap_n": gap_n, "gap_mean": wait, "gap_2": total(g**2),
    }
    return bar[at], np.stack([columns[f].astype(np.float64) for f in FIELDS], axis=1)


def _moments(n: float, mean: float, squares: float, m: float, other: float, more: float) -> tuple[float, float, float]:
    """Number, mean and squared deviations of two groups together."""
    both, d = n + m, other - mean
    return (both, mean + d * m / both, squares + more + d * d * n * m / both) if both else (0.0, 0.0, 0.0)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The summary of a run and of the one after it."""
    x, y = dict(zip(FIELDS, a.tolist())), dict(zip(FIELDS, b.tolist()))
    out = {f: x[f] + y[f] for f in ("n", "volume", "buy", "amount", "up", "down", "turns", "path")}
    out |= {"start": min(x["start"], y["start"]), "end": max(x["end"], y["end"]), "open": x["open"], "close": y["close"], "high": max(x["high"], y["high"]), "low": min(x["low"], y["low"]), "most": max(x["most"], y["most"])}
    step = y["open"] - x["close"]
    way = float(np.sign(step))
    out["up"] += step > 0
    out["down"] += step < 0
    out["path"] += abs(step)
    out["turns"] += bool(way and x["last_way"] and way != x["last_way"])
    before = way or x["last_way"]
    out["turns"] += bool(y["first_way"] and before and y["first_way"] != before)
    out["first_way"] = x["first_way"] or way or y["first_way"]
    out["last_way"] = y["last_way"] or way or x["last_way"]
    n, m = x["n"], y["n"]
    both, d = n + m, y["price_mean"] - x["price_mean"]
    _, out["price_mean"], out["price_2"] = _moments(n, x["price_mean"], x["price_2"], m, y["price_mean"], y["price_2"])
    out["price_3"] = x["price_3"] + y["price_3"] + d**3 * n * m * (n - m) / both**2 + 3 * d * (n * y["price_2"] - m * x["price_2"]) / both
    out["price_4"] = x["price_4"] + y["price_4"] + d**4 * n * m * (n * n - n * m + m * m) / both**3 + 6 * d * d * (n * n * y["price_2"] + m * m * x["price_2"]) / both**2 + 4 * d * (n * y["price_3"] - m * x["price_3"]) / both
    _, out["size_mean"], out["size_2"] = _moments(n, x["size_mean"], x["size_2"], m, y["size_mean"], y["size_2"])
    gap = _moments(x["gap_n"], x["gap_mean"], x["gap_2"], y["gap_n"], y["gap_mean"], y["gap_2"])
    # Between the runs there is a gap, too.
    wait = y["start"] - x["end"]
    out["gap_n"], out["gap_mean"], out["gap_2"] = _moments(*gap, 1.0, wait, 0.0) if wait >= 0 else gap
    return np.array([out[f] for f in FIELDS], np.float64)


BASIC = "start_time_ms long, end_time_ms long, open double, high double, low double, close double, volume double, buy_volume double, sell_volume double, vwap double, tick_count long, dollar_volume double"
ADVANCED = (
    "price_std double, volume_std double, up_move_ratio double, down_move_ratio double, reversals long, buy_sell_imbalance double, spread_proxy double, skewness double, kurtosis double, "
    "max_trade_volume double, max_trade_ratio double, tick_interval_mean double, tick_interval_std double, path_efficiency double, impact_density double"
)


def columns(s: np.ndarray, start: int | None = None) -> tuple:
    """BASIC and ADVANCED of a summary, as operators.bars defines them."""
    x = dict(zip(FIELDS, s.tolist()))
    n, share = x["n"], lambda a, b: a / b if b else 0.0
    spread = lambda squares, m: math.sqrt(squares / (m - 1)) if m > 1 else 0.0
    vwap, sell, moves = share(x["amount"], x["volume"]), x["volume"] - x["buy"], x["high"] > x["low"]
    basic = (int(x["start"]) if start is None else start, int(x["end"]), x["open"], x["high"], x["low"], x["close"], x["volume"], x["buy"], sell, vwap, int(n), x["amount"])
    return basic + (
        spread(x["price_2"], n),
        spread(x["size_2"], n),
        x["up"] / n,
        x["down"] / n,
        int(x["turns"]),
        share(x["buy"] - sell, x["volume"]),
        (x["high"] - x["low"]) / vwap if vwap > 0 and moves else 0.0,
        math.sqrt(n) * x["price_3"] / x["price_2"] ** 1.5 if n >= 3 and moves else 0.0,
        n * x["price_4"] / x["price_2"] ** 2 - 3 if n >= 4 and moves else 0.0,
        max(x["most"], 0.0),
        share(x["most"], x["volume"]),
        x["gap_mean"],
        spread(x["gap_2"], x["gap_n"]),
        abs(x["close"] - x["open"]) / x["path"] if x["path"] > 0 else 1.0,
        share(abs(x["close"] - x["open"]), x["amount"]),
    )
