"""Windows over long histories, spread over blocks of time.

A window by symbol puts a symbol's whole history into one task. Here a history is cut into
blocks of rows (or of numbered timestamps), so that a symbol is many tasks:

* ``halo``: windows of bounded length. Each block takes along the rows before it that its
  windows reach, marked as not its own; any window function, or a pandas function, then
  runs by (symbol, block).
* ``exponential``: exponential means over all history. A step is the affine map
  ``x -> q x + v``; a block's rows compose to one such map, blocks are folded on these, one row
  each, and every row applies its own block's prefix to what comes in. Nothing is cut off.
* ``running_max`` and ``last_known``: prefix maxima, by blocks in the same way. ``positions``
  makes of them a state that is entered at one limit and left at another: such a state is
  the last entry's, unless it was left since, so no history need be gone through in order.
"""

from __future__ import annotations

from collections.abc import Callable
from math import floor, log

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions import sliding

ROW, BLOCK, OWN = "__row", "__block", "__own"
#: Rows of a block, unless told otherwise.
SIZE = 4096


def numbered_rows(df: DataFrame, by: tuple[str, ...] = ("symbol",), order: str = "ts") -> DataFrame:
    """Adds ROW, a row's number in its group, from 0, by counts per day: what stands in
    one order is a row per group and day, and a day's rows. ``order`` tells rows apart."""
    dated = df.withColumn("__day", F.to_date(order))
    days = dated.groupBy(*by, "__day").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*by).orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy(*by, "__day").orderBy(order)) - 1
    counted = days.select(*by, "__day", before.alias("__before"))
    return dated.withColumn(ROW, own).join(counted, [*by, "__day"]).select(*df.columns, (F.col(ROW) + F.col("__before")).alias(ROW))


def halo(df: DataFrame, before: int, *, number: str = ROW, size: int = SIZE) -> DataFrame:
    """Each row in the block of its ``number``, OWN, and again in those blocks whose first
    ``before`` numbers reach back to it. With ``before`` up to ``size`` rows come twice at most."""
    at = F.col(number)
    blocks = F.sequence(F.floor(at / size), F.floor((at + before) / size))
    return df.withColumn(BLOCK, F.explode(blocks)).withColumn(OWN, F.floor(at / size) == F.col(BLOCK))


def windows(df: DataFrame, before: int, make: Callable[[dict], dict[str, Column]], *, by: tuple[str, ...] = ("symbol",), order: str = "ts", number: str | None = None, size: int = SIZE) -> DataFrame:
    """``df`` with the columns that ``make`` gives. It is called with the arguments of
    ``functions.rolling`` by which windows run inside blocks, and its windows may reach
    ``before`` rows back, or with ``number`` timestamps (see operators.panel)."""
    rows = df if number else numbered_rows(df, by, order)
    spread = halo(rows, before, number=number or ROW, size=size)
    how = {"by": (*by, BLOCK), "order": order} | ({"number": number} if number else {})
    made = spread.select("*", *[x.alias(name) for name, x in make(how).items()])
    return made.filter(OWN).drop(BLOCK, OWN, ROW)


def apply_per_block(df: DataFrame, name: str, f: Callable, columns: list[str], before: int, *, size: int = SIZE) -> DataFrame:
    """(factor, ts, symbol, value) of a pandas function that reaches ``before`` rows
    back, given frames of a block and its halo in order of time: the same values
    as ``operators.factors.apply_per_symbol``, without a task per symbol."""
    symbol = df.schema["symbol"].dataType.simpleString()
    spread = halo(numbered_rows(df.select("ts", "symbol", *columns)), before, size=size)

    def run(pdf):
        pdf = pdf.sort_values(ROW)
        made = pdf[["ts", "symbol"]].assign(factor=name, value=f(pdf).astype("float64"))
        return made[pdf[OWN].to_numpy()][["factor", "ts", "symbol", "value"]]

    return spread.groupBy("symbol", BLOCK).applyInPandas(run, f"factor string, ts timestamp, symbol {symbol}, value double")


def order_statistics(df: DataFrame, made: dict[str, tuple[str, int, float | None]], *, order: str = "ts", size: int = SIZE) -> DataFrame:
    """Adds ``{name: (column, n, q)}``: the q-quantile of the column over a symbol's last n rows,
    or with q None the row's rank among them (see ``functions.sliding``). Blocks have
    at least as many rows as the longest window, so none comes in more than two."""
    before = max(n for _, n, _ in made.values()) - 1
    spread = halo(numbered_rows(df, order=order), before, size=max(size, before))
    schema = StructType([*df.schema.fields, *[StructField(name, DoubleType()) for name in made]])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(ROW)
        own = table[OWN]
        out = table.select(df_columns)
        for name, (column, n, q) in made.items():
            x = pc.fill_null(table[column].cast(pa.float64()), float("nan")).to_numpy()
            got = sliding.rank(x, n) if q is None else sliding.quantile(x, n, q)
            out = out.append_column(name, pa.array(got, from_pandas=True))
        return out.filter(own)

    df_columns = df.columns
    return spread.groupBy("symbol", BLOCK).applyInArrow(run, schema)


def exponential(df: DataFrame, made: dict[str, tuple[str, int]], *, by: tuple[str, ...] = ("symbol",), order: str = "ts", size: int = SIZE) -> DataFrame:
    """Adds exponential means ``{name: (column, span)}`` over all of a group's history, weights
    normed to those there are; a row without a value keeps the mean, its time counting."""
    decay = {name: 1 - 2 / (span + 1) for name, (_, span) in made.items()}
    # So few rows that powers of the decay stay far from the bounds of doubles.
    rows = max(1, min([size, *(floor(460 / -log(q)) for q in decay.values() if 0 < q < 1)]))
    spread = numbered_rows(df, by, order).withColumns({BLOCK: F.floor(F.col(ROW) / rows), "__at": (F.col(ROW) % rows).cast("double")})
    w = Window.partitionBy(*by, BLOCK).orderBy(ROW).rowsBetween(Window.unboundedPreceding, 0)
    parts = {}
    for name, (column, _) in made.items():
        q, v = decay[name], F.col(column).cast("double")
        if q <= 0:
            parts |= {f"__n_{name}": F.coalesce(v, F.lit(0.0)), f"__d_{name}": v.isNotNull().cast("double")}
            continue
        up, down = F.pow(F.lit(q), -F.col("__at")), F.pow(F.lit(q), F.col("__at"))
        parts |= {f"__n_{name}": F.sum(F.coalesce(v, F.lit(0.0)) * up).over(w) * down, f"__d_{name}": F.sum(F.when(v.isNotNull(), up).otherwise(0.0)).over(w) * down}
    local = spread.select("*", *[x.alias(n) for n, x in parts.items()])
    ends = local.groupBy(*by, BLOCK).agg(F.max(ROW).alias("__last"), *[F.max_by(n, ROW).alias(n) for n in parts])
    # A block's map is x -> q^rows x + its own sum; only the last block may have fewer rows, and nothing follows it.
    listed = ends.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(BLOCK, *parts))).alias("__blocks"))
    factor = {n: max(0.0, decay[n[4:]]) ** rows for n in parts}
    kinds = ", ".join(f"{n}: double" for n in parts)
    start = F.struct(*[F.lit(0.0).alias(n) for n in parts], F.array().cast(f"array<struct<{BLOCK}: bigint, {kinds}>>").alias("out"))

    def step(s: Column, b: Column) -> Column:
        seen = F.struct(b[BLOCK].alias(BLOCK), *[s[n].alias(n) for n in parts])
        return F.struct(*[(s[n] * factor[n] + b[n]).alias(n) for n in parts], F.concat(s["out"], F.array(seen)).alias("out"))

    into = listed.select(*by, F.inline(F.aggregate("__blocks", start, step)["out"])).withColumnsRenamed({n: f"{n}_in" for n in parts})
    both = local.join(into, [*by, BLOCK])
    whole = lambda n: F.col(n) + F.col(f"{n}_in") * F.pow(F.lit(max(0.0, decay[n[4:]])), F.col("__at") + 1)
    out = {name: F.when(whole(f"__d_{name}") > 0, whole(f"__n_{name}") / whole(f"__d_{name}")) for name in made}
    return both.select(*df.columns, *[x.alias(n) for n, x in out.items()])


def running_max(df: DataFrame, made: dict[str, Column], *, by: tuple[str, ...] = ("symbol",), size: int = SIZE) -> DataFrame:
    """Adds, to rows numbered by ROW, maxima of columns over a group's history up to the row."""
    spread = df.withColumn(BLOCK, F.floor(F.col(ROW) / size))
    w = Window.partitionBy(*by, BLOCK).orderBy(ROW).rowsBetween(Window.unboundedPreceding, 0)
    local = spread.select("*", *[F.max(x).over(w).alias(n) for n, x in made.items()])
    ends = spread.groupBy(*by, BLOCK).agg(*[F.max(x).alias(n) for n, x in made.items()])
    earlier = Window.partitionBy(*by).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    into = ends.select(*by, BLOCK, *[F.max(n).over(earlier).alias(f"{n}_in") for n in made])
    both = local.join(into, [*by, BLOCK])
    # What a block has is later, and so greater, where the columns grow with the row.
    return both.select(*df.columns, *[F.greatest(n, f"{n}_in").alias(n) for n in made])


def last_known(df: DataFrame, made: dict[str, str], *, by: tuple[str, ...] = ("symbol",), order: str = "ts", size: int = SIZE) -> DataFrame:
    """Adds the last value of a column that isn't null, up to the row."""
    rows = numbered_rows(df, by, order)
    found = running_max(rows, {f"__k_{n}": F.when(F.col(x).isNotNull(), F.struct(F.col(ROW), F.col(x).alias("x"))) for n, x in made.items()}, by=by, size=size)
    return found.select(*df.columns, *[F.col(f"__k_{n}.x").alias(n) for n in made])


def positions(df: DataFrame, *, long: Column, leave_long: Column, short: Column, leave_short: Column, by: tuple[str, ...] = ("symbol",), order: str = "ts", size: int = SIZE) -> DataFrame:
    """Adds ``position``: 1 from a row where ``long`` holds to the one before ``leave_long``, -1
    likewise, else 0. An entry ends the other side; a row that enters isn't left at once; of
    two entries ``long`` counts. A condition that is null doesn't hold."""
    yes = lambda x: F.coalesce(x, F.lit(False))
    rows = numbered_rows(df, by, order)
    up, down = yes(long), yes(short) & ~yes(long)
    at = lambda cond: F.when(cond, F.col(ROW))
    found = running_max(rows, {"__up": at(up), "__down": at(down), "__no_up": at(yes(leave_long) & ~up), "__no_down": at(yes(leave_short) & ~down)}, by=by, size=size)
    of = lambda n: F.coalesce(n, F.lit(-1))
    position = F.when((of("__up") > of("__down")) & (of("__up") > of("__no_up")), 1).when((of("__down") > of("__up")) & (of("__down") > of("__no_down")), -1).otherwise(0)
    return found.withColumn("position", position).select(*df.columns, "position")
