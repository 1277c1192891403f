"""Mixing sources to target weights by hierarchical budgeting.

A token budget goes down a tree root - domain - language - source. At each node
it is dealt to the children by weight; a child takes no more than it holds, and
what it can't take goes to its siblings first. As a node's capacity is the sum
of its leaves', only what a whole subtree lacks reaches the ancestors' other
children. The deal at a node is the water level of its children, found in one
window ordered by capacity over weight, in whole numbers.

Within a leaf, documents stand in a seeded order, anew in each epoch, and the
leaf takes the prefix of that sequence that its budget pays for: whole epochs,
then a prefix of the next one. The prefix is a limit on the seeded hash, found
from sums over ``FAN`` hash ranges, then over as many parts of the one range in which
the budget ends, and so on until that range holds at most ``FAN`` documents or one
hash. So no task ever has more than ``FAN`` rows of a leaf; documents are then
filtered where they lie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import small, stored

SEED = 17
#: Hash values, 15 hex digits of an md5, and the parts into which a range of them is cut.
PLACES, FAN = 16**15, 256
_DOMAINS = 3
LEVELS = ("domain", "language", "source")
#: Target weights (whole numbers up to 1000); others weigh 100.
WEIGHTS: dict[str, dict[str, int]] = {
    "domain": {"domain0": 100, "domain1": 80, "domain2": 60},
    "language": {"de": 80, "en": 200, "es": 60, "fr": 80},
    "source": {},
}
OTHER_WEIGHT = 100
#: Tokens wanted, in thousandths of those available.
SHARE = 750


def domain_of(source: Column) -> Column:
    """A source's domain. The tables name none, so a digest of the name deals sources out."""
    return F.concat(F.lit("domain"), F.conv(F.substring(F.md5(F.coalesce(source, F.lit(""))), 1, 8), 16, 10).cast("long") % _DOMAINS)


def tokens_of(text: Column) -> Column:
    """Runs of characters other than white space; a text counts as one at least."""
    return F.greatest(F.lit(1), F.coalesce(F.regexp_count(text, F.lit("[^ \\t\\n\\r\\f\\x0B]+")), F.lit(0))).cast("long")


def seeded(doc_id: Column, epoch: Column, seed: int) -> Column:
    """The place of a document in the order of an epoch, in [0, 16^15)."""
    name = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("long")


def _weight(level: str, weights: dict[str, dict[str, int]]) -> Column:
    known = weights.get(level, {})
    out = F.lit(OTHER_WEIGHT)
    for name, w in known.items():
        out = F.when(F.col(level) == name, F.lit(w)).otherwise(out)
    return out.cast("decimal(38,0)")


def deal(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """``nodes`` (parent columns, name, w, cap, budget of the parent) with budget
    replaced by each node's own."""
    big = lambda c: F.col(c).cast("decimal(38,0)")
    order = [F.expr("coalesce(try_divide(cap, w), 1e30)"), F.col("name")]
    before = Window.partitionBy(*parent).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    everyone = Window.partitionBy(*parent)
    n = (
        nodes.withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("w_left", F.sum("w").over(everyone) - F.coalesce(F.sum("w").over(before), F.lit(0)))
        .withColumn("full", (F.col("w") > 0) & (big("cap") * big("w_left") <= big("w") * (big("budget") - big("cap_before"))))
    )
    level = n.withColumn("taken", F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(everyone)).withColumn("w_open", F.sum(F.when(~F.col("full"), F.col("w")).otherwise(0)).over(everyone))
    share = F.expr("cast(cast(w as decimal(19,0)) * cast(budget - taken as decimal(19,0)) div nullif(w_open, 0) as bigint)")
    return level.withColumn("budget", F.when(F.col("full"), F.col("cap")).otherwise(F.coalesce(share, F.lit(0)))).select(*nodes.columns)


def budgets(leaves: DataFrame, *, total: int | None = None, share: int = SHARE, epochs: int = 1, weights: dict[str, dict[str, int]] | None = None) -> DataFrame:
    """(domain, language, source, tokens, budget) from ``leaves`` (domain,
    language, source, tokens). The total is given or a share of all tokens; a
    leaf holds ``epochs`` times its tokens."""
    weights = WEIGHTS if weights is None else weights
    sizes = leaves.withColumn("cap", F.col("tokens") * epochs)
    root = sizes.agg(F.coalesce(F.sum("cap"), F.lit(0)).alias("held"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens")).first()
    now = None
    for depth, level in enumerate(LEVELS):
        parent = [F.lit(0).alias("root")] if depth == 0 else list(LEVELS[:depth])
        names = ["root"] if depth == 0 else parent
        nodes = sizes.groupBy(*parent, F.col(level)).agg(F.sum("cap").alias("cap")).withColumn("w", _weight(level, weights)).withColumn("name", F.col(level))
        if depth == 0:
            nodes = nodes.withColumn("budget", F.lit(min(root.held, total if total is not None else root.tokens * share // 1000)))
        else:
            nodes = nodes.join(now, names)
        now = deal(nodes, names).select(*LEVELS[: depth + 1], "budget")
    return leaves.join(now, list(LEVELS))


def selection(docs: DataFrame, *, seed: int = SEED, epochs: int = 1, **how) -> tuple[DataFrame, DataFrame]:
    """(``docs`` with domain, language, n_tokens and epochs, chosen rows only; the
    stored leaf table with budgets and limits).

    A row is taken in whole epochs that the budget pays for, and once more if its
    place in the next epoch is within the limit. Rows with equal doc_id have one
    place and are taken together or not. Null language or source count as the
    empty name; a text without tokens counts one. The columns added must not
    clash: domain, language, leaf_source, n_tokens and epochs are replaced.
    """
    added = ("domain", "language", "leaf_source", "n_tokens", "epochs")
    docs = docs.drop(*added)
    lang, source = F.coalesce("lang", F.lit("")), F.coalesce("source", F.lit(""))
    named = docs.select("*", domain_of(source).alias("domain"), lang.alias("language"), source.alias("leaf_source"), tokens_of(F.col("text")).alias("n_tokens"))
    narrow = stored(named.select("doc_id", "domain", "language", F.col("leaf_source").alias("source"), "n_tokens"), "mixing-tokens")
    leaf = list(LEVELS)
    held = narrow.groupBy(*leaf).agg(F.sum("n_tokens").alias("tokens"))
    paid = budgets(held, epochs=epochs, **how).withColumn("whole", F.expr("budget div tokens")).withColumn("rest", F.expr("budget % tokens"))
    paid = stored(paid, "mixing-budgets")

    few = lambda df: small(df, leaves, 100_000)  # noqa: E731  leaves of 100 bytes at most 10 MB
    leaves = paid.count()
    placed = narrow.join(few(paid.select(*leaf, "whole", "rest")), leaf).withColumn("place", seeded(F.col("doc_id"), F.col("whole"), seed))
    # Per leaf, the range [low, low + width) in which the budget ends, and the tokens before it.
    ends, width, most = paid.select(*leaf, F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("before")), PLACES, FAN + 1
    inside = lambda: placed.join(few(ends), leaf).filter(f"place >= low and place < low + {width}")
    while width > 1 and most > FAN:
        step = max(1, width // FAN)
        sums = inside().groupBy(*leaf, "rest", "low", "before", F.expr(f"(place - low) div {step}").alias("part")).agg(F.sum("n_tokens").alias("n"), F.count("*").alias("rows"))
        through = F.col("before") + F.sum("n").over(Window.partitionBy(*leaf).orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        end = F.min(F.struct("part", F.expr("through - n").alias("before"), "rows", "low"))
        found = sums.withColumn("through", through).filter("through > rest").groupBy(*leaf).agg(end.alias("e"))
        ends = stored(found.select(*leaf, F.expr(f"e.low + e.part * {step}").alias("low"), "e.before", "e.rows"), "mixing-ranges")
        width, most = step, ends.agg(F.max("rows")).first()[0] or 0
    run = F.col("before") + F.sum("n").over(Window.partitionBy(*leaf).orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    within = inside().groupBy(*leaf, "rest", "before", "place").agg(F.sum("n_tokens").alias("n")).withColumn("through", run)
    # The limit: the last place that is paid for, or the end of the range before.
    last = within.groupBy(*leaf).agg(F.max(F.expr("case when through <= rest then place end")).alias("last"))
    limits = paid.join(ends.select(*leaf, "low"), leaf, "left").join(last, leaf, "left").withColumn("limit", F.coalesce("last", F.expr("low - 1"), F.lit(PLACES)))
    limits = stored(limits.select(*leaf, "tokens", "budget", "whole", "limit"), "mixing-limits")

    there = few(limits.select("domain", "language", F.col("source").alias("leaf_source"), "whole", "limit"))
    taken = F.col("whole") + (seeded(F.col("doc_id"), F.col("whole"), seed) <= F.col("limit")).cast("long")
    chosen = named.join(there, ["domain", "language", "leaf_source"]).withColumn("epochs", taken).filter("epochs > 0")
    return chosen.select(*docs.columns, *added), limits


def mix(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, domain, language, source, n_tokens, epochs) of the rows chosen."""
    chosen, _ = selection(docs, **how)
    return chosen.select("doc_id", "domain", "language", F.col("leaf_source").alias("source"), "n_tokens", "epochs")


def _deal_sql(name: str, nodes: str, parent: str) -> str:
    """``deal`` as two common table expressions."""
    return f"""
{name}_a AS (
  SELECT *, cap_before <= budget AND cap::HUGEINT * w_left <= w::HUGEINT * (budget - cap_before) AND w > 0 AS is_full FROM (
    SELECT *,
      coalesce(sum(cap) OVER (PARTITION BY {parent} ORDER BY cap::DOUBLE / w, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
      sum(w) OVER (PARTITION BY {parent} ORDER BY cap::DOUBLE / w, name ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left
    FROM ({nodes}))
), {name} AS (
  SELECT * EXCLUDE (budget), CASE WHEN is_full THEN cap ELSE w::HUGEINT * (budget - taken) // w_open END::BIGINT AS budget FROM (
    SELECT *, coalesce(sum(cap) FILTER (WHERE is_full) OVER (PARTITION BY {parent}), 0) AS taken, sum(w) FILTER (WHERE NOT is_full) OVER (PARTITION BY {parent}) AS w_open
    FROM {name}_a)
)"""


def _weight_sql(level: str) -> str:
    known = "".join(f" WHEN '{name}' THEN {w}" for name, w in WEIGHTS[level].items())
    return f"CASE {level}{known} ELSE {OTHER_WEIGHT} END" if known else str(OTHER_WEIGHT)


def mix_sql() -> str:
    """What ``mix`` gives with its defaults, in DuckDB SQL by plain running sums."""
    nodes1 = f"SELECT 0 AS root, domain, domain AS name, {_weight_sql('domain')} AS w, sum(tokens) AS cap, (SELECT sum(tokens) * {SHARE} // 1000 FROM leaf) AS budget FROM leaf GROUP BY domain"
    nodes2 = f"SELECT leaf.domain, language, language AS name, {_weight_sql('language')} AS w, sum(tokens) AS cap, any_value(b1.budget) AS budget FROM leaf JOIN b1 USING (domain) GROUP BY leaf.domain, language"
    nodes3 = f"SELECT domain, language, source, source AS name, {_weight_sql('source')} AS w, tokens AS cap, b2.budget AS budget FROM leaf JOIN b2 USING (domain, language)"
    return f"""
WITH d AS (
  SELECT doc_id, 'domain' || (('0x' || substr(md5(coalesce(source, '')), 1, 8))::BIGINT % {_DOMAINS}) AS domain, coalesce(lang, '') AS language,
    coalesce(source, '') AS source, greatest(1, coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\x0B]+')), 0))::BIGINT AS n_tokens
  FROM documents
), leaf AS (
  SELECT domain, language, source, sum(n_tokens)::BIGINT AS tokens FROM d GROUP BY ALL
), {_deal_sql("b1", nodes1, "root")}, {_deal_sql("b2", nodes2, "domain")}, {_deal_sql("b3", nodes3, "domain, language")},
placed AS (
  SELECT d.*, budget // tokens AS whole, budget % tokens AS rest,
    ('0x' || substr(md5('{SEED}:' || (budget // tokens) || ':' || doc_id), 1, 15))::BIGINT AS place
  FROM d JOIN leaf USING (domain, language, source) JOIN (SELECT domain, language, source, budget FROM b3) USING (domain, language, source)
)
SELECT * FROM (
  SELECT doc_id, domain, language, source, n_tokens,
    whole + (sum(n_tokens) OVER (PARTITION BY domain, language, source ORDER BY place) <= rest)::BIGINT AS epochs
  FROM placed)
WHERE epochs > 0
"""
