"""Top-k search, perspective rotation and mixing against plain versions; the pipeline."""


import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import chat, mixing, queries, topk

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "conversations")


def normal(rows):
    return sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    names = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(names)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert normal(got.select(*names).collect()) == normal(want) and want


# Top-k


def brute_top(rows, k=5, every=50):
    v = [(i, np.floor(np.array(x) * 256).astype(int)) for i, x in rows if x is not None and all(e is not None and np.isfinite(e) for e in x)]
    out = []
    for n, (q, x) in enumerate(v):
        if q % every == 0:
            scored = sorted((-int(x @ y), c) for m, (c, y) in enumerate(v) if m != n and len(y) == len(x))[:k]
            out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(scored)]
    return sorted(out)


def top(df):
    return sorted(map(tuple, topk.top_k(df).drop("query_row").collect()))


@pytest.mark.parametrize(("n", "dim", "seed"), [(400, 8, 0), (3000, 64, 1), (30, 3, 2), (900, 1, 3)])
def test_top_k_equals_brute_force_with_ties(spark, n, dim, seed, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 7)
    monkeypatch.setattr(topk, "LEAST_SLICE", 100)
    rnd = np.random.default_rng(seed)
    rows = [(k, [float(x) for x in np.round(rnd.normal(size=dim), 1)]) for k in range(n)]
    rows[3:9] = [(k, rows[0][1]) for k in range(3, 9)]
    rows += [(n, None), (n + 1, [None] + [0.0] * (dim - 1)), (n + 2, [float("nan")] * dim), (50 * n, [1e3] * dim), (0, [2.0] * dim), (3, [3.0] * dim)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("v", "row", "block", "side")})
    assert top(df) == brute_top(rows)


def test_clustered_vectors_are_pruned_and_scored_pair_by_pair(spark, monkeypatch):
    rnd = np.random.default_rng(4)
    centre = rnd.normal(size=(40, 32)) * 4
    rows = [(k, [float(x) for x in centre[k % 40] + 0.02 * rnd.normal(size=32)]) for k in range(4000)]
    assert top(spark.createDataFrame(rows, "vec_id long, embedding array<double>")) == brute_top(rows)
    v = np.floor(np.array([x for _, x in rows]) * 256).astype(np.int64)
    ids, scored = np.arange(4000), []
    pairs = topk.Best._score_pairs
    monkeypatch.setattr(topk.Best, "_score_pairs", lambda self, r, c, i, j: (scored.append(len(i)), pairs(self, r, c, i, j))[1])
    monkeypatch.setattr(topk, "_exact", None)
    best = topk.Best(topk._Vectors(ids[::50], ids[::50], v[::50]), 5)
    best.search(topk._Vectors(ids, ids, v))
    assert sum(scored) < 0.1 * 80 * 4000


def test_top_k_small_tables(spark):
    kind = "vec_id long, embedding array<float>"
    assert top(spark.createDataFrame([], kind)) == []
    assert top(spark.createDataFrame([(0, [1.0, 2.0])], kind)) == []
    two = spark.createDataFrame([(0, [1.0]), (7, [0.5]), (7, [0.75]), (None, [9.0])], kind)
    assert top(two) == [(0, 1, 7, 256 * 192), (0, 2, 7, 256 * 128)]
    both = spark.createDataFrame([(50, [1.0]), (50, [2.0])], kind)
    assert top(both) == [(50, 1, 50, 512 * 256), (50, 1, 50, 512 * 256)]


def test_components_too_large_for_whole_scores_are_an_error(spark):
    df = spark.createDataFrame([(0, [1e30, 1.0]), (1, [0.1, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        topk.top_k(df).collect()
    large = [(0, [4e6, -4e6]), (1, [4e6, 4e6]), (2, [-5e6, 5e6])]
    assert top(spark.createDataFrame(large, "vec_id long, embedding array<double>")) == brute_top(large)


def test_bounds_hold():
    rnd = np.random.default_rng(0)
    a, b = (topk._Vectors(np.arange(40), np.arange(40), rnd.integers(-300, 300, (40, 20))) for _ in range(2))
    exact = a.v @ b.v.T
    tight = [topk.Best._bound(a, b, x, y) - exact for x, y in zip(a.levels, b.levels)]
    assert all((t >= -1e-6).all() for t in tight) and tight[-1].mean() < tight[0].mean()


# Perspectives

TURNS = "conv_id long, turn long, role string, text string"


def test_rotation_by_hand(spark):
    rows = [(1, 0, "system", "be brief"), (1, 1, "ann", "hi"), (1, 2, "bob", "<|x"), (1, 2, "bob", "<|x"), (1, 3, None, None)]
    df = spark.createDataFrame(rows, TURNS).withColumn("part", F.lit("clash"))
    got = {r.perspective: r for r in chat.rotate(df).collect()}
    assert set(got) == {"ann", "bob", "unknown"}
    assert got["ann"].rendered == "<|system|>\nbe brief<|end|>\n<|assistant|>\nhi<|end|>\n<|user name=bob|>\n< |x<|end|>\n<|user name=unknown|>\n<|end|>\n"
    for who, said in (("ann", ["hi<|end|>"]), ("bob", ["< |x<|end|>"]), ("unknown", ["<|end|>"])):
        spans = [tuple(map(int, s.split("-"))) for s in got[who].mask.split(",")]
        assert [got[who].rendered[a:b] for a, b in spans] == said
    assert {(r.n_turns, r.n_target_turns) for r in got.values()} == {(4, 1)}


def test_long_dialogues_come_in_parts_that_join(spark):
    rows = [(1, k, "ab"[k % 2], f"t{k}") for k in range(25)]
    df = spark.createDataFrame(rows, TURNS)
    parts = chat.rotate(df, part_turns=10).filter("perspective = 'a'").orderBy("part").collect()
    assert [r.n_turns for r in parts] == [10, 10, 5]
    assert "".join(r.rendered for r in parts) == chat.rotate(df).filter("perspective = 'a'").first().rendered


def test_crowded_parts_are_split_and_join_to_the_whole(spark):
    rows = [(1, k // 100, "ab"[k % 2], f"t{k}") for k in range(300)] + [(1, 0, "a", "same")] * 200 + [(2, 0, "a", "x")]
    df = spark.createDataFrame(rows, TURNS)
    got = chat.rotate(df, part_turns=10).filter("conv_id = 1 and perspective = 'a'").orderBy("part", "first_turn", "tie").collect()
    assert len(got) > 20 and max(r.n_turns for r in got) < 30 and sum(r.n_turns for r in got) == 301
    assert [r.first_turn for r in got] == sorted(r.first_turn for r in got)
    assert [(r.part, r.tie) for r in chat.rotate(df, part_turns=10).filter("conv_id = 2").collect()] == [(0, 0)]


def test_repeats_change_nothing_and_runs_keep_the_order(spark):
    whole = [(1, k, "ab"[k % 2], f"t{k}") for k in range(8)]
    crowd = [(2, k % 3, "abc"[k % 7 % 3], f"t{k}") for k in range(2_000)]
    got = chat.rotate(spark.createDataFrame(whole * 129 + crowd, TURNS)).filter("perspective = 'a'").orderBy("conv_id", "part", "first_turn", "tie").collect()
    assert [r.asDict() for r in got if r.conv_id == 1] == [r.asDict() for r in chat.rotate(spark.createDataFrame(whole, TURNS)).filter("perspective = 'a'").collect()]
    runs = [r for r in got if r.conv_id == 2]
    assert [r.tie for r in runs] == list(range(8)) and [r.n_turns for r in runs] == [256] * 7 + [208]
    assert "".join(r.rendered for r in runs) == "".join(f"<|{'assistant' if who == 'a' else 'user name=' + who}|>\n{text}<|end|>\n" for _, _, who, text in sorted(crowd))


def test_crowded_parts_equal_the_sql(spark):
    rows = [(1, t % 300, f"s{t % 5}", f"line {t}") for t in range(3000)] + [(2, 0, "a", f"x{k}") for k in range(1024)] + [(3, 1, "b", f"y{k}") for k in range(1025)] + [(5, 3, "d", f"z{k}") for k in range(256)] + [(6, 3, "e", "w" * 300 + f"{k}") for k in range(257)] + [(4, 7, "c", "same")] * 3000
    df = spark.createDataFrame(rows, TURNS)
    con = duckdb.connect()
    con.register("conversations", df.toPandas())
    got = chat.rotate(df)
    names = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(names)} FROM ({chat.ROTATE_SQL})").fetchall()
    assert normal(got.select(*names).collect()) == normal(want)


def test_rotation_odd_rows(spark):
    rows = [(None, 1, "a", "x"), (None, 1, "b", "y"), (2, None, "a", "p"), (2, None, "b", "q"), (3, 0, "system", "s"), (4, 0, "a", "long " * 50_000)]
    got = chat.rotate(spark.createDataFrame(rows, TURNS)).collect()
    assert sorted(r.perspective for r in got if r.conv_id is None) == ["a", "b"]
    assert len([r for r in got if r.conv_id == 2]) == 4 and not [r for r in got if r.conv_id == 3]
    assert chat.rotate(spark.createDataFrame([], TURNS)).count() == 0


# Mixing


def water(budget, caps, weights):
    """Deals a budget out one step at a time: what a full child can't take goes to the others."""
    taken, open_ = {c: 0.0 for c in caps}, {c for c in caps if weights[c] > 0}
    left = min(budget, sum(caps[c] for c in open_))
    while left > 1e-9 and open_:
        total = sum(weights[c] for c in open_)
        full = {c for c in open_ if caps[c] - taken[c] <= left * weights[c] / total + 1e-12}
        if not full:
            for c in open_:
                taken[c] += left * weights[c] / total
            break
        for c in full:
            left -= caps[c] - taken[c]
            taken[c] = caps[c]
        open_ -= full
    return taken


def test_shortages_go_to_siblings_first(spark):
    leaves = [("d1", "en", "a", 1000), ("d1", "en", "b", 10), ("d1", "fr", "c", 5), ("d2", "en", "e", 300), ("d2", "xx", "z", 300)]
    weights = {"domain": {"d1": 300, "d2": 100}, "language": {"xx": 0}, "source": {"a": 50, "b": 100}}
    df = spark.createDataFrame(leaves, "domain string, language string, source string, tokens long")
    got = {r.source: r.budget for r in mixing.budgets(df, total=800, weights=weights).collect()}
    domain = water(800, {"d1": 1015, "d2": 600}, {"d1": 300, "d2": 100})
    one = water(domain["d1"], {"en": 1010, "fr": 5}, {"en": 100, "fr": 100})
    two = water(domain["d2"], {"en": 300, "xx": 300}, {"en": 100, "xx": 0})
    deep = water(one["en"], {"a": 1000, "b": 10}, {"a": 50, "b": 100})
    want = {**deep, "c": one["fr"], "e": two["en"], "z": two["xx"]}
    assert all(abs(got[s] - want[s]) <= 2 for s in want)


@pytest.mark.parametrize("share", [100, 900, 1700, 5000])
def test_prefixes_follow_the_seeded_order(spark, share):
    df = spark.read.parquet(f"{SF}/documents.parquet").withColumn("domain", F.lit("clash"))
    chosen, limits = mixing.selection(df, epochs=3, share=share)
    every = df.drop("domain").select("doc_id", "lang", "source", mixing.tokens_of(F.col("text")).alias("n")).collect()
    rows, taken = {(r.language, r.source): r for r in limits.collect()}, {r.doc_id: r.epochs for r in chosen.collect()}
    for (lang, source), leaf in rows.items():
        own = [r for r in every if (r.lang, r.source) == (lang, source)]
        whole, rest = divmod(leaf.budget, leaf.tokens)
        place = {r.doc_id: p for r, p in zip(own, [x[0] for x in spark.createDataFrame([(r.doc_id,) for r in own], "d long").select(mixing.seeded(F.col("d"), F.lit(whole), mixing.SEED)).collect()])}
        run = 0
        for r in sorted(own, key=lambda r: place[r.doc_id]):
            run += r.n
            assert taken.get(r.doc_id, 0) == whole + (run <= rest)


def test_rows_of_one_id_and_narrow_ranges_equal_the_sql(spark, monkeypatch):
    """One doc_id holds a third of a leaf; ranges are cut down to single hashes."""
    monkeypatch.setattr(mixing, "FAN", 4)
    rows = [(5 if k % 3 == 0 else k, "w " * (1 + k % 9), "en" if k % 4 else "de", f"src{k % 3}") for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    got = mixing.mix(df)
    names = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(names)} FROM ({mixing.mix_sql()})").fetchall()
    assert normal(got.select(*names).collect()) == normal(want) and want


def test_mixing_odd_rows(spark):
    kind = "doc_id long, text string, lang string, source string"
    rows = [(1, None, None, None), (2, "", "en", None), (None, "a b", "en", "s"), (3, "a b", "en", "s"), (3, "a b", "en", "s")]
    assert mixing.mix(spark.createDataFrame(rows, kind), share=1000).count() == len(rows)
    assert mixing.mix(spark.createDataFrame([], kind)).count() == 0


# The pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept, before = docs, docs.count()
    for name, stage in p.STAGES[:-1]:
        kept = p.stored(stage(spark, kept, SF), f"test-{name}")
        assert kept.columns == docs.columns
        assert 0 < kept.count() <= before
        before = kept.count()
    packed = p.STAGES[-1][1](spark, kept, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in kept.collect()}


def test_line_dedup_stage_leaves_unique_lines(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet").schema
    shared = [f"a passage number {k} that some other document holds as well {'x' * k}" for k in range(0, 60, 5)]
    texts = ["\n".join(shared[:6]), "\n".join(shared[6:]), "\n".join([*shared, "own line"]), "\n\t\n".join(shared[:3]), None, " "]
    df = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in enumerate(texts)], docs)
    got = {r.doc_id: (r.text, r.n_chars) for r in p.line_dedup(spark, df, SF).collect()}
    assert got == {0: (texts[0], len(texts[0])), 1: (texts[1], len(texts[1])), 2: ("own line", 8), 4: (None, None), 5: (" ", 1)}


def test_texts_that_no_language_fits_are_rejected(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    polish = "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem."
    texts = {-1: polish, -2: "xqzvkj wqpzx kjxqv zzqxw jvkqp xwzqk vjqxz qkzpw", -3: '<div class="x1"><a href="/q?z=1">#</a></div><br/><td width="3">', -4: "Все люди рождаются свободными и равными", -5: "The.", -6: "The and of that."}
    more = docs.unionByName(spark.createDataFrame([(k, t, None, "s", len(t)) for k, t in texts.items()], docs.schema))
    kept = {r.doc_id: r.lang for r in p.language_id(spark, more, SF).collect()}
    assert {k for k in kept if k < 0} == {-5, -6} and kept[-6] == "en"
    assert len(kept) >= 0.97 * docs.count()


def test_pipeline_stages_take_odd_rows(spark):
    import corpus_pipeline as p

    kind = spark.read.parquet(f"{SF}/documents.parquet").schema
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "some words of a text", "en", "s", 20), (3, "some words of a text", "en", "s", 20)]
    for df in (spark.createDataFrame(rows, kind), spark.createDataFrame([], kind)):
        for _, stage in p.STAGES:
            stage(spark, df.withColumn("h", F.lit(1)), SF).collect()


def test_everything_is_registered():
    import __spark_entry__ as e

    names = e.queries()
    assert {n.split("_")[0] for n in names} >= {f"op{k}" for k in range(1, 11)} and "pipeline" in names
    assert set(e.oracle_sql()) <= set(names)
