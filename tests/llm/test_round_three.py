"""Alignment, centroid clustering and least-squares packing against plain versions."""

import hashlib
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from barloom.llm import alignment, bytebpe, centroids, windows
from barloom.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, a string, uid long, salt string, key long"
LETTERS = [*"abcXYZ019 .,'!?\n \t\r éñß²ª½—“”▁\xa0\x85\x1c 　\xad中文אब़ा😀\x01\x00", " ", "\n", "  ", "'s", "'ll", "<|endoftext|>", "<s>", "<0x41>", "...", " \n", "\n\n"]


def texts(n, seed, most=14):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(LETTERS) for _ in range(rnd.randint(0, most))) for _ in range(n)]


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "x", 7, "y", 1) for i, t in rows], DOCS)


# Encoder


@pytest.mark.parametrize("specials", [True, False])
def test_encoder_gives_the_tokenizers_ids(specials):
    plain = Tokenizer.from_file(A)
    plain.encode_special_tokens = not specials
    mine = bytebpe.ByteEncoder(A, specials=specials)
    assert mine.ranked is not None
    some = texts(20_000, 1) + ["", "word " * 3000, "The end. It's 12:30, they're\n\nhere; 3 % off..."]
    ids, size = mine.encode(pa.array(some))
    at = bytebpe.bounds(size)
    assert all(e.ids == ids[a:b].tolist() for e, a, b in zip(plain.encode_batch(some, add_special_tokens=False), at[:-1], at[1:], strict=True))
    ids, size = mine.encode(pa.array([None, "a"]))
    assert size.tolist() == [0, 1]


def test_vocabulary_without_ranks_is_encoded_whole():
    mine = bytebpe.ByteEncoder(public_tokenizers.path("word_bpe_49k.json"))
    assert mine.ranked is None
    ids, size = mine.encode(pa.array(["Some words, here.", None]))
    assert ids.tolist() == mine.tokenizer.encode("Some words, here.", add_special_tokens=False).ids and size[1] == 0


# Alignment


def brute(rows):
    """Byte by byte, each text encoded whole."""
    import sentencepiece

    tok, sp = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    tok.encode_special_tokens = True
    letters, of = bytebpe.byte_of_letter(), {n: t for t, n in tok.get_vocab().items()}
    piece = lambda i: bytes([int(sp.id_to_piece(i)[1:-1], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()
    made, count = [], Counter()
    for i, text in rows:
        ia = tok.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        ib = sp.encode(text) if text else []
        ta, tb = [bytes(letters[c] for c in of[x]) for x in ia], [piece(x) for x in ib]
        whole = (" " + text).encode() if text else b""
        if b"".join(ta) != whole or b"".join(tb) != whole:
            ia, ib, ta, tb = [], [], [], []
        spans = []
        for part in (ta, tb):
            at, own = 0, []
            for x in part:
                own.append((at, at + len(x)))
                at += len(x)
            spans.append(own)
        owners = [[k for k, (p, q) in enumerate(own) for _ in range(p, q)] for own in spans]
        links = [(ia[m], ib[n]) for m, n in sorted(set(zip(*owners, strict=True)))]  # who share a byte
        ends = sorted({q for _, q in spans[0]} & {s for _, s in spans[1]})
        groups, last = [], 0
        for e in ends:
            groups.append(",".join(str(x) for x, (_, q) in zip(ia, spans[0]) if last < q <= e) + "|" + ",".join(str(x) for x, (_, s) in zip(ib, spans[1]) if last < s <= e))
            last = e
        count.update(links)
        made.append((i, ia, ib, groups, links))
    most = Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    return [(i, len(a), len(b), len(g), len(k), hashlib.sha256(";".join(g).encode()).hexdigest() if a else "", sum(count[x] == most[x[1]] for x in k), sum(count[x] for x in k)) for i, a, b, g, k in made]


NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]


def key(rows):
    return sorted(map(tuple, rows), key=str)


@pytest.mark.parametrize("most_pairs", [alignment.PAIRS, 0])
def test_alignment_equals_the_plain_version(spark, most_pairs):
    rows = list(enumerate(texts(500, 2))) + [(1, "twice the same"), (1, "twice the same"), (None, "no id"), (900, None), (901, ""), (902, " "), (903, "\n"), (904, "\n lead"), (905, "tail \n"), (906, "a▁b"), (907, "In eaenat the ouat onenti, thheingble. " * 400), (908, "a  b   c"), (909, "<s> </s> <unk> <|endoftext|>")]
    got = alignment.align(documents(spark, rows).repartition(3), path_a=A, path_b=B, most_pairs=most_pairs)
    assert got.columns == NAMES or set(got.columns) == set(NAMES)
    assert key(got.select(NAMES).collect()) == key(brute(rows))


def test_alignment_of_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect() if len(r.text or "") < 3000]
    mine = alignment.align(docs.filter("length(text) < 3000 or text is null"), path_a=A, path_b=B).select(NAMES).collect()
    assert key(mine) == key(brute(rows)) and len(rows) > 100
    assert QUERIES["op11_tokenizer_alignment"](spark, SF).count() == docs.count()


def test_alignment_of_nothing(spark):
    for most in (alignment.PAIRS, 0):
        assert alignment.align(documents(spark, []), path_a=A, path_b=B, most_pairs=most).count() == 0
        only = alignment.align(documents(spark, [(1, None), (2, "")]), path_a=A, path_b=B, most_pairs=most).select(NAMES).collect()
        assert key(only) == [(1, 0, 0, 0, 0, "", 0, 0), (2, 0, 0, 0, 0, "", 0, 0)]


# Clustering


def plain_clusters(rows, k, rounds, seed, scale):
    """Python whole numbers, every distance."""
    v = [(i, [int(np.floor(float(x) * scale)) for x in e]) for i, e in rows]
    order = sorted(range(len(v)), key=lambda j: (v[j][0] is None, hashlib.sha256(f"{seed}:{v[j][0]}".encode()).hexdigest() if v[j][0] is not None else "", v[j][1]))
    cents = [v[j][1] for j in order[:k]]
    far = lambda x, c: sum((p - q) ** 2 for p, q in zip(x, c))
    for t in range(rounds + 1):
        label = [min(range(len(cents)), key=lambda c: (far(x, cents[c]), c)) for _, x in v]
        if t < rounds:
            cents = [[sum(col) // len(own) for col in zip(*own)] if (own := [x for (_, x), n in zip(v, label) if n == c]) else cents[c] for c in range(len(cents))]
    d = [far(x, cents[n]) for (_, x), n in zip(v, label)]
    of = Counter()
    for n, y in zip(label, d):
        of[n] += y
    return [(i, n, y, of[n], sum(d), hashlib.sha256(",".join(map(str, cents[n])).encode()).hexdigest()) for (i, _), n, y in zip(v, label, d)]


def test_clusters_equal_the_plain_version(spark):
    rnd = random.Random(4)
    mid = [[rnd.uniform(-2, 2) for _ in range(6)] for _ in range(5)]
    rows = [(n, [m + rnd.gauss(0, 0.2) for m in mid[n % 5]]) for n in range(150)] + [(3, [0.5] * 6), (3, [0.5] * 6), (None, [0.25] * 6), (None, [-1.0] * 6)]
    odd = [(200, None), (201, [0.1] * 5), (202, [0.1, None] + [0.1] * 4), (203, [float("nan")] * 6), (204, [float("inf")] * 6), (205, [])]
    df = spark.createDataFrame([(i, e, 1, "x") for i, e in rows + odd], "vec_id long, embedding array<double>, cluster int, v string").repartition(3)
    for k, rounds in ((8, 10), (3, 2), (1, 1), (400, 2)):
        got = centroids.cluster(df, k=k, rounds=rounds, seed=3, dimensions=6, scale=1024)
        assert key(got.collect()) == key(plain_clusters(rows, k, rounds, 3, 1024))
    assert centroids.cluster(df.filter("vec_id = 201"), dimensions=6).count() == 0
    with pytest.raises(Exception, match="components too large"):
        centroids.cluster(spark.createDataFrame([(1, [1e300] * 6)], "vec_id long, embedding array<double>"), dimensions=6).collect()


def test_threshold_algorithm_is_exact_and_stops_early():
    rng = np.random.default_rng(5)
    cents = rng.integers(-900, 900, (60, 12))
    cents[9] = cents[4]
    near = cents[rng.integers(0, 60, 3000)] + rng.integers(-40, 40, (3000, 12))
    for v in (near, rng.integers(-900, 900, (500, 12)), cents, np.zeros((1, 12), np.int64)):
        label, far, scored = centroids.Lists(cents).nearest(v)
        every = ((v[:, None] - cents[None]) ** 2).sum(2)
        assert (label == every.argmin(1)).all() and (far == every.min(1)).all() and scored <= every.size
    assert centroids.Lists(cents).nearest(near)[2] < 0.7 * len(near) * 60


def test_clusters_equal_their_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    got = QUERIES["op12_centroid_clustering"](spark, SF)
    names = sorted(got.columns)
    assert key(got.select(names).collect()) == key(con.execute(f"SELECT {', '.join(names)} FROM ({ORACLE_SQL['op12_centroid_clustering']})").fetchall())


# Packing


def check_packing(got, rows, window):
    """Ids by document, places by sequence; returns (padding, pieces)."""
    tok = Tokenizer.from_file(A)
    want = Counter()
    for i, text in rows:
        want[i, tuple(tok.encode(text or "", add_special_tokens=False).ids + [0])] += 1
    by_doc = {}
    for r in got:
        assert r.length > 0
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    for (i, n), mine in by_doc.items():
        docs = [ids for (d, ids), c in want.items() for _ in range(c) if d == i and len(ids) == n]
        assert sum(r.length for r in mine) == n * len(docs)
        if len(docs) == 1:
            at = 0
            for r in sorted(mine, key=lambda r: r.start):
                assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(docs[0][at : at + r.length], "<u4").tobytes())
                at += r.length
    assert {k for k in by_doc} == {(i, len(ids)) for i, ids in want}
    padding, by_seq = 0, {}
    for r in got:
        by_seq.setdefault(r.sequence_id, []).append(r)
    for mine in by_seq.values():
        at = 0
        for r in sorted(mine, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
        padding += window - at if at & (at - 1) else 0
    return padding, len(got)


def test_windows_are_full_and_hold_every_id(spark):
    rnd = random.Random(6)
    rows = [(n, " ".join(rnd.choice("the of and in a hous garden quickly".split()) for _ in range(rnd.choice((3, 40, 200, rnd.randint(0, 900)))))) for n in range(400)]
    rows += [(1000, None), (1001, ""), (1001, ""), (1002, "word " * 9000), (None, "no id"), (1003, "<|endoftext|> tail"), (1004, "x " * 511), (1005, "x " * 511)]
    tok = Tokenizer.from_file(A)
    sizes = [len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows]
    for window in (1024, 64):
        got = windows.pack(documents(spark, rows).repartition(4), vocabulary=A, window=window).collect()
        padding, pieces = check_packing(got, rows, window)
        natural = sum(-(-n // window) for n in sizes)
        assert padding == 0 and pieces - natural <= len({r.sequence_id for r in got})
    assert windows.pack(documents(spark, []), vocabulary=A).count() == 0
    one = windows.pack(documents(spark, [(5, None)]), vocabulary=A).collect()
    assert [(r.doc_id, r.start, r.length, r.doc_tokens, r.offset) for r in one] == [(5, 0, 1, 1, 0)]


def test_packing_of_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert check_packing(QUERIES["op13_least_squares_packing"](spark, SF).collect(), rows, 1024)[0] == 0


def test_least_squares_find_a_known_mixture():
    """A histogram made of combinations alone is used up but for a little rest."""
    rng = np.random.default_rng(7)
    h = np.zeros(257, np.int64)
    for _ in range(60):
        a = int(rng.integers(1, 200))
        b = int(rng.integers(1, 256 - a)) if a < 255 else 1
        parts = [a, b, 256 - a - b] if 256 - a - b > 0 else [a, 256 - a]
        for p in parts:
            h[p] += 1000
    rows, rest = windows.plan({n: int(c) for n, c in enumerate(h) if c}, 256)
    total = int((h * np.arange(257)).sum())
    assert rest[-1] < 0.02 * total
    # Every rank of every length has one place, and places don't meet.
    combos = windows.combinations(h, 256)
    assert (combos.sum(1) == 256).all() and (h[combos[:, :2]] > 0).all()
    for n in np.flatnonzero(h).tolist():
        assert rows[rows[:, 0] == n][0, 1] == 0
