"""Conversation tries and vector codes against their SQL, brute force and odd rows."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import Row

from panelwright.llm import prefix_trie as P
from panelwright.llm import queries as Q
from panelwright.llm import vector_codes as V

from ..oracle import check

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op12_conversation_trie", "op13_vector_codes"])
def test_matches_sql(spark, name):
    check(spark, Q.QUERIES[name], Q.ORACLES[name], SF)


def slow_trie(rows):
    """Every prefix as a tuple of whole turns; sums over subtrees by comparing prefixes."""
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts, key=lambda t: (t[:2], hashlib.sha256(f"{len(t[2])}:{t[2]}{t[3]}".encode()).digest()))] for c, ts in convs.items()}
    paths = {}
    for c in own:
        h, base = zlib.crc32(str(c).encode()) % 6, c - (abs(c) % 100) * (1 if c > 0 else -1)
        paths[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    nodes = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            nodes.setdefault(path[:d], []).append(c)
    out = []
    for prefix, members in nodes.items():
        below = [q for q in nodes if q[: len(prefix)] == prefix]
        leaves = [q for q in below if not any(len(r) == len(q) + 1 and r[:-1] == q for r in nodes)]
        ends = sorted(c for c in members if paths[c] == prefix)
        out.append((
            min(members), len(prefix), min(nodes[prefix[:-1]]) if prefix else None, len(members), sum(len(q) == len(prefix) + 1 for q in below), len(leaves),
            sum((len(nodes[q]) - 1) * len(q[-1][1]) for q in below if q), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def turns(spark, rows):
    """With columns whose names the operator uses itself."""
    return spark.createDataFrame([(*r, 1, "k", 2) for r in rows], "conv_id long, turn long, role string, text string, base long, key string, family long")


def trie_rows(spark, rows):
    return sorted([tuple(r) for r in P.prefix_trie(turns(spark, rows)).collect()], key=str)


def test_trie_of_random_families(spark):
    rng = random.Random(3)
    rows = [
        (c, None if rng.random() < 0.1 else t, rng.choice(["user", "bot", "", None]), rng.choice(["a", "bb", "", None, "né\x00", "𝔘x"]))
        for c in rng.sample([*range(-250, -90, 7), *range(-90, 120, 5), *range(900, 1010), 10**15 + 5, 10**15], 120) for t in range(rng.choice([1, 1, 2, 3, 7]))
    ]
    assert trie_rows(spark, rows) == slow_trie(rows)


def test_trie_of_odd_rows(spark):
    rows = [(None, 1, "user", "lost")] * 2 + [(5, 1, None, None), (5, 1, None, None), (5, None, "user", "first"), (105, 2, "user", "x" * 300_000), (106, 0, "", "a"), (106, 0, "a", "")]
    rows += [(7, t, "user", "same") for t in (3, 1, 2)] + [(100, t, "bot", "deep") for t in range(600)]
    assert trie_rows(spark, rows) == slow_trie(rows)
    assert trie_rows(spark, []) == [] and trie_rows(spark, rows[:2]) == []


def test_a_prefix_that_most_families_share(spark):
    rows = [(c, t, "user", "hello" if t == 0 else f"{c % 7}") for c in range(0, 3000, 10) for t in range(2)]
    assert trie_rows(spark, rows) == slow_trie(rows)


def slow_codes(rows, parts, entries, rounds):
    """With Python integers, entry by entry."""
    kept = [(i, [int(np.floor(256 * np.float64(x))) for x in v], la) for i, v, la in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(kept[0][1]) // parts
    cut = [[v[p * w : (p + 1) * w] for p in range(parts)] for _, v, _ in kept]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, y, strict=True)), e) for e, y in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for c in cut:
                groups.setdefault(near(c[p], books[p])[1], []).append(c[p])
            for e, xs in groups.items():
                books[p][e] = [sum(col) // len(xs) for col in zip(*xs, strict=True)]
    out, by_label = [], {}
    for (i, _, la), c in zip(kept, cut, strict=True):
        found = [near(c[p], books[p]) for p in range(parts)]
        error = sum(d for d, _ in found)
        by_label[la] = by_label.get(la, 0) + error
        out.append((i, la, bytes(e for _, e in found), error if error < 1 << 63 else None))
    return sorted([(i, la, code, e, by_label[la] if by_label[la] < 1 << 63 else None) for i, la, code, e in out], key=str), books


SCHEMA = "vec_id long, embedding array<double>, label int, id long, vector int, part int, of string"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 0, 0, 0, "") for r in rows], SCHEMA)


def code_rows(spark, rows, **how):
    coded, books = V.vector_codes(vectors(spark, rows), **how)
    return sorted([(r["id"], r["label"], bytes(r["code"]) if r["code"] is not None else None, r["error"], r["label_error"]) for r in coded.collect()], key=str), books


@pytest.mark.parametrize("large", [1.0, 2.0**18, 2.0**22])  # with components beyond 2^25; with sums beyond a long, which are null
def test_codes_of_random_vectors(spark, large):
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in rng.normal(size=12).round(2) * large], int(la) if la else None) for i, la in zip(rng.permutation(90), rng.integers(0, 4, 90), strict=True)]
    rows += [(3, rows[0][1], 1), (200, [0.0] * 11 + [None], 1), (201, None, 2), (202, [float("nan")] * 12, 2), (203, [float("inf")] * 12, 2), (None, rows[1][1], None)]
    got, books = code_rows(spark, rows, parts=4, entries=8)
    want, values = slow_codes(rows, 4, 8, 2)
    assert got == want and books.values == values
    assert books.sha256() == hashlib.sha256(",".join(str(x) for part in values for e in part for x in e).encode()).hexdigest()


def test_codes_of_odd_tables(spark):
    assert code_rows(spark, []) == ([], None) and code_rows(spark, [(1, None, 1), (2, [None], 1)]) == ([], None)
    same = [(i, [0.5, -0.25, 1.0, 0.0], None) for i in (4, 4, 9)]
    got, _ = code_rows(spark, same, parts=2)
    assert got == [(i, None, bytes(2), 0, 0) for i in (4, 4, 9)]
    other = [(1, [1.0, 2.0], 1), (2, [1.0], 1), (3, [3.0, 5.0], 1)]
    got, books = code_rows(spark, other, parts=2, entries=1)
    assert [r[2] is None for r in got] == [False, True, False] and books.length == 2 and got[0][4] == got[0][3] + got[2][3]
    with pytest.raises(ValueError):
        code_rows(spark, [(1, [1.0, 2.0, 3.0], 1)], parts=2)
    huge = [(1, [1e30, 0.0], 7), (2, [-1e30, 0.0], 7), (3, [0.0, 0.0], 8)]
    got, _ = code_rows(spark, huge, parts=1, entries=1, rounds=1)
    assert [r[3:] for r in got] == [(None, None), (None, None), (0, 0)]
    assert code_rows(spark, [(1, [], 1), (2, [], None)])[0] == [(1, 1, bytes(16), 0, 0), (2, None, bytes(16), 0, 0)]


def test_codes_read_rows_of_spark(spark):
    df = spark.createDataFrame([Row(vec_id="b", embedding=[1, 2], label="x"), Row(vec_id="a", embedding=[5, 2], label=None)])
    coded, _ = V.vector_codes(df, parts=2)
    assert {(r["id"], r["label"], r["error"]) for r in coded.collect()} == {("a", None, 0), ("b", "x", 0)}
