"""SimHash classes, components and passages."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from panelwright.llm import near_copies as N
from panelwright.llm import passages as P
from panelwright.llm import queries as Q
from panelwright.llm import simhash as H
from panelwright.llm.components import components

from .cases import empty_documents, odd_documents

SF = "/root/testdata/sf0.001"


def slow_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_classes(fps):
    """id -> smallest id reachable, all pairs compared."""
    ids, parent = sorted(fps), {i: i for i in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(ids, 2):
        if (fps[a] ^ fps[b]).bit_count() <= 2:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {i: find(i) for i in ids}


def slow_similar(docs):
    """id -> smallest id reachable over pairs of shingle similarity 0.8, all pairs compared."""
    sets = {i: N.shingles(t, 5) for i, t in docs.items()}
    parent = {i: i for i in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(docs), 2):
        if min(len(sets[a]), len(sets[b])) >= 0.8 * max(len(sets[a]), len(sets[b])) and N.jaccard(docs[a], docs[b], 5) >= 0.8:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {i: find(i) for i in docs}


def test_near_copies_around_an_original(spark):
    """Edited copies that are alike only through their original, which is neither first nor last by id."""
    r = random.Random(8)
    word = lambda: "".join(r.choices("abcdefghijklmnop", k=5))
    docs = {}
    for g in range(3):
        original = [word() for _ in range(r.choice([60, 150, 400]))]
        for i in range(40):
            edited = original.copy()
            for _ in range(max(1, len(original) // 50) if i != 20 else 0):
                edited[r.randrange(len(edited))] = word()
            docs[g * 100 + i] = " ".join(edited)
    docs |= {900 + i: " ".join(word() for _ in range(80)) for i in range(20)}
    docs |= {950: "", 951: None, 952: "A  b", 953: "a B\n", 954: "a b c"}
    got = {x["doc_id"]: x["component"] for x in N.similar_classes(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()}
    assert got == slow_similar({i: t or "" for i, t in docs.items()})
    assert N.similar_classes(empty_documents(spark)).count() == 0 and N.similar_classes(odd_documents(spark)).count() == 10


def test_fingerprint():
    for text in ("", " \n", "One", "one TWO", "a b c", "É é ß\x0b漢 字 x y z", "the cat sat on the mat the cat sat"):
        assert H.fingerprint(text) == slow_fingerprint(text)


def test_op4_against_all_pairs(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    fps = {i: slow_fingerprint(t) for i, t in docs.items()}
    want = slow_classes(fps)
    got = {r["doc_id"]: r for r in Q.op4_simhash(spark, SF).collect()}
    assert len(got) == len(docs)
    assert all(got[i]["fingerprint"] == format(f, "016x") and got[i]["component_id"] == want[i] for i, f in fps.items())


def test_links_in_crowded_and_plain_buckets(spark):
    """Chains and clouds of near fingerprints, with buckets far over the limit."""
    r, fps = random.Random(2), set()
    for _ in range(4):
        x = r.getrandbits(64)
        fps.add(x)
        for _ in range(60):
            y = x
            for _ in range(r.randint(1, 3)):
                y ^= 1 << r.randrange(64)
            fps.add(y)
        for _ in range(20):  # a chain
            x ^= 1 << r.randrange(64) | 1 << r.randrange(64)
            fps.add(x)
    fps |= {r.getrandbits(64) for _ in range(100)}
    by_id = dict(enumerate(sorted(fps)))
    want = slow_classes(by_id)
    frame = spark.createDataFrame([(i, int(np.uint64(f).astype(np.int64))) for i, f in by_id.items()], "node long, fp long")
    for parts, crowded in ((3, 1000), (3, 4), (4, 8), (2, 1)):
        got = {x["node"]: x["component"] for x in components(H.links(frame, parts=parts, crowded=crowded)).collect()}
        assert all(got.get(i, i) == c for i, c in want.items())


def test_threshold_allotment():
    costs = [[0, 5, 50, 500], [0, 1, 9, 90], [0, 100, 900, 9000]]
    best = min(itertools.product(range(4), repeat=3), key=lambda u: (sum(costs[i][k] for i, k in enumerate(u)) if sum(u) == 3 else 1e9))
    assert H.allot(costs, 3) == [k - 1 for k in best]
    groups = H.partition_bits(10, np.eye(64) * 5, 3)
    assert sorted(b for g in groups for b in g) == list(range(64)) and {len(g) for g in groups} == {21, 22}


def test_components(spark):
    r = random.Random(5)
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(r.randrange(200, 300), r.randrange(200, 300)) for _ in range(80)] + [(7, 7), (3, 2)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(i) for i in parent if any(i in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_documents(spark):
    got = H.near_duplicate_classes(odd_documents(spark))
    rows = {(r["doc_id"], r["component"]) for r in got.collect()}
    assert got.count() == 11 and {(1, 1), (2, 1), (3, 1), (5, 5), (6, 5), (7, 5)} <= rows
    assert H.near_duplicate_classes(empty_documents(spark)).count() == 0 and H.drop_near_duplicates(empty_documents(spark)).count() == 0
    kept = H.drop_near_duplicates(odd_documents(spark))
    assert kept.columns == odd_documents(spark).columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "4", "5", "8", "9", "None"]
    assert H.drop_near_duplicates(odd_documents(spark).where("doc_id = 6")).count() == 1
    assert P.repeated_passages(odd_documents(spark)).count() == 0 and P.repeated_passages(empty_documents(spark)).count() == 0


def slow_chain_score(matches, cost):
    best = 0.0
    score = {}
    for a, b in sorted(set(matches)):
        before = [score[x, y] - cost * (a - x + b - y) for x, y in score if x < a and y < b]
        score[a, b] = 1 + max([0.0, *before])
        best = max(best, score[a, b])
    return best


def test_chains_against_all_pairs():
    r = random.Random(1)
    for _ in range(60):
        matches = [(r.randrange(30), r.randrange(30)) for _ in range(r.randint(1, 25))]
        chains = P.chains(matches, 0.03)
        assert sorted(m for c in chains for m in c) == sorted(set(matches))
        assert all(x[0] < y[0] and x[1] < y[1] for c in chains for x, y in itertools.pairwise(c))
        first = chains[0]
        score = len(first) - 0.03 * (first[-1][0] - first[0][0] + first[-1][1] - first[0][1])
        assert abs(score - slow_chain_score(matches, 0.03)) < 1e-9


def test_copies_without_their_repeats(spark):
    """Documents of which one repeats a line and the other holds it once; their shingle sets are alike."""
    r = random.Random(8)
    text = lambda n: ["".join(r.choices("abcdefghijklmnop", k=6)) for _ in range(n)]
    docs = {}
    for i in range(12):
        body, line = text(120), text(10)
        docs[2 * i], docs[2 * i + 1] = " ".join(body + line * 20), " ".join(body + line)
    want = slow_similar(docs)
    assert all(want[2 * i + 1] == 2 * i for i in range(12))
    got = N.similar_classes(spark.createDataFrame(list(docs.items()), "doc_id long, text string"))
    assert {x["doc_id"]: x["component"] for x in got.collect()} == want


def test_planted_passages(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choices("abcdefghijklmnop", k=6))
    text = lambda n: [word() for _ in range(n)]
    passage, edited = text(60), text(80)
    changed = edited.copy()
    for k in (25, 55):
        changed[k] = word()
    del changed[40]
    short = text(40)
    docs = [(i, " ".join([*text(r.randint(0, 200)), *passage, *text(r.randint(0, 200))])) for i in range(20)]
    docs += [(100, " ".join([*text(50), *edited])), (101, " ".join([*changed, *text(90)])), (200, " ".join([*text(30), *short])), (201, " ".join([*short, *text(40)])), (300, " ".join(text(300)))]
    docs += [(400, " ".join(text(120)))] * 2 + [(401, "dup " * 90), (402, "dup " * 70 + "x")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    out = P.repeated_passages(frame).collect()
    linked = {frozenset((x["a"], x["b"])) for x in out}
    held = set().union(*linked)
    assert set(range(20)) <= held and not held & {200, 201, 300, 400}
    assert frozenset((100, 101)) in linked and frozenset((401, 402)) in linked
    words = {i: t.split() for i, t in docs}
    for x in out:
        a, b = words[x["a"]][x["a_start"] : x["a_end"]], words[x["b"]][x["b_start"] : x["b_end"]]
        if x["a"] < 20:
            assert a == b == passage
        assert min(len(a), len(b)) >= 50 and x["identity"] >= 0.8


def test_edited_passages(spark):
    """Passages with every 10th to 20th word replaced: brute force holds every pair of documents with one seed in common."""
    r = random.Random(6)
    word = lambda: "".join(r.choices("abcdefghijklmnop", k=6))
    text = lambda n: [word() for _ in range(n)]
    docs, want = [], set()
    for i in range(150):
        passage = text(r.randint(60, 120))
        changed = passage.copy()
        k = r.randint(5, 15)
        while k < len(changed):
            changed[k] = word()
            k += r.randint(10, 20)
        for j, body in enumerate((passage, changed)):
            docs.append((2 * i + j, " ".join([*text(r.randint(20, 100)), *body, *text(r.randint(20, 100))])))
        want.add((2 * i, 2 * i + 1))
    seeds = {i: set(P.seeds_of(P.words(t), P.K, P.WINDOW)[0].tolist()) for i, t in docs}
    met = {(a, a + 1) for a, _ in want if seeds[a] & seeds[a + 1]}
    out = P.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    got = {(x["a"], x["b"]) for x in out}
    assert got <= want and len(met) >= 0.95 * len(want) and len(got & met) >= 0.95 * len(want)
    assert all(x["identity"] >= 0.8 and x["a_end"] - x["a_start"] >= 50 for x in out)


def test_gaps_of_any_length_are_aligned():
    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            diagonal = 0
            for j, y in enumerate(b, 1):
                diagonal, row[j] = row[j], diagonal + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    r = random.Random(9)
    for _ in range(150):
        a, b = ([r.randrange(12) for _ in range(r.randint(0, 130))] for _ in range(2))
        assert P._gap(a, b) == slow(a, b)
    a = [f"w{i}" for i in range(200)]
    b = [f"x{i}" if 40 < i < 160 and i % 6 == 0 else w for i, w in enumerate(a)]  # seeded at both ends only
    runs = P.equal_runs(a, b, [(0, 0), (20, 20), (165, 165), (190, 190)], 8)
    assert P.split_passages(a, b, runs, 50, 0.8) == [(0, 200, 0, 200, 200 - sum(x != y for x, y in zip(a, b, strict=True)))]


def test_exact_runs_in_the_tables_are_found(spark):
    """Documents that share 50 words running, by an index of every 50 words."""
    docs = {r["doc_id"]: P.words(r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    index = {}
    for i, w in docs.items():
        for k in range(len(w) - 49):
            index.setdefault(tuple(w[k : k + 50]), set()).add(i)
    want = set().union(*(v for v in index.values() if len(v) > 1))
    out = Q.op3_passages(spark, "/root/testdata/sf0.01").collect()
    got = {x["doc_id"] for x in out} | {x["other_doc_id"] for x in out}
    assert len(want - got) <= 0.01 * len(want)
    for x in out:
        a, b = docs[x["doc_id"]][x["a_start"] : x["a_end"]], docs[x["other_doc_id"]][x["b_start"] : x["b_end"]]
        assert min(len(a), len(b)) >= 50 and len(set(a) & set(b)) >= 0.6 * min(len(set(a)), len(set(b)))


def test_short_copies_compilations_and_common_lines(spark):
    """Copies of ten to thirty words, texts quoted whole by a longer one, and texts made of widely shared lines."""
    r = random.Random(15)
    text = lambda n: ["".join(r.choices("abcdefghijklmnop", k=6)) for _ in range(n)]
    docs = {}
    for g in range(40):
        body = text(r.randint(10, 80))
        docs[10 * g], docs[10 * g + 1], docs[10 * g + 2] = " ".join(body), " ".join([*body[:-1], *text(1)]), " ".join([*text(1), *body])
    quoted = [text(120) for _ in range(6)]
    for i, body in enumerate(quoted):
        for k in range(2):
            edited = body.copy()
            edited[r.randrange(len(edited))] = text(1)[0]
            docs[1000 + 10 * i + k] = " ".join(edited)
    docs |= {990 + k: " ".join(w for q in quoted for w in q) + f" end {k}" for k in range(2)}
    lines = [" ".join(text(14)) for _ in range(30)]
    for i in range(25):
        body = "\n".join(r.sample(lines, 12))
        docs[2000 + 2 * i], docs[2001 + 2 * i] = body, body + " " + text(1)[0]
    want = slow_similar(docs)
    got = {x["doc_id"]: x["component"] for x in N.similar_classes(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()}
    assert got == want and len(set(want.values())) < len(docs) - 100


def test_an_id_with_two_texts(spark):
    r = random.Random(16)
    text = lambda n: ["".join(r.choices("abcdefghijklmnop", k=6)) for _ in range(n)]
    one, two = text(100), text(100)
    docs = [(1, " ".join(one)), (1, " ".join(two)), (2, " ".join([*one, *text(1)])), (3, " ".join([*two, *text(1)])), (4, " ".join(text(100)))]
    got = sorted(map(tuple, N.similar_classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()))
    assert got == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4)]


def test_classes_of_spans(spark):
    """Three passages, each in several documents, two of them in one document; classes are those of the planted passages."""
    r = random.Random(17)
    text = lambda n: ["".join(r.choices("abcdefghijklmnop", k=6)) for _ in range(n)]
    passages, docs, planted = [text(80), text(100), text(60)], [], []
    for i in range(24):
        parts = [text(r.randint(30, 90))]
        for p in {i % 3, (i // 3) % 3}:
            planted.append((i, sum(map(len, parts)), p))
            parts += [passages[p], text(r.randint(60, 90))]
        docs.append((i, " ".join(w for part in parts for w in part)))
    out = P.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string"))
    spans = {(x["id"], x["start"]): x["class"] for x in P.passage_classes(out).collect()}
    named = {}
    for i, start, p in planted:
        near = {c for (d, s), c in spans.items() if d == i and abs(s - start) <= 2}
        assert len(near) == 1 and named.setdefault(p, near) == near
    assert len(set().union(*named.values())) == 3 and len(spans) >= len(planted)
    rows = P.with_classes(out).collect()
    assert len(rows) == out.count() and all(x["class"] == spans[x["a"], x["a_start"]] == spans[x["b"], x["b_start"]] for x in rows)
    for p, (c,) in named.items():  # a class's rows name all its documents, also those that no row joins directly
        assert {i for i, _, q in planted if q == p} <= {i for x in rows if x["class"] == c for i in (x["a"], x["b"])}


def test_many_partners_of_one_document(spark, monkeypatch):
    monkeypatch.setattr(P, "GROUP", 300)
    r = random.Random(18)
    text = lambda n: ["".join(r.choices("abcdefghijklmnop", k=6)) for _ in range(n)]
    passage = text(70)
    docs = [(i, " ".join([*text(20), *passage, *text(20)])) for i in range(30)]
    out = P.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    whole = [x for x in out if x["a_end"] - x["a_start"] >= 70]
    assert {x["a"] for x in whole} | {x["b"] for x in whole} == set(range(30)) and all(50 <= x["a_end"] - x["a_start"] <= 72 and x["identity"] >= 0.95 for x in out)


@pytest.mark.parametrize("length", [100, 300, 1000])
def test_versions_of_a_text(spark, length):
    """Chains and trees of edits, each of 1.5 % of the words of an earlier version: 98 % of the links of all pairs, at least."""
    r = random.Random(length)
    word = lambda: "".join(r.choices("abcdefghijklmnop", k=5))
    families = []
    for kind in ("chain", "tree") * 3:
        family = [[word() for _ in range(length)]]
        for _ in range(40):
            version = list(family[-1] if kind == "chain" else r.choice(family))
            for k in r.sample(range(length), max(1, round(0.015 * length))):
                version[k] = word()
            family.append(version)
        r.shuffle(family)
        families.append(family)
    docs = {41 * f + k: " ".join(v) for f, family in enumerate(families) for k, v in enumerate(family)}
    got = {x["doc_id"]: x["component"] for x in N.similar_classes(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()}
    sets = {i: N.shingles(t, 5) for i, t in docs.items()}
    links = [(i, j) for f in range(len(families)) for i in range(41 * f, 41 * f + 41) for j in range(41 * f, i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert len(links) > 200 and sum(got[i] == got[j] for i, j in links) >= 0.98 * len(links)
    want = slow_similar(docs)
    assert all(want[i] == want[c] for i, c in got.items())  # and no class joins what links don't


@pytest.mark.parametrize("block", [2048, 7])
def test_partners_beyond_the_nearest_rows(spark, monkeypatch, block):
    """Fingerprints that agree in one partition with all and in enough bytes with one that sorts far from them."""
    monkeypatch.setattr(N, "BLOCK", block)
    rng = np.random.default_rng(19)
    marks = rng.integers(0, 256, (60, N.BANDS * N.ROWS), dtype=np.uint8)
    marks[30:] = marks[:30]
    marks[:, : N.ROWS] = 1
    marks[:30, N.ROWS : 2 * N.ROWS], marks[30:, N.ROWS : 2 * N.ROWS] = 0, 255
    bands = [[7, *(int(x) for x in rng.integers(100, 1 << 60, N.BANDS - 1))] for _ in marks]
    rows = [(k, str(k), b, bytearray(m.tobytes())) for k, (b, m) in enumerate(zip(bands, marks, strict=True))]
    distinct = spark.createDataFrame(rows, "key long, node string, bands array<long>, wide binary")
    want = {(a, b): int((marks[a] == marks[b]).sum()) for a, b in itertools.combinations(range(60), 2)}
    want = {(*p, n) for p, n in want.items() if n >= N.LEAST}
    near = {tuple(r) for r in N._near_pairs(distinct).collect()}
    assert len(want) == 30 and want - near  # neighbours alone lose some
    classes = spark.createDataFrame([], "node string, component string")
    assert {tuple(r) for r in N._apart_pairs(distinct, classes).collect()} == want
    joined = spark.createDataFrame([(str(k), str(k % 30)) for k in range(20)] + [(str(k + 30), str(k)) for k in range(20)], "node string, component string")
    assert {tuple(r)[:2] for r in N._apart_pairs(distinct, joined).collect()} == {(k, k + 30) for k in range(20, 30)}


def test_passages_whose_parts_have_other_ends(spark):
    """Documents between others that hold every part of 35 words of their passage, but never 50 words of it."""
    r = random.Random(20)
    text = lambda n: ["".join(r.choices("abcdefghijklmnop", k=6)) for _ in range(n)]
    passages, docs = [text(63 + 3 * p) for p in range(8)], []
    for p, passage in enumerate(passages):
        docs += [(1000 + 10 * p + i, " ".join([*text(60), *passage, *text(60)])) for i in range(3)]
        for k in range(0, len(passage) - 34, 4):
            docs += [(first + 100 * p + k, " ".join([*text(60), *passage[k : k + 35], *text(60)])) for first in (0, 5000)]
    out = P.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {frozenset((x["a"], x["b"])) for x in out} >= {frozenset((1000 + 10 * p + i, 1000 + 10 * p + j)) for p in range(8) for i in range(3) for j in range(i)}
    assert all(1000 <= x["a"] < 2000 and x["b"] < 2000 for x in out)


def test_rows_that_meet_across_tasks():
    """Neighbours are found whatever the batches and tasks that the ordered rows are dealt to."""
    rng = np.random.default_rng(4)
    rows = sorted((int(b), bytes(m), int(k)) for b, m, k in zip(rng.integers(0, 5, 60), rng.integers(0, 2, (60, N.BANDS * N.ROWS), dtype=np.uint8), range(60), strict=True))
    batch = lambda part: pa.RecordBatch.from_pylist([dict(zip(("band", "turned", "key"), x, strict=True)) for x in part], pa.schema([("band", pa.int64()), ("turned", pa.binary()), ("key", pa.int64())]))

    def met(tasks):
        out = [r for task in tasks for b in N._meet([batch(p) for p in task]) for r in b.to_pylist()]
        pairs = {(r["a"], r["b"], r["equal"]) for r in out if r["a"] is not None}
        ends = sorted({(r["band"], r["turned"], r["key"]) for r in out if r["a"] is None})
        return pairs | {(r["a"], r["b"], r["equal"]) for b in N._meet([batch(ends)]) for r in b.to_pylist() if r["a"] is not None}

    whole = met([[rows]])
    assert whole == met([[rows[:7], [], rows[7:]]]) and len(whole) > 10
    assert whole <= met([[rows[:20]], [rows[20:22], rows[22:40]], [], [rows[40:]]])


def test_components_end_at_stars(spark, monkeypatch):
    """No round is spent on seeing that nothing changes: the edges are written once at first and once for the only round."""
    from panelwright.llm import components as module

    names, write = [], module.Written
    monkeypatch.setattr(module, "Written", lambda df, name: names.append(name) or write(df, name))
    edges = spark.createDataFrame([(1, 2), (1, 3), (5, 4), (4, 6), (7, 7)], "a long, b long")
    assert {x["node"]: x["component"] for x in components(edges).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4}
    assert len(names) == 2
    for rows, stars in (([], True), ([(2, 1), (3, 1)], True), ([(3, 1), (3, 2)], False), ([(3, 2), (2, 1)], False)):
        assert module._stars(spark.createDataFrame(rows, "u long, v long")) is stars


@pytest.mark.parametrize("block", [2048, 20])
def test_rest_of_a_crowded_key_is_linear(spark, monkeypatch, block):
    """Of two groups of 40 near copies each, in as many classes as texts, a task hands on fewer links than it has rows; the groups end whole."""
    monkeypatch.setattr(N, "BLOCK", block)
    r = random.Random(23)
    word = lambda: "".join(r.choices("abcdefghijklmnop", k=5))
    docs = []
    for g in range(2):
        body = [word() for _ in range(400)]
        for k in range(40):
            edited = list(body)
            edited[5 * k + 3] = word()
            docs.append((40 * g + k, " ".join(edited)))
    frame = spark.createDataFrame(docs, "id long, text string")
    distinct = spark.createDataFrame(
        [(k, i, n, [7, *(1000 + 100 * i + b for b in range(N.BANDS - 1))], bytearray(wide)) for i, t in docs for k, n, wide in [(N._key(t), *[N.sketch(t, 5)[c] for c in (2, 4)])]],
        "key long, node long, n long, bands array<long>, wide binary",
    )
    classes = spark.createDataFrame([], "node long, component long")
    node = {x["key"]: x["node"] for x in distinct.collect()}
    every, few = ([(node[x["a"]], node[x["b"]]) for x in pairs.collect()] for pairs in (N._apart_pairs(distinct, classes), N._apart_pairs(distinct, classes, frame)))
    tasks = 1 if block == 2048 else 10
    assert len(every) >= 1000 and set(few) <= set(every) and 78 <= len(few) <= 80 * tasks and all(a // 40 == b // 40 for a, b in few)
    ends = components(spark.createDataFrame(few, "a long, b long")).collect()
    assert {x["node"]: x["component"] for x in ends} == {i: i // 40 * 40 for i in range(80)}


def test_stages_of_near_copies(spark):
    """Each stage leaves files of its tasks on disk, whatever the rows: versions of three texts end whole in 137 stages (157 before)."""
    r = random.Random(29)
    word = lambda: "".join(r.choices("abcdefghijklmnop", k=5))
    docs = []
    for f in range(3):
        version = [word() for _ in range(300)]
        for k in range(25):
            version[(11 * k) % 300] = word()
            docs.append((100 * f + k, " ".join(version)))
    spark.sparkContext.setJobGroup("near copies", "stages of near copies")
    try:
        got = {x["doc_id"]: x["component"] for x in N.similar_classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == {i: i // 100 * 100 for i, _ in docs}
    tracker = spark.sparkContext.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup("near copies") for s in tracker.getJobInfo(j).stageIds}
    ran = [s for s in stages if (info := tracker.getStageInfo(s)) and info.numCompletedTasks]
    assert 20 < len(ran) < 147, len(ran)


def test_differences_are_tried_in_one_fixed_order():
    """The order is made once, nearest to equal lengths first, and alignment of words beyond ASCII works on their bytes."""
    assert P._skips(6, 4) is P._skips(6, 4) and P._skips(6, 4)[:5] == [(0, 1, 4), (1, 0, 4), (1, 1, 2), (0, 2, 4), (2, 0, 4)]
    a = "ä b ç d é f g h ï j k l".encode().split(b" ")
    b = [*a[:7], b"x", *a[8:]]
    assert P.equal_runs(a, b, [(0, 0)], 6) == [(0, 0, 7), (8, 8, 4)]
