import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from toolcorpus.llm.hard_negatives import first_of, grid, mine_hard_negatives, planes, scores, subset_sums, unpacked_planes
from toolcorpus.llm.sharding import balanced_shards, quotas
from toolcorpus.llm.spelling import count_words, near_words, neighbourhood, reduced_key, roots, runs, spelling_groups, symbols

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# -- spelling variants -----------------------------------------------------------

def plain_counts(rows, drop_every, least=5):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run if drop_every is None or h % drop_every else run[:h % len(run)] + run[h % len(run) + 1:]] += 1
    return {w: c for w, c in n.items() if len(w) >= 6 and c >= least}


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[k + 1:] == b[k + 1:] or a[k:] == b[k + 1:] or a[k + 1:] == b[k:]


def plain_groups(n):
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {w: (n[w], len(near[w]), form[w], None if form[w] is None else n[form[w]], root(w)) for w in n}


def spelled(rng, docs):
    base = ["".join(rng.choice("abcdeé×ÿ") for _ in range(rng.randrange(6, 10))) for _ in range(25)] + ["repeated" * 4]
    words = []
    for w in base:
        words += [w.upper() if rng.random() < 0.3 else w] * rng.choice([3, 8, 60])
        for _ in range(6):
            k = rng.randrange(len(w) + 1)
            words += [rng.choice([w[:k] + "b" + w[k:], w[:k] + w[k + 1:], w[:k] + "é" + w[k + 1:]])] * rng.choice([2, 6, 12])
    rng.shuffle(words)
    texts = [rng.choice([" ", "-", "1", "’", "ā"]).join(words[i::9]) for i in range(9)]
    return list(enumerate(texts)) + [(None, texts[0]), (3, texts[3]), (20, None), (21, ""), (22, " 12 \n"), (23, "É" * 9 + " ÉÉÉÉÉÉÉÉ")]


@pytest.mark.parametrize("seed,drop_every", [(1, 7), (2, 199), (3, None), (4, 2)])
def test_spelling_groups_match_plain_version(docs, seed, drop_every):
    rows = spelled(random.Random(seed), docs)
    want = plain_counts(rows, drop_every)
    counts = count_words(docs(rows), drop_every=drop_every)
    assert {r["word"]: r["n"] for r in counts.collect()} == want
    got = {r["word"]: tuple(r)[1:] for r in spelling_groups(counts).collect()}
    assert got == plain_groups(want)
    assert any(v[2] for v in got.values()) and any(v[1] > 1 for v in got.values())


@pytest.mark.parametrize("kinds", [1, 2, 8, 40])
def test_every_near_pair_is_found_with_any_alphabet(spark, kinds):
    rng = random.Random(kinds)
    n = {"".join(rng.choice("abß") for _ in range(rng.randrange(1, 6))): rng.randrange(1, 9) for _ in range(150)}
    got = {(r["word"], r["near"]) for r in near_words(spark.createDataFrame(sorted(n.items()), "word string, n long"), kinds).collect()}
    assert got == {(a, b) for a in n for b in n if one_edit(a, b)}


def test_neighbourhoods_hold_every_edit_of_a_reduced_word():
    points = np.array([[ord(c) for c in "spelling"]], np.uint32)
    s = symbols(points, 4)
    word = s[0].tolist()
    edits = [word] + [word[:i] + word[i + 1:] for i in range(8)] + [word[:i] + [x] + word[j:] for i in range(9) for x in range(1, 5) for j in {i, min(8, i + 1)}]
    want = {int(reduced_key(np.array([e], np.uint64))[0]) for e in edits}
    assert {int(x) for part in neighbourhood(s, 4) for x in part.ravel()} == want


def test_long_texts_are_split_without_cutting_words_and_roots_follow_long_ways(spark, docs):
    text = "Letters’" * 400_000 + "x" * 3_000_000
    assert Counter(run for piece in runs(text) for run in piece) == {b"letters": 400_000, b"x" * 3_000_000: 1}
    got = {r["word"]: r["n"] for r in count_words(docs([(1, text), (2, "letters")])).collect()}
    assert got == {"letters": 400_001}
    way = spark.createDataFrame([(f"w{i:02}", f"w{i + 1:02}") for i in range(37)] + [("a", "w36")], "word string, form string")
    assert {r["root"] for r in roots(way).collect()} == {"w37"}


def test_spelling_of_nothing(spark, docs):
    assert count_words(docs([]).limit(0)).count() == 0
    assert spelling_groups(spark.createDataFrame([], "word string, n long")).count() == 0
    got = spelling_groups(spark.createDataFrame([("abcdef", 3), ("abcdef", 4), (None, 9), ("abcdeg", None), ("", 2), ("a", 1)], "word string, n long"))
    assert sorted(map(tuple, got.collect())) == [("", 2, 1, None, None, ""), ("a", 1, 1, None, None, "a"), ("abcdef", 7, 0, None, None, "abcdef")]


# -- sharding ---------------------------------------------------------------------

def sharded(docs, rows, shards=8, **options):
    out = balanced_shards(docs(rows), shards, **options).collect()
    assert len(out) == len(rows)
    counts = Counter(r["shard"] for r in out)
    sizes = [counts[s] for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == len(rows)
    for s in range(shards):
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(counts[s]))
    want = Counter((i, len((t or "").encode()) + 1, None if t is None else zlib.crc32(t.encode())) for i, t in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == want
    assert {r["law"] for r in out} <= {"rows"} and {r["grown_shard"] for r in out} <= {None}
    parts = {}
    for r in out:
        parts.setdefault(r["text_crc32"], set()).add(r["shard"])
    return out, parts


def test_copies_share_a_shard_and_shards_stay_even(docs):
    rng = random.Random(5)
    texts = [f"alone {i}" for i in range(150)] + [f"copy {k}" for k in range(30) for _ in range(rng.randrange(2, 6))] + [None, None, "", ""]
    rng.shuffle(texts)
    _, parts = sharded(docs, list(enumerate(texts)))
    assert all(len(p) == 1 for p in parts.values())


def test_a_group_larger_than_its_shards_is_cut_into_few_parts(docs):
    rows = [(i % 40, "same") for i in range(100)] + [(i, f"alone {i}") for i in range(120)] + [(i, f"pair {i // 2}") for i in range(40)]
    _, parts = sharded(docs, rows, rounds=12)  # 260 rows, 32 or 33 a shard
    assert len(parts[zlib.crc32(b"same")]) <= 5
    cut = [p for c, p in parts.items() if c != zlib.crc32(b"same") and len(p) > 1]
    assert len(cut) <= 2


def test_linked_rows_only_few_rows_and_no_rows(docs):
    _, parts = sharded(docs, [(i, f"g{i % 4}") for i in range(64)], rounds=5)
    assert sum(len(p) for p in parts.values()) <= 20  # eight at best; there are no spare rows to change places with
    sharded(docs, [(None, "x" * 200_000), (None, None), (7, "x" * 200_000)])
    sharded(docs, [(1, "one")], shards=1)
    assert balanced_shards(docs([]).limit(0)).count() == 0


def test_rows_linked_by_another_column_share_a_shard(docs):
    rows = [(i, f"t{i}") for i in range(110)]
    links = [F.when(F.col("doc_id") < 60, F.floor(F.col("doc_id") / 3)).otherwise(F.col("doc_id") + 1000)]
    out, _ = sharded(docs, rows, 4, links=links, rounds=6)
    assert len({(r["doc_id"] // 3, r["shard"]) for r in out if r["doc_id"] < 60}) <= 22  # 20 groups of three


def test_shards_do_not_depend_on_partitions(frame):
    rows = [(i, f"copy {i % 17}" if i % 3 else f"alone {i}") for i in range(120)]
    one, many = (balanced_shards(frame(rows, "doc_id long, text string", parts)) for parts in (1, 7))
    assert sorted(map(str, one.collect())) == sorted(map(str, many.collect()))


def test_quotas_bound_what_comes_in_by_what_leaves_and_is_spare():
    rng = random.Random(9)
    for _ in range(300):
        k = rng.randrange(2, 7)
        wanted = [[0 if s == t or rng.random() < 0.4 else rng.randrange(10 ** rng.randrange(1, 12)) for t in range(k)] for s in range(k)]
        spare = [rng.choice([0, 3, 10 ** 12]) for _ in range(k)]
        take = quotas(wanted, spare)
        for t in range(k):
            assert sum(take[s][t] for s in range(k)) - sum(take[t]) <= spare[t]
            assert all(0 <= take[s][t] <= wanted[s][t] for s in range(k))
    assert quotas([[0, 5], [5, 0]], [0, 0]) == [[0, 5], [5, 0]]
    assert quotas([[0, 5], [2, 0]], [0, 0]) == [[0, 2], [2, 0]]
    assert quotas([[0, 5], [2, 0]], [0, 2]) == [[0, 4], [2, 0]]


# -- hard negatives ---------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, id string, score double"


def plain_negatives(rows, positives=5, negatives=10):
    seen, part = set(), []
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) or abs(x) >= 1 << 18 for x in v):
            continue
        ints = tuple(math.floor(256 * float(np.float32(x))) for x in v)
        while ints and not ints[-1]:
            ints = ints[:-1]
        if (i, label, ints) not in seen:
            seen.add((i, label, ints))
            part.append((i, label, ints))
    key = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = []
    for a in part:
        if a[0] is None or a[0] % 100:
            continue
        s = lambda c: sum(x * y for x, y in zip(a[2], c[2]))  # noqa: E731, B023
        best = sorted(((s(c), c[0]) for c in part if c is not a and c[1] == a[1]), key=key)[:positives]
        other = sorted(((s(c), c[0]) for c in part if c[1] != a[1]), key=key)
        for ps, pid in best:
            fit = [x for x in other if 30 * ps <= 100 * x[0] <= 90 * ps][:negatives]
            out += [(a[0], pid, r, nid, ps, ns) for r, (ns, nid) in enumerate(fit, 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("seed,dims,ties", [(1, 64, False), (2, 5, True), (3, 8, True), (4, 17, False)])
def test_hard_negatives_match_plain_version(frame, seed, dims, ties):
    rng = random.Random(seed)
    draw = lambda: [round(rng.uniform(-1, 3) / (64 if ties else 1), 2 if ties else 6) for _ in range(dims)]
    rows = [(i * rng.choice([1, 1, 10]), draw(), rng.randrange(3)) for i in range(260)]
    rows += [(100, draw(), 1), (100, draw(), 1), (200, rows[5][1], 2), rows[7], rows[7], (300, rows[7][1], rows[7][2])]
    rows += [(None, draw(), 0), (None, draw(), 1), (400, None, 1), (500, draw(), None), (600, [float("nan")] * dims, 0),
             (700, [None] + draw()[1:], 0), (800, [float("inf")] + draw()[1:], 0), (900, draw()[:3], 1), (1000, [], 2), (1100, [3e5] * dims, 1)]
    df = frame([(*r, "x", 1.5) for r in rows], VECTORS, 5)
    got = mine_hard_negatives(df, F.col("vec_id") % 100 == 0)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_negatives(rows)


def test_one_hot_vector_in_a_third_of_the_rows_and_large_identifiers(frame):
    rng = random.Random(8)
    far = 1 << 60
    hot = [0.5] * 16
    rows = [(far + i, hot if i % 3 == 0 else [rng.uniform(-1, 1) for _ in range(16)], i % 4) for i in range(600)] + [(None, hot, 2)]
    got = mine_hard_negatives(frame([(*r, "x", 1.5) for r in rows], VECTORS, 4), F.col("vec_id") % 100 == 0)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_negatives(rows)


def test_no_vectors_or_no_anchors_give_no_rows(frame):
    rows = [(1, [1.0, 2.0], 0, "x", 1.0), (2, [1.0, 2.0], 1, "x", 1.0)]
    assert mine_hard_negatives(frame(rows, VECTORS), F.col("vec_id") % 100 == 0).count() == 0
    assert mine_hard_negatives(frame([], VECTORS), F.col("vec_id") % 100 == 0).count() == 0
    assert mine_hard_negatives(frame([(100, None, 1, "x", 1.0)], VECTORS), F.col("vec_id") % 100 == 0).count() == 0


def test_tables_give_exact_inner_products():
    rng = np.random.default_rng(3)
    for width, kind in ((2, np.int32), (9, np.int32), (27, np.int64)):
        most = 1 << (width - 1)
        a, c = (rng.integers(-most, most, (n, 24)) for n in (7, 50))
        a[0], c[0], c[1] = -most, -most, most - 1
        assert (unpacked_planes(planes(c, width)) == c).all()
        assert (scores(subset_sums(a, kind), planes(c, width)) == c @ a.T).all()


def test_first_of_and_grid():
    s = np.array([3, 9, 9, 1, 9, 3])
    assert first_of(s, 2).tolist() == [1, 2] and first_of(s, 4).tolist() == [1, 2, 4, 0] and first_of(s, 9).tolist() == [1, 2, 4, 0, 5, 3]
    for n, a in ((0, 0), (10, 1), (51_282, 513), (10 ** 9, 10 ** 7)):
        columns, lines = grid(n, a, 24)
        assert n / columns <= 1 << 17 and a / lines <= 1 << 17 and (n / columns) * (a / lines) <= 1.1 * (1 << 26)
