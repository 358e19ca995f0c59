import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from toolcorpus.llm.decontaminate import decontaminate, edit_distance_within, find_contamination, plain
from toolcorpus.llm.simhash_dedup import covering_masks, simhash_components, simhash_dedup
from toolcorpus.llm.substring_dedup import substring_dedup


def words_of(t):
    return re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())


def plain_substring(rows, width):
    split = [(i, words_of(t)) for i, t in rows]
    seen = Counter(tuple(w[p:p + width]) for _, w in split for p in range(len(w) - width + 1))
    out = []
    for i, w in split:
        hit = {q for p in range(len(w) - width + 1) if seen[tuple(w[p:p + width])] > 1 for q in range(p, p + width)}
        out.append((i, len(w), len(hit), b" ".join(x for q, x in enumerate(w) if q not in hit).decode()))
    return sorted(out, key=str)


@pytest.mark.parametrize("width,vocabulary", [(35, 400), (5, 30), (3, 3), (2, 2), (1, 50)])
def test_substring_dedup_matches_plain_version(docs, width, vocabulary):
    rng = random.Random(width)
    draw = lambda n: [f"w{rng.randrange(vocabulary)}" for _ in range(n)]
    shared = [draw(rng.randrange(width, 3 * width)) for _ in range(4)]
    texts = [" ".join(draw(rng.randrange(40)) + rng.choice(shared) + draw(rng.randrange(40))) for _ in range(30)]
    texts += [None, "", " \n\t", texts[0], texts[0] + " tail", "a " * (4 * width), "\x0b".join(shared[0]), "é b " * 50, "w1"]
    rows = list(enumerate(texts)) + [(5, texts[5]), (None, texts[6]), (None, "one more")]
    got = substring_dedup(docs(rows), width=width)
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in got.collect()), key=str) == plain_substring(rows, width)


def test_substring_spans_are_maximal_and_empty_tables_give_nothing(docs):
    long = " ".join(f"x{i}" for i in range(60))
    got = {r["doc_id"]: r for r in substring_dedup(docs([(1, "a " + long), (2, long + " b c"), (3, "d")])).collect()}
    assert [tuple(s) for s in got[1]["spans"]] == [(1, 61)] and [tuple(s) for s in got[2]["spans"]] == [(0, 60)]
    assert got[3]["spans"] == [] and got[1]["kept_text"] == "a"
    assert substring_dedup(docs([]).limit(0)).count() == 0


def test_covering_masks_cover_every_pair_within_the_radius():
    masks = covering_masks(2)
    assert len(masks) == 7
    for flips in itertools.chain(itertools.combinations(range(64), 1), itertools.combinations(range(64), 2)):
        diff = sum(1 << f for f in flips)
        assert any(not m & diff for m in masks)


def plain_simhash(t):
    w = words_of((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    shingles = [b" ".join(w[k:k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    hs = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(rows):
    prints = {k: plain_simhash(t) for k, (_, t) in enumerate(rows)}
    root = {k: k for k in prints}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in itertools.combinations(prints, 2):
        if (prints[a] ^ prints[b]).bit_count() <= 2:
            root[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(rows):
        low.setdefault(find(k), []).append(i)
    least = {r: min((i for i in ids if i is not None), default=None) for r, ids in low.items()}
    return sorted(((i, f"{prints[k]:016x}", least[find(k)]) for k, (i, _) in enumerate(rows)), key=str)


def near_texts():
    rng = random.Random(3)
    base = [[f"v{rng.randrange(500)}" for _ in range(300)] for _ in range(5)]
    texts = [" ".join(b) for b in base]
    for b in base:
        for _ in range(25):
            c = list(b)
            c[rng.randrange(len(c))] = "changed"
            texts.append(" ".join(c))
    return texts + ["", None, "One", "one", "one two", "a b c", "A  B\nc", "  ", texts[0].upper(), texts[1]]


def test_simhash_components_match_plain_version(docs):
    rows = [(100 - k, t) for k, t in enumerate(near_texts())] + [(None, near_texts()[0]), (None, "alone here"), (7, "twice"), (7, "twice")]
    got = simhash_components(docs(rows))
    assert sorted((tuple(r) for r in got.select("doc_id", "fingerprint", "component_id").collect()), key=str) == plain_components(rows)


def test_simhash_dedup_keeps_one_row_of_each_component(docs):
    rows = list(enumerate(near_texts())) + [(0, near_texts()[0]), (None, "no one else"), (None, "no one else")]
    df = docs(rows)
    got = simhash_dedup(df)
    want = {c for _, _, c in plain_components(rows)}
    assert got.columns == df.columns
    assert sorted((r["doc_id"] for r in got.collect()), key=str) == sorted(want, key=str)
    assert simhash_dedup(df.limit(0)).count() == 0


def test_large_group_of_near_copies_is_linked_without_pairs(frame):
    """A path of fingerprints one bit apart, all in shared buckets."""
    from toolcorpus.llm.common import connected_components
    from toolcorpus.llm.simhash_dedup import near_links

    rng = np.random.default_rng(1)
    nodes, x = [], int(rng.integers(1 << 62))
    for _ in range(400):
        nodes.append(x - (1 << 64) if x >> 63 else x)
        x ^= 1 << int(rng.integers(64))
    nodes = sorted(set(nodes)) + [int(v) for v in rng.integers(-(1 << 62), 1 << 62, 200)]
    links = near_links(frame([(n,) for n in nodes], "fp long"))
    assert links.count() < 70 * len(nodes)
    got = {}
    for r in connected_components(links).distinct().collect():
        got.setdefault(r["root"], set()).add(r["node"])
    bits = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count()
    want, left = [], set(nodes)
    while left:
        group, todo = set(), [left.pop()]
        while todo:
            a = todo.pop()
            group.add(a)
            near = {b for b in left if bits(a, b) <= 2}
            left -= near
            todo += near
        want.append(group)
    assert sorted(map(sorted, got.values())) == sorted(sorted(g) for g in want if len(g) > 1)


def plain_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item):
        new = [i + 1]
        for j, x in enumerate(text):
            new.append(min(row[j] + (w != x), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_edit_distance_matches_plain_version():
    rng = random.Random(5)
    for _ in range(300):
        item = [rng.randrange(4) for _ in range(rng.randrange(1, 12))]
        text = [rng.randrange(4) for _ in range(rng.randrange(0, 25))]
        want = plain_distance(item, text)
        got = edit_distance_within(np.array(item, np.uint64), np.array(text, np.uint64), 3)
        assert (got[0] if got else None) == (want if want <= 3 else None)


def leaky(rng, item, edits):
    out = list(item)
    for _ in range(edits):
        at = rng.randrange(len(out))
        kind = rng.randrange(3)
        if kind == 0:
            out[at] = "changed"
        elif kind == 1:
            del out[at]
        else:
            out.insert(at, "added")
    return out


def test_contamination_recall_against_brute_force(docs, frame):
    rng = random.Random(9)
    word = lambda: f"v{rng.randrange(3000)}"
    items = [[word() for _ in range(n)] for n in (1, 2, 5, 14, 20, 33, 59)]
    items = items[2:] + [[word() for _ in range(rng.randrange(14, 60))] for _ in range(20)]
    texts = []
    for k in range(400):
        body = [word() for _ in range(rng.randrange(5, 120))]
        if k % 2:
            item = rng.choice(items)
            body[rng.randrange(len(body)):0] = leaky(rng, item, rng.randrange(0, int(len(item) * 0.2) + 2))
        texts.append(" ".join(body))
    rows = list(enumerate(texts)) + [(1000, None), (1001, ""), (1002, " ".join(items[3]).upper() + "!!"), (1002, " ".join(items[3]).upper() + "!!")]
    bench = frame([(k, " ".join(w)) for k, w in enumerate(items)] + [(98, None), (99, " ?! ")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in find_contamination(docs(rows), bench).collect()}
    want = {}
    for i, t in rows:
        w = [x for x in map(plain, (t or "").split()) if x]
        for k, item in enumerate(items):
            d = plain_distance(item, w)
            if d <= math.floor(len(item) * 0.2):
                want[i, k] = d
    assert set(got) <= set(want) and len(set(got)) >= 0.99 * len(want)
    assert all(got[p] == want[p] for p in got) and all(p in got for p, d in want.items() if d == 0)
    clean = decontaminate(docs(rows), bench)
    assert clean.columns == docs(rows).columns
    assert {r["doc_id"] for r in clean.collect()} == {i for i, _ in rows} - {i for i, _ in got}
    blocks = find_contamination(docs(rows), bench, block_bytes=500)
    assert {(r["doc_id"], r["item_id"]): r["distance"] for r in blocks.collect()} == got


@pytest.mark.parametrize("length", [5, 15, 59, 100, 300])
def test_contamination_recall_at_exactly_the_limit(docs, frame, length):
    rng = random.Random(length)
    edits, items, texts = math.floor(length * 0.2), [], []
    for k in range(100):
        item = [f"w{k}x{j}" for j in range(length)]
        items.append((k, " ".join(item)))
        out = list(item)
        # Spread over the item, or one after another somewhere in it.
        at = rng.sample(range(length), edits) if k % 4 else range((first := rng.randrange(length - edits + 1)), first + edits)
        for p in sorted(at, reverse=True):
            kind = rng.randrange(3)
            out[p:p + 1] = ([f"c{k}x{p}"], [], [f"a{k}x{p}", item[p]])[kind]
        texts.append(" ".join([f"f{k}x{j}" for j in range(40)] + out + [f"e{k}x{j}" for j in range(40)]))
    bench = frame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in find_contamination(docs(list(enumerate(texts))), bench).collect()}
    assert got == {(k, k) for k in range(100)}


def test_contamination_with_empty_tables(docs, frame):
    bench = frame([(1, "a b c d e")], "item_id long, text string")
    assert find_contamination(docs([]).limit(0), bench).count() == 0
    assert find_contamination(docs([(1, "a b c d e")]), bench.limit(0)).count() == 0
    assert decontaminate(docs([(1, "a b c d e"), (None, None)]), bench).count() == 1
