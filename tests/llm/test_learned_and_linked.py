import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import SF_SMALL
from toolcorpus.llm import language_id as lang
from toolcorpus.llm.quality_ranking import DECAY, GRAM_BITS, describe, features, grams, pair_gradient, rank_quality, train, with_threshold
from toolcorpus.llm.queries import QUERIES
from toolcorpus.llm.url_filter import filter_urls, propagate, rounds_for

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def plain_url(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    path = tail[:min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    host = host.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    fits = [(len(r), r, v) for v, r in RULES
            if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


def test_url_parts_and_rules_match_plain_version(frame):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.ORG/es/1?x#y", "http://example.org", "http://example.org/en/12", "x://com/fr/",
            "http://notexample.org/es/", "http://a.com/de/?q", "http://É.com/fr/x", "a://b://c/d", "http://h?x/y", "http://h#f", "http://u:p@H.com:80/de/",
            "http://org/", "http://example.org/en/1"] * 2
    pages = frame([(i, u, None if i % 3 else '<a href="http://x.org/">', "h") for i, u in enumerate(urls)],
                  "page_id long, url string, html string, host string")
    got = {r["page_id"]: r for r in filter_urls(pages).collect()}
    for i, u in enumerate(urls):
        host, path, rule, verdict = plain_url(u)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule), u
        assert got[i]["verdict"] == verdict or verdict is None
    assert got[0]["verdict"] == "allow"
    assert filter_urls(pages.limit(0)).count() == 0


def plain_rank(links, seeds, hosts, damping=0.85):
    n = {h: k for k, h in enumerate(hosts)}
    m, s = np.zeros((len(n), len(n))), np.zeros(len(n))
    for a, b, w in links:
        m[n[b], n[a]] += w
    for h, w in seeds.items():
        s[n[h]] = w
    out = m.sum(0)
    x = s.copy()
    for _ in range(200):
        given = (m / np.where(out > 0, out, 1)) @ x
        x = (1 - damping) * s + damping * (given + x[out == 0].sum() * s / max(s.sum(), 1e-12))
    return dict(zip(hosts, x, strict=True))


def test_trust_and_distrust_match_power_iteration(frame):
    rng = random.Random(2)
    hosts = [f"h{i}" for i in range(12)]
    links = [(a, b, rng.randrange(1, 4)) for a, b in itertools.permutations(hosts, 2) if rng.random() < 0.15]
    good, bad = {"h0": 3.0, "h1": 1.0}, {"h5": 2.0, "h11": 2.0}
    seeds = frame([(h, good.get(h, 0.0), bad.get(h, 0.0)) for h in {**good, **bad}], "host string, good double, bad double")
    got = {r["host"]: r for r in propagate(frame(links, "src string, dst string, n long"), seeds, rounds=60, tolerance=1e-9).collect()}
    total = 8.0
    trust = plain_rank(links, {h: w / total for h, w in good.items()}, hosts)
    distrust = plain_rank([(b, a, w) for a, b, w in links], {h: w / total for h, w in bad.items()}, hosts)
    for h, r in got.items():
        assert r["trust"] == pytest.approx(trust[h], abs=1e-6) and r["distrust"] == pytest.approx(distrust[h], abs=1e-6)


def test_propagation_goes_on_to_the_tolerance_or_raises(spark):
    # A chain: distrust moves one link a round, so two rounds are too few.
    links = spark.createDataFrame([(f"h{i + 1}", f"h{i}", 1) for i in range(5)], "src string, dst string, n long").coalesce(1)
    seeds = spark.createDataFrame([("h0", 0.0, 1.0)], "host string, good double, bad double").coalesce(1)
    with pytest.raises(RuntimeError, match="settle"):
        propagate(links, seeds, rounds=2)
    assert 2 * 0.85 ** rounds_for(0.85, 1e-6) <= 1e-6 and 2 * 0.5 ** rounds_for(0.5, 1e-9) <= 1e-9


def test_hosts_near_blocked_ones_are_blocked(frame):
    page = lambda i, u, *to: (i, u, "".join(f"<a href='http://{t}/'>" for t in to))
    pages = [page(0, "http://bad.com/de/1"), page(1, "http://links-to-bad.net/x", "bad.com"), page(2, "http://good.org/"),
             page(3, "http://good.org/2", "friend.net"), page(4, "http://friend.net/y"), page(5, "http://alone.net/")]
    got = {r["host"]: r["verdict"] for r in filter_urls(frame(pages, "page_id long, url string, html string")).collect()}
    assert got == {"bad.com": "block", "links-to-bad.net": "block", "good.org": "allow", "friend.net": "allow", "alone.net": "allow"}


def test_forward_backward_matches_enumeration():
    rng = np.random.default_rng(4)
    sizes, labels = np.array([5, 3, 3, 1]), 3
    begins = np.cumsum(sizes) - sizes
    e, t, s = rng.normal(size=(int(sizes.sum()), labels)), rng.normal(size=(labels, labels)), rng.normal(size=labels)
    post, pairs, logz = lang.marginals(e, begins, sizes, t, s)
    want, want_pairs, total = np.zeros_like(e), np.zeros_like(t), 0.0
    for b, n in zip(begins, sizes, strict=True):
        paths = list(itertools.product(range(labels), repeat=int(n)))
        mass = np.exp([s[p[0]] + sum(e[b + i, y] for i, y in enumerate(p)) + sum(t[x, y] for x, y in itertools.pairwise(p)) for p in paths])
        total += np.log(mass.sum())
        for p, q in zip(paths, mass / mass.sum(), strict=True):
            for i, y in enumerate(p):
                want[b + i, y] += q
            for x, y in itertools.pairwise(p):
                want_pairs[x, y] += q
    assert np.allclose(post, want) and np.allclose(pairs, want_pairs) and logz == pytest.approx(total)


def test_word_features_hold_affixes_ngrams_and_the_word():
    ids, at = lang.features(["ab", "abc", "b"])
    parts = np.split(ids, at[1:])
    assert [len(p) for p in parts] == [4 + 3 + 2 + 1 + 1, 5 + 4 + 3 + 2 + 1, 3 + 2 + 1 + 1]
    again, first = lang.features(["abc"])
    assert set(again) == set(parts[1]) and list(first) == [0]


def test_language_id_held_out_accuracy_and_edge_texts(spark, frame):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text", "lang")
    odd = frame([(10_000, None, "en"), (10_001, "", "en"), (10_002, "12 !? 3", None), (10_003, "the of and " * 30_000, None), (None, "the", None)],
                "doc_id long, text string, lang string")
    rows = lang.language_id(docs.unionByName(odd)).collect()
    got = {r["doc_id"]: r for r in rows}
    known = {r["doc_id"]: r["lang"] for r in docs.collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items() if i is not None)
    held = [i for i in known if got[i]["held_out"]]
    assert sum(got[i]["lang_pred"] == known[i] for i in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert [got[i]["lang_pred"] for i in (10_000, 10_001, 10_002, 10_003)] == ["und", "und", "und", "en"]
    assert lang.language_id(docs.limit(0)).count() == 0
    assert {r["lang_pred"] for r in lang.language_id(odd.select("doc_id", "text", odd.lang.substr(9, 1).alias("lang")).where("lang is null")).collect()} == {"und"}


def test_even_mixtures_of_languages_are_accepted(spark, frame):
    model = lang.train([(k, " ".join(f"{c}{v}{c}" for c in part for v in "aeiou")) for k, part in
                        (("l1", "bcd"), ("l2", "fgh"), ("l3", "jkl"), ("l4", "mnp"))] * 20)
    text = " ".join(" ".join(f"{c}{v}{c}" for c in part for v in "aeiou") for part in ("bcd", "fgh", "jkl", "mnp"))
    rows = frame([(1, text), (2, None), (3, "12 !?")], "doc_id long, text string")
    best = {r["doc_id"]: r["score"] for r in lang.identify(rows, model, doc_id=F.col("doc_id")).collect()}
    assert best[1] < 0.3
    assert [r["doc_id"] for r in lang.accepted(rows, model).collect()] == [1]


def invented(rng, alphabet):
    """A language of its own: a lexicon of syllables over some letters."""
    syllables = ["".join(rng.choice(alphabet) + rng.choice("aeiou")) for _ in range(14)]
    lexicon = ["".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(120)]
    return lambda n: " ".join(rng.choice(lexicon) for _ in range(n))


@pytest.mark.parametrize("n_labels", [1, 2, 4, 8])
def test_stage_rejects_noise_and_unknown_letters_but_no_mixture(frame, n_labels):
    rng = random.Random(n_labels)
    said = [invented(rng, "".join(rng.sample("bcdfghjklmnpqrstvwxz", 5))) for _ in range(n_labels)]
    learned = [(i, said[i % n_labels](60), f"l{i % n_labels}") for i in range(40 * n_labels)]
    mixed = " ".join(s(12) for s in said)
    shuffled = " ".join("".join(rng.sample(w, len(w))) for w in said[0](200).split() if len(w) > 4)
    junk = [" ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(rng.randrange(4, 9))) for _ in range(40)), shuffled,
            "Это русский текст, его букв никто не учил", "这是中文文本 没有学过", "αυτό είναι ελληνικά", "12 ?!", "", None]
    good = [mixed, *(s(40) for s in said), *(s(400).upper() for s in said)]
    rows = frame([(i, t, None, "x") for i, t in enumerate(good + junk)], "doc_id long, text string, lang string, txt string")
    model = lang.fit(frame([(*r, "x") for r in learned], "doc_id long, text string, lang string, txt string"), key=F.col("doc_id"), other=True)
    kept = lang.accepted(rows, model)
    assert kept.columns == rows.columns and {r["doc_id"] for r in kept.collect()} == set(range(len(good)))
    assert lang.accepted(rows, lang.fit(rows, other=True)).count() == 0
    assert lang.accepted(rows.limit(0), model).count() == 0


def test_more_labels_than_are_learned_leave_the_rarest_out(frame, monkeypatch):
    monkeypatch.setattr(lang, "MAX_LANGUAGES", 2)
    rows = frame([(i, "ab cd ef", f"l{min(i % 5, 2)}") for i in range(30)] + [(99, "gh", "rare")], "doc_id long, text string, lang string")
    assert lang.fit(rows).labels == ["l0", "l2"]


def test_a_row_repeated_many_times_is_one_document_and_a_hub_is_split(spark, frame):
    from toolcorpus.llm.common import connected_components
    from toolcorpus.llm.line_dedup import line_dedup

    rows = frame([(7, "one line\nand two\nand three\nfour")] * 3000 + [(8, "x\none line\nand two\nand three")], "doc_id long, text string", 5)
    got = line_dedup(rows).groupBy("doc_id", "text", "n_removed").count().collect()
    assert sorted(map(tuple, got)) == [(7, "one line\nand two\nand three\nfour", 0, 3000), (8, "x", 3, 1)]
    star = spark.range(1, 5000).select(F.lit(0).cast("bigint").alias("u"), F.col("id").alias("v"))
    roots = connected_components(star).distinct()
    assert roots.count() == 5000 and {r["root"] for r in roots.select("root").distinct().collect()} == {0}


def test_code_switched_words_are_labelled_one_by_one(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    model = lang.fit(docs)
    decoder = lang.Decoder(model)
    mixed = " ".join(["the of and with that"] * 4 + ["der und die nicht für"] * 4)
    words = decoder.coded([mixed])[0]
    post, _, _ = lang.marginals(decoder.rows[words], np.array([0]), np.array([len(words)]), model.transitions, model.start)
    said = [model.labels[k] for k in post.argmax(1)]
    assert said[:18] == ["en"] * 18 and said[-18:] == ["de"] * 18


def test_quality_held_out_accuracy_and_edge_texts(spark, frame):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    odd = frame([(90_000, None), (90_001, ""), (90_002, "a " * 200_000), (None, "x")], "doc_id long, text string")
    rows = rank_quality(docs.select("doc_id", "text").unionByName(odd), labels).collect()
    got = {r["doc_id"]: r for r in rows}
    y = {r["doc_id"]: r["quality"] for r in labels.collect()}
    held = [i for i in y if i in got and got[i]["held_out"]]
    assert len(rows) == docs.count() + 4
    assert sum(got[i]["predicted"] == y[i] for i in held) >= 0.93 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    none = rank_quality(odd, labels.limit(0)).collect()
    assert {(r["score"], r["predicted"]) for r in none} == {(0.5, 1)}
    assert rank_quality(docs.limit(0), labels).count() == 0


def test_ranking_learns_an_order_from_pairs():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 4))
    y = x[:, 0] - 2 * np.abs(x[:, 1]) > -1.2
    model = train(x[y], x[~y], y.mean())
    assert ((model.score(x) >= 0.5) == y).mean() > 0.95
    assert len(describe(None)) == len(describe("a b\nc")) and np.isfinite(describe("")).all()


def test_pair_gradient_is_that_of_the_loss_over_all_differences():
    rng = np.random.default_rng(3)
    h, w, up, down = rng.normal(size=(40, 5)), rng.normal(size=5), rng.integers(40, size=300), rng.integers(40, size=300)
    loss = lambda v: np.mean(np.log1p(np.exp(-(h[up] - h[down]) @ v))) + DECAY / 2 * v @ v
    slope = [(loss(w + 1e-5 * e) - loss(w - 1e-5 * e)) / 2e-5 for e in np.eye(5)]
    assert np.allclose(pair_gradient(h, w, up, down), slope, atol=1e-8)


def plain_grams(text):
    raw, n = text.lower().encode(), 1 << GRAM_BITS
    put = lambda code: (code * 2654435761 & 0xFFFFFFFF) >> 32 - GRAM_BITS
    out = np.zeros(2 * n)
    for a, b, c in zip(raw, raw[1:], raw[2:]):
        out[put(a << 16 | b << 8 | c)] += 1
    ids = [zlib.crc32(w) for w in raw.split()]
    for code in ids + [(a * 40503 + b) & 0xFFFFFFFF for a, b in zip(ids, ids[1:])]:
        out[n + put(code)] += 1
    return np.sqrt(np.concatenate([part / max(1, part.sum()) for part in (out[:n], out[n:])]))


@pytest.mark.parametrize("text", ["", "a", "ab", "Abc abc\n  é", "word " * 9, "x y z " * 200_000])
def test_hashed_ngrams_match_plain_counts(text):
    assert np.allclose(grams(text), plain_grams(text)) and not grams(None).any()


def test_fluent_prose_of_other_words_is_told_apart_by_ngrams_and_the_threshold_is_over_all_labels(spark, frame):
    rng = np.random.default_rng(8)
    # Both kinds have words of equal lengths from the same letters: only n-grams differ.
    words = ["".join(rng.permutation(list("aeilnorst"))[:6]) for _ in range(400)]
    kinds = words[:200], words[200:]
    texts = [(i, " ".join(rng.choice(kinds[i % 2], 60)), i % 2) for i in range(900)]
    docs = frame([(i, t, t) for i, t, _ in texts], "doc_id long, text string, score string")
    labels = frame([(i, y, 0) for i, _, y in texts], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in rank_quality(docs, labels).collect()}
    held = [(i, y) for i, _, y in texts if got[i]["held_out"]]
    assert np.mean([got[i]["predicted"] == y for i, y in held]) >= 0.95
    x = np.array([features(t) for _, t, _ in texts])
    y = np.array([y for _, _, y in texts])
    model = train(x[y == 1][:50], x[y == 0][:50], 0.5, 2 << GRAM_BITS)
    strengths = frame([(i, float(v)) for (i, _, _), v in zip(texts, model.strength(x))], "doc_id long, s double")
    moved = with_threshold(model, strengths, labels, "doc_id", "quality")
    assert abs(moved.threshold - np.quantile(model.strength(x), 0.5, method="inverted_cdf")) < 1e-9


def test_pipeline_stages_keep_columns_and_follow_a_plain_version(spark):
    from .test_text_operators import plain_components

    from toolcorpus.llm.common import materialize

    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(materialize(stage(spark, seen[-1], SF_SMALL), f"test-{name}"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_dedup", "decontaminate", "mix_sources"]
    assert all(d.columns == docs.columns for d in seen[1:-1])
    ids = [{r["doc_id"] for r in d.select("doc_id").collect()} for d in seen]
    assert len(ids[1]) >= 0.98 * len(ids[0]) and ids[2] == ids[1]
    lined = [(r["doc_id"], r["text"]) for r in seen[2].collect()]
    assert ids[3] == {c for _, _, c in plain_components(lined)}
    items = [r["text"].split() for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    leaks = {r["doc_id"] for r in seen[3].collect() if any(" ".join(i) in " ".join((r["text"] or "").split()) for i in items)}
    assert not leaks & ids[4] and len(ids[4]) >= len(ids[3]) - 2 * len(leaks) - 5
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF_SMALL).collect()), key=str) == sorted(map(tuple, seen[-1].collect()), key=str)


def test_every_query_carries_its_contract_columns(spark):
    want = {"op1_": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars", "op2_": "doc_id n_words n_removed kept_sha256",
            "op3_": "page_id host path rule verdict", "op4_": "doc_id fingerprint component_id", "op7_": "doc_id held_out lang_pred score",
            "op9_": "doc_id held_out score predicted", "op10_": "doc_id keep_id group_size kept text_sha256"}
    for name, f in QUERIES.items():
        columns = f(spark, SF_SMALL).columns
        assert set(want.get(name.split("_")[0] + "_", "").split()) <= set(columns)
