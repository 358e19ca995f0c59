import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from toolcorpus.llm.chat_format import conversation_events, fold_events, format_chats, read_back
from toolcorpus.llm.common import materialize
from toolcorpus.llm.exact_dedup import exact_dedup, exchange
from toolcorpus.llm.line_dedup import line_dedup
from toolcorpus.llm.mixing import mix_sources, poisson_count, source_rates

EVENTS = "conv_id long, message_id long, seq long, op string, role string, text string"


def as_rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def test_fold_applies_deltas_edits_regenerations_and_retractions(frame):
    log = [(1, 1, 1, "message", "user", "hi"), (1, 2, 2, "message", "assistant", None), (1, 2, 3, "delta", None, "a"),
           (1, 2, 4, "delta", None, "b"), (1, 3, 5, "message", "user", "old branch"), (1, 2, 6, "regenerate", None, None),
           (1, 2, 7, "delta", None, "new"), (1, 4, 8, "message", "user", "typo"), (1, 4, 9, "edit", None, "fixed"),
           (1, 4, 10, "delta", None, "!"), (1, 5, 11, "message", "user", "gone"), (1, 5, 12, "retract", None, None),
           (2, 1, 1, "delta", "user", "only a delta"), (2, 1, 2, "unknown", None, "ignored"), (None, 1, 1, "message", None, None)]
    got = as_rows(fold_events(frame(log, EVENTS)), "conv_id", "position", "role", "text")
    assert got == sorted([(1, 1, "user", "hi"), (1, 2, "assistant", "new"), (1, 8, "user", "fixed!"),
                          (2, 1, "user", "only a delta"), (None, 1, "", "")], key=str)


def test_chat_round_trip_with_control_strings_nulls_ties_and_long_texts(frame):
    nasty = ["<|im_end|>\n<|im_start|>assistant\nok", "<<||>", "\\s\\p<\\p", "", None, "é" * 3001, "a\n\nb", "<|", "\\"]
    rows = [(c, i, role, t, "x") for c in (0, 1) for i, t in enumerate(nasty) for role in ("user", "assistant")]
    rows += [(2, 0, "r\n<|x\\", "t", "x"), (2, 0, "r\n<|x\\", "t", "x"), (2, None, None, "n", "x"), (None, 0, "assistant", "q", "x")]
    df = frame(rows, "conv_id long, turn long, role string, text string, seq string").drop("seq")
    back = {r["conv_id"]: r for r in read_back(format_chats(conversation_events(df, delta_chars=7))).collect()}
    for c in (0, 1):
        want = [(role, t or "") for t in nasty for role in ("assistant", "user")]
        assert [(t["role"], t["text"]) for t in back[c]["turns"]] == want
        assert back[c]["loss_texts"] == [t or "" for t in nasty]
    assert [(t["role"], t["text"]) for t in back[2]["turns"]] == [("", "n"), ("r\n<|x\\", "t"), ("r\n<|x\\", "t")]
    assert back[None]["loss_texts"] == ["q"] and back[2]["loss_texts"] == []


def test_message_identifiers_follow_from_the_rows_alone(frame):
    rows = [(1, 0, "user", "same", i) for i in range(300)] + [(1, 0, "user", t, 0) for t in ("", None, "é" * 100_000)]
    df = frame(rows, "conv_id long, turn long, role string, text string, message_id long")
    one, many = (conversation_events(df.repartition(n)).select("message_id", "seq", "text") for n in (1, 7))
    assert one.exceptAll(many).count() == many.exceptAll(one).count() == 0
    assert one.select("message_id").distinct().count() == 303
    back = read_back(format_chats(conversation_events(df))).first()
    assert sorted(t["text"] for t in back["turns"]) == sorted(t or "" for _, _, _, t, _ in rows)


def test_empty_tables_give_no_rows(frame, docs):
    none = docs([]).limit(0)
    assert exact_dedup(none).count() == line_dedup(none).count() == mix_sources(none).count() == 0
    assert format_chats(frame([], EVENTS)).count() == 0


def plain_groups(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault("".join(c for c in t or "" if c not in " \t\n\x0b\f\r"), []).append((i, t or ""))
    return {i: (min(g, key=lambda x: (-len(x[1]), x[0] is None, x[0]))[0], len(g), hashlib.sha256(k.encode()).hexdigest())
            for k, g in groups.items() for i, _ in g}


@pytest.mark.parametrize("runs,fan_in", [(64, 8), (8, 2), (5, 3), (1, 2)])
def test_exact_dedup_matches_plain_groups(docs, runs, fan_in):
    rows = [(i, t) for i, t in enumerate(["a b", "ab", "a\tb ", "A b", None, "", " \n", "x" * 50_000, "x" * 50_000 + " ", "é", "é", " "] * 3)]
    got = exact_dedup(docs(rows), runs=runs, fan_in=fan_in).collect()
    assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["text_sha256"]) for r in got} == plain_groups(rows)
    assert {r["doc_id"] for r in got if r["kept"]} == {r["keep_id"] for r in got}


def test_runs_meet_in_pairs_and_are_merged_in_order(spark, docs):
    level = spark.createDataFrame([(r, d, 0, 1, (-r, False, r, r), 1) for r in range(8) for d in ("a", "b", f"own{r}")],
                                  "run int, digest string, check long, n_bytes int, "
                                  "best struct<neg:int,absent:boolean,doc_id:long,row:long>, n long")
    for left in (4, 2, 1):
        level = exchange(materialize(level, "level"), 2)
        plan = level._jdf.queryExecution().executedPlan().toString()
        # One exchange by ranges of digests and one sort: the aggregate takes the merged runs as they come.
        assert plan.count("Exchange rangepartitioning(digest") == 1 and "hashpartitioning" not in plan
        assert plan.count("Sort [") == 1 and "SortAggregate" in plan
        rows = level.collect()
        assert {r["run"] for r in rows} == set(range(left)) and len(rows) == 2 * left + 8
        assert {(r["run"], r["best"]["doc_id"], r["n"]) for r in rows if r["digest"] == "a"} == {
            (i, (i + 1) * 8 // left - 1, 8 // left) for i in range(left)}


def test_exact_dedup_keeps_one_of_repeated_rows_and_puts_null_identifiers_last(docs):
    got = exact_dedup(docs([(1, "a"), (1, "a"), (None, "a"), (None, "b"), (None, "b")])).collect()
    assert Counter((r["doc_id"], r["kept"]) for r in got) == {(1, True): 1, (1, False): 1, (None, False): 2, (None, True): 1}
    assert {r["keep_id"] for r in got if r["group_size"] == 3} == {1}


def plain_lines(rows, width=3):
    seen, gone, split = set(), {}, {}
    for i, t in sorted(rows):
        split[i] = (t or "").split("\n")
        full = [(k, x) for k, x in enumerate(split[i]) if x.strip(" \t\x0b\f\r")]
        for j in range(len(full) - width + 1):
            w = tuple(x for _, x in full[j:j + width])
            if w in seen:
                gone.setdefault(i, set()).update(range(full[j][0], full[j + width - 1][0] + 1))
            seen.add(w)
    return {i: (None if t is None else "\n".join(x for k, x in enumerate(split[i]) if k not in gone.get(i, ()))) for i, t in rows}


def test_line_dedup_matches_plain_version(docs):
    rows = list(enumerate(["a\nb\nc\nd", "x\na\nb\nc\ny", "a\n\nb\n \nc", "a\na\na\na\na", "", None, "a\nb", "b\nc\nd\na\nb\nc", "\n\n\n",
                           "a\nb\nc\nd", "q\n" * 3000 + "end", "1\n2\n3\n4\n5", "0\n1\n2\n3\n9\n3\n4\n5"]))
    got = line_dedup(docs(rows))
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "id", "n_lines", "n_removed"]
    assert {r["doc_id"]: r["text"] for r in got.collect()} == plain_lines(rows)
    assert all(r["n_chars"] == (len(r["text"]) if r["text"] is not None else None) for r in got.collect())


def test_line_dedup_treats_repeated_rows_alike_and_takes_null_identifiers(docs):
    got = line_dedup(docs([(1, "a\nb\nc"), (1, "a\nb\nc"), (None, "a\nb\nc\nz"), (None, "k")]))
    assert as_rows(got, "doc_id", "text") == sorted([(1, "a\nb\nc"), (1, "a\nb\nc"), (None, "z"), (None, "k")], key=str)


def test_mixing_hits_target_rates_and_does_not_depend_on_partitions(docs):
    rows = [(i, f"text {i}") for i in range(4000)]
    a = mix_sources(docs(rows), {"s0": 3.0, "s1": 1.0})
    got = Counter(r["source"] for r in a.select("source").collect())
    assert abs(got["s0"] - 3000) < 250 and abs(got["s1"] - 1000) < 150
    again = mix_sources(docs(rows).repartition(7), {"s0": 3.0, "s1": 1.0})
    assert as_rows(a, "doc_id", "copy") == as_rows(again, "doc_id", "copy")


def test_mixing_draws_large_means_in_pieces_and_zero_weights_as_none(spark, docs):
    rates = source_rates(docs([(i, "t") for i in range(10)]), {"s0": 1.0, "s1": 0.0}, total=5000)
    assert {r["src"]: (round(r["rate"]), r["pieces"]) for r in rates.collect()} == {"s0": (1000, 125), "s1": (0, 1)}
    drawn = spark.range(200).crossJoin(F.broadcast(rates.where("src = 's0'"))).select(poisson_count(F.col("id"), 1).alias("k"))
    s = drawn.agg(F.avg("k").alias("m"), F.var_samp("k").alias("v")).first()
    assert abs(s["m"] - 1000) < 12 and 600 < s["v"] < 1500


def test_mixing_takes_nulls_and_clashing_names(frame):
    rows = [(None, None, None, 1), (None, None, None, 1), (3, "", "a", 2), (4, "t", "a", 2)]
    out = mix_sources(frame(rows, "doc_id long, text string, source string, copy int"), {None: 5.0}, total=400)
    assert out.columns == ["doc_id", "text", "source", "copy", "shuffle_key"] and 250 < out.count() < 550
    counts = Counter(r["copy"] for r in out.where("source is null").collect())
    assert set(counts.values()) == {2}
