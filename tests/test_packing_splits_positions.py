import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from toolcorpus.functions.permute import permuted
from toolcorpus.functions.tokens import Tokenizer, ends_of, first_tokens, token_count
from toolcorpus.operators import parse as B
from toolcorpus.operators import prompts as PR
from toolcorpus.operators import scoring as S
from toolcorpus.sources import positions as POS
from toolcorpus.sources.incremental import Refreshed, read_refreshed, refresh_corpus
from toolcorpus.streaming.metrics_store import store_batch, stored_metrics

TOKENIZERS = "/opt/tokenizers"


@pytest.mark.parametrize("n", [1, 2, 3, 5, 10, 97, 1000])
def test_permutation_is_one_to_one_and_depends_on_the_seed(spark, n):
    got = [[r[0] for r in spark.range(n).select(permuted(F.col("id"), n, seed)).collect()] for seed in (1, 2)]
    assert sorted(got[0]) == sorted(got[1]) == list(range(n))
    assert n < 10 or got[0] != got[1] and got[0] != list(range(n))


@pytest.mark.parametrize("n,ratio", [(0, 0.5), (1, 0.05), (7, 0.05), (20, 0.05), (333, 0.1), (1000, 0.05), (1000, 0.0), (40, 1.0)])
def test_exact_split_has_exactly_the_share_whatever_the_partitions(spark, n, ratio):
    df = spark.range(n).select((F.col("id") * 7 + 1).alias("example_id"), F.lit("x").alias("text"))
    chosen = []
    for parts in (1, 6):
        rows = B.split_corpus(df.repartition(parts), ratio, 5, "exact").collect()
        assert len(rows) == n
        chosen.append({r["example_id"] for r in rows if r["split"] == "validation"})
    assert chosen[0] == chosen[1] and len(chosen[0]) == math.ceil(n * ratio)


def test_exact_split_of_equal_and_null_keys(spark):
    df = spark.createDataFrame([(1,)] * 30 + [(None,)] * 30, "example_id long").repartition(4)
    assert B.split_corpus(df, 0.1, 1, "exact").where("split = 'validation'").count() == 6


def plain_bins(sizes, capacity):
    """Fewest bins, by trying all ways of a few rows."""
    best = len(sizes)

    def go(rest, bins):
        nonlocal best
        if len(bins) >= best and rest:
            return
        if not rest:
            best = min(best, len(bins))
            return
        for k in range(len(bins)):
            if bins[k] + rest[0] <= capacity:
                go(rest[1:], bins[:k] + [bins[k] + rest[0]] + bins[k + 1:])
        go(rest[1:], [*bins, rest[0]])

    go(sorted(sizes, reverse=True), [])
    return best


def test_packing_plan_places_every_row_whole_in_few_bins():
    rng = random.Random(3)
    for case in range(300):
        capacity = rng.choice([10, 20, 64])
        sizes = [rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 9 if case % 2 else 400))]
        counts = {s: sizes.count(s) for s in set(sizes)}
        bins, seen = {}, {s: [] for s in counts}
        for length, a, b, first, per, at in PR.packing_plan(counts, capacity):
            seen[length] += range(a, b)
            for i in range(b - a):
                start = at + i % per * length
                bins.setdefault(first + i // per, []).append((start, start + length))
        assert all(sorted(seen[s]) == list(range(n)) for s, n in counts.items())
        for spans in bins.values():
            spans.sort()
            assert spans[0][0] >= 0 and spans[-1][1] <= capacity and all(x[1] <= y[0] for x, y in itertools.pairwise(spans))
        assert sorted(bins) == list(range(len(bins)))
        fewest = plain_bins(sizes, capacity) if len(sizes) < 9 else -(-sum(sizes) // capacity)
        if len(sizes) < 9:
            assert len(bins) <= 11 / 9 * fewest + 1


def texts_of(spark, sizes, parts):
    rows = [(i, None if n is None else " ".join(["w"] * n)) for i, n in enumerate(sizes)]
    return spark.createDataFrame(rows, "example_id long, text string").repartition(parts)


def test_packing_is_the_same_for_any_partitions_and_keeps_rows_whole(spark):
    rng = random.Random(6)
    sizes = [rng.choice([0, 1, 3, 3, 3, 7, 20, 31, 32, 33, 90]) for _ in range(400)] + [None]
    whole = [sorted(map(tuple, PR.pack_whole(texts_of(spark, sizes, p), 32).collect()), key=lambda r: r[1]) for p in (1, 50)]
    assert whole[0] == whole[1] and len(whole[0]) == 401
    bins = {}
    for (b, i, at, n, cut), size in zip(whole[0], sizes, strict=True):
        assert n == min(size or 0, 32) and cut == ((size or 0) > 32) and 0 <= at and at + n <= 32
        if n:
            bins.setdefault(b, []).append((at, at + n))
    assert all(x[1] <= y[0] for spans in bins.values() for x, y in itertools.pairwise(sorted(spans)))
    total = sum(min(s or 0, 32) for s in sizes)
    assert len(bins) <= 11 / 9 * -(-total // 32) + 1
    joined = [sorted(map(tuple, PR.pack_sequences(texts_of(spark, sizes, p), 32).collect()), key=lambda r: r[1]) for p in (1, 50)]
    assert joined[0] == joined[1]
    start = 0
    for (b, _, at, n), size in zip(joined[0], sizes, strict=True):
        assert (b, at, n) == (start // 32, start % 32, size or 0)
        start += size or 0
    for op in (PR.pack_whole, PR.pack_sequences):
        assert op(texts_of(spark, [], 2), 32).count() == 0


@pytest.mark.parametrize("file", ["byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_tokens_of_a_public_vocabulary_count_cap_and_pack(spark, file):
    tok = Tokenizer(f"{TOKENIZERS}/{file}")
    texts = ["Hello, world! <|endoftext|>", "", "naïve 😀😀 ☃ café\n\n  two  blanks", "a" * 5000, "the cat sat " * 300, None]
    df = spark.createDataFrame(list(enumerate(texts)), "example_id long, text string")
    for n in (0, 1, 5, 64):
        rows = df.select("example_id", token_count(F.col("text"), tok).alias("n"), first_tokens(F.col("text"), n, tok).alias("cut")).orderBy("example_id").collect()
        for r, t in zip(rows, texts, strict=True):
            if t is None:
                assert r["n"] is None and r["cut"] is None
                continue
            ends = ends_of(tok)(t)
            assert r["n"] == len(ends) and ends == sorted(ends) and t.startswith(r["cut"])
            assert r["cut"] == (t if len(ends) <= n else t[:ends[n - 1] if n else 0])
    capped = PR.cap_length(df.where("text is not null"), "text", 5, tokenizer=tok).orderBy("example_id").collect()
    assert [c["truncated"] for c in capped] == [len(ends_of(tok)(t)) > 5 for t in texts[:-1]]
    assert PR.pack_whole(df, 128, tokenizer=tok).agg(F.sum("n_tokens")).first()[0] == sum(min(128, len(ends_of(tok)(t))) for t in texts if t)


def test_tokens_equal_the_libraries_own_encoders():
    import base64

    import tiktoken
    from tokenizers import Tokenizer as Plain

    texts = ["Hello, world!", "naïve 😀 ☃", "  x\n\ny"]
    plain = Plain.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(f"{TOKENIZERS}/byte_bpe_50k.tiktoken", "rb"))}
    own = Tokenizer(f"{TOKENIZERS}/byte_bpe_50k.tiktoken")
    coder = tiktoken.Encoding("own", pat_str=own.pattern, mergeable_ranks=ranks, special_tokens={})
    for t in texts:
        assert len(ends_of(Tokenizer(f"{TOKENIZERS}/byte_bpe_50k.json"))(t)) == len(plain.encode(t, add_special_tokens=False).ids)
        ids = coder.encode_ordinary(t)
        assert len(ends_of(own)(t)) == len(ids) and coder.decode(ids) == t
        for k, end in enumerate(ends_of(own)(t), 1):
            assert t.encode().startswith(coder.decode_bytes(ids[:k])) and len(t[:end].encode()) <= len(coder.decode_bytes(ids[:k]))


def test_positions_follow_the_files(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(500).select((500 - F.col("id")).alias("v"), F.lit("x").alias("w")).repartition(7).write.parquet(path)
    stored = [r["v"] for r in spark.read.parquet(*sorted(str(p) for p in (tmp_path / "t").glob("*.parquet"))).coalesce(1).collect()]
    order = {f: i for i, f in enumerate(sorted(str(p) for p in (tmp_path / "t").glob("*.parquet")))}
    assert len(order) == 7
    rows = POS.read_positioned(spark, path).collect()
    assert sorted(r["row_no"] for r in rows) == list(range(500))
    by_file = spark.read.parquet(path).select("v", "_metadata.file_path", "_metadata.row_index").collect()
    want = [r["v"] for r in sorted(by_file, key=lambda r: (r["file_path"], r["row_index"]))]
    assert [r["v"] for r in sorted(rows, key=lambda r: r["row_no"])] == want and sorted(stored) == sorted(want)
    assert {r["v"] for r in POS.first_in_source_order(spark, path, 30, "v").collect()} == set(want[:30])
    assert POS.first_in_source_order(spark, path, 0, "v").count() == 500
    short = str(tmp_path / "s")
    spark.range(40).write.parquet(short)
    both = POS.align_positional(POS.read_positioned(spark, path, "v"), POS.read_positioned(spark, short))
    assert sorted(r["row_no"] for r in both.collect()) == list(range(40))


SCORES = "model string, valid_json boolean, tool_match boolean, hallucinated boolean, precision double, recall double, rouge_l double"


def test_states_merge_to_one_pass_and_a_replayed_batch_changes_nothing(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), *(rng.random() < 0.5 for _ in range(3)), *(rng.randrange(9) / 8 for _ in range(3))) for _ in range(300)]
    whole = spark.createDataFrame(rows, SCORES)
    parts = [spark.createDataFrame(rows[i::3], SCORES) for i in range(3)]
    want = sorted(map(tuple, S.aggregate_metrics(whole).collect()))
    path = str(tmp_path / "state")
    for batch in (0, 1, 2, 1, 0):
        store_batch(path)(parts[batch], batch)
    for got, row in zip(sorted(map(tuple, stored_metrics(spark, path).collect())), want, strict=True):
        assert got[0] == row[0] and got[1:] == pytest.approx(row[1:])
    assert S.aggregate_metrics(whole.limit(0), ()).first()["n"] == 0


def test_wall_time_counts_overlaps_once_across_buckets(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", None]), t := rng.randrange(5000), t + rng.randrange(-5, 400)) for _ in range(200)]
    rows += [("c", None, 5), ("c", 7, 7), ("a", 0, 20_000)]
    df = spark.createDataFrame(rows, "model string, start_ms long, end_ms long").repartition(3)
    for bucket in (100, 777, 10 ** 9):
        got = {r["model"]: (r["n"], r["busy_s"]) for r in S.wall_time(df, bucket_ms=bucket).collect()}
        for m in ("a", "b", "c", None):
            mine = [(a, b) for k, a, b in rows if k == m]
            busy = len({t for a, b in mine if a is not None for t in range(a, b)})
            assert got[m] == (len(mine), round(busy / 1000, 1))


def test_refresh_parses_only_what_changed(spark, tmp_path):
    path = str(tmp_path / "corpus")
    rows = [(i, "S", f"USER: hi {i} ASSISTANT: <functioncall> {{\"name\": \"f{i}\"}} </s>") for i in range(40)]
    frame = lambda r: spark.createDataFrame(r, "example_id long, system string, chat string").repartition(3)
    assert refresh_corpus(frame(rows), path, buckets=5) == Refreshed(40, 0, 0)
    assert refresh_corpus(frame(rows), path, buckets=5) == Refreshed(0, 40, 0)
    rows[3] = (3, "S", "USER: changed")
    assert refresh_corpus(frame(rows), path, buckets=5) == Refreshed(1, 39, 0)
    rows = rows[:30] + [(99, None, "USER: new")]
    assert refresh_corpus(frame(rows), path, buckets=5) == Refreshed(1, 30, 10)
    got = {r["example_id"]: [t["content"] for t in r["turns"]] for r in read_refreshed(spark, path).collect()}
    want = {r["example_id"]: [t["content"] for t in r["turns"]] for r in B.parse_corpus(frame(rows)).collect()}
    assert got == want and got[3] == ["changed"]
    assert refresh_corpus(frame([]), path, buckets=5) == Refreshed(0, 0, 31)
