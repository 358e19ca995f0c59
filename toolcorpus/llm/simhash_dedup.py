"""SimHash near-deduplication by covering locality-sensitive hashing."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from toolcorpus.llm.common import connected_components, materialize, packed, text_hash

SHINGLE, RADIUS, SEED = 3, 2, 42


def simhash_bytes(text: bytes, width: int = SHINGLE, seed: int = SEED) -> int:
    """Signed 64-bit fingerprint of one text.

    A-Z is lower-cased, words are split at ASCII white space, shingles are
    ``width`` words joined by a space, repeats included (fewer words: all of
    them; none: zero). A bit is 1 if set in over half the shingles' XXH64.
    """
    import numpy as np
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    flat, k = b" ".join(words), min(width, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.empty_like(ends)
    starts[0], starts[1:] = 0, ends[:-1] + 1
    digest = xxhash.xxh64_intdigest
    n, votes, step = len(words) - k + 1, np.zeros(64, np.int64), 1 << 16
    for at in range(0, n, step):
        to = min(n, at + step)
        h = np.fromiter((digest(flat[a:b], seed) for a, b in zip(starts[at:to].tolist(), ends[at + k - 1:to + k - 1].tolist(), strict=True)),
                        np.uint64, to - at)
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = votes * 2 > n
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def fingerprint(text: Column, width: int = SHINGLE, seed: int = SEED) -> Column:
    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([simhash_bytes(t.encode(), width, seed) if t else 0 for t in texts], dtype="int64")

    return run(text)


def covering_masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """Masks such that any two words within ``radius`` bits agree under at least one.

    Bit ``i`` gets a nonzero vector of ``radius + 1`` bits, in turn. The mask of
    a nonzero vector ``v`` has the bits whose vectors have an odd product with
    ``v``. For any ``radius`` bits some ``v`` is orthogonal to all their vectors,
    so its mask has none of them.
    """
    n = 1 << (radius + 1)
    own = [1 + i % (n - 1) for i in range(bits)]
    return [sum(1 << i for i in range(bits) if (own[i] & v).bit_count() & 1) for v in range(1, n)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges ``(u, v)`` that connect distinct fingerprints ``fp`` exactly as all pairs within the radius do.

    Every fingerprint goes to one table per covering mask. A bucket of two is
    verified by its bit distance. In larger buckets no pairs are made: each
    member emits the words within ``radius // 2`` flips of its unmasked bits,
    and members that meet at a word are linked to the smallest there. For an
    even radius two members meet if and only if they are within the radius, so
    links are exact and grow with the members, not with their square.
    """
    if radius % 2:
        raise ValueError("the radius must be even")
    masks = covering_masks(radius)
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(_signed(m)).alias("m")) for t, m in enumerate(masks)])
    rows = (prints.select("fp", F.explode(tables).alias("x"))
            .select("fp", F.col("x.t").alias("t"), F.col("x.m").alias("m"), F.col("fp").bitwiseAND(F.col("x.m")).alias("key")))
    buckets = rows.groupBy("t", "key").agg(F.count("*").alias("n"), F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("n > 1")
    buckets = materialize(buckets, "simhash-buckets")
    pairs = buckets.where((F.col("n") == 2) & (F.bit_count(F.col("lo").bitwiseXOR(F.col("hi"))) <= radius)).select(
        F.col("hi").alias("u"), F.col("lo").alias("v"))
    member = (rows.join(buckets.where("n > 2").select("t", "key"), ["t", "key"])
              .groupBy("fp").agg(F.bit_or(F.bitwise_not("m")).alias("free")))
    # Words within radius // 2 flips, flipping only bits that some shared bucket leaves free.
    words = member.select("fp", "free", F.col("fp").alias("word"), F.lit(-1).alias("last"))
    balls = words
    for _ in range(radius // 2):
        words = words.select("fp", "free", F.explode(F.filter(
            F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.struct(
                F.col("word").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).alias("word"), i.alias("last"))),
            lambda s: (s["last"] > F.col("last")) & (F.call_function("getbit", F.col("free"), s["last"]) == 1))).alias("s")
            ).select("fp", "free", "s.word", "s.last")
        balls = balls.union(words)
    balls = balls.select("fp", "word")
    meet = balls.groupBy("word").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo < hi").select("word", "lo")
    stars = balls.join(meet, "word").where("fp > lo").select(F.col("fp").alias("u"), F.col("lo").alias("v"))
    return pairs.union(stars).distinct()


def _components(docs: DataFrame, id_col: str, text_col: str, width: int, radius: int, seed: int) -> DataFrame:
    """``(doc_id, th, fp, root, component_id)`` per row; ``root`` names the component, ``th`` the text."""
    base = materialize(docs.select(F.col(id_col).alias("doc_id"), text_hash(F.col(text_col)).alias("th"),
                                   fingerprint(F.col(text_col), width, seed).alias("fp")), "simhash")
    nodes = materialize(base.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-nodes")
    comps = connected_components(near_links(nodes.select("fp"), radius))
    rooted = materialize(nodes.join(comps, nodes["fp"] == comps["node"], "inner").select("fp", "low", "root"), "simhash-rooted")
    lows = materialize(rooted.groupBy("root").agg(F.min("low").alias("component")), "simhash-lows")
    linked = rooted.join(lows, "root").select("fp", "root", "component")
    # Written, so that the last join reads two plain exchanges and a hot fingerprint can be split.
    low = materialize(nodes.join(linked, "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component", "low").alias("component_id")), "simhash-low")
    return base.join(low, "fp")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE,
                       radius: int = RADIUS, seed: int = SEED) -> DataFrame:
    """``doc_id, fingerprint, component_id`` per row: groups of texts linked at ``radius`` or fewer differing bits.

    Fingerprints as in ``simhash_bytes``, over whole texts; null and empty
    texts have fingerprint zero and link like any other. ``component_id`` is
    the smallest identifier reachable, itself included; null identifiers are
    passed over unless a component has no other. Repeated rows give a row each.
    An empty table gives no rows; other columns are ignored.

    Equal fingerprints are folded into one node first, so copies never meet
    in a bucket. Links come from covering tables (every pair within the radius
    shares a bucket, see ``near_links``); components are found in rounds
    written to the shared folder.
    """
    return _components(docs, id_col, text_col, width, radius, seed).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE,
                  radius: int = RADIUS, seed: int = SEED) -> DataFrame:
    """One row of ``docs``, unchanged, for each component of ``simhash_components``.

    The row with the smallest identifier stays (a null one only if there is no
    other), then the one with the smallest hash of its text; of fully repeated
    rows one stays. Rows without a word are one component. An empty table gives
    no rows.
    """
    at = F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "th")
    key = lambda i, th: F.concat_ws("|", F.coalesce(i.cast("string"), F.lit("~")), th.cast("string"))
    stay = (_components(docs, id_col, text_col, width, radius, seed).groupBy("root").agg(F.min(at).alias("at"))
            .select(key(F.col("at.doc_id"), F.col("at.th")).alias("key")))
    rows = packed(docs, key=key(F.col(id_col), text_hash(F.col(text_col))))
    # The join deals the rows out by key, so the choice among repeated rows needs no second shuffle.
    return rows.join(stay, "key", "left_semi").groupBy("key").agg(F.first("__row").alias("__row")).select("__row.*")
