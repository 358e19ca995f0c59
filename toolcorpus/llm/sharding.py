"""Sharding by balanced label propagation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from toolcorpus.llm.common import materialize
from toolcorpus.operators.scan import row_numbers

SHARDS, ROUNDS = 8, 24


def _way(room: list[list[int]], start: int, goal: int) -> list[int] | None:
    """A shortest way over pairs with room."""
    came, queue = {start: start}, [start]
    for here in queue:
        if here == goal:
            way = [goal]
            while way[-1] != start:
                way.append(came[way[-1]])
            return way[::-1]
        for there, free in enumerate(room[here]):
            if free and there not in came:
                came[there] = here
                queue.append(there)
    return None


def quotas(wanted: list[list[int]], spare: list[int]) -> list[list[int]]:
    """How many of the rows that want to go from one shard to another may, so that every shard keeps its size.

    Moves are allowed along circles of shards, as many at once as the circle's
    narrowest step has left: first circles of wanted moves only, then such as
    are closed by spare rows, which may go anywhere. Every circle uses up a
    step, and in the end no wanted move has a circle left.
    """
    k = len(wanted)
    room = [[*row, 0] for row in wanted] + [[0] * (k + 1)]
    take = [[0] * k for _ in range(k)]
    for with_spare in (False, True):
        if with_spare:  # through one more place, where spare rows meet
            for t in range(k):
                room[t][k], room[k][t] = spare[t], sum(spare)
        for s, t in sorted(((s, t) for s in range(k) for t in range(k)), key=lambda x: -wanted[x[0]][x[1]]):
            while room[s][t]:
                back = _way(room, t, s)
                if back is None:
                    break
                steps = list(zip([s, *back[:-1]], back, strict=True))
                n = min(room[x][y] for x, y in steps)
                for x, y in steps:
                    room[x][y] -= n
                    if x < k and y < k:
                        take[x][y] += n
    return take


def _matrix(df: DataFrame, k: int) -> list[list[int]]:
    out = [[0] * k for _ in range(k)]
    for r in df.groupBy("shard", "target").count().collect():  # at most k * k rows
        out[r["shard"]][r["target"]] = r["count"]
    return out


def propagate(members: DataFrame, spare: list[int], rounds: int = ROUNDS) -> tuple[DataFrame, list[int]]:
    """Moves of linked rows ``(position, shard, g1, g2, ...)`` towards their neighbours; the rows with their last shard, and the spare rows left.

    In every round the rows of each group are counted by shard, and a join
    brings the counts to the rows: a row wants to go where most of its
    neighbours are, ties to the shard that a hash of the group prefers, so all
    rows of a group agree. ``quotas`` bounds the moves between two shards, in the
    order of their gain. A shard that has no more room for those who want to
    come is left out, until spare rows come to it, so a group larger than a
    shard goes on to fill the next. Rounds end when nothing moves and no shard
    is newly left out; any number of rounds leaves the sizes as they were.
    """
    k, spare = len(spare), list(spare)
    is_open = [True] * k
    rest = [c for c in members.columns if c != "shard"]
    for _ in range(rounds):
        held = members.groupBy("g1", "g2").agg(F.array(*[F.count(F.when(F.col("shard") == s, 1)) for s in range(k)]).alias("held"))
        held = materialize(held, "shard-groups")
        preferred = lambda t: F.xxhash64("g1", "g2", t)
        choices = [F.struct(F.get("held", F.lit(t)).alias("n"), preferred(F.lit(t)).alias("p"), F.lit(t).alias("t"))
                   for t in range(k) if is_open[t]]
        best = F.array_max(F.array(*choices))
        own_open = F.array_contains(F.array(*[F.lit(t) for t in range(k) if is_open[t]]), F.col("shard"))
        here = F.get("held", F.col("shard"))
        asks = members.join(held, ["g1", "g2"]).select(*rest, "shard", best.alias("best"), here.alias("here"), own_open.alias("own_open"))
        asks = materialize(asks.select(
            *rest, "shard", F.when(F.col("own_open") | (F.col("best.n") >= F.col("here")), F.col("best.t")).otherwise(F.col("shard")).alias("target"),
            (F.col("best.n") - F.col("here")).alias("gain")), "shard-moves")
        wanted = _matrix(asks.where("shard <> target"), k)
        take = quotas(wanted, spare)
        cut = [(s, t) for s in range(k) for t in range(k) if take[s][t] < wanted[s][t]]
        if cut:
            key = F.col("shard") * k + F.col("target")
            limited = key.isin([s * k + t for s, t in cut])
            queue = row_numbers(asks.where(limited), ["shard", "target", -F.col("gain"), "g1", "g2", "position"], "turn")
            last, before = F.lit(0), 0
            for s, t in cut:
                last = F.when(key == s * k + t, F.lit(before + take[s][t])).otherwise(last)
                before += wanted[s][t]
            queue = queue.withColumn("target", F.when(F.col("turn") < last, F.col("target")).otherwise(F.col("shard"))).drop("turn")
            asks = materialize(asks.where(~limited).unionByName(queue), "shard-moved")
        members = asks.select(*rest, F.col("target").alias("shard"))
        net = [sum(take[s][t] for s in range(k)) - sum(take[t]) for t in range(k)]
        spare = [spare[t] - net[t] for t in range(k)]
        came, asked = ([sum(m[s][t] for s in range(k)) for t in range(k)] for m in (take, wanted))
        left_out = [o and asked[t] > came[t] and (came[t] == 0 or spare[t] == 0 < sum(spare)) for t, o in enumerate(is_open)]
        if not any(came) and not any(left_out):
            break
        is_open = [spare[t] > 0 or o and not left_out[t] for t, o in enumerate(is_open)]
        if not any(is_open):
            break
    return members, spare


def balanced_shards(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text",
                    links: Sequence[Column] | None = None, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every row.

    Rows are linked if they agree in ``links`` (by default: in their texts, so
    copies are linked; null texts are linked to each other, not to empty
    ones). They are first dealt out in a hashed order, and then change places
    until linked rows share a shard as far as the sizes allow; see
    ``propagate``. The law is ``rows``: at every moment the numbers of rows of
    two shards differ by one at most, so a group larger than a shard is cut
    into as few parts as its shards allow. ``slot`` numbers a shard's rows from
    0 without gaps, linked rows next to each other. ``grown_shard`` is null:
    this law deals anew for another number of shards.

    ``size`` is the UTF-8 length of the text, null as none, plus one;
    ``text_crc32`` is unsigned, null for a null text. Texts are compared by two
    64-bit hashes. Repeated rows and null identifiers are rows like others. An
    empty table gives no rows; other columns are ignored.

    Only narrow rows move, and only linked ones take part in the rounds: rows
    without a neighbour are counted by shard, and get their places last. Every
    round is written to the shared folder; a group of any size is counted with
    map-side combine, and the join splits it.
    """
    text = F.col(text_col)
    keys = list(links) if links is not None else [text]
    base = docs.select(F.col(id_col).alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(*keys).alias("g1"), F.xxhash64(F.lit(1), *keys).alias("g2"))
    base = materialize(base, "shard-rows")
    dealt = row_numbers(base, [F.xxhash64("doc_id", "g1"), "doc_id", "g1"], "position", tie=F.monotonically_increasing_id())
    dealt = dealt.withColumn("shard", F.pmod("position", F.lit(shards)).cast("int"))
    groups = materialize(base.groupBy("g1", "g2").count().where(F.col("count") > 1), "shard-links")
    dealt = materialize(dealt.join(groups, ["g1", "g2"], "left"), "shard-dealt")
    alone = F.col("count").isNull()
    spare, whole = [0] * shards, [0] * shards
    for r in dealt.groupBy("shard").agg(F.count("*").alias("n"), F.count(F.when(alone, 1)).alias("alone")).collect():  # one row per shard
        spare[r["shard"]], whole[r["shard"]] = r["alone"], r["n"]
    columns = ["doc_id", "size", "text_crc32", "position", "g1", "g2", "shard"]
    members, spare = propagate(dealt.where(~alone).select(*columns), spare, rounds)

    def starts(counts: list[int]) -> Column:
        return F.array(*[F.lit(sum(counts[:s])).cast("bigint") for s in range(shards + 1)])

    linked = [w - n for w, n in zip(whole, spare, strict=True)]
    members = row_numbers(members, ["shard", "g1", "g2", "position"], "turn").withColumn(
        "slot", F.col("turn") - F.get(starts(linked), F.col("shard")))
    free = row_numbers(dealt.where(alone).select(*columns), ["position"], "turn")
    own = F.size(F.filter(starts(spare), lambda x: x <= F.col("turn"))) - 1
    free = free.withColumn("shard", own.cast("int")).withColumn(
        "slot", F.col("turn") - F.get(starts(spare), F.col("shard"))
        + F.get(F.array(*[F.lit(n).cast("bigint") for n in linked]), F.col("shard")))
    return members.unionByName(free).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                                            F.lit(None).cast("int").alias("grown_shard"))
