"""Line deduplication by overlapping three-line windows (DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from toolcorpus.llm.common import materialize, packed, text_hash

WINDOW = 3


def line_windows(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """``(id, th, first, last, h1, h2)``: a row per window of ``width`` consecutive non-blank lines."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = docs.select(
        F.col(id_col).alias("id"), text_hash(F.col(text_col)).alias("th"),
        F.filter(F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("i"), x.alias("x"))),
                 lambda p: F.length(F.btrim(p["x"], F.lit(" \t\x0b\f\r"))) > 0).alias("lines"))
    lines = lines.where(F.size("lines") >= width)

    def window(j):
        parts = [F.get(F.col("lines"), j + k)["x"] for k in range(width)]
        return F.struct(F.get(F.col("lines"), j)["i"].alias("first"),
                        F.get(F.col("lines"), j + (width - 1))["i"].alias("last"),
                        F.xxhash64(*parts).alias("h1"), F.xxhash64(F.lit(width), *parts).alias("h2"))

    return lines.select("id", "th", F.inline(F.transform(
        F.sequence(F.lit(0), F.size("lines") - width), window)))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW) -> DataFrame:
    """``(id, th, spans)``: the merged line intervals ``[first, last]`` that later occurrences cover."""
    wins = materialize(line_windows(docs, id_col, text_col, width), "line-windows")
    at = F.struct(F.col("id").isNull().alias("absent"), F.col("id"), F.col("th"), F.col("first"))
    # Written, so that the join reads two plain exchanges and a hot window can be split.
    firsts = materialize(wins.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(at).alias("at"))
                         .where(F.col("n") > 1).select("h1", "h2", "at"), "line-firsts")
    later = (wins.join(firsts, ["h1", "h2"])
             .where(~(F.col("id").eqNullSafe(F.col("at.id")) & (F.col("th") == F.col("at.th"))
                      & (F.col("first") == F.col("at.first"))))
             # Rows repeated in full have the same windows: each counts once, so they do not fill one group.
             .select("id", "th", "first", "last").distinct())
    own = Window.partitionBy("id", "th").orderBy("first")
    before = F.max("last").over(own.rowsBetween(Window.unboundedPreceding, -1))
    isles = (later.withColumn("new", F.when(F.col("first") <= before + 1, 0).otherwise(1))
             .withColumn("isle", F.sum("new").over(own.rowsBetween(Window.unboundedPreceding, 0))))
    merged = isles.groupBy("id", "th", "isle").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return merged.groupBy("id", "th").agg(
        F.array_sort(F.collect_list(F.struct("first", "last"))).alias("spans"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW,
               chars_col: str = "n_chars") -> DataFrame:
    """Every row of ``docs`` with later occurrences of repeated line windows cut from its text.

    Lines end at ``\\n``. A window is ``width`` consecutive lines that are not
    blank; blank lines (ASCII white space only) between them belong to it, and
    others stay. The first occurrence of a window is the one with the smallest
    identifier (null last), then the smallest hash of the text, then the
    smallest line; all lines that a later occurrence covers go, in the same
    document too. Windows are judged on the input. ``n_lines`` and ``n_removed``
    are added, and ``chars_col`` follows the text if present; input columns of
    those two names are replaced, other columns stay.

    A null text stays null, with no lines; an empty text has one. A text of fewer than ``width``
    lines has no window and stays as it is. Rows that agree in identifier and
    text are one document: they count once per row when windows are counted,
    all keep the first occurrence, and all get the same text. An empty table
    gives no rows.

    Windows are hashed to 128 bits, counted with map-side combine and joined
    back by hash (hot windows are split at run time). Merged spans per document
    come to the text in one join; the text itself is never exploded.
    """
    spans = repeated_spans(docs, id_col, text_col, width)
    rows = packed(docs, id=F.col(id_col), th=text_hash(F.col(text_col)), txt=F.col(text_col)).alias("d")
    s = spans.alias("s")
    out = rows.join(s, F.col("d.id").eqNullSafe(F.col("s.id")) & (F.col("d.th") == F.col("s.th")), "left").select(
        "__row", "txt", "spans", F.split("txt", "\n").alias("lines"))
    out = out.withColumn("n_all", F.coalesce(F.size("lines"), F.lit(0)))
    cut = F.flatten(F.transform(
        F.sequence(F.lit(0), F.size("spans")),
        lambda k: F.slice(F.col("lines"),
                          F.when(k == 0, 1).otherwise(F.get(F.col("spans"), k - 1)["last"] + 2),
                          F.coalesce(F.get(F.col("spans"), k)["first"], F.col("n_all"))
                          - F.when(k == 0, 0).otherwise(F.get(F.col("spans"), k - 1)["last"] + 1))))
    gone = F.aggregate("spans", F.lit(0), lambda a, x: a + x["last"] - x["first"] + 1)
    out = (out.withColumn("new_text", F.when(F.col("spans").isNull(), F.col("txt")).otherwise(F.array_join(cut, "\n")))
           .withColumn("gone", F.coalesce(gone, F.lit(0))))
    fields = [f for f in out.schema["__row"].dataType.fields if f.name not in ("n_lines", "n_removed")]
    cols = []
    for f in fields:
        if f.name == text_col:
            cols.append(F.col("new_text").alias(f.name))
        elif f.name == chars_col:
            cols.append(F.length("new_text").cast(f.dataType).alias(f.name))
        else:
            cols.append(F.col("__row").getField(f.name).alias(f.name))
    return out.select(*cols, F.greatest(F.col("n_all"), F.lit(0)).cast("bigint").alias("n_lines"),
                      F.col("gone").cast("bigint").alias("n_removed"))
