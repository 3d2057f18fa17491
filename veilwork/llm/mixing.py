"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target number of words.  Its documents first receive the
whole copies that the ratio of target to size makes certain; the rest of the
target is a sample without replacement.  Each document draws a number ``u``; its
rank is the random odds ``u / (1 - u)`` divided by the odds of its inclusion,
and documents enter in order of rank until the words of the target are reached,
so the sample has a fixed size in words and the inclusion probabilities asked
for, which differ between sources.

The draw is a function of the row (its id and text), so reruns and retried tasks
agree.  No source is sorted as a whole: words are counted per rank interval, and
only inside the interval in which a source reaches its target are single ranks
looked at, after a second division of that interval.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilwork.llm.text import whole, word_count
from veilwork.llm.work import written

INTERVALS = 4096
DRAWS = 1 << 52


def draw(doc_id: Column, text: Column, seed: str) -> Column:
    """A number in (0, 1) that depends on ``seed``, id and text only.

    The text takes part so that rows without an id, or with the same one, differ.
    """
    name = F.concat_ws("|", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(text))
    number = F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("long")
    return (number + F.lit(0.5)) / F.lit(float(DRAWS))


def ranked_sources(sized: DataFrame) -> DataFrame:
    """One row per source: ``source``, ``source_size``, ``place`` (by code point, null last, from 0).

    Sources are dealt to tasks by range, so numbering them is not the work of one task.
    """
    totals = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    order = [F.col("source").isNull(), F.col("source")]
    dealt = written(
        totals.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "sources"
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per task
    parts = dealt.groupBy("part").agg(F.count("*").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    placed = dealt.withColumn("inside", inside).join(parts, "part")
    return placed.select("source", "source_size", (F.col("offset") + F.col("inside")).alias("place"))


def targets(sized: DataFrame, weights=(1, 2, 3), most_times: int = 3) -> DataFrame:
    """``source``, ``source_size``, ``target``, ``whole`` copies and ``odds`` of one more.

    Sources share all words by weight.  A source whose share would exceed
    ``most_times`` its own words stops there, and what is left over is shared by
    weight among the others, until no share is above its limit.  All sums are
    whole numbers; a target is rounded once, at the end.
    """
    weight = F.array(*[F.lit(w) for w in weights])
    sources = written(
        ranked_sources(sized).withColumns(
            {
                "weight": F.get(weight, (F.col("place") % len(weights)).cast("int")).cast("long"),
                "most": F.col("source_size") * F.lit(most_times),
            }
        ),
        "weights",
    )
    wide = "decimal(38,0)"
    words, shares, capped = None, None, -1
    while True:
        over = F.lit(False)
        if words is not None and shares:
            # most < weight * words / shares
            over = F.col("most").cast("decimal(19,0)") * F.lit(shares).cast("decimal(18,0)") < (
                F.col("weight").cast("decimal(9,0)") * F.lit(words).cast("decimal(19,0)")
            )
        state = sources.agg(
            F.sum(F.col("source_size").cast(wide)).alias("all"),
            F.sum(F.when(over, F.col("most").cast(wide))).alias("used"),
            F.sum(F.when(~over, F.col("weight"))).alias("shares"),
            F.sum(over.cast("long")).alias("capped"),
        ).first()
        if state["capped"] == capped or state["all"] is None:
            break
        words, shares, capped = int(state["all"]) - int(state["used"] or 0), int(state["shares"] or 0), state["capped"]
    share = (F.col("weight") * F.lit(words or 0)).cast("double") / F.lit(float(shares or 1))
    target = F.when(over, F.col("most").cast("double")).otherwise(share)
    copies = F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(F.lit(0.0))
    out = sources.select("source", "source_size", target.alias("target"), copies.alias("copies"))
    out = out.withColumn("whole", F.floor("copies").cast("long"))
    fraction = F.col("copies") - F.col("whole")
    return out.select(
        "source", "source_size", "target", "whole",
        (fraction / (F.lit(1.0) - fraction)).alias("odds"),
        (F.col("target") - F.col("whole") * F.col("source_size")).alias("wanted"),
    )


def _place(u: Column, odds: Column) -> Column:
    """The Pareto rank q = (u / (1 - u)) / odds as q / (1 + q), which lies in (0, 1)."""
    q = (u / (F.lit(1.0) - u)) / odds
    return F.when(odds > 0, q / (q + F.lit(1.0))).otherwise(F.lit(1.0))


def cuts(sized: DataFrame, weights=(1, 2, 3), most_times: int = 3) -> DataFrame:
    """The columns of ``targets``, ``cut`` and ``part``: rows of rank below the cut are taken once more,
    and of those of that rank ``part`` rows.

    ``sized`` has ``source``, ``size``, ``u`` and ``n``, the number of such rows.  Of the rows in
    order of rank, a row enters if at most half of it lies beyond the wanted words.  Rows
    of equal rank (the same id and text) are interchangeable; as many enter as fit.
    """
    sources = written(targets(sized, weights, most_times), "targets")
    same = F.col("d.source").eqNullSafe(F.col("t.source"))
    ranked = sized.alias("d").join(sources.alias("t"), same).select(
        "d.source", "t.wanted", "size", (F.col("size") * F.col("n")).alias("words"), _place(F.col("u"), F.col("odds")).alias("x")
    )
    first = F.least(F.floor(F.col("x") * INTERVALS), F.lit(INTERVALS - 1)).cast("int")
    second = F.least(
        F.floor((F.col("x") * INTERVALS - F.col("first")) * INTERVALS), F.lit(INTERVALS - 1)
    ).cast("int")
    ranked = ranked.withColumn("first", first).withColumn("second", second)

    def reached(sums: DataFrame, level: str, start: Column) -> DataFrame:
        """Of the intervals of each source, the one in which the words reach the wanted number."""
        ordered = Window.partitionBy("source").orderBy(level).rowsBetween(Window.unboundedPreceding, 0)
        end = sums.withColumn("end", start + F.sum("words").over(ordered))
        return end.filter((F.col("end") > F.col("wanted")) & (F.col("end") - F.col("words") <= F.col("wanted")))

    coarse = ranked.groupBy("source", "wanted", "first").agg(F.sum("words").alias("words"))
    coarse = reached(coarse.filter("words > 0"), "first", F.lit(0)).select(
        "source", "first", (F.col("end") - F.col("words")).alias("start")
    )
    inner = ranked.alias("r").join(
        coarse.alias("c"),
        F.col("r.source").eqNullSafe(F.col("c.source")) & (F.col("r.first") == F.col("c.first")),
    ).select("r.*", "c.start")
    inner = written(inner, "interval")
    fine = inner.groupBy("source", "wanted", "start", "second").agg(F.sum("words").alias("words"))
    fine = reached(fine.filter("words > 0"), "second", F.col("start")).select(
        "source", "second", (F.col("end") - F.col("words")).alias("start")
    )
    last = inner.drop("start").alias("r").join(
        fine.alias("c"),
        F.col("r.source").eqNullSafe(F.col("c.source")) & (F.col("r.second") == F.col("c.second")),
    ).select("r.source", "r.wanted", "c.start", "r.x", "r.size", "r.words")
    last = last.filter("size > 0").groupBy("source", "wanted", "start", "x", "size").agg(F.sum("words").alias("words"))
    ordered = Window.partitionBy("source").orderBy("x", "size").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("start") + F.coalesce(F.sum("words").over(ordered), F.lit(0))
    fitting = F.floor((F.col("wanted") - before) / F.col("size") + F.lit(0.5)).cast("long")
    fitting = F.greatest(F.lit(0), F.least(fitting, (F.col("words") / F.col("size")).cast("long")))
    # The cut is the highest rank of which rows enter, or else just below the interval.
    last = last.withColumn("part", fitting)
    cut = last.groupBy("source").agg(
        F.max(F.when(F.col("part") > 0, F.struct("x", "size", "part"))).alias("at"), F.min("x").alias("lowest")
    )
    joined = sources.alias("t").join(cut.alias("c"), F.col("t.source").eqNullSafe(F.col("c.source")), "left")
    # No interval is reached if the wanted words are all words of the source or none.
    rest = F.when(F.col("lowest").isNull(), F.when(F.col("wanted") > 0, F.lit(2.0)).otherwise(F.lit(-1.0)))
    low = F.col("lowest") * F.lit(1.0 - 2.0**-52)
    return joined.select("t.*", F.coalesce("at.x", rest, low).alias("cut"), F.coalesce("at.part", F.lit(0)).alias("part"))


def _sized(packed: DataFrame, doc_id: str, text: str, source: str, seed: str, keep) -> DataFrame:
    """``keep``, ``source``, ``size`` and ``u`` of rows packed into the struct ``row``."""
    row = F.col("row")
    body = whole(row.getField(text))
    return packed.select(
        *keep,
        row.getField(source).alias("source"),
        word_count(body).alias("size"),
        draw(row.getField(doc_id), body, seed).alias("u"),
    )


def _packed(df: DataFrame) -> DataFrame:
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))


def _merged(sized: DataFrame) -> DataFrame:
    """Equal rows once, with their number ``n``: they draw alike, however many there are."""
    return sized.groupBy(*sized.columns).agg(F.count("*").alias("n"))


def _with_copies(rows: DataFrame, bounds: DataFrame) -> DataFrame:
    """``rows`` (source, size, u, ...) with ``source_size``, ``target``, ``copies`` and ``part``.

    ``part`` of the rows that are equal to a row at the cut have a copy more (null: not at the cut).
    """
    bounds = bounds.withColumnRenamed("source", "of")
    joined = rows.join(bounds, F.col("source").eqNullSafe(F.col("of")))
    x = _place(F.col("u"), F.col("odds"))
    filled = F.col("size") > 0
    copies = F.col("whole") + ((x < F.col("cut")) & (F.col("odds") > 0)).cast("long")
    return joined.select(
        *rows.columns, "source_size", "target",
        F.when(filled, copies).otherwise(F.lit(0)).cast("long").alias("copies"),
        F.when(filled & (x == F.col("cut")) & (F.col("odds") > 0), F.col("part")).alias("part"),
    )


def allocate(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
    weights=(1, 2, 3), most_times: int = 3, seed: str = "mix",
) -> DataFrame:
    """Per row: ``doc_id``, ``size``, ``source_size``, ``target``, ``taken`` (words, repeats counted).

    A null source is a source of its own, the last.  A null or empty text has
    size 0 and is taken 0 times.  Rows equal in id and text draw alike; of those at the
    cut as many are taken once more as fit, so a source misses its target by at most half of
    one document.  An empty table gives an empty result.
    """
    key = F.col("row").getField(doc_id).alias("doc_id")
    rows = written(_merged(_sized(_packed(df), doc_id, text, source, seed, [key])), "sized")
    bounds = written(cuts(rows, weights, most_times), "cuts")
    mixed = _with_copies(rows, bounds)
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("row")
    mixed = mixed.select("doc_id", "size", "source_size", "target", "copies", "part", each)
    more = (F.col("row") <= F.coalesce("part", F.lit(0))).cast("long")
    return mixed.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * (F.col("copies") + more)).alias("taken")
    )


def mix(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
    weights=(1, 2, 3), most_times: int = 3, seed: str = "mix",
) -> DataFrame:
    """The mixed rows themselves, with the columns of ``df``; a row taken n times is there n times.

    Of rows equal in id and text at the cut of a source, one stands for the copies that fit.
    """
    sized = written(_merged(_sized(_packed(df), doc_id, text, source, seed, [])), "sized")
    bounds = written(cuts(sized, weights, most_times), "cuts")
    rows = _sized(_packed(df), doc_id, text, source, seed, ["row"])
    copied = _with_copies(rows, bounds)
    repeated = copied.filter("copies > 0").select("row", "copies")
    # One row per source, chosen in each task before rows move.
    at_cut = copied.filter("part > 0").select("source", F.to_json("row").alias("shown"), "row", F.col("part").alias("copies"))
    at_cut = at_cut.groupBy("source").agg(F.min_by(F.struct("row", "copies"), F.col("shown")).alias("one"))
    both = repeated.unionByName(at_cut.select("one.row", "one.copies"))
    each = both.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return each.select(*[F.col("row").getField(c).alias(c) for c in df.columns])
