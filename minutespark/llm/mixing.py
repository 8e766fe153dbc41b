"""Mixing sources to target weights: temperature mixing as budgeted block permutations.

Source shares p (of tokens) become weights w ~ p^a.  The exponent a is found by
bisection: the smallest for which no source repeats more than ``max_repeat`` times
and the entropy of w stays at or under its target, where one is given.  A budget
of tokens is then dealt by the weights: a source gets budget * w / tokens epochs.

Each row has a place, a hash of 40 bits; the places of a source fall into ``BLOCKS``
blocks.  Every epoch has a permutation of its own: blocks in the order of a hash of
epoch and block, documents of a block by one of epoch and place.  Whole epochs repeat
every document.  The last, partial epoch takes blocks until its budget is met: whole
blocks by their sums; the block where the budget ends is cut into BLOCKS smaller ones,
and so on until at most ``EDGE`` tokens of a source are left, which alone are put in
order.  So no source, nor any large part of one, meets in one task.

The default budget is the least that shows every document once: then no document
is dropped, and small sources repeat.  With a smaller budget large sources lose
their last documents of the partial epoch.

Sources are rows of a table throughout; the driver holds a few sums.  A token is a
word between white space.  Null and empty texts have none; they come with every whole
epoch and cost nothing.  Null sources form a source of their own.  Repeated rows are
dealt alike.  A table without tokens is returned once.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import HOT, documents, require, stored

#: Blocks of a source, and smaller ones of a block; bits of a place.
BITS, PLACE = 10, 40
BLOCKS = 1 << BITS
#: Tokens of a source that are put in order in one task, at most (but for one document).
EDGE = 1 << 20
#: Up to so many sources (a few numbers each) their plan is broadcast; beyond, joined.
FEW = 20_000
#: Production parameters of the query and the pipeline.
MAX_REPEAT = 1.25
SEED = 20240229


def tokens(text: Column) -> Column:
    """Words between white space, as a count."""
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


# --- weights.  A table of sources has ``source`` and ``n``, its tokens.


def temperature(sources: DataFrame, a: float) -> DataFrame:
    """The sources with ``weight``: p^a, normalised; sources without tokens get nothing."""
    total = sources.agg(F.sum("n")).first()[0] or 0
    power = F.when(F.col("n") > 0, F.exp(a * F.log(F.col("n") / F.lit(float(total or 1))))).otherwise(0.0)
    norm = sources.agg(F.sum(power)).first()[0] or 1.0
    return sources.withColumn("weight", power / F.lit(norm))


def given(sources: DataFrame, weights: Mapping[str | None, float]) -> DataFrame:
    """The sources with these weights, normalised over those that have tokens."""
    rows = sources.sparkSession.createDataFrame([(s, float(w)) for s, w in weights.items()], "s string, w double")
    rows = sources.join(rows, F.col("source").eqNullSafe(F.col("s")), "left").withColumn("w", F.when(F.col("n") > 0, F.coalesce("w", F.lit(0.0))).otherwise(0.0))
    norm = rows.agg(F.sum("w")).first()[0] or 1.0
    return rows.withColumn("weight", F.col("w") / F.lit(norm)).drop("s", "w")


def repetition(sources: DataFrame) -> float:
    """Epochs of the most repeated source where the least repeated is shown once, of a table with weights."""
    epochs = F.col("weight") / F.col("n")
    row = sources.filter("n > 0 and weight > 0").agg(F.max(epochs) / F.min(epochs)).first()
    return row[0] or 1.0


def entropies(sources: DataFrame, exponents: list[float]) -> list[float]:
    """Entropy of the weights at each exponent, in one pass."""
    total = sources.agg(F.sum("n")).first()[0] or 0
    log_p = F.log(F.col("n") / F.lit(float(total or 1)))
    sums = [F.struct(F.sum(F.exp(a * log_p)), F.sum(F.exp(a * log_p) * log_p)) for a in exponents]
    row = sources.filter("n > 0").agg(*sums).first()
    return [math.log(z) - a * e / z if z else 0.0 for a, (z, e) in zip(exponents, row, strict=True)]


def find_exponent(sources: DataFrame, max_repeat: float | None = None, target_entropy: float | None = None) -> float:
    """The smallest exponent in [0, 1] that keeps both limits; 1 if none is given or none can be kept.

    Repetition and entropy fall as the exponent grows, so each limit is bisected alone
    and the larger exponent keeps both.
    """
    least, most = sources.filter("n > 0").agg(F.min("n"), F.max("n")).first()
    if not least or (max_repeat is None and target_entropy is None):
        return 1.0
    found = [0.0]
    if max_repeat is not None and most / least > max_repeat:
        low, high = 0.0, 1.0
        for _ in range(60):
            mid = (low + high) / 2
            # the largest source repeats (most / least)^(a - 1) times as often as the smallest
            low, high = (low, mid) if (most / least) ** (1 - mid) <= max_repeat else (mid, high)
        found.append(high)
    if target_entropy is not None:
        low, high = 0.0, 1.0
        for _ in range(9):  # a table is read once for six halvings
            points = [low + (high - low) * i / 64 for i in range(65)]
            fine = [i for i, h in enumerate(entropies(sources, points)) if h <= target_entropy]
            first = fine[0] if fine else 64
            low, high = points[max(0, first - 1)], points[first]
        found.append(high)
    return max(found)


def epochs(sources: DataFrame, weights: Mapping[str | None, float] | None = None, budget: int | None = None, max_repeat: float | None = MAX_REPEAT, target_entropy: float | None = None) -> DataFrame:
    """The sources with weight, ``whole`` epochs, and the tokens of a partial one (``rest``)."""
    shares = given(sources, weights) if weights is not None else temperature(sources, find_exponent(sources, max_repeat, target_entropy))
    shares = stored(shares, "mix-shares")
    if budget is None:
        budget = shares.filter("n > 0 and weight > 0").agg(F.max(F.ceil(F.col("n") / F.col("weight")))).first()[0] or 0
    # within a millionth of a whole epoch it is one
    part = F.when((F.col("n") > 0) & (F.col("weight") > 0), F.least(F.lit(float(budget)) * F.col("weight") / F.col("n"), F.lit(1e6))).otherwise((F.col("n") <= 0).cast("double"))
    whole = F.floor(part + 1e-6)
    rest = F.round(F.greatest(part - whole, F.lit(0.0)) * F.col("n")).cast("long")
    return shares.withColumns({"whole": whole.cast("int"), "rest": rest})


# --- dealing


def _cut(cells: DataFrame, plan: DataFrame, shift: int) -> DataFrame:
    """The plan with the cell of 2^shift places where each source's partial epoch ends.

    ``cells``: source, cell, n.  Places before ``lo`` are taken, of those up to ``hi``
    as many as ``room`` tokens allow; ``size`` is what they hold.
    """
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = cells.withColumn("before", before).join(_few(plan.select(F.col("source").alias("s"), F.col("room").alias("rest")), plan), F.col("source").eqNullSafe(F.col("s")))
    ends = ends.filter("rest > 0 and before + n > rest").groupBy("source").agg(F.min(F.struct("cell", (F.col("rest") - F.col("before")).alias("room"), "n")).alias("end"))
    joined = plan.join(ends.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left")
    lo = F.coalesce(F.col("end.cell") * (1 << shift), F.when(F.col("room") > 0, F.col("hi")).otherwise(F.col("lo")))
    hi = F.coalesce((F.col("end.cell") + 1) * (1 << shift), lo)
    found = joined.select("source", "weight", "rows", "whole", lo.alias("lo"), hi.alias("hi"), F.coalesce("end.room", F.lit(0)).cast("long").alias("room"), F.coalesce("end.n", F.lit(0)).cast("long").alias("size"))
    return stored(found, "mix-plan")


def _few(df: DataFrame, sources: DataFrame) -> DataFrame:
    return F.broadcast(df) if sources.count() <= FEW else df


def _with_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows with the plan of their source; few sources, or the few that hold much, are broadcast."""
    same = F.col("source").eqNullSafe(F.col("s"))
    plan = plan.withColumnRenamed("source", "s")
    if plan.count() <= FEW:
        return rows.join(F.broadcast(plan), same)
    least = (plan.agg(F.sum("rows")).first()[0] or 0) // HOT
    hot, cold = F.broadcast(plan.filter(F.col("rows") > least)), plan.filter(F.col("rows") <= least)
    return rows.join(hot, same).unionByName(rows.join(hot, same, "left_anti").join(cold, same))


def mix(docs: DataFrame, weights: Mapping[str | None, float] | None = None, budget: int | None = None, max_repeat: float | None = MAX_REPEAT, target_entropy: float | None = None, seed: int = SEED) -> DataFrame:
    """The columns of ``docs`` once for each time a row is dealt, and __epoch, __block, __order, __place, __weight, __tokens.

    Rows ordered by (__epoch, __order, __place) follow the permutation.  ``weights``
    replaces the temperature where the mixture is known.
    """
    require(docs, ["doc_id", "text", "source"])
    place = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("source"), F.col("text")), 64 - PLACE)
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("source").cast("string").alias("source"), tokens(F.col("text")).alias("tokens"), place.alias("place"))
    shift = PLACE - BITS
    cells = stored(rows.groupBy("source", F.shiftright("place", shift).alias("cell")).agg(F.sum("tokens").alias("n"), F.count(F.lit(1)).alias("rows")), "mix-cells")
    sources = stored(cells.groupBy("source").agg(F.sum("n").alias("n"), F.sum("rows").alias("rows")), "mix-sources")
    plan = epochs(sources, weights, budget, max_repeat, target_entropy)
    plan = plan.select("source", "weight", "rows", "whole", F.lit(0).cast("long").alias("lo"), F.lit(1 << PLACE).alias("hi"), F.col("rest").alias("room"))
    plan = _cut(cells.select("source", "cell", "n"), stored(plan, "mix-plan"), shift)
    while shift > 0:
        open_ = plan.filter(F.col("size") > EDGE)
        if open_.isEmpty():
            break
        shift = max(0, shift - BITS)
        inner = _with_plan(rows, open_).filter("place >= lo and place < hi").groupBy("source", F.shiftright("place", shift).alias("cell")).agg(F.sum("tokens").alias("n"))
        plan = stored(plan.filter(F.col("size") <= EDGE).unionByName(_cut(stored(inner, "mix-cells"), open_.drop("size"), shift)), "mix-plan")
    dealt = _with_plan(rows, plan)

    # whole epochs, and what the partial epoch takes by whole blocks
    count = F.col("whole") + (F.col("place") < F.col("lo")).cast("int")
    repeated = dealt.filter(count > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0), count - 1)))
    # the little of a source where the budget ends: documents in order while they fit
    edge = dealt.filter("place >= lo and place < hi and room > 0")
    run = F.sum("tokens").over(Window.partitionBy("s").orderBy("place", "row.doc_id", "tokens").rowsBetween(Window.unboundedPreceding, 0))
    last = edge.withColumn("run", run).filter("run <= room").drop("run").withColumn("epoch", F.col("whole"))
    block = F.shiftright("place", PLACE - BITS).cast("int")
    return repeated.unionByName(last).select(
        "row.*", F.col("epoch").alias("__epoch"), block.alias("__block"),
        F.xxhash64(F.lit(seed), "epoch", "source", block).alias("__order"),
        F.xxhash64(F.lit(seed), "epoch", "place").alias("__place"),
        F.col("weight").alias("__weight"), F.col("tokens").alias("__tokens"),
    )


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = mix(documents(spark, sf_dir).select("doc_id", "source", "text"))
    return dealt.select("doc_id", "source", F.col("__tokens").alias("n_tokens"), F.round("__weight", 9).alias("weight"), F.col("__epoch").alias("epoch"), F.col("__block").alias("block"), F.col("__order").alias("block_order"), F.col("__place").alias("place"))


def mixed(docs: DataFrame) -> DataFrame:
    """The mixture with the columns of ``docs`` alone."""
    return mix(docs).select(*docs.columns)


def mix_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of ``op6_mix`` SQL can express: weights, and how much is dealt of each source."""
    docs = documents(spark, sf_dir).groupBy("source").agg(F.sum(tokens(F.col("text"))).alias("n"))
    return epochs(docs).select("source", "n", F.round("weight", 6).alias("weight"), "whole", "rest")


PLAN_SQL = f"""
WITH s AS (
  SELECT source, CAST(sum(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))) AS BIGINT) AS n FROM documents GROUP BY source
), x AS (
  SELECT CAST(max(n) AS DOUBLE) / min(n) AS ratio, CAST((SELECT sum(n) FROM s) AS DOUBLE) AS total FROM s WHERE n > 0
), p AS (
  SELECT source, n, CASE WHEN n > 0 THEN exp(CASE WHEN ratio > {MAX_REPEAT} THEN 1 - ln({MAX_REPEAT}) / ln(ratio) ELSE 0 END * ln(n / total)) ELSE 0 END AS p FROM s, x
), w AS (
  SELECT source, n, p / sum(p) OVER () AS weight FROM p
), e AS (
  SELECT *, CASE WHEN weight > 0 THEN (SELECT max(ceil(n / weight)) FROM w WHERE n > 0) * weight / n ELSE 1.0 END AS part FROM w
)
SELECT source, n, round(weight, 6) AS weight, CAST(floor(part + 1e-6) AS INTEGER) AS whole, CAST(round(greatest(part - floor(part + 1e-6), 0) * n) AS BIGINT) AS rest FROM e
"""

QUERIES = {"op6_mix": op6_mix, "mix_plan": mix_plan}
ORACLES = {"mix_plan": PLAN_SQL}
