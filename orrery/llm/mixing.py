"""Mixing sources to target weights.

Tokens are summed per source, targets follow from the weights under a cap on
repetition, and each document is emitted floor(rate) times plus at most once
more, by a draw that is seeded with its id.

Nothing but per-source sums crosses the network before the documents meet their
source's plan: one row for each source, and one for each source and slice of the
draw. The plan is broadcast if it is counted to be short; else the join is left to the
optimiser, which splits hot sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm.common import draw32, free_name, materialise, n_words, table

#: Slices of the draw for which words are counted: the cut of a source is moved
#: to the slice where its drawn words come nearest to the wanted fraction.
SLICES = 4096
#: Sources whose plan is broadcast at most; with more the documents meet it in a shuffle, which may split hot sources.
BROADCAST_ROWS = 100_000


def source_targets(sizes: DataFrame, weights=(3, 1, 2), share=1.5, max_repeat=2) -> DataFrame:
    """Per source: source, source_size long, target double.

    sizes has columns source and size. Sources take the weights in code-point
    order, null last, repeating. Together they get share times all words; a
    target stops at max_repeat times its source's size and the excess goes to
    the others by weight. That fixed point has a closed form: with sources in
    ascending order of cap / weight, a source is capped where its ratio is at
    most (total - caps before) / (weights from here on).

    The windows run over one row for each source, never over documents.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("_i", (F.row_number().over(by_name) - 1) % len(weights))
    per = per.withColumn("_w", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), F.col("_i") + 1).cast("long"))
    per = per.withColumn("_cap", F.col("source_size") * max_repeat).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    every = Window.partitionBy()
    before = Window.orderBy("_ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_total", F.sum("source_size").over(every) * F.lit(float(share)))
    per = per.withColumn("_left", F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0)))
    per = per.withColumn("_weights", F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0)))
    per = per.withColumn("_capped", F.col("_ratio") <= F.col("_left") / F.col("_weights"))
    open_w = F.sum(F.when(~F.col("_capped"), F.col("_w"))).over(every)
    level = (F.col("_total") - F.coalesce(F.sum(F.when(F.col("_capped"), F.col("_cap"))).over(every), F.lit(0))) / open_w
    target = F.when(F.col("_capped"), F.col("_cap").cast("double")).otherwise(F.col("_w") * level)
    return per.select("source", "source_size", target.alias("target"))


def _slice(key: Column, seed: str) -> Column:
    return F.shiftright(draw32(key, seed), 20).cast("int")


def plan_mix(sizes: DataFrame, **params) -> DataFrame:
    """Per source: source_size, target, copies (whole), fraction and cut.

    sizes has columns source, size, slice. It is summed by source and slice once; all
    else works on those sums, written to the shared folder. The extra copy goes to documents whose
    slice is below cut, so that a document's chance is cut / SLICES. Over seeds that is
    the fraction of the rate, for long documents and short ones alike; for the seed at hand
    the cut is the slice border at which the source's words below it come
    nearest to fraction x words, so that the sum does not stray by the luck of a few
    long documents. It lies no further from the fraction than plain draws would let the
    words stray: |cut / SLICES - fraction| <= max over borders of
    |share of words below the border - border / SLICES| + the heaviest slice's share,
    which is about 1 / sqrt(n) for n documents of one size.
    """
    cells = materialise(sizes.groupBy("source", "slice").agg(F.sum("size").alias("size")))
    targets = source_targets(cells, **params)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    targets = targets.withColumn("copies", F.floor(rate).cast("long")).withColumn("fraction", rate - F.col("copies")).withColumn("_want", F.col("target") - F.col("copies") * F.col("source_size"))
    upto = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.withColumn("_upto", F.sum("size").over(upto))
    joined = cells.alias("c").join(targets.alias("t"), F.col("c.source").eqNullSafe(F.col("t.source")))
    own = ["source_size", "target", "copies", "fraction", "_want"]
    joined = joined.select("t.source", *own, "slice", "_upto")
    nearest = F.min(F.struct(F.abs(F.col("_upto") - F.col("_want")).alias("gap"), (F.col("slice") + 1).alias("cut")))
    plan = joined.groupBy("source", *own).agg(nearest.alias("_best"))
    cut = F.when(F.col("_best.gap") < F.col("_want"), F.col("_best.cut")).otherwise(F.lit(0))
    return plan.select("source", "source_size", "target", "copies", "fraction", cut.alias("cut"))


def mix(docs: DataFrame, seed: str = "mix", id_col="doc_id", text_col="text", source_col="source", **params) -> DataFrame:
    """docs with size, source_size, target, copies (times that the mix takes the row).

    Null text and empty text have size 0; null sources form one source, the last.
    Rows with equal ids get equal draws. An empty table gives an empty result.
    Columns of docs that carry the names of results are replaced by the results;
    others may have any name.
    """
    mark, results = free_name(docs), ["size", "source_size", "target", "copies"]
    base = docs.withColumns({mark + "size": n_words(F.col(text_col)), mark + "slice": _slice(F.col(id_col), seed)})
    plan = plan_mix(base.select(F.col(source_col).alias("source"), F.col(mark + "size").alias("size"), F.col(mark + "slice").alias("slice")), **params)
    plan = materialise(plan.select(*[F.col(c).alias(mark + "plan_" + c) for c in plan.columns]))
    plan = F.broadcast(plan) if plan.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else plan
    out = base.join(plan, F.col(source_col).eqNullSafe(F.col(mark + "plan_source")), "left")
    copies = F.col(mark + "plan_copies") + F.when(F.col(mark + "slice") < F.col(mark + "plan_cut"), 1).otherwise(0)
    made = [F.col(mark + "size").alias("size"), F.col(mark + "plan_source_size").alias("source_size"), F.col(mark + "plan_target").alias("target"), copies.alias("copies")]
    return out.select(*[F.col(f"`{c}`") for c in docs.columns if c not in results], *made)


def emit(mixed: DataFrame) -> DataFrame:
    """Each row as often as its column copies says; the columns size .. copies go."""
    copy = free_name(mixed)
    return mixed.where("copies > 0").withColumn(copy, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop(copy, "size", "source_size", "target", "copies")


def op3_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    taken = (F.col("copies") * F.col("size")).cast("long")
    return mix(docs).select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def mixing_sql(docs: str = "documents") -> str:
    """WITH parts that end in mix_rows(rid, copies, ...): the rows of docs with their copies."""
    return rf"""
mix_base AS (SELECT *, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT >> 20 AS slice FROM {docs}),
mix_src AS (SELECT source, sum(size)::BIGINT AS source_size FROM mix_base GROUP BY source),
mix_w AS (SELECT *, [3, 1, 2][1 + (row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % 3]::BIGINT AS w FROM mix_src),
mix_cap AS (SELECT *, source_size * 2 AS cap, (source_size * 2)::DOUBLE / w::DOUBLE AS ratio, sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE AS total FROM mix_w),
mix_cum AS (SELECT *, total - coalesce(sum(cap) OVER o, 0)::DOUBLE AS rest, (sum(w) OVER () - coalesce(sum(w) OVER o, 0))::DOUBLE AS ws
    FROM mix_cap WINDOW o AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
mix_is AS (SELECT *, ratio <= rest / ws AS capped FROM mix_cum),
mix_lvl AS (SELECT *, (total - coalesce(sum(cap) FILTER (capped) OVER (), 0)::DOUBLE) / (sum(w) FILTER (NOT capped) OVER ())::DOUBLE AS lvl FROM mix_is),
mix_t AS (SELECT source, source_size, CASE WHEN capped THEN cap::DOUBLE ELSE w::DOUBLE * lvl END AS target FROM mix_lvl),
mix_r AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size::DOUBLE) ELSE 0 END::BIGINT AS whole FROM mix_t),
mix_want AS (SELECT *, target - (whole * source_size)::DOUBLE AS want FROM mix_r),
mix_cell AS (SELECT source, slice, sum(sum(size)) OVER (PARTITION BY source ORDER BY slice)::DOUBLE AS upto FROM mix_base GROUP BY source, slice),
mix_best AS (SELECT t.source, t.source_size, t.target, t.whole, t.want, min({{'gap': abs(upto - want), 'cut': slice + 1}}) AS best
    FROM mix_cell c JOIN mix_want t ON c.source IS NOT DISTINCT FROM t.source GROUP BY ALL),
mix_plan AS (SELECT *, CASE WHEN best.gap < want THEN best.cut ELSE 0 END AS cut FROM mix_best),
mix_rows AS (SELECT b.*, p.source_size, p.target, p.whole + CASE WHEN b.slice < p.cut THEN 1 ELSE 0 END AS copies
    FROM mix_base b JOIN mix_plan p ON b.source IS NOT DISTINCT FROM p.source)"""


OP3_SQL = f"WITH {mixing_sql()} SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken FROM mix_rows"
