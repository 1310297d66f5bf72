"""Mixing sources to target weights by Pareto order sampling (DataFrame functions only)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tickloom.llm.common import count_words, prefix_sum, unit_hash
from tickloom.plans.ranking import number_rows
from tickloom.session import stage

#: Weights of the sources in code point order, repeating.
WEIGHTS = (3, 1, 2)
#: Words of the mix as a share of all words, and the most copies of a document.
SHARE, MAX_COPIES = 1.5, 2


def water_level(sources: DataFrame, share: float, cap: int) -> float:
    """The level t at which targets least(cap * size, t * weight) add up to share * all sizes.

    ``sources`` (one row per source, stored) is aggregated once per round; a round only adds
    sources that reach their cap, and what they leave is shared again by weight.
    """
    level = 0.0
    full = F.col("source_size") * F.lit(cap) <= F.lit(0)
    while True:
        capped, weight, total, n = sources.agg(
            F.sum(F.when(full, F.col("source_size") * cap).otherwise(0)),
            F.sum(F.when(~full, F.col("weight")).otherwise(0)),
            F.sum("source_size"),
            F.sum(F.when(full, 1).otherwise(0)),
        ).first()
        if not weight:
            return level
        level = (min(share, float(cap)) * total - capped) / weight
        full = F.col("source_size") * cap <= F.lit(level) * F.col("weight")
        if sources.where(full).count() == n:
            return level


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = MAX_COPIES
) -> DataFrame:
    """One row per source: ``source_size``, ``weight`` and ``target`` words.

    ``sizes`` has ``source`` and ``size``. Sources are weighted in code point order, null last.
    """
    totals = stage(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    ranked = number_rows(totals, [], [F.col("source").asc_nulls_last()], out="_rank")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    ranked = stage(ranked.withColumn("weight", weight).drop("_rank"), "weighted")
    level = water_level(ranked, share, cap)
    target = F.least(F.col("source_size").cast("double") * cap, F.lit(level) * F.col("weight"))
    return ranked.withColumn("target", target)


def mix_sources(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    cap: int = MAX_COPIES,
    affinity: str | None = None,
    seed: str = "mix",
    row: Sequence[str] = (),
) -> DataFrame:
    """Copies of every document so that each source's words meet its target.

    ``docs`` has ``doc_id``, ``text`` and ``source``; the result has one row per input row with
    ``doc_id``, ``size`` (words), ``source_size``, ``target``, ``copies`` and ``taken``. A source is
    to be read target / source_size times: the whole part is certain copies of each document, the
    fractional part f is a Pareto sample: documents are ranked by the odds of a hashed uniform
    number over their inclusion odds f / (1 - f) (times the ``affinity`` column, where given), and
    the head of that order whose words come nearest to f * source_size is taken.

    ``row`` names columns that tell rows apart; they come along in the result, and then the hashed number of a row
    follows from its text as well, so that rows with equal ids, or none, are not drawn together.

    Null or blank texts have size 0 and null sources form a source of their own, ordered last.
    Repeated rows are told apart only by their place in the order. An empty table gives an empty
    result. Other columns are ignored. The hash makes reruns agree. The order is
    a range sort of narrow rows, so a source with a third of all rows spreads over many tasks.
    """
    picked = docs.select(
        "doc_id", "source", count_words("text").alias("size"),
        (F.col(affinity).cast("double") if affinity else F.lit(1.0)).alias("affinity"),
        unit_hash(F.lit(seed), F.col("doc_id"), *([F.md5(F.coalesce("text", F.lit("")))] if row else [])).alias("_u"), *row,
    )
    rows = stage(picked, "mix-sizes")
    targets = stage(source_targets(rows.select("source", "size"), weights, share, cap), "targets")
    t = targets.select(F.col("source").alias("_source"), "source_size", "target")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    joined = rows.join(t, F.col("source").eqNullSafe(F.col("_source"))).withColumn("_rate", rate)
    joined = joined.withColumns({"_whole": F.floor("_rate"), "_part_p": F.col("_rate") - F.floor("_rate")})
    odds = F.col("_part_p") / (1 - F.col("_part_p")) * F.col("affinity")
    joined = joined.withColumn("_q", F.when(odds > 0, F.col("_u") / (1 - F.col("_u")) / odds).otherwise(F.lit(float("inf"))))
    joined = stage(joined.drop("_source", "_u", "_rate", "affinity"), "mix-order")
    summed = prefix_sum(joined, ["source"], ["_q", "doc_id", "size"], "size", "_before")
    extra = F.col("_before") + F.col("size") / 2.0 < F.col("_part_p") * F.col("source_size")
    copies = F.least(F.col("_whole") + F.when(extra, 1).otherwise(0), F.lit(cap)).cast("long")
    return summed.withColumn("copies", copies).select(
        "doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *row
    )
