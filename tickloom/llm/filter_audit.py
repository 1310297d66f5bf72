"""Interaction of quality filters over all their orders, enumerated by a recursive CTE."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tickloom.llm.common import WORD, text_or_empty
from tickloom.session import stage

#: Failure conditions A to D read a text alone, E compares it with the texts of smaller ids.
LETTERS = "ABCDE"
MIN_WORDS, DISTINCT_PCT, CAPITALS_PCT = 200, 50, 2
SYMBOLS = "[#$%&*|]"
#: Rows without an id are spread over so many keys where labels are looked up.
_SALTS = 64


def text_mask(text: Column) -> Column:
    """Bits of the filters A to D that a text fails (bit 0 is A)."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    capitals = F.regexp_count(text, F.lit("[A-Z]"))
    fails = (
        F.size(words) < MIN_WORDS,
        F.size(F.array_distinct(words)) * 100 < F.size(words) * DISTINCT_PCT,
        capitals.cast("long") * 100 > F.char_length(text).cast("long") * CAPITALS_PCT,
        text.rlike(SYMBOLS),
    )
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0)).cast("int")


def mask_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents per ``part`` and mask of failed filters: ``n``, and those labelled ``good`` and ``toxic``.

    ``docs`` has ``doc_id``, ``text`` and ``source``; ``labels`` has ``doc_id``, ``quality`` and ``toxic``. Every
    row counts as a document, repeated ids too. A null text is an empty one, a null source the part ''. A row fails E
    where a row with the same text has a smaller id; rows without an id are neither earlier nor later than others, so
    they pass E, and have no labels. Of repeated labels of an id one that is set suffices; null labels are not set.
    Empty tables give no cells. Other columns are ignored.

    Texts are read once and leave as a digest of 256 bits with their bits. Copies of a text are counted per
    (digest, part, id) and (digest, part) before anything gathers them, and only their smallest id meets the
    other parts, so a text or a source with a third of all rows is spread over the tasks.
    """
    digest = F.unhex(F.sha2(text_or_empty("text"), 256))
    narrow = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), text_mask(text_or_empty("text")).alias("bits"), digest.alias("digest"))
    narrow = stage(narrow, "audit-docs")
    flags = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(
        *[F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0))).alias(f"_{c}") for c in ("quality", "toxic")]
    )
    salt = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("digest", "part"), F.lit(_SALTS))).otherwise(F.lit(0).cast("long"))
    marked = narrow.withColumn("_salt", salt).join(
        flags.withColumn("_none", F.lit(0).cast("long")), (F.col("doc_id") == F.col("_id")) & (F.col("_salt") == F.col("_none")), "left"
    )
    sums = [F.sum(c).alias(c) for c in ("n", "good", "toxic")]
    per_id = marked.groupBy("digest", "part", "bits", "doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("_quality"), F.lit(0)).alias("good"), F.coalesce(F.sum("_toxic"), F.lit(0)).alias("toxic")
    )
    here = F.struct("n", "good", "toxic")
    unknown = F.col("doc_id").isNull()
    per_text = stage(per_id.groupBy("digest", "part", "bits").agg(
        *sums, F.min("doc_id").alias("lowest"), F.min_by(F.when(~unknown, here), "doc_id").alias("at"),
        *[F.sum(F.when(unknown, F.col(c)).otherwise(0)).alias(f"_{c}") for c in ("n", "good", "toxic")],
    ), "audit-texts")
    firsts = per_text.groupBy(F.col("digest").alias("_digest")).agg(F.min("lowest").alias("first"))
    met = per_text.join(firsts, F.col("digest") == F.col("_digest"))
    first_here = F.col("lowest").isNotNull() & (F.col("lowest") == F.col("first"))
    passed = {c: F.col(f"_{c}") + F.when(first_here, F.col("at")[c]).otherwise(0) for c in ("n", "good", "toxic")}
    unique = F.struct(F.col("bits").alias("mask"), *[passed[c].alias(c) for c in passed])
    copies = F.struct(F.col("bits").bitwiseOR(F.lit(16)).alias("mask"), *[(F.col(c) - passed[c]).alias(c) for c in passed])
    rows = met.select("part", F.explode(F.array(unique, copies)).alias("c")).select("part", "c.*").where("n > 0")
    return rows.groupBy("part", "mask").agg(*sums)


def audit_orders(cells: DataFrame, letters: Sequence[str] = LETTERS) -> DataFrame:
    """Metrics of each filter at each step of every order of ``letters``, per part.

    ``cells`` has one row per ``part`` and ``mask`` (bit i: fails the i-th filter) with ``n``, ``good`` and ``toxic``; the
    result has ``part``, ``filter_order``, ``step`` and the counts ``kept``, ``removed``, ``redundant``, ``unique_fails``,
    ``good_lost``, ``toxic_lost`` and ``shapley``. A recursive query extends every prefix of filters by each unused
    letter, joins the part's cells and carries the applied bits; a level of the recursion emits the metrics of its step.
    Orders that share a prefix share its rows: 325 per part for five filters. A prefix of k letters begins (n - k)!
    orders, so that is the weight of its removals in ``shapley``. No cells give no rows.

    The cells of a part are at most 2**n. The letters are given by the caller; each more makes the result n times longer.
    """
    n = len(letters)
    if not 1 <= n <= 8 or len(set(letters)) != n or any(len(x) != 1 for x in letters):
        raise ValueError("one to eight different letters")
    packed = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    packed = stage(packed, "audit-cells")
    values = ", ".join(f"('{x}', {1 << i})" for i, x in enumerate(letters))

    def total(what: str, where: str) -> str:
        return f"aggregate(filter(c.cells, x -> {where}), 0L, (s, x) -> s + x.{what})"

    here = "(x.mask & w.applied) = 0 AND (x.mask & f.bit) != 0"
    walk = cells.sparkSession.sql(
        f"""
        WITH RECURSIVE walk(part, prefix, applied, step, letter, kept, removed, redundant, unique_fails, good_lost, toxic_lost) AS (
          SELECT part, '', 0, 0, '', 0L, 0L, 0L, 0L, 0L, 0L FROM {{cells}}
          UNION ALL
          SELECT w.part, concat(w.prefix, f.letter), w.applied | f.bit, w.step + 1, f.letter,
                 {total('n', '(x.mask & (w.applied | f.bit)) = 0')},
                 {total('n', here)},
                 {total('n', '(x.mask & w.applied) != 0 AND (x.mask & f.bit) != 0')},
                 {total('n', 'x.mask = f.bit')},
                 {total('good', here)},
                 {total('toxic', here)}
          FROM walk w
          JOIN (VALUES {values}) f(letter, bit) ON (w.applied & f.bit) = 0
          JOIN {{cells}} c ON c.part = w.part
        )
        SELECT * FROM walk WHERE step > 0 LIMIT ALL
        """,
        cells=packed,
    )
    walk = stage(walk.drop("applied"), "audit-prefixes")
    orders_left = F.factorial(F.lit(n) - F.col("step"))
    worth = walk.groupBy(F.col("part").alias("_part"), F.col("letter").alias("_letter")).agg(F.sum(F.col("removed") * orders_left).alias("shapley"))
    # n! orders of n steps, whatever the data.
    orders = walk.where(F.col("step") == n).select(F.col("prefix").alias("filter_order")).distinct()
    steps = orders.select("filter_order", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("_step"))
    steps = steps.withColumn("_prefix", F.substr("filter_order", F.lit(1), F.col("_step")))
    valued = walk.join(worth, (F.col("part") == F.col("_part")) & (F.col("letter") == F.col("_letter")))
    return valued.join(F.broadcast(steps), F.col("prefix") == F.col("_prefix")).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """:func:`audit_orders` of the five filters over ``docs``; see :func:`mask_cells` for odd rows."""
    return audit_orders(mask_cells(docs, labels))
