"""Divergence of sources from each other and from their language, over terms found by iceberg prefix refinement."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tickloom.llm.common import text_or_empty
from tickloom.plans.ranking import number_rows
from tickloom.session import stage

#: A term is kept in a language if so many of its documents hold it; added to every count; parts of a whole.
MIN_DOCS, SMOOTHING, UNIT = 30, 5, 1_000_000_000
#: Ranks of the terms of a group.
TOP = 50
#: A tile of the pair distances: terms, and sources on either side.
TERM_BLOCK, SOURCE_BLOCK = 512, 256
#: Prefixes start with 2**FIRST_LEVEL bytes and double.
FIRST_LEVEL = 2
#: Bytes of text that a task counts at once (a longer text is counted by itself).
_CHUNK_BYTES = 6 << 20

#: Bytes outside terms become blanks and capitals small letters. Bytes of a character beyond ASCII all lie above 127.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256)
)

def _tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of each term of the texts: its text, its rank among the distinct terms; and these in byte order."""
    data = np.frombuffer(b" ".join(texts).translate(_FOLD), np.uint8)
    inside = data != 32
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    ends = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths, out=ends[1:])
    buffers = [None, pa.py_buffer(ends), pa.py_buffer(data[inside])]
    coded = pa.Array.from_buffers(pa.large_binary(), len(starts), buffers).dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    firsts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return np.searchsorted(firsts, starts, "right") - 1, rank[coded.indices.to_numpy()], coded.dictionary.take(order)


def _levels(doc: np.ndarray, code: np.ndarray, terms: pa.Array) -> np.ndarray:
    """Level of each (text, term), sorted by both: the first k where 2**k bytes part it from the text's term before.

    The end of a term counts as a byte, so different terms part at last. Two terms share a prefix
    if no neighbours between them in the order of all terms differ in it.
    """
    level = np.full(len(doc), FIRST_LEVEL, np.int32)
    open_ = np.flatnonzero(doc[1:] == doc[:-1]) + 1
    k = FIRST_LEVEL
    while len(open_):
        cut = pc.binary_slice(terms, 0, 1 << k)
        run = np.zeros(len(terms), np.int64)
        np.cumsum(pc.not_equal(cut[1:], cut[:-1]).to_numpy(zero_copy_only=False), out=run[1:])
        open_ = open_[run[code[open_]] == run[code[open_ - 1]]]
        k += 1
        level[open_] = k
    return level


def _count_chunk(texts: list[bytes], groups: list[tuple[str, str]]) -> pa.RecordBatch | None:
    doc, code, terms = _tokens(texts)
    if not len(doc):
        return None
    named: dict[tuple, int] = {}
    group = np.array([named.setdefault(g, len(named)) for g in groups], np.int64)
    pairs, n = np.unique(doc * len(terms) + code, return_counts=True)
    doc, code = np.divmod(pairs, len(terms))
    level = _levels(doc, code, terms)
    top = int(level.max()) + 1
    key = (group[doc] * len(terms) + code) * top + level
    order = np.argsort(key, kind="stable")
    key = key[order]
    at = np.flatnonzero(np.diff(key, prepend=-1))
    found, level = np.divmod(key[at], top)
    group, code = np.divmod(found, len(terms))
    name = lambda i: pa.array([g[i] for g in named], pa.string()).take(pa.array(group))
    return pa.RecordBatch.from_arrays(
        [name(0), name(1), terms.take(pa.array(code)).cast(pa.binary()), pa.array(level.astype(np.int32)),
         pa.array(np.diff(at, append=len(key))), pa.array(np.add.reduceat(n[order], at))],
        ["lang", "source", "term", "level", "docs", "n"],
    )


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of (lang, source, term, level) over the documents of a task, chunk by chunk.

    A prefix of 2**level bytes or more (see :func:`_levels`) is new to the document at the term, a shorter one was met at
    a term before, so documents per prefix can be summed from these rows.
    """
    texts, groups, size = [], [], 0
    for batch in batches:
        for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text"))):
            texts.append(text)
            groups.append((lang, source))
            size += len(text)
            if size >= _CHUNK_BYTES:
                if (out := _count_chunk(texts, groups)) is not None:
                    yield out
                texts, groups, size = [], [], 0
    if texts and (out := _count_chunk(texts, groups)) is not None:
        yield out


def term_counts(docs: DataFrame) -> DataFrame:
    """Per (lang, source, term, level): ``docs`` and occurrences ``n``, see :func:`_count_terms`.

    Tasks add up their own documents first, so a frequent term leaves a task as a few rows.
    """
    named = docs.select(text_or_empty("lang").alias("lang"), text_or_empty("source").alias("source"), text_or_empty("text").cast("binary").alias("text"))
    rows = named.mapInArrow(_count_terms, "lang string, source string, term binary, level int, docs long, n long")
    return rows.groupBy("lang", "source", "term", "level").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))


def kept_terms(counts: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """The terms (``lang``, ``term``) that at least ``min_docs`` documents of the language hold.

    Prefixes of 4, 8, 16, ... bytes are refined level by level. At a level every prefix that is left is counted with
    the distinct documents that hold a term below it; terms under a prefix short of ``min_docs`` are discarded, terms
    that end inside the prefix are complete and kept, and the others go on to the next level. Prefixes double, so
    the levels follow the logarithm of the longest kept term. ``counts`` is a stored result of :func:`term_counts`.
    """
    left = counts.groupBy("lang", "term", "level").agg(F.sum("docs").alias("docs"))
    complete, k = [], FIRST_LEVEL
    while True:
        prefix = F.substring(F.concat("term", F.lit(b"\0")), 1, 1 << k)
        left = left.withColumn("_prefix", prefix)
        if k == FIRST_LEVEL:
            left = stage(left, "terms")
        frequent = left.groupBy(F.col("lang").alias("_lang"), F.col("_prefix").alias("_own")).agg(
            F.sum(F.when(F.col("level") <= k, F.col("docs")).otherwise(0)).alias("_docs")
        ).where(F.col("_docs") >= min_docs)
        left = left.join(frequent, (F.col("lang") == F.col("_lang")) & (F.col("_prefix") == F.col("_own")), "left_semi").drop("_prefix")
        left = stage(left, f"terms-{k}")
        ends = F.octet_length("term") < (1 << k)
        complete.append(left.where(ends).select("lang", "term").distinct())
        left = left.where(~ends)
        if left.isEmpty():
            break
        k += 1
    kept = complete[0]
    for more in complete[1:]:
        kept = kept.unionByName(more)
    return stage(kept, "kept-terms")


def _share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (n + SMOOTHING) / (total + SMOOTHING * terms)), in exact arithmetic; null without terms."""
    whole = lambda c: c.cast("decimal(24,0)")
    top = F.lit(UNIT).cast("decimal(10,0)") * (whole(n) + SMOOTHING)
    bottom = F.nullif(whole(total) + whole(terms) * SMOOTHING, F.lit(0).cast("decimal(24,0)"))
    # An integral division: what top is beyond a multiple of bottom is taken off first.
    return (F.lit(1) + ((top - top % bottom) / bottom)).cast("long")


def _tile_distances(source_block: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """Sum over a tile's terms of abs(p - q) less the distance of the two shares without occurrences."""

    def distances(key: tuple, tile: pd.DataFrame) -> pd.DataFrame:
        lang_no, _, low, high = key
        named = tile["term"].notna()
        bases = tile[~named].drop_duplicates("no").sort_values("no")
        numbers, base = bases["no"].to_numpy(np.int64), bases["p"].to_numpy(np.int64)
        rows = tile[named]
        codes, terms = pd.factorize(rows["term"])
        shares = np.repeat(base[:, None], len(terms), axis=1)
        shares[np.searchsorted(numbers, rows["no"].to_numpy(np.int64)), codes] = rows["p"].to_numpy(np.int64)
        block = numbers // source_block
        a, b = np.flatnonzero(block == low), np.flatnonzero(block == high)
        more = np.zeros((len(a), len(b)), np.int64)
        for at, i in enumerate(a):
            more[at] = (np.abs(shares[b] - shares[i]) - np.abs(base[b] - base[i])[:, None]).sum(axis=1)
        out = pd.DataFrame({"a": np.repeat(numbers[a], len(b)), "b": np.tile(numbers[b], len(a)), "more": more.ravel()})
        if low != high:
            out = pd.concat([out, out.rename(columns={"a": "b", "b": "a"})])
        return out[out["a"] != out["b"]].assign(lang_no=lang_no)[["lang_no", "a", "b", "more"]]

    return distances


def _pair_values(shares: DataFrame, groups: DataFrame, term_block: int, source_block: int) -> DataFrame:
    """Distance of each two sources of a language, over all its kept terms.

    A source has one share for all terms that it lacks, so terms that neither of two sources holds need no rows: the
    sum is (all terms) * (distance of those shares) + what the terms held differ from it. That is summed in tiles of
    ``term_block`` terms by two blocks of ``source_block`` sources, each a dense matrix of bounded size in a task of
    its own. Rows are sent once per block of other sources; the pairs themselves are the result.
    """
    top = groups.agg(F.max("terms")).first()[0] or 0
    blocks = max(1, -(-top // term_block))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)).alias("_other")
    own = F.floor(F.col("no") / source_block)
    in_term_block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("tb")
    bases = groups.select("lang_no", "no", "_blocks", F.coalesce("base", F.lit(0)).alias("p"), F.lit(None).cast("binary").alias("term"), in_term_block)
    held = shares.select("lang_no", "no", "_blocks", "p", "term", F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("int").alias("tb"))
    rows = bases.unionByName(held).select("*", other)
    rows = rows.select("lang_no", "tb", F.least(own, "_other").alias("low"), F.greatest(own, "_other").alias("high"), "no", "term", "p")
    summed = rows.groupBy("lang_no", "tb", "low", "high").applyInPandas(_tile_distances(source_block), "lang_no long, a long, b long, more long")
    summed = summed.groupBy("lang_no", "a", "b").agg(F.sum("more").alias("more"))
    side = lambda s: groups.select(F.col("lang_no").alias(f"_l{s}"), F.col("no").alias(f"_n{s}"), F.col("source").alias(f"_s{s}"),
                                   F.coalesce("base", F.lit(0)).alias(f"_p{s}"), F.col("terms").alias(f"_t{s}"), F.col("lang").alias(f"_g{s}"))
    met = summed.join(side(1), (F.col("lang_no") == F.col("_l1")) & (F.col("a") == F.col("_n1")))
    met = met.join(side(2), (F.col("lang_no") == F.col("_l2")) & (F.col("b") == F.col("_n2")))
    value = F.col("_t1") * F.abs(F.col("_p1") - F.col("_p2")) + F.col("more")
    return met.select(F.col("_g1").alias("lang"), F.col("_s1").alias("source"), F.lit("pair").alias("part"), F.col("_s2").alias("item"), value.alias("value"))


def audit_sources(
    docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, term_block: int = TERM_BLOCK, source_block: int = SOURCE_BLOCK
) -> DataFrame:
    """How the sources of each language differ in their terms.

    ``docs`` has ``text``, ``lang`` and ``source``, null read as ''; every row is a document. Terms are runs of ASCII
    letters and characters beyond ASCII, with A-Z in lower case; kept are those of :func:`kept_terms`. A (lang, source)
    group and a language give each kept term a smoothed share, see :func:`_share`. The result has ``lang``, ``source``,
    ``part``, ``item``, ``value`` and ``rank`` (by value descending, then item in byte order):

    * part ``pair``: every other source of the language, with the summed distance of the shares of all kept terms
      (0 without any), all ranks;
    * part ``term``: the ``top`` terms of the group whose share exceeds the language's most.

    Empty texts and groups without kept terms have the shares of no occurrences. A language with one source has no
    pairs. An empty table gives an empty result; other columns are ignored. Long texts are read whole; a task holds
    the counts of its own documents up to a bound and passes them on.
    """
    counts = stage(term_counts(docs), "term-counts")
    kept = kept_terms(counts, min_docs).select(F.col("lang").alias("_lang"), F.col("term").alias("_term"))
    same = lambda other: (F.col("lang") == F.col("_lang")) & (F.col("term") == other)
    # One layout by (lang, term) serves the join, the counts and the language's sums: a term has a row per source there.
    found = counts.join(kept, same(F.col("_term"))).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"))
    found = stage(found.withColumn("_n", F.sum("n").over(W.partitionBy("lang", "term"))), "kept-counts")

    groups = stage(docs.select(text_or_empty("lang").alias("lang"), text_or_empty("source").alias("source")).distinct(), "groups")
    groups = stage(number_rows(groups, ["lang"], ["source"], out="no", total="_sources"), "groups")
    langs = number_rows(stage(groups.groupBy("lang").agg(F.max("_sources").alias("_sources")), "langs"), [], ["lang"], out="lang_no")
    sizes = kept.groupBy("_lang").agg(F.count(F.lit(1)).alias("terms"))
    langs = langs.join(sizes, F.col("lang") == F.col("_lang"), "left").select(
        F.col("lang").alias("_g"), "lang_no", F.coalesce("terms", F.lit(0)).alias("terms"), F.ceil(F.col("_sources") / source_block).alias("_blocks")
    )
    totals = found.groupBy(F.col("lang").alias("_l"), F.col("source").alias("_s")).agg(F.sum("n").alias("total"))
    groups = groups.join(langs, F.col("lang") == F.col("_g")).join(
        totals, (F.col("lang") == F.col("_l")) & (F.col("source") == F.col("_s")), "left"
    )
    groups = groups.select("lang", "source", "no", "lang_no", "terms", "_blocks", F.coalesce("total", F.lit(0)).alias("total"))
    groups = groups.withColumn("base", _share(F.lit(0), F.col("total"), F.col("terms")))
    groups = stage(groups, "group-shares")

    of_group = groups.select(F.col("lang").alias("_l"), F.col("source").alias("_s"), "no", "lang_no", "terms", "_blocks", "total")
    shares = found.join(of_group, (F.col("lang") == F.col("_l")) & (F.col("source") == F.col("_s")))
    shares = shares.withColumn("p", _share(F.col("n"), F.col("total"), F.col("terms"))).drop("_l", "_s", "total")
    lang_totals = groups.groupBy(F.col("lang").alias("_g")).agg(F.sum("total").alias("_total"))
    shares = shares.join(lang_totals, F.col("lang") == F.col("_g"))
    shares = stage(shares.withColumn("q", _share(F.col("_n"), F.col("_total"), F.col("terms"))).select(
        "lang", "source", "term", "no", "lang_no", "_blocks", "p", "q"), "shares")

    best = W.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    pairs = _pair_values(shares, groups, term_block, source_block).withColumn("rank", F.row_number().over(best))
    terms = shares.where("p > q").select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), (F.col("p") - F.col("q")).alias("value")
    ).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return pairs.unionByName(terms)
