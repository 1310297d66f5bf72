"""Language identification by fusing text, declared markup, address suffix and host priors.

The log likelihood of the text (letter trigrams) and of the language its markup declares are added
to the log prior of the host. Priors are grouped sums of first-pass posteriors: a host leans on
its address suffix, the suffix on all rows, and a row's own share is left out of its prior. Texts in none
of the fitted languages are told by a floor under the text's likelihood, set by held-out rows.
"""

from __future__ import annotations

import html as html_entities
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tickloom.llm.common import fresh, unit_hash
from tickloom.session import stage

#: Buckets of hashed trigrams; expected labelled rows per language to fit on.
BUCKETS, SAMPLE_ROWS = 1 << 14, 2000
#: Trigrams of one text count as independent up to this many, as neighbours overlap.
MAX_EVIDENCE = 60.0
#: How often a declared language is right, and pseudo counts that pull a host to its suffix and a suffix to all.
DECLARED_RIGHT, HOST_WEIGHT, SUFFIX_WEIGHT = 0.9, 5.0, 20.0
#: A row is accepted with letters in its text, a known language and at least this probability.
MIN_PROBABILITY = 0.5
#: Held-out rows from which a language's usual score is taken, trigrams of such a row, and deviations that chance is given.
MIN_HELD_OUT, HELD_OUT_GRAMS, DEVIATIONS = 20, 50, 3.0

_KEEP = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
_HIDDEN = re.compile(r"(?is)<(script|style)\b.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)|<[^<>]*>")


def visible_text(page: str | None) -> str:
    """The text of a page without markup, scripts, styles and comments."""
    return html_entities.unescape(_HIDDEN.sub(" ", page or ""))


def trigrams(text: str | None) -> np.ndarray:
    """Buckets of the letter trigrams of the whole text in lower case; other characters part words."""
    data = np.frombuffer((" " + (text or "").lower() + " ").encode("utf-8", "replace").translate(_KEEP), np.uint8).astype(np.uint32)
    a, b, c = data[:-2], data[1:-1], data[2:]
    ok = (b != 32) | ((a != 32) & (c != 32))
    return (((a + 251 * b + 63001 * c) * np.uint32(2654435761)) >> np.uint32(18))[ok] & np.uint32(BUCKETS - 1)


class TextModel:
    """Log likelihoods of trigram buckets per language (64 KB each), and the usual score of each language.

    ``usual`` holds two numbers per language, from held-out rows: the median of a row's mean log likelihood and
    the deviation of single trigrams; NaN where too few rows were held out.
    """

    def __init__(self, languages: list[str], table: np.ndarray, usual: np.ndarray | None = None):
        self.languages, self.table = languages, table  # table: BUCKETS x languages
        self.usual = np.full((len(languages), 2), np.nan) if usual is None else usual

    def means(self, grams: np.ndarray) -> np.ndarray:
        """Mean log likelihood of the trigrams under each language."""
        total = np.zeros(len(self.languages))
        for at in range(0, len(grams), 1 << 18):
            total += self.table[grams[at : at + (1 << 18)]].sum(axis=0, dtype=np.float64)
        return total / max(1, len(grams))

    def score(self, text: str | None) -> tuple[int, np.ndarray]:
        """Number of trigrams and the log likelihood of each language, tempered to MAX_EVIDENCE."""
        grams = trigrams(text)
        return len(grams), self.means(grams) * min(len(grams), MAX_EVIDENCE)

    def floor(self, n_grams: int) -> np.ndarray:
        """Mean log likelihood under which a text of so many trigrams is not in the language.

        It lies halfway between the language's own texts and trigrams at random, less what chance may
        take off a short text; neighbours overlap, so a third of the trigrams count as independent. A language
        without held-out rows has no floor.
        """
        median, single = self.usual.T
        halfway = (median + self.table.mean(axis=0, dtype=np.float64)) / 2
        return np.nan_to_num(halfway - DEVIATIONS * single * np.sqrt(3.0 / max(1, n_grams)), nan=-np.inf)

    def is_known(self, n_grams: int, scores: np.ndarray) -> bool:
        """Whether some language explains a text with these ``scores`` (see ``score``) well enough."""
        means = scores / max(1.0, min(n_grams, MAX_EVIDENCE))
        return not len(scores) or not n_grams or bool((means >= self.floor(n_grams)).any())


def _log_shares(counts: np.ndarray) -> np.ndarray:
    return np.log((counts + 0.5) / (counts + 0.5).sum(axis=0)).astype(np.float32)


def fit_text_model(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> TextModel:
    """Fits on a sample of ``labelled`` (``doc_id``, ``text``, ``lang``): about ``sample_rows`` per language, chosen by hash.

    Every language that labels a row is fitted. The sample has two halves; the usual score of a language is that
    of each half's rows under the counts of the other. Sums per half, language and bucket go to the driver.
    """
    counts = {r["lang"]: r["n"] for r in labelled.where("lang is not null").groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return TextModel([], np.zeros((BUCKETS, 0), np.float32))
    languages = sorted(counts)
    place = {x: i for i, x in enumerate(languages)}
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, sample_rows / n)])
    sample = labelled.where(F.col("lang").isin(*counts)).where(unit_hash(F.lit("lang"), F.col("doc_id")) < share[F.col("lang")])
    sample = stage(sample.select("lang", (unit_hash(F.lit("half"), F.col("doc_id")) < 0.5).cast("int").alias("half"), "text"), "labelled")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            for lang, half, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                got = sums.setdefault((lang, half), np.zeros(BUCKETS, np.int64))
                got += np.bincount(trigrams(text.as_py()), minlength=BUCKETS)
        for (lang, half), got in sums.items():
            hit = np.flatnonzero(got)
            yield pa.RecordBatch.from_arrays(
                [pa.array([place[lang]] * len(hit), pa.int32()), pa.array([half] * len(hit), pa.int32()), pa.array(hit), pa.array(got[hit])],
                ["language", "half", "bucket", "n"],
            )

    rows = sample.mapInArrow(count, "language int, half int, bucket long, n long").groupBy("language", "half", "bucket").agg(F.sum("n").alias("n"))
    found = rows.toArrow()
    halves = np.zeros((2, BUCKETS, len(languages)))
    language, half, bucket, n = (found.column(c).to_numpy() for c in ("language", "half", "bucket", "n"))
    halves[half, bucket, language] = n
    others = [TextModel(languages, _log_shares(halves[1 - h])) for h in (0, 1)]

    def held_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: list[list] = [[], [], []]
            for lang, half, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                grams = trigrams(text.as_py())
                if len(grams) >= HELD_OUT_GRAMS:
                    logs = others[half].table[grams, place[lang]].astype(np.float64)
                    for col, v in zip(made, (place[lang], logs.mean(), logs.var())):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(made[0], pa.int32()), *(pa.array(c, pa.float64()) for c in made[1:])], ["language", "mean", "var"])

    usual = np.full((len(languages), 2), np.nan)
    judged = sample.mapInArrow(held_out, "language int, mean double, var double").groupBy("language").agg(
        F.count(F.lit(1)).alias("n"), F.percentile("mean", 0.5).alias("median"), F.sqrt(F.percentile("var", 0.5)).alias("single")
    )
    for r in judged.where(F.col("n") >= MIN_HELD_OUT).collect():
        usual[r["language"]] = r["median"], r["single"]
    return TextModel(languages, _log_shares(halves.sum(axis=0)), usual)


def softmax(scores: np.ndarray) -> np.ndarray:
    powers = np.exp(scores - scores.max(axis=1, keepdims=True)) if scores.size else scores
    return powers / powers.sum(axis=1, keepdims=True) if scores.size else powers


def said(declared: list[str | None], languages: list[str]) -> np.ndarray:
    """Log likelihood of the declared language under each language; 0 where it is none of them."""
    out = np.zeros((len(declared), len(languages)))
    place = {x: i for i, x in enumerate(languages)}
    for row, x in enumerate(declared):
        if x in place:
            out[row] = np.log((1 - DECLARED_RIGHT) / max(1, len(languages) - 1))
            out[row, place[x]] = np.log(DECLARED_RIGHT)
    return out


def _lists(x: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), max(1, x.shape[1])).cast(pa.list_(pa.float64())) if x.size else pa.array([[]] * len(x), pa.list_(pa.float64()))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.array([v or [0.0] * width for v in column.to_pylist()], np.float64).reshape(-1, width)


def text_evidence(rows: DataFrame, model: TextModel, keys: list[str], text: str, reader: Callable | None = None) -> DataFrame:
    """``keys`` (with ``declared``) and ``n_grams``, ``known`` (whether the text is in one of the languages), ``text_lang``,
    ``evidence`` (log likelihood of text and markup per language) and ``p`` (posterior of the evidence alone)."""
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    languages, at = model.languages, keys.index("declared")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scored = [model.score(reader(v.as_py()) if reader else v.as_py()) for v in batch.column(batch.num_columns - 1)]
            grams = [n for n, _ in scored]
            logs = np.array([s for _, s in scored]).reshape(len(scored), len(languages))
            known = [model.is_known(n, x) for n, x in scored]
            best = [languages[i] if n else None for n, i in zip(grams, logs.argmax(axis=1))] if languages else [None] * len(grams)
            evidence = logs + said(batch.column(at).to_pylist(), languages)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(grams, pa.int64()), pa.array(known, pa.bool_()), pa.array(best, pa.string()), _lists(evidence), _lists(softmax(evidence))],
                [*batch.schema.names[:-1], "n_grams", "known", "text_lang", "evidence", "p"],
            )

    schema = ", ".join(f"`{k}` {types[k]}" for k in keys)
    return rows.select(*keys, text).mapInArrow(run, f"{schema}, n_grams long, known boolean, text_lang string, evidence array<double>, p array<double>")


def fuse(rows: DataFrame, languages: list[str]) -> DataFrame:
    """Adds ``lang``, ``probability``, ``host_prior`` (of ``lang``) and ``accepted`` to stored ``text_evidence``.

    ``rows`` has ``host`` and ``suffix`` too; null ones are groups of their own. Hosts are summed
    before they are shuffled.
    """
    n = len(languages)
    sums = lambda c: F.array(*[F.sum(F.get(c, F.lit(i))) for i in range(n)])
    hosts = stage(rows.groupBy("host", "suffix").agg(sums("p").alias("h")), "hosts")
    suffixes = stage(hosts.groupBy("suffix").agg(sums("h").alias("x")), "suffixes")
    world = suffixes.agg(sums("x").alias("g")).first()["g"]  # one number per language
    total = np.array([v or 0.0 for v in world])
    wide = hosts.join(suffixes.withColumnRenamed("suffix", "_sfx"), F.col("suffix").eqNullSafe(F.col("_sfx"))).select(
        F.col("host").alias("_host"), F.col("suffix").alias("_suffix"), "h", "x"
    )
    met = rows.join(wide, F.col("host").eqNullSafe(F.col("_host")) & F.col("suffix").eqNullSafe(F.col("_suffix")), "left")
    kept = [c for c in rows.columns if c not in ("evidence", "p")]
    types = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = dict(zip(batch.schema.names, batch.columns))
            grams = col["n_grams"].to_numpy()
            known = col["known"].to_numpy(zero_copy_only=False)
            if n:
                evidence, p, h, x = (_matrix(col[c], n) for c in ("evidence", "p", "h", "x"))
                less = lambda a: np.maximum(a - p, 0.0)  # without the row's own share
                every = (less(total) + 1.0) / (less(total).sum(axis=1, keepdims=True) + n)
                by_suffix = (less(x) + SUFFIX_WEIGHT * every) / (less(x).sum(axis=1, keepdims=True) + SUFFIX_WEIGHT)
                prior = (less(h) + HOST_WEIGHT * by_suffix) / (less(h).sum(axis=1, keepdims=True) + HOST_WEIGHT)
                post = softmax(evidence + np.log(prior))
                best, top = post.argmax(axis=1), post.max(axis=1)
                lang = [languages[i] for i in best]
                host = prior[np.arange(len(best)), best]
                fine = (grams > 0) & known & (top >= MIN_PROBABILITY)
                made = [pa.array(lang, pa.string()), pa.array(top), pa.array(host), pa.array(fine)]
            else:
                none = pa.nulls(len(grams), pa.float64())
                made = [pa.nulls(len(grams), pa.string()), none, none, pa.array(grams > 0)]
            yield pa.RecordBatch.from_arrays([*(col[c] for c in kept), *made], [*kept, "lang", "probability", "host_prior", "accepted"])

    schema = ", ".join(f"`{c}` {types[c]}" for c in kept)
    return met.select(*kept, "evidence", "p", "h", "x").mapInArrow(
        run, f"{schema}, lang string, probability double, host_prior double, accepted boolean"
    )


def host_of(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def suffix_of(host: Column) -> Column:
    return F.nullif(F.regexp_extract(host, r"([^.]+)\.?$", 1), F.lit(""))


def declared_of(page: Column) -> Column:
    """Primary language that the root element declares, in lower case."""
    found = F.regexp_extract(page, r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([a-z]{2,3})""", 1)
    return F.nullif(F.lower(found), F.lit(""))


def identify_pages(pages: DataFrame, model: TextModel) -> DataFrame:
    """Language of each row of ``pages`` (``page_id``, ``url``, ``html``).

    Columns: ``page_id``, ``lang``, ``probability``, ``text_lang`` (of the text alone), ``declared``,
    ``host``, ``suffix``, ``host_prior``, ``n_grams``, ``known``, ``accepted``. A text nearer to trigrams at random than to the texts
    of any language is not known and not accepted. A null or empty page has no text
    evidence and is not accepted; a null or odd address joins the group without host. Ties go to
    the first language in order. Repeated rows each get a result. Whole pages are read. With a
    model of no languages ``lang`` is null. Other columns are ignored.
    """
    rows = pages.select(
        "page_id", host_of(F.col("url")).alias("host"), suffix_of(host_of(F.col("url"))).alias("suffix"),
        declared_of(F.col("html")).alias("declared"), F.col("html").cast("string").alias("html"),
    )
    scored = text_evidence(rows, model, ["page_id", "host", "suffix", "declared"], "html", visible_text)
    return fuse(stage(scored, "page-evidence"), model.languages).select(
        "page_id", "lang", "probability", "text_lang", "declared", "host", "suffix", "host_prior", "n_grams", "known", "accepted"
    )


def keep_identified(docs: DataFrame, model: TextModel | None = None) -> DataFrame:
    """``docs`` without the rows whose language cannot be told; all columns as they are.

    ``lang`` serves as the declared language and ``source`` as the host. Rejected are rows without
    a letter (null, empty, only digits or marks), rows in none of the fitted languages and rows whose
    best language stays under MIN_PROBABILITY. The row itself is carried through, so ties and repeated rows are judged alike.
    """
    model = model or fit_text_model(docs.select("doc_id", "text", "lang"))
    keys = ["doc_id", "_h", "declared", "host", "suffix"]
    rows = docs.select(
        "doc_id", F.xxhash64("text").alias("_h"), F.col("lang").alias("declared"), F.col("source").alias("host"),
        F.lit(None).cast("string").alias("suffix"), F.col("text").cast("string").alias("text"),
    )
    judged = fuse(stage(text_evidence(rows, model, keys, "text"), "doc-evidence"), model.languages)
    bad = judged.where(~F.col("accepted")).select(F.col("doc_id").alias("_id"), F.col("_h").alias("_bad_h")).distinct()
    h = fresh("_h", docs.columns)
    return docs.withColumn(h, F.xxhash64("text")).join(
        bad, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col(h) == F.col("_bad_h")), "left_anti"
    ).drop(h)
