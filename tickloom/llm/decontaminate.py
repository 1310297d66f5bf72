"""Benchmark passages in training documents, found by a hash set of item windows (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tickloom.llm.common import fresh, let, text_or_empty
from tickloom.session import stage

#: Words of a window; shorter items are one window.
WINDOW = 10
#: A word after A-Z were put in lower case, and the same in a text as it stands.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_CASED = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Up to so many windows of so many bytes in all go to every task as sets; more are joined.
SET_WINDOWS, SET_BYTES = 50_000, 8 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_JOIN = " "
_NO_HITS = "array<struct<pos:int,len:int,win:string>>"


def words_of(text: Column) -> Column:
    """Words of a text, A-Z in lower case; the general function does that where the text has only ASCII."""
    lowered = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))


def _window(words: Column, at: Column, n: Column) -> Column:
    return F.array_join(F.slice(words, at, n), _JOIN)


def _starts(words: Column, n: int) -> Column:
    """1-based places at which ``n`` words begin."""
    last = F.size(words) - (n - 1)
    return F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows ``win`` of all items, with ``len`` (words) and ``items`` (their ids as strings).

    An item without an id has the id ''. Items that share a window are gathered by it; one window may be in all items.
    """
    words = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words_of(text_or_empty("text")).alias("words"))
    n = F.least(F.size("words"), F.lit(window))
    starts = F.sequence(F.lit(1), F.size("words") - n + 1)
    rows = words.where(F.size("words") > 0).select(
        "item", n.alias("len"), F.explode(F.array_distinct(F.transform(starts, lambda i: _window(F.col("words"), i, n)))).alias("win")
    )
    return rows.groupBy("win").agg(F.first("len").alias("len"), F.collect_set("item").alias("items"))


def _covered(hits: Column) -> Column:
    """Number of words inside hits, given in the order of their places."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def add(s: Column, h: Column) -> Column:
        end = h["pos"] + h["len"]
        more = F.greatest(end - F.greatest(s["end"], h["pos"]), F.lit(0))
        return F.struct(F.greatest(s["end"], end).alias("end"), (s["n"] + more).alias("n"))

    return F.aggregate(hits, zero, add, lambda s: s["n"])


def _scan_sets(texts: DataFrame, windows: DataFrame, lengths: list[int]) -> DataFrame:
    """``n_words`` and ``hits`` per row of ``texts``; the windows lie in two sets that every task has.

    A window of the text is first sought by its hash, then, where the hash is known, by its words.
    """
    known = windows.select("len", F.xxhash64(F.split("win", _JOIN)).alias("h"), "win").collect()
    by_length = {n: ([r["h"] for r in known if r["len"] == n], [r["win"] for r in known if r["len"] == n]) for n in lengths}

    def hits(words: Column) -> Column:
        found = []
        for n, (hashes, texts_) in by_length.items():
            count = F.lit(n)
            at = F.filter(_starts(words, n), lambda i: F.xxhash64(F.slice(words, i, count)).isin(hashes) & _window(words, i, count).isin(texts_))
            found.append(F.transform(at, lambda i: F.struct(i.alias("pos"), count.alias("len"), _window(words, i, count).alias("win"))))
        return F.array_sort(F.concat(*found)) if len(found) > 1 else found[0]

    scan = let(words_of(F.col("_text")), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), hits(w).alias("hits")))
    return texts.withColumn("_scan", scan)


def _scan_join(texts: DataFrame, windows: DataFrame, lengths: list[int]) -> DataFrame:
    """The same where the windows are too many for a set: window hashes of the texts are joined with them.

    The join is left to the optimizer, which knows the size of the stored windows. What is found is gathered per text
    (by its digest: equal texts share it) and held against the words of the text.
    """
    texts = texts.withColumn("_digest", F.sha2("_text", 256))
    words = texts.select("_digest", "_text").dropDuplicates(["_digest"]).select("_digest", words_of(F.col("_text")).alias("words"))
    key = windows.select(F.col("len").alias("_len"), F.xxhash64(F.split("win", _JOIN)).alias("_key"), "win")
    met = None
    for n in lengths:
        hashes = F.transform(_starts(F.col("words"), n), lambda i: F.xxhash64(F.slice("words", i, n)))
        rows = words.select("_digest", F.posexplode(hashes).alias("_at", "_h"))
        rows = rows.join(key.where(F.col("_len") == n), F.col("_h") == F.col("_key"))
        met = rows if met is None else met.unionByName(rows)
    cands = met.groupBy(F.col("_digest").alias("_d")).agg(
        F.array_sort(F.collect_list(F.struct((F.col("_at") + 1).alias("pos"), F.col("_len").alias("len"), "win"))).alias("_cands")
    )
    held = texts.join(cands, F.col("_digest") == F.col("_d"), "left")
    right = lambda w: F.filter(F.coalesce("_cands", F.array().cast(_NO_HITS)), lambda c: _window(w, c["pos"], c["len"]) == c["win"])
    scan = let(words_of(F.col("_text")), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), right(w).alias("hits")))
    return held.withColumn("_scan", scan).drop("_digest", "_d", "_cands")


def scan_documents(docs: DataFrame, windows: DataFrame, set_windows: int = SET_WINDOWS, set_bytes: int = SET_BYTES) -> DataFrame:
    """``docs`` with ``_scan``: ``n_words`` and ``hits``, the places (from 1) of all windows that occur in the text.

    ``windows`` is a stored result of :func:`benchmark_windows`. Its size decides how it reaches the tasks.
    """
    n, size, lengths = windows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("win")), F.lit(0)), F.collect_set("len")).first()
    texts = docs.withColumn("_text", text_or_empty("text"))
    if not n:
        scan = F.struct(F.size(words_of(F.col("_text"))).cast("long").alias("n_words"), F.array().cast(_NO_HITS).alias("hits"))
        return texts.withColumn("_scan", scan).drop("_text")
    how = _scan_sets if n <= set_windows and size <= set_bytes else _scan_join
    return how(texts, windows, sorted(lengths)).drop("_text")


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, **limits) -> DataFrame:
    """Per row of ``docs``: which share of its words lies in windows of benchmark items, and of which items.

    ``docs`` has ``doc_id`` and ``text``, ``benchmark`` has ``item_id`` and ``text``. A window is ``window`` consecutive words of
    an item; an item of fewer words is one window. The result has ``doc_id``, ``n_words``, ``n_hit`` (words inside any
    occurrence), ``n_items`` and ``items_sha256`` (ids sorted as strings, joined by commas) and ``contaminated``.

    Null and wordless texts have no words and no windows. Repeated documents each get their row, repeated items count
    once by id, an item without an id counts as ''. Empty tables give no rows, or rows without hits. Other columns are
    ignored. A text is scanned whole in its own row and leaves only the distinct windows found; texts with the same
    windows are resolved to items once, however many they are.
    """
    windows = stage(benchmark_windows(benchmark, window), "windows")
    read = scan_documents(docs.select("doc_id", "text"), windows, **limits)
    found = F.array_sort(F.array_distinct(F.transform("_scan.hits", lambda h: h["win"])))
    rows = read.select("doc_id", F.col("_scan.n_words").alias("n_words"), _covered(F.col("_scan.hits")).alias("n_hit"), found.alias("_found"))
    rows = rows.withColumn("_set", F.when(F.col("n_hit") > 0, F.sha2(F.array_join("_found", "\n"), 256)))
    rows = stage(rows, "scanned")
    sets = rows.where("_set IS NOT NULL").groupBy(F.col("_set").alias("_key")).agg(F.first("_found").alias("_found"))
    met = sets.select("_key", F.explode("_found").alias("_win")).join(windows, F.col("_win") == F.col("win"))
    ids = met.select("_key", F.explode("items").alias("item")).distinct().groupBy("_key").agg(F.array_sort(F.collect_list("item")).alias("ids"))
    ids = ids.select("_key", F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"))
    ids = stage(ids, "item-sets")
    out = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated")]
    clean = rows.where("_set IS NULL").withColumns({"n_items": F.lit(0).cast("long"), "items_sha256": F.sha2(F.lit(""), 256)})
    hit = rows.where("_set IS NOT NULL").join(ids, F.col("_set") == F.col("_key"))
    return clean.select(*out).unionByName(hit.select(*out))


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "spans", window: int = WINDOW, **limits) -> DataFrame:
    """``docs`` without the words found in ``benchmark``, or without the documents that hold any.

    ``remove`` is ``spans`` (the hit words go, with what stands between two of them; other columns stay as they are) or
    ``documents``. Rows without hits are returned unchanged, null texts too. All columns of ``docs`` are kept.
    """
    if remove not in ("spans", "documents"):
        raise ValueError("remove is 'spans' or 'documents'")
    windows = stage(benchmark_windows(benchmark, window), "windows")
    # The scan's own columns begin with "_"; columns of the input that do so step aside.
    aside = fresh("own", docs.columns)
    taken = [c for c in docs.columns if c.startswith("_")]
    read = scan_documents(docs.withColumnsRenamed({c: aside + c for c in taken}), windows, **limits)
    if remove == "documents":
        kept = read.where(F.size("_scan.hits") == 0).drop("_scan")
    else:
        text = F.when(F.size("_scan.hits") > 0, _without(F.col("text"), F.col("_scan.hits"))).otherwise(F.col("text"))
        kept = read.withColumn("text", text).drop("_scan")
    return kept.withColumnsRenamed({aside + c: c for c in taken}).select(*docs.columns)


def _without(text: Column, hits: Column) -> Column:
    """The text less its hit words and the gaps between neighbouring ones."""
    spans = F.transform(hits, lambda h: F.sequence(h["pos"], h["pos"] + h["len"] - 1))
    gone = F.array_sort(F.array_distinct(F.flatten(spans)))
    words, gaps = F.regexp_extract_all(text, F.lit(_CASED), F.lit(0)), F.split(text, _CASED, -1)

    def build(w: Column, g: Column, x: Column) -> Column:
        firsts = F.filter(x, lambda p, i: F.coalesce(F.get(x, i - 1) != p - 1, F.lit(True)))
        lasts = F.filter(x, lambda p, i: F.coalesce(F.get(x, i + 1) != p + 1, F.lit(True)))
        pieces = F.transform(w, lambda word, i: F.concat(F.get(g, i), word))

        def join(p: Column, a: Column, b: Column) -> Column:
            def before(a_: Column, k: Column) -> Column:
                done = F.coalesce(F.get(b, k - 1), F.lit(0))
                return F.concat(F.array_join(F.slice(p, done + 1, a_ - 1 - done), ""), F.get(g, a_ - 1))

            rest = F.slice(p, F.element_at(b, -1) + 1, F.size(p))
            return F.concat(F.array_join(F.transform(a, before), ""), F.array_join(rest, ""), F.get(g, F.size(p)))

        return let(pieces, lambda p: let(firsts, lambda a: let(lasts, lambda b: join(p, a, b))))

    return let(words, lambda w: let(gaps, lambda g: let(gone, lambda x: build(w, g, x))))
