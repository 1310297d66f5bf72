"""Removal of repeated passages by distributed prefix doubling over content-chosen positions.

Every string of ``threshold`` bytes has one anchor: the position of the smallest hashed 8-gram in
it. Equal strings have it at the same place, so only anchors (about one in ``threshold`` / 2
bytes) are named and sorted in Spark, not all positions. The name of an anchor is first that of
about half a threshold of text beside it; a position whose name is unique is dropped. What is left is named again, with the
text of all strings that have this anchor: where that longer name occurs twice, the
threshold is passed and all those strings are repeated. Only where names part, at the ends of repeats, are
single byte positions ranked: inside their class, names of 8 bytes are joined in pairs at offsets
of 8, 16, 32, ... bytes until they cover the threshold.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tickloom.llm.common import fresh, text_or_empty, whole_groups
from tickloom.session import stage

THRESHOLD = 200
#: Contexts of one class compared in a task; the windows of larger classes are counted by Spark.
CLASS_ROWS = 100_000
_GRAM = 8
#: Start positions looked at together in a very long text.
_SEGMENT = 1 << 22
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def text_key() -> Column:
    """64-bit key of a text: equal texts share their spans."""
    return F.xxhash64(text_or_empty("text"))


def _grams(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position as a uint64."""
    n = len(data) - 7
    out = np.empty(max(0, n), np.uint64)
    for o in range(min(8, max(0, n))):
        out[o::8] = data[o : o + (n - o + 7) // 8 * 8].view("<u8")
    return out


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = (a ^ (b * _M2 + (b >> np.uint64(29)))) * _M1
    return h ^ (h >> np.uint64(32))


def anchors(data: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of start positions (first, last) whose strings have the same anchor."""
    width = threshold - _GRAM + 1
    h = _grams(data) * _M1
    h = (h ^ (h >> np.uint64(31))) * _M2
    # The leftmost of equal grams wins, whatever is around the string.
    value = (h & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(h), dtype=np.uint64)
    pad = -len(value) % width
    blocks = np.concatenate([value, np.full(pad, 0xFFFFFFFFFFFFFFFF, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(value) - width + 1
    at = (np.minimum(back[:n], ahead[width - 1 : width - 1 + n]) & np.uint64(0xFFFFFF)).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
    last = np.concatenate([first[1:] - 1, [n - 1]])
    return first, last, at[first]


def anchor_rows(text: bytes, threshold: int) -> Iterator[tuple[int, int, int]]:
    """(name, longer name, place) of each anchor side; place packs first start, last - first, anchor - first."""
    half = (threshold - _GRAM) // 2
    name = xxhash.xxh64_intdigest
    for seg in range(0, len(text) - threshold + 1, _SEGMENT):
        part = text[seg : seg + _SEGMENT + threshold - 1]
        for lo, hi, a in zip(*(x.tolist() for x in anchors(np.frombuffer(part, np.uint8), threshold))):
            # Strings that begin at least half before their anchor share the text before it, others the text after it.
            for side, (s, e) in enumerate(((lo, min(hi, a - half)), (max(lo, a - half + 1), hi))):
                if s > e:
                    continue
                known = part[a : a + threshold - half + 1] if side else part[a - half : a + _GRAM]
                shape = (e - s) << 8 | (a - s)
                yield name(known, side), name(part[s : e + threshold], shape + 2), (seg + s) << 16 | shape


def _combined(names: list[int], longer: list[int], keys: list[int], places: list[int]) -> pa.RecordBatch:
    """Rows of a task before they are dealt by name: one for each longer name, ``more`` if there are others.

    The others are ``sure`` repeats and need no sorting; copies of the very same row are dropped. So a
    passage that is everywhere sends one row from each task.
    """
    cols = [np.array(names, np.uint64).view(np.int64), np.array(longer, np.uint64).view(np.int64), np.array(keys, np.int64), np.array(places, np.int64)]
    order = np.lexsort(cols[::-1])
    name, wide, key, place = (c[order] for c in cols)
    same = np.append(False, (name[1:] == name[:-1]) & (wide[1:] == wide[:-1])) if len(name) else np.zeros(0, bool)
    twin = same & np.append(False, (key[1:] == key[:-1]) & (place[1:] == place[:-1])) if len(name) else same
    more = ~same & np.append(same[1:], False) if len(name) else same
    keep = ~twin
    return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (name, wide, key, place, more, same)], ["name", "longer", "key", "place", "more", "sure"])


def _name_anchors(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list, list, list] = ([], [], [], [])
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for row in anchor_rows(text.as_py() or b"", threshold):
                    for col, v in zip(held, (row[0], row[1], key, row[2])):
                        col.append(v)
                if len(held[0]) > 400_000:
                    yield _combined(*held)
                    held = ([], [], [], [])
        yield _combined(*held)

    return run


def _sort_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by name, longer name, key and place: drops unique names and tells the others apart.

    ``repeated``: the longer name occurs twice. ``open``: the name has other longer names, and this
    is the row that stands for its own. Two rows are remembered, however long a run of a name is.
    """
    before: list | None = None  # the row before the held one
    held: list | None = None
    first = True  # whether the class of ``before`` is the first of its name

    def settle(rows: list[np.ndarray], more: bool) -> pa.RecordBatch:
        """``rows`` begin with ``before`` if there is one; the last row waits if ``more`` may follow."""
        nonlocal first
        name, longer, key, place, more_in_task = rows
        same_name = np.append(False, name[1:] == name[:-1])
        same = same_name & np.append(False, longer[1:] == longer[:-1])
        twin = same & np.append(False, (key[1:] == key[:-1]) & (place[1:] == place[:-1]))
        start = np.maximum.accumulate(np.where(same, 0, np.arange(len(name))))
        is_first = ~same_name[start]
        if before is not None:
            is_first = np.where(start == 0, first, is_first)
        next_name, next_same = np.append(same_name[1:], False), np.append(same[1:], False)
        repeated = same | next_same | more_in_task
        stands = ~next_same & (next_name | ~is_first)
        lo, hi = int(before is not None), len(name) - int(more)
        keep = np.flatnonzero(((repeated & ~twin) | stands)[lo:hi]) + lo
        first = bool(is_first[hi - 1]) if hi else first
        return pa.RecordBatch.from_arrays(
            [pa.array(x[keep]) for x in (name, key, place, repeated, stands)], ["name", "key", "place", "repeated", "open"]
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        for one in (held, before):
            if one is not None:
                rows = [np.append(x, y) for x, y in zip(one, rows)]
        if len(rows[0]) - int(before is not None) > 1:
            yield settle(rows, True)
            before = [x[-2:-1] for x in rows]
        held = [x[-1:] for x in rows]
    if held is not None:
        yield settle(held if before is None else [np.append(x, y) for x, y in zip(before, held)], False)


def byte_names(data: np.ndarray, threshold: int) -> np.ndarray:
    """Name of the ``threshold`` bytes from each position: names of 8, joined in pairs at growing offsets."""
    h, length = _grams(data), _GRAM
    while length < threshold:
        step = min(length, threshold - length)
        h, length = _mix(h[: len(h) - step], h[step:]), length + step
    return h


def _windows(table: pa.Table, threshold: int) -> tuple[np.ndarray, ...]:
    """Of rows (name, key, place, context): row, start and name (within the class) of every string."""
    name, key, place = (table.column(i).to_numpy() for i in range(3))
    parts = table.column(3).to_pylist()
    sizes = np.array([len(p) for p in parts], np.int64)
    names = byte_names(np.frombuffer(b"".join(parts), np.uint8), threshold)
    count = sizes - threshold + 1
    row = np.repeat(np.arange(len(parts)), count)
    j = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    x = (place[row] & 255) - j  # anchor - start
    full = _mix(_mix(names[(np.cumsum(sizes) - sizes)[row] + j], x.astype(np.uint64)), name[row].view(np.uint64))
    return row, (place[row] >> 16) + j, full, key[row]


def _runs(key: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
    """Runs (key, lo, hi) of consecutive starts; both arrays are ordered by context, then start."""
    if not len(key):
        return pa.RecordBatch.from_arrays([pa.array(np.zeros(0, np.int64))] * 3, ["key", "lo", "hi"])
    cut = np.flatnonzero((np.diff(key) != 0) | (np.diff(start) != 1)) + 1
    lo, hi = np.append(0, cut), np.append(cut, len(key)) - 1
    return pa.RecordBatch.from_arrays([pa.array(key[lo]), pa.array(start[lo]), pa.array(start[hi])], ["key", "lo", "hi"])


def _compare(threshold: int):
    """Runs of strings that occur twice in their class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches):
            _, start, full, key = _windows(table, threshold)
            _, back, times = np.unique(full, return_inverse=True, return_counts=True)
            hit = times[back] > 1
            yield _runs(key[hit], start[hit])

    return run


def _all_windows(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                _, start, full, key = _windows(pa.Table.from_batches([batch.slice(at, 2000)]), threshold)
                yield pa.RecordBatch.from_arrays([pa.array(full.view(np.int64)), pa.array(key), pa.array(start)], ["full", "key", "lo"])

    return run


def _contexts(threshold: int):
    """(name, key, place, bytes) of the open anchors of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for key, text, rows in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                data = text.as_py()
                for r in rows.as_py() or []:
                    lo, shape = r["place"] >> 16, r["place"] & 0xFFFF
                    for col, v in zip(out, (r["name"], key, r["place"], data[lo : lo + (shape >> 8) + threshold])):
                        col.append(v)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.binary())], ["name", "key", "place", "context"]
            )

    return run


def _cut_out(threshold: int):
    """(key, n_removed, n_spans, sha, text) of what is left of each text and its runs of repeated starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for key, text, runs in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                data = text.as_py()
                spans: list[list[int]] = []
                for r in sorted(runs.as_py() or [], key=lambda r: r["lo"]):
                    lo, hi = r["lo"], r["hi"] + threshold
                    if spans and lo <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], hi)
                    else:
                        spans.append([lo, hi])
                edges = [0, *(x for s in spans for x in s), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
                for col, v in zip(out, (key, len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore"))):
                    col.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))],
                ["key", "n_removed", "n_spans", "sha", "text"],
            )

    return run


def repeated_parts(docs: DataFrame, threshold: int = THRESHOLD, class_rows: int = CLASS_ROWS) -> DataFrame:
    """``key`` (of the text), ``n_removed``, ``n_spans``, ``sha`` and ``text`` of what is left of each text that loses some.

    Texts are told apart by key; copies of a text are processed once and count as repeats.
    """
    texts = docs.select("doc_id", text_key().alias("key"), text_or_empty("text").cast("binary").alias("text"))
    long = texts.where(F.octet_length("text") >= threshold)
    layout = "name long, longer long, key long, place long, more boolean, sure boolean"
    named = stage(long.select("key", "text").mapInArrow(_name_anchors(threshold), layout), "anchors")
    dealt = named.where("not sure").drop("sure").repartition("name").sortWithinPartitions("name", "longer", "key", "place")
    marked = stage(dealt.mapInArrow(_sort_out, "name long, key long, place long, repeated boolean, open boolean"), "names")
    marked = marked.unionByName(named.where("sure").select("key", "place").distinct().selectExpr(
        "cast(null as long) AS name", "key", "place", "true AS repeated", "false AS open"
    ))

    # One text per key: rows with that key and the smallest doc_id, which may repeat but are alike.
    per_key = marked.groupBy("key").agg(F.collect_list(F.when(F.col("open"), F.struct("name", "place"))).alias("rows"))
    owner = long.select("doc_id", "key").groupBy("key").agg(F.min("doc_id").alias("owner"))
    wanted = per_key.join(owner, "key").select(F.col("key").alias("_key"), "owner", "rows")
    found = long.join(wanted, (F.col("doc_id").eqNullSafe(F.col("owner"))) & (F.col("key") == F.col("_key")))
    kept = stage(found.select("key", "text", "rows"), "repeating-texts")

    contexts = kept.where(F.size("rows") > 0).mapInArrow(_contexts(threshold), "name long, key long, place long, context binary")
    contexts = stage(contexts, "contexts")
    heavy = contexts.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > class_rows).select("name")
    heavy = stage(heavy, "heavy-classes")
    runs = "key long, lo long, hi long"
    light = contexts.join(heavy, "name", "left_anti").select("name", "key", "place", "context")
    spans = light.repartition("name").sortWithinPartitions("name").mapInArrow(_compare(threshold), runs)
    if not heavy.isEmpty():
        single = contexts.join(heavy, "name", "left_semi").select("name", "key", "place", "context")
        single = stage(single.mapInArrow(_all_windows(threshold), "full long, key long, lo long"), "windows")
        often = single.groupBy("full").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("full")
        spans = spans.unionByName(single.join(often, "full", "left_semi").select("key", "lo", F.col("lo").alias("hi")))
    sure = marked.where("repeated").select(
        "key", F.shiftright("place", 16).alias("lo"),
        (F.shiftright("place", 16) + F.shiftright("place", 8).bitwiseAND(255)).alias("hi"),
    )
    spans = spans.unionByName(sure).groupBy("key").agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))
    cut = kept.select("key", "text").join(spans, "key").select("key", "text", "runs")
    cut = cut.mapInArrow(_cut_out(threshold), "key long, n_removed long, n_spans long, sha string, text string")
    return cut


def remove_repeats(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Per row of ``docs`` (``doc_id``, ``text``): what is left without bytes in repeated strings.

    Texts are UTF-8 bytes. A byte goes if a string of ``threshold`` bytes over it also starts
    anywhere else, in the same text or another; strings are judged on the input, and matches never
    cross documents. Columns: ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed
    runs) and ``kept_sha256`` of the remaining bytes.

    Null and empty texts have 0 bytes; texts shorter than ``threshold`` keep all. Copies of a text
    of at least ``threshold`` bytes all go whole, repeated rows included. Null ids are kept. An
    empty table gives an empty result, and other columns are ignored. Memory in a task is bounded
    by its longest text and by ``class_rows`` contexts.
    """
    if not 16 <= threshold <= 255:
        raise ValueError("threshold must be from 16 to 255 bytes")
    parts = stage(repeated_parts(docs, threshold).drop("text").dropDuplicates(["key"]), "cut")
    rows = docs.select(
        "doc_id", text_key().alias("_key"), F.octet_length(text_or_empty("text")).cast("long").alias("n_bytes"),
        F.sha2(text_or_empty("text").cast("binary"), 256).alias("_sha"),
    )
    return rows.join(parts, F.col("_key") == F.col("key"), "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"), F.coalesce("sha", "_sha").alias("kept_sha256"),
    )


def without_repeats(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """``docs`` with the repeated bytes taken out of ``text``; a character cut in half goes whole.

    All rows and columns stay; a text of nothing but repeats becomes empty, and null stays null.
    ``n_chars``, where there is one, is counted anew.
    """
    parts = stage(repeated_parts(docs, threshold).select("key", "text").dropDuplicates(["key"]), "cut")
    key, text = fresh("_key", docs.columns), fresh("_kept", docs.columns)
    parts = parts.select(F.col("key").alias(key + "2"), F.col("text").alias(text))
    joined = docs.withColumn(key, text_key()).join(parts, F.col(key) == F.col(key + "2"), "left")
    new = {"text": F.coalesce(F.col(text), F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col(text).isNotNull(), F.char_length(text).cast("long")).otherwise(F.col("n_chars"))
    return joined.withColumns(new).select(*docs.columns)
