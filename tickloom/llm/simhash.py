"""SimHash near duplicates with bit-sliced comparison inside blocks.

Fingerprints that share a block key are compared 64 at a time: their bits are stored as vertical
planes (bit j of word w of a plane is a bit of fingerprint 64 w + j), the differences to one
fingerprint are added to carry-save counters for all 64 lanes at once, and a word is abandoned
once every lane exceeds the radius. A block yields the edges of a spanning forest, not its pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tickloom.llm.common import components, fresh, whole_groups
from tickloom.session import stage

SEED = 42
#: Words a shingle has, and bits in which linked fingerprints may differ, in the plain operator.
WIDTH, RADIUS = 3, 2
#: Fingerprints compared in one task at most; larger blocks are keyed anew, then cut into tiles.
BLOCK_ROWS = 16_384
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 of each shingle of the words of ``text`` with A-Z in lower case, repeats included."""
    words = _WORDS.findall((text or "").encode("utf-8", "surrogatepass").lower())
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]])
    n = max(1, len(words) - width + 1)
    last = ends[min(width, len(words)) - 1 :] - 1
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), last.tolist())], dtype=np.uint64)


def _mixed(h: np.ndarray, word: int) -> np.ndarray:
    """Further 64 hash bits of each shingle; word 0 is the hash itself."""
    if not word:
        return h
    x = h + np.uint64((0x9E3779B97F4A7C15 * word) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(h: np.ndarray, words: int = 1) -> np.ndarray:
    """``words`` uint64: a bit is 1 if set in over half the hashes."""
    out = np.zeros(words, np.uint64)
    for w in range(words):
        total = np.zeros(64, np.int64)
        for at in range(0, len(h), 255 * 64):
            bits = np.unpackbits(_mixed(h[at : at + 255 * 64], w).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            whole = len(bits) // 255 * 255
            total += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
            total += bits[whole:].sum(axis=0, dtype=np.int64)
        out[w] = np.packbits(2 * total > len(h), bitorder="little").view("<u8")[0]
    return out


def band_keys(h: np.ndarray, bands: int) -> np.ndarray:
    """Per band a key from the smallest shingle hash under two orders; none without shingles."""
    if not len(h):
        return np.zeros(bands, np.uint64)
    low = np.array([_mixed(h, 101 + i).min() for i in range(2 * bands)], np.uint64)
    return _mixed(low[::2] ^ (low[1::2] * np.uint64(0x9E3779B97F4A7C15)), 1)


def fingerprints(docs: DataFrame, width: int = WIDTH, words: int = 1, bands: int = 0) -> DataFrame:
    """``doc_id``, ``fp`` (bytes, most significant first) and ``bands`` (array of keys) per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, keys = [], []
            for text in batch.column(1):
                h = shingle_hashes(text.as_py(), width)
                fps.append(fingerprint(h, words).astype(">u8").tobytes())
                keys.append(band_keys(h, bands).view(np.int64) if bands else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(fps, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "fp", "bands"]
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, fp binary, bands array<long>"
    )


def planes_of(fps: np.ndarray) -> np.ndarray:
    """Vertical planes of ``fps`` (n x words): planes[bit, w] holds that bit of rows 64 w to 64 w + 63."""
    n, words = fps.shape
    padded = np.zeros((-(-n // 64) * 64, words), "<u8")
    padded[:n] = fps
    bits = np.unpackbits(padded.view(np.uint8), axis=1, bitorder="little")  # rows x bits
    flat = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")
    return flat.view("<u8")


def close_pairs(fps: np.ndarray, first: np.ndarray, end: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (i, j) of ``fps`` that differ in at most ``radius`` bits, for j from first[i] up to end[i]."""
    planes = planes_of(fps)
    rows = np.flatnonzero(end > first)
    blocks = (end[rows] - 1) // 64 - first[rows] // 64 + 1
    total, bounds = int(blocks.sum()), np.concatenate([[0], np.cumsum(blocks)])
    size = (radius + 1).bit_length()
    for at in range(0, total, 32_768):
        k = np.arange(at, min(total, at + 32_768))
        which = np.searchsorted(bounds, k, side="right") - 1
        q = rows[which]
        w = first[q] // 64 + (k - bounds[which])
        lo = np.clip(first[q] - 64 * w, 0, 63).astype(np.uint64)
        hi = np.clip(64 * (w + 1) - end[q], 0, 63).astype(np.uint64)
        over = ~((_ALL << lo) & (_ALL >> hi))
        # The counters start so high that the first count beyond the radius carries out of the top.
        start = (1 << size) - (radius + 1)
        counters = [np.full(len(k), _ALL if start >> i & 1 else 0, np.uint64) for i in range(size)]
        for bit in range(0, len(planes), 2):
            x, y = (
                planes[b][w] ^ (np.uint64(0) - ((fps[q, b // 64] >> np.uint64(b % 64)) & np.uint64(1)))
                for b in (bit, bit + 1)
            )
            half = counters[0] ^ x
            carry = (counters[0] & x) | (half & y)
            counters[0] = half ^ y
            for i in range(1, size):
                counters[i], carry = counters[i] ^ carry, counters[i] & carry
            over = over | carry
            if bit % 8 == 6:
                alive = np.flatnonzero(over != _ALL)
                if not len(alive):
                    break
                if 2 * len(alive) < len(over):
                    q, w, over = q[alive], w[alive], over[alive]
                    counters = [c[alive] for c in counters]
        else:
            hits = np.unpackbits((~over).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            i, lane = np.nonzero(hits)
            if len(i):
                yield q[i], 64 * w[i] + lane


def forest(fps: np.ndarray, first: np.ndarray, end: np.ndarray, radius: int) -> np.ndarray:
    """For each row the smallest row that it reaches through close pairs."""
    label = np.arange(len(fps))
    for i, j in close_pairs(fps, first, end, radius):
        while True:
            low = np.minimum(label[i], label[j])
            if (label[i] == low).all() and (label[j] == low).all():
                break
            np.minimum.at(label, label[i], low)
            np.minimum.at(label, label[j], low)
            while (label[label] != label).any():
                label = label[label]
    return label


def compare_blocks(keyed: DataFrame, radius: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Spanning edges (``a``, ``b``: ids) of the close pairs in each block of ``keyed``.

    ``keyed`` (stored) has ``key`` (any long), ``id`` (long) and ``fp``. A block of more than
    ``block_rows`` rows is cut into parts by a hash of the id, and each two parts meet in a tile
    of their own, so no task holds more than about twice ``block_rows`` rows of a block.
    """
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    parts = F.ceil(F.col("_n") / F.lit(float(block_rows))).cast("int")
    part = F.pmod(F.xxhash64("id"), F.col("_parts")).cast("int")
    met = keyed.join(sizes.select(F.col("key").alias("_k"), parts.alias("_parts")), F.col("key") == F.col("_k"))
    met = met.withColumn("_mine", part)
    other = F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_other")
    tiles = met.select("key", "id", "fp", "_mine", other).select(
        F.xxhash64("key", F.least("_mine", "_other"), F.greatest("_mine", "_other")).alias("tile"), "key", "id", "fp",
    )
    dealt = tiles.repartition("tile").sortWithinPartitions("tile", "key", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches):
            tile, ids = (table.column(i).to_numpy() for i in (0, 2))
            fps = np.frombuffer(b"".join(table.column(3).to_pylist()), ">u8").astype(np.uint64).reshape(len(ids), -1)
            bounds = np.flatnonzero(np.diff(tile)) + 1
            sizes = np.diff(np.concatenate([[0], bounds, [len(tile)]]))
            end = np.repeat(np.concatenate([bounds, [len(tile)]]), sizes)
            root = forest(fps, np.arange(1, len(tile) + 1), end, radius)
            far = np.flatnonzero(root != np.arange(len(root)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[far]), pa.array(ids[root[far]])], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def _masks(bits: list[int], level: int) -> list[list[int]]:
    """Bit sets that must agree: two of four blocks of the open bits, refined ``level`` times.

    Of four blocks at least two agree where at most two bits differ.
    """
    size = len(bits) // 4
    blocks = [bits[i * size : (i + 1) * size] for i in range(3)] + [bits[3 * size :]]
    out = []
    for one, two in combinations(range(4), 2):
        agreed = blocks[one] + blocks[two]
        if level == 0:
            out.append(agreed)
        else:
            rest = [b for i in range(4) if i not in (one, two) for b in blocks[i]]
            out += [agreed + more for more in _masks(rest, level - 1)]
    return out


def link_close(fps: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Spanning edges among distinct 64-bit fingerprints (``id`` long, ``fp``) that differ in at most 2 bits.

    Every close pair agrees in two of four 16-bit blocks and so meets under one of six 32-bit
    keys. Blocks over ``block_rows`` are keyed again by the bits still open (48, then 56 bits);
    at most 256 fingerprints share 56 bits, so the last level is small by construction.
    """
    edges, rows = None, fps
    for level in range(3):
        masks = _masks(list(range(64)), level)
        signed = [sum(1 << b for b in m) for m in masks]
        signed = [m - (1 << 64) if m >> 63 else m for m in signed]
        every = 6 ** level
        options = F.array(*[F.struct(F.lit(i).alias("path"), F.lit(m).cast("long").alias("mask")) for i, m in enumerate(signed)])
        if level:  # only the children of the heavy keys
            options = F.slice(options, F.col("path") * 6 + 1, F.lit(6))
        keyed = rows.select("id", "fp", F.explode(options).alias("o")).select(
            F.col("o.path").alias("path"), F.xxhash64(F.col("o.path"), F.col("id").bitwiseAND(F.col("o.mask"))).alias("key"), "id", "fp"
        )
        keyed = stage(keyed, f"blocks-{level}")
        heavy = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > block_rows).select("key")
        heavy = stage(heavy, "heavy") if level < 2 else heavy.limit(0)
        more = level < 2 and not heavy.isEmpty()
        light = keyed.join(heavy, "key", "left_anti") if more else keyed
        found = compare_blocks(light.select("key", "id", "fp"), RADIUS, block_rows)
        edges = found if edges is None else edges.unionByName(found)
        if not more:
            break
        rows = stage(keyed.join(heavy, "key", "left_semi").select("id", "fp", "path"), "heavy-rows")
    return edges


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``fingerprint`` (hex) and ``component_id`` of every row of ``docs`` (``doc_id``, ``text``).

    Fingerprints of 3-word shingles; two link when they differ in at most 2 bits, and
    ``component_id`` is the smallest doc_id reachable. Null, empty and blank texts have the
    fingerprint zero and link like any other; fewer than three words are one shingle. Repeated
    rows and ids are kept, each with its class. A null doc_id is never a component_id, unless the whole class
    has none. An empty table gives an empty result; other columns are ignored. Equal fingerprints are
    one row before any comparison, so copies cost nothing there.
    """
    marked = fingerprints(docs).select("doc_id", F.conv(F.hex("fp"), 16, -10).cast("long").alias("id"), "fp")
    marked = stage(marked, "fingerprints")
    classes = stage(marked.groupBy("id").agg(F.min("doc_id").alias("low"), F.first("fp").alias("fp")), "classes")
    joined = stage(components(link_close(classes.select("id", "fp"))), "components")
    roots = classes.select("id", "low").join(joined.withColumnRenamed("node", "id"), "id")
    lows = roots.groupBy("root").agg(F.min("low").alias("least"))
    linked = joined.join(lows, "root").select(F.col("node").alias("id"), "least")
    names = classes.select("id", "low").join(linked, "id", "left").select(
        F.col("id").alias("_id"), F.coalesce("least", "low").alias("component_id")
    )
    return marked.join(names, F.col("id") == F.col("_id"), "left").select(
        "doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id"
    )


#: The stage of the corpus pipeline: five words, similarity 0.8; bits, bands and radius that go with them.
STAGE_WIDTH, STAGE_SIMILARITY, STAGE_WORDS, STAGE_BANDS = 5, 0.8, 16, 12
#: Bits beyond the expected radius that the fingerprints are let differ before the exact check: their noise is about 12
#: bits, and odd and even set sizes shift the majority of very short texts by up to 40.
STAGE_SLACK = 100
#: Documents and shingles of a candidate group checked in one task at most (a task takes two such parts).
PART_ROWS, PART_SHINGLES = 4096, 1 << 22


def radius_for(similarity: float, bits: int) -> int:
    """Expected differing bits of two equally large shingle sets with this Jaccard similarity."""
    cosine = 2 * similarity / (1 + similarity)
    return int(bits * np.arccos(cosine) / np.pi)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of ``text``."""
    return np.unique(shingle_hashes(text, width))


def set_fingerprints(docs: DataFrame, width: int) -> DataFrame:
    """Per row ``doc_id``, ``t`` (hash of the text), ``id`` (hash of the shingle set), its size ``n``, ``fp`` and ``bands``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, fps, keys = [], [], [], []
            for text in batch.column(1):
                h = shingle_set(text.as_py(), width)
                ids.append(xxhash.xxh64_intdigest(h.tobytes(), SEED))
                sizes.append(len(h))
                fps.append(fingerprint(h, STAGE_WORDS).astype(">u8").tobytes())
                keys.append(band_keys(h, STAGE_BANDS).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(np.array(ids, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()),
                 pa.array(fps, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "t", "id", "n", "fp", "bands"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), _text_hash().alias("t")).mapInArrow(
        run, "doc_id long, t long, id long, n long, fp binary, bands array<long>"
    )


def similar_edges(sets: list[np.ndarray], fps: np.ndarray, end: np.ndarray, radius: int, similarity: float) -> Iterator[tuple[int, int]]:
    """A spanning forest (rows i, j) of the close pairs whose shingle sets have at least this Jaccard similarity."""
    label = np.arange(len(sets))
    sizes = np.array([len(x) for x in sets], np.int64)

    def root(i: int) -> int:
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    for i, j in close_pairs(fps, np.arange(1, len(sets) + 1), end, radius):
        fits = np.minimum(sizes[i], sizes[j]) >= similarity * np.maximum(sizes[i], sizes[j]) - 1e-9
        i, j = i[fits], j[fits]
        for at in range(0, len(i), 1024):
            while (label[label] != label).any():
                label[:] = label[label]
            one, two = i[at : at + 1024], j[at : at + 1024]
            apart = label[one] != label[two]
            for a, b in zip(one[apart].tolist(), two[apart].tolist()):
                ra, rb = root(a), root(b)
                if ra == rb:
                    continue
                both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                if both >= similarity * (sizes[a] + sizes[b] - both) - 1e-9:
                    label[max(ra, rb)] = min(ra, rb)
                    yield a, b


def confirmed(docs: DataFrame, members: DataFrame, width: int, radius: int, similarity: float, part_rows: int) -> DataFrame:
    """Spanning edges (``a``, ``b``) of the pairs of similar shingle sets among the ``members`` of a candidate group.

    ``members`` (stored) has ``root`` (the group), ``id``, ``n``, ``fp`` and the row that holds the
    text (``head``). A group of many documents or shingles is cut into parts, and each two
    parts meet in a tile, as in :func:`compare_blocks`.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("_doc"), _text_hash().alias("_t"), F.col("text").cast("string").alias("text"))
    at = F.col("head.doc_id").eqNullSafe(F.col("_doc")) & (F.col("head.t") == F.col("_t"))
    held = members.join(texts, at).select("root", "id", "fp", "text").dropDuplicates(["id"])

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(text.as_py(), width).tobytes() for text in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sets, pa.binary())], ["root", "id", "fp", "hashes"])

    held = stage(held.mapInArrow(to_sets, "root long, id long, fp binary, hashes binary"), "shingle-sets")
    share = F.greatest(F.count(F.lit(1)) / F.lit(float(part_rows)), F.sum("n") / F.lit(float(PART_SHINGLES)))
    parts = members.groupBy(F.col("root").alias("_k")).agg(F.greatest(F.ceil(share), F.lit(1)).cast("int").alias("_parts"))
    met = held.join(parts, F.col("root") == F.col("_k")).withColumn("_mine", F.pmod(F.xxhash64("id"), F.col("_parts")).cast("int"))
    tiles = met.select("root", "id", "fp", "hashes", "_mine", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_other")).select(
        F.xxhash64("root", F.least("_mine", "_other"), F.greatest("_mine", "_other")).alias("tile"), "id", "fp", "hashes"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches):
            tile, ids = table.column(0).to_numpy(), table.column(1).to_numpy()
            fps = np.frombuffer(b"".join(table.column(2).to_pylist()), ">u8").astype(np.uint64).reshape(len(ids), -1)
            sets = [np.frombuffer(x, np.uint64) for x in table.column(3).to_pylist()]
            bounds = np.append(np.flatnonzero(np.diff(tile)) + 1, len(tile))
            end = np.repeat(bounds, np.diff(np.append(0, bounds)))
            found = np.array(list(similar_edges(sets, fps, end, radius, similarity)), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(ids[found[:, 0]]), pa.array(ids[found[:, 1]])], ["a", "b"])

    return tiles.repartition("tile").sortWithinPartitions("tile", "id").mapInArrow(run, "a long, b long")


def _near_classes(docs: DataFrame, width: int, similarity: float, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """Rows (``doc_id``, ``t``: hash of the text, ``id`` of the class of equal shingle sets) and each class's ``group``.

    Two texts link when their sets of distinct shingles have a Jaccard similarity of ``similarity``
    or more. Candidates have fingerprints of 1,024 bits, compared bit-sliced with a wide radius
    within blocks of documents that share a smallest shingle under two hash orders; of twelve such keys a
    pair of similarity 0.8 shares at least one with probability 1 - 5e-6. Within the groups that
    candidates form, the sets themselves decide.
    """
    bits = 64 * STAGE_WORDS
    radius = min(bits // 2, radius_for(similarity, bits) + STAGE_SLACK)
    marked = stage(set_fingerprints(docs, width), "wide-fingerprints")
    keyed = marked.groupBy("id", "bands").agg(F.first("fp").alias("fp")).select(
        F.posexplode("bands").alias("_band", "_key"), "id", "fp"
    ).select(F.xxhash64("_band", "_key").alias("key"), "id", "fp")
    edges = compare_blocks(stage(keyed, "bands"), radius, block_rows)
    loose = stage(components(edges), "candidates")
    classes = stage(marked.groupBy("id").agg(F.min(_first_row()).alias("head"), F.min("doc_id").alias("low"), F.first("n").alias("n")), "near-classes")
    prints = marked.groupBy("id").agg(F.first("fp").alias("fp"))
    members = loose.withColumnRenamed("node", "id").join(classes, "id").join(prints, "id").select("root", "id", "n", "fp", "head")
    members = stage(members, "candidate-groups")
    joined = stage(components(confirmed(docs, members, width, radius, similarity, min(block_rows, PART_ROWS))), "components")
    named = classes.join(joined.withColumnRenamed("node", "id"), "id", "left").withColumn("group", F.coalesce("root", "id")).drop("root")
    return marked.select("doc_id", "t", "id"), stage(named, "near-groups")


def _text_hash() -> Column:
    return F.xxhash64(F.col("text").cast("string"))


def _first_row() -> Column:
    """Orders the rows of a class: by doc_id, those without one last, then by the hash of the text."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "t")


def near_duplicate_groups(
    docs: DataFrame, width: int = STAGE_WIDTH, similarity: float = STAGE_SIMILARITY, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``doc_id`` and ``group_id`` (smallest doc_id of its near-duplicate group) of every row."""
    marked, classes = _near_classes(docs, width, similarity, block_rows)
    lows = classes.groupBy("group").agg(F.min("low").alias("group_id"))
    names = classes.select("id", "group").join(lows, "group").select(F.col("id").alias("_id"), "group_id")
    return marked.join(names, F.col("id") == F.col("_id"), "left").select("doc_id", "group_id")


def keep_one_each(docs: DataFrame, width: int = STAGE_WIDTH, similarity: float = STAGE_SIMILARITY) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: that of the smallest doc_id, all columns as they are.

    Texts without words are one group. Of rows that share the smallest id the first by a hash of its
    text stays; a group without any doc_id leaves one row with a null id. Groups are told apart
    whatever their ids, so rows that share an id, or have none, stay if their groups differ.
    """
    key = fresh("_near", docs.columns)
    marked, classes = _near_classes(docs, width, similarity, BLOCK_ROWS)
    heads = classes.groupBy("group").agg(F.min("head").alias("head")).select(
        F.col("head.doc_id").alias(f"{key}_doc"), F.col("head.t").alias(f"{key}_head")
    )
    # Rows of one id and text are one class, so no two groups have the same head.
    here = F.col("doc_id").cast("long").eqNullSafe(F.col(f"{key}_doc")) & (_text_hash() == F.col(f"{key}_head"))
    rows = marked.groupBy(F.col("doc_id").alias("_id"), F.col("t").alias("_text")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    same = F.col(f"{key}_doc").eqNullSafe(F.col("_id")) & (F.col(f"{key}_head") == F.col("_text"))
    twice = stage(heads.join(rows, same, "left_semi"), "repeated-heads")
    if twice.isEmpty():
        return docs.join(heads, here, "left_semi")
    single = docs.join(heads.join(rows, same, "left_anti"), here, "left_semi")
    # Copies are dropped before the join, in each task first, so that many equal rows do not meet in one.
    once = docs.withColumns({f"{key}_id": F.col("doc_id").cast("long"), f"{key}_t": _text_hash()}).dropDuplicates([f"{key}_id", f"{key}_t"])
    return single.unionByName(once.join(twice, here, "left_semi").select(*docs.columns))
