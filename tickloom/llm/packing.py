"""Best-fit packing of token sequences by exact-complement hashing over the histogram of lengths."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tickloom.plans.ranking import number_rows
from tickloom.session import stage

#: Tokens of a sequence, and the id that ends each document.
CONTEXT, END_ID = 2048, 0

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class RankEncoder:
    """The byte-level BPE of a ``tokenizers`` file, run from its vocabulary as ranks.

    Gives the ids of ``Tokenizer.from_file(path).encode(text, add_special_tokens=False)`` (checked
    in the tests) in about a sixth of the time: ids of a byte-level vocabulary are its merge ranks.
    """

    def __init__(self, path: str):
        import json

        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(printable)]
        byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(map(byte_of.__getitem__, t)): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self._bpe = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self._special = set(special)

    def encode(self, text: str) -> list[int]:
        return self._bpe.encode(text, allowed_special=self._special)


def cut(n: int, context: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids; the first may be shorter."""
    first = n % context or context
    if n <= context:
        return [(0, n)]
    return [(0, first)] + [(at, context) for at in range(first, n, context)]


def tokenize_pieces(docs: DataFrame, tokenizer_path: str | None = None, context: int = CONTEXT) -> DataFrame:
    """Pieces of every document: ids by the tokenizer, then ``END_ID``, cut when over ``context``.

    The ids stay in the task; only their place, number and CRC-32 (little-endian unsigned 32-bit)
    leave it. A null text is an empty one.
    """
    path = tokenizer_path or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = RankEncoder(path).encode
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out: list[list] = [[], [], [], [], []]
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids = np.array(encode(text or "") + [END_ID], dtype="<u4")
                    for i, (start, length) in enumerate(cut(len(ids), context)):
                        crc = zlib.crc32(ids[start : start + length].tobytes())
                        for col, v in zip(out, (doc_id, i, start, length, crc)):
                            col.append(v)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


class _Counts:
    """Pieces left of each length, with the lengths in reach."""

    def __init__(self, counts: np.ndarray):
        self.left = counts.astype(np.int64)

    def single(self, gap: int) -> tuple[int, ...] | None:
        return (gap,) if self.left[gap] > 0 else None

    def pair(self, gap: int) -> tuple[int, ...] | None:
        """The pair with this sum whose larger part is largest."""
        low = np.arange(1, gap // 2 + 1)
        high = gap - low
        ok = (self.left[low] > 0) & (self.left[high] > 0)
        if gap % 2 == 0 and gap >= 2:
            ok[-1] = self.left[gap // 2] > 1
        hit = np.flatnonzero(ok)
        return (int(high[hit[0]]), int(low[hit[0]])) if hit.size else None

    def triple(self, gap: int) -> tuple[int, ...] | None:
        firsts = np.flatnonzero(self.left[1 : gap - 1]) + 1
        for a in firsts[::-1]:
            if 3 * int(a) < gap:
                return None
            self.left[a] -= 1
            rest = self.pair(gap - int(a))
            self.left[a] += 1
            if rest:
                return (int(a), *rest)
        return None

    def best(self, gap: int) -> tuple[int, ...] | None:
        fits = np.flatnonzero(self.left[: gap + 1])
        return (int(fits[-1]),) if fits.size else None


def plan_patterns(counts: np.ndarray, context: int) -> list[tuple[int, tuple[int, ...]]]:
    """(how often, lengths) that use up ``counts`` (index: length) in few sequences.

    Complements of up to three, two and one lengths are tried, and best fit alone, which wins where lengths are
    few; the plan of the fewest sequences is taken.
    """
    plans = (_plan(counts, context, kinds) for kinds in (3, 2, 1, 0))
    return min(plans, key=lambda plan: sum(times for times, _ in plan))


def _plan(counts: np.ndarray, context: int, kinds: int) -> list[tuple[int, tuple[int, ...]]]:
    """A plan, longest lengths first, with exact complements of up to ``kinds`` lengths.

    The gap beside the longest piece is filled by lengths whose sum is exactly
    the gap while such pieces are left; else by the longest that fits, and its residual gap again.
    A pattern is repeated until one of its lengths runs out, so the work depends on the number of
    different lengths, not on the number of pieces.
    """
    c = _Counts(np.concatenate([counts, np.zeros(max(0, context + 1 - len(counts)), np.int64)]))
    ways = [c.single, c.pair, c.triple][:kinds] + [c.best]
    plan = []
    for longest in range(context, 0, -1):
        while c.left[longest]:
            used: list[int] = []
            gap = context

            def take(lengths: tuple[int, ...]) -> None:
                for x in lengths:
                    c.left[x] -= 1
                    used.append(x)

            take((longest,))
            gap -= longest
            while gap > 0:
                found = next((f for f in (look(gap) for look in ways) if f), None)
                if not found:
                    break
                take(found)
                gap -= sum(found)
            parts, times = np.unique(used, return_counts=True)
            more = int((c.left[parts] // times).min())
            c.left[parts] -= more * times
            plan.append((more + 1, tuple(used)))
    return plan


def slots_of(plan: list[tuple[int, tuple[int, ...]]]) -> tuple[np.ndarray, ...]:
    """Arrays (length, first index, sequence, offset): where pieces number index.. of a length go."""
    rows, seen, seq = [], {}, 0
    for times, lengths in plan:
        at = 0
        for x in lengths:
            rows.append((x, seen.get(x, 0), seq, at))
            seen[x] = seen.get(x, 0) + times
            at += x
        seq += times
    rows.sort()
    return tuple(np.array(col, dtype=np.int64) for col in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 4


def pack_pieces(pieces: DataFrame, context: int = CONTEXT) -> DataFrame:
    """``pieces`` (stored; with ``length`` from 1 to ``context``) with ``sequence_id`` and ``offset``.

    Only the histogram of lengths, at most ``context`` rows, goes to the driver. Pieces are
    numbered within their length by a range sort, and the number tells the slot: no task holds all
    pieces of a frequent length.
    """
    histogram = pieces.groupBy("length").count().collect()  # at most ``context`` rows
    counts = np.zeros(context + 1, np.int64)
    for length, n in histogram:
        counts[length] = n
    lengths, firsts, seqs, offsets = slots_of(plan_patterns(counts, context))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = (lengths << 48) + firsts
        for b in batches:
            n = b.schema.names
            idx = b.column(n.index("_idx")).to_numpy()
            slot = np.searchsorted(keys, (b.column(n.index("length")).to_numpy() << 48) + idx, side="right") - 1
            keep = [(x, c) for x, c in zip(n, b.columns) if x != "_idx"]
            keep += [("sequence_id", pa.array(seqs[slot] + idx - firsts[slot])), ("offset", pa.array(offsets[slot]))]
            yield pa.RecordBatch.from_arrays([c for _, c in keep], [x for x, _ in keep])

    numbered = number_rows(pieces, ["length"], ["doc_id", "piece", "ids_crc32"], out="_idx")
    columns = pieces.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return numbered.select(*columns, "_idx").mapInArrow(place, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, context: int = CONTEXT) -> DataFrame:
    """Packs ``docs`` (``doc_id``, ``text``) into sequences of at most ``context`` tokens.

    One row per piece: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``,
    ``sequence_id``, ``offset``. Null or empty texts are one token (the end id). Repeated rows are
    packed each; rows with a null id are packed too. An empty table gives no rows, and other
    columns are ignored. Very long texts are cut, never dropped.
    """
    return pack_pieces(stage(tokenize_pieces(docs, tokenizer_path, context), "pieces"), context)
