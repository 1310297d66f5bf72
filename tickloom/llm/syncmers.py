"""Document fingerprints from closed syncmers (DataFrame functions only).

A k-mer of the text's UTF-8 bytes is chosen if the smallest hash among its inner s-mers is that of
its first or its last one. Whether it is chosen depends on the k-mer alone, so equal passages give equal
anchors wherever they stand. The fingerprint is the set of smallest hashes of the chosen k-mers, each with
the place of its first occurrence. Two texts are matched by position: of the anchors that both have, the longest run of
them that stands in the same order in both counts, as a share of the anchors of either.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tickloom.llm.common import let, text_or_empty
from tickloom.plans.ranking import number_rows
from tickloom.session import stage

#: Bytes of a k-mer and of its inner substrings, and hashes kept of a text.
K, S, SKETCH = 12, 8, 64
#: Bytes of a text that are looked at as one array; parts overlap by K - 1 and are merged.
PART = 8192
#: An anchor is one long: 32 bits of its hash over as many of its place in bytes.
_PLACE_BITS = 31
_PLACE = (1 << _PLACE_BITS) - 1


def _anchor(hash_: Column, place: Column) -> Column:
    return F.shiftleft(hash_.bitwiseAND(0xFFFFFFFF), _PLACE_BITS).bitwiseOR(place.cast("long"))


def _hash(anchor: Column) -> Column:
    return F.shiftright(anchor, _PLACE_BITS)


def _anchors(part: Column, start: Column, k: int, s: int) -> Column:
    """The closed syncmers of a binary variable that begins at byte ``start`` of its text."""
    inner = k - s + 1
    places = F.sequence(F.lit(1), F.octet_length(part) - (s - 1))
    hashes = F.transform(places, lambda i: F.xxhash64(F.substring(part, i, F.lit(s))))

    def chosen(h: Column) -> Column:
        def key(first: Column, i: Column) -> Column:
            last = F.get(h, i + (inner - 1))
            between = [F.get(h, i + j) for j in range(1, inner - 1)]
            # The two inner strings cover the k-mer, so their hashes in this order stand for it.
            # Beyond the last k-mer there is no last one; hashes and least values would pass over the null.
            return F.when(last.isNotNull() & (F.least(first, last) <= F.least(*between)), _anchor(F.xxhash64(first, last), start + i))

        return F.array_compact(F.transform(h, key))

    return let(hashes, chosen)


def _smallest(anchors: Column, size: int) -> Column:
    """The ``size`` smallest hashes, ascending, each at its first place."""
    first = lambda a: F.filter(a, lambda x, i: (i == 0) | (_hash(x) != _hash(F.get(a, i - 1))))
    return F.slice(let(F.array_sort(anchors), first), 1, size)


def _least(data: Column, start: Column, k: int, s: int, size: int, part: int) -> Column:
    """The ``size`` smallest anchors of a binary variable that begins at byte ``start`` of its text; none if it is shorter than k.

    Long ones are taken in overlapping parts, each reduced to its smallest anchors before they are merged.
    """

    def low(keys: Column) -> Column:
        """The smallest of many: sorts only those under a bound that leaves about four times as many as are kept."""
        bound = F.lit(4.0 * size * (1 << 32)) / F.greatest(F.size(keys), F.lit(1))
        few = F.filter(keys, lambda x: _hash(x) < bound.cast("long"))
        return let(_smallest(few, size), lambda f: F.when(F.size(f) == size, f).otherwise(_smallest(keys, size)))

    starts = F.transform(F.sequence(F.lit(0), F.floor((F.octet_length(data) - k) / F.lit(part)).cast("int")), lambda j: j * part)
    cut = lambda at: F.substring(data, at + 1, F.lit(part + k - 1))
    kept = F.flatten(F.transform(starts, lambda at: let(cut(at), lambda p: let(_anchors(p, start + at, k, s), low))))
    return F.when(F.octet_length(data) < k, F.array().cast("array<bigint>")).otherwise(_smallest(kept, size))


def _named(anchors: Column, whole: Column) -> Column:
    """The anchors, or the hash of the whole text if there are none."""
    return F.when(F.size(anchors) == 0, F.array(_anchor(whole, F.lit(0)))).otherwise(anchors)


def fingerprint(text: Column, k: int = K, s: int = S, size: int = SKETCH, part: int = PART) -> Column:
    """The ``size`` smallest anchors of the text, ascending (array of long: 32 bits of hash, 31 of place).

    A text shorter than k bytes, or without a closed syncmer, is its own only anchor; null counts as empty.
    """
    whole = lambda data: let(_least(data, F.lit(0), k, s, size, part), lambda m: _named(m, F.xxhash64(data)))
    return let(text_or_empty(text).cast("binary"), whole)


def _kept_chars(text: Column) -> Column:
    """The part of a text that its edited text begins with."""
    n = F.char_length(text)
    return F.left(text, n - F.floor(n / 2).cast("int"))


def _shared(kept: Column) -> Column:
    """Number of k-mers that begin in the kept part of a text and end there: they are those of the edited text as well."""
    return F.greatest(F.octet_length(kept) - (K - 1), F.lit(0))


def _beyond(text: Column, shared: Column) -> Column:
    """The smallest anchors of a text's k-mers from the place ``shared`` on."""
    rest = let(text.cast("binary"), lambda data: F.substring(data, shared + 1, F.octet_length(data)))
    return let(rest, lambda data: _least(data, shared, K, S, SKETCH, PART))


def _marks(text: Column) -> Column:
    """The smallest anchors of a text (none if it has no closed syncmer), then those of the kept part's smallest that are not among them."""

    def both(kept: Column) -> Column:
        begin = let(kept.cast("binary"), lambda data: _least(data, F.lit(0), K, S, SKETCH, PART))
        return let(begin, lambda a: let(_smallest(F.concat(a, _beyond(text, _shared(kept))), SKETCH), lambda m: F.concat(m, F.array_except(a, m))))

    return let(_kept_chars(text), both)


def _of_text(marks: Column) -> Column:
    return F.slice(marks, 1, SKETCH)


def _of_edited(marks: Column, kept: Column, edited: Column) -> Column:
    """The smallest anchors of an edited text: the kept part's are known, those beyond it are looked for."""

    def merged(shared: Column) -> Column:
        begin = F.filter(marks, lambda x: x.bitwiseAND(_PLACE) < shared)
        return _smallest(F.concat(begin, _beyond(edited, shared)), SKETCH)

    return let(_shared(kept), merged)


def as_text(fp: Column) -> Column:
    """16 hex digits per anchor."""
    return F.lower(F.array_join(F.transform(fp, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def _longest_rise(places: Column) -> Column:
    """Length of the longest rising subsequence: smallest ends of the rising runs of each length, kept element by element."""

    def put(ends: Column, x: Column) -> Column:
        below = F.filter(ends, lambda e: e < x)
        return let(below, lambda b: F.concat(b, F.array(x), F.slice(ends, F.size(b) + 2, F.greatest(F.size(ends), F.lit(1)))))

    return F.size(F.aggregate(places, F.array().cast("array<bigint>"), put))


def likeness(a: Column, b: Column, size: int = SKETCH) -> Column:
    """The part of the smallest hashes of either text that both have in the same order (0 to 1)."""

    def matched(hashes_a: Column, hashes_b: Column) -> Column:
        both = F.slice(F.array_sort(F.array_union(hashes_a, hashes_b)), 1, size)
        return let(both, lambda u: let(F.array_intersect(F.array_intersect(u, hashes_a), hashes_b), lambda shared: ordered(shared) / F.size(u)))

    def ordered(shared: Column) -> Column:
        # Both are ascending by hash, so those of the shared hashes stand beside each other.
        held = lambda fp: F.transform(F.filter(fp, lambda x: F.array_contains(shared, _hash(x))), lambda x: x.bitwiseAND(_PLACE))
        pairs = F.zip_with(held(a), held(b), lambda x, y: F.shiftleft(x, _PLACE_BITS).bitwiseOR(y))
        return _longest_rise(F.transform(F.array_sort(pairs), lambda x: x.bitwiseAND(_PLACE))).cast("double")

    hashes = lambda fp: F.transform(fp, _hash)
    return let(hashes(a), lambda x: let(hashes(b), lambda y: matched(x, y)))


def _same(id_: str, hash_: str, out: str) -> list[Column]:
    """Columns that identify a document, a null id included. Equality of them joins and groups by one partitioning."""
    return [F.coalesce(F.col(id_), F.lit(0)).alias(f"{out}0"), F.col(id_).isNull().alias(f"{out}1"), F.col(hash_).alias(f"{out}2")]


def _equal(a: str, b: str) -> list[Column]:
    return [F.col(f"{a}{i}") == F.col(f"{b}{i}") for i in range(3)]


def edited_pairs(docs: DataFrame) -> DataFrame:
    """Each text with its edited text: ``doc_id``, ``hash``, ``text``, ``marks``, ``edited``, and the next document's ``next_hash``, ``next_marks``.

    The edited text has the last floor(n / 2) code points replaced by the first as many (or all) of the next document by
    ascending doc_id (null first); the last is followed by the first. Only ids are sorted; a text
    is shuffled once under its own id and its head once under the id before, each with the text's smallest anchors. Both joins
    are merged whatever their size and take the same columns of the texts, so that one shuffle of these serves both.
    """
    own = docs.select("doc_id", F.xxhash64(text_or_empty("text")).alias("hash"), text_or_empty("text").alias("text"))
    ids = own.groupBy("doc_id", "hash").agg(F.max(F.char_length("text")).alias("n"))
    own = own.select("text", _marks(F.col("text")).alias("marks"), *_same("doc_id", "hash", "o"))
    order = stage(number_rows(stage(ids, "ids"), [], ["doc_id", "hash"], out="at"), "order")
    total = order.count()
    before = order.select(
        F.pmod(F.col("at") + 1, F.lit(max(total, 1))).alias("at"), F.col("doc_id").alias("p_id"), F.col("hash").alias("p_hash"),
        F.floor(F.col("n") / 2).cast("int").alias("take"),
    )
    links = order.join(before, "at").select(*_same("doc_id", "hash", "k"), *_same("p_id", "p_hash", "p"), "take")
    heads = own.join(links.hint("merge"), _equal("o", "k")).groupBy("p0", "p1", "p2").agg(
        F.first(F.left("text", "take")).alias("head"), F.first("o2").alias("next_hash"), F.first(_of_text(F.col("marks"))).alias("next_marks"),
    )
    joined = own.join(heads.hint("merge"), _equal("o", "p"))
    edited = F.concat(_kept_chars(F.col("text")), F.col("head"))
    doc_id = F.when(~F.col("o1"), F.col("o0")).alias("doc_id")
    return joined.select(doc_id, F.col("o2").alias("hash"), "text", "marks", edited.alias("edited"), "next_hash", "next_marks")


def compare_edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text of ``docs`` (``doc_id``, ``text``) and of its edited text, and their likeness.

    Columns: ``doc_id``, ``n_chars``, ``edited_sha256``, ``fingerprint`` and
    ``edited_fingerprint`` (hex), ``near_edited`` and ``near_next`` (the next document's).

    Likeness is by position: a text with its halves swapped is about half like itself. Null texts count as empty; two
    empty texts are alike (1). Texts shorter than a k-mer are alike
    only if equal. Rows that share id and text are one document in the order and each get its
    result; rows that share only the id follow each other by a hash of the text. With a single document the next
    is itself. An empty table gives an empty result, and other columns are ignored.
    """
    marks, edited = F.col("marks"), F.col("edited")
    met = edited_pairs(docs).select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2(edited.cast("binary"), 256).alias("edited_sha256"),
        _named(_of_text(marks), F.col("hash")).alias("fp"),
        let(_of_edited(marks, _kept_chars(F.col("text")), edited), lambda m: _named(m, F.xxhash64(edited))).alias("fp2"),
        _named(F.col("next_marks"), F.col("next_hash")).alias("n_fp"),
    )
    return met.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("fp")).alias("fingerprint"), as_text(F.col("fp2")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("fp2")).alias("near_edited"), likeness(F.col("fp"), F.col("n_fp")).alias("near_next"),
    )
