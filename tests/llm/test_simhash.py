import re

import numpy as np
import pytest
import xxhash

from tickloom.llm import simhash as S


def brute_fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, radius=2):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if bin(prints[a] ^ prints[b]).count("1") <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(prints))]


@pytest.mark.parametrize("words,radius", [(1, 0), (1, 2), (2, 5), (16, 160)])
def test_bit_sliced_pairs(words, radius):
    rng = np.random.default_rng(words * 100 + radius)
    base = rng.integers(0, 2**64, size=(30, words), dtype=np.uint64)
    fps = base[rng.integers(0, 30, 400)].copy()
    for row in fps:
        for b in rng.integers(0, 64 * words, rng.integers(0, 2 * radius + 2)):
            row[b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    group = np.sort(rng.integers(0, 9, len(fps)))
    end = np.searchsorted(group, group, side="right")
    got = set()
    for i, j in S.close_pairs(fps, np.arange(1, len(fps) + 1), end, radius):
        got |= set(zip(i.tolist(), j.tolist()))
    bits = lambda x: sum(bin(int(v)).count("1") for v in x)
    want = {(i, j) for i in range(400) for j in range(i + 1, end[i]) if bits(fps[i] ^ fps[j]) <= radius}
    assert want and got == want


def near_prints(n, seed):
    rng = np.random.default_rng(seed)
    base = [int(x) for x in rng.integers(0, 2**63, 12)]
    return [base[rng.integers(0, 12)] ^ sum({1 << int(b) for b in rng.integers(0, 64, rng.integers(0, 5))}) for _ in range(n)]


@pytest.mark.parametrize("block_rows", [16_384, 5])
def test_links_at_every_block_size(spark, block_rows):
    prints = sorted(set(near_prints(300, 3)))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    rows = [(s, p.to_bytes(8, "big")) for s, p in zip(signed, prints)]
    df = spark.createDataFrame([(a, bytearray(b)) for a, b in rows], "id long, fp binary")
    edges = S.link_close(df, block_rows).select("a", "b")
    from tickloom.llm.common import components

    root = {r["node"]: r["root"] for r in components(edges).collect()}
    want = brute_components(prints)
    got = [root.get(s, s) for s in signed]
    for i in range(len(prints)):
        assert (got[i] == got[want[i]]) and (len({got[j] for j in range(len(prints)) if want[j] == want[i]}) == 1)
    assert len(set(got)) == len(set(want))


TEXTS = [None, "", "  \n", "one", "ONE", "one two", "a b c d", "A B c d", "x " * 3000, "x " * 3000 + "y", "é É ü\x0bz w", "q r s t u v w"]


def test_classes_of_odd_texts(spark):
    rows = [(i, t, 0, "k") for i, t in enumerate(TEXTS)] + [(None, "a b c d", 1, "k"), (3, "one", 1, "k")]
    got = S.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, id int, key string")).collect()
    prints = [brute_fingerprint(t) for t in TEXTS]
    roots = brute_components(prints)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], set()).add((r["fingerprint"], r["component_id"]))
    for i in range(len(TEXTS)):
        assert by[i] == {(f"{prints[i]:016x}", roots[i])}
    assert len(got) == len(rows) and by[None] == {(f"{prints[6]:016x}", 6)}
    assert S.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def words(seed, n):
    import random

    r = random.Random(seed)
    return ["".join(r.choice("abcdefgh") for _ in range(r.randrange(3, 9))) for _ in range(n)]


def test_stage_groups_near_copies_and_leaves_the_rest(spark):
    rows, kept = [], set()
    for i in range(20):
        w = words(i, 400)
        rows += [(10 * i, " ".join(w)), (10 * i + 1, " ".join(w))]  # exact copy
        near = list(w)
        for at in (50, 200, 350):  # three changed words: similarity about 0.93
            near[at] = "changed"
        rows.append((10 * i + 2, " ".join(near)))
        far = list(w)
        for at in range(0, 400, 10):  # similarity about 0.33
            far[at] = "other"
        rows.append((10 * i + 3, " ".join(far)))
        kept |= {10 * i, 10 * i + 3}
    rows += [(900, None), (901, ""), (None, "only one of its kind here"), (902, "tie tie"), (902, "tie tie")]
    df = spark.createDataFrame([(a, b, "s") for a, b in rows], "doc_id long, text string, key string")
    got = S.keep_one_each(df)
    assert got.columns == df.columns
    assert sorted(r["doc_id"] for r in got.collect() if r["doc_id"] is not None) == sorted(kept | {900, 902})
    assert got.where("doc_id is null").count() == 1
    tiled = S.near_duplicate_groups(df, block_rows=3).where("doc_id = group_id").distinct().count()
    assert tiled == len(kept | {900, 902})


def test_stage_keeps_every_group_without_an_id_or_with_a_shared_one(spark):
    text = {i: " ".join(words(100 + i, 60)) for i in range(6)}
    rows = [(None, text[0]), (None, text[0]), (None, text[1]), (None, text[2]), (7, text[3]), (7, text[4]), (7, text[4]), (None, text[5]), (8, text[5])]
    got = S.keep_one_each(spark.createDataFrame(rows, "doc_id long, text string"))
    want = [(None, text[0]), (None, text[1]), (None, text[2]), (7, text[3]), (7, text[4]), (8, text[5])]
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in got.collect()))) == sorted(map(str, want))


def test_stage_decides_by_jaccard_of_distinct_shingles(spark):
    line, body = words(300, 6), words(301, 300)
    repeated, once = body + line * 60, body + line  # nearly one set, but most of the first text is the line
    boiler = words(302, 6) * 80
    shared = [boiler + words(303 + i, 200) for i in range(2)]  # mostly equal shingles, sets mostly different
    near, at = [words(400 + i, 504) for i in range(20)], []
    for i, w in enumerate(near):  # 500 shingles, 55 of them changed: Jaccard 445 / 555, just above 0.8
        at.append([x + "z" if n % 45 == 20 and n < 480 else x for n, x in enumerate(w)])
    pairs = [(repeated, once), tuple(shared), *zip(near, at)]
    rows = [(2 * n + s, " ".join(p[s])) for n, p in enumerate(pairs) for s in (0, 1)]
    got = {r["doc_id"]: r["group_id"] for r in S.near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {i: set(S.shingle_hashes(t, S.STAGE_WIDTH).tolist()) for i, t in rows}
    for n in range(len(pairs)):
        a, b = sets[2 * n], sets[2 * n + 1]
        assert (got[2 * n] == got[2 * n + 1]) == (len(a & b) >= 0.8 * len(a | b)), n
    assert got[1] == 0 and got[3] == 3 and all(got[2 * n + 1] == 2 * n for n in range(2, len(pairs)))
