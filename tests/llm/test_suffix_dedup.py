import collections
import hashlib
import random

import numpy as np
import pytest

from tickloom.llm import suffix_dedup as S


def brute(texts, size):
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(d[i : i + size] for d in data for i in range(len(d) - size + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - size + 1):
            if seen[d[i : i + size]] > 1:
                gone[i : i + size] = True
        runs = int((np.diff(np.concatenate([[False], gone]).astype(int)) == 1).sum())
        kept = bytes(x for x, g in zip(d, gone) if not g)
        out.append((len(d), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest(), kept))
    return out


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    some = lambda n: "".join(r.choice("abcdé ") for _ in range(n))
    base = [some(r.randrange(100, 900)) for _ in range(20)]
    out = [None, "", "x" * 30, "a" * 500, "a" * 300, *base, base[3], base[4], base[4]]
    shared, more = some(120), some(60)
    for _ in range(30):
        a, b = r.choice(base), r.choice(base)
        t = a[: r.randrange(len(a))] + some(r.randrange(5)) + b[r.randrange(len(b)) :] + shared[: r.randrange(len(shared))]
        k = r.randrange(len(t) + 1)
        out.append(t[:k] + r.choice("zyxw") + t[k:])
    return out + [some(40) + shared + more + some(50) for _ in range(8)] + ["ab" * 400, "abcabcabd" * 80]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, 1, "k") for i, t in enumerate(texts)], "doc_id long, text string, key int, kept string")


@pytest.mark.parametrize("size", [64, 200])
@pytest.mark.parametrize("class_rows", [100_000, 3])
def test_against_every_string(spark, texts, monkeypatch, size, class_rows):
    monkeypatch.setattr(S.repeated_parts, "__defaults__", (S.THRESHOLD, class_rows))
    got = [tuple(r)[1:] for r in S.remove_repeats(frame(spark, texts), size).orderBy("doc_id").collect()]
    assert got == [w[:4] for w in brute(texts, size)]


def test_segments_of_long_texts(spark, texts, monkeypatch):
    joined = " ".join(t for t in texts if t)
    rows = [r for r in S.anchor_rows(joined.encode(), 64)]
    monkeypatch.setattr(S, "_SEGMENT", 700)
    cut = [r for r in S.anchor_rows(joined.encode(), 64)]
    starts = lambda rows: sorted(s for _, _, p in rows for s in range(p >> 16, (p >> 16) + (p >> 8 & 255) + 1))
    assert starts(cut) == starts(rows) == list(range(len(joined.encode()) - 63))


def test_texts_without_repeats(spark, texts):
    df = frame(spark, texts).withColumnRenamed("key", "n_chars")
    got = S.without_repeats(df)
    assert got.columns == df.columns
    want = [w[4].decode("utf-8", "ignore") for w in brute(texts, 200)]
    for r in got.collect():
        t = texts[r["doc_id"]]
        assert r["text"] == (None if t is None else want[r["doc_id"]])
        if t and r["text"] != t:
            assert r["n_chars"] == len(r["text"])


def test_odd_rows(spark):
    assert S.remove_repeats(frame(spark, [])).count() == 0
    rows = [(None, "q" * 10), (1, "r" * 199), (1, "r" * 199), (2, "s" * 250), (2, "s" * 250), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_removed"], r["n_spans"]) for r in S.remove_repeats(df).collect())
    assert got == [(0, 0, 0, 0), (0, 10, 0, 0), (1, 199, 0, 0), (1, 199, 0, 0), (2, 250, 250, 1), (2, 250, 250, 1)]
