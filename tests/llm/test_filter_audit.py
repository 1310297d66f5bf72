import itertools
import random
import re

import pytest

from tickloom.llm import filter_audit as A

DOCS = "doc_id long, text string, source string, part string, n long, mask int"
LABELS = "doc_id long, quality int, toxic int, digest string"


def frames(spark, docs, labels):
    return spark.createDataFrame([(*d, "x", 5, 3) for d in docs], DOCS).repartition(3), spark.createDataFrame([(*r, "y") for r in labels], LABELS)


def fails(docs):
    texts = [t or "" for _, t, _ in docs]
    out = []
    for (i, _, _), t in zip(docs, texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = set()
        if len(words) < 200:
            f.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            f.add("B")
        if 100 * len(re.findall("[A-Z]", t)) > 2 * len(t):
            f.add("C")
        if re.search(r"[#$%&*|]", t):
            f.add("D")
        if i is not None and any(j is not None and j < i and u == t for (j, _, _), u in zip(docs, texts)):
            f.add("E")
        out.append(f)
    return out


def brute(docs, labels):
    marks = fails(docs)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    rows = {}
    for part in {s or "" for _, _, s in docs}:
        own = [(f, i in good, i in toxic) for f, (i, _, s) in zip(marks, docs) if (s or "") == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            for k, x in enumerate(order):
                before = set(order[:k])
                here = [r for r in own if x in r[0] and not r[0] & before]
                total[x] += len(here)
                rows[part, "".join(order), k + 1] = [
                    sum(not r[0] & (before | {x}) for r in own), len(here), sum(x in r[0] and bool(r[0] & before) for r in own),
                    sum(r[0] == {x} for r in own), sum(r[1] for r in here), sum(r[2] for r in here),
                ]
        for (p, order, k), row in rows.items():
            if p == part:
                row.append(total[order[k - 1]])
    return {k: tuple(v) for k, v in rows.items()}


def collected(df):
    return {
        (r["part"], r["filter_order"], r["step"]): (
            r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"], r["shapley"]
        )
        for r in df.collect()
    }


def make(seed):
    r = random.Random(seed)
    pool = ["", " \t\n", "a b", "A B C", "x#y", "wörter 50%", "w " * 260, " ".join(f"w{i}" for i in range(230)),
            " ".join(f"W{i}" for i in range(230)) + " $", "\U0001d400 \x0b|" * 3, " ".join(f"v{i}" for i in range(199))]
    docs = [(r.choice([None, *range(60)]), r.choice([None, *pool]), r.choice([None, "", "hot", "hot", "hot", "é"])) for _ in range(150)]
    labels = [(r.choice([None, *range(80)]), r.choice([None, 0, 1]), r.choice([None, 0, 1])) for _ in range(90)]
    return docs, labels


def test_every_order_against_brute_force(spark):
    docs, labels = make(3)
    got = A.audit_filters(*frames(spark, docs, labels))
    assert got.count() == 120 * 5 * len({s or "" for _, _, s in docs})
    assert collected(got) == brute(docs, labels)


def test_ties_and_copies_across_parts(spark):
    text = "same text"
    docs = [(2, text, "a"), (2, text, "b"), (1, text, "b"), (1, text, "b"), (None, text, "a"), (3, text, None), (7, None, "a"), (6, "", "b")]
    labels = [(1, 1, 0), (1, 0, 1), (2, 1, None)]
    assert collected(A.audit_filters(*frames(spark, docs, labels))) == brute(docs, labels)


def test_empty_tables(spark):
    docs, labels = make(4)
    assert A.audit_filters(*frames(spark, [], labels)).count() == 0
    assert collected(A.audit_filters(*frames(spark, docs[:20], []))) == brute(docs[:20], [])


def test_very_long_text(spark):
    docs = [(1, "lorem ipsum " * 300_000, "s"), (2, "lorem ipsum " * 300_000, "s"), (3, "a" * 2_000_000, "s")]
    assert collected(A.audit_filters(*frames(spark, docs, []))) == brute(docs, [])


def test_other_numbers_of_filters(spark):
    cells = spark.createDataFrame([("p", 0, 5, 1, 0), ("p", 1, 2, 1, 1), ("p", 3, 4, 0, 2)], "part string, mask int, n long, good long, toxic long")
    got = collected(A.audit_orders(cells, "XY"))
    assert got["p", "XY", 1] == (5, 6, 0, 2, 1, 3, 8) and got["p", "YX", 2] == (5, 2, 4, 2, 1, 1, 8)
    with pytest.raises(ValueError):
        A.audit_orders(cells, "XX")
