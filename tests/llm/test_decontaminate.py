import hashlib
import random
import re

import pytest

from tickloom.llm import decontaminate as C


def frames(spark, docs, items):
    return (
        spark.createDataFrame([(*d, "z", 4) for d in docs], "doc_id long, text string, _text string, n_hit int").repartition(3),
        spark.createDataFrame([(*b, "q") for b in items], "item_id long, text string, win string"),
    )


def words_of(text):
    fold = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", fold)


def hits_of(text, items, window=10):
    words, covered, found = words_of(text), set(), set()
    for item, t in items:
        w = words_of(t)
        n = min(window, len(w))
        wins = {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if n else set()
        for i in range(len(words) - n + 1):
            if tuple(words[i:i + n]) in wins:
                covered |= set(range(i, i + n))
                found.add("" if item is None else str(item))
    return words, covered, sorted(found)


def brute(docs, items, window=10):
    out = []
    for doc, text in docs:
        words, covered, found = hits_of(text, items, window)
        out.append((doc, len(words), len(covered), len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), bool(covered)))
    return sorted(out, key=repr)


def collected(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in df.collect()), key=repr)


def make(seed):
    r = random.Random(seed)
    vocabulary = ["the", "a", "Été", "x1", "7", "日本", "Zoo", "q", "and"] + [f"w{i}" for i in range(30)]
    text = lambda n: r.choice([" ", ", ", "-"]).join(r.choice(vocabulary) for _ in range(n))
    items = [(i, text(r.choice([10, 11, 25, 40]))) for i in (*range(14), 100, 20)] + [(3, text(12)), (None, text(15)), (30, text(4)), (31, "?!"), (32, None), (33, "")]
    items += [(40, items[0][1]), (41, items[0][1].upper() if items[0][1].isascii() else items[0][1])]
    docs = []
    for i in range(120):
        body = text(r.randrange(0, 60))
        for _ in range(r.choice([0, 0, 1, 3])):
            passage = (r.choice(items)[1] or "").split(" ")
            at = r.randrange(max(1, len(passage) - 10))
            body += ". " + " ".join(passage[at:at + r.randrange(5, 30)]) + r.choice([" ", "! ", "\n"]) + text(r.randrange(0, 8))
        docs.append((r.choice([None, i, 5]), r.choice([body, body, body.title(), None if i % 17 == 0 else body])))
    return docs + docs[:9], items


@pytest.mark.parametrize("limits", [{}, {"set_windows": 0}, {"set_bytes": 10}])
def test_against_brute_force(spark, limits):
    docs, items = make(5)
    want = brute(docs, items)
    assert sum(w[-1] for w in want) > 30
    assert collected(C.find_contamination(*frames(spark, docs, items), **limits)) == want


def test_items_of_one_word_and_overlaps(spark):
    docs = [(1, "the cat the the"), (2, "THE"), (3, "cat"), (4, "thé them"), (5, "b c a b c a b")]
    items = [(9, "The"), (10, "a b c a"), (11, "c a b c"), (100, "the")]
    for limits in ({}, {"set_windows": 0}):
        assert collected(C.find_contamination(*frames(spark, docs, items), window=4, **limits)) == brute(docs, items, 4)


def test_empty_tables_and_long_texts(spark):
    docs, items = make(6)
    assert C.find_contamination(*frames(spark, [], items)).count() == 0
    assert collected(C.find_contamination(*frames(spark, docs[:9], []))) == brute(docs[:9], [])
    passage = items[0][1]
    long = [(1, "filler words " * 150_000 + passage + " filler" * 10), (2, "y" * 2_000_000)]
    assert collected(C.find_contamination(*frames(spark, long, items[:3]))) == brute(long, items[:3])


def removed(text, items):
    _, covered, _ = hits_of(text, items)
    if not covered:
        return text
    word = "[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+"
    words, gaps = re.findall(word, text), re.split(word, text)
    out = [gaps[0] + ("" if 0 in covered else words[0])]
    for i in range(1, len(words)):
        out.append(("" if i in covered and i - 1 in covered else gaps[i]) + ("" if i in covered else words[i]))
    return "".join(out) + gaps[-1]


@pytest.mark.parametrize("limits", [{}, {"set_windows": 0}])
def test_removing_spans_or_documents(spark, limits):
    docs, items = make(7)
    df, bench = frames(spark, docs, items)
    cut = C.decontaminate(df, bench, **limits)
    assert cut.columns == df.columns
    assert sorted(((r[0], r[1]) for r in cut.collect()), key=repr) == sorted(((i, removed(t, items)) for i, t in docs), key=repr)
    kept = C.decontaminate(df, bench, remove="documents", **limits)
    assert sorted(((r[0], r[1], r[2]) for r in kept.collect()), key=repr) == sorted(((i, t, "z") for i, t in docs if not hits_of(t, items)[1]), key=repr)
    with pytest.raises(ValueError):
        C.decontaminate(df, bench, remove="all")
