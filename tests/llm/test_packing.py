import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tickloom.llm import packing as P


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(P.default_tokenizer())


def test_ids_are_those_of_the_tokenizer(reference):
    enc, r = P.RankEncoder(P.default_tokenizer()), random.Random(1)
    pool = [chr(c) for c in [*range(0, 0x250), 0x2028, 0x3000, 0x200B, 0xFEFF, 0x1680, 0x4E2D, 0x1F600, 0x200D, 0x301, 0x660, 0xFF11, 0x10FFFF]]
    pool += ["<|endoftext|>", "'s", "'LL", " ", " ", "\n", "\r\n", "  "]
    for _ in range(4000):
        t = "".join(r.choice(pool) for _ in range(r.randrange(0, 24)))
        assert enc.encode(t) == reference.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("n,parts", [(1, [(0, 1)]), (8, [(0, 8)]), (9, [(0, 1), (1, 8)]), (16, [(0, 8), (8, 8)]), (20, [(0, 4), (4, 8), (12, 8)])])
def test_cuts(n, parts):
    assert P.cut(n, 8) == parts


@pytest.mark.parametrize("seed", range(6))
def test_plans_use_every_piece_once(seed):
    r = np.random.default_rng(seed)
    counts = np.zeros(101, np.int64)
    kinds = r.integers(1, 101, r.integers(1, 60))
    counts[kinds] = r.integers(1, 400, len(kinds))
    plan = P.plan_patterns(counts.copy(), 100)
    used = np.zeros(101, np.int64)
    for times, lengths in plan:
        assert sum(lengths) <= 100
        np.add.at(used, list(lengths), times)
    assert (used == counts).all()
    # First fit decreasing as the yardstick.
    bins = []
    for x in np.repeat(np.arange(101), counts)[::-1].tolist():
        for i, b in enumerate(bins):
            if b + x <= 100:
                bins[i] += x
                break
        else:
            bins.append(x)
    assert sum(t for t, _ in plan) <= len(bins)


def test_exact_complements_are_found_first():
    counts = np.zeros(11, np.int64)
    counts[[7, 3, 6, 4, 5, 1]] = [1, 1, 1, 1, 1, 4]
    plan = P.plan_patterns(counts, 10)
    assert sum(t for t, _ in plan) == 3 and all(sum(x) in (10, 9) for _, x in plan)


def test_documents(spark, reference):
    r = random.Random(3)
    texts = [None, "", "a <|endoftext|> b", "dup", "dup", "x y z " * 9000] + ["w" * r.randrange(1, 40) + " ab" * r.randrange(0, 900) for _ in range(60)]
    df = spark.createDataFrame([(i if i != 3 else None, t, 7, 8) for i, t in enumerate(texts)], "doc_id long, text string, length int, piece int")
    rows = P.pack_documents(df).collect()
    by, seqs = {}, {}
    for x in rows:
        by.setdefault(x["doc_id"], []).append(x)
        seqs.setdefault(x["sequence_id"], []).append(x)
    for i, t in enumerate(texts):
        ids = np.array(reference.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        got = sorted(by[i if i != 3 else None], key=lambda x: x["piece"])
        assert [x["piece"] for x in got] == list(range(len(got))) and sum(x["length"] for x in got) == len(ids)
        for x in got:
            assert x["ids_crc32"] == zlib.crc32(ids[x["start"] : x["start"] + x["length"]].tobytes())
        assert all(x["length"] == 2048 for x in got[1:])
    for s in seqs.values():
        at = 0
        for x in sorted(s, key=lambda x: x["offset"]):
            assert x["offset"] == at
            at += x["length"]
        assert at <= 2048
    assert len(seqs) <= -(-sum(x["length"] for x in rows) // 2048) + 1
    assert P.pack_documents(df.where("false")).count() == 0
    again = P.pack_documents(spark.createDataFrame([(5, "same"), (5, "same")], "doc_id long, text string")).collect()
    assert sorted(x["offset"] for x in again) == [0, again[0]["length"]]
