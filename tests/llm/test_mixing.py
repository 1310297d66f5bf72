import pytest

from tickloom.llm import mixing as M


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, 5) for i, t, s in rows], "doc_id long, text string, source string, size int")


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, cap=2):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = min(share, cap) * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if level * w[s] >= cap * sizes[s]}
        if not full:
            out |= {s: level * w[s] for s in open_}
            break
        for s in full:
            out[s] = cap * sizes[s]
            left -= out[s]
        open_ -= full
    return out


@pytest.fixture(scope="module")
def mixed(spark):
    import random

    r = random.Random(4)
    rows = []
    for i in range(3000):
        source = r.choice(["hot"] * 12 + ["b", "é", "Z", None, "rare" if i % 50 == 0 else "c"])
        rows.append((i, " ".join(["w"] * r.randrange(0, 120)), source))
    df = frame(spark, rows)
    return rows, [r.asDict() | {"source": rows[r["doc_id"]][2]} for r in M.mix_sources(df).collect()], df


def test_targets_and_words_taken(mixed):
    rows, got, _ = mixed
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want = brute_targets(sizes)
    assert len(got) == len(rows)
    for s, target in want.items():
        own = [r for r in got if r["source"] == s]
        assert all(r["source_size"] == sizes[s] and abs(r["target"] - target) < 1e-6 for r in own)
        assert abs(sum(r["taken"] for r in own) - target) <= 120
    assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in got)


def test_reruns_agree_whatever_the_partitions(mixed):
    _, got, df = mixed
    again = {r["doc_id"]: r["taken"] for r in M.mix_sources(df.repartition(7)).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in got}


def test_odd_rows(spark):
    rows = [(1, None, None), (2, "", "a"), (None, "x y", "a"), (3, "x y z", "b"), (3, "x y z", "b"), (4, "w " * 50000, "c")]
    got = M.mix_sources(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    assert sum(r["taken"] for r in got if r["doc_id"] in (1, 2)) == 0
    assert all(r["taken"] <= 2 * r["size"] for r in got)
    assert M.mix_sources(frame(spark, [])).count() == 0
    assert M.mix_sources(frame(spark, [(1, None, "a"), (2, "", "b")])).where("taken > 0").count() == 0
