from collections import Counter

import pytest

from tickloom.llm import licenses as L
from pyspark.sql import functions as F


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "MIT", 1.0) for i, t in rows], "doc_id long, text string, license string, dice double")


def test_every_template_is_found_in_other_dress(spark):
    rows = []
    for i, (name, body) in enumerate(L.TEMPLATES.items()):
        wrapped = body.upper().replace(". ", ".\n *  ")
        rows.append((i, f"some prose before\n\n{wrapped}\n\nand after it"))
    got = {r["doc_id"]: r for r in L.scan_licenses(frame(spark, rows)).collect()}
    for i, name in enumerate(L.TEMPLATES):
        assert got[i]["license"] == name and got[i]["dice"] == 1.0, name


def brute(spark, passages, threshold):
    """The best template of each passage, without pruning."""
    norm = lambda texts: [r["g"] for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i")
                          .select(L.bigrams_of(L.words_of(F.col("t"))).alias("g")).collect()]
    temps = dict(zip(L.TEMPLATES, map(Counter, norm(list(L.TEMPLATES.values())))))
    out = []
    for g in map(Counter, norm(passages)):
        best = [(-2 * sum((g & t).values()) / max(1, sum(g.values()) + sum(t.values())), k) for k, t in temps.items()]
        d, k = min(best)
        out.append((k, -d) if -d >= threshold - 1e-12 else (None, None))
    return out


@pytest.mark.parametrize("threshold", [0.6, 0.9])
def test_pruning_loses_nothing(spark, threshold):
    import random

    r, passages = random.Random(2), []
    for body in L.TEMPLATES.values():
        for _ in range(4):
            w = body.split()
            for _ in range(r.randrange(0, max(2, len(w) // 6))):
                k = r.randrange(len(w))
                w[k : k + 1] = r.choice([[], ["another"], [w[k], w[k]]])
            passages.append(" ".join(w))
    got = {r["doc_id"]: r for r in L.scan_licenses(frame(spark, list(enumerate(passages))), threshold=threshold).collect()}
    for i, (k, d) in enumerate(brute(spark, passages, threshold)):
        assert got[i]["license"] == k and (d is None or abs(got[i]["dice"] - d) < 1e-9)


def test_odd_rows(spark):
    mit = L.TEMPLATES["MIT"]
    rows = [(1, None), (2, ""), (3, mit), (3, mit), (None, "All rights -- reserved"), (4, "prose " * 200_000 + "\nReleased under the MIT License."),
            (5, "All rights reserved.\nAll rights reserved.\nReleased under the MIT License.")]
    got = L.scan_licenses(frame(spark, rows)).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows)
    assert by[1]["license"] is None and by[1]["n_passages"] == 0 and by[2]["license"] is None
    assert by[3]["license"] == "MIT" and by[None]["license"] == "All-rights-reserved" and by[4]["license"] == "MIT-notice"
    assert by[5]["license"] == "All-rights-reserved" and by[5]["n_passages"] == 2
    assert L.scan_licenses(frame(spark, [])).count() == 0
