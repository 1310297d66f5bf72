import hashlib

from pyspark.sql import functions as F

from tickloom.llm import syncmers as S

SCHEMA = "doc_id long, text string, hash string, n int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)


def words(seed, n):
    import random

    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghéß") for _ in range(r.randrange(2, 9))) for _ in range(n))


def jaccard(a, b, k=S.K):
    sets = [{t[i : i + k] for i in range(max(1, len(t) - k + 1))} for t in (a.encode(), b.encode())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_edited_texts_and_likeness(spark):
    texts = [words(i, 400) for i in range(12)]
    texts[5] = texts[4]
    got = {r["doc_id"]: r for r in S.compare_edited(frame(spark, list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        after = texts[(i + 1) % len(texts)]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        r = got[i]
        assert r["n_chars"] == len(t)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(r["near_edited"] - jaccard(t, edited)) < 0.25
        assert abs(r["near_next"] - jaccard(t, after)) < 0.1
    assert got[4]["fingerprint"] == got[5]["fingerprint"] and got[4]["near_next"] == 1.0


def closed(data, k=S.K, s=S.S):
    """First place of each closed syncmer's 32-bit hash."""
    import xxhash

    def h(x):
        v = xxhash.xxh64_intdigest(x, 42)
        return v - (1 << 64) if v >> 63 else v

    out = {}
    for i in range(len(data) - k + 1):
        inner = [h(data[j : j + s]) for j in range(i, i + k - s + 1)]
        if min(inner[0], inner[-1]) <= min(inner[1:-1]):
            seed = xxhash.xxh64_intdigest(inner[0].to_bytes(8, "little", signed=True), 42)
            out.setdefault(xxhash.xxh64_intdigest(inner[-1].to_bytes(8, "little", signed=True), seed) & 0xFFFFFFFF, i)
    return out or {h(data) & 0xFFFFFFFF: 0}


def test_anchors_match_the_definition_across_parts(spark):
    texts = [words(1, 300), words(2, 30), "ab" * 100, "a" * 50, "x" * S.K, words(3, 40) + words(1, 40) + words(3, 40)]
    df = frame(spark, list(enumerate(texts))).select("doc_id", S.as_text(S.fingerprint(F.col("text"), part=100)).alias("f"))
    for r in df.collect():
        want = sorted(closed(texts[r["doc_id"]].encode()).items())[: S.SKETCH]
        assert r["f"] == "".join(f"{(v << 31) | place:016x}" for v, place in want)


def ordered(a, b):
    """Longest common order of shared anchors over the anchors of either, from all anchors, by a plain table."""
    x, y = closed(a.encode()), closed(b.encode())
    places = [y[h] for h in sorted(x.keys() & y.keys(), key=x.get)]
    best = []
    for i, p in enumerate(places):
        best.append(1 + max((best[j] for j in range(i) if places[j] < p), default=0))
    return max(best, default=0) / len(x.keys() | y.keys())


def test_likeness_is_by_position(spark):
    a, b, c = words(11, 150), words(12, 150), words(13, 150)
    pairs = [(a + b, b + a), (a + b, a + "wedge " + b), (a + b + c, c + b + a), (a + b, a + c), (a, c), (a, a), ("a" * 40, "-" * 40),
             ("a" * 40, "a" * 60), (words(14, 12), words(14, 13)), ("zq93kfmPq!xx", "zq93kfmPq!xy"), ("", ""), ("", "x")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i long, a string, b string")
    for size, slack in ((100_000, 1e-12), (S.SKETCH, 0.2)):
        prints = [S.fingerprint(F.col(x), size=size) for x in "ab"]
        got = {r["i"]: r["l"] for r in df.select("i", S.likeness(*prints, size=size).alias("l")).collect()}
        for i, (x, y) in enumerate(pairs):
            assert abs(got[i] - ordered(x, y)) <= slack
    assert 0.35 < got[0] < 0.65 and got[1] > 0.9 and got[2] < 0.5 and got[5] == 1.0 and got[6] == 0.0


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "x"), (None, "abc"), (3, "y"), (3, "y")]
    got = S.compare_edited(frame(spark, rows)).collect()
    assert len(got) == 6
    by = {(r["doc_id"], r["n_chars"]): r for r in got}
    assert by[1, 0]["near_next"] == 1.0 and by[2, 0]["near_next"] == 0.0
    twins = [r for r in got if r["doc_id"] == 3]
    assert len({tuple(r) for r in twins}) == 2
    assert S.compare_edited(frame(spark, [])).count() == 0
    one = S.compare_edited(frame(spark, [(9, words(3, 50000))])).first()
    assert one["near_edited"] > 0.4 and one["near_next"] == 1.0


def test_one_shuffle_of_the_texts_and_no_stored_fingerprints(spark, tmp_path):
    """Texts that share a beginning with their edited text: long ones of several parts, some shorter than a k-mer, some without an anchor."""
    import glob

    from tickloom.session import stage, staged_folder

    texts = [words(1, 4000), words(2, 3), "a" * 40, "x" * S.K, "", words(3, 60), "a" * 9000 + words(4, 900), "é" * 13, words(1, 4000)]
    df = stage(frame(spark, list(enumerate(texts))), "texts")
    area = staged_folder(spark, "x").removeprefix("file:").rsplit("/", 1)[0]
    before = set(glob.glob(f"{area}/fingerprints-*"))
    done = S.compare_edited(df)
    done.write.parquet(f"{tmp_path}/out")
    assert set(glob.glob(f"{area}/fingerprints-*")) == before
    got = {r["doc_id"]: r for r in done.collect()}
    plan = done._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "ReusedExchange" in plan and plan.count("array_except") == 1
    for i, t in enumerate(texts):
        after = texts[(i + 1) % len(texts)]
        one = frame(spark, [(0, t)]).select(S.as_text(S.fingerprint(F.col("text"))).alias("f")).first()["f"]
        two = frame(spark, [(0, t[: len(t) - len(t) // 2] + after[: len(t) // 2])]).select(S.as_text(S.fingerprint(F.col("text"))).alias("f")).first()["f"]
        assert (got[i]["fingerprint"], got[i]["edited_fingerprint"]) == (one, two)


def test_periodic_and_anchorless_texts_differ(spark):
    import random

    r = random.Random(8)
    short = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(12 + i % 3)) for i in range(60)]
    texts = ["a" * 40, "-" * 40, "ab" * 20, "abcd" * 10, *short]
    df = frame(spark, list(enumerate(texts))).select(S.as_text(S.fingerprint(F.col("text"))).alias("f"))
    prints = [x["f"] for x in df.collect()]
    assert all(prints) and len(set(prints)) == len(texts)
    assert any(not closed_keys(t.encode()) for t in short)


def closed_keys(data):
    """Whether any k-mer of the text is chosen."""
    import xxhash

    signed = lambda v: v - (1 << 64) if v >> 63 else v
    inner = [signed(xxhash.xxh64_intdigest(data[i : i + S.S], 42)) for i in range(len(data) - S.S + 1)]
    w = S.K - S.S + 1
    parts = [inner[i : i + w] for i in range(len(inner) - w + 1)]
    return [p for p in parts if min(p[0], p[-1]) <= min(p[1:-1])]
