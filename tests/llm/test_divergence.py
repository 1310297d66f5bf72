import random
import re
from collections import Counter, defaultdict

from tickloom.llm import divergence as D


def frame(spark, docs):
    return spark.createDataFrame([(*d, 1) for d in docs], "text string, lang string, source string, term int").repartition(4)


def terms_of(text):
    fold = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", fold)


def brute_kept(docs, least):
    seen = defaultdict(set)
    for i, (t, lang, _) in enumerate(docs):
        for w in terms_of(t):
            seen[lang or "", w].add(i)
    return {k for k, v in seen.items() if len(v) >= least}


def brute(docs, least, top=50):
    kept = brute_kept(docs, least)
    counts, langs = defaultdict(Counter), defaultdict(Counter)
    groups = {(lang or "", source or "") for _, lang, source in docs}
    for t, lang, source in docs:
        for w in terms_of(t):
            if (lang or "", w) in kept:
                counts[lang or "", source or ""][w] += 1
                langs[lang or ""][w] += 1
    rows = set()
    for lang, source in groups:
        vocabulary = [w for g, w in kept if g == lang]
        v = len(vocabulary)

        def share(c, w):
            return 1 + 1000000000 * (c[w] + 5) // (sum(c.values()) + 5 * v)

        own = counts[lang, source]
        pairs = [
            (sum(abs(share(own, w) - share(counts[lang, o], w)) for w in vocabulary), o) for g, o in groups if g == lang and o != source
        ]
        terms = [(share(own, w) - share(langs[lang], w), w) for w in vocabulary if own[w] > 0 and share(own, w) > share(langs[lang], w)]
        for part, found in (("pair", pairs), ("term", terms)):
            found.sort(key=lambda x: (-x[0], x[1].encode()))
            rows |= {(lang, source, part, w, d, k + 1) for k, (d, w) in enumerate(found) if part == "pair" or k < top}
    return rows


def collected(df):
    rows = [(r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def make(seed, n=220, sources=9):
    r = random.Random(seed)
    stems = ["a", "an", "ant", "ante", "antenna", "antennae", "É", "éa", "éan", "the", "them", "theme", "日本", "日本語", "x" * 40, "x" * 41, "x" * 300]
    docs = []
    for i in range(n):
        lang, source = r.choice([("en", f"s{r.randrange(sources)}")] * 6 + [("fr", None), (None, "s1"), (None, ""), ("xx", "only")])
        words = [r.choice(stems[: 3 + i % len(stems)]) + r.choice(["", "", "s", "S", f"q{r.randrange(40)}"]) for _ in range(r.randrange(0, 25))]
        docs.append((r.choice([" ", "-", "7", "\n"]).join(w.upper() if r.random() < 0.2 and w.isascii() else w for w in words) if r.random() > 0.05 else None, lang, source))
    return docs + docs[:30]


def test_kept_terms_are_those_of_enough_documents(spark):
    docs = make(1)
    counts = D.stage(D.term_counts(frame(spark, docs)), "t")
    for least in (1, 4, 30):
        got = [(r["lang"], bytes(r["term"]).decode()) for r in D.kept_terms(counts, least).collect()]
        assert len(got) == len(set(got)) and set(got) == brute_kept(docs, least)


def test_prefixes_count_documents_and_not_terms(spark):
    # Three terms of one document share a prefix: one document, so none of them reaches two.
    docs = [("prefixa prefixb prefixc", "en", "a"), ("other", "en", "b"), ("other", "en", "a")]
    counts = D.stage(D.term_counts(frame(spark, docs)), "t")
    assert [bytes(r["term"]) for r in D.kept_terms(counts, 2).collect()] == [b"other"]


def test_all_rows_against_brute_force(spark):
    docs = make(2)
    df = frame(spark, docs)
    want = brute(docs, 5)
    assert collected(D.audit_sources(df, 5)) == want
    # Many tiles, and blocks of sources that meet other blocks.
    assert collected(D.audit_sources(df, 5, term_block=3, source_block=2)) == want


def test_only_the_top_terms(spark):
    docs = make(3)
    assert collected(D.audit_sources(frame(spark, docs), 3, top=4)) == brute(docs, 3, 4)


def test_odd_tables(spark):
    assert D.audit_sources(frame(spark, [])).count() == 0
    docs = [(None, None, None), ("", "en", "a"), ("12 3", "en", "b"), ("w " * 400_000, "en", "c"), ("y" * 1_000_000, "de", "d")]
    assert collected(D.audit_sources(frame(spark, docs))) == brute(docs, 30)
    assert collected(D.audit_sources(frame(spark, docs), 1)) == brute(docs, 1)
