import numpy as np
import pytest

from tickloom.llm import langid as G

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def model(docs):
    return G.fit_text_model(docs.where("doc_id % 2 = 0"))


def test_held_out_accuracy(docs, model):
    rows = docs.where("doc_id % 2 = 1").collect()
    right = [model.languages[int(np.argmax(model.score(r["text"])[1]))] == r["lang"] for r in rows]
    assert np.mean(right) > 0.98


def test_clean_documents_stay(docs):
    assert G.keep_identified(docs).count() == docs.count()


def test_rejected_and_odd_documents(spark, model):
    schema = "doc_id long, text string, lang string, source string, p int, host string"
    rows = [(1, None, "en", "a"), (2, "", None, None), (3, "12 34 !!", "en", "a"), (None, "the and of this", None, "a"),
            (4, "der und die ist ein", None, "b"), (4, "der und die ist ein", None, "b"), (5, "the of and " * 100_000, "en", "b")]
    df = spark.createDataFrame([(*r, 1, "h") for r in rows], schema)
    for m in (model, None):
        got = G.keep_identified(df, m)
        assert got.columns == df.columns
        assert sorted((r["doc_id"] or 0) for r in got.collect()) == [0, 4, 4, 5]
    none = df.withColumn("lang", df.lang.substr(9, 1)).replace("", None, "lang")
    assert G.keep_identified(none.where("doc_id = 4")).count() == 2
    assert G.keep_identified(df.where("false")).count() == 0


def brute_priors(pages, model):
    """Posterior of each page by plain loops over all pages."""
    n = len(model.languages)
    evidence = [model.score(G.visible_text(h))[1] + G.said([d], model.languages)[0] for _, _, d, h in pages]
    p = [G.softmax(e[None])[0] for e in evidence]
    out = []
    for i, (host, suffix, _, _) in enumerate(pages):
        rest = [j for j in range(len(pages)) if j != i]
        total = lambda js: np.sum([p[j] for j in js], axis=0) if js else np.zeros(n)
        world = (total(rest) + 1) / (total(rest).sum() + n)
        x = total([j for j in rest if pages[j][1] == suffix])
        by = (x + G.SUFFIX_WEIGHT * world) / (x.sum() + G.SUFFIX_WEIGHT)
        h = total([j for j in rest if pages[j][0] == host])
        prior = (h + G.HOST_WEIGHT * by) / (h.sum() + G.HOST_WEIGHT)
        out.append(G.softmax((evidence[i] + np.log(prior))[None])[0])
    return out


def test_fusion_against_loops(spark, model):
    urls = ["https://a.example.de/x", "http://b.example.de/", "http://c.example.fr:80/p?q", None, "odd", "http://u@A.example.de/y"]
    texts = ["der und die", "the of and", "les des est", "", "un que la los", "ein nicht mit"]
    langs = ["de", "en", None, "es", "xx", "fr"]
    rows = [(i, urls[i % 6], None if i == 7 else f"<html{'' if langs[i % 5] is None else f' lang={chr(34)}{langs[i % 5]}-x{chr(34)}'}><script>the the</script><p>{texts[i % 6 if i < 20 else i % 4]}&nbsp;</p>") for i in range(40)]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, lang string")
    got = {r["page_id"]: r for r in G.identify_pages(df, model).collect()}
    want = brute_priors([(got[i]["host"], got[i]["suffix"], got[i]["declared"], rows[i][2]) for i in range(40)], model)
    for i in range(40):
        assert abs(got[i]["probability"] - want[i].max()) < 1e-6
        assert got[i]["lang"] == model.languages[int(want[i].argmax())]
    assert got[0]["host"] == "a.example.de" and got[5]["host"] == "a.example.de" and got[2]["suffix"] == "fr" and got[3]["host"] is None
    assert got[7]["n_grams"] == 0 and not got[7]["accepted"] and got[0]["declared"] == "de"


def test_no_labels_and_no_rows(spark, model):
    df = spark.createDataFrame([(1, "http://a.b/", "<p>text</p>")], "page_id long, url string, html string")
    empty = G.TextModel([], np.zeros((G.BUCKETS, 0), np.float32))
    assert G.identify_pages(df, empty).first()["lang"] is None
    assert G.identify_pages(df.where("false"), model).count() == 0


def gibberish(seed, letters, n_words):
    import random

    r = random.Random(seed)
    return " ".join("".join(r.choice(letters) for _ in range(r.randrange(2, 10))) for _ in range(n_words))


LATIN, CYRILLIC, GREEK = "abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщыэюя", "αβγδεζηθικλμνξοπρστυφχψω"
FOREIGN = [
    "Minden ember szabadnak születik és egyenlő méltósága és joga van, az emberek ésszel és lelkiismerettel bírnak",
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan, heille on annettu järki",
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw, są oni obdarzeni rozumem",
    "人人生而自由在尊严和权利上一律平等他们赋有理性和良心并应以兄弟关系的精神相对待",
]


def test_gibberish_and_foreign_texts_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = G.fit_text_model(docs)
    assert np.isfinite(model.usual).all()
    odd = [gibberish(i, letters, 5 + i) for i in range(60) for letters in (LATIN, CYRILLIC, GREEK)] + FOREIGN
    declared = model.languages * len(odd)
    rows = [(i, t, declared[i], "wiki") for i, t in enumerate(odd)] + [(9000 + i, r["text"], r["lang"], r["source"]) for i, r in enumerate(docs.collect())]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"] for r in G.keep_identified(df, model).collect()}
    assert not {i for i in kept if i < 9000}
    assert len(kept) == docs.count()


def test_every_label_is_fitted(spark):
    rows = [(i, f"{chr(97 + i % 26)}{chr(97 + i // 26)} word", f"l{i:03}") for i in range(90)]
    model = G.fit_text_model(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.languages) == 90 and np.isnan(model.usual).all()
    assert model.is_known(20, np.full(90, -400.0))  # too few rows to tell what is unusual
