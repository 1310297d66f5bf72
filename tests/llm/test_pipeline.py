import collections

import __spark_entry__ as entry
import corpus_pipeline as P
from tickloom.llm import langid, mixing, packing, simhash, suffix_dedup
from tickloom.llm.common import with_row_key
from tickloom.session import stage

SF = "/root/testdata/sf0.001"


def test_stages_chain_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, []
    for name, step in P.STAGES:
        docs = stage(step(spark, docs, SF), "test")
        seen.append(docs)
        if name != P.STAGES[-1][0]:
            assert docs.columns == columns
    kept, single, cut, mixed, packed = seen
    assert kept.count() == 200
    groups = simhash.near_duplicate_groups(kept).select("group_id").distinct().count()
    assert single.count() == groups < 200
    assert suffix_dedup.remove_repeats(cut).agg({"n_bytes": "sum"}).first()[0] == sum(
        len(r["text"].encode()) for r in suffix_dedup.without_repeats(single).collect()
    )
    keyed, keys = with_row_key(cut, "_k")
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix_sources(keyed, row=keys).collect()}
    got = collections.Counter(r["doc_id"] for r in mixed.collect())
    assert got == collections.Counter({k: v for k, v in copies.items() if v})
    assert packed.where("piece = 0").count() == mixed.count()
    assert P.run(spark, SF).count() == packed.count()


def words_by_source(df):
    words = collections.Counter()
    for r in df.collect():
        words[r["source"]] += len((r["text"] or "").split())
    return words


def test_mix_takes_what_was_chosen_of_each_row(spark):
    """Rows that share an id, a size or the whole text: the words taken stay within a document of the target."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(7, f"a b c d e{i}", "en", "x", 9) for i in range(8)] + [(None, f"n o p q{i}", "en", "y", 7) for i in range(30)]
    rows += [(5, "same text here", "en", "y", 14)] * 9 + [(i, "w " * (i % 11), "en", "z", 22) for i in range(40)]
    docs = spark.createDataFrame(rows, schema).repartition(3)
    for table in (docs, stage(docs, "odd")):
        mixed = P.mix(spark, table, SF)
        assert mixed.columns == docs.columns
        got, sizes = words_by_source(mixed), words_by_source(docs)
        for source in "xyz":
            target = next(r["target"] for r in mixing.mix_sources(docs).collect() if r["source_size"] == sizes[source])
            assert abs(got[source] - target) <= 10 / 2 + 1
        assert max(collections.Counter(map(tuple, mixed.where("doc_id IS NULL").collect())).values()) <= 2
    # Rows without an id are drawn one by one and not by size: neither the shortest nor the longest alone.
    assert 0 < mixed.where("doc_id IS NULL").count() <= 60


def test_odd_documents_pass_every_stage(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, size int, _copy int"
    rows = [(1, None, "en", "a", 0), (2, "", "en", None, 0), (None, "the and of this", None, "a", 1), (4, "der und die", None, "b", 1),
            (4, "der und die", None, "b", 3), (4, "der und das", None, "b", 3)]
    full = spark.createDataFrame([(*r, 1, 1) for r in rows], schema)
    for docs in (full, full.where("false")):
        for name, step in P.STAGES:
            columns = docs.columns
            docs = stage(step(spark, docs, SF), "odd")
            assert docs.columns == columns or name == P.STAGES[-1][0]


def test_registered():
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14))
