import corpus_pipeline
from pyroclast.llm.queries import QUERIES
from pyroclast.llm.storage import stored
from tests.llm.test_jaccard_join import brute as linked

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, kept = docs.columns, [{r.doc_id: r.text for r in docs.collect()}]
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, FOLDER), "test-stage")
        if name != "packing":
            assert docs.columns == columns
            kept.append({r.doc_id: r.text for r in docs.collect()})
    known, single, apart, clean = kept[1:]
    assert known == kept[0]  # all of these have letters
    norm = lambda t: "".join(c for c in t if c not in " \t\n\x0b\x0c\r")
    assert len(single) == len({norm(t) for t in known.values()})
    assert set(apart) == {c for _, _, c in linked(list(single.items()), 5, 80)}
    assert set(clean) == set(apart) and all("AKIA" not in t or "[SECRET]" in t for t in clean.values())
    assert {r.doc_id for r in docs.collect()} == set(clean)


def test_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_odd_rows_through_all_stages(spark, odd, empty):
    """Nulls, empty and very long texts, repeated rows, and columns named as helpers are."""
    docs = odd.withColumn("n_chars", odd.key.cast("long")).withColumnsRenamed({"norm": "row", "key": "spans", "id": "sha"})
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, FOLDER), "test-stage")
        if name != "packing":
            assert docs.columns == columns
            kept = sorted(r.doc_id for r in docs.collect())
    # 0, 1, 2 and 8 have no letter; 4, 5 and 6 are equal without white space up to a letter's case.
    assert kept == [3, 4, 7, 9, 10] and sorted({r.doc_id for r in docs.collect()}) == kept
    docs = empty
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, FOLDER), "test-stage")
    assert docs.count() == 0
