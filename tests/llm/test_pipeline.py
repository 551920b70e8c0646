import corpus_pipeline
from tessera.llm.common import stored
from llm.test_setjoin import _brute as brute_classes
from llm.test_suffixdedup import _brute as brute_spans

SF = "/root/testdata/sf0.001"


def test_each_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stored(stage(spark, docs, SF), name)
        rows[name] = before.collect(), docs.collect()
        if name != "best_fit_packing":
            assert docs.columns == before.columns
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").filter("toxic = 1").collect()}
    before, after = rows["toxicity"]
    clean = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").filter("toxic = 0").collect()}
    left = {r["doc_id"] for r in after}
    assert not clean - left and left <= {r["doc_id"] for r in before}
    assert len(toxic & left) < len(toxic)
    before, after = rows["ngram_jaccard_join"]
    want = {i for i, _, c in brute_classes([(r["doc_id"], r["text"]) for r in before], 5, 80, 100) if i == c}
    assert {r["doc_id"] for r in after} == want and len(after) == len(want)
    before, after = rows["suffix_array_dedup"]
    spans = {i: s for i, s, _ in brute_spans([(r["doc_id"], r["text"].encode()) for r in before], 100)}
    text = {r["doc_id"]: r for r in after}
    for r in before:
        if not spans[r["doc_id"]]:
            assert text[r["doc_id"]] == r
        elif r["doc_id"] in text:
            kept = text[r["doc_id"]]
            lost = len(r["text"].encode()) - len(kept["text"].encode())
            total = sum(e - s for s, e in spans[r["doc_id"]])
            assert total - 6 * len(spans[r["doc_id"]]) <= lost <= total and kept["n_chars"] == len(kept["text"])
    before, after = rows["source_mixing"]
    times = {}
    for r in after:
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
    assert max(times.values()) <= 2 and set(times) <= {r["doc_id"] for r in before}
    size = {r["doc_id"]: len(r["text"].split()) for r in before}
    assert abs(sum(size[i] * n for i, n in times.items()) / sum(size.values()) - 1.5) < 0.2
    before, after = rows["best_fit_packing"]
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before}
    assert sum(r["length"] for r in after if r["piece"] == 0) > 0


def test_odd_rows_and_empty_tables(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            was = docs.columns
            docs = stored(stage(spark, docs, SF), name)
            if name != "best_fit_packing":
                assert docs.columns == was
        assert {"doc_id", "sequence_id", "offset"} <= set(docs.columns)
