"""The corpus pipeline, stage by stage, against brute force over each stage's own input."""

import corpus_pipeline as C
from panelwright.llm import decontaminate, language_id, secret_scan

from .cases import odd_documents
from .test_duplicates import slow_similar

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    assert [n for n, _ in C.STAGES] == ["language_id", "simhash_near_dedup", "benchmark_decontamination", "secret_scan", "temperature_mix"]
    rows = {r["doc_id"]: r for r in docs.collect()}
    kept = C.identify_language(spark, docs, SF)
    assert kept.columns == docs.columns
    gone = set(rows) - {r["doc_id"] for r in kept.collect()}
    assert all(not any(map(str.isalpha, rows[i]["text"] or "")) for i in gone)

    classes = slow_similar({i: r["text"] or "" for i, r in rows.items()})
    one = C.drop_near_duplicates(spark, docs, SF)
    assert one.columns == docs.columns and {r["doc_id"] for r in one.collect()} == set(classes.values())

    bench = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    index = decontaminate.WindowIndex(bench, 13)
    clean = C.drop_contaminated(spark, docs, SF)
    want = set()
    for i, r in rows.items():
        n, spans, _ = index.scan(r["text"])
        hit = sum(b - a for a, b in spans)
        if not (hit and 20 * hit >= n):
            want.add(i)
    assert clean.columns == docs.columns and {r["doc_id"] for r in clean.collect()} == want

    masked = {r["doc_id"]: r for r in C.redact_secrets(spark, docs, SF).collect()}
    ranks = secret_scan.Ranks(secret_scan.corpus_words(docs))
    assert masked.keys() == rows.keys()
    for i, r in rows.items():
        spans = secret_scan.find_spans(r["text"] or "", ranks, 9.0)
        assert (masked[i]["text"] == r["text"]) == (not spans) and not any(r["text"][s:e] in masked[i]["text"] for k, s, e, _ in spans if k != "hex")
        assert masked[i]["n_chars"] == len(masked[i]["text"] or "") or r["text"] is None


def test_run(spark):
    out = C.run(spark, SF)
    rows = out.collect()
    assert rows and {"doc_id", "source", "epoch", "block", "position"} <= set(out.columns)
    assert len({(r["block"], r["position"]) for r in rows}) == len(rows)


def test_odd_documents_pass_every_stage(spark):
    docs = odd_documents(spark)
    for _, stage in C.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() <= docs.count()
    assert language_id.UND == "und"
