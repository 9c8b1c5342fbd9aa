from collections import Counter

import numpy as np

import corpus_pipeline as P
from shopflow.llm import secret_scan, toxicity
from shopflow.llm.packing import END_ID, decompose

from .conftest import MEDIUM
from .test_decontaminate import _whole_items
from .test_ngram_join import brute
from .test_packing import REFERENCE


def _brute_force(rows, model, items):
    """[(doc_id, start, length, ids)] of documents (doc_id, text), row by row in Python."""
    kept = []
    for d, t in rows:
        weight, _, n = model.weigh(t)
        if model.score(weight, n) < 0.5:
            kept.append((d, t))
    classes = brute(kept, P.WORDS, *P.SIMILAR)
    kept = [(d, t) for d, t in kept if classes[d][0] == 0 or classes[d][1] == d]
    leaked = {d for d, _ in _whole_items(kept, items)}
    out = []
    for d, t in kept:
        if d in leaked:
            continue
        spans = [{"start": s, "end": e} for s, e, _ in secret_scan.find_secrets(t, secret_scan.encoder())]
        ids = REFERENCE.encode(secret_scan.redact(t, spans) or "", add_special_tokens=False).ids + [END_ID]
        at = 0
        for n in decompose(len(ids)).tolist():
            out.append((d, at, n, np.array(ids[at:at + n], "<u4").tobytes()))
            at += n
    return out


def test_run_equals_brute_force(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{MEDIUM}/labels.parquet"))
    items = [tuple(r) for r in spark.read.parquet(f"{MEDIUM}/benchmark.parquet")
             .select("item_id", "text").collect()]
    want = _brute_force([tuple(r) for r in docs.select("doc_id", "text").collect()], model, items)
    got = [(r["doc_id"], r["start"], r["length"], bytes(r["ids"])) for r in P.run(spark, MEDIUM).collect()]
    assert Counter(got) == Counter(want)


def test_order_of_the_stages():
    assert [n for n, _ in P.STAGES] == ["toxicity", "ngram_jaccard_join", "decontamination",
                                        "secret_scan", "packing"]


def test_each_stage_decides_and_keeps_the_columns(spark, folder):
    words = [f"w{i}" for i in range(400)]
    item = " ".join(f"item{i}" for i in range(30))
    clean = {i: " ".join(words[i * 20:i * 20 + 60]) for i in range(10)}
    rows = [(i, t) for i, t in clean.items()]
    rows += [(100, clean[0] + " x"), (101, clean[0]), (102, "before " * 9 + item + " after" * 9),
             (103, " ".join(words[300:350]) + " password=hunter2hunter"),
             (104, " ".join(words[350:390]) + " idiot moron scum")]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t), "extra") for d, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars int, id string")
    tables = folder(documents=docs,
                    labels=spark.createDataFrame([], "doc_id long, quality int, toxic int"),
                    benchmark=spark.createDataFrame([(1, item)], "item_id long, text string"))
    left = [{*range(10), 100, 101, 102, 103}, {*range(10), 102, 103}, {*range(10), 103}, {*range(10), 103}]
    for (name, stage), ids in zip(P.STAGES, left, strict=False):
        docs = stage(spark, docs, tables)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "id"], name
        assert {r["doc_id"] for r in docs.collect()} == ids, name
    masked = docs.where("doc_id = 103").first()
    assert masked["text"].endswith(" [SECRET]") and masked["n_chars"] == len(masked["text"])
    assert {r["doc_id"] for r in P.pack_sequences(spark, docs, tables).collect()} == ids


def test_odd_rows_and_empty_tables(spark, folder, odd_docs, no_docs, monkeypatch):
    tables = folder(labels=spark.createDataFrame([], "doc_id long, quality int, toxic int"),
                    benchmark=spark.createDataFrame([(None, None)], "item_id long, text string"))
    for limit in (P.BROADCAST_KEYS, -1):
        monkeypatch.setattr(P, "BROADCAST_KEYS", limit)
        docs = odd_docs
        for _, stage in P.STAGES[:-1]:
            docs = stage(spark, docs, tables)
            assert docs.columns == odd_docs.columns
        # One of the three long texts; blank texts and the small ones all stay.
        assert Counter((r["doc_id"], len(r["text"] or "")) for r in docs.collect()) == Counter([
            (None, 0), (None, 0), (5, len(" ".join(f"w{i}" for i in range(30_000)))), (5, 26),
            (7, 3), (7, 3), (8, 5), (9, 5000)])
        docs = no_docs
        for _, stage in P.STAGES:
            docs = stage(spark, docs, tables)
        assert docs.collect() == []
