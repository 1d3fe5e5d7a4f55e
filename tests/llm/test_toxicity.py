import zlib

import numpy as np
from helpers import ODD_TEXTS, documents, prose

from tabsleuth.llm import toxicity as tx

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = tx.toxicity_scores(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    toxic = [r for r in held if r["toxic"] == 1]
    assert sum(r["predicted"] for r in toxic) >= 0.85 * len(toxic)
    assert sum(r["predicted"] == r["toxic"] for r in held) >= 0.97 * len(held)


def test_odd_rows_and_small_tables(spark):
    texts = [*ODD_TEXTS, *(prose(i, 20) + (" horrid" if i % 2 else "") for i in range(80))]
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(i, (i - len(ODD_TEXTS)) % 2 if i >= len(ODD_TEXTS) else None) for i in range(len(texts))], "doc_id long, toxic int")
    rows = tx.toxicity_scores(docs.unionByName(docs.where("doc_id < 2")), labels).collect()
    assert len(rows) == len(texts) + 2 and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (0, 1, 2, 3)}) == 1
    none = tx.toxicity_scores(docs, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.0} and len(none) == len(texts)
    assert tx.toxicity_scores(docs.limit(0), labels).collect() == []
    assert tx.remove_toxic(docs, labels).columns == docs.columns


def test_weights_are_sparse_and_labels_decide():
    rng = np.random.default_rng(1)
    examples = []
    for k in range(600):
        toxic = k % 3 == 0
        examples.append((np.unique(np.append(rng.integers(100, tx.BUCKETS, 50), [7] if toxic else [])).astype(int), int(toxic)))
    bucket, weight, _ = tx.train(examples)
    assert 7 in bucket and weight[list(bucket).index(7)] == weight.max() and len(bucket) < 200
