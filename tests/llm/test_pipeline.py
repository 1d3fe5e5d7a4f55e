import importlib

from helpers import ODD_TEXTS, documents, prose

SF = "/root/testdata/sf0.001"


def test_registered():
    entry = importlib.import_module("__spark_entry__")
    names = [k for k in entry.queries() if k.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()


def test_stages_chain_and_take_effect(spark):
    import corpus_pipeline as cp

    assert [n for n, _ in cp.STAGES] == ["toxicity", "near_duplicates", "repeated_passages", "decontamination", "token_ids"]
    out = cp.run(spark, SF)
    rows = out.collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert 0 < len(rows) < docs.count() and all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in rows)
    assert len({r["doc_id"] for r in rows}) == len(rows)


def test_stages_take_odd_and_empty_tables(spark):
    import corpus_pipeline as cp

    df = documents(spark, [*ODD_TEXTS, prose(1, 90), prose(1, 90)])
    for name, stage in cp.STAGES:
        for docs in (df, df.limit(0)):
            out = stage(spark, docs, SF)
            rows = out.collect()
            if name != "token_ids":
                assert out.columns == df.columns
            if name in ("repeated_passages", "token_ids"):
                assert len(rows) == docs.count()
