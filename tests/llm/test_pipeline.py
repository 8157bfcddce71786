from collections import Counter

import corpus_pipeline
from fathom.llm import byte_cnn, line_rules, packing, queries, secrets
from tests.llm.edge import edge_docs, edge_rows, no_docs
from tests.llm.test_near_copies import brute_kept

SMALL = "/root/testdata/sf0.001"


def test_stages_by_plain_python(spark, tmp_path):
    docs = queries.table(spark, SMALL, "documents")
    schema, before = docs.schema, docs
    rows = {r.doc_id: r for r in docs.collect()}
    net = byte_cnn.ByteNetwork.loads(byte_cnn.train(docs, queries.table(spark, SMALL, "labels")))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, before, SMALL)
        assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in schema]
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        got = {r.doc_id: r.text for r in out.collect()}
        assert len(got) == out.count()
        if name == "quality":
            assert set(got) == {i for i, r in rows.items() if net.score(r.text or "") >= byte_cnn.PASS_SCORE}
        elif name == "rules":
            judged = {i: line_rules.judge(t or "") for i, t in last.items()}
            assert got == {i: j[7] for i, j in judged.items() if j[6]}
        elif name == "near_duplicates":
            assert set(got) == set(brute_kept(list(last.items())))
        else:
            assert got == {i: secrets.redact(t, secrets.all_spans(t)[1]) for i, t in last.items()}
        last, before = got, out
    pieces = corpus_pipeline.STAGES[-1][1](spark, before, SMALL).collect()
    tokenizer = packing.WordTokenizer(queries.WORD_BPE)
    assert {r.doc_id: r.doc_tokens for r in pieces} == {i: len(ids) // 4 + 1 for i, ids in zip(last, tokenizer.batch(list(last.values())))}
    whole = corpus_pipeline.run(spark, SMALL)
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in whole.collect()) == Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in pieces)


def test_stages_take_edge_rows_and_empty_tables(spark, tmp_path):
    for number, docs in enumerate((edge_docs(spark), no_docs(spark))):
        docs.write.parquet(str(tmp_path / f"in{number}"))
        docs = spark.read.parquet(str(tmp_path / f"in{number}"))
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SMALL)
            if name != "pack":
                assert [f.name for f in out.schema] == docs.columns
            assert out.count() <= len(edge_rows()) * 200


def test_names():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "rules", "near_duplicates", "secret_scan", "pack"]
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{k}" for k in range(1, 14)}
