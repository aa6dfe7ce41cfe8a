import re
import zlib

import numpy as np
import pytest

import __spark_entry__ as entry
from outlens.llm.queries import QUERIES, tokenizer

pipe = pytest.importorskip("corpus_pipeline")


def test_stages(spark, sf, tmp_path):
    """Each stage on what its predecessor kept, against what its operator says row by row."""
    from outlens.llm import lang_id, pii, prob_minhash, quality

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in pipe.STAGES]
    assert names == ["quality", "language", "near_dedup", "pii", "packing"]
    for k, (name, stage) in enumerate(pipe.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        before, after = docs.collect(), out.collect()
        if name == "quality":
            labels = spark.read.parquet(f"{sf}/labels.parquet")
            kept = {r.doc_id for r in quality.assess(docs, labels).where("kept").collect()}
            assert {tuple(r) for r in after} == {tuple(r) for r in before if r.doc_id in kept} and 0 < len(after) < len(before)
        elif name == "language":
            model = lang_id.fit(docs)
            good = lambda j: j[0] != "und" and j[1] >= lang_id.MIN_SCORE
            assert {tuple(r) for r in after} == {tuple(r) for r in before if good(model.judge(r.text))}
        elif name == "near_dedup":
            classes = {r.doc_id: r.class_id for r in prob_minhash.near_duplicates(docs).collect()}
            assert sorted(r.doc_id for r in after) == sorted(set(classes.values()))
        elif name == "pii":
            assert {(r.doc_id, r.text, r.n_chars) for r in after} == {(r.doc_id, m := pii.mask(r.text), len(m)) for r in before}
        else:
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
            ids = {r.doc_id: [*tok.encode(r.text, add_special_tokens=False).ids, 1] for r in before}
            for r in after:
                piece = ids[r.doc_id][r.start : r.start + r.length]
                assert zlib.crc32(np.array(piece, "<u4").tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
            assert sum(r.length for r in after) == sum(map(len, ids.values()))
        if k < len(pipe.STAGES) - 1:
            assert out.columns == docs.columns
        docs = out


def test_run_is_the_stages(spark, sf):
    rows = pipe.run(spark, sf)
    assert rows.count() > 0 and "sequence_id" in rows.columns


def test_registered(spark, sf):
    found = entry.queries()
    assert set(QUERIES) <= set(found) and "pipeline" in found
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 11))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_runs_over_the_whole_table(spark, sf, name):
    df = QUERIES[name](spark, sf)
    table = {"op1": "embeddings", "op2": "pages"}.get(name.split("_")[0], "documents")
    n = spark.read.parquet(f"{sf}/{table}.parquet").count()
    key = df.columns[0]
    assert df.select(key).distinct().count() == spark.read.parquet(f"{sf}/{table}.parquet").select(key).distinct().count()
    assert df.count() == n or name.startswith("op10")
