import hashlib

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from sheafline.llm.exact_dedup import exact_dedup
from sheafline.llm.langid import has_letter, held_out, identify, train
from sheafline.llm.simhash import simhash_groups

SF = "/root/testdata/sf0.001"


def test_each_stage_on_its_own_input(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(90001, "1234 !!!", "en", "src0", 8), (90002, None, None, None, None)], docs.schema)
    docs = docs.unionByName(extra)
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        before = {r.doc_id: r for r in docs.collect()}
        ids = {r.doc_id for r in out.select("doc_id").collect()}
        if name != "encoded":
            assert out.columns == columns
            assert {r.doc_id: r for r in out.collect()} == {i: before[i] for i in ids}
        if name == "language":
            known = {r.doc_id for r in identify(docs, train(docs.where(~held_out()))).where("score >= 0.5").collect()}
            assert ids == {i for i, r in before.items() if has_letter(r.text) and i in known} and len(ids) > 0.95 * len(before)
        elif name == "exact":
            best = {}
            for i, r in before.items():
                t = r.text.encode().translate(None, b" \t\n\x0b\x0c\r")
                best.setdefault(t, []).append((-len(r.text), i))
            assert ids == {min(v)[1] for v in best.values()}
            assert len(ids) < len(before)
        elif name == "near":
            assert ids == {r.component_id for r in simhash_groups(docs).collect()}
        elif name == "mixed":
            words = {i: len(r.text.split()) for i, r in before.items()}
            assert 0.4 < sum(words[i] for i in ids) / sum(words.values()) <= 0.6
        else:
            t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
            for r in out.collect():
                assert r.token_ids == t.encode(before[r.doc_id].text, add_special_tokens=False).ids
                assert r.decoded_sha256 == hashlib.sha256(before[r.doc_id].text.encode()).hexdigest()
            assert ids == set(before)
        docs = out


def test_run_is_the_stages_in_order(spark):
    out = corpus_pipeline.run(spark, SF)
    assert 0 < out.count() < spark.read.parquet(f"{SF}/documents.parquet").count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "exact", "near", "mixed", "encoded"]
    assert exact_dedup(spark.read.parquet(f"{SF}/documents.parquet").where(F.lit(False))).count() == 0
