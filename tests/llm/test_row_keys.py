from pyspark.sql import functions as F

import corpus_pipeline
from sheafline.llm.mixing import keep_mixed

SCHEMA = "doc_id long, text string, lang string, source string, n int"


def kept(df):
    return sorted(r.n for r in df.collect())


def test_dedup_keeps_one_row_of_each_group_with_null_and_repeated_ids(spark):
    a, b, c, d = ("alpha beta gamma delta", "one two three four five", "entirely other words stand here", "some last text that is alone")
    rows = [(None, a, 1), (None, a, 2), (None, b, 3), (4, b, 4), (7, c, 5), (7, c, 6), (7, d, 7)]
    df = spark.createDataFrame([(i, t, "en", "src0", n) for i, t, n in rows], SCHEMA)
    for stage in (corpus_pipeline.exact, corpus_pipeline.near):
        out = stage(spark, df, "")
        assert out.columns == df.columns
        got = kept(out)
        assert [len(set(got) & x) for x in ({1, 2}, {5, 6})] == [1, 1] and {4, 7} < set(got) and len(got) == 4


def test_mix_takes_rows_not_ids(spark):
    df = spark.createDataFrame([(None if n % 2 else 5, "w " * 10, "en", "src0", n) for n in range(100)], SCHEMA)
    assert len(kept(keep_mixed(df, total=F.col("tokens") * 0.6, weights={}, domain=F.lit("d")))) == 60


CLASH = "doc_id long, text string, lang string, source string, n int, tokens int, fp string, kept boolean, copies int, domain string, component_id int, held_out int, fingerprint string"


def odd(spark):
    words = ["the cat and the dog run over the hill", "der Hund und die Katze laufen weit", "le chat et le chien vont loin"]
    rows = [(k, f"{words[k % 3]} number{k} " * (k % 4 + 1), ["en", "de", "fr"][k % 3], "src0") for k in range(40)]
    rows += [(None, None, None, None), (50, "", "en", None), (51, " \t", None, "src1"), (None, "the cat alone " * 30_000, "en", "src0"), rows[1], rows[1], (None, rows[2][1], "fr", "src0"), (None, rows[2][1], "fr", "src0")]
    return spark.createDataFrame([(*r, k, 7, "x", True, 3, "d", 4, 5, "f") for k, r in enumerate(rows)], CLASH), rows


def test_every_stage_takes_odd_rows_and_clashing_columns(spark):
    df, rows = odd(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, "")
        assert out.columns == df.columns, name
        got = {r.n: r for r in out.collect()}
        assert all(tuple(r)[:4] == rows[n] and tuple(r)[5:] == (7, "x", True, 3, "d", 4, 5, "f") for n, r in got.items()), name
        if name == "language":
            assert not {40, 41, 42} & set(got) and len(got) == len(rows) - 3
        elif name in ("exact", "near"):
            assert sum(n in got for n in (40, 41, 42)) == 1 and sum(n in got for n in (1, 44, 45)) == 1 and {2, 46, 47} & set(got) == {2} and 43 in got
        else:
            assert 0 < len(got) < len(rows) and not {40, 41, 42} & set(got)
    encoded = corpus_pipeline.encoded(spark, df, "").collect()
    assert len(encoded) == len(rows) and sorted(r.n_tokens for r in encoded)[:2] == [0, 0] and max(r.n_tokens for r in encoded) > 80_000


def test_every_stage_takes_an_empty_table(spark):
    df, _ = odd(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df.limit(0), "")
        assert out.collect() == [] and (name == "encoded" or out.columns == df.columns)
    unlabelled = df.withColumn("lang", F.lit(None).cast("string"))
    assert corpus_pipeline.language(spark, unlabelled, "").count() == df.where("length(trim(text)) > 1").count()


def test_scratch_tables_of_a_stage_are_gone_after_it(spark):
    from sheafline import scratch

    df, _ = odd(spark)
    out = scratch.settled(spark, lambda: corpus_pipeline.exact(spark, df, ""))
    top = scratch.shared_dir(spark).removeprefix("file://") + "/sheafline/" + scratch.RUN
    import os

    left = os.listdir(top)
    assert out._scratch_path.rpartition("/")[2] in left
    again = scratch.settled(spark, lambda: corpus_pipeline.near(spark, df, ""))
    assert set(os.listdir(top)) - set(left) == {again._scratch_path.rpartition("/")[2]}
