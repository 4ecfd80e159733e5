import __spark_entry__


def test_entry_gives_rows(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["lang", "source", "n_docs", "n_looped", "n_chars"] and df.count() > 0


def test_every_sql_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_library_does_not_need_the_corpus_operators():
    import pathlib
    import re

    root = pathlib.Path(__spark_entry__.__file__).parent / "sheafline"
    users = [p for p in root.rglob("*.py") if p.parent.name != "llm" and re.search(r"^\s*(from|import) sheafline\.llm", p.read_text(), re.M)]
    assert users == []
