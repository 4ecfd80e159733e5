"""Every registered query against its SQL; those without SQL must give rows."""

import collections
import pathlib
import re
import unicodedata

import pyarrow.parquet as pq
import pytest

from sheafline.functions.text import STRUCTURE
from sheafline.plans import registry
from tests.compare import check

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    check(spark, SF, registry.queries()[name], registry.oracle_sql()[name])


@pytest.mark.parametrize("name", [n for n in registry.queries() if n not in registry.oracle_sql()])
def test_query_without_sql_runs(spark, name):
    df = registry.queries()[name](spark, SF)
    assert len(set(df.columns)) == len(df.columns)
    df.collect()


def looped(text):
    """Whether a text shows a loop, by plain patterns."""
    if re.search(r"([^\d\s])\1{5,}", text):
        return True
    grams = (m[1] for n in (2, 3, 4) for m in re.finditer(rf"(.{{{n}}})\1{{3,}}", text))
    return any(not g.isdigit() and not set(g) <= set(STRUCTURE) for g in grams)


def test_flagship_matches_plain_python(spark):
    want = collections.defaultdict(lambda: [0, 0, 0])
    for r in pq.read_table(f"{SF}/documents.parquet").to_pylist():
        text = "".join(c for c in unicodedata.normalize("NFD", (r["text"] or "").replace("đ", "d").replace("Đ", "D")) if unicodedata.category(c) != "Mn")
        for k, n in enumerate((1, looped(r["text"] or ""), len(" ".join(text.lower().split())))):
            want[r["lang"], r["source"]][k] += n
    got = {(r.lang, r.source): [r.n_docs, r.n_looped, r.n_chars] for r in registry.flagship(spark, SF).collect()}
    assert got == dict(want) and sum(v[1] for v in got.values()) > 0


def test_scan_lists_the_folder(spark):
    got = [(r.name, r.length) for r in registry.queries()["scan_sorted"](spark, SF).collect()]
    assert got == sorted((f"{p.parent.name}/{p.name}", p.stat().st_size) for p in pathlib.Path(SF).rglob("*.parquet"))
