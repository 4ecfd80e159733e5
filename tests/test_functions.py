import math
import unicodedata

import pytest
from pyspark.sql import functions as F

from sheafline.functions import dates, numbers, text


def apply(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.o for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


NUMBERS = {
    "45.000": 45000, "45 000": 45000, "45.000 đ": 45000, "45.000₫": 45000, "VND 45.000": 45000, "vnđ45.000": 45000, "1.250.000": 1250000,
    "1,250,000": 1250000, "1-250-000": 1250000, "59-000": 59000, "12-34": None, "1,5": 1.5, "1.5": 1.5, "1.2345": 1.2345, "1,": 1, "5,": 5,
    "1,250.50": 1250.5, "1.250,50": None, "0,706": 706, "0.704": 704, ".500": 500, "-5.000": -5000, "45.000 VNĐ": None, "45.000 vnđ": None,
    "$45.00": None, "abc": None, "": None, "  ": None, None: None, "1e3": 1000, "1_000": 1000, "12d": None,
}
DATES = {
    "15-01-2024": "2024-01-15", "15/1/2024": "2024-01-15", "15.01.2024": "2024-01-15", "15 01 2024": "2024-01-15", "01/13/2024": "2024-01-13",
    "2024-1-5": "2024-01-05", "2024-02-30": "2024-02-30", "32-13-2026": "32-13-2026", "20230916": "2023-09-16", "16092023": "16092023",
    "23-09-16": "2023-09-16", "16-09-23": "2016-09-23", "05-06-45": "2045-06-05", "1-2-23": "1-2-23", "ngày 5 tháng Năm": "ngày 5 tháng Năm", " ": None, None: None,
}
TIMES = {"08:52:NV:283872": "08:52", "8:05": "08:05", "8:05:07": "08:05:07", "25:99": None, "8:05:61": None, "10h30": "10h30", "half past eight": "half past ", "": None, None: None}
LOOPS = {"aaaaa": False, "aaaaaa": True, "0000000000": False, "abcabcabcabc": True, "abcabcabc": False, "null,null,null,null,": False, "lalalala": False, "": False, None: False}


@pytest.mark.parametrize("fn, cases", [
    (numbers.coerce_numeric, NUMBERS), (dates.normalize_date, DATES), (dates.normalize_time, TIMES), (text.has_loop, LOOPS),
    (text.strip_trailing_punct, {"Cà phê sữa.;": "Cà phê sữa", "...": "...", None: None}), (text.strip_cjk, {"咖啡": None, "Bún 米粉 bò": "Bún bò", None: None}),
    (text.normalize_for_match, {" Cà  Phê ĐEN. ": "ca phe den.", None: ""}), (text.normalize_name, {"Cà-Phê  ĐEN.": "ca phe den", "a_b": "a_b", None: ""}),
    (text.strip_code_fences, {"```json\n{}\n```": "{}", "{}": "{}", None: ""}), (text.json_substring, {"x {\"a\": 1} y": '{"a": 1}', "x [1] y": "[1]", "}{": "}{", None: ""}),
    (numbers.normalize_total, {None: "", "null": "", " 25000 ": "25000.0", "25000.0": "25000.0", "X Y": "x y"}),
    (lambda c: dates.find_date(c, 2026), {"Ngày 01/02/2024 09:10": "2024-02-01", "Ngay 05062024": "2024-06-05", "05062024": None, "1.1.1999": None, "2024-05-06": "2024-05-06", None: None}),
    (dates.find_time, {"In lúc 10h30": "10:30", "9:5": None, "25:00": None, "Giờ 7:08:09": "07:08:09", None: None}),
    (dates.is_expiry_line, {"HSD 31/12/2025": True, "Hạn sử dụng": True, "Ngày": False, None: False}),
])
def test_golden_values(spark, fn, cases):
    got = apply(spark, fn, list(cases))
    want = [float(v) if isinstance(v, int) and not isinstance(v, bool) else v for v in cases.values()]
    assert dict(zip(cases, got)) == dict(zip(cases, want))


def test_nan_is_read_as_python_reads_it(spark):
    assert math.isnan(apply(spark, numbers.coerce_numeric, ["nan"])[0])


def test_diacritics_match_unicode_decomposition(spark):
    chars = [chr(c) for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0x300, 0x370)]]
    want = ["".join(x for x in unicodedata.normalize("NFD", c.replace("đ", "d").replace("Đ", "D")) if unicodedata.category(x) != "Mn") for c in chars]
    assert apply(spark, text.strip_diacritics, chars) == want


def test_item_pairs(spark):
    s = '{"it":[{"n":"A","qty":1,"t":5},{"name":"B","t":null},{"n":"C","p":1}'
    assert [(p.name, p.total) for p in apply(spark, text.json_item_pairs, [s])[0]] == [("A", "5"), ("B", "null")]
