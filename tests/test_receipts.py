import json
import random
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from sheafline.functions import text
from sheafline.operators import loops, postprocess, quality, receipts, routing
from sheafline.sources import config, patterns, providers, requests


def receipt(spark, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "ref int, raw_text string")
    return receipts.to_receipt(receipts.parse_ladder(rows)).orderBy("ref").collect()


def test_items_are_recovered_one_by_one(spark):
    got = receipt(spark, '{"it":[null,"  ","Coca",{"n":"Phở","t":"90.000"},5,["x"]]}', '{"it":null}', '{"it":"x"}', "{}")
    assert [(i.name, i.total) for i in got[0]["items"]] == [("Coca", None), ("Phở", 90000.0)]
    assert got[0].items_dropped == 4
    assert [r["items"] for r in got[1:]] == [[], [], []]


def test_numbers_keep_their_kind(spark):
    got = receipt(spark, '{"ta":"0.704"}', '{"ta":0.704}', '{"ta":true}', '{"ta":[1]}', '{"ta":null,"total_amount":5}')
    assert [r.total_amount for r in got] == [704.0, 0.704, 1.0, None, None]


def test_rules_that_make_a_receipt_invalid(spark):
    many = json.dumps({"it": [{"n": "a"}] * 101})
    got = receipt(spark, many, '{"ly":"ODD"}', '{"td":"a date that is far too long"}', "[1]", "", None, '{"ly":"COMPLETE"}')
    assert [r.violations for r in got] == [["too_many_items"], ["unknown_layout"], ["long_date"], ["not_an_object"], ["not_an_object"], ["not_an_object"], []]
    assert len(got[0]["items"]) == 101


def test_broken_json_is_repaired(spark):
    got = receipt(spark, '{"mn":"A","it":[{"n":"B","t":5', "{'mn': 'A', it: [{n: 'B', t: 5}],}", '```json\n{"mn":"A"}\n```', 'So: {"mn":"A"} ok', "no json")
    assert [r.parsed_by for r in got] == ["repair", "repair", "json", "substring", None]
    assert [r.merchant_name for r in got] == ["A", "A", "A", "A", None]
    assert [(i.name, i.total) for i in got[0]["items"]] == [(i.name, i.total) for i in got[1]["items"]] == [("B", 5.0)]
    deep = json.loads(receipts.repair('{"a":' * 1000 + '"end"'))
    while "a" in deep and isinstance(deep["a"], dict):
        deep = deep["a"]
    assert deep == {"a": "end"}


def keys(spark, names, totals=None, strict=False):
    rows = spark.createDataFrame([(0, k, n, None if totals is None else str(totals[k])) for k, n in enumerate(names)], "ref int, pos int, n string, t string")
    rows = rows.withColumn("key", loops.item_key(F.col("n"), F.col("t"), strict)).withColumn("name", F.col("key.name"))
    return [(r.period, r.repeats) for r in loops.cyclic_runs(rows, ["ref"], "pos", "name", "key").collect()]


def test_cycles(spark):
    assert keys(spark, "A" * 9) == [] and keys(spark, "A" * 10) == [(1, 10)]
    assert keys(spark, "ABAB") == [] and keys(spark, "ABABAB") == [(2, 3)] and keys(spark, "ABCABCABC") == [(3, 3)]
    assert keys(spark, "A" * 10, range(10)) == [] and keys(spark, "A" * 10, range(10), strict=True) == [(1, 10)]


def test_dedup_keeps_the_first_of_a_run(spark):
    item = "struct<name:string,quantity:double,price:double,total:double>"
    rows = spark.createDataFrame([([(n, None, None, 1.0) for n in names],) for names in (["A", "A", "B", "A"], ["A", None, "A"], [])], f"items array<{item}>")
    got = [[i.name for i in r.o] for r in rows.select(loops.dedup_consecutive(F.col("items")).alias("o")).collect()]
    assert got == [["A", "B", "A"], ["A", None, "A"], []]


def test_canonical_names_before_denied_names(spark):
    item = "array<struct<name:string,quantity:double,price:double,total:double>>"
    names = ["PHIẾU THANH TOÁN BÁCH HÓA XANH", "Phiếu thanh toán", "Gia luon re hom nay", "咖啡", "Kingg Food Market", None]
    rows = spark.createDataFrame([(k, "COMPLETE", n, None, None, None, None) for k, n in enumerate(names)], f"ref int, layout string, merchant_name string, merchant_address string, items {item}, transaction_date string, transaction_time string")
    pairs = [("gia luon re hon", "GO"), ("gia luon re", "GO"), ("phieu thanh toan bach hoa xanh", "Bách Hoá Xanh"), ("king food market", "King Food Market")]
    got = postprocess.postprocess(rows, ["tip"], ["phieu thanh toan"], pairs).orderBy("ref")
    assert "layout" not in got.columns
    assert [r.merchant_name for r in got.collect()] == ["Bách Hoá Xanh", None, "GO", None, "King Food Market", None]
    assert SequenceMatcher(None, "kingg food market", "king food market").ratio() >= 0.9


def test_fallback_sees_triggered_rows_only(spark):
    item = "array<struct<name:string,quantity:double,price:double,total:double>>"
    schema = f"ref int, items {item}, merchant_name string, merchant_address string, transaction_date string, transaction_time string, total_amount double, trigger string, has_data boolean"
    rows = spark.createDataFrame([(1, [], "A", None, None, None, None, None, True), (2, [("x", None, None, None)] * 3, None, None, None, None, None, "hallu:x", True), (3, [], None, None, None, None, None, "empty_response", False)], schema)
    got = {r.ref: (r.engine, len(r["items"] or [])) for r in routing.with_fallback(rows, lambda hit: hit.where("ref = 3").withColumn("merchant_name", F.lit("B"))).collect()}
    assert got == {1: ("vllm", 0), 2: ("vllm", 1), 3: ("paddle", 0)}


def test_sources(spark, tmp_path):
    (tmp_path / "p.txt").write_text("# list\n\nTip, Quà tặng\nabc\n", encoding="utf-8")
    got = patterns.read_patterns(spark, f"file://{tmp_path}/p.txt").orderBy("ord").collect()
    assert [(r.pattern, r.pattern_norm) for r in got] == [("Tip", "tip"), ("Quà tặng", "qua tang"), ("abc", "abc")]
    assert patterns.read_patterns(spark, f"file://{tmp_path}/none.txt").count() == 0
    made = providers.apply_provider(spark.createDataFrame([("a",), (None,)], "t string"), providers.fake_completion, ["t"], "raw_text string, finish_reason string")
    assert {r.finish_reason for r in made.collect()} == {"stop"}
    broken = providers.apply_provider(spark.createDataFrame([("a",)], "t string"), lambda: lambda t: 1 / 0, ["t"], "x string").collect()
    assert broken[0].x is None and "ZeroDivisionError" in broken[0].provider_error
    counted = providers.count_tokens(spark.createDataFrame([("a b",), ("a b",), (None,)], "t string"), "t", providers.word_counter)
    assert sorted(r.tokens for r in counted.collect()) == [0, 2, 2]
    df = spark.createDataFrame([("data:image/png;base64,aGk=",), ("@@@",), (None,)], "b string")
    assert [r.c and bytes(r.c) for r in df.select(requests.decode_base64(F.col("b")).alias("c")).collect()] in ([b"hi", b"", None], [b"hi", None, None])


def test_settings(tmp_path):
    (tmp_path / "a.yaml").write_text("fit: {max_side: 100}\n")
    env = {"PP2_GATE_ENABLED": "no", "VLLM_IMAGE_MAX_PIXELS": "7", "PP2_FIT_MIN_PIXELS": "3", "VLLM_IMAGE_MIN_PIXELS": "9", "PADDLE_DEVICE": "cpu"}
    got = config.load((str(tmp_path / "a.yaml"),), env)
    assert (got.fit.max_side, got.gate.enabled, got.fit.max_pixels, got.fit.min_pixels, got.services.device) == (100, False, 7, 3, "cpu")
    assert [config.env_int("X", 5, 2, {"X": v}) for v in ("3",)] == [3] and config.env_int("X", 5, 2, {}) == 5
    with pytest.raises(ValueError):
        config.load((), {}) and config._changed(got, "fit", {"no_such": 1})


def test_every_setting_loads_from_yaml_and_from_the_environment(tmp_path):
    changed = lambda v: (not v) if isinstance(v, bool) else v + "x" if isinstance(v, str) else v + 1
    want = {name: {k: changed(v) for k, v in values.items()} for name, values in config.DEFAULTS.items()}
    (tmp_path / "all.yaml").write_text(json.dumps(want))
    by_file = config.load((str(tmp_path / "all.yaml"),), {})
    by_name = config.load((), {f"PP2_{s}_{k}".upper(): str(v) for s, values in want.items() for k, v in values.items()})
    plain = lambda got: {name: {k: getattr(getattr(got, name), k) for k in values} for name, values in want.items()}
    assert plain(by_file) == plain(by_name) == want
    assert plain(config.load((), {})) == config.DEFAULTS and config.DEFAULTS["gate"]["unreadable_blur"] == 80.0


def test_gate_thresholds_can_be_set(spark):
    df = spark.createDataFrame([(5, 30.0, 100.0)], "n int, h double, b double")
    of = lambda g: df.select(quality.gate(F.col("n"), F.col("h"), F.col("b"), g).alias("v")).first().v
    assert of(config.Gate()) == "marginal" and of(config.Gate(marginal_blur=90.0)) == "readable"
    assert of(config.Gate(unreadable_min_polys=6)) == "unreadable" and of(config.Gate(unreadable_min_polys=6, reject_enabled=False)) == "marginal"


def test_cycles_inside_a_row_match_those_over_rows(spark):
    rng = random.Random(12)
    lists = [[(rng.choice(["A", "B", "C", ""]), rng.choice(["1", "2"]) if k % 3 else "1") for _ in range(rng.randrange(45))] for k in range(300)]
    lists += [[(c, "") for c in "ABAB" * 5], [("A", "")] * 10, [(c, "") for c in "ABCABCABC"], [], None]
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(lists)], "ref int, keys array<struct<name:string,total:string>>")
    inside = {r.ref: r.c and tuple(r.c) for r in rows.select("ref", loops.cycle_in(F.col("keys"), single=4, cycle=2).alias("c")).collect()}
    flat = rows.select("ref", F.posexplode("keys").alias("pos", "key")).withColumn("name", F.col("key.name"))
    over = {r.ref: (r.period, r.repeats, r.sample) for r in loops.cyclic_runs(flat, ["ref"], "pos", "name", "key", single=4, cycle=2).collect()}
    assert {k: v for k, v in inside.items() if v} == over and len(over) > 40


def test_detect_looks_at_each_row_alone(spark):
    item = "array<struct<name:string,quantity:double,price:double,total:double>>"
    six, twelve = [("A", None, None, 1.0)] * 6, [("A", None, None, 1.0)] * 12
    df = spark.createDataFrame([("r", six), ("r", six), (None, twelve), ("x", None)], f"ref string, items {item}")
    got = [r.loop_reason for r in loops.detect(df).collect()]
    assert got == [None, None, "dup_items_run period=1 repeats=12 name='a'", None]


def test_patterns_meet_names_without_a_nested_loop(spark):
    rng = random.Random(15)
    text = lambda: "".join(rng.choice("aábB c") for _ in range(rng.randrange(9)))
    names, patterns = [text() for _ in range(80)] + [None, "  "], [(k, text().strip().lower().replace("á", "a")) for k in range(12)] + [(90, "")]
    patterns = [(k, " ".join(p.split())) for k, p in patterns]
    rows = spark.createDataFrame([(k, n) for k, n in enumerate(names)], "k int, name string")
    norm = lambda n: " ".join((n or "").replace("á", "a").lower().split())
    listed = spark.createDataFrame([(k, p, p.upper()) for k, p in patterns], "ord int, alias_norm string, canonical string")
    got = {r.k: r.canonical for r in postprocess.canonical_by_substring(rows, "name", listed).collect()}
    assert got == {k: next((p.upper() for _, p in patterns if p and norm(n) and p in norm(n)), None) for k, n in enumerate(names) if n is not None} | {80: None}
    kept = postprocess.deny_rows(rows, "name", listed.select(F.col("alias_norm").alias("pattern_norm")))
    assert kept.columns == ["k", "name"] and sorted(r.k for r in kept.collect()) == [k for k, n in enumerate(names) if not any(p and p in norm(n) for _, p in patterns)]
    plan = postprocess.canonical_by_substring(rows, "name", listed)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_texts_are_stripped_without_a_search_and_as_python_does(spark):
    every = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000]
    got = spark.createDataFrame([(c, f"{c}a{c}b{c}{c}") for c in every], "c string, t string").select("c", "t", text.strip(F.col("t")).alias("s"))
    assert "regexp" not in got._jdf.queryExecution().analyzed().toString()
    assert [r.c for r in got.collect() if r.s != r.t.strip()] == []


def test_a_receipt_is_known_as_an_object_without_its_whole_type(spark):
    data = [("{}", True), ('{"mn": null}', True), ("[1]", False), ('"x"', False), ("null", False), ("3", False), ("true", False), (None, False)]
    df = spark.createDataFrame(data, "j string, want boolean").withColumn("data", F.try_parse_json("j"))
    out = receipts.to_receipt(df)
    assert all(r.is_valid == r.want for r in out.select("is_valid", "want").collect())
    assert "schema_of_variant(data)" not in re.sub(r"#\d+", "", out._jdf.queryExecution().analyzed().toString())
