"""Queries of the receipt operators: an order is a receipt, its lines are the items."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sheafline.functions.text import normalize_for_match
from sheafline.operators import loops, postprocess, receipts, routing
from sheafline.plans.base import per_order, sql_norm, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return register


def raw_receipts(spark, d):
    """Orders as JSON with short keys: amounts as text in one shape and as numbers."""
    items = per_order(table(spark, d, "lineitem"), "l_partkey", "l_quantity", "l_extendedprice")
    rows = table(spark, d, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"))
    item = lambda r: F.struct(F.concat(F.lit(" part "), r["l_partkey"]).alias("n"), r["l_quantity"].alias("qty"), F.concat(F.format_number(F.floor(r["l_extendedprice"]), 0), F.lit(" đ")).alias("p"), F.floor(r["l_extendedprice"]).alias("t"))
    body = F.struct(
        F.lit("COMPLETE").alias("ly"), F.transform("rows", item).alias("it"), F.concat(F.lit("Shop "), F.col("o_custkey")).alias("mn"), F.lit("  ").alias("ma"),
        F.date_format("o_orderdate", "dd-MM-yyyy").alias("td"), F.lit("8:05:NV").alias("tt"), F.floor("o_totalprice").alias("ta"))
    return rows.select(F.col("o_orderkey").alias("ref"), F.to_json(body).alias("raw_text"))


@query("""
    SELECT o_orderkey AS ref, 'json' AS parsed_by, true AS is_valid, count(*) AS n_items, sum(floor(l_extendedprice))::DOUBLE AS total, sum(floor(l_extendedprice))::DOUBLE AS price,
           sum(l_quantity)::DOUBLE AS quantity, 'part ' || min({'n': l_linenumber, 'p': l_partkey}).p AS first_name, 'Shop ' || any_value(o_custkey) AS merchant_name, NULL::VARCHAR AS merchant_address,
           strftime(any_value(o_orderdate), '%Y-%m-%d') AS transaction_date, '08:05' AS transaction_time, any_value(floor(o_totalprice))::DOUBLE AS total_amount, 4::BIGINT AS n_scalars
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey""")
def receipt_struct(spark, d):
    """JSON parsed back into typed receipts."""
    got = receipts.to_receipt(receipts.parse_ladder(raw_receipts(spark, d)))
    total = lambda n: F.aggregate(F.transform("items", lambda i: i[n]), F.lit(0.0), lambda a, v: a + v)
    return got.select(
        "ref", "parsed_by", "is_valid", F.size("items").alias("n_items"), total("total").alias("total"), total("price").alias("price"), total("quantity").alias("quantity"),
        F.col("items")[0]["name"].alias("first_name"), *receipts.SCALARS, receipts.substantive_scalars().alias("n_scalars"))


@query("""
    SELECT l_orderkey AS ref, count(*) FILTER (l_linenumber % 6 IN (2, 3)) AS kept, count(*) FILTER (l_linenumber % 6 NOT IN (2, 3)) AS dropped,
           coalesce(sum(90000) FILTER (l_linenumber % 6 = 3), 0)::DOUBLE AS total FROM lineitem GROUP BY l_orderkey""")
def item_recover(spark, d):
    """Lists of mixed elements."""
    k = lambda r: r["l_linenumber"] % 6
    element = lambda r: F.when(k(r) == 0, F.lit("null")).when(k(r) == 1, F.lit('"  "')).when(k(r) == 2, F.lit('"Coca"')).when(k(r) == 3, F.lit('{"n":"Phở","t":"90.000"}')).when(k(r) == 4, F.lit("5")).otherwise(F.lit('["x"]'))
    rows = per_order(table(spark, d, "lineitem"))
    rows = rows.select(F.col("l_orderkey").alias("ref"), F.try_parse_json(F.concat(F.lit("["), F.array_join(F.transform("rows", element), ","), F.lit("]"))).alias("v"))
    rows = rows.withColumn("items", receipts.items_of(F.col("v"))).withColumn("dropped", receipts.dropped_of(F.col("v"), F.col("items")))
    total = F.aggregate(F.transform("items", lambda i: F.coalesce(i["total"], F.lit(0.0))), F.lit(0.0), lambda a, v: a + v)
    return rows.select("ref", F.size("items").alias("kept"), "dropped", total.alias("total"))


@query("""
    SELECT o_orderkey AS ref, CASE o_orderkey % 5 WHEN 3 THEN NULL WHEN 4 THEN NULL WHEN 1 THEN 'long ' || o_custkey ELSE 'short ' || o_custkey END AS value, o_orderkey % 5 NOT IN (3, 4) AS present FROM orders""")
def first_present(spark, d):
    """Short and long keys, both in either order, a null that counts as present, and neither."""
    k, short, long = F.col("o_orderkey") % 5, F.concat(F.lit('"n":"short '), F.col("o_custkey"), F.lit('"')), F.concat(F.lit('"name":"long '), F.col("o_custkey"), F.lit('"'))
    both = F.when(F.col("o_custkey") % 2 == 0, F.concat(long, F.lit(","), short)).otherwise(F.concat(short, F.lit(","), long))
    raw = F.concat(F.lit("{"), F.when(k == 0, short).when(k == 1, F.concat(long, F.lit(',"z":1'))).when(k == 2, both).when(k == 3, F.concat(F.lit('"n":null,'), long)).otherwise(F.lit('"m":1')), F.lit("}"))
    value = receipts.as_text(receipts.field(F.try_parse_json(raw), "n", "name"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("ref"), value.alias("value"), value.isNotNull().alias("present"))


PATTERNS = ("almond", "blue", "green", "red", "steel")


def pattern_table(spark):
    return spark.createDataFrame([(k, p, p) for k, p in enumerate(PATTERNS)], "ord int, pattern string, pattern_norm string")


@query(f"SELECT p_partkey, p_name FROM part p WHERE NOT EXISTS (SELECT 1 FROM (VALUES {', '.join(f'({p!r})' for p in PATTERNS)}) t(x) WHERE contains({sql_norm('p.p_name')}, t.x))")
def exclude_items(spark, d):
    """F1, J4 in exploded form: an anti join on contains."""
    return postprocess.deny_rows(table(spark, d, "part").select("p_partkey", "p_name"), "p_name", pattern_table(spark))


@query(f"SELECT doc_id, n_chars FROM documents d WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT {sql_norm('text')} AS x FROM benchmark) b WHERE x <> '' AND contains({sql_norm('d.text')}, x))")
def deny_passages(spark, d):
    """F1, J4 with a list that grows: documents without any passage of the benchmark, all passages in one automaton."""
    listed = table(spark, d, "benchmark").select(normalize_for_match(F.col("text")).alias("pattern_norm")).distinct()
    return postprocess.deny_rows(table(spark, d, "documents"), "text", listed).select("doc_id", "n_chars")


@query()
def similar_words(spark, d):
    """J2 between two tables: words of conversations that are all but those of the benchmark; tested against difflib."""
    word = lambda name: F.explode(F.split(normalize_for_match(F.col("text")), "[^\\p{L}]+"))
    words = lambda name: table(spark, d, name).select(word(name).alias("word")).where(F.length("word") >= 8).distinct()
    aliases = words("benchmark").select(F.col("word").alias("ord"), F.col("word").alias("alias_norm"), F.col("word").alias("canonical"))
    return postprocess.similar(words("conversations"), "word", aliases, least=0.85).select("word", "canonical")


@query("SELECT c_custkey, CASE WHEN contains(lower(c_name), '7') THEN NULL ELSE c_name END AS merchant_name FROM customer")
def exclude_merchant(spark, d):
    """F2, J3."""
    rows = table(spark, d, "customer").select("c_custkey", F.col("c_name").alias("merchant_name"))
    return postprocess.deny_merchant(rows, ["7", "no such name"])


@query("""
    SELECT s_suppkey, s_name, (SELECT arg_min(c, o) FROM (VALUES (0, '#00000001', 'One'), (1, '0000', 'Many'), (2, 'supplier', 'Any')) t(o, a, c) WHERE contains(lower(s_name), a)) AS canonical FROM supplier""")
def canonical_merchant(spark, d):
    """The first entry in order whose alias is part of the name."""
    names = spark.createDataFrame([(0, "#00000001", "One"), (1, "0000", "Many"), (2, "supplier", "Any")], "ord int, alias_norm string, canonical string")
    return postprocess.canonical_by_substring(table(spark, d, "supplier").select("s_suppkey", "s_name"), "s_name", names).select("s_suppkey", "s_name", "canonical")


@query()
def canonical_ratio(spark, d):
    """Names with a letter changed, matched by similarity; tested against difflib."""
    rows = table(spark, d, "customer").select("c_custkey", F.translate("c_name", "u", "v").alias("merchant_name"))
    return postprocess.canonicalize(rows, [("customer#000000001", "First"), ("customer#000000002", "Second")])


@query("""
    SELECT l_orderkey, l_linenumber FROM (SELECT *, lag(l_returnflag || l_linestatus) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag || l_linestatus) AS b FROM lineitem)
    WHERE b IS NULL OR b <> l_returnflag || l_linestatus""")
def dedup_items(spark, d):
    """W2 over rows."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat("l_returnflag", "l_linestatus").alias("k"))
    rows = rows.withColumn("o", F.struct("l_linenumber", "k"))
    return loops.repeated_rows(rows, ["l_orderkey"], "o", F.col("k"), F.col("k") == "").where("NOT repeats").select("l_orderkey", "l_linenumber")


@query("""
    WITH k AS (SELECT l_orderkey, l_linenumber, l_returnflag AS n, lag(l_returnflag) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag) AS b FROM lineitem)
    SELECT l_orderkey AS ref, count(*) FILTER (b IS NULL OR b <> n) AS kept, count(*) FILTER (b = n) AS dropped FROM k GROUP BY 1""")
def dedup_struct(spark, d):
    """W2, R3 over an array of items."""
    item = lambda r: F.struct(r["l_returnflag"].alias("name"), F.lit(None).cast("double").alias("quantity"), F.lit(None).cast("double").alias("price"), F.lit(5.0).alias("total"))
    rows = per_order(table(spark, d, "lineitem"), "l_returnflag").select("l_orderkey", F.transform("rows", item).alias("items"))
    out = rows.withColumn("out", loops.dedup_consecutive(F.col("items")))
    return out.select(F.col("l_orderkey").alias("ref"), F.size("out").alias("kept"), (F.size("items") - F.size("out")).alias("dropped"))


CYCLES = """
    WITH e AS (SELECT user_id, event_type AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS spot FROM events),
    p AS (SELECT e.*, range AS period FROM e, range(1, 6)),
    m AS (SELECT *, CASE period WHEN 1 THEN lag(k, 1) OVER w WHEN 2 THEN lag(k, 2) OVER w WHEN 3 THEN lag(k, 3) OVER w WHEN 4 THEN lag(k, 4) OVER w ELSE lag(k, 5) OVER w END AS seed,
                 lag(k, 1) OVER w AS k1, lag(k, 2) OVER w AS k2, lag(k, 3) OVER w AS k3, lag(k, 4) OVER w AS k4, lag(k, 5) OVER w AS k5 FROM p WINDOW w AS (PARTITION BY user_id, period ORDER BY spot)),
    i AS (SELECT *, seed = k AS hit, sum(CASE WHEN seed = k THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, period ORDER BY spot) AS island FROM m),
    r AS (SELECT user_id, period, island, count(*) // period + 1 AS repeats, min(spot) AS start, arg_min(seed, spot) AS sample,
                 arg_min(len(list_distinct(list_slice([k1, k2, k3, k4, k5], 1, period))), spot) AS kinds FROM i WHERE hit GROUP BY user_id, period, island),
    g AS (SELECT * FROM r WHERE CASE WHEN period = 1 THEN repeats >= 3 ELSE repeats >= 2 AND kinds > 1 END)
    SELECT user_id, period, repeats, sample FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY repeats DESC, period, start) AS n FROM g) WHERE n = 1"""


@query(CYCLES)
def cyclic_items(spark, d):
    """W1, J6 over each user's events, with lower thresholds."""
    rows = table(spark, d, "events").select("user_id", F.struct("ts", "event_id").alias("o"), F.col("event_type").alias("k"), F.col("event_type").alias("name"))
    return loops.cyclic_runs(rows, ["user_id"], "o", "name", "k", single=3, cycle=2)


@query(CYCLES.replace("SELECT user_id, event_type AS k", "SELECT event_id >= 0 AS user_id, event_type AS k").replace("PARTITION BY user_id ORDER BY ts", "PARTITION BY event_id >= 0 ORDER BY ts").replace("SELECT user_id, period, repeats, sample FROM", "SELECT period, repeats, sample FROM"))
def cyclic_all(spark, d):
    """W1 over one hot group: all events as one list, in segments of a thousand."""
    rows = table(spark, d, "events").select((F.col("event_id") >= 0).alias("g"), F.struct("ts", "event_id").alias("o"), F.col("event_type").alias("k"), F.col("event_type").alias("name"))
    return loops.cyclic_runs(rows, ["g"], "o", "name", "k", single=3, cycle=2, segment=1000).drop("g")


@query("""
    SELECT user_id, event_id, lag(event_type) OVER w IS NOT DISTINCT FROM event_type AS same, n <= 30 AS tail
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def tail_pairs(spark, d):
    """The last 30 of each user, and which repeat the one before."""
    rows = table(spark, d, "events")
    n = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    rows = loops.repeated_rows(rows.withColumn("o", F.struct("ts", "event_id")).withColumn("tail", n <= 30), ["user_id"], "o", F.col("event_type"), F.lit(False))
    return rows.select("user_id", "event_id", F.col("repeats").alias("same"), "tail")


def typed(spark, d):
    """Orders as typed receipts, some of their texts looping, blank or denied."""
    rows = table(spark, d, "orders").join(per_order(table(spark, d, "lineitem"), "l_partkey", "l_quantity", "l_extendedprice", "l_returnflag"), F.col("o_orderkey") == F.col("l_orderkey"))
    k = F.col("o_orderkey") % 5
    name = lambda r: F.when(r["l_partkey"] % 7 == 0, F.lit("item  BLUR")).when(r["l_partkey"] % 7 == 1, F.lit("aaaaaaaa")).when(r["l_partkey"] % 7 == 2, F.lit("Khuyến mãi")).otherwise(F.concat(F.lit("Cà phê "), r["l_partkey"], F.lit(" .;")))
    number = lambda r: F.when(r["l_partkey"] % 14 != 1, r["l_quantity"])
    none = F.lit(None).cast("double")
    item = lambda r: F.struct(name(r).alias("name"), number(r).alias("quantity"), none.alias("price"), none.alias("total"))
    merchant = F.when(k == 0, F.lit("PHIẾU THANH TOÁN Bách Hoá")).when(k == 1, F.lit("Phiếu thanh toán")).when(k == 2, F.lit("咖啡")).when(k == 3, F.lit("lololololo")).otherwise(F.concat(F.lit("Shop "), F.col("o_custkey")))
    return rows.select(
        F.col("o_orderkey").alias("ref"), F.lit("COMPLETE").alias("layout"), F.transform("rows", item).alias("items"), merchant.alias("merchant_name"), F.lit("Street 1").alias("merchant_address"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("transaction_date"), F.lit(None).cast("string").alias("transaction_time"), F.col("o_totalprice").alias("total_amount"))


@query("""
    SELECT o_orderkey AS ref, CASE o_orderkey % 5 WHEN 0 THEN 'Bách Hoá Xanh' WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 3 THEN 'lololololo' ELSE 'Shop ' || any_value(o_custkey) END AS merchant_name,
           count(*) FILTER (l_partkey % 7 NOT IN (0, 2)) AS n_items, count(*) FILTER (l_partkey % 7 = 1) AS n_loops,
           'Cà phê ' || (min({'n': l_linenumber, 'p': l_partkey}) FILTER (l_partkey % 7 > 2)).p AS first_name
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey""")
def postprocess_full(spark, d):
    """All cleanup steps in their order."""
    got = postprocess.postprocess(typed(spark, d), ["khuyen mai"], ["phieu thanh toan"], [("phieu thanh toan bach hoa", "Bách Hoá Xanh")])
    looped = F.filter("items", lambda i: i["name"] == "aaaaaaaa")
    first = F.get(F.filter(F.transform("items", lambda i: i["name"]), lambda n: n != "aaaaaaaa"), F.lit(0))
    return got.select("ref", "merchant_name", F.size("items").alias("n_items"), F.size(looped).alias("n_loops"), first.alias("first_name"))


@query("""
    SELECT o_orderkey AS ref, o_orderkey % 5 = 3 AS merchant_nulled, count(*) FILTER (l_partkey % 14 <> 1) AS n_items,
           count(*) FILTER (l_partkey % 7 = 1 AND l_partkey % 14 <> 1) AS n_nameless, count(*) FILTER (l_partkey % 14 = 1) AS n_dropped
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey""")
def scrub_fields(spark, d):
    """looping texts go; items stay where they have a number."""
    rows = typed(spark, d).withColumn("merchant_name", F.when(F.col("ref") % 5 == 3, F.lit("khokhokhokho")).otherwise(F.col("merchant_name")))
    got = loops.scrub(rows)
    return got.select(
        "ref", F.array_contains("nulled", "merchant_name").alias("merchant_nulled"), F.size("items").alias("n_items"),
        F.size(F.filter("items", lambda i: i["name"].isNull())).alias("n_nameless"), F.size(F.filter("nulled", lambda p: p.endswith("(dropped)"))).alias("n_dropped"))


@query("""
    SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 5 THEN 'vlm_upstream_error' WHEN l_linenumber = 2 THEN 'hallu:stream_abort' WHEN l_linenumber = 3 THEN 'vlm_truncated'
           WHEN l_tax > 0.06 THEN 'hallu:loop' WHEN l_discount < 0.03 THEN 'empty_response' END AS trigger,
           CASE WHEN NOT (l_quantity < 5 OR l_linenumber IN (2, 3) OR l_tax > 0.06 OR l_discount < 0.03) THEN 'vllm'
                WHEN NOT (l_discount < 0.03 AND NOT (l_quantity < 5 OR l_linenumber IN (2, 3) OR l_tax > 0.06)) AND l_partkey % 2 = 0 AND l_discount >= 0.03 THEN 'vllm'
                WHEN NOT l_quantity < 5 AND (l_linenumber = 2 OR (l_linenumber <> 3 AND l_tax > 0.06)) AND l_partkey % 3 = 0 AND l_suppkey % 2 = 0 THEN 'vllm' ELSE 'paddle' END AS engine FROM lineitem""")
def trigger_route(spark, d):
    """Why a request falls back and whose result it gets."""
    rows = table(spark, d, "lineitem")
    finish = F.when(F.col("l_linenumber") == 2, F.lit("hallu_abort")).when(F.col("l_linenumber") == 3, F.lit("length")).otherwise(F.lit("stop"))
    has = F.col("l_discount") >= 0.03
    rows = rows.withColumn("trigger", routing.trigger(F.col("l_quantity") < 5, finish, F.when(F.col("l_tax") > 0.06, F.lit("loop")), has))
    items = F.when(F.col("l_suppkey") % 2 == 0, F.lit(4)).otherwise(F.lit(0))
    fallback = F.when(F.col("l_partkey") % 3 == 0, F.lit(0)).otherwise(F.lit(2))
    return rows.select("l_orderkey", "l_linenumber", "trigger", routing.engine(F.col("trigger"), items, has, fallback, F.col("l_partkey") % 2 != 0).alias("engine"))


@query("""
    SELECT c_custkey, (CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 1 END + CASE WHEN c_custkey % 4 = 0 THEN 0 ELSE 1 END + CASE WHEN c_acctbal < 0 THEN 0 ELSE 1 END)::INT AS n,
           NOT (c_custkey % 3 = 0 AND c_custkey % 4 = 0 AND c_acctbal < 0) AS has_data FROM customer""")
def scalar_count(spark, d):
    """A1, F10."""
    rows = table(spark, d, "customer").select(
        "c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")).alias("merchant_name"), F.when(F.col("c_custkey") % 4 == 0, F.lit("  ")).otherwise(F.col("c_mktsegment")).alias("merchant_address"),
        F.lit(None).cast("string").alias("transaction_date"), F.lit("").alias("transaction_time"), F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("total_amount"), F.array().cast(f"array<{receipts.ITEM}>").alias("items"))
    return rows.select("c_custkey", receipts.substantive_scalars().alias("n"), receipts.has_data().alias("has_data"))


@query("""
    WITH r AS (SELECT o_orderkey AS ref, any_value(o_custkey) AS c, count(*) AS n, any_value(o_totalprice) AS total FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1)
    SELECT ref, CASE ref % 4 WHEN 0 THEN NULL WHEN 1 THEN 'vlm_truncated' WHEN 2 THEN 'empty_response' END AS trigger,
           CASE WHEN ref % 4 IN (0, 3) THEN 'vllm' WHEN ref % 4 = 1 AND c % 2 = 0 THEN 'vllm' ELSE 'paddle' END AS engine,
           CASE WHEN ref % 4 IN (0, 3) OR (ref % 4 = 1 AND c % 2 = 0) THEN CASE WHEN ref % 4 = 2 THEN 0 ELSE n END WHEN c % 2 = 1 THEN 1 ELSE 0 END AS n_items,
           CASE WHEN ref % 4 IN (0, 3) OR (ref % 4 = 1 AND c % 2 = 0) THEN total WHEN c % 2 = 1 THEN 1.0 END AS total_amount FROM r""")
def pipeline_branch(spark, d):
    """C6, P4, H: only triggered rows reach the fallback; its failures are empty records."""
    rows = typed(spark, d).join(table(spark, d, "orders").select(F.col("o_orderkey").alias("ref"), "o_custkey"), "ref")
    empty = F.col("ref") % 4 == 2
    rows = receipts.fail_safe(rows, empty)
    rows = rows.withColumn("has_data", receipts.has_data()).withColumn("trigger", F.when(F.col("ref") % 4 == 1, F.lit("vlm_truncated")).when(empty, F.lit("empty_response")))

    def fallback(hit):
        made = F.array(F.struct(F.lit("x").alias("name"), F.lit(1.0).alias("quantity"), F.lit(1.0).alias("price"), F.lit(1.0).alias("total")))
        out = receipts.fail_safe(hit.withColumn("items", made).withColumn("total_amount", F.lit(1.0)), F.col("o_custkey") % 2 == 0)
        return out.withColumn("has_data", receipts.has_data())

    got = routing.with_fallback(rows, fallback)
    return got.select("ref", "trigger", "engine", F.size("items").alias("n_items"), "total_amount")


@query(f"SELECT p_partkey, {sql_norm('p_name')} AS norm, p_partkey % 2 = 0 AS blur FROM part")
def blur_drop(spark, d):
    """the sentinel item is told by its normalised name."""
    one = F.when(F.col("p_partkey") % 2 == 0, F.lit(" Ítem  blur")).otherwise(F.col("p_name"))
    none = F.lit(None).cast("double")
    rows = table(spark, d, "part").select("p_partkey", "p_name", F.array(F.struct(one.alias("name"), none.alias("quantity"), none.alias("price"), none.alias("total"))).alias("items"))
    got = postprocess.drop_sentinel(rows)
    return got.select("p_partkey", normalize_for_match(F.col("p_name")).alias("norm"), (F.size("items") == 0).alias("blur"))


@query("""
    SELECT o_orderkey AS ref, true AS is_valid, NULL::VARCHAR AS loop_reason,
           '{"merchant_name":"Shop ' || any_value(o_custkey) || '","merchant_address":null,"transaction_date":"' || strftime(any_value(o_orderdate), '%Y-%m-%d') || '","transaction_time":"08:05","items":['
           || string_agg('{"name":"part ' || l_partkey || '","quantity":' || l_quantity::BIGINT || '.0,"price":' || floor(l_extendedprice)::BIGINT || '.0,"total":' || floor(l_extendedprice)::BIGINT || '.0}',
                         ',' ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice)
           || '],"total_amount":' || any_value(floor(o_totalprice)::BIGINT) || '.0}' AS answer
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey""")
def receipt_answer(spark, d):
    """Whole receipts as JSON text, from raw model output to the answer."""
    got = receipts.to_receipt(receipts.parse_ladder(raw_receipts(spark, d)))
    got = loops.detect(loops.scrub(postprocess.postprocess(got, ["khuyen mai"], ["phieu thanh toan"])))
    return got.select("ref", "is_valid", "loop_reason", receipts.receipt_json().alias("answer"))
