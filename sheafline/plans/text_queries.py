"""Queries of the scalar operators over text, numbers, dates and payloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheafline.functions import dates, numbers, text
from sheafline.operators.postprocess import parse_entry
from sheafline.operators.receipts import parse_ladder
from sheafline.plans.base import per_order, sql_fold, sql_norm, SQL_WS, table
from sheafline.sources import requests
from sheafline.sources.patterns import split_lines

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return register


@query(f"SELECT doc_id, {sql_norm('text')} AS norm FROM documents")
def norm_match(spark, d):
    """X1, X2."""
    return table(spark, d, "documents").select("doc_id", text.normalize_for_match(F.col("text")).alias("norm"))


@query(rf"SELECT doc_id, trim(regexp_replace(regexp_replace({sql_fold('text')}, '[^\p{{L}}\p{{N}}_\s\x0b\x1c-\x1f\x85\x{{a0}}]+', ' ', 'g'), '{SQL_WS}+', ' ', 'g')) AS key FROM documents")
def norm_name(spark, d):
    """X3."""
    return table(spark, d, "documents").select("doc_id", text.normalize_name(F.col("text")).alias("key"))


@query(f"SELECT conv_id, turn, nullif(trim(regexp_replace(regexp_replace(replace(text, 'a', '咖'), '[\\x{{3040}}-\\x{{30FF}}\\x{{3400}}-\\x{{4DBF}}\\x{{4E00}}-\\x{{9FFF}}\\x{{AC00}}-\\x{{D7AF}}\\x{{F900}}-\\x{{FAFF}}\\x{{FF00}}-\\x{{FFEF}}]', '', 'g'), '{SQL_WS}+', ' ', 'g')), '') AS plain FROM conversations")
def cjk_strip(spark, d):
    """X5 over texts with a CJK character put in."""
    mixed = F.replace("text", F.lit("a"), F.lit("咖"))
    return table(spark, d, "conversations").select("conv_id", "turn", text.strip_cjk(mixed).alias("plain"))


@query(r"SELECT doc_id, coalesce(nullif(regexp_replace(text || ' ;:., ', '[.,;:\s]+$', ''), ''), text || ' ;:., ') AS cut FROM documents")
def trailing_punct(spark, d):
    """X6."""
    return table(spark, d, "documents").select("doc_id", text.strip_trailing_punct(F.concat("text", F.lit(" ;:., "))).alias("cut"))


@query(r"SELECT conv_id, turn, nullif(left(regexp_replace('  ' || text || ' ', '^\s+|\s+$', '', 'g'), 250), '') AS cut, CASE WHEN length(text) > 120 THEN left(translate(text, chr(10), ' '), 120) || '…' ELSE translate(text, chr(10), ' ') END AS shown FROM conversations")
def trim_truncate(spark, d):
    """X7, X15."""
    padded = F.concat(F.lit("  "), F.col("text"), F.lit(" "))
    return table(spark, d, "conversations").select("conv_id", "turn", text.trim_to(padded, 250).alias("cut"), text.preview(F.col("text"), 120).alias("shown"))


@query(r"""
    WITH c AS (SELECT doc_id, generate_subscripts(s, 1) AS pos, unnest(s) AS ch FROM (SELECT doc_id, string_split(text, '') AS s FROM documents)),
    g AS (SELECT doc_id, ch, pos - row_number() OVER (PARTITION BY doc_id, ch ORDER BY pos) AS island FROM c),
    r AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, ch, island, count(*) AS n FROM g GROUP BY ALL) WHERE n >= 6 AND NOT regexp_matches(ch, '[\p{Nd}\s\x0b\x1c-\x1f\x85\x{a0}]'))
    SELECT doc_id, doc_id IN (SELECT doc_id FROM r) AS looped FROM documents""")
def char_run(spark, d):
    """X10."""
    return table(spark, d, "documents").select("doc_id", text.has_char_run(F.col("text")).alias("looped"))


#: Loops of every document without a pattern that looks back: places that equal the one n further, in stretches; a loop is taken from the left, and what it covers is not looked at again.
SQL_LOOPS = r"""
    WITH c AS (SELECT doc_id, generate_subscripts(s, 1) AS pos, unnest(s) AS ch FROM (SELECT doc_id, string_split(text, '') AS s FROM documents)),
    q AS (SELECT *, lead(ch, 1) OVER w AS l1, lead(ch, 2) OVER w AS l2, lead(ch, 3) OVER w AS l3, lead(ch, 4) OVER w AS l4 FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
    e AS (SELECT doc_id, 1 AS n, pos FROM q WHERE ch = l1 AND NOT regexp_matches(ch, '[\p{Nd}\s\x0b\x1c-\x1f\x85\x{a0}]')
          UNION ALL SELECT doc_id, 2, pos FROM q WHERE ch = l2 AND ch <> chr(10) UNION ALL SELECT doc_id, 3, pos FROM q WHERE ch = l3 AND ch <> chr(10) UNION ALL SELECT doc_id, 4, pos FROM q WHERE ch = l4 AND ch <> chr(10)),
    i AS (SELECT doc_id, n, min(pos) AS s, count(*) AS m FROM (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, n ORDER BY pos) AS k FROM e) GROUP BY doc_id, n, k HAVING count(*) >= CASE n WHEN 1 THEN 5 ELSE 3 * n END),
    f AS (SELECT doc_id, n, list_reduce(list_prepend({'s': 0::BIGINT, 'm': 0::BIGINT, 'e': 0::BIGINT, 'o': []::BIGINT[]}, list({'s': s, 'm': m, 'e': 0::BIGINT, 'o': []::BIGINT[]} ORDER BY s)),
              lambda a, r: CASE WHEN r.m - (greatest(r.s, a.e) - r.s) >= 3 * n
                  THEN {'s': 0::BIGINT, 'm': 0::BIGINT, 'e': greatest(r.s, a.e) + n * ((r.m - (greatest(r.s, a.e) - r.s)) // n + 1), 'o': list_append(a.o, greatest(r.s, a.e))} ELSE a END).o AS o FROM i WHERE n > 1 GROUP BY doc_id, n),
    g AS (SELECT doc_id, n, spot, substring(text, spot::INT, n) AS gram FROM (SELECT doc_id, n, unnest(o) AS spot FROM f) JOIN documents USING (doc_id)),
    k AS (SELECT doc_id, string_agg(gram, '|' ORDER BY n, spot) AS loops FROM g WHERE NOT regexp_full_match(gram, '\p{Nd}+') AND NOT regexp_full_match(gram, '[{}\[\]":,nulltrefas \n]+') GROUP BY doc_id),
    b AS (SELECT doc_id FROM k UNION SELECT doc_id FROM i WHERE n = 1)"""


@query(SQL_LOOPS + " SELECT doc_id, coalesce(loops, '') AS loops, doc_id IN (SELECT doc_id FROM b) AS looped FROM documents LEFT JOIN k USING (doc_id)")
def ngram_loop(spark, d):
    """X11; also tested against a restatement in Python."""
    return table(spark, d, "documents").select("doc_id", F.concat_ws("|", text.ngram_loops(F.col("text"))).alias("loops"), text.has_loop(F.col("text")).alias("looped"))


AMOUNT = """CASE l_linenumber % 8 WHEN 0 THEN format('{:,}', v) WHEN 1 THEN replace(format('{:,}', v), ',', '.') WHEN 2 THEN replace(format('{:,}', v), ',', '-')
    WHEN 3 THEN v || ' đ' WHEN 4 THEN 'VND ' || v WHEN 5 THEN v || ',5' WHEN 6 THEN v || '.25' ELSE '$' || v END"""


def amounts(spark, d):
    v = F.floor("l_extendedprice")
    commas, k = F.format_number(v, 0), F.col("l_linenumber") % 8
    shape = F.when(k == 0, commas).when(k == 1, F.replace(commas, F.lit(","), F.lit("."))).when(k == 2, F.replace(commas, F.lit(","), F.lit("-")))
    shape = shape.when(k == 3, F.concat(v, F.lit(" đ"))).when(k == 4, F.concat(F.lit("VND "), v)).when(k == 5, F.concat(v, F.lit(",5"))).when(k == 6, F.concat(v, F.lit(".25"))).otherwise(F.concat(F.lit("$"), v))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", shape.alias("printed"))


@query(rf"""
    WITH a AS (SELECT l_orderkey, l_linenumber, floor(l_extendedprice)::BIGINT AS v FROM lineitem), p AS (SELECT *, {AMOUNT} AS printed FROM a),
    b AS (SELECT *, regexp_replace(regexp_replace(replace(trim(printed), ' ', ''), '[đ₫]$', ''), '^(?i)(VNĐ|VND|USD)', '') AS s FROM p),
    c AS (SELECT *, CASE WHEN regexp_matches(s, '^\d+(-\d{{3}})+$') THEN replace(s, '-', '') ELSE s END AS s1 FROM b),
    e AS (SELECT *, CASE WHEN regexp_matches(s1, '^[^,]*,\d{{1,2}}$') THEN replace(s1, ',', '.') ELSE replace(s1, ',', '') END AS s2 FROM c)
    SELECT l_orderkey, l_linenumber, printed, try_cast(CASE WHEN regexp_matches(s2, '^[^.]*(\.\d{{3}})+$') THEN replace(s2, '.', '') ELSE s2 END AS DOUBLE) AS amount FROM e""")
def coerce_numeric(spark, d):
    """M1."""
    return amounts(spark, d).withColumn("amount", numbers.coerce_numeric(F.col("printed")))


@query("""
    SELECT o_orderkey, strftime(CASE o_orderkey % 5 WHEN 0 THEN o_orderdate WHEN 1 THEN o_orderdate WHEN 2 THEN
        CASE WHEN day(o_orderdate) <= 12 THEN make_date(year(o_orderdate), day(o_orderdate), month(o_orderdate)) ELSE o_orderdate END
        WHEN 3 THEN o_orderdate ELSE make_date(2000 + year(o_orderdate) % 100, month(o_orderdate), day(o_orderdate)) END, '%Y-%m-%d') AS iso FROM orders WHERE o_orderkey % 6 <> 5
    UNION ALL SELECT o_orderkey, strftime(o_orderdate, '%d.%m.%Y') || ' x' FROM orders WHERE o_orderkey % 6 = 5""")
def norm_date(spark, d):
    """D1 over five printed shapes and one that is no date."""
    t, k = F.col("o_orderdate"), F.col("o_orderkey") % 5
    as_ = lambda p: F.date_format(t, p)
    shape = F.when(F.col("o_orderkey") % 6 == 5, F.concat(as_("dd.MM.yyyy"), F.lit(" x"))).when(k == 0, as_("dd-MM-yyyy")).when(k == 1, as_("yyyy/M/d")).when(
        k == 2, as_("MM/dd/yyyy")).when(k == 3, as_("yyyyMMdd")).otherwise(as_("yy-MM-dd"))
    return table(spark, d, "orders").select("o_orderkey", dates.normalize_date(shape).alias("iso"))


@query("""
    SELECT event_id, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%H:%M:%S') WHEN 1 THEN strftime(ts, '%H:%M') WHEN 2 THEN NULL ELSE hour(ts) || 'h' || minute(ts) || ' gio' END AS clock,
           CASE WHEN event_id % 4 IN (0, 3) AND (event_id % 4 = 0 OR minute(ts) > 9) THEN CASE event_id % 4 WHEN 0 THEN strftime(ts, '%H:%M:%S') ELSE strftime(ts, '%H:%M') END
                WHEN event_id % 4 = 1 THEN strftime(ts, '%H:%M') END AS found FROM events""")
def norm_time(spark, d):
    """D2, D4."""
    t, k = F.col("ts"), F.col("event_id") % 4
    shape = F.when(k == 0, F.concat(F.date_format(t, "H:mm:ss"), F.lit(":NV:283872"))).when(k == 1, F.concat(F.date_format(t, "H:mm"), F.lit(" NV"))).when(
        k == 2, F.lit("25:99")).otherwise(F.concat(F.hour(t), F.lit("h"), F.minute(t), F.lit(" gio")))
    return table(spark, d, "events").select("event_id", dates.normalize_time(shape).alias("clock"), dates.find_time(shape).alias("found"))


@query("""
    SELECT o_orderkey, o_orderkey % 5 = 3 AS expiry, strftime(CASE o_orderkey % 5 WHEN 4 THEN NULL ELSE o_orderdate + INTERVAL 20 YEAR END, '%Y-%m-%d') AS found FROM orders""")
def parse_date_text(spark, d):
    """Dates inside lines of text."""
    t, k = F.col("o_orderdate") + F.expr("INTERVAL 20 YEAR"), F.col("o_orderkey") % 5
    line = F.when(k == 0, F.concat(F.lit("Ngày "), F.date_format(t, "dd/MM/yyyy"))).when(k == 1, F.concat(F.date_format(t, "yyyy-MM-dd"), F.lit(" lúc"))).when(
        k == 2, F.concat(F.lit("Date: "), F.date_format(t, "ddMMyyyy"))).when(k == 3, F.concat(F.lit("Hạn sử dụng "), F.date_format(t, "d.M.yy"))).otherwise(F.date_format(t, "ddMMyyyy"))
    return table(spark, d, "orders").select("o_orderkey", dates.is_expiry_line(line).alias("expiry"), dates.find_date(line, 2026).alias("found"))


@query("""
    SELECT l_orderkey, l_linenumber, CASE (l_partkey + l_linenumber) % 6 WHEN 0 THEN '' WHEN 1 THEN (l_quantity::INT)::DOUBLE::VARCHAR WHEN 2 THEN (l_partkey + 0.5)::DOUBLE::VARCHAR WHEN 3 THEN (-(l_suppkey::DOUBLE))::VARCHAR
           WHEN 4 THEN lower(l_returnflag) || ' ' || l_partkey || ' x' ELSE '' END AS total FROM lineitem""")
def norm_total(spark, d):
    """The same number in several spellings, words, and nothing."""
    k, part = (F.col("l_partkey") + F.col("l_linenumber")) % 6, F.col("l_partkey").cast("string")
    zeros = F.concat(F.col("l_quantity").cast("int").cast("string"), F.when(F.col("l_suppkey") % 2 == 0, F.lit(".00")).otherwise(F.lit("")))
    raw = F.when(k == 0, F.when(F.col("l_suppkey") % 2 == 0, F.lit(" NULL ")).otherwise(F.lit("null"))).when(k == 1, F.concat(F.lit(" "), zeros)).when(k == 2, F.concat(part, F.lit(".50"))).when(
        k == 3, F.concat(F.lit("-"), F.col("l_suppkey").cast("string"), F.lit(".0 "))).when(k == 4, F.concat("l_returnflag", F.lit(" "), part, F.lit(" X"))).otherwise(F.lit("  "))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", numbers.normalize_total(raw).alias("total"))


@query("""
    WITH b AS (SELECT o_orderkey, o_orderkey % 7 AS k, '{"ta": ' || o_custkey || repeat(',' || chr(10) || ' "x": {}', (o_custkey % 4)::INT) || '}' AS j FROM orders)
    SELECT o_orderkey, CASE WHEN k < 4 THEN j WHEN k = 4 THEN 'x' || o_orderkey || ' ' || j || ' y' WHEN k = 5 THEN '[' || o_orderkey || ']' ELSE 'no ' || o_orderkey END AS bare,
           CASE WHEN k <= 4 THEN j WHEN k = 5 THEN '[' || o_orderkey || ']' ELSE 'no ' || o_orderkey END AS inner_json FROM b""")
def fence_strip(spark, d):
    """Fences with and without a language and an end, bodies of several lines, text around, a list, and no JSON."""
    key = F.col("o_orderkey").cast("string")
    body = F.concat(F.lit('{"ta": '), F.col("o_custkey"), F.repeat(F.lit(',\n "x": {}'), (F.col("o_custkey") % 4).cast("int")), F.lit("}"))
    k, wrap = F.col("o_orderkey") % 7, lambda a, b: F.concat(F.lit(a), body, F.lit(b))
    raw = F.when(k == 0, wrap("```json\n", "\n```")).when(k == 1, wrap("  ```\n", "\n``` ")).when(k == 2, wrap("```js\n", "")).when(k == 3, wrap("\n", "  ")).when(
        k == 4, F.concat(F.lit(" x"), key, F.lit(" "), body, F.lit(" y "))).when(k == 5, F.concat(F.lit("["), key, F.lit("]"))).otherwise(F.concat(F.lit("no "), key))
    bare = text.strip_code_fences(raw)
    return table(spark, d, "orders").select("o_orderkey", bare.alias("bare"), text.json_substring(bare).alias("inner_json"))


@query("""
    SELECT l_orderkey, count(*) FILTER (l_linenumber % 5 <> 4)::INT AS pairs, coalesce(string_agg('Item ' || l_partkey || '=' || CASE l_linenumber % 5 WHEN 0 THEN 'null' WHEN 1 THEN l_partkey::VARCHAR WHEN 2 THEN '-' || l_suppkey || '.5' ELSE '0' END, ';'
           ORDER BY l_linenumber, l_partkey, l_suppkey) FILTER (l_linenumber % 5 <> 4), '') AS listed FROM lineitem GROUP BY l_orderkey""")
def json_pairs(spark, d):
    """X12 over an order's lines as JSON that is still being written: short and full names, totals of several kinds, items without one."""
    k = lambda r: r["l_linenumber"] % 5
    total = lambda r: F.when(k(r) == 0, F.lit("null")).when(k(r) == 1, r["l_partkey"].cast("string")).when(k(r) == 2, F.concat(F.lit("-"), r["l_suppkey"], F.lit(".5"))).otherwise(F.lit("0"))
    name = lambda r: F.concat(F.when(k(r) == 1, F.lit('{"name" : "Item ')).otherwise(F.lit('{"n":"Item ')), r["l_partkey"], F.lit('"'))
    item = lambda r: F.concat(name(r), F.when(k(r) == 4, F.lit(',"p":1}')).otherwise(F.concat(F.lit(',"qty":1,"t":'), total(r), F.lit("}"))))
    rows = per_order(table(spark, d, "lineitem"), "l_partkey", "l_suppkey")
    raw = F.concat(F.lit('{"it":['), F.array_join(F.transform("rows", item), ","), F.lit(',{"n":"C","qty"'))
    got = rows.select("l_orderkey", text.json_item_pairs(raw).alias("p"))
    return got.select("l_orderkey", F.size("p").alias("pairs"), F.array_join(F.transform("p", lambda x: F.concat(x["name"], F.lit("="), x["total"])), ";").alias("listed"))


@query("""
    WITH b AS (SELECT *, 'Shop ' || o_custkey AS shop, (o_orderkey // 4) % 3 AS cut FROM orders)
    SELECT o_orderkey, CASE o_orderkey % 4 WHEN 2 THEN 'substring' WHEN 3 THEN 'repair' ELSE 'json' END AS parsed_by,
           CASE WHEN o_orderkey % 4 <> 3 THEN '{"it":[{"n":"A","t":' || o_orderkey || '}],"mn":"' || shop || '","ta":5}'
                WHEN cut = 0 THEN '{"mn":"' || rtrim(left(shop, (o_orderkey % length(shop))::INT)) || '"}'
                WHEN cut = 1 THEN '{"it":[{"n":"A","t":' || left(o_orderkey::VARCHAR, (1 + o_custkey % length(o_orderkey::VARCHAR))::INT) || '}],"mn":"' || shop || '"}'
                ELSE '{"it":[{"n":"A","t":' || o_orderkey || '}],"mn":"' || shop || '"}' END AS data FROM b""")
def json_ladder(spark, d):
    """Whole, fenced, prefixed and cut JSON; each row is cut at a place of its own in a name, in a number or behind an item.

    White space at the end of what was written is dropped before it is read.
    """
    shop, key = F.concat(F.lit("Shop "), F.col("o_custkey")), F.col("o_orderkey").cast("string")
    head, item = F.concat(F.lit('{"mn":"'), shop), F.lit('","it":[{"n":"A","t":')
    body = F.concat(head, item, key, F.lit('}],"ta":5}'))
    k, cut = F.col("o_orderkey") % 4, F.floor(F.col("o_orderkey") / 4) % 3
    in_name = F.concat(F.lit('{"mn":"'), F.substr(shop, F.lit(1), (F.col("o_orderkey") % F.length(shop)).cast("int")))
    in_number = F.concat(head, item, F.substr(key, F.lit(1), (1 + F.col("o_custkey") % F.length(key)).cast("int")))
    broken = F.when(cut == 0, in_name).when(cut == 1, in_number).otherwise(F.concat(head, item, key, F.substr(F.lit("}],"), F.lit(1), (F.col("o_custkey") % 4).cast("int"))))
    raw = F.when(k == 0, body).when(k == 1, F.concat(F.lit("```\n"), body, F.lit("\n```"))).when(k == 2, F.concat(F.lit("Sure: "), body, F.lit("!"))).otherwise(broken)
    got = parse_ladder(table(spark, d, "orders").select("o_orderkey", raw.alias("raw_text")))
    return got.select("o_orderkey", "parsed_by", F.to_json("data").alias("data"))


@query("""
    SELECT doc_id, octet_length(encode(text)) AS bytes, text AS back, NULL::VARCHAR AS error FROM documents WHERE doc_id % 3 <> 2 AND text <> ''
    UNION ALL SELECT doc_id, CASE WHEN doc_id % 3 <> 2 THEN 0 END, CASE WHEN doc_id % 3 <> 2 THEN '' END, 'bad_payload' FROM documents WHERE NOT (doc_id % 3 <> 2 AND text <> '')""")
def b64_payload(spark, d):
    """Plain, as a data URI, and broken."""
    k = F.col("doc_id") % 3
    plain = F.to_binary("text", F.lit("utf-8"))
    raw = F.when(k == 0, F.base64(plain)).when(k == 1, requests.data_uri(plain)).otherwise(F.lit("@@@=a"))
    got = table(spark, d, "documents").select("doc_id", requests.decode_base64(raw).alias("c"))
    return got.select("doc_id", F.length("c").alias("bytes"), F.decode("c", "UTF-8").alias("back"), requests.payload_error(F.col("c")).alias("error"))


@query("""
    WITH n AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 4 < 3 THEN l_partkey % 4 END AS u, CASE WHEN l_suppkey % 5 < 2 THEN l_suppkey % 5 END AS b FROM lineitem),
    v AS (SELECT *, CASE WHEN u IS NULL AND b IS NULL THEN 'no_source' WHEN u IS NOT NULL AND b IS NOT NULL THEN 'two_sources' WHEN coalesce(u, b) <> 1 THEN 'wrong_count' ELSE '' END AS violations FROM n)
    SELECT l_orderkey, l_linenumber, violations, CASE WHEN violations = '' THEN 200 ELSE 422 END AS status FROM v""")
def request_violations(spark, d):
    """Lists of none to two sources, and none."""
    from sheafline.operators.routing import status_of

    listed = lambda n, most: F.when(n < most, F.slice(F.array(*(F.concat(F.lit("u"), F.col("l_orderkey"), F.lit(f"/{k}")) for k in range(3))), F.lit(1), n.cast("int")))
    v = requests.violations(listed(F.col("l_partkey") % 4, 3), listed(F.col("l_suppkey") % 5, 2))
    got = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", v.alias("v"))
    return got.select("l_orderkey", "l_linenumber", F.concat_ws(",", "v").alias("violations"), status_of(F.when(F.size("v") > 0, F.lit("invalid_request"))).alias("status"))


@query("SELECT n_nationkey, t.ord, t.pattern || n_name AS pattern, t.alias || lower(n_name) AS alias, t.canonical || n_name AS canonical FROM nation, (VALUES (0, 'ÀB => Chợ ', 'ab => cho ', NULL), (1, 'x', 'x', 'x')) t(ord, pattern, alias, canonical) WHERE false UNION ALL SELECT n_nationkey, 0, 'Ác ' || n_name || ' => Chợ', 'ac ' || lower(n_name), 'Chợ' FROM nation UNION ALL SELECT n_nationkey, 1, n_name, lower(n_name), n_name FROM nation UNION ALL SELECT n_nationkey, 2, '=> ' || n_name, NULL, NULL FROM nation")
def pattern_file(spark, d):
    """Comments, blank lines, commas and mapped names."""
    lines = F.split(F.concat(F.lit("# names\n\n Ác "), F.col("n_name"), F.lit(" => Chợ , "), F.col("n_name"), F.lit("\n=> "), F.col("n_name")), "\n")
    rows = table(spark, d, "nation").select("n_nationkey", F.posexplode(lines).alias("line", "value"))
    rows = rows.withColumn("line_no", F.struct("n_nationkey", "line"))
    got = split_lines(rows).withColumn("e", parse_entry(F.col("pattern")))
    got = got.select(F.col("ord.line_no.n_nationkey").alias("n_nationkey"), "ord", "pattern", F.col("e.alias_norm").alias("alias"), F.col("e.canonical").alias("canonical"))
    from pyspark.sql import Window as W

    return got.withColumn("ord", F.row_number().over(W.partitionBy("n_nationkey").orderBy("ord")) - 1)


@query("""
    SELECT o_orderkey, 'Row ' || o_custkey || CASE WHEN o_orderkey % 2 = 0 THEN ' (columns)' ELSE '' END || chr(10) AS prompt, '<context>' || chr(10) || 'Current year is ' || year(o_orderdate)
           || '. Use ONLY to expand a PRINTED 2-digit year (DD/MM/YY -> 20YY). Never add a year when the printed date has only day and month.' || chr(10) || '</context>' || chr(10) || chr(10) AS context,
           CASE WHEN o_orderkey % 3 = 0 THEN 'auto-' || left(sha256(o_custkey::VARCHAR), 8) ELSE 'r' || o_orderkey END AS ref FROM orders""")
def prompt_block(spark, d):
    """P8, P9, D5."""
    hint = F.when(F.col("o_orderkey") % 2 == 0, F.lit(" (columns)")).otherwise(F.lit(""))
    prompt = F.replace(F.concat(F.lit("Row "), F.col("o_custkey"), F.lit("{hint}\n")), F.lit("{hint}"), hint)
    given = F.when(F.col("o_orderkey") % 6 == 0, F.lit("N/A")).when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("r"), "o_orderkey"))
    return table(spark, d, "orders").select(
        "o_orderkey", prompt.alias("prompt"), dates.year_context(F.year("o_orderdate")).alias("context"), requests.reference_id(given, F.to_binary(F.col("o_custkey").cast("string"), F.lit("utf-8"))).alias("ref"))


@query("""
    SELECT l_orderkey, l_linenumber, greatest(32, l_partkey::INT // 32 * 32) AS down, greatest(32, (l_partkey::INT + 31) // 32 * 32) AS up,
           CASE WHEN l_linenumber = 7 THEN 2656 WHEN 8192 - l_partkey * 60 - 256 < 512 THEN 512 ELSE least(2656, 8192 - l_partkey * 60 - 256) END AS most,
           round_even(l_partkey / 8.0, 1)::DOUBLE AS even FROM lineitem""")
def align_numbers(spark, d):
    """M2, M8, M9."""
    n = F.col("l_partkey").cast("int")
    prompt = F.when(F.col("l_linenumber") != 7, F.col("l_partkey") * 60)
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", numbers.align_down(n, 32).alias("down"), numbers.align_up(n, 32).alias("up"),
        numbers.max_tokens(prompt, 2656, 8192, 256, 512).alias("most"), F.bround(n / 8, 1).alias("even"))
