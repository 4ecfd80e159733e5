"""The queries of this package's operators, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafline.llm import runs, secret_scan
from sheafline.llm.bpe import encode
from sheafline.llm.chat import digests, format_chats
from sheafline.llm.common import table
from sheafline.llm.embed_dedup import near_groups
from sheafline.llm.exact_dedup import exact_dedup
from sheafline.llm.langid import held_out, identify, train
from sheafline.llm.lm_score import pseudo_likelihood
from sheafline.llm.mixing import mix
from sheafline.llm.phrases import collocations
from sheafline.llm.sharding import interleave
from sheafline.llm.simhash import simhash_groups
from sheafline.llm.warc import round_trip


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact dedup of all documents."""
    return exact_dedup(table(spark, sf_dir, "documents"))


#: The mix of op2 and the pipeline: uneven weights by domain and language.
MIX_WEIGHTS = {"domain": {"web": 2, "books": 3, "forums": 1}, "language": {"en": 4, "de": 2, "fr": 2, "es": 2}}


def mix_domain(source: str = "source") -> Column:
    """A domain for each source: the largest is the web, sources ending in an even digit are books."""
    name = F.col(source)
    return F.when(name == "src0", F.lit("web")).when(name.rlike("[02468]$"), F.lit("books")).otherwise(F.lit("forums"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document is taken in a mix of 60 % of all tokens, at most two epochs."""
    return mix(table(spark, sf_dir, "documents"), F.col("tokens") * 0.6, MIX_WEIGHTS, mix_domain(), epochs=2, seed=5)


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs.where(~held_out())))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to WARC archives with revisits, and read back."""
    return round_trip(table(spark, sf_dir, "pages"), least_bytes=0)


def op5_bpe(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """All documents encoded with a public byte-level vocabulary, and decoded again."""
    return encode(table(spark, sf_dir, "documents"), vocabulary or public_tokenizers.path("byte_bpe_50k.json"), ids=False)


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The masked pseudo-likelihood of all documents under a network trained on all of them."""
    return pseudo_likelihood(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash groups of all documents, links at 2 or fewer differing bits."""
    return simhash_groups(table(spark, sf_dir, "documents"), limit=2)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 8 shards that each match the source mixture."""
    return interleave(table(spark, sf_dir, "documents"), shards=8, seed=7)


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one of control strings, formatted and read back."""
    text = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return digests(format_chats(table(spark, sf_dir, "conversations").select(*more.columns).unionByName(more)))


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at cosine 0.9."""
    return near_groups(table(spark, sf_dir, "embeddings"), cosine=0.9)


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest phrases of each language, counted over all documents."""
    return collocations(table(spark, sf_dir, "documents"), least=30, words=4, top=2000, share=80)


def planted(docs: DataFrame) -> DataFrame:
    """doc_id, text, where every tenth document by crc32 of its id goes round a stretch of its words from some word on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = docs.select("doc_id", "text", F.when(h % 10 == 0, F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")).alias("w"), F.floor(h / 10).alias("g"))
    words = words.withColumn("n", F.size("w")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    words = words.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    rest = F.col("n") - F.col("a")
    turns = F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), F.ceil(rest / F.col("p")).cast("int")))
    made = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), F.slice(turns, F.lit(1), rest)), " ")
    return words.select("doc_id", F.when(F.col("n") > 0, made).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of repeated words in all documents, a tenth of them with a run planted."""
    return runs.digests(runs.periodic_runs(planted(table(spark, sf_dir, "documents"))))


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents; a source is an owner, each of its documents a repository."""
    return secret_scan.digests(secret_scan.secrets(table(spark, sf_dir, "documents"), repo=F.col("doc_id"), owner=F.col("source")))


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_mixing": op2_mixing,
    "op3_langid": op3_langid,
    "op4_warc": op4_warc,
    "op5_bpe": op5_bpe,
    "op6_lm_score": op6_lm_score,
    "op7_simhash": op7_simhash,
    "op8_sharding": op8_sharding,
    "op9_chat": op9_chat,
    "op10_embeddings": op10_embeddings,
    "op11_phrases": op11_phrases,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_secrets": op13_secrets,
}

SQL = {
    "op1_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, length(coalesce(text, '')) AS chars,
                   regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
            FROM documents)
        SELECT doc_id, keep_id, group_size, keep_id = doc_id AS kept, text_sha256
        FROM (SELECT doc_id, sha256(norm) AS text_sha256,
                     first_value(doc_id) OVER (PARTITION BY norm ORDER BY chars DESC, doc_id) AS keep_id,
                     count(*) OVER (PARTITION BY norm) AS group_size FROM d)""",
    "op2_mixing": r"""
        WITH d AS (
            SELECT doc_id, CASE WHEN source = 'src0' THEN 'web' WHEN regexp_matches(source, '[02468]$') THEN 'books' ELSE 'forums' END AS domain,
                   coalesce(lang, '(null)') AS language, coalesce(source, '(null)') AS source,
                   len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS tokens FROM documents),
        leaf AS (
            SELECT domain, language, source, sum(tokens)::BIGINT AS tokens, 2 * sum(tokens)::BIGINT AS holds, 1.0::DOUBLE AS weight,
                   (CASE domain WHEN 'web' THEN 2 WHEN 'books' THEN 3 ELSE 1 END)::DOUBLE AS w_domain,
                   (CASE language WHEN 'en' THEN 4 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 WHEN 'es' THEN 2 ELSE 1 END)::DOUBLE AS w_language
            FROM d GROUP BY ALL),
        root AS (SELECT least(floor(sum(tokens) * 0.6::DOUBLE)::BIGINT, sum(holds))::BIGINT AS total FROM leaf),
        n1 AS (SELECT domain, w_domain AS weight, sum(holds)::BIGINT AS holds, (SELECT total FROM root) AS total FROM leaf GROUP BY ALL),
        l1 AS (SELECT *, (total - coalesce(sum(holds) OVER b, 0)::BIGINT) / sum(weight) OVER a AS level, holds / weight AS ratio FROM n1
               WINDOW b AS (ORDER BY holds / weight, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                      a AS (ORDER BY holds / weight, domain ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
        m1 AS (SELECT *, max(level) FILTER (ratio > level) OVER () AS cut FROM l1),
        s1 AS (SELECT domain, floor((CASE WHEN cut IS NULL OR ratio <= cut THEN holds::DOUBLE ELSE weight * cut END) + 1e-6)::BIGINT AS total FROM m1),
        n2 AS (SELECT domain, language, w_language AS weight, sum(holds)::BIGINT AS holds, any_value(total) AS total FROM leaf JOIN s1 USING (domain) GROUP BY ALL),
        l2 AS (SELECT *, (total - coalesce(sum(holds) OVER b, 0)::BIGINT) / sum(weight) OVER a AS level, holds / weight AS ratio FROM n2
               WINDOW b AS (PARTITION BY domain ORDER BY holds / weight, language ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                      a AS (PARTITION BY domain ORDER BY holds / weight, language ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
        m2 AS (SELECT *, max(level) FILTER (ratio > level) OVER (PARTITION BY domain) AS cut FROM l2),
        s2 AS (SELECT domain, language, floor((CASE WHEN cut IS NULL OR ratio <= cut THEN holds::DOUBLE ELSE weight * cut END) + 1e-6)::BIGINT AS total FROM m2),
        n3 AS (SELECT domain, language, source, tokens, weight, holds, total FROM leaf JOIN s2 USING (domain, language)),
        l3 AS (SELECT *, (total - coalesce(sum(holds) OVER b, 0)::BIGINT) / sum(weight) OVER a AS level, holds / weight AS ratio FROM n3
               WINDOW b AS (PARTITION BY domain, language ORDER BY holds / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                      a AS (PARTITION BY domain, language ORDER BY holds / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
        m3 AS (SELECT *, max(level) FILTER (ratio > level) OVER (PARTITION BY domain, language) AS cut FROM l3),
        s3 AS (SELECT domain, language, source, tokens AS leaf_tokens,
                      floor((CASE WHEN cut IS NULL OR ratio <= cut THEN holds::DOUBLE ELSE weight * cut END) + 1e-6)::BIGINT AS budget FROM m3),
        e AS (SELECT *, CASE WHEN leaf_tokens > 0 THEN budget // leaf_tokens ELSE 0 END AS whole FROM s3),
        r AS (SELECT d.*, e.budget, e.whole, e.budget - e.whole * e.leaf_tokens AS rest,
                     md5('5:' || (e.whole + 1) || ':' || doc_id) AS mix FROM d JOIN e USING (domain, language, source))
        SELECT doc_id, domain, language, source, tokens, budget,
               (CASE WHEN tokens = 0 THEN 0 ELSE whole + (sum(tokens) OVER (
                   PARTITION BY domain, language, source ORDER BY mix, doc_id ROWS UNBOUNDED PRECEDING) <= rest)::INT END)::BIGINT AS copies
        FROM r""",
    "op4_warc": r"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (
            SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS h,
                   min(page_id) OVER (PARTITION BY html) AS first FROM p)
        SELECT page_id, payload_bytes,
               array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   (((('0x' || substr(h, (1 + 5 * (i // 4))::INT, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1)::INT, 1)), '') AS payload_digest,
               CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN first <> page_id THEN first END AS refers_to
        FROM d""",
    "op8_sharding": r"""
        WITH t AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
        b AS (SELECT doc_id, CASE WHEN source IS NULL THEN '-' ELSE '=' || source END AS stratum, md5('7:' || coalesce(doc_id::VARCHAR, '-')) AS mix,
                     list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS v FROM documents),
        d AS (SELECT doc_id, stratum, mix, len(v) + 1 AS size, xor(list_reduce(list_prepend(4294967295, v), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32 FROM b, t),
        r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY mix, doc_id NULLS FIRST, text_crc32, size) - 1 AS rank, count(*) OVER (PARTITION BY stratum) AS n, count(*) OVER () AS total FROM d),
        f AS (SELECT *, (rank + (('0x' || substr(md5('7/' || stratum), 1, 8))::BIGINT::DOUBLE + 0.5) / 4294967296) / n AS fraction FROM r),
        p AS (SELECT *, row_number() OVER (ORDER BY fraction, stratum, mix, doc_id NULLS FIRST, text_crc32, size) - 1 AS place FROM f)
        SELECT doc_id, size, text_crc32, 'rows' AS law, (place * 8 // total)::INT AS shard, place - ceil((place * 8 // total) * total / 8)::BIGINT AS slot, NULL::INT AS grown_shard FROM p""",
    "op9_chat": r"""
        WITH c AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
        t AS (
            SELECT *, CASE role WHEN 'system' THEN 'System' WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant' ELSE '@' || role END AS label,
                   lag(role, 1, '^') OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before,
                   length(text) - length(replace(text, '\', ''))
                   + coalesce(list_sum(list_transform(regexp_extract_all(text, '#{3,}'), lambda x: length(x) - 2)), 0)
                   + (length(text) - length(replace(text, '</turn>', ''))) // 7 AS marks FROM c)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
               sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
               sum(4 + length(label) + 2 + length(text) + marks + 9)::BIGINT AS formatted_chars,
               bool_and(before || '>' || role IN ('^>system', '^>user', 'system>user', 'user>assistant', 'assistant>user')) AS valid
        FROM t GROUP BY conv_id""",
    "op10_embeddings": r"""
        WITH RECURSIVE v AS (
            SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
              AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
        l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.9),
        r AS (SELECT vec_id AS n, vec_id AS c FROM embeddings UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.n),
        c AS (SELECT n AS vec_id, min(c) AS component_id FROM r GROUP BY n)
        SELECT c.vec_id, (SELECT count(*) FROM l WHERE l.a = c.vec_id) AS n_links, component_id, c.vec_id = component_id AS kept FROM c""",
    "op11_phrases": r"""
        WITH p AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
        n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
        g AS (SELECT lang, unnest(flatten(list_transform(range(1, 5), lambda s: list_transform(range(1, len(w) - s + 2), lambda i: w[i:i + s - 1])))) AS g FROM w WHERE len(w) > 0),
        f AS (SELECT lang, g, len(g) AS size, count(*) AS f FROM g GROUP BY ALL HAVING f >= 30),
        c AS (SELECT lang, g, f AS a, size, unnest(range(1, size)) AS k FROM f WHERE size > 1),
        s AS (SELECT c.lang, c.g, c.a, c.k, x.f AS l, y.f AS r, 2000000 * c.a::HUGEINT // (x.f + y.f) AS score
              FROM c JOIN f x ON x.lang = c.lang AND x.g = c.g[1:c.k] JOIN f y ON y.lang = c.lang AND y.g = c.g[c.k + 1:c.size]),
        b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
        i AS (SELECT lang, f, g, size, unnest(range(2, size)) AS width FROM f WHERE size > 2),
        j AS (SELECT lang, f, unnest(list_transform(range(1, size - width + 2), lambda i: g[i:i + width - 1])) AS g FROM i),
        o AS (SELECT lang, g, max(f) AS longer FROM j GROUP BY ALL),
        t AS (SELECT b.lang, array_to_string(b.g, ' ') AS phrase, a, l, r, score::BIGINT AS score FROM b LEFT JOIN o ON o.lang = b.lang AND o.g = b.g
              WHERE longer IS NULL OR 100 * longer::HUGEINT < 80 * a::HUGEINT)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
        FROM t JOIN n USING (lang) QUALIFY rank <= 2000""",
    "op12_periodic_runs": r"""
        WITH t AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
        h AS (SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                     xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM documents, t),
        g AS (SELECT d, doc_id, w, len(w) AS n, h, h // 10 AS g, CASE WHEN len(w) > 0 THEN h // 10 % len(w) END AS a FROM h),
        p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM g),
        x AS (SELECT d, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE w END AS w FROM p),
        u AS (SELECT d, n, unnest(w) AS word, unnest(range(n)) AS i FROM x),
        b AS (SELECT d, n, i, word, lead(word) OVER (PARTITION BY d ORDER BY i) AS next FROM u),
        e AS (SELECT y.d, y.i, z.i - y.i AS q FROM b y JOIN b z ON y.d = z.d AND y.word = z.word AND y.next = z.next AND z.i > y.i AND 3 * (z.i - y.i) <= y.n),
        r AS (SELECT d, q, min(i) AS start, count(*) + 1 + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY d, q ORDER BY i) AS k FROM e)
              GROUP BY d, q, k HAVING length >= greatest(24, 3 * q)),
        f AS (SELECT d, start, length, min(q) AS period FROM r GROUP BY ALL),
        o AS (SELECT d, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
                     first({'s': start, 'l': length, 'p': period} ORDER BY length / period DESC, start, period) AS best FROM f GROUP BY d),
        k AS (SELECT d, string_agg(word, ' ' ORDER BY i) AS kept FROM u
              WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.d = u.d AND u.i >= f.start + f.period AND u.i < f.start + f.length) GROUP BY d)
        SELECT x.doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.l AS length, best.p AS period, best.l * 1000 // best.p AS exponent_milli,
               sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
        FROM x LEFT JOIN o USING (d) LEFT JOIN k USING (d)""",
    "op13_secrets": r"""
        WITH k AS (SELECT * FROM (VALUES
                ('assign', 1, 8, '(?s)(.*?)((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?)([A-Za-z0-9+/_.=-]+)'),
                ('access', 2, 16, '(?s)(.*?)()(AKIA[A-Z0-9]+)'), ('hex', 3, 32, '(?s)(.*?)()([0-9a-f]+)'), ('live', 4, 20, '(?s)(.*?)()([A-Za-z0-9+/_=-]+)')) v(kind, ord, least, pat)),
        d AS (SELECT row_number() OVER () AS d, doc_id, coalesce('=' || source, '-') AS owner, coalesce(text, '') AS text FROM documents),
        m AS (SELECT d, doc_id, owner, kind, ord, least, regexp_extract_all(text, pat, 1) AS b, regexp_extract_all(text, pat, 2) AS k, regexp_extract_all(text, pat, 3) AS v FROM d, k),
        u AS (SELECT d, doc_id, owner, kind, ord, least, unnest(b) AS b, unnest(k) AS k, unnest(v) AS v, unnest(range(len(v))) AS i FROM m),
        e AS (SELECT *, sum(length(b) + length(k) + length(v)) OVER (PARTITION BY d, ord ORDER BY i)::BIGINT AS "end" FROM u),
        s AS (SELECT d, doc_id, owner, kind, ord, v, "end" - length(k) - length(v) AS start, "end",
                     len(list_distinct(string_split(v, ''))) >= 10 AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AS random FROM e WHERE length(v) >= least),
        c AS (SELECT * FROM s WHERE ord < 4 UNION ALL
              SELECT * FROM s WHERE ord = 4 AND random AND NOT EXISTS (SELECT 1 FROM s o WHERE o.d = s.d AND o.ord < 4 AND o.start < s."end" AND s.start < o."end")),
        o AS (SELECT v, count(DISTINCT owner) >= 3 OR count(DISTINCT coalesce(doc_id::VARCHAR, '-')) >= 10 AS copied FROM c GROUP BY v),
        j AS (SELECT c.*, kind || ':' || start || ':' || "end" AS span, CASE WHEN copied THEN 'example' WHEN random THEN 'live' ELSE 'weak' END AS verdict FROM c JOIN o USING (v)),
        a AS (SELECT d, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
                     string_agg(span, ',' ORDER BY start, ord) FILTER (ord < 4) AS base, string_agg(span, ',' ORDER BY start, ord) AS spans,
                     count(*) FILTER (verdict = 'live') AS n_live, count(*) FILTER (verdict = 'example') AS n_example
              FROM j WHERE ord < 4 OR verdict = 'live' GROUP BY d)
        SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
               coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
        FROM d LEFT JOIN a USING (d)""",
}
