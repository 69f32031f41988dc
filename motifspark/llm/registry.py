"""The queries of this subpackage and the SQL they are checked against."""

from motifspark.llm import fm_decontaminate as fm
from motifspark.llm import (
    byte_bpe,
    fill_middle,
    hilbert_shards,
    importance_resampling,
    language_id,
    license_scan,
    media_columns,
    secret_scan,
    sentencepiece_array,
    spelling_variants,
    warc_zip,
)
from motifspark.llm import ngram_jaccard as jaccard
from motifspark.llm.text import read

QUERIES = {}
ORACLES = {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i+4], ' ') END AS sh
  FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 4, 1))) AS i FROM w WHERE len(ws) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), classes AS (
  SELECT doc_id, n, min(doc_id) OVER (PARTITION BY n, h) AS class
  FROM (SELECT doc_id, count(*) AS n, md5(string_agg(sh, chr(10) ORDER BY sh)) AS h FROM s GROUP BY doc_id)
), r AS (SELECT doc_id, sh FROM s SEMI JOIN (SELECT DISTINCT class FROM classes) c ON s.doc_id = c.class
), shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM r x JOIN r y ON x.sh = y.sh AND x.doc_id < y.doc_id GROUP BY 1, 2
), e AS (
  SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * k >= 75 * (p.n + q.n - k)
), ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e
), reach AS (SELECT class AS a, class AS b FROM classes UNION SELECT reach.a, ways.b FROM reach JOIN ways ON ways.a = reach.b
), roots AS (SELECT a AS class, min(b) AS root FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(c.n, 0) AS n_shingles, coalesce(c.class, d.doc_id) AS class_id, coalesce(root, d.doc_id) AS component_id
FROM documents d LEFT JOIN classes c USING (doc_id) LEFT JOIN roots USING (class)
"""


@query("op1_ngram_jaccard", OP1_SQL)
def op1(spark, sf):
    return jaccard.components_of(read(spark, sf, "documents"))


WORDS7 = rf"regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP7_SQL = f"""
WITH d AS (SELECT doc_id, {WORDS7} AS ws FROM documents
), b AS (SELECT item_id, {WORDS7} AS ws FROM benchmark
), p AS (
  SELECT item_id, k, array_to_string(ws[i:i+k-1], ' ') AS ph
  FROM (SELECT item_id, ws, least(len(ws), 10) AS k, unnest(generate_series(1, greatest(len(ws) - 9, 1))) AS i FROM b WHERE len(ws) > 0)
), g AS (
  SELECT doc_id, i, k, array_to_string(ws[i:i+k-1], ' ') AS ph
  FROM (SELECT doc_id, ws, k, unnest(generate_series(1, len(ws) - k + 1)) AS i FROM d, (SELECT DISTINCT k FROM p) WHERE len(ws) >= k)
), o AS (SELECT DISTINCT doc_id, i, g.k, item_id FROM g JOIN p ON g.k = p.k AND g.ph = p.ph
), h AS (
  SELECT doc_id, count(DISTINCT w) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS w FROM o) GROUP BY doc_id
), t AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS s
  FROM (SELECT DISTINCT doc_id, item_id::varchar AS item FROM o) GROUP BY doc_id
)
SELECT doc_id, coalesce(len(ws), 0) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""


@query("op7_fm_decontaminate", OP7_SQL)
def op7(spark, sf):
    return fm.digest(fm.decontaminate(read(spark, sf, "documents"), read(spark, sf, "benchmark")))


def canonical_sql(text):
    line = f"concat(' ', trim(regexp_replace(regexp_replace(lower(l), '{license_scan.COPYRIGHT}', ''), '{license_scan.PUNCTUATION}', ' ', 'g')), ' ')"
    for one, other in license_scan.SPELLINGS:
        line = f"replace({line}, ' {one} ', ' {other} ')"
    return f"list_filter(list_transform(string_split(coalesce({text}, ''), chr(10)), lambda l: trim({line})), lambda l: l <> '')"


LICENSES_SQL = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, _, text in license_scan.KNOWN)

OP2_SQL = f"""
WITH k AS (
  SELECT sha256(array_to_string({canonical_sql("text")}, ' ')) AS digest, min(license) AS license
  FROM (VALUES {LICENSES_SQL}) AS v(license, text) GROUP BY 1
), d AS (SELECT doc_id, {canonical_sql("text")} AS ls FROM documents
), n AS (
  SELECT doc_id, count(*) AS n_notices, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses
  FROM (SELECT doc_id, unnest(ls) AS l FROM d) JOIN k ON k.digest = sha256(l) GROUP BY doc_id
)
SELECT d.doc_id, sha256(array_to_string(ls, ' ')) AS digest, license, coalesce(n_notices, 0) AS n_notices, coalesce(licenses, '') AS licenses
FROM d LEFT JOIN k ON len(ls) > 0 AND k.digest = sha256(array_to_string(ls, ' ')) LEFT JOIN n USING (doc_id)
"""


@query("op2_license_scan", OP2_SQL)
def op2(spark, sf):
    return license_scan.scan(read(spark, sf, "documents"))


@query("op4_language_id")
def op4(spark, sf):
    return language_id.identify(read(spark, sf, "documents"))


@query("op8_hilbert_shards")
def op8(spark, sf):
    return hilbert_shards.shard(read(spark, sf, "documents"))


OP10_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha256(coalesce(html, '')) AS h FROM pages
), f AS (SELECT *, CASE WHEN octet_length(b) >= 100 THEN min(page_id) OVER (PARTITION BY h) END AS first FROM p)
SELECT page_id, octet_length(b) AS payload_bytes, h AS payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM f
"""


@query("op10_warc_zip", OP10_SQL)
def op10(spark, sf):
    return warc_zip.round_trip(read(spark, sf, "pages"))


@query("op6_media_columns")
def op6(spark, sf):
    return media_columns.documents_as_media(read(spark, sf, "documents"))


@query("op5_secret_scan")
def op5(spark, sf):
    docs = read(spark, sf, "documents")
    return secret_scan.digest(secret_scan.scan(docs, secret_scan.train(docs)))


@query("op9_sentencepiece_array")
def op9(spark, sf):
    return sentencepiece_array.encode(read(spark, sf, "documents"))


@query("op3_importance_resampling")
def op3(spark, sf):
    return importance_resampling.sample(read(spark, sf, "documents"), read(spark, sf, "labels"))


@query("op11_byte_bpe")
def op11(spark, sf):
    return byte_bpe.digest(byte_bpe.encode(read(spark, sf, "documents")))


DRAWS = ", ".join(f"('0x' || substr(hx, {8 * k + 1}, 8))::BIGINT AS h{k + 1}" for k in range(4))

OP12_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS ls, sha256('7:' || coalesce(doc_id::varchar, '')) AS hx
  FROM documents
), h AS (SELECT *, len(ls) AS n, {DRAWS} FROM d
), c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM h
), p AS (
  SELECT doc_id, t, n, array_to_string(ls[:a], '') AS pre, array_to_string(ls[a + 1:b], '') AS mid, array_to_string(ls[b + 1:], '') AS suf,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
         WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""


@query("op12_fill_middle", OP12_SQL)
def op12(spark, sf):
    return fill_middle.digest(fill_middle.transform(read(spark, sf, "documents")))


OP13_SQL = rf"""
WITH RECURSIVE tab AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS crc
), r AS (
  SELECT doc_id, run, count(*) AS k
  FROM (SELECT doc_id, unnest(regexp_extract_all({LOWER}, '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents) GROUP BY ALL
), b AS (
  SELECT run, k, flatten(list_transform(string_split(coalesce(doc_id::varchar, '') || ':' || run, ''),
    lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)] END)) AS bytes FROM r
), h AS (
  SELECT run, k, xor(4294967295, list_reduce([4294967295] || bytes, lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255) + 1]))) AS h FROM b, tab
), s AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, k FROM h
), w AS (SELECT word, sum(k)::BIGINT AS n FROM s WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3
), cut AS (
  SELECT DISTINCT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w)
), edge AS (
  SELECT a.word, b.word AS near FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word FROM cut a JOIN w b ON b.word = a.rest
  UNION SELECT b.word, a.word FROM cut a JOIN w b ON b.word = a.rest
), e AS (
  SELECT e.word, near, x.n AS near_n, row_number() OVER (PARTITION BY e.word ORDER BY x.n DESC, encode(near)) AS rank, count(*) OVER (PARTITION BY e.word) AS n_near
  FROM edge e JOIN w x ON x.word = e.near
), f AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * w.n THEN near END AS form, CASE WHEN near_n >= 2 * w.n THEN near_n END AS form_n
  FROM w LEFT JOIN e ON e.word = w.word AND rank = 1
), way AS (SELECT word, word AS last FROM f UNION ALL SELECT way.word, f.form FROM way JOIN f ON f.word = way.last WHERE f.form IS NOT NULL
)
SELECT f.word, n, n_near, form, form_n, last AS root FROM f JOIN way ON way.word = f.word JOIN (SELECT word FROM f WHERE form IS NULL) l ON l.word = way.last
"""


@query("op13_spelling_variants", OP13_SQL)
def op13(spark, sf):
    return spelling_variants.group(read(spark, sf, "documents"))
