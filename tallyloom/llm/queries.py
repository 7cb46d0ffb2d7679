"""The registered queries of the text operators, with their production parameters, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import classifier, decontaminate, jaccard, licenses, mixing, quality_rules, records, spelling, substring, suffix_arrays, token_counts, urls, vector_codes

BYTE_BPE = "byte_bpe_50k.json"
END_OF_TEXT = 50256

URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]

DOMAIN = """case when source in ('src0','src1','src2','src3','src4') then 'web'
 when source in ('src5','src6','src7','src8','src9') then 'books'
 when source in ('src10','src11','src12','src13','src14') then 'code'
 else 'reference' end"""
DOMAIN_WEIGHTS = {"web": 40, "books": 30, "code": 10, "reference": 20}
LANG_WEIGHTS = {"en": 50, "de": 20, "fr": 20, "es": 10}
TREE = mixing.Tree([("domain", DOMAIN, DOMAIN_WEIGHTS, 10), ("lang", "lang", LANG_WEIGHTS, 5), ("source", "source", {}, 1)])


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), END_OF_TEXT)
    return counts.select("doc_id", "n_tokens", "ended")


def op2_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=10).drop("items")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    judged = quality_rules.judge(docs.select("doc_id", "lang", "text"), quality_rules.references(docs))
    return judged.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(_table(spark, sf_dir, "documents"), window=20).drop("kept")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op6_url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return urls.judge(pages, urls.rules_table(spark, URL_RULES), urls.page_edges(pages)).drop("component_rule")


def op7_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.token_records(_table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE)).select("doc_id", "start", "n_tokens", "ids_crc32")


def op8_jaccard_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_groups(_table(spark, sf_dir, "documents"), k=3, threshold=Fraction(9, 10))


def op9_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"), TREE).select("row.doc_id", "domain", "lang", "source", "n_tokens", "epoch")


def op11_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.groups(_table(spark, sf_dir, "documents"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_arrays.remove_repeated_bytes(_table(spark, sf_dir, "documents"), width=400).drop("spans", "kept")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.encode(_table(spark, sf_dir, "embeddings")).drop("label", "n_scanned")


_SPACE = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s : s + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT DISTINCT doc_id, n, s, g FROM dw WHERE (n, g) IN (SELECT n, g FROM bw)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + n - 1)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT hit.doc_id, item_id::VARCHAR AS i FROM hit JOIN bw USING (n, g)) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
 sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_RULES = quality_rules.Rules()
_CLASS_SQL = {
    "c0": "len(regexp_extract_all(t, '[a-z]'))", "c1": "len(regexp_extract_all(t, '[A-Z]'))", "c2": "len(regexp_extract_all(t, '[0-9]'))",
    "c3": r"len(regexp_extract_all(t, '[\x20\x09-\x0D]'))", "c4": "len(regexp_extract_all(t, '[#*$%&|<>]'))", "c6": r"len(regexp_extract_all(t, '[^\x00-\x7F]'))",
}
OP3_SQL = rf"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_SPACE}') AS w,
  regexp_extract_all({_LOWER}, '{_SPACE}') AS lw FROM documents),
c AS (SELECT *, length(t) - c0 - c1 - c2 - c3 - c4 - c6 AS c5 FROM (SELECT *, {', '.join(f'{e} AS {n}' for n, e in _CLASS_SQL.items())} FROM t)),
base AS (SELECT doc_id, lang, w, lw, [c0, c1, c2, c3, c4, c5, c6] AS cls, len(w)::BIGINT AS n_words,
  (length(t) - c3)::BIGINT AS word_chars, c4::BIGINT AS n_symbols,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_SPACE}')) AS lines FROM c),
grams AS (SELECT doc_id, s, w[s] || ' ' || w[s + 1] || ' ' || w[s + 2] AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS s FROM base)),
twice AS (SELECT doc_id, s FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([s, s + 1, s + 2]) AS p FROM twice) GROUP BY doc_id),
m AS (SELECT base.*, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words FROM base LEFT JOIN rep USING (doc_id)),
lw AS (SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(lw) AS word FROM base) GROUP BY lang, word),
total AS (SELECT lang, sum(n) AS of_words FROM lw GROUP BY lang),
top AS (SELECT lang, word, n FROM lw QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) <= {_RULES.common_words}),
ref_class AS (SELECT lang, k, sum(v) AS q FROM (SELECT lang, unnest(cls) AS v, unnest(range(7)) AS k FROM m) GROUP BY lang, k),
doc_class AS (SELECT doc_id, lang, unnest(cls) AS v, unnest(range(7)) AS k FROM m),
pq AS (SELECT doc_id, v / sum(v) OVER (PARTITION BY doc_id) AS p, q / sum(q) OVER (PARTITION BY doc_id) AS q, sum(v) OVER (PARTITION BY doc_id) AS size
  FROM doc_class JOIN ref_class USING (lang, k)),
class_js AS (SELECT doc_id, any_value(size) AS size, sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2)) AS js
  FROM pq WHERE size > 0 GROUP BY doc_id),
seen AS (SELECT doc_id, word, count(*) AS v FROM (SELECT doc_id, unnest(lw) AS word FROM base) GROUP BY doc_id, word),
common AS (SELECT m.doc_id, top.word, coalesce(seen.v, 0) AS v, top.n AS q, m.n_words, total.of_words
  FROM m JOIN top USING (lang) JOIN total USING (lang) LEFT JOIN seen ON seen.doc_id = m.doc_id AND seen.word = top.word WHERE m.n_words > 0),
both_ AS (SELECT doc_id, v / n_words AS p, q / of_words AS q FROM common
  UNION ALL SELECT doc_id, (any_value(n_words) - sum(v)) / any_value(n_words), (any_value(of_words) - sum(q)) / any_value(of_words) FROM common GROUP BY doc_id),
word_js AS (SELECT doc_id, sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2)) AS js FROM both_ GROUP BY doc_id),
v AS (SELECT m.*, n_words < {_RULES.min_words} OR 100 * n_repeat_words > {_RULES.max_repeat_percent} * n_words AS base_failed,
  coalesce(of_words, 0) >= {_RULES.reference_min_words} AND (
   coalesce(class_js.size >= {_RULES.class_min_chars} AND class_js.js > {_RULES.class_limit}, false)
   OR coalesce(n_words >= {_RULES.word_from} AND word_js.js > {_RULES.word_limit} * greatest(1, {_RULES.word_min_words} / greatest(1, n_words)) ** 0.25, false)) AS far
  FROM m LEFT JOIN total USING (lang) LEFT JOIN class_js USING (doc_id) LEFT JOIN word_js USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT far AS kept FROM v
"""

OP4_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_SPACE}') AS w FROM documents),
win AS (SELECT doc_id, s, array_to_string(w[s : s + 19], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 19)) AS s FROM d)),
later AS (SELECT doc_id, s FROM win QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, s) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(s, s + 19)) AS p FROM later),
words AS (SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS p FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

_RULE_ROWS = ", ".join(f"('{a}', '{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for a, r in URL_RULES)
_UP, _DOWN = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _attribute_sql(tag: str, name: str) -> str:
    forms = ", ".join(f"nullif(regexp_extract({tag}, '(?is)\\s{name}\\s*=\\s*{form}', 1), '')" for form in ('"([^"]*)"', "''([^'']*)''", "([^\\s\"''>]+)"))
    return f"trim(regexp_replace(coalesce({forms}, ''), '(?i)&(amp|#38|#x26);', '&', 'g'))"


def _normal_sql(url: str) -> str:
    scheme = f"regexp_extract({url}, '^([^/?#:]*://)', 1)"
    rest = f"regexp_replace(substr({url}, length({scheme}) + 1), '(?s)#.*$', '')"
    host = f"regexp_extract({rest}, '^([^/?]*)', 1)"
    return f"CASE WHEN length({scheme}) = 0 THEN {url} ELSE translate({scheme} || {host}, '{_UP}', '{_DOWN}') || substr({rest}, length({host}) + 1) END"


OP6_SQL = rf"""
WITH RECURSIVE p AS (SELECT page_id, {_normal_sql('url')} AS url, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
tags AS (SELECT url, unnest([
  {_attribute_sql("list_filter(regexp_extract_all(html, '(?is)<link[ \t\n\r\f][^>]*>'), lambda t: list_contains(string_split_regex(lower(" + _attribute_sql('t', 'rel') + r"), '\s+'), 'canonical'))[1]", 'href')},
  trim(regexp_extract({_attribute_sql("list_filter(regexp_extract_all(html, '(?is)<meta[ \t\n\r\f][^>]*>'), lambda t: lower(" + _attribute_sql('t', 'http-equiv') + ") = 'refresh')[1]", 'content')},
   '(?is)[;,]\s*url\s*=\s*["'']?([^"'']*)', 1))]) AS link FROM p WHERE url IS NOT NULL),
linked AS (SELECT url, regexp_replace(link, '(?s)#.*$', '') AS link, regexp_extract(url, '^([^/?#:]*://[^/?#]*)', 1) AS site, regexp_extract(url, '^([^/?#:]*:)//', 1) AS scheme,
  regexp_extract(url, '^[^/?#:]*://[^/?#]*([^?#]*)', 1) AS path FROM tags WHERE link <> ''),
stepped AS (SELECT *, string_split(regexp_replace(CASE WHEN starts_with(link, '/') THEN regexp_extract(link, '^([^?]*)', 1) ELSE regexp_extract(path, '^(.*/)', 1) || regexp_extract(link, '^([^?]*)', 1) END, '^/', ''), '/') AS s
  FROM linked WHERE link <> ''),
taken AS (SELECT *, list_filter(range(1, len(s) + 1), lambda i: s[i] NOT IN ('.', '..') AND NOT coalesce(list_bool_or(list_transform(range(i + 1, len(s) + 1),
   lambda j: len(list_filter(s[i + 1 : j], lambda x: x = '..')) > len(list_filter(s[i + 1 : j], lambda x: x NOT IN ('.', '..'))))), false)) AS kept FROM stepped),
e AS (SELECT url AS u, {_normal_sql('v')} AS v FROM (SELECT url, CASE WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN link WHEN site = '' THEN NULL
  WHEN starts_with(link, '//') THEN scheme || link WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL WHEN starts_with(link, '?') THEN site || path || link
  ELSE site || '/' || array_to_string(list_transform(kept, lambda i: s[i]), '/') || CASE WHEN s[-1] IN ('.', '..') AND len(kept) > 0 THEN '/' ELSE '' END || regexp_extract(link, '(\?.*)$', 1) END AS v FROM taken) WHERE v IS NOT NULL),
both_ AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
reach AS (SELECT u, v FROM both_ UNION SELECT reach.u, both_.v FROM reach JOIN both_ ON reach.v = both_.u),
parts AS (SELECT url, coalesce(m, url) AS part FROM (SELECT DISTINCT url FROM p WHERE url IS NOT NULL UNION SELECT u FROM both_)
  LEFT JOIN (SELECT u AS url, least(u, min(v)) AS m FROM reach GROUP BY u) USING (url)),
urls AS (SELECT url, part, coalesce(CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END, '') AS rest FROM parts),
h AS (SELECT url, part, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UP}', '{_DOWN}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM urls),
rules AS (SELECT * FROM (VALUES {_RULE_ROWS}) r(action, rule, rule_host, rule_path)),
fits AS (SELECT url, rule, action FROM h JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  QUALIFY row_number() OVER (PARTITION BY url ORDER BY length(rule) DESC, action, rule) = 1),
inherit AS (SELECT part, min(action) AS action FROM h JOIN fits USING (url) WHERE part IN (SELECT part FROM h GROUP BY part HAVING count(*) > 1) GROUP BY part),
v AS (SELECT h.url, fits.rule, coalesce(fits.action, inherit.action, 'allow') AS verdict FROM h LEFT JOIN fits USING (url) LEFT JOIN inherit USING (part))
SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), '{_UP}', '{_DOWN}') AS host,
 regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN v USING (url)
"""

OP8_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_SPACE}') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[s : s + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 2))) AS s FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
link AS (SELECT a.doc_id AS u, b.doc_id AS v FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 90 * (na.n + nb.n - count(*))),
reach AS (SELECT u, v FROM link UNION SELECT reach.u, link.v FROM reach JOIN link ON reach.v = link.u)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(min(reach.v), d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN reach ON reach.u = d.doc_id GROUP BY d.doc_id, n.n
"""

OP11_SQL = f"""
WITH RECURSIVE bits AS (SELECT i, i::BIGINT AS v, 0 AS step FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, step + 1 FROM bits WHERE step < 8),
crc AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE step = 8),
runs AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[a-zÀ-ÿ]+')) AS w FROM documents),
d AS (SELECT doc_id, w, count(*) AS m FROM runs GROUP BY doc_id, w),
b AS (SELECT w, m, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || w, ''),
  lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT] ELSE [195::BIGINT, (ord(c) - 64)::BIGINT] END)) AS bytes FROM d),
h AS (SELECT w, m, xor(list_reduce(bytes, lambda r, c: xor(t[xor(r, c) % 256 + 1], r >> 8), 4294967295::BIGINT), 4294967295) AS h FROM b, crc),
slipped AS (SELECT CASE WHEN h % 199 = 0 THEN left(w, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word, m FROM h),
words AS (SELECT word, sum(m)::BIGINT AS n FROM slipped WHERE length(word) >= 6 GROUP BY word HAVING sum(m) >= 5),
less AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(generate_series(1, length(word)))::INT AS i FROM words)),
near AS (SELECT a.word, b.word AS other FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT less.word, words.word FROM less JOIN words ON less.rest = words.word UNION SELECT words.word, less.word FROM less JOIN words ON less.rest = words.word),
top AS (SELECT near.word, other, o.n AS other_n, count(*) OVER (PARTITION BY near.word) AS n_near FROM near JOIN words o ON o.word = near.other
  QUALIFY row_number() OVER (PARTITION BY near.word ORDER BY o.n DESC, other) = 1),
known AS (SELECT words.word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN other_n >= 5 * n THEN other END AS form, CASE WHEN other_n >= 5 * n THEN other_n END AS form_n FROM words LEFT JOIN top USING (word)),
walk AS (SELECT word, word AS stop, 0 AS step FROM known UNION ALL SELECT walk.word, form, step + 1 FROM walk JOIN known ON known.word = walk.stop WHERE form IS NOT NULL),
root AS (SELECT word, arg_max(stop, step) AS root FROM walk GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM known JOIN root USING (word)
"""

OP12_SQL = """
WITH d AS (SELECT row_number() OVER () AS k, doc_id, encode(coalesce(text, '')) AS b FROM documents),
win AS (SELECT k, s, md5(array_slice(b, s, s + 399)) AS g FROM (SELECT k, b, unnest(generate_series(1, octet_length(b) - 399)) AS s FROM d)),
hit AS (SELECT k, s FROM win QUALIFY count(*) OVER (PARTITION BY g) > 1),
marked AS (SELECT k, s, coalesce(s > lag(s) OVER (PARTITION BY k ORDER BY s) + 400, true)::INT AS new FROM hit),
numbered AS (SELECT k, s, sum(new) OVER (PARTITION BY k ORDER BY s) AS run FROM marked),
gone AS (SELECT k, run, min(s) AS a, max(s) + 400 AS e FROM numbered GROUP BY k, run),
edges AS (SELECT k, coalesce(lag(e) OVER (PARTITION BY k ORDER BY a), 1) AS first, a AS until FROM gone
  UNION ALL SELECT d.k, coalesce(max(e), 1), any_value(octet_length(b)) + 1 FROM d LEFT JOIN gone ON gone.k = d.k GROUP BY d.k),
kept AS (SELECT k, string_agg(hex(array_slice(b, first, until - 1)), '' ORDER BY first) AS left_ FROM edges JOIN d USING (k) WHERE first < until GROUP BY k)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, (octet_length(b) - length(coalesce(left_, '')) // 2)::BIGINT AS n_removed,
 (SELECT count(*) FROM gone WHERE gone.k = d.k)::BIGINT AS n_spans, sha256(unhex(coalesce(left_, ''))) AS kept_sha256 FROM d LEFT JOIN kept USING (k)
"""


def _codes_sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Every assignment as a scan of all entries, every update as sums by entry and component, one step after another."""
    near = "arg_min(e, {'d': list_inner_product(v, v) + list_inner_product(c, c) - 2 * list_inner_product(v, c), 'e': e})"
    far = "min(list_inner_product(v, v) + list_inner_product(c, c) - 2 * list_inner_product(v, c))"
    steps = []
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT vec_id, p, v, {near} AS e, {far} AS d FROM v JOIN b{r} USING (p) GROUP BY vec_id, p, v)")
        if r < rounds:
            steps.append(f"""m{r} AS (SELECT p, e, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT p, e, unnest(v)::BIGINT AS x, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY p, e, i),
b{r + 1} AS MATERIALIZED (SELECT p, e, coalesce(new, c) AS c FROM b{r} LEFT JOIN (SELECT p, e, list(((s - ((s % n) + n) % n) // n)::DOUBLE ORDER BY i) AS new FROM m{r} GROUP BY p, e) USING (p, e))""")
    return f"""
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS x FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS MATERIALIZED (SELECT vec_id, p::INT AS p, x[p * len(x) // {parts} + 1 : (p + 1) * len(x) // {parts}] AS v FROM kept, range({parts}) t(p)),
b0 AS MATERIALIZED (SELECT p, (row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1)::INT AS e, v AS c FROM v QUALIFY row_number() OVER (PARTITION BY p ORDER BY vec_id) <= {entries}),
{', '.join(steps)},
sha AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: x::BIGINT), ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds}),
coded AS (SELECT vec_id, string_agg(lpad(lower(to_hex(e)), 2, '0'), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN kept USING (vec_id), sha
"""


def _mixing_sql() -> str:
    """Budgets of three levels, each filled in order of cap / weight, then the prefix of each leaf's next epoch."""

    def weight(col: str, weights: dict[str, int], other: int) -> str:
        return "CASE " + "".join(f"WHEN {col} = '{k}' THEN {w} " for k, w in weights.items()) + f"ELSE {other} END" if weights else str(other)

    parts, above = [], None
    for depth, (name, _, weights, other) in enumerate(TREE.levels):
        here, parent = TREE.names[: depth + 1], TREE.names[:depth]
        over = f"PARTITION BY {', '.join(parent)}" if parent else ""
        keys = ", ".join(here)
        budget = f"(SELECT sum(tokens)::BIGINT * {TREE.budget_percent} // 100 FROM lv)" if not parent else "p.alloc"
        source = f"(SELECT {keys}, sum(tokens)::HUGEINT AS tokens FROM lv GROUP BY {keys}) n" + (f" JOIN f{depth - 1} p USING ({', '.join(parent)})" if parent else "")
        parts.append(f"""n{depth} AS (SELECT {keys}, n.tokens, n.tokens * {TREE.max_epochs} AS cap, ({weight(name, weights, other)})::HUGEINT AS weight, ({budget})::HUGEINT AS budget FROM {source}),
o{depth} AS (SELECT *, coalesce(sum(cap) OVER ({over} ORDER BY cap / weight, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  sum(weight) OVER ({over} ORDER BY cap / weight, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_ FROM n{depth}),
s{depth} AS (SELECT *, cap * left_ <= (budget - before) * weight AS full_ FROM o{depth}),
f{depth} AS (SELECT {keys}, tokens, CASE WHEN full_ THEN cap ELSE (budget - coalesce(sum(cap) FILTER (full_) OVER ({over}), 0)) * weight // (sum(weight) FILTER (NOT full_) OVER ({over})) END AS alloc FROM s{depth})""")
    last = len(TREE.levels) - 1
    names = ", ".join(TREE.names)
    return f"""
WITH l AS (SELECT doc_id, coalesce({DOMAIN}, 'unknown') AS domain, coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source,
  len(regexp_extract_all(coalesce(text, ''), '{_SPACE}'))::BIGINT AS tokens FROM documents),
lv AS (SELECT {names}, sum(tokens) AS tokens FROM l GROUP BY {names} HAVING sum(tokens) > 0),
{', '.join(parts)},
leaf AS (SELECT {names}, (alloc // tokens)::BIGINT AS whole, (alloc % tokens)::BIGINT AS rest FROM f{last}),
k AS (SELECT l.*, whole, rest, sum(l.tokens) OVER (PARTITION BY {names} ORDER BY md5('{TREE.seed}:' || (whole + 1)::VARCHAR || ':' || coalesce(doc_id::VARCHAR, ''))) AS upto FROM l JOIN leaf USING ({names})),
t AS (SELECT *, whole + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END AS times FROM k)
SELECT doc_id, domain, lang, source, tokens AS n_tokens, unnest(generate_series(1, times))::BIGINT AS epoch FROM t WHERE times > 0
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_contamination": OP2_SQL, "op3_quality_rules": OP3_SQL, "op4_substring_dedup": OP4_SQL, "op6_url_verdicts": OP6_SQL,
        "op8_jaccard_groups": OP8_SQL, "op10_mixture": _mixing_sql(), "op11_spelling_groups": OP11_SQL, "op12_suffix_dedup": OP12_SQL, "op13_vector_codes": _codes_sql(),
    }
