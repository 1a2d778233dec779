"""Queries of this subpackage over the stored tables, and SQL where it can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sulatan.llm import collocations, decontamination, exact_dedup, html_cut, importance, jaccard, quality_model, quality_rules, secrets, sentencepiece_scan, token_counts, toxicity, url_filters
from sulatan.llm.store import read

PIECES, BYTE_BPE = "piece_bpe_32k.model", "byte_bpe_50k.json"


def _number(column, salt: str, most: int):
    """A number below ``most`` from the md5 of a value, alike in any SQL engine."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt), column)), 1, 6), 16, 10).cast("int") % most


def url_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a day of 2024 as their fetch time."""
    pages = read(spark, sf_dir, "pages")
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), _number(F.col("page_id").cast("string"), "fetch", 366)).alias("day"))


def url_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dated list entries for hosts, parent domains and paths of the pages themselves."""
    urls = read(spark, sf_dir, "pages").where("url is not null").select("url")
    keys = urls.select(F.explode(url_filters.keys_of(F.col("url"))).alias("key")).distinct()
    pick = _number(F.col("key"), "pick", 12)
    lists = keys.select("key", F.when(pick == 0, "allow").when(pick <= 2, "block").when(pick == 3, "watch").alias("list"), _number(F.col("key"), "day", 330).alias("d"), _number(F.col("key"), "len", 200).alias("n")).where("list is not null")
    day = lambda n: F.date_add(F.lit("2023-12-01").cast("date"), n)
    moves = F.array(F.struct(F.lit(0).alias("o"), F.lit("add").alias("action")), F.struct(F.col("n").alias("o"), F.lit("remove").alias("action")), F.struct((F.col("n") * 2).alias("o"), F.lit("add").alias("action")))
    return lists.select("list", "key", F.explode(moves).alias("m"), "d").select("list", "key", day(F.col("d") + F.col("m.o")).alias("day"), F.col("m.action").alias("action"))


def op1_url_filters(spark, sf_dir):
    return url_filters.evaluate(url_captures(spark, sf_dir), url_entries(spark, sf_dir))


def op2_decontamination(spark, sf_dir):
    return decontamination.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op3_toxicity(spark, sf_dir):
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_html_extraction(spark, sf_dir):
    return html_cut.extract(read(spark, sf_dir, "pages"))


def op5_quality_rules(spark, sf_dir):
    return quality_rules.quality_rules(read(spark, sf_dir, "documents"))


def op6_quality_classifier(spark, sf_dir):
    return quality_model.quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_secret_scans(spark, sf_dir):
    return secrets.secret_spans(read(spark, sf_dir, "documents")).drop("found")


def op8_sentencepiece(spark, sf_dir):
    """Pieces of every text, their digest, and whether decoding gives the text back."""
    rows = sentencepiece_scan.encode(read(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), "round_trip")


def op9_ngram_jaccard(spark, sf_dir):
    return jaccard.jaccard_components(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op10_token_counts(spark, sf_dir):
    return token_counts.token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op11_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_groups(read(spark, sf_dir, "documents"))


def op12_importance_resampling(spark, sf_dir):
    return importance.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_collocations(spark, sf_dir):
    return collocations.collocations(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_url_filters, op2_decontamination, op3_toxicity, op4_html_extraction, op5_quality_rules, op6_quality_classifier, op7_secret_scans, op8_sentencepiece, op9_ngram_jaccard, op10_token_counts, op11_exact_dedup, op12_importance_resampling, op13_collocations)}

_RE = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)(?::[0-9]*)?([^?#]*)"
_NUM = "(('0x' || substr(md5('{0}' || {1}), 1, 6))::BIGINT % {2})"
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLES = {
    "op1_url_filters": f"""
WITH parsed AS (
  SELECT page_id, url, DATE '2024-01-01' + CAST({_NUM.format('fetch', 'page_id::VARCHAR', 366)} AS INTEGER) AS day,
         regexp_replace(lower(regexp_extract(coalesce(url, ''), '{_RE}', 1)), '\\.+$', '') AS host,
         regexp_extract(coalesce(url, ''), '{_RE}', 2) AS path
  FROM pages),
keyed AS (
  SELECT url, day, unnest(list_distinct(list_concat(
    list_transform(range(1, len(labels) + 1), lambda i: 'd:' || array_to_string(labels[i:], '.')),
    list_transform(range(1, len(steps) + 1), lambda i: 'p:' || host || '/' || array_to_string(steps[1:i], '/'))))) AS key
  FROM (SELECT DISTINCT url, day, host, string_split(host, '.') AS labels,
               list_filter(string_split(path, '/'), lambda x: x <> '') AS steps
        FROM parsed WHERE host <> '')),
picked AS (
  SELECT key, {_NUM.format('pick', 'key', 12)} AS pick, {_NUM.format('day', 'key', 330)} AS d, {_NUM.format('len', 'key', 200)} AS n
  FROM (SELECT DISTINCT key FROM keyed)),
listed AS (
  SELECT CASE WHEN pick = 0 THEN 'allow' WHEN pick <= 2 THEN 'block' ELSE 'watch' END AS list, key, d, n FROM picked WHERE pick <= 3),
entries AS (
  SELECT list, key, DATE '2023-12-01' + CAST(d + o AS INTEGER) AS day, max(action) AS action
  FROM (SELECT list, key, d, 0 AS o, 'add' AS action FROM listed
        UNION ALL SELECT list, key, d, n, 'remove' FROM listed
        UNION ALL SELECT list, key, d, 2 * n, 'add' FROM listed)
  GROUP BY ALL),
held AS (
  SELECT * FROM (SELECT list, key, action, day AS since, lead(day) OVER (PARTITION BY list, key ORDER BY day) AS until FROM entries)
  WHERE action = 'add'),
found AS (
  SELECT k.url, k.day, count(*) AS n_matches, array_to_string(list_sort(list_distinct(list(list))), ',') AS lists,
         bool_or(list = 'block') AND NOT bool_or(list = 'allow') AS blocked
  FROM keyed k JOIN held h ON k.key = h.key AND h.since <= k.day AND (h.until IS NULL OR k.day < h.until)
  GROUP BY ALL)
SELECT p.page_id, p.url, p.day, p.host, coalesce(n_matches, 0) AS n_matches, coalesce(lists, '') AS lists, coalesce(blocked, false) AS blocked
FROM parsed p LEFT JOIN found f ON p.url = f.url AND p.day = f.day""",
    "op9_ngram_jaccard": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
                                      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS gram
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
links AS (
  SELECT u, v FROM (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS shared FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY 1, 2)
  JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v
  WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
reach AS (SELECT doc_id AS u, doc_id AS v FROM documents UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT u AS doc_id, min(v) AS component_id FROM reach GROUP BY 1) c USING (doc_id)""",
    "op11_exact_dedup": f"""
WITH t AS (SELECT doc_id, {_LOWER.format("coalesce(text, '')")} AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM t JOIN g USING (norm)""",
    "op12_importance_resampling": f"""
WITH crc AS (SELECT list(c ORDER BY i) AS tab FROM (
  SELECT i, list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) AS c FROM range(256) r(i))),
texts AS (SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'b', row_number() OVER (), text FROM benchmark),
w AS (SELECT side, id, list_filter(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM texts),
f AS (SELECT side, id, unnest(ws || list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS feature FROM w),
b AS (SELECT feature, xor(list_reduce([4294967295::BIGINT] || list_transform(range(0, strlen(feature)), lambda i: ('0x' || hex(encode(feature))[2 * i + 1:2 * i + 2])::BIGINT),
        lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295::BIGINT) % 10000 AS bucket
  FROM (SELECT DISTINCT feature FROM f), crc),
n AS (SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM f JOIN b USING (feature) GROUP BY 1),
gain AS (SELECT bucket, floor(1000 * ln((t + 1.0::DOUBLE) * (sum(s) OVER () + 10000.0::DOUBLE) / ((s + 1.0::DOUBLE) * (sum(t) OVER () + 10000.0::DOUBLE))))::BIGINT AS g FROM n),
mean AS (SELECT id, count(*) AS n_features, floor(sum(g)::DOUBLE / count(*))::BIGINT AS weight FROM f JOIN b USING (feature) JOIN gain USING (bucket) WHERE side = 'd' GROUP BY 1),
scored AS (
  SELECT id AS doc_id, len(ws) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score
  FROM w LEFT JOIN mean USING (id) WHERE side = 'd'),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, 25 * count(*) OVER () // 100 AS drawn FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= drawn THEN place END AS rank FROM scored LEFT JOIN placed USING (doc_id)""",
    "op13_collocations": f"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM pieces),
total AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY 1),
f AS (SELECT lang, k, phrase, count(*) AS f FROM (
  SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase FROM w, range(1, 4) r(k)) GROUP BY ALL),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND f >= 10),
cut AS (SELECT lang, k, phrase, a, j, array_to_string(ws[1:j], ' ') AS head, array_to_string(ws[j + 1:k], ' ') AS tail FROM c, range(1, 3) r(j) WHERE j < k),
scored AS (SELECT c.lang, c.k, c.phrase, a, j, x.f AS l, y.f AS r, (1000000::HUGEINT * a * a // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cut c JOIN f x ON x.lang = c.lang AND x.phrase = head JOIN f y ON y.lang = c.lang AND y.phrase = tail),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inside AS (SELECT lang, array_to_string(ws[i:i + 1], ' ') AS phrase, max(a) AS most FROM c, range(1, 3) r(i) WHERE k = 3 GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN inside USING (lang, phrase) WHERE k = 3 OR most IS NULL OR 100 * most < 50 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000""",
}
