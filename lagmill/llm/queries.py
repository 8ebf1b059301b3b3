"""Queries and oracle SQL of the training-data operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lagmill.llm.bpe_codec import round_trip
from lagmill.llm.common import materialize, new_path, read_table, remove, scratch
from lagmill.llm.decontaminate import contamination
from lagmill.llm.lexical_search import search
from lagmill.llm.license_scan import license_matches
from lagmill.llm.mixing import mix_plan
from lagmill.llm.near_dedup import near_duplicates
from lagmill.llm.quality_classifier import classify
from lagmill.llm.quality_rules import quality_rules
from lagmill.llm.secret_scan import secret_digests
from lagmill.llm.sharding import shard
from lagmill.llm.spelling import spelling_variants
from lagmill.llm.token_count import default_path, token_counts
from lagmill.llm.warc import assemble, capture_pages, read_archives, write_archives


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document; trained on the labelled rows that are not held out."""
    return classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every licence notice found in the documents."""
    return license_matches(read_table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    plan = mix_plan(read_table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document."""
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the secrets found in every document."""
    return secret_digests(read_table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in every document, and how many items stand near."""
    found = contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document."""
    return shard(read_table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    found = quality_rules(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    return token_counts(read_table(spark, sf_dir, "documents"), default_path())


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as WARC records, read back and assembled; the archives go once their records are a table."""
    path = new_path(spark, "warc")
    with scratch(spark):
        write_archives(read_table(spark, sf_dir, "pages"), path)
    records = materialize(read_archives(spark, path, with_payload=False), "warc-records")  # three joins read them
    remove(spark, path)
    pages = capture_pages(assemble(records))
    return pages.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "digest_ok")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every benchmark item."""
    return search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form and root of every word of the documents."""
    return spelling_variants(read_table(spark, sf_dir, "documents"))


def op13_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again."""
    return round_trip(read_table(spark, sf_dir, "documents"), default_path(name="byte_bpe_50k.tiktoken"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_classifier, op2_license_scans, op3_mixing, op4_near_dedup, op5_secret_scans, op6_decontamination, op7_sharding,
        op8_quality_rules, op9_token_counts, op10_warc, op11_lexical_search, op12_spelling_variants, op13_bpe_round_trip,
    )
}

OP3_SQL = """
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight
  FROM sized GROUP BY source),
levels AS (
  SELECT *, (sum(source_size::DOUBLE) OVER () - coalesce(sum(3.0::DOUBLE * source_size) OVER ahead, 0)) /
            (sum(weight) OVER () - coalesce(sum(weight) OVER ahead, 0)) AS level
  FROM per WINDOW ahead AS (ORDER BY 3.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (SELECT source, source_size, least(3.0::DOUBLE * source_size, weight * max(level) OVER ()) AS target FROM levels),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
         ('0x' || substr(md5('mix:' || coalesce(s.source, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u,
         row_number() OVER (PARTITION BY s.source ORDER BY floor(sqrt(s.size::DOUBLE)), md5(coalesce(s.doc_id::VARCHAR, '')), s.doc_id, s.size) AS i
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate) + floor(u + i * (rate - floor(rate))) - floor(u + (i - 1) * (rate - floor(rate)))))::BIGINT AS taken FROM placed
"""

#: Fixed shape of the contract: sets of five-word shingles, links at 75 %, smallest reachable doc_id.
OP4_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id
  GROUP BY x.doc_id, y.doc_id),
links AS (
  SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)),
reach AS (
  SELECT doc_id AS id, doc_id AS other FROM documents
  UNION
  SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, r.component_id, d.doc_id = r.component_id AS kept
FROM documents d LEFT JOIN sizes s USING (doc_id)
JOIN (SELECT id, min(other) AS component_id FROM reach GROUP BY id) r ON r.id = d.doc_id
"""

OP6_SQL = """
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n,
         unnest(CASE WHEN len(w) >= 10 THEN list_transform(range(1, len(w) - 8), lambda i: array_to_string(w[i:i + 9], ' '))
                     WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS win FROM iw),
lengths AS (SELECT DISTINCT n FROM windows),
grams AS (
  SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS win
  FROM dw, lengths WHERE len(w) >= n),
found AS (SELECT g.doc_id, g.n, g.i, w.item_id FROM grams g JOIN windows w USING (n, win)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM found) GROUP BY doc_id),
tokens AS (SELECT doc_id, unnest(w) AS t, unnest(range(0, len(w))) AS i FROM dw),
frequencies AS (SELECT t, count(*) AS n FROM tokens WHERE t IN (SELECT unnest(w) FROM iw) GROUP BY t),
ranked AS (
  SELECT item_id, t, row_number() OVER (PARTITION BY item_id ORDER BY n, t) AS k
  FROM (SELECT DISTINCT item_id, unnest(w) AS t FROM iw WHERE item_id IS NOT NULL) JOIN frequencies USING (t)),
near AS (
  SELECT x.doc_id, count(DISTINCT a.item_id) AS n_near
  FROM ranked a JOIN ranked b ON a.item_id = b.item_id AND a.k = 1 AND b.k = 2 JOIN tokens x ON x.t = a.t
  JOIN tokens y ON y.t = b.t AND y.doc_id = x.doc_id AND abs(x.i - y.i) <= 8
  GROUP BY x.doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0)::BIGINT AS n_near
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN near USING (doc_id)
"""

#: Fixed value: 3988292384 is the reversed polynomial of the CRC-32.
OP7_SQL = """
WITH RECURSIVE crc_table AS (
  SELECT list(c ORDER BY n) AS tbl FROM (
    SELECT n, list_reduce(range(0, 8), lambda a, k: CASE WHEN a % 2 = 1 THEN xor(3988292384, a >> 1) ELSE a >> 1 END, n) AS c
    FROM (SELECT unnest(range(0, 256)) AS n))),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, coalesce(doc_id::VARCHAR, '') AS id FROM documents),
bytes AS (SELECT rid, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::BIGINT) AS b FROM d),
crc AS (
  SELECT rid, xor(4294967295, list_reduce(b, lambda a, x: xor(a >> 8, tbl[(xor(a, x) & 255) + 1]), 4294967295)) AS crc FROM bytes, crc_table),
jump AS (
  SELECT rid, 0::BIGINT AS b, 0::BIGINT AS j, 0::BIGINT AS shard, id AS chain FROM d
  UNION ALL
  SELECT rid, j, floor((j + 1) * (2147483648.0::DOUBLE / ((('0x' || substr(md5(chain), 1, 8))::BIGINT >> 1) + 1)::DOUBLE))::BIGINT,
         CASE WHEN j < 40 THEN j ELSE shard END, md5(chain) FROM jump WHERE j < 41),
placed AS (SELECT rid, max(shard)::INT AS shard, max(b)::INT AS grown_shard FROM jump GROUP BY rid)
SELECT doc_id, (octet_length(encode(text)) + 16)::BIGINT AS size, crc AS text_crc32, 'key' AS law, shard,
       (row_number() OVER (PARTITION BY shard ORDER BY md5(id), doc_id, crc, octet_length(encode(text))) - 1)::BIGINT AS slot, grown_shard
FROM d JOIN crc USING (rid) JOIN placed USING (rid)
"""

#: Fixed value: the base32 alphabet.
OP10_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS n, sha1(encode(coalesce(html, ''))) AS h FROM pages),
r AS (SELECT *, min(page_id) OVER (PARTITION BY h, n) AS first_id, row_number() OVER (PARTITION BY h, n ORDER BY page_id NULLS LAST) AS k FROM p)
SELECT page_id, n AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         ((('0x' || substr(h, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT + 1, 1)), '') AS payload_digest,
       CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN first_id END AS refers_to, true AS digest_ok
FROM r
"""

OP11_SQL = """
WITH dt AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents),
totals AS (SELECT count(*) FILTER (len(w) > 0) AS n_docs, coalesce(sum(len(w)), 0)::BIGINT AS n_terms FROM dt),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                     '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS t FROM benchmark),
held AS (SELECT rid, t, count(*) AS tf FROM (SELECT rid, unnest(w) AS t FROM dt) WHERE t IN (SELECT t FROM asked) GROUP BY rid, t),
weights AS (
  SELECT t, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM held, totals GROUP BY t),
lengths AS (SELECT rid, doc_id, 10 + (90 * len(w) * n_docs) // greatest(n_terms, 1) AS m FROM dt, totals),
scored AS (
  SELECT item_id, rid, any_value(doc_id) AS doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM asked JOIN held USING (t) JOIN weights USING (t) JOIN lengths USING (rid) GROUP BY item_id, rid),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""

#: Fixed value: 3988292384 is the reversed polynomial of the CRC-32.
OP12_SQL = """
WITH RECURSIVE crc_table AS (
  SELECT list(c ORDER BY n) AS tbl FROM (
    SELECT n, list_reduce(range(0, 8), lambda a, k: CASE WHEN a % 2 = 1 THEN xor(3988292384, a >> 1) ELSE a >> 1 END, n) AS c
    FROM (SELECT unnest(range(0, 256)) AS n))),
runs AS (
  SELECT doc_id, run, count(*) AS k FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents) GROUP BY doc_id, run),
hashed AS (
  SELECT run, k, xor(4294967295, list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)), '..'),
    lambda x: ('0x' || x)::BIGINT), lambda a, x: xor(a >> 8, tbl[(xor(a, x) & 255) + 1]), 4294967295)) AS h FROM runs, crc_table),
words AS (
  SELECT word, sum(k)::BIGINT AS n FROM (
    SELECT k, CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
cut AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM words),
cuts AS (SELECT word, n, p, substr(word, 1, p - 1) || substr(word, p + 1) AS rest FROM cut),
near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.p = b.p AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.rest = b.word),
ranked AS (SELECT *, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) AS i FROM near),
formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * w.n THEN other END AS form, CASE WHEN other_n >= 2 * w.n THEN other_n END AS form_n
  FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.i = 1),
walk AS (
  SELECT word, word AS root, form AS further FROM formed
  UNION ALL
  SELECT k.word, f.word, f.form FROM walk k JOIN formed f ON f.word = k.further)
SELECT f.word, f.form, k.root, f.n, f.n_near::BIGINT AS n_near, f.form_n FROM formed f JOIN walk k ON k.word = f.word AND k.further IS NULL
"""

ORACLE_SQL: dict[str, str] = {
    "op3_mixing": OP3_SQL,
    "op4_near_dedup": OP4_SQL,
    "op6_decontamination": OP6_SQL,
    "op7_sharding": OP7_SQL,
    "op10_warc": OP10_SQL,
    "op11_lexical_search": OP11_SQL,
    "op12_spelling_variants": OP12_SQL,
}
