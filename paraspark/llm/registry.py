"""Queries of this package, with production parameters over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from paraspark.llm import (
    ann,
    bpe,
    filter_audit,
    fingerprints,
    license_scan,
    mixing,
    near_dedup,
    preferences,
    resampling,
    secret_scan,
    sharding,
    substring_dedup,
    toxicity,
)
from paraspark.llm.common import read_table, shared_dir


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_digest(license_scan.scan_licenses(read_table(spark, sf_dir, "documents")))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_digest(secret_scan.scan_secrets(read_table(spark, sf_dir, "documents")))


def op3_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = preferences.conversation_turns(read_table(spark, sf_dir, "conversations"))
    return preferences.format_preferences(turns, preferences.rejected_from_next(turns, wrap=True))


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest_neighbours(read_table(spark, sf_dir, "embeddings"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The ranks file holds the vocabulary of byte_bpe_50k.json.
    return bpe.bpe_digest(
        read_table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN,
    )


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(read_table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeats_digest(substring_dedup.remove_repeats(read_table(spark, sf_dir, "documents")))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing_digest(mixing.mix_documents(read_table(spark, sf_dir, "documents")))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read_table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents")
    model = toxicity.train_on(documents, read_table(spark, sf_dir, "labels"))
    return toxicity.score_documents(documents, model)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return filter_audit.audit_orders(filter_audit.count_masks(documents, labels))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/shard-maps/{uuid.uuid4().hex}"
    return sharding.shard_digest(sharding.shard_documents(read_table(spark, sf_dir, "documents"), path))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, benchmark = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")
    return resampling.resample_digest(resampling.draw_sample(resampling.score_documents(documents, benchmark)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_license_scan,
        op2_secret_scan,
        op3_preference_format,
        op4_nearest_neighbours,
        op5_bpe,
        op6_fingerprints,
        op7_substring_dedup,
        op8_mixing,
        op9_near_dedup,
        op10_toxicity,
        op11_filter_audit,
        op12_sharding,
        op13_importance_resampling,
    )
    return {f.__name__: f for f in found}


_SUBSTRING_DEDUP = r"""
WITH texts AS (
  SELECT doc_id, list_filter(string_split_regex(COALESCE(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS ws FROM documents
),
words AS (SELECT doc_id, UNNEST(ws) AS word, GENERATE_SUBSCRIPTS(ws, 1) AS pos FROM texts),
windows AS (
  SELECT doc_id, pos, md5(STRING_AGG(word, ' ') OVER w) AS h, COUNT(*) OVER w AS n FROM words
  WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)
),
lowest AS (SELECT h, MIN(doc_id) AS first_doc FROM windows WHERE n = 50 GROUP BY h),
later AS (
  SELECT doc_id, pos AS start FROM windows JOIN lowest USING (h) WHERE n = 50 AND first_doc < doc_id
),
covered AS (
  SELECT w.doc_id, w.pos, w.word,
         MAX(l.start) OVER (PARTITION BY w.doc_id ORDER BY w.pos ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
  FROM words w LEFT JOIN later l ON l.doc_id = w.doc_id AND l.start = w.pos
)
SELECT d.doc_id, COUNT(c.pos) AS n_words, COUNT(*) FILTER (WHERE c.gone) AS n_removed,
       sha256(COALESCE(STRING_AGG(c.word, ' ' ORDER BY c.pos) FILTER (WHERE NOT c.gone), '')) AS kept_sha256
FROM documents d LEFT JOIN covered c USING (doc_id) GROUP BY d.doc_id
"""


_FILTER_AUDIT = r"""
WITH texts AS (
  SELECT doc_id, COALESCE(source, '') AS part, COALESCE(text, '') AS body,
         list_filter(string_split_regex(COALESCE(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS ws
  FROM documents
),
flags AS (
  SELECT part,
         CASE WHEN len(ws) < 50 THEN 'A' ELSE '' END
         || CASE WHEN 100 * len(list_distinct(ws)) < 65 * len(ws) THEN 'B' ELSE '' END
         || CASE WHEN 100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 5 * length(body) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(body, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN doc_id > MIN(doc_id) OVER (PARTITION BY body) THEN 'E' ELSE '' END AS fails,
         EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = t.doc_id AND l.quality = 1) AS good,
         EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = t.doc_id AND l.toxic = 1) AS toxic
  FROM texts t
),
masks AS (
  SELECT part, fails, COUNT(*) AS n, COUNT(*) FILTER (WHERE good) AS good, COUNT(*) FILTER (WHERE toxic) AS toxic
  FROM flags GROUP BY ALL
),
letters AS (SELECT UNNEST(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS o
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
),
steps AS (
  SELECT o, s::INT AS s, substr(o, s::INT, 1) AS x, substr(o, 1, s::INT - 1) AS earlier, substr(o, 1, s::INT) AS upto
  FROM orders, range(1, 6) r(s)
),
per_step AS (
  SELECT part, o, s, x,
         COALESCE(SUM(n) FILTER (WHERE translate(fails, upto, '') = fails), 0) AS kept,
         COALESCE(SUM(n) FILTER (WHERE contains(fails, x) AND translate(fails, earlier, '') = fails), 0) AS removed,
         COALESCE(SUM(n) FILTER (WHERE contains(fails, x) AND translate(fails, earlier, '') <> fails), 0) AS redundant,
         COALESCE(SUM(n) FILTER (WHERE fails = x), 0) AS unique_fails,
         COALESCE(SUM(good) FILTER (WHERE contains(fails, x) AND translate(fails, earlier, '') = fails), 0) AS good_lost,
         COALESCE(SUM(toxic) FILTER (WHERE contains(fails, x) AND translate(fails, earlier, '') = fails), 0) AS toxic_lost
  FROM masks, steps GROUP BY part, o, s, x
)
SELECT part, o AS filter_order, s AS step, kept::BIGINT AS kept, removed::BIGINT AS removed,
       redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
       toxic_lost::BIGINT AS toxic_lost, (SUM(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley
FROM per_step
"""

_RESAMPLING = r"""
WITH crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM range(256) r(i)
  )
),
raw_words AS (
  SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents
),
target_words AS (
  SELECT UNNEST(regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w
  FROM benchmark
),
per_doc AS (SELECT doc_id, w, COUNT(*) AS n FROM (SELECT doc_id, UNNEST(ws) AS w FROM raw_words) GROUP BY doc_id, w),
vocabulary AS (
  SELECT w, xor(list_reduce(
           list_concat([4294967295], list_transform(range(octet_length(encode(w))), lambda i: ('0x' || substr(hex(encode(w)), 2 * i::INT + 1, 2))::BIGINT)),
           lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])
         ), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT w FROM (SELECT w FROM per_doc UNION ALL SELECT w FROM target_words)), crc_table
),
raw_counts AS (SELECT bucket, SUM(n) AS s FROM per_doc JOIN vocabulary USING (w) GROUP BY bucket),
target_counts AS (SELECT bucket, COUNT(*) AS t FROM target_words JOIN vocabulary USING (w) GROUP BY bucket),
totals AS (SELECT (SELECT COALESCE(SUM(s), 0) FROM raw_counts) AS all_s, (SELECT COALESCE(SUM(t), 0) FROM target_counts) AS all_t),
gains AS (
  SELECT bucket, floor(1000 * ln((COALESCE(t, 0) + 1)::DOUBLE * (all_s + 10000)::DOUBLE
                                 / ((s + 1)::DOUBLE * (all_t + 10000)::DOUBLE)))::BIGINT AS gain
  FROM raw_counts LEFT JOIN target_counts USING (bucket), totals
),
weights AS (
  SELECT doc_id, SUM(n) AS n, SUM(n * gain) AS total
  FROM per_doc JOIN vocabulary USING (w) JOIN gains USING (bucket) GROUP BY doc_id
),
scored AS (
  SELECT d.doc_id, COALESCE(w.n, 0)::BIGINT AS n_features,
         CASE WHEN w.n IS NULL THEN 0 ELSE (total - ((total % n) + n) % n) // n END::BIGINT AS weight,
         floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id::VARCHAR), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS noise
  FROM documents d LEFT JOIN weights w USING (doc_id)
),
placed AS (
  SELECT doc_id, ROW_NUMBER() OVER (ORDER BY weight + noise DESC, doc_id) AS place, COUNT(*) OVER () AS n
  FROM scored WHERE n_features >= 20
)
SELECT s.doc_id, n_features, weight, weight + noise AS score,
       CASE WHEN place <= 10 * n // 100 THEN place END AS rank
FROM scored s LEFT JOIN placed p USING (doc_id)
"""


_PREFERENCES = r"""
WITH turns AS (
  SELECT conv_id AS conv, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
),
placed AS (
  SELECT conv, role, text, ROW_NUMBER() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text) - 1 AS place FROM turns
),
replies AS (
  SELECT conv, MAX(place) AS spot, arg_max(text, place) AS reply FROM placed WHERE role = 'assistant' GROUP BY conv
),
paired AS (
  SELECT conv, spot, COALESCE(LEAD(reply) OVER (ORDER BY conv), FIRST_VALUE(reply) OVER (ORDER BY conv)) AS other FROM replies
),
whole AS (SELECT conv, list({'role': role, 'text': text} ORDER BY place) AS good FROM placed GROUP BY conv),
both_sides AS (
  SELECT conv, good, list_concat(list_slice(good, 1, spot), [{'role': 'assistant', 'text': other}]) AS bad
  FROM paired JOIN whole USING (conv)
),
common AS (
  SELECT *, list_min(list_filter(range(0, LEAST(len(good), len(bad)) + 1),
                                 lambda i: i = LEAST(len(good), len(bad)) OR good[i + 1] <> bad[i + 1])) AS n
  FROM both_sides
),
parts AS (
  SELECT conv, n, list_slice(good, 1, n) AS shared, list_slice(good, n + 1, len(good)) AS good, list_slice(bad, n + 1, len(bad)) AS bad
  FROM common
)
SELECT conv AS conv_id, n AS prompt_turns,
       COALESCE(array_to_string(list_transform(shared, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)), ''), '') AS prompt,
       COALESCE(array_to_string(list_transform(good, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)), ''), '') AS chosen,
       COALESCE(array_to_string(list_transform(bad, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)), ''), '') AS rejected,
       COALESCE(array_to_string(list_transform(
         list_filter(range(1, len(good) + 1), lambda i: good[i].role = 'assistant'),
         lambda i: (COALESCE(list_sum(list_transform(list_slice(good, 1, i - 1), lambda t: length(t.role) + length(t.text) + 13)), 0)
                    + length(good[i].role) + 5)::BIGINT || ':'
                || (COALESCE(list_sum(list_transform(list_slice(good, 1, i - 1), lambda t: length(t.role) + length(t.text) + 13)), 0)
                    + length(good[i].role) + length(good[i].text) + 12)::BIGINT), ','), '') AS chosen_mask,
       COALESCE(array_to_string(list_transform(
         list_filter(range(1, len(bad) + 1), lambda i: bad[i].role = 'assistant'),
         lambda i: (COALESCE(list_sum(list_transform(list_slice(bad, 1, i - 1), lambda t: length(t.role) + length(t.text) + 13)), 0)
                    + length(bad[i].role) + 5)::BIGINT || ':'
                || (COALESCE(list_sum(list_transform(list_slice(bad, 1, i - 1), lambda t: length(t.role) + length(t.text) + 13)), 0)
                    + length(bad[i].role) + length(bad[i].text) + 12)::BIGINT), ','), '') AS rejected_mask
FROM parts
"""

_NEAR_DEDUP = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, list_filter(
           string_split_regex(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS ws
  FROM documents
),
sets AS (
  SELECT DISTINCT doc_id, UNNEST(
    CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(list_slice(ws, i, i + 4), ' '))
         WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS shingle
  FROM texts
),
sizes AS (SELECT doc_id, COUNT(*) AS n FROM sets GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, COUNT(*) AS c
  FROM sets a JOIN sets b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2
),
links AS (
  SELECT x, y FROM shared JOIN sizes sx ON sx.doc_id = x JOIN sizes sy ON sy.doc_id = y WHERE 100 * c >= 75 * (sx.n + sy.n - c)
),
neighbours AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reached AS (
  SELECT doc_id AS x, doc_id AS r FROM documents
  UNION
  SELECT n.y, reached.r FROM reached JOIN neighbours n ON n.x = reached.x
),
lowest AS (SELECT x AS doc_id, MIN(r) AS component_id FROM reached GROUP BY x)
SELECT d.doc_id, COALESCE(s.n, 0)::BIGINT AS n_shingles, l.component_id, d.doc_id = l.component_id AS kept
FROM documents d JOIN lowest l USING (doc_id) LEFT JOIN sizes s USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op3_preference_format": _PREFERENCES,
        "op7_substring_dedup": _SUBSTRING_DEDUP,
        "op9_near_dedup": _NEAR_DEDUP,
        "op11_filter_audit": _FILTER_AUDIT,
        "op13_importance_resampling": _RESAMPLING,
    }
