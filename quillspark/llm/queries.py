"""One query for each operator, over its whole table with production parameters, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import ans, compression_quality, line_dedup, media, mixing, near_dups, packing, repetition, token_counts, wrappers
from quillspark.llm.common import load


def op1_wrapper_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.main_text(load(spark, sf_dir, "pages"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(load(spark, sf_dir, "documents"))


def op3_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(load(spark, sf_dir, "documents").select("doc_id", "source", "text"), columns=["doc_id", "source"])


def op4_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(load(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_quality.quality_scores(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op6_suffix_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = repetition.quality_rules(load(spark, sf_dir, "documents"))
    return rules.withColumn("long_repeat", F.col("longest_repeat") > repetition.MAX_REPEAT).drop("longest_repeat")


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(load(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(load(spark, sf_dir, "documents"))


def op9_rans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ans.read_ids(ans.write_ids(load(spark, sf_dir, "documents")))


def op10_media_sniffing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(media.store_texts(load(spark, sf_dir, "documents")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_wrapper_text, op2_token_counts, op3_pareto_mix, op4_line_windows, op5_compression_quality, op6_suffix_repetition, op7_minhash, op8_packing, op9_rans, op10_media_sniffing, pipeline)
}

#: Queries without SQL: they are held against brute force or exact round trips in tests/llm.
ORACLE_SQL: dict[str, str] = {
    "op3_pareto_mix": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         (CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight,
         row_number() OVER (ORDER BY source NULLS LAST) AS rank
  FROM d GROUP BY source),
l AS (
  SELECT *, CAST(3 * source_size AS DOUBLE) AS most,
         (CAST(sum(source_size) OVER () AS DOUBLE)
          - coalesce(sum(CAST(3 * source_size AS DOUBLE)) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
         / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS own_level
  FROM s WINDOW o AS (ORDER BY CAST(3 * source_size AS DOUBLE) / weight, rank)),
t AS (
  SELECT source, source_size, least(most, weight * (SELECT own_level FROM l WHERE most / weight >= own_level ORDER BY most / weight, rank LIMIT 1)) AS target FROM l),
g AS (
  SELECT *, CAST(floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END) AS BIGINT) AS whole FROM t),
r AS (SELECT *, greatest(0.0::DOUBLE, target - whole * source_size) AS rest FROM g),
v AS (SELECT source, sum(CAST(size AS DOUBLE) * CAST(size AS DOUBLE)) AS squares, max(size) AS longest FROM d GROUP BY source),
f AS (
  SELECT r.*, CASE WHEN source_size > 0 THEN rest / source_size ELSE 0.0::DOUBLE END AS share, CASE WHEN source_size > 0 THEN squares / source_size ELSE 1.0::DOUBLE END AS mean, longest
  FROM r JOIN v ON r.source IS NOT DISTINCT FROM v.source),
p AS (
  SELECT *, 0.5::DOUBLE * least(1.0::DOUBLE, CASE WHEN longest > mean THEN mean / (longest - mean) ELSE 1.0::DOUBLE END, CASE WHEN share > 0 THEN (1.0::DOUBLE - share) / share ELSE 1.0::DOUBLE END) AS tilt FROM f),
i AS (
  SELECT d.*, rest, p.share * (1.0::DOUBLE + tilt * (1.0::DOUBLE - size / mean)) AS prob FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source WHERE rest > 0 AND size > 0),
o AS (SELECT doc_id, source, size, rest, (u / (1.0::DOUBLE - u)) / (prob / (1.0::DOUBLE - prob)) AS odds FROM i),
a AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY odds, doc_id) AS upto FROM o),
n AS (SELECT *, upto > rest AS out, row_number() OVER (PARTITION BY source, upto > rest ORDER BY odds, doc_id) AS k FROM a),
cut AS (SELECT source, doc_id AS last, size AS last_size, rest - (upto - size) AS room FROM n WHERE out AND k = 1),
c AS (
  SELECT n.source, n.doc_id, n.size, length(bin(n.size)) AS class, row_number() OVER (PARTITION BY n.source, length(bin(n.size)) ORDER BY odds, n.doc_id) AS j
  FROM n JOIN cut ON n.source IS NOT DISTINCT FROM cut.source WHERE out AND k > 1 AND n.size <= room),
fill AS (
  SELECT source, last, last_size, room, room AS first_room, 64 AS class, CAST([] AS BIGINT[]) AS more FROM cut
  UNION ALL
  SELECT fill.source, last, last_size, CASE WHEN c.size <= room THEN room - c.size ELSE room END, first_room, fill.class - 1,
         CASE WHEN c.size <= room THEN list_append(more, c.doc_id) ELSE more END
  FROM fill LEFT JOIN c ON c.source IS NOT DISTINCT FROM fill.source AND c.class = fill.class - 1 AND c.j = 1 WHERE fill.class > 1),
e AS (SELECT source, CASE WHEN last_size - first_room < room THEN [last] ELSE more END AS more FROM fill WHERE class = 1),
drawn AS (
  SELECT n.doc_id FROM n LEFT JOIN e ON n.source IS NOT DISTINCT FROM e.source WHERE NOT out OR list_contains(more, n.doc_id))
SELECT d.doc_id, d.source, d.size, p.source_size, p.target,
       CAST(CASE WHEN d.size > 0 THEN whole + CAST(d.doc_id IN (SELECT doc_id FROM drawn) AS INT) ELSE 0 END AS BIGINT) AS copies,
       CAST(CASE WHEN d.size > 0 THEN whole + CAST(d.doc_id IN (SELECT doc_id FROM drawn) AS INT) ELSE 0 END * d.size AS BIGINT) AS taken
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source""",
    "op4_line_windows": r"""
WITH l AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents),
n AS (
  SELECT doc_id, pos, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS line FROM l
  WHERE trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) <> ''),
w AS (
  SELECT doc_id, pos, line || chr(10) || lead(line, 1) OVER o || chr(10) || lead(line, 2) OVER o AS win,
         lead(pos, 1) OVER o AS pos1, lead(pos, 2) OVER o AS pos2
  FROM n WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
k AS (
  SELECT doc_id, pos, pos1, pos2, row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) AS occurrence FROM w WHERE win IS NOT NULL),
gone AS (
  SELECT DISTINCT doc_id, unnest([pos, pos1, pos2]) AS pos FROM k WHERE occurrence > 1)
SELECT l.doc_id,
       coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE gone.pos IS NULL), '') AS text,
       CAST(count(*) AS BIGINT) AS n_lines, CAST(count(gone.pos) AS BIGINT) AS n_removed
FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.pos = gone.pos GROUP BY l.doc_id""",
    "op6_suffix_repetition": r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM t),
k AS (
  SELECT doc_id, i, CASE WHEN i + 7 <= len(w) THEN hash(w[i:i + 7]) END AS h8, CASE WHEN i + 9 <= len(w) THEN hash(w[i:i + 9]) END AS h10,
         CASE WHEN i + 200 <= len(w) THEN hash(w[i:i + 200]) END AS h201
  FROM p),
c AS (
  SELECT doc_id, i, h8 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, h8) > 1 AS r8, h10 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, h10) > 1 AS r10,
         h201 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, h201) > 1 AS r201
  FROM k),
v AS (
  SELECT doc_id, r201, bool_or(r8) OVER (o ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS in8, bool_or(r10) OVER (o ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS in10
  FROM c WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, count(*) FILTER (WHERE in8) AS n8, count(*) FILTER (WHERE in10) AS n10, bool_or(r201) AS long FROM v GROUP BY doc_id),
l AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
b AS (
  SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(l.n, 0) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n8, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(n10, 0) AS BIGINT) AS covered_words, coalesce(long, false) AS long_repeat
  FROM t LEFT JOIN r USING (doc_id) LEFT JOIN l USING (doc_id))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 100 * covered_words <= 20 * n_words AND NOT long_repeat AS kept FROM b""",
}
