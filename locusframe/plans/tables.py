"""Queries over the annotation tables that need the packed-field, bad-row and span operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.operators import bad_rows, packed_fields, span_union
from locusframe.session import read_table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    junctions = packed_fields.unpack(read_table(spark, sf_dir, "splice_table"), "splice_id", {"jn_end_str": packed_fields.NUMBERS, "jn_start_str": packed_fields.NUMBERS}, "splice_table")
    attributes = packed_fields.unpack(read_table(spark, sf_dir, "gff_features"), "feature_id", {"attributes": packed_fields.ATTRIBUTES}, "gff_features")
    return junctions.unionByName(attributes)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bad_rows.faulty_lines(read_table(spark, sf_dir, "gff_raw"))


def p5_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bad_rows.load_rows(read_table(spark, sf_dir, "gff_raw"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    genes = read_table(spark, sf_dir, "genes").filter(F.col("strand").isNotNull())
    return span_union.periods_and_gaps(genes, ["contig_id", "strand"], "gene_start", "gene_end")


P3 = r"""
WITH fields AS (
  SELECT DISTINCT 'splice_table' AS table_name, splice_id AS row_id, 'jn_end_str' AS field, jn_end_str AS v FROM splice_table
  UNION ALL SELECT DISTINCT 'splice_table', splice_id, 'jn_start_str', jn_start_str FROM splice_table
), raw_num AS (
  SELECT table_name, row_id, field, t, i FROM (
    SELECT table_name, row_id, field, unnest(l) AS t, unnest(range(1, len(l) + 1)) AS i
    FROM (SELECT *, regexp_extract_all(v, '"(?:[^"]|"")*"|[^\s,;|/:\[\](){}"]+') AS l FROM fields WHERE v IS NOT NULL))
), num AS (
  SELECT table_name, row_id, field, i, CASE WHEN t LIKE '"%' THEN regexp_replace(t, '["\s,._'']', '', 'g') ELSE t END AS d FROM raw_num
), nums AS (
  SELECT table_name, row_id, field, i, CAST(CAST(d AS HUGEINT) AS VARCHAR) AS item FROM num WHERE regexp_full_match(d, '[0-9]+')
), att AS (
  SELECT row_id, unnest(l) AS e, unnest(range(1, len(l) + 1)) AS i FROM (
    SELECT feature_id AS row_id, regexp_extract_all(attributes, '(?:"(?:[^"]|"")*"|[^";|\t\n\r])+') AS l
    FROM (SELECT DISTINCT feature_id, attributes FROM gff_features WHERE attributes IS NOT NULL))
), tagged AS (
  SELECT row_id, i, regexp_extract(e, '^\s*([A-Za-z_]+)', 1) AS tag, regexp_replace(e, '^\s*[A-Za-z_]+(\s*=|\s+=?)', '') AS rest
  FROM att WHERE regexp_matches(e, '^\s*[A-Za-z_]+(\s*=|\s)')
), vals AS (
  SELECT row_id, tag, i, unnest(l) AS w, unnest(range(1, len(l) + 1)) AS j FROM (SELECT *, regexp_extract_all(rest, '(?:"(?:[^"]|"")*"|[^",])+') AS l FROM tagged)
), clean AS (
  SELECT row_id, i * 10000 + j AS i, tag, CASE WHEN trim(w) LIKE '"%' THEN replace(substr(trim(w), 2, length(trim(w)) - 2), '""', '"') ELSE trim(w) END AS w FROM vals
), all_items AS (
  SELECT table_name, row_id, field, i, item FROM nums
  UNION ALL SELECT 'gff_features', row_id, 'attributes', i, trim(tag || '=' || w) FROM clean WHERE trim(w) <> ''
)
SELECT table_name, row_id, field, CAST(row_number() OVER (PARTITION BY table_name, row_id, field ORDER BY i) AS INT) AS pos, item FROM all_items
"""

_BASE5 = r"""
WITH data AS (
  SELECT DISTINCT line_id, rtrim(raw_line, chr(13) || chr(10)) AS l FROM gff_raw
  WHERE raw_line IS NOT NULL AND raw_line NOT LIKE '#%' AND NOT regexp_full_match(raw_line, '\s*')
), split AS (
  SELECT line_id, string_split(l, chr(9)) AS f FROM data
), parts AS (
  SELECT line_id, len(f) AS n, f[1] AS seqid, f[2] AS source, f[3] AS ft, f[4] AS s, f[5] AS e, f[6] AS sc, f[7] AS st, f[8] AS ph, f[9] AS a FROM split
), judged AS (
  SELECT *, CASE
    WHEN n <> 9 THEN 'columns'
    WHEN NOT regexp_full_match(a, '(?:[^";]*|[^";=, ]* *[= ] *(?: *(?:"(?:[^"]|"")*" *|[^",;]*),)* *(?:"(?:[^"]|"")*" *|[^",;]*))(?:;(?:[^";]*|[^";=, ]* *[= ] *(?: *(?:"(?:[^"]|"")*" *|[^",;]*),)* *(?:"(?:[^"]|"")*" *|[^",;]*)))*')
         AND NOT regexp_full_match(a, '(?:[^";]*| *[^";=, ]+ *[= ] *(?: *(?:"(?:[^"]|"")*" *|[^",;]*),)* *(?:"(?:[^"]|"")*" *|[^",;]*))(?:;(?:[^";]*| *[^";=, ]+ *[= ] *(?: *(?:"(?:[^"]|"")*" *|[^",;]*),)* *(?:"(?:[^"]|"")*" *|[^",;]*)))*') THEN 'quoting'
    WHEN ft NOT IN ('region', 'gene', 'mRNA', 'exon', 'CDS') OR NOT regexp_full_match(s, '[0-9]+') OR NOT regexp_full_match(e, '[0-9]+')
         OR TRY_CAST(s AS HUGEINT) < 1 OR TRY_CAST(e AS HUGEINT) < TRY_CAST(s AS HUGEINT)
         OR NOT (sc = '.' OR regexp_full_match(sc, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') AND isfinite(TRY_CAST(sc AS DOUBLE)))
         OR st NOT IN ('+', '-', '.', '?') OR NOT (ph IN ('0', '1', '2') OR ft <> 'CDS' AND ph = '.') THEN 'value'
    WHEN NOT regexp_full_match(a, ' *[A-Za-z_]+(?: *= *| +)(?:"(?:[^"]|"")+"|[^",; =][^";]*)[^;"]*(?:"(?:[^"]|"")*"[^;"]*)*(?:; *[A-Za-z_]+(?: *= *| +)(?:"(?:[^"]|"")+"|[^",; =][^";]*)[^;"]*(?:"(?:[^"]|"")*"[^;"]*)*)*(?:; *)?') THEN 'attributes'
    END AS reason
  FROM parts
)
"""
P5 = _BASE5 + "SELECT line_id, reason FROM judged WHERE reason IS NOT NULL"
P5_ROWS = _BASE5 + """SELECT line_id, seqid, source, ft AS feature_type, TRY_CAST(s AS BIGINT) AS "start", TRY_CAST(e AS BIGINT) AS "end",
  CASE WHEN sc = '.' THEN NULL ELSE TRY_CAST(sc AS DOUBLE) END AS score, st AS strand, CASE WHEN ph = '.' THEN NULL ELSE CAST(ph AS INT) END AS phase, a AS attributes
FROM judged WHERE reason IS NULL"""

P6 = """
WITH spans AS (
  SELECT contig_id, strand, least(gene_start, gene_end) AS a, greatest(gene_start, gene_end) AS b FROM genes
  WHERE strand IS NOT NULL AND gene_start IS NOT NULL AND gene_end IS NOT NULL AND gene_start <> gene_end
), flagged AS (
  SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY contig_id, strand ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS brk FROM spans
), numbered AS (
  SELECT *, sum(brk) OVER (PARTITION BY contig_id, strand ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM flagged
), period AS (SELECT contig_id, strand, g, min(a) AS s, max(b) AS e FROM numbered GROUP BY ALL),
gap AS (SELECT contig_id, strand, lag(e) OVER (PARTITION BY contig_id, strand ORDER BY s) AS s, s AS e FROM period)
SELECT 'period' AS kind, contig_id, strand, s AS span_start, e AS span_end FROM period
UNION ALL SELECT 'gap', contig_id, strand, s, e FROM gap WHERE s IS NOT NULL
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p3_found, p5_found, p5_rows, p6_found)}


def oracle_sql() -> dict[str, str]:
    return {"p3_found": P3, "p5_found": P5, "p5_rows": P5_ROWS, "p6_found": P6}
