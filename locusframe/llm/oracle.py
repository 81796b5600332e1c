"""DuckDB SQL for the corpus queries that SQL can express."""

P1 = """
WITH once AS (
  SELECT DISTINCT call_id, contig_id, strand, group_id, tx_start, tx_end, score
  FROM transcripts WHERE group_id IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)
), ranked AS (
  SELECT call_id, CAST(row_number() OVER (PARTITION BY contig_id, strand, group_id
         ORDER BY score DESC, tx_start ASC NULLS LAST, tx_end ASC NULLS LAST, call_id ASC) AS INT) AS rank_no
  FROM once)
SELECT call_id, rank_no FROM ranked WHERE rank_no <= 5
"""

P4 = """
WITH RECURSIVE cfg AS (
  SELECT context_length AS c, context_length AS ov, max_len FROM model_configs
  UNION ALL SELECT NULL, context_length, max_len FROM model_configs WHERE is_default
), long_ones AS (
  SELECT DISTINCT d.rec_id, d.seq, length(d.seq) AS n, cfg.ov, cfg.max_len AS m
  FROM datafile d JOIN cfg ON d.context_length IS NOT DISTINCT FROM cfg.c
  WHERE length(d.seq) > cfg.max_len
), cuts AS (
  SELECT rec_id, string_split_regex(seq, '[Nn]{10,}') AS outside, regexp_extract_all(seq, '[Nn]{10,}') AS gaps FROM long_ones
), gap AS (
  SELECT rec_id, list_sum([length(x) for x in outside[1:i]]) + coalesce(list_sum([length(x) for x in gaps[1:i-1]]), 0) AS g
  FROM (SELECT rec_id, outside, gaps, unnest(range(1, len(gaps) + 1)) AS i FROM cuts)
), piece AS (
  SELECT rec_id, n, ov, m, 1 AS piece_no, CAST(0 AS BIGINT) AS ps,
    CAST(CASE WHEN n > m THEN coalesce((SELECT max(g) FROM gap WHERE gap.rec_id = l.rec_id AND 2 * g > m AND g <= m), m) ELSE n END AS BIGINT) AS pe
  FROM long_ones l
  UNION ALL
  SELECT rec_id, n, ov, m, piece_no + 1, pe - ov,
    CAST(CASE WHEN n - (pe - ov) > m THEN coalesce((SELECT max(g) FROM gap WHERE gap.rec_id = p.rec_id AND 2 * (g - (pe - ov)) > m AND g <= pe - ov + m), pe - ov + m) ELSE n END AS BIGINT)
  FROM piece p WHERE pe < n
)
SELECT rec_id, CAST(piece_no AS INT) AS piece_no, ps AS piece_start, pe AS piece_end FROM piece
"""


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1, "p4_found": P4}
