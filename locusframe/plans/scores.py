"""Queries over scored calls: thresholds, metrics, genes and their output rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from locusframe.functions import seq as Q
from locusframe.operators import genes as G
from locusframe.operators import intervals as I
from locusframe.operators import metrics as M
from locusframe.operators import threshold as T
from locusframe.operators import training
from locusframe.plans.intervals import calls
from locusframe.session import read_table

LOCUS = ["contig_id", "strand", "group_id"]


def _loci(spark, d):
    return calls(spark, d).filter("group_id is not null")


def o_locus_max(spark, d):
    return T.best_per_locus(_loci(spark, d), LOCUS, "score")


def o_score_histogram(spark, d):
    return T.histogram(T.best_per_locus(_loci(spark, d), LOCUS, "score"), "best", 100)


def o_smooth(spark, d):
    return T.smoothed(o_score_histogram(spark, d), 20).select("bin", F.round("height", 6).alias("height"))


def o_extrema(spark, d):
    """Peaks and valleys of the smoothed histogram of 100 bins."""
    import numpy as np

    peaks, valleys = T.extrema(np.array([r["height"] for r in o_smooth(spark, d).orderBy("bin").collect()]))
    return spark.createDataFrame([(i, "peak") for i in peaks] + [(i, "valley") for i in valleys], "bin int, kind string")


def o_dynamic_threshold(spark, d):
    return spark.createDataFrame([(T.dynamic_threshold(_loci(spark, d), LOCUS, "score"),)], "threshold double")


def o_threshold_filter(spark, d):
    rows = _loci(spark, d)
    return T.above(rows, "score", T.dynamic_threshold(rows, LOCUS, "score")).select("call_id")


def o_gene_rollup(spark, d):
    return G.gene_rollup(_loci(spark, d), LOCUS, "tx_start", "tx_end", "score")


def o_gene_summary(spark, d):
    return G.score_summary(o_gene_rollup(spark, d)).select("genes", "transcripts", F.round("mean_score", 6).alias("mean_score"), F.round("per_gene", 6).alias("per_gene"))


def o_gene_ids(spark, d):
    genes = o_gene_rollup(spark, d).withColumn("_back", -F.col("strand"))
    return G.numbered(genes, ["contig_id", "gene_start", "_back", "group_id"]).select(*LOCUS, "gene_id")


def record_transcripts(spark, d):
    """Training records as genes of one transcript, in the shape of predicted ones."""
    exons = Q.exon_pairs(Q.int_list("jn_end"), Q.int_list("jn_start"))
    score = (F.col("rec_id") % 1000) / 1000.0
    rows = read_table(spark, d, "datafile").filter(F.col("chrom").isNotNull()).select("rec_id", F.col("chrom").alias("contig_id"), F.when(F.col("strand") == "-", -1).otherwise(1).alias("strand"), exons.alias("x"), training.phases(exons, F.col("strand")).alias("ph"), score.alias("score")).distinct()
    sense = F.when(F.col("strand") == -1, F.reverse("x")).otherwise(F.col("x"))
    made = F.zip_with(sense, F.col("ph"), lambda e, p: F.struct((e["start"] - 1).alias("start"), e["end"].alias("end"), F.col("score").alias("score"), p.alias("phase")))
    rows = rows.withColumn("exons", made).withColumn("start", F.element_at("x", 1)["start"] - 1).withColumn("end", F.element_at("x", -1)["end"])
    rows = G.numbered(rows, ["contig_id", "start", "end", "rec_id"])
    return rows.select("gene_id", "contig_id", "strand", F.col("start").alias("gene_start"), F.col("end").alias("gene_end"), F.col("score").alias("gene_score"), F.lit(0).alias("place"), F.lit("PRIMARY").alias("variant"), "score", "start", "end", "exons")


def o_gff_rows(spark, d):
    return G.gff_rows(record_transcripts(spark, d))


def _labelled(spark, d):
    return calls(spark, d).withColumn("y", F.coalesce(F.col("transcript_variant") == "PRIMARY", F.lit(False)))


def o_topkl(spark, d):
    t = M.top_kl(_labelled(spark, d), "score", "y", "call_id")
    return t.select("k", "taken", F.round("accuracy", 9).alias("accuracy"), "threshold")


def o_avg_precision(spark, d):
    return M.average_precision(_labelled(spark, d), "score", "y").select(F.round("ap", 9).alias("ap"), "positives")


def o_masked_ce(spark, d):
    rows = calls(spark, d).filter("score between 0 and 1")
    return rows.agg(F.round(M.masked_cross_entropy(F.col("score"), F.col("group_id").isNotNull()), 6).alias("loss"))


def o_locus_split(spark, d):
    """All loci split by overlap with their primaries; the order of a gene's isoforms."""
    rows = _loci(spark, d).withColumn("bases", F.col("tx_end") - F.col("tx_start"))
    return G.split_by_primary(rows, LOCUS, "tx_start", "tx_end", "score", "bases", "call_id").select("call_id", "part_no", "place")


_L = """WITH c AS (SELECT DISTINCT call_id, contig_id, strand, group_id, tx_start, tx_end, score, n_exons, transcript_variant FROM transcripts
  WHERE score IS NOT NULL AND NOT isnan(score) AND tx_start IS NOT NULL AND tx_end IS NOT NULL),
l AS (SELECT * FROM c WHERE group_id IS NOT NULL), b AS (SELECT contig_id, strand, group_id, max(score) AS best FROM l GROUP BY ALL),
g AS (SELECT contig_id, strand, group_id, min(tx_start) AS gene_start, max(tx_end) AS gene_end, max(score) AS gene_score, count(*) AS n_transcripts FROM l GROUP BY ALL)
"""


def _hist(bins: str, window: str) -> str:
    return f""", z AS (SELECT {bins} AS bins, {window} AS w),
h AS (SELECT CAST(r.range AS INT) AS bin, count(b.best) AS n FROM (SELECT unnest(range(0, (SELECT bins FROM z))) AS range) r
  LEFT JOIN b ON b.best BETWEEN 0 AND 1 AND least(CAST(floor(b.best * (SELECT bins FROM z)) AS BIGINT), (SELECT bins FROM z) - 1) = r.range GROUP BY 1),
s AS (SELECT h.bin, CAST((SELECT sum(q.n) FROM h q WHERE q.bin BETWEEN h.bin - (SELECT w FROM z) // 2 AND h.bin + ((SELECT w FROM z) - 1) // 2) AS DOUBLE) / (SELECT w FROM z) AS height FROM h),
t AS (SELECT bin, sign(lead(height) OVER (ORDER BY bin) - height) AS d FROM s), u AS (SELECT bin, d, lead(d) OVER (ORDER BY bin) AS nd, lead(bin) OVER (ORDER BY bin) AS nb FROM t WHERE d <> 0),
x AS (SELECT CAST((bin + 1 + nb) // 2 AS INT) AS bin, CASE WHEN d < 0 THEN 'valley' ELSE 'peak' END AS kind FROM u WHERE nd IS NOT NULL AND nd <> d)
"""


_FIXED = _hist("CAST(100 AS BIGINT)", "CAST(20 AS BIGINT)")
_RULE = _hist(
    "(SELECT CAST(least(150, greatest(10, floor(sqrt(count(*))))) AS BIGINT) FROM b)",
    "(SELECT CAST(least(30, greatest(5, floor(floor(least(150, greatest(10, floor(sqrt(count(*)))))) * 0.2))) AS BIGINT) FROM b)",
)
_CUT = (
    _RULE
    + """, top AS (SELECT x.bin FROM x JOIN s USING (bin) WHERE kind = 'peak' ORDER BY height DESC, x.bin LIMIT 2), lo AS (SELECT min(bin) AS a, max(bin) AS b2, count(*) AS k FROM top),
v AS (SELECT round((x.bin + 0.5) / (SELECT bins FROM z), 2) AS c FROM x JOIN s USING (bin), lo WHERE kind = 'valley' AND lo.k = 2 AND x.bin > lo.a AND x.bin < lo.b2 AND (x.bin + 0.5) / (SELECT bins FROM z) BETWEEN 0.2 AND 0.8 ORDER BY height, x.bin LIMIT 1),
cut AS (SELECT CASE WHEN (SELECT count(*) FROM b) < 100 THEN 0.5 ELSE coalesce((SELECT c FROM v), 0.5) END AS threshold)
"""
)
SQL = {
    "o_locus_max": _L + "SELECT * FROM b",
    "o_score_histogram": _L + _FIXED + "SELECT * FROM h",
    "o_smooth": _L + _FIXED + "SELECT bin, round(height, 6) AS height FROM s",
    "o_extrema": _L + _FIXED + "SELECT * FROM x",
    "o_dynamic_threshold": _L + _CUT + "SELECT CAST(threshold AS DOUBLE) AS threshold FROM cut",
    "o_threshold_filter": _L + _CUT + "SELECT call_id FROM l WHERE score >= (SELECT threshold FROM cut)",
    "o_gene_rollup": _L + "SELECT * FROM g",
    "o_gene_summary": _L + "SELECT count(*) AS genes, CAST(sum(n_transcripts) AS BIGINT) AS transcripts, round(avg(gene_score), 6) AS mean_score, round(sum(n_transcripts) / count(*), 6) AS per_gene FROM g",
    "o_gene_ids": _L + "SELECT contig_id, strand, group_id, printf('GML%06d', row_number() OVER (ORDER BY contig_id NULLS FIRST, gene_start, -strand NULLS FIRST, group_id)) AS gene_id FROM g",
    "o_locus_split": _L.replace("WITH c", "WITH RECURSIVE c", 1) + """, r AS (SELECT call_id, tx_start AS s, tx_end AS e, hash(contig_id, strand, group_id) AS g,
  row_number() OVER (PARTITION BY hash(contig_id, strand, group_id) ORDER BY tx_end - tx_start DESC, score DESC, tx_start, tx_end, call_id) AS rn FROM l),
f AS (SELECT g, rn, call_id, s, 1 AS home, [{'s': s, 'e': e}] AS firsts FROM r WHERE rn = 1
  UNION ALL SELECT g, rn, call_id, s, CASE WHEN h = 0 THEN len(firsts) + 1 ELSE h END, CASE WHEN h = 0 THEN list_append(firsts, {'s': s, 'e': e}) ELSE firsts END
  FROM (SELECT r.*, f.firsts, coalesce(list_position(list_transform(f.firsts, lambda p: r.s < p.e AND p.s < r.e), true), 0) AS h FROM f JOIN r ON r.g = f.g AND r.rn = f.rn + 1)),
p AS (SELECT g, home, min(s) AS low FROM f GROUP BY ALL), n AS (SELECT g, home, row_number() OVER (PARTITION BY g ORDER BY low, home) - 1 AS part_no FROM p)
SELECT call_id, CAST(part_no AS INT) AS part_no, CAST(row_number() OVER (PARTITION BY f.g, f.home ORDER BY rn) - 1 AS INT) AS place FROM f JOIN n ON n.g = f.g AND n.home = f.home""",
    "o_gff_rows": """WITH r AS (SELECT DISTINCT rec_id, chrom, strand, jn_start, jn_end FROM datafile WHERE chrom IS NOT NULL),
x AS (SELECT *, list_sort(list_transform(range(1, len(string_split(rtrim(jn_end, ','), ',')) + 1),
  lambda i: {'start': CAST(trim(string_split(rtrim(jn_end, ','), ',')[i]) AS BIGINT), 'end': CAST(trim(string_split(rtrim(jn_start, ','), ',')[i]) AS BIGINT)})) AS e FROM r),
q AS (SELECT *, CASE WHEN strand = '-' THEN list_reverse(e) ELSE e END AS o, printf('%.3f', (rec_id % 1000) / 1000.0) AS sc, CASE WHEN strand = '-' THEN '-' ELSE '+' END AS st,
  printf('GML%06d', row_number() OVER (ORDER BY chrom, e[1].start, e[-1].end, rec_id)) AS gene_id FROM x),
p AS (SELECT *, unnest(range(1, len(o) + 1)) AS i FROM q),
f AS (SELECT *, (3 - coalesce(list_sum(list_transform(o[1:i - 1], lambda y: y.end + 1 - y.start)), 0) % 3) % 3 AS ph FROM p)
SELECT gene_id, CAST(0 AS BIGINT) AS row_no, chrom AS seqid, 'locusframe' AS source, 'gene' AS feature_type, e[1].start AS start, e[-1].end AS "end", sc AS score, st AS strand, '.' AS phase, 'ID=' || gene_id AS attributes FROM q
UNION ALL SELECT gene_id, 100000, chrom, 'locusframe', 'mRNA', e[1].start, e[-1].end, sc, st, '.', 'ID=' || gene_id || '_mRNA1;Parent=' || gene_id || ';TranscriptVariant=PRIMARY' FROM q
UNION ALL SELECT gene_id, 100000 + 2 * i - 1, chrom, 'locusframe', 'exon', o[i].start, o[i].end, sc, st, '.', 'ID=' || gene_id || '_mRNA1_exon' || i || ';Parent=' || gene_id || '_mRNA1' FROM f
UNION ALL SELECT gene_id, 100000 + 2 * i, chrom, 'locusframe', 'CDS', o[i].start, o[i].end, sc, st, CAST(CAST(ph AS INT) AS VARCHAR), 'ID=' || gene_id || '_mRNA1_CDS' || i || ';Parent=' || gene_id || '_mRNA1' FROM f""",
    "o_topkl": _L + """, y AS (SELECT *, coalesce(transcript_variant = 'PRIMARY', false) AS y FROM c), t AS (SELECT count(*) FILTER (y) AS p, count(*) AS n FROM y),
r AS (SELECT *, row_number() OVER (ORDER BY score DESC, call_id) AS rn FROM y), k AS (SELECT unnest([0.5, 1.0, 2.0, 4.0])::DOUBLE AS k), j AS (SELECT k, least(CAST(floor(k * p) AS BIGINT), n) AS taken, p FROM k, t)
SELECT k, taken, round(count(*) FILTER (y) / least(taken, any_value(p)), 9) AS accuracy, min(score) AS threshold FROM j LEFT JOIN r ON rn <= taken GROUP BY k, taken""",
    "o_avg_precision": _L + """, y AS (SELECT score, count(*) AS n, count(*) FILTER (coalesce(transcript_variant = 'PRIMARY', false)) AS h FROM c GROUP BY 1),
r AS (SELECT *, sum(n) OVER (ORDER BY score DESC) AS sn, sum(h) OVER (ORDER BY score DESC) AS sh FROM y)
SELECT round(coalesce(sum(CAST(h AS DOUBLE) * sh / sn) / sum(h), 0), 9) AS ap, CAST(sum(h) AS BIGINT) AS positives FROM r""",
    "o_masked_ce": _L + "SELECT round(sum(-ln(score + 1e-10)) FILTER (group_id IS NOT NULL) / (count(*) FILTER (group_id IS NOT NULL) + 1e-8), 6) AS loss FROM c WHERE score BETWEEN 0 AND 1",
}


def queries():
    return {n: globals()[n] for n in SQL}


def oracle_sql():
    return dict(SQL)
