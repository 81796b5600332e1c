"""Queries of the interval operators: calls, gene extents, neighbours, flanks, attribute maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.functions import attrs as A
from locusframe.operators import annotation
from locusframe.operators import intervals as I
from locusframe.session import read_table, write_once

CALL = ["contig_id", "strand"]


def calls(spark: SparkSession, d: str) -> DataFrame:
    """Each call once, with a usable score and coordinates."""
    t = read_table(spark, d, "transcripts").select("call_id", "contig_id", "strand", "group_id", "tx_start", "tx_end", "score", "n_exons", "transcript_variant")
    return t.filter(F.col("score").isNotNull() & ~F.isnan("score") & F.col("tx_start").isNotNull() & F.col("tx_end").isNotNull()).distinct()


def _grouped(spark, d):
    return write_once(_overlaps(spark, d))


def _overlaps(spark, d):
    return I.overlap_groups(calls(spark, d), CALL, "tx_start", "tx_end", "call_id")


def o_overlap_islands(spark, d):
    return _overlaps(spark, d).select("call_id", "overlap_no")


def o_margin_filter(spark, d):
    return I.within_margin(_grouped(spark, d), [*CALL, "overlap_no"], "score", 0.4).select("call_id", "overlap_no")


def o_anchor_split(spark, d):
    """Loci of the loose survivors, then the strict margin inside each locus."""
    loose = I.within_margin(_grouped(spark, d), [*CALL, "overlap_no"], "score", 0.4).withColumn("_last", F.col("tx_end") - 1)
    loci = write_once(I.anchor_loci(write_once(loose), [*CALL, "overlap_no"], "tx_start", "_last", "score", "call_id"))
    return I.within_margin(loci, [*CALL, "overlap_no", "locus_no"], "score", 0.2).select("call_id", "overlap_no", "locus_no")


def o_overlap_join(spark, d):
    """Genes against annotated flank spans of the same contig and strand."""
    genes = read_table(spark, d, "genes").filter("gene_start < gene_end and strand is not null").select("gene_id", "contig_id", "strand", "gene_start", "gene_end").distinct()
    spans = read_table(spark, d, "splice_table").filter("flank_start <= flank_end").select("splice_id", F.col("chrom").alias("contig_id"), F.when(F.col("strand") == "+", 1).when(F.col("strand") == "-", -1).alias("strand"), (F.col("flank_start") - 1).alias("s"), F.col("flank_end").alias("e")).distinct()
    return I.overlap_join(genes, spans, CALL, ("gene_start", "gene_end"), ("s", "e")).groupBy("gene_id").agg(F.count(F.lit(1)).alias("spans"), F.sum(F.least("gene_end", "e") - F.greatest("gene_start", "s")).alias("bases"))


def features(spark, d):
    """Annotation rows once, with their attributes parsed as the training pipeline does."""
    rows = read_table(spark, d, "gff_features").select("feature_id", "genome_id", "seqid", "feature_type", "feat_start", "feat_end", "strand", "attributes")
    return annotation.parsed(rows.distinct())


def o_attr_parse(spark, d):
    p = F.col("parsed")
    return features(spark, d).filter("attributes is not null").select("feature_id", F.size(p).alias("parts"), A.malformed(p).alias("malformed"), A.value(p, "ID").alias("id"), A.value(p, "Parent").alias("parent"), A.value(p, "gene_id").alias("gene"))


def o_id_precedence(spark, d):
    p = F.col("parsed")
    return features(spark, d).filter(F.col("attributes").isNotNull() & ~A.malformed(p)).select("feature_id", A.gene_name(p).alias("name"), A.is_pseudo(p).alias("pseudo"))


def cds_rows(spark, d):
    mito = read_table(spark, d, "contigs").filter("is_mito").select(F.col("contig_id").alias("seqid"))
    return annotation.cds_rows(features(spark, d), mito)


def o_anti_contigs(spark, d):
    return cds_rows(spark, d).select("feature_id")


def o_contig_sizes(spark, d):
    return annotation.contig_sizes(cds_rows(spark, d))


def gene_extents(spark, d):
    return annotation.gene_extents(cds_rows(spark, d))


def o_gene_extents(spark, d):
    return gene_extents(spark, d).select("seqid", "strand", "name", "start", "end", F.size("exons").alias("n_exons"))


def o_neighbour_asof(spark, d):
    return I.neighbours(gene_extents(spark, d), ["seqid", "strand"], "start", "end", "name").select("seqid", "strand", "name", "start", "end", "upstream", "downstream")


def flanked(spark, d):
    return annotation.flanked(gene_extents(spark, d), o_contig_sizes(spark, d))


def o_flanks(spark, d):
    return flanked(spark, d).select("seqid", "strand", "name", "flank_start", "flank_end", I.enough_flank().alias("enough"))


def o_splice_rows(spark, d):
    return annotation.splice_lines(flanked(spark, d))


def o_allow_list(spark, d):
    """Gene extents of the names that rows of other types carry too."""
    p = F.col("parsed")
    listed = features(spark, d).filter(F.col("attributes").isNotNull() & (F.col("feature_type") != "CDS")).select(A.gene_name(p).alias("name")).filter("name is not null").distinct()
    return gene_extents(spark, d).join(listed, "name", "left_semi").select("seqid", "strand", "name")


_C = """WITH c AS (SELECT DISTINCT call_id, contig_id, strand, group_id, tx_start, tx_end, score, n_exons, transcript_variant FROM transcripts
  WHERE score IS NOT NULL AND NOT isnan(score) AND tx_start IS NOT NULL AND tx_end IS NOT NULL),
p AS (SELECT *, lag(tx_end) OVER (PARTITION BY contig_id, strand ORDER BY tx_start, tx_end, call_id) AS pe FROM c),
g AS (SELECT *, CAST(sum(CASE WHEN tx_start >= pe THEN 1 ELSE 0 END) OVER (PARTITION BY contig_id, strand ORDER BY tx_start, tx_end, call_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS overlap_no FROM p),
m AS (SELECT * FROM (SELECT *, max(score) OVER (PARTITION BY contig_id, strand, overlap_no) AS best FROM g) WHERE best - score <= 0.4)
"""
_F = r"""WITH f0 AS (SELECT DISTINCT feature_id, genome_id, seqid, feature_type, feat_start, feat_end, strand, attributes FROM gff_features),
f1 AS (SELECT *, CASE WHEN feature_type = 'region' THEN CASE WHEN contains(attributes, '=') THEN '=' ELSE ' ' END ELSE CASE WHEN contains(attributes, 'Parent') THEN '=' ELSE ' ' END END AS sep,
  list_transform(string_split(trim(attributes, ';'), ';'), lambda q: trim(q, ' ')) AS parts FROM f0),
f AS (SELECT *, list_transform(parts, lambda q: {'k': CASE WHEN contains(q, sep) THEN split_part(q, sep, 1) END, 'v': CASE WHEN contains(q, sep) THEN substr(q, instr(q, sep) + 1) END}) AS parsed FROM f1),
v AS (SELECT *, len(list_filter(parsed, lambda x: x.v IS NULL)) > 0 AS malformed, list_filter(parsed, lambda x: x.k = 'ID')[-1].v AS id, list_filter(parsed, lambda x: x.k = 'Parent')[-1].v AS parent,
  list_filter(parsed, lambda x: x.k = 'gene_id')[-1].v AS gene, list_filter(parsed, lambda x: x.k = 'name')[-1].v AS nm, list_filter(parsed, lambda x: x.k = 'genome')[-1].v AS genome,
  coalesce(list_filter(parsed, lambda x: x.k = 'pseudo')[-1].v = 'true', false) OR len(list_filter(parsed, lambda x: x.k = 'pseudogene')) > 0 AS pseudo FROM f),
n AS (SELECT *, coalesce(CASE WHEN contains(id, '-') THEN split_part(id, '-', 2) ELSE id END, nm, parent, replace(gene, '"', '')) AS name FROM v),
d AS (SELECT * FROM n WHERE feature_type = 'CDS' AND seqid IS NOT NULL AND feat_start IS NOT NULL AND feat_end IS NOT NULL AND strand IS NOT NULL
  AND seqid NOT IN (SELECT contig_id FROM contigs WHERE is_mito) AND seqid NOT IN (SELECT seqid FROM n WHERE feature_type = 'region' AND lower(genome) = 'mitochondrion' AND seqid IS NOT NULL)),
z AS (SELECT seqid, max(feat_end) AS contig_size FROM d GROUP BY 1),
e0 AS (SELECT seqid, strand, name, list_sort(list({'start': feat_start, 'end': feat_end})) AS exons FROM d WHERE attributes IS NOT NULL AND NOT malformed AND NOT pseudo AND name IS NOT NULL GROUP BY 1, 2, 3),
e AS (SELECT *, exons[1].start AS start, exons[-1].end AS "end" FROM e0),
a AS (SELECT e.*, (SELECT max(q."end") FROM e q WHERE q.seqid = e.seqid AND q.strand = e.strand AND q."end" < e.start) AS upstream,
  (SELECT min(q.start) FROM e q WHERE q.seqid = e.seqid AND q.strand = e.strand AND q.start > e."end") AS downstream FROM e),
k AS (SELECT a.*, contig_size, greatest(start - CASE WHEN strand = '+' THEN 1000 ELSE 500 END, coalesce(upstream, 1), 1) AS flank_start,
  least("end" + CASE WHEN strand = '+' THEN 500 ELSE 1000 END, coalesce(downstream, contig_size), contig_size) AS flank_end FROM a JOIN z USING (seqid)),
w AS (SELECT *, (start - flank_start >= 200 OR flank_start <> 1) AND (flank_end - "end" >= 200 OR flank_end <> contig_size) AS enough FROM k)
"""
SQL = {
    "o_overlap_islands": _C + "SELECT call_id, overlap_no FROM g",
    "o_margin_filter": _C + "SELECT call_id, overlap_no FROM m",
    "o_anchor_split": _C.replace("WITH ", "WITH RECURSIVE ", 1) + """, b AS (SELECT contig_id, strand, overlap_no, tx_start, arg_min(tx_end, (-score, tx_end, call_id)) AS te FROM m GROUP BY ALL),
  l AS (SELECT contig_id, strand, overlap_no, list_sort(list({'s': tx_start, 'e': te - 1})) AS x FROM b GROUP BY ALL),
  r AS (SELECT contig_id, strand, overlap_no, x, 1 AS i, CAST(0 AS BIGINT) AS locus_no, x[1].e AS stop FROM l
        UNION ALL SELECT contig_id, strand, overlap_no, x, i + 1, locus_no + CASE WHEN x[i + 1].s > stop THEN 1 ELSE 0 END, CASE WHEN x[i + 1].s > stop THEN x[i + 1].e ELSE stop END FROM r WHERE i < len(x)),
  t AS (SELECT contig_id, strand, overlap_no, x[i].s AS tx_start, locus_no FROM r),
  j AS (SELECT m.*, t.locus_no, max(score) OVER (PARTITION BY m.contig_id, m.strand, m.overlap_no, t.locus_no) AS top FROM m JOIN t ON m.contig_id IS NOT DISTINCT FROM t.contig_id AND m.strand IS NOT DISTINCT FROM t.strand AND m.overlap_no = t.overlap_no AND m.tx_start = t.tx_start)
SELECT call_id, overlap_no, locus_no FROM j WHERE top - score <= 0.2""",
    "o_overlap_join": """WITH s AS (SELECT DISTINCT splice_id, chrom, CASE strand WHEN '+' THEN 1 WHEN '-' THEN -1 END AS st, flank_start - 1 AS s, flank_end AS e FROM splice_table WHERE flank_start <= flank_end),
q AS (SELECT DISTINCT gene_id, contig_id, strand, gene_start, gene_end FROM genes WHERE gene_start < gene_end AND strand IS NOT NULL)
SELECT gene_id, count(*) AS spans, CAST(sum(least(gene_end, e) - greatest(gene_start, s)) AS BIGINT) AS bases FROM q JOIN s ON contig_id = chrom AND strand = st AND gene_start < e AND s < gene_end GROUP BY 1""",
    "o_attr_parse": _F + "SELECT feature_id, len(parsed) AS parts, malformed, id, parent, gene FROM v WHERE attributes IS NOT NULL",
    "o_id_precedence": _F + "SELECT feature_id, name, pseudo FROM n WHERE attributes IS NOT NULL AND NOT malformed",
    "o_anti_contigs": _F + "SELECT feature_id FROM d",
    "o_contig_sizes": _F + "SELECT * FROM z",
    "o_gene_extents": _F + 'SELECT seqid, strand, name, start, "end", len(exons) AS n_exons FROM e',
    "o_neighbour_asof": _F + 'SELECT seqid, strand, name, start, "end", upstream, downstream FROM a',
    "o_flanks": _F + "SELECT seqid, strand, name, flank_start, flank_end, enough FROM w",
    "o_splice_rows": _F + """SELECT concat_ws(chr(9), replace(name, '"', ''), '0', seqid, strand, flank_start, flank_end, list_aggregate(list_transform(exons, lambda x: x.end || ','), 'string_agg', ''),
  list_aggregate(list_transform(exons, lambda x: x.start || ','), 'string_agg', '')) AS line FROM w WHERE enough""",
    "o_allow_list": _F + "SELECT seqid, strand, name FROM e WHERE name IN (SELECT name FROM n WHERE attributes IS NOT NULL AND feature_type <> 'CDS' AND name IS NOT NULL)",
}


def queries():
    return {n: globals()[n] for n in SQL}


def oracle_sql():
    return dict(SQL)
