"""Queries of what is read from and written to files, and of the data sets made for training, over lines made of the tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from locusframe import schema as S
from locusframe.functions import seq as Q
from locusframe.operators import genes as G
from locusframe.operators import metrics, tracks, training
from locusframe.plans.scores import record_transcripts
from locusframe.plans.sequences import _R
from locusframe.plans.tracks import _contigs
from locusframe.session import read_table
from locusframe.sources import fasta, sinks, tables


def _records(spark, d):
    return read_table(spark, d, "datafile").filter(F.length("seq") > 0).dropDuplicates(["rec_id"])


def _exons():
    return Q.exon_pairs(Q.int_list("jn_end"), Q.int_list("jn_start"))


def _fasta(spark, d):
    """The records as a sequence file parts it, wrapped at sixty letters, with remarks and both kinds of line ends."""
    wrapped = F.regexp_replace("seq", "(.{60})", "$1\r\n")
    return fasta.fasta_records(_records(spark, d).select(F.concat(F.col("rec_id").cast("string"), F.lit(" of "), F.coalesce("genome_id", F.lit("-")), F.lit("\n"), wrapped).alias("value")))


def o_fasta_scan(spark, d):
    """Identifier, length and letters of every record of a sequence file."""
    return fasta.contigs(_fasta(spark, d), check=False).select("contig_id", F.col("length").cast("bigint").alias("length"), F.md5("seq").alias("digest"))


def o_contig_filter(spark, d):
    """Asked-for contigs that are there, and those that aren't (an error on the command line)."""
    asked = read_table(spark, d, "splice_table").select(F.col("chrom").alias("contig_id")).filter("contig_id is not null").distinct()
    there = read_table(spark, d, "contigs").filter(~F.coalesce("is_mito", F.lit(False))).select("contig_id")
    found, missing = fasta.matched(there, asked)
    return found.distinct().withColumn("found", F.lit(True)).unionByName(missing.withColumn("found", F.lit(False)))


def o_genome_size(spark, d):
    return fasta.sizes(read_table(spark, d, "contigs"), F.col("contig_len"), ("genome_id",))


def o_gff_scan(spark, d):
    lines = read_table(spark, d, "gff_raw").select("line_id", F.col("raw_line").alias("value")).distinct()
    return tables.gff_lines(lines, ("line_id",))


def o_allow_scan(spark, d):
    rows = read_table(spark, d, "splice_table")
    some = rows.select(F.concat(F.lit('"'), "gene_name", F.lit('" \tnote')).alias("value"))
    return tables.allow_list(some.unionByName(rows.select(F.concat(F.lit("# "), "gene_name").alias("value"))))


def o_splice_scan(spark, d):
    """Splice-table lines of the records, read back; those of other genomes have a column too few."""
    cells = ["gene_name", F.col("paralog").cast("string"), "chrom", "strand", F.col("cds_start").cast("string"), F.col("cds_end").cast("string"), "jn_start"]
    filled = [F.coalesce(c, F.lit("")) for c in cells]
    whole = F.concat_ws("\t", *filled, F.coalesce("jn_end", F.lit("")))
    lines = _records(spark, d).select(F.when(F.col("rec_id") % 7 == 0, F.concat_ws("\t", *filled)).otherwise(whole).alias("value"))
    return tables.splice_rows(lines)


def o_region_scan(spark, d):
    lines = _records(spark, d).filter("chrom is not null").select(F.concat("chrom", F.lit(":"), F.col("cds_start").cast("string"), F.lit("-"), F.col("cds_end").cast("string"), F.lit("\t"), "seq").alias("value"))
    return tables.region_rows(lines).select("chrom", "region_start", "region_end", F.md5("seq").alias("digest"))


def o_gff_lines(spark, d):
    """The lines of an annotation file of the records, with its head."""
    contigs = read_table(spark, d, "contigs").select("contig_id", F.col("contig_len").alias("length"), F.col("contig_len").alias("contig_ord")).distinct()
    return sinks.gff_lines(G.gff_rows(record_transcripts(spark, d)), contigs, 0.5).select("part", "value")


def _cds(spark, d):
    """Each record as a contig with one transcript."""
    rows = _records(spark, d).withColumn("x", _exons())
    inside = rows.filter((F.size("x") > 0) & ~F.exists("x", lambda e: (e["start"] < F.col("seq_start")) | (e["end"] - F.col("seq_start") + 1 > F.length("seq"))))
    moved = F.transform("x", lambda e: F.struct((e["start"] - F.col("seq_start")).alias("start"), (e["end"] - F.col("seq_start") + 1).alias("end")))
    made = inside.select(F.col("rec_id").cast("string").alias("gene_id"), F.col("rec_id").alias("contig_id"), F.lit(0).alias("place"), F.when(F.col("strand") == "-", -1).otherwise(1).alias("strand"), moved.alias("exons"))
    return sinks.cds_of(made, inside.select(F.col("rec_id").alias("contig_id"), F.upper("seq").alias("seq")))


def o_cds_build(spark, d):
    return _cds(spark, d).select("gene_id", F.length("cds").alias("n"), F.md5("cds").alias("digest"))


def o_fasta_lines(spark, d):
    return sinks.fasta_lines(_cds(spark, d), "cds").select(F.md5("value").alias("digest"))


def o_structure(spark, d):
    """Broken rules of structure among the records as transcripts, and the gene spans of their names."""
    rows = _records(spark, d).select("genome_id", "gene_name", F.col("cds_start").alias("start"), F.col("cds_end").alias("end"), _exons().alias("exons")).filter("genome_id is not null and gene_name is not null")
    spans = read_table(spark, d, "splice_table").filter("genome_id is not null and gene_name is not null").groupBy("genome_id", "gene_name").agg(F.min("flank_start").alias("gene_start"), F.max("flank_end").alias("gene_end"))
    return G.violations(rows, spans, ["genome_id", "gene_name"])


def letter_scorer(context: int):
    """Scores that can be told from three neighbouring letters; a stand-in that SQL can check."""
    half = context // 2

    def make():
        def score(padded: str) -> np.ndarray:
            code = np.frombuffer(padded.encode(), np.uint8).astype(np.int64)
            n = len(code) - context
            before, own, after = (code[half + k : half + k + n] for k in (-1, 0, 1))
            return np.stack([(own * (11 + c) + before * 3 + after * 5) % 1000 for c in range(7)])

        return score

    return make


def o_scored_tiles(spark, d):
    """Scores of both strands in tiles of 1,000 with a context of 2,000, summed by record and strand."""
    t = tracks.scored(tracks.sequence_tiles(_contigs(spark, d), 1000, 2000), letter_scorer(2000), 2000)
    at = lambda c: F.aggregate(F.transform(F.col("p")[c], lambda x, i: x.cast("double") * ((F.col("tile_start") + i) % 97)), F.lit(0.0), lambda a, x: a + x)
    total = lambda c: F.aggregate(F.col("p")[c], F.lit(0.0), lambda a, x: a + x.cast("double"))
    sums = [F.sum(f(c)).cast("bigint").alias(f"{n}_{k}") for c, k in enumerate(S.CLASSES) for n, f in (("sum", total), ("mixed", at))]
    return t.groupBy("contig_id", F.col("strand").cast("int").alias("strand")).agg(F.sum(F.length("letters")).alias("bases"), *sums)


def _points(spark, d):
    rows = _records(spark, d).select("rec_id", "seq", "seq_start", "strand", "cds_start", "cds_end", _exons().alias("exons"))
    return training.datapoints(rows, 5000, 800)


def o_datapoints(spark, d):
    """Windows and labels of all records: how often each code occurs in each window."""
    times = lambda c, k: F.size(F.filter(c, lambda v: v == k))
    return _points(spark, d).select("rec_id", "tile_no", *[times("x", k).alias(f"x{k}") for k in range(5)], *[times("y", k).alias(f"y{k}") for k in range(8)])


def o_chunks(spark, d):
    """The chunk of every record and whether it is for training."""
    return training.in_chunks(_records(spark, d).select("rec_id"), "rec_id", 20, seed=5)


def o_epoch_order(spark, d):
    """The order of the records in the third epoch."""
    return training.epoch_order(o_chunks(spark, d).filter("use = 'train'"), "chunk", ["rec_id"], 3).select("rec_id", "pool_no", "place")


def o_evaluation(spark, d):
    """Metrics of the six classes on a seeded sample of records, as an evaluation takes it, with made scores."""
    rows = _records(spark, d).filter("genome_id is not null").select("rec_id", "genome_id", "strand", "cds_start", "cds_end", _exons().alias("exons"))
    labels = training.label_raster(training.sampled(rows, "rec_id", "genome_id", 2, seed=3), "rec_id")
    at = labels.select("rec_id", F.posexplode(F.split("labels", "")).alias("pos", "y"))
    made = lambda c: (F.col("pos") * (37 + 2 * c) + F.col("rec_id") * 7 + c * 101) % 1000
    points = at.select((F.col("rec_id") * 100_000 + F.col("pos")).alias("tie"), "y", F.inline(F.array(*[F.struct(F.lit(c).alias("kind"), made(c).alias("score")) for c in range(1, 7)])))
    rated = metrics.evaluation(points.withColumn("hit", F.col("y") == F.col("kind").cast("string")), "kind", "score", "hit", "tie")
    return rated.select("kind", "k", "taken", F.round("accuracy", 9).alias("accuracy"), F.col("threshold").cast("bigint").alias("threshold"), F.round("ap", 9).alias("ap"), "positives")


_LABELS = """, g AS (SELECT rec_id, genome_id, strand, cds_start, cds_end, exons, unnest(range(cds_start, cds_end + 1)) AS c FROM x0),
e AS (SELECT rec_id, CASE WHEN strand = '-' THEN cds_end - c ELSE c - cds_start END AS pos, CASE
  WHEN c = exons[-1].end THEN CASE WHEN strand = '-' THEN 3 ELSE 4 END WHEN c = exons[1].start THEN CASE WHEN strand = '-' THEN 4 ELSE 3 END
  WHEN len(list_filter(exons, lambda q: q.start = c)) > 0 THEN CASE WHEN strand = '-' THEN 2 ELSE 1 END
  WHEN len(list_filter(exons, lambda q: q.end = c)) > 0 THEN CASE WHEN strand = '-' THEN 1 ELSE 2 END
  WHEN len(list_filter(range(1, len(exons)), lambda i: exons[i].end <= c AND c < exons[i + 1].start)) > 0 THEN 6
  WHEN len(list_filter(exons, lambda q: q.start <= c AND c < q.end)) > 0 THEN 5 ELSE 0 END AS y FROM g)
"""
_HEX = lambda c: f"CAST('0x' || substr({c}, 1, 8) AS BIGINT)"
_CHUNKS = f"""WITH r AS (SELECT DISTINCT rec_id FROM datafile WHERE length(seq) > 0), n AS (SELECT CAST(ceil(count(*) / 20.0) AS BIGINT) AS k FROM r),
c AS (SELECT rec_id, CAST({_HEX("md5('5:' || rec_id)")} % k AS INT) AS chunk FROM r, n),
u AS (SELECT rec_id, chunk, CASE WHEN {_HEX("md5('5/' || chunk)")} / 4294967296.0 < 0.1 THEN 'valid' ELSE 'train' END AS use FROM c)
"""
_GFF_ROWS = """WITH r AS (SELECT DISTINCT rec_id, chrom, strand, jn_start, jn_end FROM datafile WHERE chrom IS NOT NULL),
x AS (SELECT *, list_sort(list_transform(range(1, len(string_split(rtrim(jn_end, ','), ',')) + 1),
  lambda i: {'start': CAST(trim(string_split(rtrim(jn_end, ','), ',')[i]) AS BIGINT), 'end': CAST(trim(string_split(rtrim(jn_start, ','), ',')[i]) AS BIGINT)})) AS e FROM r),
q AS (SELECT *, CASE WHEN strand = '-' THEN list_reverse(e) ELSE e END AS o, printf('%.3f', (rec_id % 1000) / 1000.0) AS sc, CASE WHEN strand = '-' THEN '-' ELSE '+' END AS st,
  printf('GML%06d', row_number() OVER (ORDER BY chrom, e[1].start, e[-1].end, rec_id)) AS gene_id FROM x),
p AS (SELECT *, unnest(range(1, len(o) + 1)) AS i FROM q),
f AS (SELECT *, (3 - coalesce(list_sum(list_transform(o[1:i - 1], lambda y: y.end + 1 - y.start)), 0) % 3) % 3 AS ph FROM p),
l AS (SELECT chrom, concat_ws(chr(9), chrom, 'locusframe', 'gene', e[1].start, e[-1].end, sc, st, '.', 'ID=' || gene_id) AS value FROM q
UNION ALL SELECT chrom, concat_ws(chr(9), chrom, 'locusframe', 'mRNA', e[1].start, e[-1].end, sc, st, '.', 'ID=' || gene_id || '_mRNA1;Parent=' || gene_id || ';TranscriptVariant=PRIMARY') FROM q
UNION ALL SELECT chrom, concat_ws(chr(9), chrom, 'locusframe', 'exon', o[i].start, o[i].end, sc, st, '.', 'ID=' || gene_id || '_mRNA1_exon' || i || ';Parent=' || gene_id || '_mRNA1') FROM f
UNION ALL SELECT chrom, concat_ws(chr(9), chrom, 'locusframe', 'CDS', o[i].start, o[i].end, sc, st, CAST(ph AS INT), 'ID=' || gene_id || '_mRNA1_CDS' || i || ';Parent=' || gene_id || '_mRNA1') FROM f),
c AS (SELECT DISTINCT contig_id, contig_len FROM contigs)
"""
_NEAR = ", ".join(f"CAST(sum((v * {11 + c} + b * 3 + a * 5) % 1000) AS BIGINT) AS sum_{k}, CAST(sum((v * {11 + c} + b * 3 + a * 5) % 1000 * (pos % 97)) AS BIGINT) AS mixed_{k}" for c, k in enumerate(S.CLASSES))
SQL = {
    "o_fasta_scan": _R + "SELECT CAST(rec_id AS VARCHAR) AS contig_id, length(u) AS length, md5(u) AS digest FROM r",
    "o_contig_filter": """WITH a AS (SELECT DISTINCT chrom AS contig_id FROM splice_table WHERE chrom IS NOT NULL) SELECT contig_id, contig_id IN (SELECT contig_id FROM contigs WHERE contig_id IS NOT NULL AND NOT coalesce(is_mito, false)) AS found FROM a""",
    "o_genome_size": "SELECT genome_id, CAST(sum(contig_len) AS BIGINT) AS bases, count(*) AS contigs FROM contigs GROUP BY genome_id",
    "o_gff_scan": """WITH l AS (SELECT DISTINCT line_id, raw_line, string_split(rtrim(raw_line, chr(13) || chr(10)), chr(9)) AS f FROM gff_raw WHERE NOT starts_with(raw_line, '#') AND trim(translate(raw_line, chr(13) || chr(10) || chr(9), '')) <> '')
SELECT line_id, f[1] AS seqid, f[2] AS source, f[3] AS feature_type, CASE WHEN regexp_full_match(trim(f[4]), '[+-]?[0-9]+') THEN TRY_CAST(trim(f[4]) AS BIGINT) END AS "start",
  CASE WHEN regexp_full_match(trim(f[5]), '[+-]?[0-9]+') THEN TRY_CAST(trim(f[5]) AS BIGINT) END AS "end", f[6] AS score, f[7] AS strand, f[8] AS phase, f[9] AS attributes FROM l""",
    "o_allow_scan": "SELECT DISTINCT trim(replace(gene_name, '\"', '')) AS name FROM splice_table WHERE gene_name IS NOT NULL",
    "o_splice_scan": """WITH r AS (SELECT DISTINCT rec_id, gene_name, paralog, chrom, strand, cds_start, cds_end, jn_start, jn_end FROM datafile WHERE length(seq) > 0),
n AS (SELECT *, list_transform(list_filter(string_split(coalesce(jn_start, ''), ','), lambda z: trim(z) <> ''), lambda z: CAST(trim(z) AS BIGINT)) AS exon_ends,
  list_transform(list_filter(string_split(coalesce(jn_end, ''), ','), lambda z: trim(z) <> ''), lambda z: CAST(trim(z) AS BIGINT)) AS starts FROM r)
SELECT coalesce(gene_name, '') AS name, paralog, coalesce(chrom, '') AS chrom, coalesce(strand, '') AS strand, cds_start AS flank_start, cds_end AS flank_end, exon_ends,
  CASE WHEN rec_id % 7 <> 0 THEN starts END AS exon_starts, CASE WHEN rec_id % 7 = 0 THEN 'invalid_format' END AS reason FROM n""",
    "o_region_scan": _R + "SELECT chrom, cds_start AS region_start, cds_end AS region_end, md5(seq) AS digest FROM r WHERE chrom IS NOT NULL",
    "o_gff_lines": _GFF_ROWS + """SELECT 0 AS part, '##gff-version 3.1.26' AS value UNION ALL SELECT 0, '##mean-gene-score 0.500'
UNION ALL SELECT 1, '##sequence-region ' || contig_id || ' 1 ' || contig_len FROM c WHERE contig_id IN (SELECT chrom FROM l) UNION ALL SELECT 2, value FROM l JOIN c ON contig_id = chrom""",
    "o_cds_build": _R + "SELECT CAST(rec_id AS VARCHAR) AS gene_id, length(cds) AS n, md5(cds) AS digest FROM k WHERE cds IS NOT NULL",
    "o_fasta_lines": _R + "SELECT md5('>' || rec_id || '_mRNA1' || chr(10) || cds) AS digest FROM k WHERE cds IS NOT NULL",
    "o_structure": _R.replace("rec_id, chrom,", "rec_id, genome_id, gene_name, chrom,", 1) + """, t AS (SELECT * FROM x WHERE genome_id IS NOT NULL AND gene_name IS NOT NULL),
g AS (SELECT genome_id, gene_name, min(flank_start) AS gene_start, max(flank_end) AS gene_end FROM splice_table WHERE genome_id IS NOT NULL AND gene_name IS NOT NULL GROUP BY ALL),
m AS (SELECT genome_id, gene_name, min(cds_start) AS a, max(cds_end) AS b FROM t GROUP BY ALL), j AS (SELECT g.*, m.a, m.b FROM g LEFT JOIN m USING (genome_id, gene_name))
SELECT 'transcript without exon' AS what, count(*) FILTER (len(exons) = 0) AS rows FROM t
UNION ALL SELECT 'exon outside its transcript', count(*) FILTER (len(list_filter(exons, lambda q: q.start < cds_start OR q.end > cds_end OR q.start >= q.end)) > 0) FROM t
UNION ALL SELECT 'gene without transcript', count(*) FILTER (a IS NULL) FROM j UNION ALL SELECT 'transcript outside its gene', count(*) FILTER (a < gene_start OR b > gene_end) FROM j""",
    "o_scored_tiles": _R + f""", y AS (SELECT rec_id, 1 AS strand, replace(c, 'U', 'T') AS s FROM r UNION ALL SELECT rec_id, -1, translate(reverse(replace(c, 'U', 'T')), 'ACGT', 'TGCA') FROM r),
z AS (SELECT rec_id, strand, unnest(range(0, length(s))) AS pos, unnest(string_split(s, '')) AS ch FROM y),
w AS (SELECT rec_id, strand, pos, ascii(ch) AS v, ascii(lag(ch, 1, 'N') OVER l) AS b, ascii(lead(ch, 1, 'N') OVER l) AS a FROM z WINDOW l AS (PARTITION BY rec_id, strand ORDER BY pos))
SELECT CAST(rec_id AS VARCHAR) AS contig_id, strand, count(*) AS bases, {_NEAR} FROM w GROUP BY rec_id, strand""",
    "o_datapoints": _R.replace("rec_id, chrom,", "rec_id, genome_id, chrom,", 1) + ", x0 AS (SELECT * FROM x WHERE len(exons) > 0 AND cds_start <= cds_end)" + _LABELS + """, v AS (SELECT rec_id, CASE WHEN strand = '-' THEN translate(reverse(u), 'ACGT', 'TGCA') ELSE u END AS s,
  CASE WHEN strand = '-' THEN seq_start + length(seq) - 1 - cds_end ELSE cds_start - seq_start END AS t0, unnest(range(0, CAST(ceil((cds_end - cds_start + 1) / 5000.0) AS BIGINT))) AS i FROM x0),
p AS (SELECT rec_id, i, t0 + i * 5000 - 400 AS a, t0 + (i + 1) * 5000 + 400 AS b, s FROM v),
q AS (SELECT rec_id, i, CASE WHEN least(b, length(s)) > greatest(a, 0) THEN substr(s, CAST(greatest(a, 0) + 1 AS INT), CAST(least(b, length(s)) - greatest(a, 0) AS INT)) ELSE '' END AS w FROM p),
n AS (SELECT rec_id, i, """ + ", ".join(f"5800 - (5800 - length(w)) - length(replace(w, '{c}', '')) AS x{k}" for k, c in enumerate("ACGT")) + """ FROM q),
l AS (SELECT rec_id, pos // 5000 AS i, """ + ", ".join(f"count(*) FILTER (y = {k}) AS y{k}" for k in range(7)) + """, 5000 - count(*) AS y7 FROM e GROUP BY 1, 2)
SELECT n.rec_id, CAST(n.i AS INT) AS tile_no, x0, x1, x2, x3, 5800 - x0 - x1 - x2 - x3 AS x4, """ + ", ".join(f"y{k}" for k in range(8)) + " FROM n JOIN l ON l.rec_id = n.rec_id AND l.i = n.i",
    "o_chunks": _CHUNKS + "SELECT * FROM u",
    "o_epoch_order": _CHUNKS + """, t AS (SELECT * FROM u WHERE use = 'train'), o AS (SELECT chunk, CAST((row_number() OVER (ORDER BY md5('3:' || chunk), chunk) - 1) // 4 AS INT) AS pool_no FROM (SELECT DISTINCT chunk FROM t))
SELECT rec_id, pool_no, CAST(row_number() OVER (PARTITION BY pool_no ORDER BY md5('3:' || rec_id), rec_id) - 1 AS INT) AS place FROM t JOIN o USING (chunk)""",
    "o_evaluation": _R.replace("rec_id, chrom,", "rec_id, genome_id, chrom,", 1) + """, o AS (SELECT *, row_number() OVER (PARTITION BY genome_id ORDER BY md5('3:' || rec_id), rec_id) AS nth FROM x WHERE genome_id IS NOT NULL),
x0 AS (SELECT * FROM o WHERE nth <= 2 AND len(exons) > 0 AND cds_start <= cds_end)""" + _LABELS + """, ss AS (SELECT kind, (pos * (37 + 2 * kind) + rec_id * 7 + kind * 101) % 1000 AS score, y = kind AS hit, rec_id * 100000 + pos AS tie FROM e, (SELECT unnest(range(1, 7)) AS kind)),
t AS (SELECT kind, count(*) AS n, count(*) FILTER (hit) AS p FROM ss GROUP BY 1), kk AS (SELECT t.*, unnest([0.5, 1.0, 2.0, 4.0])::DOUBLE AS k FROM t), j AS (SELECT *, least(CAST(floor(k * p) AS BIGINT), n) AS taken FROM kk),
w AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY score DESC, tie) AS rn FROM ss),
y AS (SELECT kind, score, count(*) AS n, count(*) FILTER (hit) AS h FROM ss GROUP BY 1, 2), a AS (SELECT kind, h, sum(n) OVER q AS sn, sum(h) OVER q AS sh FROM y WINDOW q AS (PARTITION BY kind ORDER BY score DESC)),
b AS (SELECT kind, round(coalesce(sum(CAST(h AS DOUBLE) * sh / sn) / nullif(sum(h), 0), 0), 9) AS ap, CAST(sum(h) AS BIGINT) AS positives FROM a GROUP BY 1)
SELECT CAST(j.kind AS INT) AS kind, k, taken, round(count(*) FILTER (hit) / nullif(least(taken, any_value(p)), 0), 9) AS accuracy, min(score) AS threshold, any_value(ap) AS ap, any_value(positives) AS positives
FROM j LEFT JOIN w ON w.kind = j.kind AND rn <= taken JOIN b ON b.kind = j.kind GROUP BY j.kind, k, taken""",
}


def queries():
    return {n: globals()[n] for n in SQL}


def oracle_sql():
    return dict(SQL)
