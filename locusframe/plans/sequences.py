"""Queries of the sequence algebra over the training records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.functions import seq as Q
from locusframe.operators import training
from locusframe.session import read_table


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with a sequence; re-sent ones are made one by each query, after its narrow result."""
    return read_table(spark, sf_dir, "datafile").filter(F.length("seq") > 0)


def _exons():
    return Q.exon_pairs(Q.int_list("jn_end"), Q.int_list("jn_start"))


def o_contig_scan(spark, d):
    return _records(spark, d).select("rec_id", F.length("seq").alias("n"), F.md5(Q.clean("seq")).alias("digest")).distinct()


def o_ambiguity_clean(spark, d):
    c = Q.clean("seq")
    count_n = F.length(c) - F.length(F.replace(c, F.lit("N"), F.lit("")))
    return _records(spark, d).select("rec_id", count_n.alias("n_count"), F.array_join(Q.invalid_letters("seq"), "").alias("invalid")).distinct()


def o_revcomp(spark, d):
    return _records(spark, d).select("rec_id", F.md5(Q.reverse_complement(Q.clean("seq"))).alias("digest")).distinct()


def o_codon_start_stop(spark, d):
    return _records(spark, d).select("rec_id", Q.is_start("seq").alias("starts"), Q.ends_with_stop("seq").alias("stops")).distinct()


def o_stop_counts(spark, d):
    return _records(spark, d).select("rec_id", Q.stop_count("seq").alias("stops"), Q.internal_stops("seq").alias("inside")).distinct()


def o_translate(spark, d):
    return _records(spark, d).select("rec_id", F.md5(Q.translated("seq")).alias("digest"), Q.protein("seq", strict=False).alias("protein")).distinct()


def o_train_base_codes(spark, d):
    return _records(spark, d).select("rec_id", F.md5(Q.training_digits("seq")).alias("digest")).distinct()


def o_base_codes(spark, d):
    codes = F.array_join(Q.base_codes("seq"), "")
    return _records(spark, d).select("rec_id", F.md5(codes).alias("digest")).distinct()


def o_spliced_cds(spark, d):
    cds = Q.spliced("seq", "seq_start", _exons(), "strand")
    return _records(spark, d).select("rec_id", F.length(cds).alias("n"), F.md5(cds).alias("digest"), Q.downstream_triplet("seq", "seq_start", _exons(), "strand").alias("after")).distinct()


def o_region_fetch(spark, d):
    region = Q.slice_between("seq", F.col("cds_start") - F.col("seq_start"), F.col("cds_end") - F.col("seq_start") + 1)
    return _records(spark, d).select("rec_id", F.md5(region).alias("digest")).distinct()


def o_cds_validate(spark, d):
    rows = _records(spark, d).select("rec_id", Q.spliced("seq", "seq_start", _exons(), "strand").alias("cds")).distinct()
    return rows.select("rec_id", Q.cds_reason("cds").alias("reason"), Q.cds_reason("cds", need_stop=False).alias("lenient"), Q.cds_reason("cds", compat=False).alias("full"))


def o_reason_counts(spark, d):
    return o_cds_validate(spark, d).groupBy("reason").agg(F.count(F.lit(1)).alias("records"))


def _extended(spark, d, threshold):
    rows = _records(spark, d).select("rec_id", "strand", "seq", "seq_start", _exons().alias("exons")).dropDuplicates(["rec_id"])
    return training.extend_stops(rows, threshold).select("rec_id", "reason", "extended", F.element_at("exons", 1)["start"].alias("first_start"), F.element_at("exons", -1)["end"].alias("last_end"))


def o_stop_extension(spark, d):
    """Records whose CDS gets its stop from the triplet after it, with the moved exon bound, whatever their share."""
    return _extended(spark, d, 0.0)


def o_stop_rule(spark, d):
    """The same if nine tenths of the faults are missing stops, on the records and on those without other faults."""
    whole = _extended(spark, d, 0.9).select("rec_id", F.lit("all").alias("rows"), "reason", "extended")
    sound = _records(spark, d).select("rec_id", "strand", "seq", "seq_start", _exons().alias("exons")).dropDuplicates(["rec_id"])
    sound = sound.filter(Q.cds_reason(Q.spliced("seq", "seq_start", F.col("exons"), "strand")).isin("valid", "no_terminal_stop"))
    return whole.unionByName(training.extend_stops(sound, 0.9).select("rec_id", F.lit("sound").alias("rows"), "reason", "extended"))


def o_introns(spark, d):
    return _records(spark, d).select("rec_id", F.explode(training.introns(_exons())).alias("i")).select("rec_id", F.col("i.start").alias("intron_start"), F.col("i.end").alias("intron_end")).distinct()


def o_cds_length(spark, d):
    return _records(spark, d).select("rec_id", training.cds_length(_exons()).alias("bases"), F.size(_exons()).alias("exons")).distinct()


def o_phase(spark, d):
    return _records(spark, d).select("rec_id", F.posexplode(training.phases(_exons(), F.col("strand")))).select("rec_id", F.col("pos").alias("exon_no"), F.col("col").alias("phase")).distinct()


def o_intron_sets(spark, d):
    """Introns of a record that no record of the same contig and strand before it has, and the shared ones."""
    ranks = _records(spark, d).select("rec_id", "chrom", "strand", training.introns(_exons()).alias("own")).distinct()
    owners = ranks.select("chrom", "strand", "rec_id", F.explode("own").alias("i")).groupBy("chrom", "strand", "i").agg(F.min("rec_id").alias("first"))
    each = ranks.select("chrom", "strand", "rec_id", F.explode("own").alias("i")).distinct().join(owners, ["chrom", "strand", "i"])
    return each.groupBy("rec_id").agg(F.count_if(F.col("first") < F.col("rec_id")).alias("shared"), F.count_if(F.col("first") == F.col("rec_id")).alias("own"))


def o_window_tiles(spark, d):
    return training.window_tiles(_records(spark, d), block=5000, context=800).select("rec_id", "tile_no", "tile_start", F.md5("window").alias("digest")).distinct()


def o_label_raster(spark, d):
    rows = _records(spark, d).select("rec_id", "strand", "cds_start", "cds_end", _exons().alias("exons"))
    return training.label_raster(rows, "rec_id").select("rec_id", F.length("labels").alias("n"), F.md5("labels").alias("digest")).distinct()


def o_split_mod5(spark, d):
    """Every fifth record by number goes to the test part."""
    return _records(spark, d).select("rec_id", training.part_of(F.col("rec_id")).alias("part")).distinct()


_R = """WITH r AS (SELECT DISTINCT rec_id, chrom, strand, cds_start, cds_end, jn_start, jn_end, seq, seq_start, upper(seq) AS u,
  translate(upper(seq), 'RYSWKMBDHV', 'NNNNNNNNNN') AS c FROM datafile WHERE length(seq) > 0),
x AS (SELECT *, list_sort(list_transform(range(1, len(string_split(rtrim(jn_end, ','), ',')) + 1),
  lambda i: {'start': CAST(trim(string_split(rtrim(jn_end, ','), ',')[i]) AS BIGINT), 'end': CAST(trim(string_split(rtrim(jn_start, ','), ',')[i]) AS BIGINT)})) AS exons FROM r),
s AS (SELECT *, CASE WHEN len(list_filter(exons, lambda e: e.start < seq_start OR e.end - seq_start + 1 > length(seq))) = 0 THEN
  list_aggregate(list_transform(exons, lambda e: substr(u, CAST(e.start - seq_start + 1 AS INT), CAST(e.end - e.start + 1 AS INT))), 'string_agg', '') END AS j FROM x),
k AS (SELECT *, CASE WHEN strand = '-' THEN translate(reverse(j), 'ACGTN', 'TGCAN') ELSE j END AS cds,
  CASE WHEN strand = '-' THEN CASE WHEN exons[1].start - seq_start >= 3 THEN translate(reverse(substr(u, CAST(exons[1].start - seq_start - 2 AS INT), 3)), 'ACGTN', 'TGCAN') END
       ELSE CASE WHEN exons[-1].end - seq_start + 4 <= length(seq) THEN substr(u, CAST(exons[-1].end - seq_start + 2 AS INT), 3) END END AS aft FROM s)
"""
_CODONS = "list_filter(regexp_extract_all({0}, '(?s)...'), lambda z: z IN ('TAA', 'TAG', 'TGA'))"


def _reason(stop: str, inner: str) -> str:
    return f"""CASE WHEN cds IS NULL OR length(cds) < 6 THEN 'too_short' WHEN length(cds) % 3 <> 0 THEN 'not_divisible_by_3'
  WHEN substr(cds, 1, 3) NOT IN ('ATG', 'TTG', 'CTG') THEN 'no_start_codon'
  WHEN len({_CODONS.format(inner)}) > 0 THEN 'internal_stops' WHEN right(cds, 3) IN ('TAA', 'TAG', 'TGA') THEN 'valid' ELSE '{stop}' END"""


_COMPAT = "CASE WHEN length(cds) < 9 THEN '' ELSE left(cds, CAST(greatest(length(cds) - 6, 0) AS INT)) END"
_FULL = "left(cds, CAST(greatest(length(cds) - 3, 0) AS INT))"
_AMINO = "substr('FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG', 1 + 16 * (instr('TCAG', z[1]) - 1) + 4 * (instr('TCAG', z[2]) - 1) + instr('TCAG', z[3]) - 1, 1)"
_PROT = f"list_aggregate(list_transform(regexp_extract_all(u, '(?s)...'), lambda z: CASE WHEN regexp_full_match(z, '[TCAG]{{3}}') THEN {_AMINO} ELSE 'X' END), 'string_agg', '')"

SQL = {
    "o_contig_scan": _R + "SELECT rec_id, length(seq) AS n, md5(c) AS digest FROM r",
    "o_ambiguity_clean": _R + "SELECT rec_id, length(c) - length(replace(c, 'N', '')) AS n_count, coalesce(list_aggregate(list_sort(list_distinct(regexp_extract_all(c, '[^ACGTN]'))), 'string_agg', ''), '') AS invalid FROM r",
    "o_revcomp": _R + "SELECT rec_id, md5(translate(reverse(c), 'ACGTN', 'TGCAN')) AS digest FROM r",
    "o_codon_start_stop": _R + "SELECT rec_id, left(u, 3) IN ('ATG', 'TTG', 'CTG') AS starts, right(u, 3) IN ('TAA', 'TAG', 'TGA') AS stops FROM r",
    "o_stop_counts": _R + f"SELECT rec_id, len({_CODONS.format('u')}) AS stops, CASE WHEN length(u) < 6 THEN 0 ELSE len({_CODONS.format('left(u, CAST((length(u) - 1) // 3 * 3 AS INT))')}) END AS inside FROM r",
    "o_translate": _R + f""", t AS (SELECT *, {_PROT} AS p FROM r)
SELECT rec_id, md5(p) AS digest, CASE WHEN length(u) % 3 = 0 AND left(u, 3) IN ('ATG', 'TTG', 'CTG') AND right(u, 3) IN ('TAA', 'TAG', 'TGA')
  AND len({_CODONS.format('u')}) = 1 THEN 'M' || substr(p, 2, length(p) - 2) END AS protein FROM t""",
    "o_train_base_codes": _R + "SELECT rec_id, md5(translate(u, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '13230031002010000434001020')) AS digest FROM r",
    "o_base_codes": _R + "SELECT rec_id, md5(regexp_replace(translate(u, 'ACGT', '0123'), '[^0123]', '4', 'g')) AS digest FROM r",
    "o_spliced_cds": _R + "SELECT rec_id, length(cds) AS n, md5(cds) AS digest, aft AS after FROM k",
    "o_region_fetch": _R + "SELECT rec_id, CASE WHEN cds_start >= seq_start AND cds_end - seq_start + 1 <= length(seq) THEN md5(substr(seq, CAST(cds_start - seq_start + 1 AS INT), CAST(cds_end - cds_start + 1 AS INT))) END AS digest FROM r",
    "o_cds_validate": _R + f"SELECT rec_id, {_reason('no_terminal_stop', _COMPAT)} AS reason, {_reason('valid_without_terminal_stop', _COMPAT)} AS lenient, {_reason('no_terminal_stop', _FULL)} AS full FROM k",
    "o_reason_counts": _R + f"SELECT reason, count(*) AS records FROM (SELECT {_reason('no_terminal_stop', _COMPAT)} AS reason FROM k) GROUP BY 1",
    "o_stop_extension": _R + f""", v AS (SELECT *, {_reason('no_terminal_stop', _COMPAT)} AS why FROM k)
SELECT rec_id, CASE WHEN why = 'no_terminal_stop' AND aft IN ('TAA', 'TAG', 'TGA') THEN 'valid' ELSE why END AS reason,
  why = 'no_terminal_stop' AND coalesce(aft IN ('TAA', 'TAG', 'TGA'), false) AS extended,
  exons[1].start - CASE WHEN strand = '-' AND why = 'no_terminal_stop' AND aft IN ('TAA', 'TAG', 'TGA') THEN 3 ELSE 0 END AS first_start,
  exons[-1].end + CASE WHEN strand <> '-' AND why = 'no_terminal_stop' AND aft IN ('TAA', 'TAG', 'TGA') THEN 3 ELSE 0 END AS last_end FROM v""",
    "o_stop_rule": _R + f""", v AS (SELECT *, {_reason('no_terminal_stop', _COMPAT)} AS why FROM k),
w AS (SELECT 'all' AS rows, * FROM v UNION ALL SELECT 'sound', * FROM v WHERE why IN ('valid', 'no_terminal_stop')),
z AS (SELECT *, coalesce(count(*) FILTER (why = 'no_terminal_stop') OVER (PARTITION BY rows) >= 0.9 * nullif(count(*) FILTER (why <> 'valid') OVER (PARTITION BY rows), 0), false) AS go FROM w),
y AS (SELECT *, go AND why = 'no_terminal_stop' AND coalesce(aft IN ('TAA', 'TAG', 'TGA'), false) AS extended FROM z)
SELECT rec_id, rows, CASE WHEN extended THEN 'valid' ELSE why END AS reason, extended FROM y""",
    "o_introns": _R + "SELECT DISTINCT rec_id, exons[i].end AS intron_start, exons[i + 1].start AS intron_end FROM (SELECT rec_id, exons, unnest(range(1, len(exons))) AS i FROM x)",
    "o_cds_length": _R + "SELECT rec_id, CAST(list_sum(list_transform(exons, lambda e: e.end + 1 - e.start)) AS BIGINT) AS bases, len(exons) AS exons FROM x",
    "o_phase": _R + """, o AS (SELECT rec_id, CASE WHEN strand = '-' THEN list_reverse(exons) ELSE exons END AS e FROM x), f AS (SELECT rec_id, e, unnest(range(0, len(e))) AS exon_no FROM o)
SELECT rec_id, CAST(exon_no AS INT) AS exon_no, CAST((3 - coalesce(list_sum(list_transform(e[1:exon_no], lambda q: q.end + 1 - q.start)), 0) % 3) % 3 AS INT) AS phase FROM f""",
    "o_intron_sets": _R + """, e AS (SELECT DISTINCT rec_id, chrom, strand, exons[i].end AS a, exons[i + 1].start AS b FROM (SELECT *, unnest(range(1, len(exons))) AS i FROM x)),
m AS (SELECT *, min(rec_id) OVER (PARTITION BY chrom, strand, a, b) AS f FROM e)
SELECT rec_id, count(*) FILTER (f < rec_id) AS shared, count(*) FILTER (f = rec_id) AS own FROM m GROUP BY 1""",
    "o_window_tiles": _R + """, t AS (SELECT rec_id, u, cds_start - seq_start AS t0, cds_end - cds_start + 1 AS n, unnest(range(0, CAST(ceil((cds_end - cds_start + 1) / 5000.0) AS BIGINT))) AS i FROM r),
p AS (SELECT rec_id, CAST(i AS INT) AS tile_no, i * 5000 AS tile_start, t0 + i * 5000 - 400 AS a, t0 + (i + 1) * 5000 + 400 AS b, u FROM t)
SELECT rec_id, tile_no, tile_start, md5(repeat('N', CAST(least(5800, greatest(0, -a)) AS INT)) || CASE WHEN least(b, length(u)) > greatest(a, 0) THEN substr(u, CAST(greatest(a, 0) + 1 AS INT), CAST(least(b, length(u)) - greatest(a, 0) AS INT)) ELSE '' END || repeat('N', CAST(least(5800, greatest(0, b - length(u))) AS INT))) AS digest FROM p""",
    "o_label_raster": _R + """, g AS (SELECT rec_id, strand, cds_start, cds_end, exons, unnest(range(cds_start, cds_end + 1)) AS c FROM x),
e AS (SELECT rec_id, c, strand, cds_start, cds_end, CASE
  WHEN c = exons[-1].end THEN CASE WHEN strand = '-' THEN 3 ELSE 4 END WHEN c = exons[1].start THEN CASE WHEN strand = '-' THEN 4 ELSE 3 END
  WHEN len(list_filter(exons, lambda q: q.start = c)) > 0 THEN CASE WHEN strand = '-' THEN 2 ELSE 1 END
  WHEN len(list_filter(exons, lambda q: q.end = c)) > 0 THEN CASE WHEN strand = '-' THEN 1 ELSE 2 END
  WHEN len(list_filter(range(1, len(exons)), lambda i: exons[i].end <= c AND c < exons[i + 1].start)) > 0 THEN 6
  WHEN len(list_filter(exons, lambda q: q.start <= c AND c < q.end)) > 0 THEN 5 ELSE 0 END AS l FROM g)
SELECT rec_id, count(*) AS n, md5(string_agg(CAST(l AS VARCHAR), '' ORDER BY CASE WHEN strand = '-' THEN -c ELSE c END)) AS digest FROM e GROUP BY rec_id""",
    "o_split_mod5": _R + "SELECT DISTINCT rec_id, CASE WHEN rec_id % 5 = 0 THEN 'test' ELSE 'train' END AS part FROM r",
}


def queries():
    return {n: globals()[n] for n in SQL}


def oracle_sql():
    return dict(SQL)
