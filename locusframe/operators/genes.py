"""Transcripts to genes: loci, identifiers, and rows of annotation output."""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from locusframe.operators.grouped import map_groups
from locusframe.operators.intervals import carried, range_tiles
from locusframe.session import write_once


def gene_rollup(df: DataFrame, locus: list[str], start: str, end: str, score: str) -> DataFrame:
    """One row for each locus: span, best score, number of transcripts."""
    return df.groupBy(*locus).agg(F.min(start).alias("gene_start"), F.max(end).alias("gene_end"), F.max(score).alias("gene_score"), F.count(F.lit(1)).alias("n_transcripts"))


def score_summary(genes: DataFrame) -> DataFrame:
    """Counts, transcripts a gene, mean gene score (null without genes)."""
    return genes.agg(F.count(F.lit(1)).alias("genes"), F.sum("n_transcripts").alias("transcripts"), F.avg("gene_score").alias("mean_score"), F.try_divide(F.sum("n_transcripts"), F.count(F.lit(1))).alias("per_gene"))


def numbered(genes: DataFrame, order: list[str], prefix: str | None = None, out: str = "gene_id") -> DataFrame:
    """``genes`` with running identifiers GML000001 on, in ``order``, counted over tiles in parallel."""
    tiles = range_tiles(genes, order)
    counted = carried(tiles, [], order, F.lit(1).cast("bigint"), "_no", "sum", inclusive=True)
    form = f"{prefix}_GML%06d" if prefix else "GML%06d"
    return counted.withColumn(out, F.format_string(form, "_no")).drop("_no", "_tile")


def split_by_primary(df: DataFrame, locus: list[str], start: str, end: str, score: str, bases: str, key: str, out: str = "part_no") -> DataFrame:
    """Parts of each locus: transcripts in the order (bases falling, score falling, start, end, key) join the
    first part whose first member they overlap, or begin one; parts are numbered by their least start.
    ``is_primary`` marks the first members, ``place`` the order inside a part.

    Transcripts that no chain of overlaps connects don't meet, so a task works on one connected run of a
    locus, found along range tiles; first members are disjoint, so a home is found among sorted ones.
    """
    rows = df.select(*locus, start, end, score, bases, key)
    order = [start, end, key]
    tiles = range_tiles(rows, [*locus, *order])
    seen = carried(tiles, locus, order, F.col(end), "_reach", "max")
    fresh = (F.col("_reach").isNull() | (F.col(start) >= F.col("_reach"))).cast("bigint")
    runs = carried(seen, locus, order, fresh, "_run", "sum", inclusive=True).drop("_reach", "_tile")
    group = [*locus, "_run"]
    schema = T.StructType([*runs.select(*group, key).schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("place", T.IntegerType())])

    def parts(rows: list[dict]) -> list[tuple]:
        found: list[list[dict]] = []
        firsts: list[tuple] = []  # start, end, part of the first members, rising
        for r in rows:
            k = bisect_left(firsts, (r[start],))
            k -= k > 0 and firsts[k - 1][1] > r[start]
            homes = []
            while k < len(firsts) and firsts[k][0] < r[end]:
                homes += [firsts[k][2]] if r[start] < firsts[k][1] else []
                k += 1
            if homes:
                found[min(homes)].append(r)
            else:
                insort(firsts, (r[start], r[end], len(found)))
                found.append([r])
        found.sort(key=lambda p: min(r[start] for r in p))
        return [(*(r[g] for g in group), r[key], n, place) for n, p in enumerate(found) for place, r in enumerate(p)]

    made = write_once(map_groups(runs, group, [F.desc(bases), F.desc(score), start, end, key], parts, schema))
    sizes = range_tiles(made.groupBy(*group).agg((F.max("_part") + 1).cast("bigint").alias("_n")), group)
    before = carried(sizes, locus, ["_run"], F.col("_n"), "_before", "sum").select(*group, "_before")
    same = F.lit(True)
    for g in group:
        same = same & F.col(f"t.{g}").eqNullSafe(F.col(f"m.{g}"))
    joined = made.alias("t").join(before.alias("m"), same)
    return joined.select(*[f"t.{g}" for g in locus], f"t.{key}", (F.col("_part") + F.coalesce("_before", F.lit(0))).cast("int").alias(out), "place")


def gff_rows(transcripts: DataFrame, source: str = "locusframe") -> DataFrame:
    """Rows of an annotation file: gene, then of each transcript mRNA, exon and CDS; sorted by (gene_id, row_no).

    ``transcripts``: gene_id, contig_id, strand (1/-1), gene_start, gene_end, gene_score, place (from 0 in the
    gene), variant, score, start, end and exons (array of start, end, score, phase in transcript order),
    half-open from 0; the rows count from 1 with inclusive ends and scores have three digits.
    """
    strand = F.when(F.col("strand") == 1, "+").otherwise("-")
    dec = lambda c: F.format_string("%.3f", c.cast("double"))
    mrna = F.concat(F.col("gene_id"), F.lit("_mRNA"), (F.col("place") + 1).cast("string"))

    def row(no, kind, s, e, score, phase, attributes):
        return F.struct(no.cast("bigint").alias("row_no"), F.lit(kind).alias("feature_type"), (s + 1).cast("bigint").alias("start"), e.cast("bigint").alias("end"), score.alias("score"), phase.cast("string").alias("phase"), attributes.alias("attributes"))

    base = (F.col("place").cast("bigint") + 1) * 100_000
    gene = F.when(F.col("place") == 0, F.array(row(F.lit(0), "gene", F.col("gene_start"), F.col("gene_end"), dec(F.col("gene_score")), F.lit("."), F.concat(F.lit("ID="), F.col("gene_id")))))
    mrna_row = F.array(row(base, "mRNA", F.col("start"), F.col("end"), dec(F.col("score")), F.lit("."), F.concat(F.lit("ID="), mrna, F.lit(";Parent="), F.col("gene_id"), F.lit(";TranscriptVariant="), F.col("variant"))))
    parts = F.flatten(
        F.transform(
            "exons",
            lambda x, i: F.array(
                row(base + 2 * i + 1, "exon", x["start"], x["end"], dec(x["score"]), F.lit("."), F.concat(F.lit("ID="), mrna, F.lit("_exon"), (i + 1).cast("string"), F.lit(";Parent="), mrna)),
                row(base + 2 * i + 2, "CDS", x["start"], x["end"], dec(x["score"]), x["phase"].cast("string"), F.concat(F.lit("ID="), mrna, F.lit("_CDS"), (i + 1).cast("string"), F.lit(";Parent="), mrna)),
            ),
        )
    )
    rows = F.concat(F.coalesce(gene, F.slice(mrna_row, 1, 0)), mrna_row, parts)
    return transcripts.select(F.col("contig_id").alias("seqid"), F.lit(source).alias("source"), strand.alias("strand"), "gene_id", F.inline(rows)).select("gene_id", "row_no", "seqid", "source", "feature_type", "start", "end", "score", "strand", "phase", "attributes")


def violations(transcripts: DataFrame, genes: DataFrame, gene: list[str]) -> DataFrame:
    """``what`` and ``rows``: how often each rule of structure is broken.

    A transcript has an exon and its exons lie inside it; a gene has a transcript and its transcripts lie
    inside it.  ``transcripts``: the ``gene`` columns, start, end, exons (start, end); ``genes``: the same
    columns, gene_start, gene_end.
    """
    rules = {
        "transcript without exon": F.size("exons") <= 0,
        "exon outside its transcript": F.exists("exons", lambda x: (x["start"] < F.col("start")) | (x["end"] > F.col("end")) | (x["start"] >= x["end"])),
    }
    own = transcripts.select(F.inline(F.array(*[F.struct(F.lit(k).alias("what"), F.coalesce(v, F.lit(False)).cast("bigint").alias("n")) for k, v in rules.items()])))
    spans = transcripts.groupBy(*gene).agg(F.min("start").alias("_first"), F.max("end").alias("_last"))
    both = genes.join(spans, gene, "left")
    empty, wide = F.col("_first").isNull(), F.coalesce((F.col("_first") < F.col("gene_start")) | (F.col("_last") > F.col("gene_end")), F.lit(False))
    of_genes = both.select(F.inline(F.array(F.struct(F.lit("gene without transcript").alias("what"), empty.cast("bigint").alias("n")), F.struct(F.lit("transcript outside its gene").alias("what"), wide.cast("bigint").alias("n")))))
    return own.unionByName(of_genes).groupBy("what").agg(F.sum("n").alias("rows"))
