"""The whole runs: prediction, raw score segments, and training data from annotations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.operators import annotation, calling, genes, intervals, isoforms, scorers, threshold, tracks, training
from locusframe.operators.grouped import map_groups
from locusframe.params import Params, Strand
from locusframe.session import cut_lineage, write_once
from locusframe.sources import fasta, sinks, tables

#: A genome of fewer bases takes the fixed threshold.
DYNAMIC_FROM = 100_000
#: Least size of a score in raw segments, by track.
SEGMENT_LEAST = {"cds": 0.01, "exon": 0.01, "inside": 0.2}


#: The two classes of each track of raw segments.
SEGMENT_TRACKS = {"cds": (3, 4), "exon": (1, 2), "inside": (5, 6)}


@dataclass
class Prediction:
    contigs: DataFrame
    transcripts: DataFrame
    genes: DataFrame
    mean_score: float | None
    threshold: float


def _contig_tiles(params: Params, make_scorer=None):
    strands = {Strand.BOTH: (1, -1), Strand.FORWARD: (1,)}.get(params.strand, (-1,))
    return tracks.contig_tiles(make_scorer or scorers.scorer_of(params.model, params.context_length), params.tile, params.context_length, strands)


def candidate_calls(contigs: DataFrame, params: Params, make_scorer=None) -> DataFrame:
    """All candidate structures of ``contigs``, written once.

    Contigs of one tile are scored where they are searched; the tiles of longer ones are scored apart and shuffled.
    """
    short = F.length("seq") <= params.tile
    calls = calling.contig_calls(contigs.filter(short), _contig_tiles(params, make_scorer), params)
    if not contigs.filter(~short).isEmpty():
        calls = calls.unionByName(calling.candidate_calls(score_tracks(contigs.filter(~short), params, make_scorer), params))
    return write_once(calls)


def score_tracks(contigs: DataFrame, params: Params, make_scorer=None) -> DataFrame:
    tiles = tracks.sequence_tiles(contigs, params.tile, params.context_length)
    if params.strand != Strand.BOTH:
        tiles = tiles.filter(F.col("strand") == (1 if params.strand == Strand.FORWARD else -1))
    return tracks.scored(tiles, make_scorer or scorers.scorer_of(params.model, params.context_length), params.context_length)


def variants(t: DataFrame) -> DataFrame:
    """Transcripts with ``variant``: PRIMARY for the first of a gene, else how it differs from that one."""
    from pyspark.sql import types as T

    schema = T.StructType([*t.select("contig_id", "strand", "call_no").schema.fields, T.StructField("variant", T.StringType())])

    def name(rows: list[dict]) -> list[tuple]:
        exons = [[(x["start"], x["end"]) for x in r["exons"]] for r in rows]
        return [(r["contig_id"], r["strand"], r["call_no"], "PRIMARY" if i == 0 else isoforms.variant(exons[0], exons[i], r["strand"])) for i, r in enumerate(rows)]

    keys = ["contig_id", "strand", "group_id", "part_no"]
    return t.join(map_groups(t.select(*keys, "place", "call_no", "exons"), keys, ["place"], name, schema), ["contig_id", "strand", "call_no"])


def predict(contigs: DataFrame, params: Params, make_scorer=None) -> Prediction:
    """Genes of ``contigs`` (contig_ord, contig_id, seq, length).

    A transcript below the threshold is left out before genes are made, so a locus can lose isoforms.
    """
    calls = candidate_calls(contigs, params, make_scorer)
    made = cut_lineage(calling.transcripts(calling.selected_calls(calls, params), contigs))
    if not params.allow_opposite_strand_overlaps:
        numbered = made.withColumn("_k", F.monotonically_increasing_id())
        made = cut_lineage(numbered)
        made = made.join(intervals.resolve_opposite_strands(made, "contig_id", "start", "end", "strand", "score", "_k"), "_k").drop("_k")
    bases = contigs.agg(F.sum("length")).first()[0] or 0
    least = params.min_gene_score
    locus = ["contig_id", "strand", "group_id"]
    if params.dynamic_scoring and bases >= DYNAMIC_FROM:
        least = threshold.dynamic_threshold(made, locus, "score", params.min_gene_score)
    made = threshold.above(made, "score", least)
    parts = genes.split_by_primary(made, locus, "start", "end", "score", "bases", "call_no")
    made = made.drop("place").join(parts, [*locus, "call_no"])
    made = variants(made)
    gene = [*locus, "part_no"]
    rolled = genes.gene_rollup(made, gene, "start", "end", "score").join(contigs.select("contig_id", "contig_ord"), "contig_id")
    first = rolled.groupBy("contig_id", "strand", "group_id").agg(F.min("gene_start").alias("_group_start"))
    ordered = rolled.join(first, locus).withColumn("_back", -F.col("strand"))
    named = genes.numbered(ordered, ["contig_ord", "_group_start", "_back", "group_id", "part_no"], params.gene_id_prefix).drop("_group_start", "_back")
    mean = named.agg(F.avg("gene_score")).first()[0]
    return Prediction(contigs, made.join(named.drop("contig_ord", "n_transcripts"), gene), named, mean, least)


def raw_segments(contigs: DataFrame, params: Params, least: dict[str, float] | None = None, make_scorer=None) -> DataFrame:
    """track, contig_id, seg_start, seg_end, value: runs of rounded signed scores of three track pairs, in forward coordinates.

    Scores below the ``least`` of their pair (SEGMENT_LEAST) count as zero.
    """
    least = SEGMENT_LEAST if least is None else least
    return tracks.joined_segments(contigs.select("contig_id", "seq"), _contig_tiles(params, make_scorer), {name: (a, b, least[name]) for name, (a, b) in SEGMENT_TRACKS.items()})


def training_run(spark: SparkSession, gff: str, sequences: str, out: str, allowed: str | None = None, threshold: float = 0.9, block: int = 5000, context: int = 800, per_chunk: int = 100) -> str:
    """Training records of an annotation and its sequences under ``out``, and the validation report.

    Writes splice_table (lines), validated (the valid rows, their sequences, the invalid rows with reasons),
    datafile (valid records as parquet, with the part each goes to) and dataset (windows and labels of the
    training part in chunks, of which a tenth is set aside), and gives the report's text.  ``allowed`` is a
    list of gene names to keep.
    """
    rows = tables.read_gff(spark, gff).withColumnsRenamed({"start": "feat_start", "end": "feat_end"})
    cds = annotation.cds_rows(annotation.parsed(rows))
    genes_found = annotation.flanked(annotation.gene_extents(cds), annotation.contig_sizes(cds))
    if allowed:
        genes_found = genes_found.join(tables.read_allow_list(spark, allowed), "name", "left_semi")
    contigs = fasta.contigs(fasta.read_sequences(spark, sequences), check=False)
    sinks.write_splice_table(annotation.splice_lines(genes_found), f"{out}/splice_table")
    judged = write_once(annotation.training_records(genes_found, contigs, threshold))
    sinks.write_validation(judged, f"{out}/validated")
    valid = genes.numbered(judged.filter("reason = 'valid'"), ["chrom", "strand", "name"], out="rec_name")
    valid = valid.withColumn("rec_id", F.substring("rec_name", 4, 20).cast("bigint")).withColumn("part", training.part_of(F.col("rec_id"))).drop("rec_name")
    sinks.write_datafile(valid.drop("rec_id"), f"{out}/datafile")
    points = training.datapoints(valid.filter("part = 'train'"), block, context)
    sinks.write_chunks(training.in_chunks(points, "rec_id", per_chunk), f"{out}/dataset")
    return sinks.report(judged)


def run(spark: SparkSession, params: Params) -> Prediction | None:
    """A command-line run: reads, predicts, writes the files that were asked for."""
    records = fasta.read_sequences(spark, params.sequence)
    contigs = write_once(fasta.contigs(records, params.contigs_filter))
    if params.write_raw_scores:
        sinks.write_segments(raw_segments(contigs, params), params.output + ".seg")
        return None
    found = predict(contigs, params)
    sinks.write_gff(genes.gff_rows(found.transcripts), contigs, params.output, found.mean_score)
    if params.genes or params.proteins:
        cds = cut_lineage(sinks.cds_of(found.transcripts, contigs))
        for path, kind in ((params.genes, "cds"), (params.proteins, "protein")):
            if path:
                sinks.write_fasta(cds, path, kind)
    return found
