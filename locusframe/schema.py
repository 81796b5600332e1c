"""Fixed vocabularies of the domain: score classes, events, variants, letters."""

from __future__ import annotations

# Score classes in the order of the score matrix.
CLASSES = ["intergenic", "exon_start", "exon_end", "cds_start", "cds_end", "is_exon", "is_intron"]
# Codes of boundary events.
CDS_START, CDS_END, EXON_START, EXON_END = 0, 1, 2, 3
# The score class that an event type is read from.
EVENT_CLASS = {CDS_START: 3, CDS_END: 4, EXON_START: 1, EXON_END: 2}
# Names of transcript variants by their codes.
VARIANTS = ["UNKNOWN", "PRIMARY", "INTRON_RETENTION", "EXON_SKIPPING", "ALT_FIRST_EXON", "ALT_LAST_EXON", "ALT_5_SPLICE_SITE", "ALT_3_SPLICE_SITE", "COMPLEX"]
# IUPAC letters that stand for several bases.
AMBIGUOUS = "RYSWKMBDHV"
START_CODONS = ["ATG", "TTG", "CTG"]
STOP_CODONS = ["TAA", "TAG", "TGA"]
# The standard genetic code, bases in the order T C A G.
BASE_ORDER = "TCAG"
AMINO_ACIDS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
# Training codes of letters; an ambiguous letter counts as one of its bases.
TRAINING_BASES = {"A": 1, "C": 2, "G": 3, "T": 4, "B": 3, "D": 3, "H": 1, "K": 2, "M": 1, "R": 4, "S": 3, "W": 1, "Y": 2}

EVENT = "struct<pos:bigint,type:tinyint,score:double>"
EXON = "struct<start:bigint,end:bigint>"
