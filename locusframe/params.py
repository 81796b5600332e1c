"""Options of a prediction run, their validation and their dumps."""

from __future__ import annotations

import argparse
import json
import os
import re
from dataclasses import asdict, dataclass, fields
from enum import Enum
from pathlib import Path


class Strand(Enum):
    FORWARD = "forward"
    REVERSE = "reverse"
    BOTH = "both"


@dataclass(frozen=True)
class Params:
    """All settings of a run; plain values, so that it can be sent to workers."""

    sequence: str = ""
    output: str | None = None
    genes: str | None = None
    proteins: str | None = None
    gene_id_prefix: str | None = None
    model: str | None = None
    context_length: int = 800
    cores: int | None = None
    verbose: bool = False
    debug: bool = False
    cpu_only: bool = False
    strand: Strand = Strand.BOTH
    contigs_filter: tuple[str, ...] | None = None
    write_raw_scores: bool = False
    max_transcripts: int = 5
    allow_opposite_strand_overlaps: bool = True
    dynamic_scoring: bool = True
    min_gene_score: float = 0.5
    min_exon_size: int = 1
    max_exon_size: int = 30_000
    min_intron_size: int = 10
    max_intron_size: int = 400
    cds_start_min_score: float = 0.01
    cds_end_min_score: float = 0.01
    exon_start_min_score: float = 0.01
    exon_end_min_score: float = 0.01
    gene_candidates: int = 5_000
    frame_max_ops: int = 100_000
    region_max_ops: int = 200_000
    tile: int = 100_000

    def thresholds(self) -> dict[int, float]:
        return {0: self.cds_start_min_score, 1: self.cds_end_min_score, 2: self.exon_start_min_score, 3: self.exon_end_min_score}

    def to_json(self) -> str:
        return json.dumps(asdict(self), default=lambda x: x.value if isinstance(x, Enum) else str(x), indent=2)

    def to_ini(self) -> str:
        """The settings as one INI section; settings without a value are left empty."""
        lines = ["[run]"]
        for f in fields(self):
            v = getattr(self, f.name)
            lines.append(f"{f.name} = {v.value if isinstance(v, Enum) else '' if v is None else ','.join(v) if isinstance(v, tuple) else v}")
        return "\n".join(lines) + "\n"


def positive_int(text: str) -> int:
    if not re.fullmatch(r"\+?[0-9]+", text) or int(text) < 1:
        raise argparse.ArgumentTypeError(f"{text!r} is no whole number of at least 1")
    return int(text)


def unit_float(text: str) -> float:
    try:
        value = float(text)
    except ValueError:
        value = -1.0
    if not 0.0 <= value <= 1.0:
        raise argparse.ArgumentTypeError(f"{text!r} is no number from 0 to 1")
    return value


def gene_score(text: str) -> str | float:
    return "dynamic" if text.lower() == "dynamic" else unit_float(text)


def gene_id_prefix(text: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", text):
        raise argparse.ArgumentTypeError("a prefix holds letters, digits, _, . and - only")
    return text


def base_path(path: str) -> str:
    """The path without ``.gz`` and one more suffix."""
    p = Path(path[:-3] if path.endswith(".gz") else path)
    return str(p.with_suffix("")) if p.suffix else str(p)


def readable(path: str, what: str) -> str:
    if not os.path.exists(path):
        raise ValueError(f"{what} {path} isn't there")
    if os.path.isdir(path) or not os.access(path, os.R_OK):
        raise ValueError(f"{what} {path} can't be read")
    return path


def writable(path: str, what: str, others: set[str]) -> str:
    """``path`` if it can be made and clashes with no other file of the run."""
    if os.path.isdir(path):
        raise ValueError(f"{what} {path} is a folder")
    if os.path.abspath(path) in others:
        raise ValueError(f"{what} {path} is used twice")
    up = Path(os.path.abspath(path)).parent
    while not up.exists():
        up = up.parent
    if not os.access(up, os.W_OK):
        raise ValueError(f"{what} {path} can't be written")
    others.add(os.path.abspath(path))
    return path


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="locusframe", description="Genes from scored sequences")
    d = Params()
    p.add_argument("sequence", help="FASTA, GenBank or EMBL file")
    p.add_argument("-o", "--output", help="annotation file; the input's name with .gff3 by default")
    p.add_argument("-g", "--genes", help="FASTA file of coding sequences")
    p.add_argument("-p", "--proteins", help="FASTA file of proteins")
    p.add_argument("--gene-id-prefix", type=gene_id_prefix)
    p.add_argument("-m", "--model", help="scorer: package.module:function or an ONNX file")
    p.add_argument("-cl", "--context-length", type=positive_int)
    p.add_argument("-c", "--cores", type=positive_int)
    p.add_argument("-v", "--verbose", action="store_true")
    p.add_argument("-d", "--debug", action="store_true")
    p.add_argument("--cpu-only", action="store_true")
    p.add_argument("--strand", choices=[s.value for s in Strand], default=d.strand.value)
    p.add_argument("--contigs-filter", help="comma list of sequence ids")
    p.add_argument("--write-raw-scores", action="store_true")
    p.add_argument("--max-transcripts", type=positive_int, default=d.max_transcripts)
    p.add_argument("--allow-opposite-strand-overlaps", action=argparse.BooleanOptionalAction, default=True)
    p.add_argument("--min-gene-score", type=gene_score, default="dynamic")
    for name in ("min_exon_size", "max_exon_size", "min_intron_size", "max_intron_size", "gene_candidates"):
        p.add_argument("--" + name.replace("_", "-"), type=positive_int, default=getattr(d, name))
    for name in ("cds_start_min_score", "cds_end_min_score", "exon_start_min_score", "exon_end_min_score"):
        p.add_argument("--" + name.replace("_", "-"), type=unit_float, default=getattr(d, name))
    return p


def parse(argv: list[str]) -> Params:
    """Params of a command line; ValueError where options don't fit together or files can't be used."""
    a = parser().parse_args(argv)
    if a.model and a.context_length is None:
        raise ValueError("a model of your own needs --context-length")
    for kind in ("exon", "intron"):
        if getattr(a, f"min_{kind}_size") > getattr(a, f"max_{kind}_size"):
            raise ValueError(f"the least {kind} size is above the greatest")
    readable(a.sequence, "the sequence file")
    used = {os.path.abspath(a.sequence)}
    output = writable(a.output or base_path(a.sequence) + ".gff3", "the annotation file", used)
    for path in (a.genes, a.proteins):
        if path:
            writable(path, "the FASTA file", used)
    dynamic = a.min_gene_score == "dynamic"
    own = {f.name for f in fields(Params)}
    values = {k: v for k, v in vars(a).items() if k in own and v is not None}
    values |= {"output": output, "strand": Strand(a.strand), "dynamic_scoring": dynamic, "min_gene_score": 0.5 if dynamic else a.min_gene_score}
    values |= {"contigs_filter": tuple(a.contigs_filter.split(",")) if a.contigs_filter else None}
    return Params(**values)
