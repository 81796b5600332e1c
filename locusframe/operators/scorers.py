"""Scorers that tracks can be made with: a motif scorer without a model, and ONNX models."""

from __future__ import annotations

import functools
import importlib
from collections.abc import Callable

import numpy as np


def motif_scorer(context: int = 800) -> Callable[[str], np.ndarray]:
    """Scores from sequence motifs alone; for tests and for runs without a model. It predicts nothing real.

    CDS starts at start codons after a purine three bases before, CDS ends at stop codons, introns from
    GTAAG, GTATG and GTGAG to TTNCAG and YAG after six pyrimidines.  Its context is 20 bases; half
    of ``context`` is cut off on either side.
    """
    letters = {"A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT"}
    # pattern (. any letter), class, place from the pattern's begin, value
    motifs = [
        ("R..ATG", 3, 3, 0.8),
        ("R..YTGR", 3, 3, 0.15),
        ("TAA", 4, 2, 0.7),
        ("TAG", 4, 2, 0.7),
        ("TGA", 4, 2, 0.7),
        ("GTAAG", 2, -1, 0.6),
        ("GTATG", 2, -1, 0.6),
        ("GTGAG", 2, -1, 0.6),
        ("TT.CAG", 1, 6, 0.6),
        ("YYYYYY.YAG", 1, 10, 0.4),
    ]
    # the mean of 21 letters by the number of G and C among them, added up as single floats
    share = np.concatenate([[0], np.cumsum(np.full(21, np.float32(1 / 21)), dtype=np.float32)]).astype(np.float32)

    def score(padded: str) -> np.ndarray:
        n = len(padded)
        p = np.zeros((7, n), np.float32)
        codes = np.frombuffer(padded.encode(), np.uint8)
        own = {c: codes == ord(c) for c in "ACGT"}
        own |= {k: own[v[0]] | own[v[1]] for k, v in letters.items() if len(v) == 2}
        gc = np.zeros(n + 21, np.int32)
        np.cumsum(own["G"] | own["C"], out=gc[11 : n + 11])
        gc[n + 11 :] = gc[n + 10]
        count = gc[21:] - gc[:n]
        p[5], p[6] = (0.3 + 0.4 * share)[count], (0.62 - 0.4 * share)[count]
        p[0] = np.where(codes == ord("N"), np.float32(0.95), np.float32(0.05))
        for pattern, row, shift, value in motifs:
            many = n - len(pattern) + 1
            if many <= 0:
                continue
            hit = np.ones(many, bool)
            for k, c in enumerate(pattern):
                if c != ".":
                    hit &= own[c][k : k + many]
            at = np.flatnonzero(hit) + shift
            at = at[(at >= 0) & (at < n)]
            p[row, at] = np.maximum(p[row, at], np.float32(value))
        half = context // 2
        return p[:, half : n - half]

    return score


def onnx_scorer(path: str) -> Callable[[], Callable[[str], np.ndarray]]:
    """Scorers that run an ONNX model on one-hot bases [1, letters, 4] and return its [letters, 7] transposed."""

    def make() -> Callable[[str], np.ndarray]:
        import onnxruntime

        session = onnxruntime.InferenceSession(path)
        name = session.get_inputs()[0].name
        row = np.full(256, 4, np.uint8)
        row[np.frombuffer(b"ACGT", np.uint8)] = range(4)
        eye = np.vstack([np.eye(4, dtype=np.float32), np.zeros((1, 4), np.float32)])

        def score(padded: str) -> np.ndarray:
            x = eye[row[np.frombuffer(padded.encode(), np.uint8)]][None]
            return session.run(None, {name: x})[0][0].T

        return score

    return make


def scorer_of(model: str | None, context: int = 800) -> Callable[[], Callable[[str], np.ndarray]]:
    """The maker of scorers that ``--model`` names; the motif scorer without a name.

    A model gives scores of all letters but half the ``context`` at either end; ``tracks.scored`` checks that.
    """
    if not model:
        return functools.partial(motif_scorer, context)
    if model.endswith(".onnx"):
        return onnx_scorer(model)
    module, _, name = model.partition(":")
    return getattr(importlib.import_module(module), name)
