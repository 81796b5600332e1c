"""Command line: ``python -m locusframe.cli genome.fasta``."""

from __future__ import annotations

import logging
import sys
import time

from locusframe import params as P
from locusframe.session import build_session


def setup_logging(params: P.Params) -> logging.Logger:
    """Console and file logging of a run; the file begins with all settings."""
    log = logging.getLogger("locusframe")
    log.setLevel(logging.DEBUG if params.debug else logging.INFO if params.verbose else logging.WARNING)
    form = logging.Formatter("%(asctime)s %(levelname)s %(message)s")
    path = f"{params.output}.log"
    with open(path, "w") as f:
        f.write(params.to_ini())
    for handler in (logging.StreamHandler(), logging.FileHandler(path)):
        handler.setFormatter(form)
        log.addHandler(handler)
    sys.excepthook = lambda kind, error, trace: log.error("ended by an error", exc_info=(kind, error, trace))
    return log


def main(argv: list[str] | None = None) -> int:
    try:
        params = P.parse(sys.argv[1:] if argv is None else argv)
    except ValueError as e:
        print(f"locusframe: {e}", file=sys.stderr)
        return 2
    from locusframe import pipeline

    log = setup_logging(params)
    began = time.time()
    spark = build_session(master=f"local[{params.cores}]" if params.cores else None)
    found = pipeline.run(spark, params)
    if found:
        log.info("%d genes, mean score %s, threshold %.2f", found.genes.count(), found.mean_score, found.threshold)
    log.info("done in %.1f s", time.time() - began)
    return 0


if __name__ == "__main__":
    sys.exit(main())
