"""python -m evenstrand.cli in=reads.fq out=kept hist=hist.tsv ..."""

from __future__ import annotations

import os
import sys
import tempfile

from pyspark.sql import SparkSession

from evenstrand.config import _is_stdin, parse_args
from evenstrand.plans.normalize import run
from evenstrand.sources.reads import spool_stdin


def main(args: list[str] | None = None) -> int:
    c = parse_args(sys.argv[1:] if args is None else args)
    if not c.in1:
        print(__doc__, file=sys.stderr)
        return 2
    for side in ("in1", "in2"):
        path = getattr(c, side)
        if path and _is_stdin(path):
            setattr(c, side, spool_stdin(sys.stdin.buffer, os.path.join(c.temp_dir or tempfile.mkdtemp(), "stdin" + (path[path.find(".") :] if "." in path else ".fq"))))
    for note in c.notes:
        print(f"note: {note}", file=sys.stderr)
    spark = SparkSession.builder.appName("evenstrand").getOrCreate()
    result = run(spark, c)
    for name, value in result.summary.items():
        print(f"{name}\t{value}", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
