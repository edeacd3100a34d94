"""python -m lamina.cli -o OUT INPUT...: container archives to one artifact with shared layers."""

from __future__ import annotations

import argparse
import logging
import os
import sys

from lamina.errors import LaminaError, UsageError
from lamina.functions.scalars import parse_size


def log_level(verbosity: int, quiet: bool, environment: dict = os.environ) -> int:
    """LAMINA_LOG has the last word."""
    named = logging.getLevelNamesMapping().get(environment.get("LAMINA_LOG", "").upper())
    if named is not None:
        return named
    return logging.ERROR if quiet else {0: logging.WARNING, 1: logging.INFO}.get(verbosity, logging.DEBUG)


def _size(text: str) -> int:
    try:
        return parse_size(text)
    except UsageError as e:
        raise argparse.ArgumentTypeError(str(e)) from e


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lamina")
    p.add_argument("-o", "--output", required=True)
    p.add_argument("inputs", nargs="+", metavar="INPUT")
    p.add_argument("--layout", choices=("tar", "dir"), default="tar")
    p.add_argument("--min-layer-size", type=_size, default=16 * 1024, help="like 16k or 1M; 0 keeps all layers")
    p.add_argument("--force", action="store_true", help="move an output that exists aside")
    p.add_argument("--timestamp", type=int)
    p.add_argument("--jobs", type=int, default=0, help="threads of a local master; 0: one for each CPU")
    p.add_argument("--scratch")
    p.add_argument("--dry-run", action="store_true")
    loud = p.add_mutually_exclusive_group()
    loud.add_argument("-v", "--verbose", action="count", default=0)
    loud.add_argument("-q", "--quiet", action="store_true")
    return p


def main(argv: list[str] | None = None) -> int:
    """0; 1 failure, 2 usage, 3 output exists, 4 digest mismatch."""
    try:
        a = parser().parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    logging.basicConfig(level=log_level(a.verbose, a.quiet), stream=sys.stderr)
    from pyspark.sql import SparkSession

    from lamina.plans.run import Config, run

    spark = SparkSession.builder.master(os.environ.get("SPARK_MASTER", f"local[{a.jobs or '*'}]")).config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()
    try:
        print(run(spark, Config(a.output, a.inputs, a.layout, a.min_layer_size, a.force, a.timestamp, a.scratch, a.dry_run)))
    except LaminaError as e:
        print(f"lamina: {e}", file=sys.stderr)
        return e.exit_code
    except OSError as e:
        print(f"lamina: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
