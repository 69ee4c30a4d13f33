"""Command line: build a reference database, search reads."""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.sql import SparkSession

from . import __version__
from .operators.ingest import failed_spots, require_unique
from .operators.params import SearchParams
from .operators.refdb import build_db, open_db
from .operators.report import print_report, run_summary, write_report
from .operators.search import count_batches, search, search_batches
from .plans.batches import memory_batches
from .sources.accessions import read_spots
from .sources.fastx import FORMATS
from .sources.reads import open_reads, open_references


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="seqloom")
    top.add_argument("--version", "-v", action="version", version=__version__)
    top.add_argument("--log-file")
    top.add_argument("--trace-level", default="warning", choices=("quiet", "error", "warning", "info"))
    top.add_argument("--threads", "-t", type=int, help="cores of a local session")
    top.add_argument("--quiet", action="store_true", help="no progress bars")
    actions = top.add_subparsers(dest="action", required=True)
    build = actions.add_parser("mkdb", help="FASTA of references to a database")
    build.add_argument("--input", "-i", nargs="+", required=True)
    build.add_argument("--output", "-o", required=True)
    build.add_argument("--mkidx", action="store_true")
    build.add_argument("--mkws", action="store_true")
    find = actions.add_parser("search", help="reads that match the references")
    find.add_argument("--db", "-d", required=True)
    find.add_argument("--keep-db-loaded", action="store_true")
    find.add_argument("--input", "-i", "--first-mate", "-1", required=True)
    find.add_argument("--second-mate", "-2")
    find.add_argument("--in-fmt", "-F", default="fasta", choices=(*FORMATS, "sra", "spots"))
    find.add_argument("--memory", "-M", type=int, help="MiB of estimated hits and bases of a batch")
    find.add_argument("--batch-size", "-b", type=int, help="most reads of a batch")
    find.add_argument("--strict-ids", action="store_true", help="refuse reads with one id")
    find.add_argument("--first-read", type=int, default=0)
    find.add_argument("--last-read", type=int)
    find.add_argument("--output", "-o", help="a folder; standard output without it")
    find.add_argument("--continuous-bases", "-C", type=int, default=0)
    find.add_argument("--covered-bases", "-B", type=int, default=0)
    find.add_argument("--max-diag-delta", "-D", type=int, default=4)
    find.add_argument("--coverage-ratio", "-c", type=float, default=0.5)
    find.add_argument("--per-mate-marks", "-m", action="store_true")
    find.add_argument("--paired", action="store_true")
    find.add_argument("--prescreen", action="store_true")
    return top


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    o = parser().parse_args(args)
    logging.basicConfig(filename=o.log_file, level=logging.CRITICAL if o.trace_level == "quiet" else o.trace_level.upper())
    if spark is None:
        builder = SparkSession.builder.appName("seqloom").config("spark.ui.showConsoleProgress", str(not o.quiet).lower())
        spark = (builder.master(f"local[{o.threads}]") if o.threads else builder).getOrCreate()
    if o.action == "mkdb":
        build_db(open_references(spark, o.input), o.output, o.mkidx, o.mkws)
        return
    params = SearchParams(o.continuous_bases, o.covered_bases, o.max_diag_delta, o.coverage_ratio, o.per_mate_marks, o.prescreen)
    refs, seeds, words = open_db(spark, o.db, o.prescreen)
    if o.keep_db_loaded:
        seeds = seeds.persist()
    mates = open_reads(spark, [o.input, *([o.second_mate] if o.second_mate else [])], o.in_fmt, o.paired, o.first_read, o.last_read)
    if o.strict_ids:
        mates = require_unique(mates)
    failed = failed_spots(read_spots(spark, o.input)) if o.in_fmt in ("sra", "spots") else None
    if o.memory or o.batch_size:
        batches = memory_batches(mates, refs, o.memory << 20) if o.memory else count_batches(mates, o.batch_size)
        mates, batches = mates.persist(), batches.persist()
        runs = search_batches(mates, batches, refs, params, seeds, words)
    else:
        runs = iter([(None, *search(mates, refs, params, seeds, words))])
    mapped, total, bad = 0, 0, 0
    for number, marks, found in runs:
        marks = marks.persist()  # the report and the summary take them from here
        if o.output:
            write_report(found, o.output if number is None else f"{o.output}/batch={number}")
        else:
            print_report(found, sys.stdout)
        total, bad, some = run_summary(mates, marks, failed).first()
        mapped += some
        marks.unpersist()
    logging.info("reads: %d, failed: %d, mapped: %d", total, bad, mapped)


if __name__ == "__main__":
    main()
