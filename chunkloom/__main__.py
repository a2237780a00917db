"""Command line: ``python -m chunkloom [-c FILE] [-p LINE]... PATH | -r JOB TARGET | -t PATH | -d JOB | -s``."""

from __future__ import annotations

import argparse
import os

from pyspark.sql import SparkSession

from .config import parse_config
from .operators import chunking
from .plans.workspace import Workspace
from .sources import snapshots, trace


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="chunkloom", description="Backs up directories with deduplication, restores versions, writes traces, reports.")
    p.add_argument("path", nargs="?", help="directory (or trace, at simulation level all) to back up; with -r the folder to restore to")
    p.add_argument("-c", "--config", default="chunkloom.config", help="file of directive lines")
    p.add_argument("-p", "--parameter", action="append", default=[], help="a directive line that overrides the file")
    p.add_argument("-r", "--restore", type=int, metavar="JOB", help="restore a version")
    p.add_argument("-t", "--trace", action="store_true", help="write PATH.trace instead of storing")
    p.add_argument("-d", "--delete", type=int, metavar="JOB", help="delete versions up to this one")
    p.add_argument("-s", "--stat", action="store_true", help="print totals")
    a = p.parse_args(argv)
    text = ""
    if os.path.exists(a.config):
        with open(a.config) as f:
            text = f.read()
    cfg = parse_config(text, tuple(a.parameter))
    spark = SparkSession.builder.appName("chunkloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    ws = Workspace(spark, cfg, cfg.working_directory)
    if a.stat:
        ws.stat().show(truncate=False)
    elif a.delete is not None:
        print(f"{len(ws.delete(a.delete))} containers can be reclaimed")
    elif not a.path:
        p.error("PATH is missing")
    elif a.restore is not None:
        if cfg.simulation_level == "no":
            print(f"{ws.restore_to(a.restore, a.path)} files restored")
        ws.simulate_restore(a.restore).show(truncate=False)
    elif a.trace:
        files = snapshots.directory_files(spark, a.path, 0)
        trace.write_trace(trace.trace_lines(chunking.chunks(files, cfg), files), 0, a.path.rstrip("/") + ".trace")
    else:
        bv = ws.backup_trace(a.path) if cfg.simulation_level == "all" else ws.backup_directory(a.path)
        print(f"version {bv}")
        ws.log().show(truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
