"""python -m caselattice --input export.csv [--clusters 5] ...: compile a register to a payload file."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .plans.workbench import Workbench
from .sources.store import Store

COLUMNS = {"id_col": "Case_ID", "date_col": "Date", "department_col": "Department", "summary_col": "Case_Summary", "severity_col": "Severity_Score"}


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="caselattice", description=__doc__)
    p.add_argument("--input", required=True)
    p.add_argument("--clusters", type=int, default=5)
    p.add_argument("--seed", type=int, default=42)
    p.add_argument("--rounds", type=int, default=12, help="resampling rounds of the quality check")
    p.add_argument("--store", default="store", help="folder of the decision store")
    p.add_argument("--output", default="data.json")
    p.add_argument("--template")
    p.add_argument("--page", default="index.html")
    for flag in COLUMNS:
        p.add_argument(f"--{flag.replace('_', '-')}", help="column of the file to use")
    a = p.parse_args(args)
    overrides = {name: getattr(a, flag) for flag, name in COLUMNS.items() if getattr(a, flag)}
    bench = Workbench(SparkSession.builder.appName("caselattice").getOrCreate(), Store(SparkSession.active(), a.store), a.clusters, a.seed, a.rounds)
    try:
        bench.ingest(a.input, overrides)
    except (ValueError, FileNotFoundError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0 if bench.write(a.output, a.template, a.page) else 1


if __name__ == "__main__":
    sys.exit(main())
