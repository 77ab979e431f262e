"""Runs named queries (all by default) against their check SQL and prints a table."""

from __future__ import annotations

import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

import checking  # noqa: E402
import __spark_entry__ as entry  # noqa: E402
from lectern.session import build_session  # noqa: E402


def main() -> None:
    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = build_session("verify", **{
        "spark.master": "local[8]", "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = checking.connect(folder)
    checks, queries = entry.oracle_sql(), entry.queries()
    names = sys.argv[1:] or list(queries)
    bad = 0
    for name in names:
        start = time.time()
        try:
            frame = queries[name](spark, folder)
            if name in checks:
                message, rows = checking.differences(frame, con, checks[name])
            else:
                rows, message = len(frame.collect()), None
        except Exception as error:  # report and go on with the next query
            message, rows = f"{type(error).__name__}: {str(error)[:1500]}", -1
        bad += message is not None
        kind = "sql" if name in checks else "rows"
        print(f"{'FAIL' if message else 'ok  '} {name:22s} {kind:4s} rows={rows} "
              f"{time.time() - start:.2f}s", flush=True)
        if message:
            print("   ", message, flush=True)
    print(f"{len(names) - bad} of {len(names)} good")


if __name__ == "__main__":
    main()
