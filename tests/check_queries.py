"""python tests/check_queries.py [folder] [name ...]: every query against its SQL, with times."""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from millrace.session import build_session
from tests import oracle


def main() -> int:
    import __spark_entry__ as contract

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:]
    spark = build_session(
        master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
           "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle.connect(folder)
    sqls, bad = contract.oracle_sql(), 0
    for name, query in contract.queries().items():
        if chosen and name not in chosen:
            continue
        start = time.time()
        try:
            df = query(spark, folder)
            if name in sqls:
                problem = oracle.compare(df, con, sqls[name])
                verdict = problem or "ok"
            else:
                problem, verdict = None, f"ok (rows only: {df.count()})"
        except Exception as error:  # report and go on
            problem = verdict = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += problem is not None
        print(f"{name:24s} {time.time() - start:6.2f}s {verdict}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
