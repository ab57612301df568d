"""Run named queries against DuckDB: ``python tests/check_queries.py FOLDER [name ...]``."""

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), ".."))

from newsloom.session import build_session  # noqa: E402
from tests.compare import compare, connect  # noqa: E402


def main() -> int:
    import __spark_entry__ as entry

    folder, wanted = sys.argv[1], sys.argv[2:]
    spark = build_session(
        "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
           "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, oracle = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in wanted or queries:
        start = time.time()
        try:
            df = queries[name](spark, folder)
            if name in oracle:
                found, rows = compare(df, con, oracle[name])
                note = found or f"{rows} rows"
            else:
                found, note = None, f"no sql, {df.count()} rows"
        except Exception as error:  # noqa: BLE001
            found = note = f"{type(error).__name__}: {str(error)[:700]}"
            if os.environ.get("TRACE"):
                traceback.print_exc()
        failed += found is not None
        print(f"{'FAIL' if found else 'pass'} {name} {time.time() - start:.1f}s {note}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main())
