"""Compare registered queries with their SQL run by DuckDB, value for value.

As a script: ``python tests/oracle.py [folder] [query ...]``.
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from weftline.sources.tables import TABLES  # noqa: E402

# DuckDB type -> Spark type. HUGEINT and decimals must be cast in the SQL.
TYPES = {
    "BIGINT": "bigint",
    "INTEGER": "int",
    "DOUBLE": "double",
    "FLOAT": "float",
    "VARCHAR": "string",
    "BOOLEAN": "boolean",
    "DATE": "date",
    "TIMESTAMP": "timestamp_ntz",
}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def differences(frame, con, sql: str) -> list[str]:
    """What differs between a Spark result and a DuckDB result; empty if equal."""
    relation = con.sql(sql)
    wanted = {n: TYPES.get(str(t), str(t)) for n, t in zip(relation.columns, relation.types)}
    given = dict(frame.dtypes)
    if wanted != given:
        odd = sorted(set(wanted.items()) ^ set(given.items()))
        if set(wanted) != set(given):
            return [f"columns {odd}"]
        problems = [f"types {odd}"]
    else:
        problems = []
    columns = sorted(given)
    left = sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=_sort_key)
    order = [relation.columns.index(c) for c in columns]
    right = sorted((tuple(r[i] for i in order) for r in relation.fetchall()), key=_sort_key)
    if len(left) != len(right):
        return [*problems, f"rows {len(left)} against {len(right)}"]
    for mine, theirs in zip(left, right):
        if mine != theirs and not _both_nan(mine, theirs):
            return [*problems, f"{columns}: {mine} against {theirs}"]
    return problems


def _sort_key(row):
    return [(v is None, str(type(v)), v if v is not None else 0) for v in row]


def _both_nan(a, b):
    def plain(v):
        return "nan" if isinstance(v, float) and math.isnan(v) else v

    return [plain(v) for v in a] == [plain(v) for v in b]


def main(argv: list[str]) -> int:
    import __spark_entry__ as spark_entry
    from weftline.session import build_session

    folder = "/root/testdata/sf0.01"
    if argv and argv[0].startswith("/"):
        folder = argv.pop(0)
    spark = build_session("local[8]", 8, **{"spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    sql = spark_entry.oracle_sql()
    failed = 0
    for name, run in spark_entry.queries().items():
        if argv and not any(name.startswith(a) for a in argv):
            continue
        start = time.time()
        try:
            frame = run(spark, folder)
            if name in sql:
                problems = differences(frame, con, sql[name])
                note = f"{relation_size(con, sql[name])} rows"
            else:
                problems, note = [], f"{len(frame.collect())} rows, no SQL"
        except Exception as error:  # report every query, not only the first failure
            problems, note = [str(error)[:1500]], ""
        failed += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name} {time.time() - start:.1f}s {note}", *problems, flush=True)
    print("failed:", failed)
    spark.stop()
    return failed


def relation_size(con, sql: str) -> int:
    return con.sql(sql).aggregate("count(*)").fetchall()[0][0]


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
