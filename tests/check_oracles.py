"""Compare every query with its SQL counterpart: ``python tests/check_oracles.py DIR [name...]``."""

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir):
    db = duckdb.connect()
    for name in TABLES:
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return db


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(row[i] for i in order) for row in rows), key=repr)


def same_type(spark_type, duck_type):
    known = {
        "string": "VARCHAR",
        "int": "INTEGER",
        "bigint": "BIGINT",
        "double": "DOUBLE",
        "boolean": "BOOLEAN",
    }
    return known.get(spark_type) == str(duck_type)


def compare(frame, result):
    """Problems found, empty if none."""
    problems = []
    types = dict(zip(result.columns, result.types))
    if sorted(frame.columns) != sorted(result.columns):
        return [f"columns {sorted(frame.columns)} and {sorted(result.columns)}"]
    for name, kind in frame.dtypes:
        if not same_type(kind, types[name]):
            problems.append(f"type of {name}: {kind} and {types[name]}")
    ours = rows_of(frame.columns, [tuple(row) for row in frame.collect()])
    theirs = rows_of(result.columns, result.fetchall())
    if len(ours) != len(theirs):
        problems.append(f"{len(ours)} and {len(theirs)} rows")
    if not ours:
        problems.append("no rows")
    differing = [(a, b) for a, b in zip(ours, theirs) if repr(a) != repr(b)]
    if differing:
        problems.append(f"{len(differing)} rows differ, first {differing[0]}")
    if any(isinstance(x, float) and math.isnan(x) for row in ours for x in row):
        problems.append("not a number")
    return problems


def main(sf_dir, *names):
    import __spark_entry__ as entry
    from trendloom.session import get_session

    spark = get_session(
        "check",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "12g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    db, sql, failed = connect(sf_dir), entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            frame = query(spark, sf_dir)
            if name in sql:
                problems = compare(frame, db.sql(sql[name]))
            else:
                problems = [] if frame.count() else ["no rows"]
        except Exception as error:  # report and go on
            problems = [f"{type(error).__name__}: {str(error)[:600]}"]
        failed += bool(problems)
        kind = "sql " if name in sql else "rows"
        print(f"{'FAIL' if problems else 'ok  '} {kind} {name} {time.time() - start:.1f}s", *problems)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(*sys.argv[1:]) else 0)
