"""Run registered jobs and their SQL side by side: ``python tests/oracle_check.py [sf] [name …]``."""

from __future__ import annotations

import os
import sys
import tempfile
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def canonical_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def norm(value):
        if isinstance(value, bool) or value is None:
            return value
        if isinstance(value, float):
            return round(value, 6) if value != int(value) else int(value)
        return value if isinstance(value, (int, str)) else str(value)

    return [names[i] for i in order], sorted((tuple(norm(row[i]) for i in order) for row in rows), key=repr)


def compare(spark, connection, sf_dir, job, sql):
    frame = job(spark, sf_dir)
    names, rows = canonical_rows(frame.columns, [tuple(r) for r in frame.collect()])
    relation = connection.sql(sql)
    want_names, want = canonical_rows(relation.columns, relation.fetchall())
    if names != want_names:
        return f"columns {names} <> {want_names}"
    if rows != want:
        extra = [r for r in rows if r not in set(want)][:2]
        missing = [r for r in want if r not in set(rows)][:2]
        return f"rows {len(rows)} <> {len(want)}; only spark {extra}; only sql {missing}"
    return None


def main(argv):
    import __spark_entry__ as entry
    from contentflow.session import local_session

    sf_dir = f"/root/testdata/{argv[0] if argv else 'sf0.01'}"
    spark, connection = local_session("8", scratch=tempfile.mkdtemp(prefix="contentflow-check-")), duck(sf_dir)
    jobs, sql = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in argv[1:] or jobs:
        started = time.time()
        try:
            if name in sql:
                problem = compare(spark, connection, sf_dir, jobs[name], sql[name])
            else:
                problem = None if jobs[name](spark, sf_dir).count() >= 0 else "none"
        except Exception as error:  # report and go on
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name} {time.time() - started:.1f}s {'' if name in sql else '(rows only)'} {problem or ''}", flush=True)
    print(f"{bad} bad; without SQL: {sorted(set(jobs) - set(sql))}; SQL without job: {sorted(set(sql) - set(jobs))}")


if __name__ == "__main__":
    main(sys.argv[1:])
