"""Run every registered query against its SQL in DuckDB: python tests/compare.py [sf_dir] [names]."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = """region nation customer supplier part orders lineitem events documents embeddings pages
benchmark labels conversations""".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def compare(df, con, sql) -> str:
    """'' if both sides have the same columns, types and rows, else what differs."""
    mine = df.toArrow()
    theirs = con.sql(sql).to_arrow_table()
    names = sorted(mine.column_names)
    if names != sorted(theirs.column_names):
        return f"columns {names} / {sorted(theirs.column_names)}"
    kinds = [(n, str(mine.schema.field(n).type), str(theirs.schema.field(n).type)) for n in names]
    odd = [k for k in kinds if k[1] != k[2] and not (k[1].startswith("large_") or k[2].startswith("large_"))]
    if odd:
        return f"types {odd}"

    def rows(table):
        return sorted(zip(*[table.column(n).to_pylist() for n in names]), key=repr)

    a, b = rows(mine), rows(theirs)
    if a != b:
        wrong = [(x, y) for x, y in zip(a, b) if x != y][:2]
        return f"rows {len(a)} / {len(b)}: {wrong}"
    return ""


def main() -> int:
    from conftest import new_session

    from dirgauge.plans import oracle, registry

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, con, texts = new_session(), connect(sf_dir), oracle.oracle_sql()
    wanted = sys.argv[2:] or list(registry.queries())
    failures = 0
    for name in wanted:
        began = time.time()
        try:
            problem = compare(registry.queries()[name](spark, sf_dir), con, texts[name])
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failures += bool(problem)
        print(f"{'FAIL' if problem else 'ok':4} {name} {time.time() - began:.2f}s {problem}", flush=True)
    print(f"{len(wanted) - failures} of {len(wanted)} equal")
    return failures


if __name__ == "__main__":
    sys.exit(main())
