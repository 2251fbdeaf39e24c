"""Compare registered queries with their DuckDB equivalents.

    python tests/oracle_check.py /root/testdata/sf0.01 g1 g2 ...
"""

from __future__ import annotations

import math
import os
import signal
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def canonical(pdf: pd.DataFrame) -> list[tuple]:
    rows = []
    # whole numbers with nulls are floats on one side and nullable integers on the other
    pdf = pdf.astype({c: "float64" for c in pdf.columns if str(pdf[c].dtype) == "Int64" and pdf[c].isna().any()})
    for row in pdf[sorted(pdf.columns)].itertuples(index=False):
        out = []
        for v in row:
            if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
                out.append("")
            elif hasattr(v, "item"):
                out.append(repr(v.item()))
            else:
                out.append(repr(v))
        rows.append(tuple(out))
    return sorted(rows)


def compare(spark_pdf: pd.DataFrame, duck_pdf: pd.DataFrame) -> str | None:
    if sorted(spark_pdf.columns) != sorted(duck_pdf.columns):
        return f"columns differ: {sorted(spark_pdf.columns)} / {sorted(duck_pdf.columns)}"
    if len(spark_pdf) != len(duck_pdf):
        return f"rows differ: spark {len(spark_pdf)} duckdb {len(duck_pdf)}"
    bad_types = [
        (c, str(spark_pdf[c].dtype), str(duck_pdf[c].dtype))
        for c in spark_pdf.columns
        if spark_pdf[c].dtype != duck_pdf[c].dtype and not spark_pdf[c].isna().any()
    ]
    left, right = canonical(spark_pdf), canonical(duck_pdf)
    diff = [(x, y) for x, y in zip(left, right) if x != y]
    if diff:
        return f"{len(diff)} of {len(left)} rows differ, e.g. {diff[:3]}"
    if bad_types:
        return f"types differ: {bad_types}"
    return None


def main(argv: list[str]) -> int:
    from __spark_entry__ import oracle_sql, queries
    from strandline.session import local_session

    sf_dir, wanted = argv[0], argv[1:]
    spark = local_session("oracle-check")
    con = connect(sf_dir)
    oracles = oracle_sql()
    failures = 0

    def late(*_):
        raise TimeoutError("query took too long")

    signal.signal(signal.SIGALRM, late)
    for name, fn in queries().items():
        if wanted and not any(name == w or name.startswith(w + "_") or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        t0 = time.time()
        signal.alarm(int(os.environ.get("QUERY_SECONDS", "90")))
        try:
            got = fn(spark, sf_dir).toPandas()
            t1 = time.time()
            if name not in oracles:
                print(f"ROWS {name}: {len(got)} rows, {t1 - t0:.1f}s", flush=True)
                continue
            problem = compare(got, con.execute(oracles[name]).df())
            t2 = time.time()
        except Exception as exc:  # report and go on with the other queries
            problem, t1, t2, got = f"{type(exc).__name__}: {str(exc)[:1500]}", time.time(), time.time(), []
            spark.sparkContext.cancelAllJobs()
        signal.alarm(0)
        failures += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name}: {len(got)} rows, spark {t1 - t0:.1f}s duckdb {t2 - t1:.1f}s {problem or ''}", flush=True)
    return failures


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
