"""Compare registered queries with their SQL twins (also usable from the shell)."""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

from fieldloom.sources.derived import BASE  # noqa: E402


def make_spark() -> SparkSession:
    return (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def make_duck(sf_dir: str):
    con = duckdb.connect()
    for name in BASE:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, (dt.datetime, dt.date)):
        return value.isoformat()
    if isinstance(value, bool) or value is None:
        return str(value)
    return repr(value)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(_plain(r[i]) for i in order) for r in data)


def check(spark, con, sf_dir, name, fn, sql) -> str | None:
    df = fn(spark, sf_dir)
    got_names, got = rows(df.columns, [tuple(r) for r in df.collect()])
    if not got:
        return "no rows"
    if sql is None:
        return None
    cur = con.execute(sql)
    want_names, want = rows([d[0] for d in cur.description], cur.fetchall())
    if got_names != want_names:
        return f"columns {got_names} != {want_names}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}; first only-spark {sorted(set(got) - set(want))[:2]} only-duck {sorted(set(want) - set(got))[:2]}"
    for a, b in zip(got, want):
        if a != b:
            return f"value\n   spark {a}\n   duck  {b}"
    return None


def main(argv):
    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
    from fieldloom.catalog import registry

    areas = [a for a in argv if a in registry._AREAS]
    if areas:
        registry._AREAS = tuple(areas)
    spark = make_spark()
    spark.sparkContext.setLogLevel("ERROR")
    con = make_duck(sf_dir)
    queries, twins = registry.queries(), registry.oracle_sql()
    names = [n for n in queries if areas or not argv or n in argv]
    bad = 0
    for name in names:
        start = time.time()
        try:
            problem = check(spark, con, sf_dir, name, queries[name], twins.get(name))
        except Exception as error:  # report and go on
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        took = time.time() - start
        if problem or took > 3:
            print(f"{'FAIL' if problem else 'slow'} {name} {took:.1f}s {problem or ''}", flush=True)
        bad += bool(problem)
    print(f"{len(names) - bad}/{len(names)} ok, {sum(n in twins for n in names)} with twin", flush=True)


if __name__ == "__main__":
    main(sys.argv[1:])
