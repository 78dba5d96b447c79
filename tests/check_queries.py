"""Runs registered queries against their SQL in DuckDB: check_queries.py SF [NAME…]."""

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6g}"
    if isinstance(value, list):
        return [_plain(v) for v in value]
    return value if value is None or isinstance(value, (bool, str)) else str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(repr([_plain(_number(r[k])) for k in order]) for r in rows)


def _number(value):
    # whole numbers compare as numbers whatever their type
    if isinstance(value, bool) or value is None or isinstance(value, (str, list)):
        return value
    return float(value)


def compare(spark, con, name, query, sql, sf_dir):
    """(matches, rows, spark seconds, sql seconds, first difference)"""
    begin = time.monotonic()
    df = query(spark, sf_dir)
    got = df.collect()
    middle = time.monotonic()
    if sql is None:
        return None, len(got), middle - begin, 0.0, None
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    want = found.fetchall()
    end = time.monotonic()
    if sorted(names) != sorted(df.columns):
        return False, len(got), middle - begin, end - middle, (sorted(df.columns), sorted(names))
    left, right = rows_of(df.columns, got), rows_of(names, want)
    differing = None if left == right else next(
        ((a, b) for a, b in zip(left, right) if a != b), (f"{len(left)} rows", f"{len(right)} rows")
    )
    return left == right, len(got), middle - begin, end - middle, differing


def main(sf, wanted):
    import __spark_entry__ as driver
    from partatlas.session import local_session

    spark = local_session()
    sf_dir = f"/root/testdata/sf{sf}"
    con = connect(sf_dir)
    queries, oracle = driver.queries(), driver.oracle_sql()
    for name in wanted or queries:
        try:
            result = compare(spark, con, name, queries[name], oracle.get(name), sf_dir)
        except Exception as error:  # noqa: BLE001
            result = ("ERROR", str(error)[:700], 0, 0, None)
        print("=>", name, *[round(x, 2) if isinstance(x, float) else x for x in result], flush=True)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
