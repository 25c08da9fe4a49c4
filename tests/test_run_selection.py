"""The choice of runs on numbers of more than four digits."""

import duckdb

import __spark_entry__ as entry


def test_numbers_of_five_digits_keep_them(spark, tmp_path):
    """A number is padded to four digits, never cut to them, in the query as in its SQL."""
    numbers = [3, 999, 1002, 9999, 10_002, 10_020, 123_456]
    made = {
        "customer": f"SELECT unnest({numbers}::BIGINT[]) AS c_custkey, 1.0::DOUBLE AS c_acctbal UNION ALL SELECT 12_003, -1.0",
        "orders": f"SELECT unnest({numbers + [12_003]}::BIGINT[]) AS o_custkey FROM range(4)",
    }
    db = duckdb.connect()
    for name, sql in made.items():
        db.sql(f"COPY ({sql}) TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
        db.sql(f"CREATE VIEW {name} AS FROM '{tmp_path}/{name}.parquet'")
    want = sorted(db.sql(entry.oracle_sql()["run_selection"]).fetchall())
    got = sorted(tuple(r) for r in entry.queries()["run_selection"](spark, str(tmp_path)).collect())
    assert got == want == sorted((f"coal-{k:04d}", "coal", k) for k in numbers if k % 3 == 0)
