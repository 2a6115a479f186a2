"""Queries against their SQL on tables unlike the given ones."""

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as entry
from millrace.functions import text
from millrace.operators import validate


def both(spark, name, folder, table, pattern):
    """Sorted rows of a query and of its SQL."""
    got = [tuple(r) for r in entry.queries()[name](spark, str(folder)).collect()]
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{pattern}')")
        want = db.execute(entry.oracle_sql()[name]).fetchall()
    return sorted(got, key=repr), sorted(want, key=repr)


def test_record_texts_numbers_beyond_six_digits(spark, tmp_path):
    ids = (0, 7, 99_999, 100_000, 999_999, 1_000_000, 1_000_001, 5_999_999, 12_345_678, 10**15, None)
    rows = [(i, '{"k": 5}') for i in ids] + [(2_000_000, '{"id": "own", "text": "t"}'), (3_000_000, None)]
    spark.createDataFrame(rows, "event_id long, props string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got, want = both(spark, "record_texts", tmp_path, "events", "events.parquet/*.parquet")
    assert got == want and (12_345_678, "events_2024_123456", "5") in got
    # The operator itself cuts no number.
    kept = spark.range(1).select(text.any_id(F.lit("{}"), ["id"], "b_2024", F.lit(12_345_678))).first()[0]
    assert kept == "b_2024_12345678"


def test_summary_of_a_table_in_several_files(spark, tmp_path):
    rows = [(i, ("en", "de", None)[i % 3], f"s{i % 2}" if i % 5 else None) for i in range(90)]
    frame = spark.createDataFrame(rows, "doc_id long, lang string, source string").repartition(6, "doc_id")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    got, want = both(spark, "summary_rollup", tmp_path, "documents", "documents.parquet/*.parquet")
    assert got == want and (None, None, 90, 1) in got
    # The operator itself counts files, or the shards it is given.
    stored = spark.read.parquet(f"{tmp_path}/documents.parquet")
    files = len(list((tmp_path / "documents.parquet").glob("*.parquet")))
    assert files > 1 and validate.summary(stored, ["lang"]).where("rows = 90").first().shards == files
    assert validate.summary(stored, ["lang"], F.col("doc_id") % 4).where("rows = 90").first().shards == 4
