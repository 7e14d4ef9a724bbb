"""Typed CSV scans: what is rejected, counted and raised."""

import pytest
from pyspark.sql import functions as F

from harborline.sources.parsers import SourceError
from harborline.sources.staged import STAGED, scan_csv, stage_csv, staged_table

KINDS = "id int not null, name string, day date, x double not null"


def written(tmp_path, *texts):
    for i, text in enumerate(texts):
        (tmp_path / f"{i}.csv").write_text(text)
    return str(tmp_path)


def test_rows_rejects_and_counts(spark, tmp_path):
    path = written(tmp_path, 'id,name,day,x\n1,"a, b",2024-01-02,1.5\n2,,,2\n3,c,2024-13-01,1\n4,d,2024-01-01\n5,e,2024-01-01,1,extra\n,f,2024-01-01,1\n', "id,name,day,x\n7,g,2024-01-01,\n8,ü,2024-01-01,-1e3\n")
    found = scan_csv(spark, path, KINDS)
    assert sorted((r.id, r.name, str(r.day), r.x) for r in found.rows.collect()) == [(1, "a, b", "2024-01-02", 1.5), (2, None, "None", 2.0), (8, "ü", "2024-01-01", -1000.0)]
    assert sorted((r.line.split(",")[0], r.reason) for r in found.rejects.collect()) == [("", "missing id"), ("3", "malformed"), ("4", "malformed"), ("5", "malformed"), ("7", "missing x")]
    assert sorted(tuple(r)[1:] for r in found.counts().collect()) == [(1, 1, 0, 1), (2, 4, 3, 1)]
    assert found.rows.select("name").count() == 3 and found.rejects.select("reason").count() == 5 and found.rows.dtypes == [("id", "int"), ("name", "string"), ("day", "date"), ("x", "double")]


def test_a_header_of_other_names_raises(spark, tmp_path):
    with pytest.raises(Exception, match="CSV header"):
        scan_csv(spark, written(tmp_path, "id,day,name,x\n1,2024-01-02,a,1\n"), KINDS).rows.collect()


def test_staged_tables_round_trip(spark, tmp_path):
    rows = spark.range(5).select(F.col("id").cast("string").alias("customer_id"), F.lit("2024-01-01").cast("date").alias("acquired_date"), F.when(F.col("id") > 2, F.lit("2024-02-01").cast("date")).alias("churn_date"), *[F.lit(i).alias(c) for i, c in enumerate(("churned", "censored", "observed_months"))])
    stage_csv(rows, f"{tmp_path}/churn_outcomes")
    assert staged_table(spark, str(tmp_path), "churn_outcomes").exceptAll(rows).count() == 0
    (tmp_path / "churn_outcomes" / "bad.csv").write_text("customer_id,acquired_date,churn_date,churned,censored,observed_months\nx,2024-01-01,,no,1,1\n,2024-01-01,,1,1,1\n")
    with pytest.raises(SourceError, match="2 lines rejected"):
        staged_table(spark, str(tmp_path), "churn_outcomes")
    assert staged_table(spark, str(tmp_path), "churn_outcomes", 2).count() == 5
    with pytest.raises(SourceError):
        staged_table(spark, str(tmp_path), "nothing")
    assert set(STAGED) >= {"customers", "transactions", "holdings"}
