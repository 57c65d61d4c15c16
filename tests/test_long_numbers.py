"""Numbers of more digits than a long has, against the SQL of dq_type."""

import duckdb

from lodestone.plans import quality


def test_whole_numbers_of_any_length_are_whole(spark, tmp_path):
    texts = ["12 4.5", "9" * 30, "0" * 25 + " 1.2.3", None, "", "7 -88 1..2"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    run, sql = quality.QUERIES["dq_type"]
    mine = sorted(tuple(r) for r in run(spark, str(tmp_path)).select("rule_id", "severity", "entity", "field", "hit").collect())
    assert mine == sorted(con.execute(sql).fetchall())
    assert [r[4] for r in mine] == ["4.5", "1.2.3", "1..2"]
