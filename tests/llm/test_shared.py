import os

from pyspark.sql import functions as F

from logsieve.llm.shared import clean, held_out, held_out_py, materialize, tables_dir
from logsieve.llm.suffix_dedup import removed_bytes


def test_tables_are_written_to_the_shared_folder_and_removed(spark):
    clean(spark)
    kept = materialize(spark.range(5), "x")
    assert kept.count() == 5 and os.listdir(tables_dir(spark))
    removed_bytes(spark.createDataFrame([(1, "a" * 300)], "doc_id long, text string")).count()
    spark.sql("create table logsieve_another_application_x (a int)")
    assert sum(t.name.startswith("logsieve_") for t in spark.catalog.listTables()) > 1
    clean(spark)
    assert not os.path.exists(tables_dir(spark)) and [t.name for t in spark.catalog.listTables() if t.name.startswith("logsieve_")] == ["logsieve_another_application_x"]
    spark.sql("drop table logsieve_another_application_x")


def test_held_out_rows(spark):
    rows = spark.range(200).select("id", held_out(F.col("id")).alias("h")).collect()
    assert [r.h for r in rows] == [held_out_py(r.id) for r in rows]
