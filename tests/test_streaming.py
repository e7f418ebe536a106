from foliant.streaming.ingest import current, ingest


def test_files_are_read_once_and_the_last_row_wins(spark, tmp_path):
    folder, table, marks = (str(tmp_path / x) for x in ("in", "table", "marks"))
    schema = "id long, v string, seq long"
    spark.createDataFrame([(1, "a", 1), (2, "b", 1), (1, "c", 2)], schema).write.parquet(folder)
    ingest(spark, folder, schema, table, marks, "id", ["seq"])
    ingest(spark, folder, schema, table, marks, "id", ["seq"])
    spark.createDataFrame([(2, "d", 2), (3, "e", 1)], schema).write.mode("append").parquet(folder)
    ingest(spark, folder, schema, table, marks, "id", ["seq"])
    assert sorted(map(tuple, current(spark, table, schema, "id", ["seq"]).collect())) == [(1, "c", 2), (2, "d", 2), (3, "e", 1)]
