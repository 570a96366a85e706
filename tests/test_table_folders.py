"""Streams over a table that is one file or a folder of files."""

from tidemark.streaming import streams as ST


def test_stream_reads_a_file_and_a_folder_of_files(spark, tmp_path):
    rows = spark.range(20).repartition(4)
    rows.write.parquet(f"{tmp_path}/many.parquet")
    rows.coalesce(1).write.parquet(f"{tmp_path}/made")
    next((tmp_path / "made").glob("part-*.parquet")).rename(tmp_path / "one.parquet")
    for name in ("many.parquet", "one.parquet"):
        folder = ST.stream_folder(spark, "table-folder")
        ST.drain(ST.file_stream(spark, str(tmp_path), name, rows.schema), folder)
        assert sorted(r.id for r in spark.read.parquet(f"{folder}/out").collect()) == [*range(20)]
