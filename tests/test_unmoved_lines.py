"""Log lines are numbered and merged where they lie."""

from pyspark.sql import functions as F

from logwarden.sources.lines import number_lines, read_log_records


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_numbering_sorts_no_texts(spark, tmp_path):
    for name, n in (("a.log", 9000), ("b.log", 1), ("c.log", 4000)):
        (tmp_path / name).write_text("".join(f"line {i}\n" for i in range(1, n + 1)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        raw = spark.read.text(str(tmp_path)).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"), "value")
        lines = number_lines(raw)
        assert raw.select("_start").distinct().count() > 3
        assert lines.where(F.concat(F.lit("line "), F.col("physical_line")) == F.col("line")).count() == lines.count() == 13001
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert "row_number" not in plan(lines)


def test_records_of_indented_lines(spark, tmp_path):
    (tmp_path / "a.log").write_text(" x\n\n\ty\nhead\n  \n one\n\ttwo\nnext\nlast\n end\n")
    (tmp_path / "b.log").write_text(" only\n")
    rows = read_log_records(spark, str(tmp_path)).orderBy("file", "line_number").collect()
    assert [(r.line_number, r.line, list(r.flags), list(r.physical_line_range)) for r in rows] == [
        (1, " x\\n\ty", ["continuation_merged"], [1, 3]), (2, "head\\n one\\n\ttwo", ["continuation_merged"], [4, 7]), (3, "next", [], [8, 8]),
        (4, "last\\n end", ["continuation_merged"], [9, 10]), (1, " only", [], [1, 1])]
