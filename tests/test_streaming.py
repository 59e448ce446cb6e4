"""B6/B9 as a stream: same rows as the batch form, once."""

from pyspark.sql import functions as F

from panelwright.sources.text import read_delimited, read_table
from panelwright.streaming.load import load_stream, stream_delimited

SCHEMA = "d string, v string"


def drain(spark, tmp_path, checkpoint="cp"):
    rows = stream_delimited(spark, str(tmp_path / "in"), SCHEMA)
    query = load_stream(rows, ["d", "v"], str(tmp_path / "out"), str(tmp_path / checkpoint), "s", "L", "2026-01-01 00:00:00")
    query.awaitTermination(120)
    assert query.exception() is None


def test_stream_equals_batch_and_repeats_nothing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("d;v\n2026-01-01;1\n2026-01-01;1\n2026-01-02;\n")
    drain(spark, tmp_path)
    out = read_table(spark, str(tmp_path / "out"))
    batch = read_delimited(spark, str(tmp_path / "in"))
    assert out.select("d", "v").exceptAll(batch).count() == 0 and out.count() == batch.count() == 3
    drain(spark, tmp_path)
    assert read_table(spark, str(tmp_path / "out")).count() == 3
    (tmp_path / "in" / "b.csv").write_text("d;v\n2026-01-03;3\n")
    drain(spark, tmp_path)
    assert read_table(spark, str(tmp_path / "out")).count() == 4
    # a lost checkpoint replays every file; the counted difference drops all of it
    drain(spark, tmp_path, "cp2")
    final = read_table(spark, str(tmp_path / "out"))
    assert final.count() == 4
    assert final.filter(F.col("_source_object").contains("/in/a.csv@")).count() == 3


def test_files_of_one_name_and_time_in_two_folders(spark, tmp_path):
    import os

    for name in ("x", "y"):
        (tmp_path / "in" / name).mkdir(parents=True)
        (tmp_path / "in" / name / "a.csv").write_text("d;v\n2026-01-01;1\n")
        os.utime(tmp_path / "in" / name / "a.csv", (1_700_000_000, 1_700_000_000))
        rows = stream_delimited(spark, str(tmp_path / "in" / "*"), SCHEMA)
        query = load_stream(rows, ["d", "v"], str(tmp_path / "out"), str(tmp_path / "cp"), "s", "L", "2026-01-01 00:00:00")
        query.awaitTermination(120)
    assert read_table(spark, str(tmp_path / "out")).count() == 2
