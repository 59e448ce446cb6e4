"""Archives and documents whose partitions and members are long: what a task holds doesn't grow with them."""

import csv
import io
import json
import time
import tracemalloc
import types
import zipfile
from collections import Counter
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelwright.plans import loading, standins
from panelwright.sources import archives, text

NAMES = ("lines_1997.csv@2026-02-11T08:15:30", "lines_1998.csv@2026-08-04T21:05:10")


class Declared:
    """Takes the place of a DataFrame; the function that tasks would run is ``run``."""

    def __init__(self, spark, columns):
        self.sparkSession, self.columns, self.write = spark, columns, self

    def mapInArrow(self, function, schema):
        self.run = function
        return self

    def same(self, *arguments, **options):
        return self

    select = repartition = sortWithinPartitions = format = mode = save = same


@pytest.mark.parametrize("kind", ["zip", "json"])
def test_a_partition_is_written_batch_by_batch(spark, tmp_path, monkeypatch, kind):
    def batches():
        for i in range(100):
            yield pa.RecordBatch.from_pydict({"a": [f"{i}-{k};{'x' * 40}" for k in range(500)], "b": ["ü", None] * 250, "_source_object": [NAMES[i // 50]] * 500})

    monkeypatch.setattr(standins, "TaskContext", types.SimpleNamespace(get=lambda: types.SimpleNamespace(partitionId=lambda: 7)))
    rows = Declared(spark, ["a", "b", "_source_object"])
    standins.write_files(rows, str(tmp_path), kind)
    tracemalloc.start()
    try:
        assert [b.to_pylist() for b in rows.run(batches())] == [[{"n": 1}]]
        assert tracemalloc.get_traced_memory()[1] < 3 << 20
    finally:
        tracemalloc.stop()
    if kind == "json":
        found = json.loads((tmp_path / "part-00007.json").read_text())["value"]
        assert found == [r for b in batches() for r in b.to_pylist()]
        return
    with zipfile.ZipFile(tmp_path / "part-00007.zip") as z:
        assert [i.filename for i in z.infolist()] == ["2026-02-11_lines_1997.csv", "2026-08-04_lines_1998.csv"]
        assert z.infolist()[1].date_time == (2026, 8, 4, 21, 5, 10)
        for half, name in enumerate(z.namelist()):
            read = list(csv.reader(io.StringIO(z.read(name).decode("utf-8-sig")), delimiter=";"))
            want = [[r["a"], r["b"] or ""] for b in list(batches())[half * 50 : half * 50 + 50] for r in b.to_pylist()]
            assert read == [["a", "b"], *want]


def test_no_partition_makes_no_file(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(standins, "TaskContext", types.SimpleNamespace(get=lambda: types.SimpleNamespace(partitionId=lambda: 7)))
    rows = Declared(spark, ["a", "_source_object"])
    standins.write_files(rows, str(tmp_path), "zip")
    assert [b.to_pylist() for b in rows.run(iter([]))] == [[{"n": 0}]] and not list(tmp_path.iterdir())


def test_mixed_rows_make_one_member_of_a_name(spark, tmp_path):
    name = F.when(F.col("id") % 2 == 0, F.lit(NAMES[0])).otherwise(F.lit(NAMES[1]))
    rows = spark.range(25_000).repartition(2).select(F.col("id").cast("string").alias("a"), F.lit('"q;\n').alias("b"), name.alias("_source_object"))
    standins.write_files(rows, str(tmp_path / "in"), "zip")
    for path in (tmp_path / "in").glob("*.zip"):
        with zipfile.ZipFile(path) as z:
            assert len(z.namelist()) == len(set(z.namelist())) == 2
    members = archives.archive_members(archives.list_archives(spark, str(tmp_path / "in")))
    read = archives.member_rows(members, ["a", "b"])
    assert read.filter("b = '\"q;\\n'").count() == read.select("a").distinct().count() == 25_000
    halves = {r["member"]: (r["least"], r["most"]) for r in read.groupBy("member").agg(F.min(F.col("a") % 2).alias("least"), F.max(F.col("a") % 2).alias("most")).collect()}
    assert halves == {"2026-02-11_lines_1997.csv": (0, 0), "2026-08-04_lines_1998.csv": (1, 1)}


def reader(spark, columns):
    members = Declared(spark, [])
    archives.tagged_rows(members, columns)
    return members.run


def listed(path, encoding=archives.UNICODE):
    row = {"archive": "a.zip", "member": "m.csv", "version_ts": "t", "crc32": "c", "path": str(path), "encoding": encoding, "header": ["a", "b"]}
    return iter([pa.RecordBatch.from_pylist([row])])


def test_a_long_member_is_not_read_far_ahead(spark, tmp_path, monkeypatch):
    class Counted(io.FileIO):
        bytes_read = 0

        def size(self):
            return self.seek(0, 2)

        def read(self, *arguments):
            got = super().read(*arguments)
            Counted.bytes_read += len(got)
            return got

    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_STORED) as z:
        z.writestr("m.csv", b"a;b\n" + b"1234567;7654321\n" * (4 << 20))
    monkeypatch.setattr(archives, "_open", Counted)
    batches = reader(spark, ["a", "b"])(listed(tmp_path / "a.zip"))
    rows = next(batches).num_rows
    time.sleep(1)
    assert Counted.bytes_read < 24 << 20
    assert rows + sum(b.num_rows for b in batches) == 4 << 20


@pytest.mark.parametrize("encoding", [archives.UNICODE, archives.SINGLE_BYTE])
@pytest.mark.parametrize("record", ["x" * (1 << 20) + ";é", '"' + "y\n" * (1 << 19) + '";é'])
def test_a_record_longer_than_a_block_is_read_whole(spark, tmp_path, encoding, record):
    lines = [f"{i};ü{i}" if i % 5 else f"s{i}" for i in range(60_000)]
    text = "\n".join(["a;b", *lines, record, *lines, ""])
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("m.csv", text.encode(encoding))
    found = Counter()
    for batch in reader(spark, ["a", "b"])(listed(tmp_path / "a.zip", encoding)):
        found.update((r["tag"], r["a"], r["b"]) for r in batch.to_pylist())
    want = Counter()
    for line in [*lines, *lines]:
        want["row", *(line.split(";") + [""])[:2]] += 1
    want["row", record.rpartition(";")[0].strip('"'), "é"] += 1
    assert found == want


def test_rows_are_staged_as_they_come(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    with zipfile.ZipFile(tmp_path / "in/a.zip", "w") as z:
        z.writestr("good.csv", "a;b\n1;2\n3\n")
        z.writestr("bad.csv", "a;b\n1;2;3\n")
    kept = []
    monkeypatch.setattr(loading, "delete_path", lambda session, path: kept.append(path))
    arguments = (f"{tmp_path}/_bronze", f"{tmp_path}/_control", ["a", "b"], "s", "L", "2026-10-01 00:00:00")
    outcome = loading.load_archives(spark, str(tmp_path / "in"), *arguments)
    assert {r["member"]: r["status"] for r in outcome.collect()} == {"good.csv": "complete", "bad.csv": "in_progress"}
    assert {(r["a"], r["b"]) for r in text.read_table(spark, f"{tmp_path}/_bronze").collect()} == {("1", "2"), ("3", "")}
    assert not [p for p in Path(kept[0].removeprefix("file:")).iterdir() if p.is_dir()]  # a folder for each tag takes a sort
    assert {r["tag"]: r["count"] for r in spark.read.parquet(kept[0]).groupBy("tag").count().collect()} == {"row": 2, "error": 1}
