"""A and B end to end: archives to stored rows, twice, interrupted, republished."""

import io
import json
import random
import tracemalloc
import zipfile

import pytest
from pyspark.sql import functions as F

from panelwright.operators import ingest
from panelwright.plans import loading
from panelwright.sources import archives, documents, text
from panelwright.sources.events import EventLog

REQUIRED = ["data_base", "uf", "modalidade", "numero_de_operacoes", "carteira_ativa"]
OLD, NEW = (2026, 2, 11, 8, 15, 30), (2026, 8, 4, 21, 5, 10)
HEADER = ";".join([*REQUIRED, "porte"])
LINES = [
    '2024-01-31;SP;"Financiamentos; imobiliários";10;1234,56;NA',
    "2024-01-31;RJ;Financiamentos;-1;;",
    "2024-01-31;RJ;Financiamentos;-1;;",
]


def write_zip(path, members):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, when, data in members:
            z.writestr(zipfile.ZipInfo(name, when), data)


def csv_bytes(lines=LINES, header=HEADER, encoding="utf-8-sig"):
    return "\r\n".join([header, *lines, ""]).encode(encoding)


@pytest.fixture()
def folder(tmp_path):
    write_zip(
        tmp_path / "2024.zip",
        [
            ("202401.csv", OLD, csv_bytes()),
            ("202402.csv", OLD, csv_bytes(encoding="latin-1")),
            ("202403.csv", OLD, csv_bytes(header=HEADER.replace("carteira_ativa", "outra"))),
            ("readme.txt", OLD, b"no"),
        ],
    )
    write_zip(tmp_path / "2025.zip", [("202501.csv", NEW, csv_bytes(["2025-01-31;AP;X;5;1,00"], ";".join(REQUIRED)))])
    (tmp_path / "broken.zip").write_bytes(b"this is no archive")
    return str(tmp_path)


def test_members_encoding_and_contract(spark, folder):
    listed = archives.archive_members(archives.list_archives(spark, folder))
    checked = {r["member"]: r for r in archives.file_contract(listed, REQUIRED).collect()}
    assert set(checked) == {"202401.csv", "202402.csv", "202403.csv", "202501.csv", ""}
    assert {r["archive"] for r in checked.values()} == {"2024.zip", "2025.zip", "broken.zip"}
    assert checked["202401.csv"]["encoding"] == "utf-8-sig" and checked["202402.csv"]["encoding"] == "latin-1"
    assert checked["202401.csv"]["version_ts"] == "2026-02-11T08:15:30"
    assert len(checked["202401.csv"]["crc32"]) == 8
    assert checked["202403.csv"]["contract"] == "rejected" and checked["202403.csv"]["missing"] == ["carteira_ativa"]
    assert checked[""]["contract"] == "bad_archive" and "zip" in checked[""]["error"]


def test_cut_character_at_the_probe_end():
    for raw, want in ((b"", "utf-8-sig"), ("ß;".encode(), "utf-8-sig"), (b"\xe9;", "latin-1"), ("ß".encode()[:1], "latin-1")):
        assert archives.member_encoding(io.BytesIO(raw)) == want
    late = b"a;b\n" + b"1;2\n" * 400_000 + b"\xfc;3\n"
    assert archives.member_encoding(io.BytesIO(late)) == "latin-1"
    assert archives.member_header(io.BytesIO('"x;1";"two\nlines";y\n1;2;3\n'.encode()), "utf-8-sig", ";") == ["x;1", "two\nlines", "y"]


def accepted(spark, folder):
    listed = archives.archive_members(archives.list_archives(spark, folder))
    return archives.file_contract(listed, REQUIRED).filter("contract = 'accepted'")


def test_rows_keep_text_and_extra_columns(spark, folder):
    members = accepted(spark, folder)
    columns = archives.header_columns(members)
    assert set(columns) == {*REQUIRED, "porte"}
    rows = archives.member_rows(members, columns)
    assert rows.count() == 7
    first = rows.filter("member = '202401.csv' AND uf = 'SP'").first()
    assert first["modalidade"] == "Financiamentos; imobiliários" and first["porte"] == "NA"
    assert rows.filter("member = '202401.csv' AND uf = 'RJ'").first()["carteira_ativa"] == ""
    assert rows.filter("member = '202402.csv' AND uf = 'SP'").first()["modalidade"] == "Financiamentos; imobiliários"
    assert rows.filter("member = '202501.csv'").first()["porte"] is None


CONTROL = "archive string, member string, version_ts string, crc32 string, source_object string, status string"


def load(spark, folder, root, control="_control"):
    return loading.load_archives(spark, folder, f"{root}/_bronze/rows", f"{root}/{control}", REQUIRED, "s", "L", "2026-10-01 00:00:00").count()


def states(spark, root):
    control = loading.read_control(loading.control_log(spark, f"{root}/_control"), f"{root}/_bronze/rows")
    return {r["member"]: r["status"] for r in control.collect()}


def test_idempotent_and_republished(spark, folder, tmp_path):
    root = str(tmp_path / "out")
    assert load(spark, folder, root) == 5
    table = text.read_table(spark, f"{root}/_bronze/rows")
    assert table.count() == 7 and "_ingestion_date" in table.columns
    first = {"202401.csv": "complete", "202402.csv": "complete", "202403.csv": "rejected", "202501.csv": "complete", "": "rejected"}
    assert states(spark, root) == first
    assert load(spark, folder, root) == 0
    assert text.read_table(spark, f"{root}/_bronze/rows").count() == 7

    newer = (2026, 10, 1, 0, 0, 0)
    earlier = open(folder + "/2025.zip", "rb").read()
    write_zip(folder + "/2025.zip", [("202501.csv", newer, csv_bytes(["2025-01-31;AP;X;5;1,00"], ";".join(REQUIRED)))])
    assert load(spark, folder, root) == 1
    stored = text.read_table(spark, f"{root}/_bronze/rows")
    assert stored.count() == 8
    assert stored.filter("_source_object LIKE '2025.zip!/202501.csv@%'").select("_source_object").distinct().count() == 2

    # the control log is lost: states come back from the stored rows, nothing is loaded twice
    rebuilt = {r["version_ts"]: r for r in ingest.rebuild_control(stored).filter("member = '202501.csv'").collect()}
    assert set(rebuilt) == {"2026-08-04T21:05:10", "2026-10-01T00:00:00"}
    assert rebuilt["2026-10-01T00:00:00"]["crc32"] is None and rebuilt["2026-10-01T00:00:00"]["archive"] == "2025.zip"
    assert load(spark, folder, root, "_control2") == 2  # the rejected member and the file that is no archive
    assert text.read_table(spark, f"{root}/_bronze/rows").count() == 8
    assert loading.control_log(spark, f"{root}/_control2").state().filter("crc32 IS NULL AND member <> ''").count() == 0

    # an archive that goes back to a version that is stored has nothing new
    open(folder + "/2025.zip", "wb").write(earlier)
    assert load(spark, folder, root) == 0


def test_members_of_one_name_in_two_archives(spark, tmp_path):
    for name in ("a", "b"):
        write_zip(tmp_path / f"{name}.zip", [("rows.csv", OLD if name == "a" else NEW, csv_bytes([f"2024-01-31;SP;{name}{i};1;1,00;x" for i in range(10)]))])
    root = str(tmp_path / "out")
    for changes in (2, 0, 0):
        assert load(spark, str(tmp_path), root) == changes
        assert text.read_table(spark, f"{root}/_bronze/rows").count() == 20


def test_a_fault_stays_with_its_member(spark, tmp_path):
    members = [
        ("good.csv", OLD, csv_bytes()),
        ("short.csv", OLD, csv_bytes(["2024-01-31;SP;\"a;b\";1", LINES[0], "2024-02-29"])),
        ("long.csv", OLD, csv_bytes([*LINES, "1;2;3;4;5;6;7"])),
        ("damaged.csv", OLD, csv_bytes(["2024-01-31;SP;damaged;1;1,00;x"] * 500)),
        ("after.csv", OLD, csv_bytes()),
    ]
    write_zip(tmp_path / "a.zip", members)
    with zipfile.ZipFile(tmp_path / "a.zip") as z:
        info = z.getinfo("damaged.csv")
        at = info.header_offset + 30 + len(info.filename) + info.compress_size // 2
    raw = bytearray((tmp_path / "a.zip").read_bytes())
    raw[at] ^= 0xFF
    (tmp_path / "a.zip").write_bytes(raw)
    root = str(tmp_path / "out")
    # a first load that died has left a half-made folder
    (tmp_path / "out/_bronze/rows/_temporary/0").mkdir(parents=True)
    assert load(spark, str(tmp_path), root) == 5
    stored = text.read_table(spark, f"{root}/_bronze/rows")
    by_member = {r[0]: r["count"] for r in stored.groupBy(F.substring_index(F.substring_index("_source_object", "!/", -1), "@", 1)).count().collect()}
    assert by_member == {"good.csv": 3, "short.csv": 3, "after.csv": 3}
    short = stored.filter("_source_object LIKE '%short%'")
    assert short.filter("modalidade = 'a;b' AND carteira_ativa = '' AND porte = ''").count() == 1
    assert short.filter("data_base = '2024-02-29' AND uf = ''").count() == 1
    control = {r["member"]: r for r in loading.control_log(spark, f"{root}/_control").state().collect()}
    assert {m: r["status"] for m, r in control.items()} == {
        "good.csv": "complete", "short.csv": "complete", "after.csv": "complete", "long.csv": "in_progress", "damaged.csv": "in_progress"
    }
    assert "7" in control["long.csv"]["reason"] and control["damaged.csv"]["reason"] and control["good.csv"]["reason"] is None

    # mended under the same time: what is missing is loaded, nothing twice
    mended = {"long.csv": csv_bytes(), "damaged.csv": csv_bytes()}
    write_zip(tmp_path / "a.zip", [(n, w, mended.get(n, d)) for n, w, d in members])
    assert load(spark, str(tmp_path), root) == 2
    assert text.read_table(spark, f"{root}/_bronze/rows").count() == 15
    assert load(spark, str(tmp_path), root) == 0
    with pytest.raises(Exception, match="can't be read"):
        write_zip(tmp_path / "a.zip", members)
        archives.member_rows(accepted(spark, str(tmp_path)), REQUIRED).count()


def test_event_log_folds_and_compacts(spark, tmp_path):
    log = EventLog(spark, str(tmp_path / "log"), "k string, v string", ["k"], compact_after=4)
    assert not log.exists() and log.state().count() == 0
    want = {}
    for i in range(1, 11):
        rows = [(f"k{i % 3}", f"v{i}"), (f"only{i}", None)]
        want |= dict(rows)
        assert log.append(spark.createDataFrame(rows, "k string, v string")) == i
        assert {r["k"]: r["v"] for r in log.state().collect()} == want
    names = sorted(p.name for p in (tmp_path / "log").iterdir())
    assert sum(n.startswith("state-") for n in names) == 2 and "batch-000000000001" not in names
    # a number taken by a writer that died is passed over; two writers don't share one
    (tmp_path / "log/batch-000000000011").mkdir()
    other = EventLog(spark, str(tmp_path / "log"), "k string, v string", ["k"])
    assert other.append(spark.createDataFrame([("k0", "last")], "k string, v string")) == 12
    assert {r["k"]: r["v"] for r in log.state().collect()} == want | {"k0": "last"}


def test_interrupted_version_is_completed_exactly(spark, folder, tmp_path):
    root = str(tmp_path / "out")
    load(spark, folder, root)
    full = text.read_table(spark, f"{root}/_bronze/rows")
    half, cut = f"{root}/half", full.filter("uf = 'SP'")
    text.append_by_date(cut, half)
    control = loading.control_log(spark, f"{root}/_control").state()
    loading.log_control(loading.control_log(spark, f"{root}/_control3"), control.filter("status = 'complete'"), ingest.IN_PROGRESS)
    changes = loading.load_archives(spark, folder, half, f"{root}/_control3", REQUIRED, "s", "L", "2026-10-01 00:00:00")
    assert changes.filter("resumes").count() == 3
    columns = ["_source_object", "_record_hash"]
    got = text.read_table(spark, half).select(*columns)
    assert got.count() == 7  # both copies of the repeated row, as in a clean load
    assert got.exceptAll(full.select(*columns)).count() == 0


def test_series_document_loads_once(spark, tmp_path):
    def run():
        loading.load_series(spark, str(tmp_path / "d.json"), str(tmp_path / "_b"), "VALDATA", "url", "s", "L", "2026-10-01 00:00:00")
        return text.read_table(spark, str(tmp_path / "_b"))

    (tmp_path / "d.json").write_text(json.dumps({"value": ITEMS[:2]}))
    assert run().count() == 2 and run().count() == 2
    (tmp_path / "d.json").write_text(json.dumps({"value": ITEMS}))
    modes = {r["_ingestion_mode"]: r["count"] for r in run().groupBy("_ingestion_mode").count().collect()}
    assert modes == {"full": 2, "incremental": 1}


def test_same_time_other_content_gets_its_own_version(spark):
    members = spark.createDataFrame([("a", "m.csv", "t1", "bb")], "archive string, member string, version_ts string, crc32 string")
    for status, crc, want in (("complete", "aa", "a!/m.csv@t1#crcbb"), ("in_progress", "bb", "a!/m.csv@t1"), ("complete", "bb", None), ("rejected", None, None)):
        control = spark.createDataFrame([("a", "m.csv", "t1", crc, "a!/m.csv@t1", status), ("b", "m.csv", "t1", "bb", "b!/m.csv@t1", "complete")], CONTROL)
        got = ingest.changed_members(members, control).collect()
        assert (got[0]["source_object"] if got else None) == want


def test_archive_actions(spark):
    listing = spark.createDataFrame(
        [("a", "t1", True), ("b", None, True), ("c", "t2", True), ("d", "t1", False)],
        "archive string, published_tag string, has_local boolean",
    )
    control = spark.createDataFrame([("a", "t1"), ("b", "t1"), ("c", "t1"), ("d", "t1")], "archive string, tag string")
    got = {r["archive"]: r["action"] for r in ingest.archive_actions(listing, control).collect()}
    assert got == {"a": "reuse", "b": "unverified", "c": "fetch", "d": "fetch"}


def test_hash_is_stable_and_null_is_not_empty(spark):
    df = spark.createDataFrame([("x", None, "o"), ("x", "", "o"), ("x", None, "p")], "b string, a string, _source_object string")
    hashes = [r[0] for r in df.select(ingest.record_hash(["b", "a"])).collect()]
    assert len(set(hashes)) == 3 and all(len(h) == 64 for h in hashes)
    assert hashes == [r[0] for r in df.select(ingest.record_hash(["a", "b"])).collect()]


def test_delimited_text_contract(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("a;b;c\nNA;;\"\"\n1;\"x;y\";007\n".encode("utf-8-sig"))
    rows = sorted(tuple(r) for r in text.read_delimited(spark, str(tmp_path / "a.csv")).collect())
    assert rows == [("1", "x;y", "007"), ("NA", "", "")]


def test_files_with_other_columns_are_united(spark):
    a = spark.createDataFrame([("1", "2")], "x string, y string")
    b = spark.createDataFrame([("3", "4")], "z string, x string")
    assert text.union_files([a, b]).columns == ["x", "y", "z"]


ITEMS = [
    {"SERCODIGO": "S", "VALDATA": "2026-03-30T00:00:00-03:00", "VALVALOR": 14.25},
    {"SERCODIGO": "S", "VALDATA": "2026-03-31T00:00:00-03:00", "VALVALOR": None},
    {"SERCODIGO": "S", "VALDATA": "2026-04-01T00:00:00-03:00", "VALVALOR": 15},
]


def test_document_source(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({"value": ITEMS}))
    rows = {r["VALDATA"][:10]: r["VALVALOR"] for r in documents.read_documents(spark, str(tmp_path / "d.json")).collect()}
    assert rows == {"2026-03-30": "14.25", "2026-03-31": None, "2026-04-01": "15"}
    (tmp_path / "e.json").write_text(json.dumps({"error": "x"}))
    with pytest.raises(documents.DocumentRefused):
        documents.read_documents(spark, str(tmp_path / "e.json"))


def test_documents_are_read_in_chunks_of_any_size():
    draw = random.Random(3)

    def value(depth=0):
        kind = draw.randrange(7 if depth < 2 else 5)
        if kind >= 5:
            return [value(depth + 1) for _ in range(draw.randint(0, 3))] if kind == 5 else {f"k{i}": value(depth + 1) for i in range(draw.randint(0, 3))}
        return [None, True, draw.randint(-99, 99), draw.random() * 1e6, "".join(draw.choice('ab"\\,]}é😀 {[:') for _ in range(draw.randint(0, 9)))][kind]

    def shown(x):
        return json.loads(json.dumps(x), parse_int=str, parse_float=str)

    for _ in range(150):
        items = [value() for _ in range(draw.randint(0, 5))]
        whole = {"before": value(), "value": items, "after": value()} if draw.random() < 0.7 else {"value": items}
        raw = json.dumps(whole, ensure_ascii=draw.random() < 0.5, indent=draw.choice([None, 1])).encode("utf-8-sig")
        for chunk in (1, 7, 1000):
            assert list(documents.document_items(io.BytesIO(raw), chunk)) == [shown(i) for i in items]
    for bad in (b"", b"{}", b"[1]", b'{"a": 1}', b'{"value": 3}', b'{"value": [1, 2', b'{"value": [1 2]}', b'{"value": [{"a": }]}', b'{"value": [tru]}'):
        with pytest.raises(documents.DocumentRefused):
            list(documents.document_items(io.BytesIO(bad), 3))


def test_a_document_is_never_held_whole():
    class Endless(io.RawIOBase):
        """A document of a few hundred MB that is made as it is read."""

        def __init__(self, items):
            self.left, self.head = items, b'{"value": ['

        def read(self, n):
            out, self.head = self.head, b""
            while len(out) < n and self.left:
                self.left -= 1
                out += b'{"a": "' + b"x" * 1000 + b'", "n": 1.50}' + (b"," if self.left else b"]}")
            return out

    tracemalloc.start()
    try:
        assert sum(item["n"] == "1.50" for item in documents.document_items(Endless(60_000), 1 << 16)) == 60_000
        assert tracemalloc.get_traced_memory()[1] < 4 << 20
    finally:
        tracemalloc.stop()


def test_watermark_load(spark):
    schema = "d string, v string, _source_object string"
    doc = spark.createDataFrame([("2026-01-01", "1", "u"), ("2026-01-02", "2", "u"), ("2026-01-02", "2", "u"), (None, "9", "u")], schema)
    empty = spark.createDataFrame([], schema)
    full = ingest.incremental_rows(doc, empty, ["d", "v", "_source_object"], "d")
    assert full.count() == 4 and {r["_ingestion_mode"] for r in full.collect()} == {"full"}
    stored = spark.createDataFrame([("2026-01-01", "1", "u"), ("2026-01-02", "2", "u")], schema)
    later = doc.unionByName(spark.createDataFrame([("2026-01-03", "3", "u"), ("2025-12-31", "0", "u")], schema))
    got = ingest.incremental_rows(later, stored, ["d", "v", "_source_object"], "d").collect()
    assert sorted((r["d"], r["v"]) for r in got) == [("2026-01-02", "2"), ("2026-01-03", "3")]
    assert {r["_ingestion_mode"] for r in got} == {"incremental"}
    assert ingest.watermark(stored, "d").first()["watermark"] == "2026-01-02"


def test_hash_of_a_row_follows_its_own_header(spark):
    row = spark.createDataFrame([("1", "", None, "f@v")], "x string, y string, z string, _source_object string")
    hashes = row.select(
        ingest.record_hash(["x", "y"], own_fields=True).alias("own"), ingest.record_hash(["x", "y", "z"], own_fields=True).alias("union")
    ).first()
    assert hashes.own == hashes.union


def test_members_are_dealt_out_over_tasks(spark, tmp_path):
    for i in range(6):
        write_zip(tmp_path / f"{i}.zip", [(f"{i}{j}.csv", OLD, csv_bytes()) for j in range(4)])
    members = archives.archive_members(archives.list_archives(spark, str(tmp_path))).cache()
    rows = archives.member_rows(members, REQUIRED).withColumn("task", F.spark_partition_id())
    assert members.count() == 24 and rows.select("task").distinct().count() > 3
