import os
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from ledgerline.errors import IngestError
from ledgerline.operators import quality as Q, roles as R
from ledgerline.sources import files as S
from ledgerline.sources.workbook import read_workbooks
from ledgerline.streaming import usage as U


def test_read_preview_profile(spark, tmp_path):
    path = tmp_path / "people.csv"
    path.write_text("name,age,signup_date,revenue\nAnn,31,2024-01-05,10.5\nBo,,2024-02-01,N/A\nAnn,31,2024-01-05,10.5\n")
    df = S.read_csv(spark, str(path))
    assert dict(df.dtypes) == {"name": "string", "age": "bigint", "signup_date": "string", "revenue": "double"}
    profile = S.profile_file(spark, str(path)).first()
    assert (profile["row_count"], profile["column_count"], profile["duplicate_rows_count"], profile["missing_values_count"]) == (3, 4, 1, 2)
    assert not profile["duplicate_detection_skipped"]
    records = [r["record"] for r in S.preview(df, 2).collect()]
    assert records[1] == '{"name":"Bo","age":null,"signup_date":"2024-02-01","revenue":null}'
    quick = S.profile_file(spark, str(path), exact_duplicates=False).first()
    assert quick["duplicate_rows_count"] is None and quick["duplicate_detection_skipped"]
    assert list(quick.asDict()) == list(profile.asDict())


def test_types(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('a,b,c,d,e\n1,1.5,True,x,\n2,1e3,false,1d,\n007,.5,TRUE,"say ""hi"", you",\n')
    df = S.read_csv(spark, str(path))
    assert [t for _, t in df.dtypes] == ["bigint", "double", "boolean", "string", "double"]
    assert df.where("a = 7").first()["d"] == 'say "hi", you'


@pytest.mark.parametrize("quoted", [True, False])
def test_line_breaks_are_found(spark, tmp_path, quoted):
    path = tmp_path / "t.csv"
    path.write_text('a,b\n1,"two\nlines"\n2,"x ""y"" z"\n' if quoted else 'a,b\n1,two\n2,"x ""y"" z"\n')
    assert S.spans_lines(spark, str(path)) is quoted
    df = S.read_csv(spark, str(path))
    assert df.count() == 2 and df.where("a = 1").first()["b"] == ("two\nlines" if quoted else "two")


def test_one_broken_file_leaves_the_others_split(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.csv").write_text('a,b\n1,"two\nlines"\n')
    (tmp_path / "t" / "b.csv").write_text('a,b\n2,plain\n3,NA\n')
    assert [os.path.basename(r["file"]) for r in S.files_with_breaks(spark, str(tmp_path / "t")).collect()] == ["a.csv"]
    rows = {r["a"]: r["b"] for r in S.read_csv(spark, str(tmp_path / "t")).collect()}
    assert rows == {1: "two\nlines", 2: "plain", 3: None}


def test_admission(spark, tmp_path):
    good = {"a.csv": b"x,y\n1,2\n", "b.XLSX": b"PK\x03\x04rest", "c.xls": bytes.fromhex("D0CF11E0A1B11AE1") + b"rest"}
    bad = {"d.csv": b"\x00\x01binary", "e.xlsx": b"not a zip", "f.xls": b"PK\x03\x04", "g.exe": b"MZ", "h.csv": b"  \n ", "noext": b"x"}
    for name, content in {**good, **bad}.items():
        (tmp_path / name).write_bytes(content)
    (tmp_path / "empty.csv").write_bytes(b"")
    got = {os.path.basename(r["path"]): r for r in S.admit(spark, str(tmp_path)).collect()}
    assert not got["empty.csv"]["accepted"] and got["empty.csv"]["reason"] == "nothing in it"
    assert all(got[n]["accepted"] for n in good), got
    assert not any(got[n]["accepted"] for n in bad), got
    assert "zero bytes" in got["d.csv"]["reason"] and ".exe" in got["g.exe"]["reason"] and "nothing" in got["h.csv"]["reason"]
    # Three gigabytes without a block on the disk: a verdict without reading them.
    with open(tmp_path / "huge.csv", "wb") as huge:
        huge.write(b"name,number\n")
        huge.truncate(3 << 30)
    start = time.time()
    big = {os.path.basename(r["path"]): r for r in S.admit(spark, str(tmp_path)).collect()}["huge.csv"]
    assert big["accepted"] and time.time() - start < 20
    assert {os.path.basename(r["path"]): r["length"] for r in S.list_files(spark, str(tmp_path)).collect()}["huge.csv"] == 3 << 30
    os.remove(tmp_path / "huge.csv")
    capped = {os.path.basename(r["path"]): r for r in S.admit(spark, str(tmp_path), max_bytes=7).collect()}
    assert len(capped) == len(got) and "larger" in capped["a.csv"]["reason"] and ".exe" in capped["g.exe"]["reason"]


def test_stale_files(spark, tmp_path):
    for owner, name, hours in (("u1", "old.csv", 48), ("u1", "new.csv", 0), ("u2", "old.csv", 30)):
        (tmp_path / owner).mkdir(exist_ok=True)
        (tmp_path / owner / name).write_text("x")
        then = time.time() - hours * 3600
        os.utime(tmp_path / owner / name, (then, then))
    got = {(r["owner"], os.path.basename(r["path"])) for r in S.stale_files(spark, str(tmp_path)).collect()}
    assert got == {("u1", "old.csv"), ("u2", "old.csv")}
    assert (tmp_path / "u1" / "old.csv").exists()
    assert S.stored_bytes(spark, str(tmp_path)).first()["bytes"] == 3


def _workbook(path, rows):
    texts = [v for row in rows for v in row if isinstance(v, str)]
    shared = "".join(f"<si><t>{v}</t></si>" for v in texts)
    place, body = 0, []
    for i, row in enumerate(rows, start=1):
        cells = []
        for j, v in enumerate(row):
            at = f"{chr(65 + j)}{i}"
            if v is None:
                continue
            if isinstance(v, bool):
                cells.append(f'<c r="{at}" t="b"><v>{int(v)}</v></c>')
            elif isinstance(v, str):
                cells.append(f'<c r="{at}" t="s"><v>{place}</v></c>')
                place += 1
            else:
                cells.append(f'<c r="{at}"><v>{v}</v></c>')
        body.append(f'<row r="{i}">{"".join(cells)}</row>')
    space = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as book:
        book.writestr("xl/workbook.xml", f'<workbook {space} xmlns:r="{rel}"><sheets><sheet name="S" sheetId="1" r:id="rId9"/></sheets></workbook>')
        book.writestr(
            "xl/_rels/workbook.xml.rels",
            '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
            '<Relationship Id="rId9" Type="t" Target="worksheets/sheet1.xml"/></Relationships>',
        )
        book.writestr("xl/sharedStrings.xml", f"<sst {space}>{shared}</sst>")
        book.writestr("xl/worksheets/sheet1.xml", f'<worksheet {space}><sheetData>{"".join(body)}</sheetData></worksheet>')


def test_workbooks(spark, tmp_path):
    _workbook(tmp_path / "a.xlsx", [["name", "age", "paid"], ["Ann", 31, True], ["Bo", None, False]])
    _workbook(tmp_path / "b.xlsx", [["name", "age", "paid"], ["Cy", 40, True], ["N/A", 22, True]])
    df = read_workbooks(spark, str(tmp_path))
    assert dict(df.dtypes) == {"name": "string", "age": "bigint", "paid": "boolean"}
    assert df.agg(F.sum("age")).first()[0] == 93 and df.where("name is null").count() == 1
    assert Q.missing(df).count() == 2 and R.role_lists(df)["numeric"] == ["age"]


def test_no_workbooks(spark, tmp_path):
    (tmp_path / "x.txt").write_text("x")
    with pytest.raises(IngestError):
        read_workbooks(spark, str(tmp_path))


def test_stream_over_several_batches_counts_once(spark, tmp_path):
    log = tmp_path / "log"
    for part in range(3):
        rows = spark.range(part * 100, part * 100 + 100).selectExpr("id % 5 AS user_id", "timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, id div 10) AS ts", "id % 4 = 0 AS cache_hit")
        rows.coalesce(1).write.mode("append").parquet(str(log))
    spark.range(1).selectExpr("id").write.parquet(str(tmp_path / "other"))
    stream = (
        spark.readStream.schema(spark.read.parquet(str(log)).schema).option("maxFilesPerTrigger", 1).parquet(str(log))
    )
    U.meter(stream, str(tmp_path / "out"), str(tmp_path / "check"), "user_id", "ts", counted=~F.col("cache_hit"), delay="3 days")
    got = sorted(tuple(r) for r in U.metered_counts(spark, str(tmp_path / "out"), 20).collect())
    batch = spark.read.parquet(str(log)).where("not cache_hit").groupBy("user_id", F.col("ts").cast("date").alias("d")).count()
    assert got == sorted((r["user_id"], r["d"], r["count"], r["count"] >= 20) for r in batch.collect())
    assert spark.read.parquet(str(tmp_path / "out")).select("batch").distinct().count() == 3
    assert U.fates(spark, str(tmp_path / "out")).first().asDict() == {"rows_read": 225, "counted": 225, "late": 0, "undated": 0}


def test_late_rows_are_counted_apart(spark, tmp_path):
    """A file at a time; the second one brings rows for a day that is closed, one without a time, and some for an open day."""
    log = str(tmp_path / "log")
    for rows in ([(1, "2024-03-10 08:00:00"), (2, "2024-03-01 09:00:00")], [(1, "2024-03-01 23:59:59"), (1, "2024-03-08 10:00:00"), (2, None)], [(1, "2024-03-10 09:00:00")]):
        df = spark.createDataFrame(rows, "user_id int, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
        df.coalesce(1).write.mode("append").parquet(log)
        time.sleep(1.1)

    def stream():
        return spark.readStream.schema("user_id int, ts timestamp").option("maxFilesPerTrigger", 1).parquet(log)

    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "check")
    U.meter(stream(), out, checkpoint, "user_id", "ts", delay="2 days")
    assert U.fates(spark, out).first().asDict() == {"rows_read": 6, "counted": 4, "late": 1, "undated": 1}
    assert [(r["user"], str(r["period"]), r["requests"], r["batch"]) for r in U.late_rows(spark, out).collect()] == [(1, "2024-03-01", 1, 1)]
    # Started again, it goes on where it was.
    spark.createDataFrame([(3, "2024-03-01 00:00:00"), (3, "2024-03-11 00:00:00")], "user_id int, ts string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(log)
    U.meter(stream(), out, checkpoint, "user_id", "ts", delay="2 days")
    assert U.fates(spark, out).first().asDict() == {"rows_read": 8, "counted": 5, "late": 2, "undated": 1}
    assert {(r["user"], str(r["period"])): r["requests"] for r in U.metered_counts(spark, out, 9).collect()} == {
        (1, "2024-03-10"): 2, (2, "2024-03-01"): 1, (1, "2024-03-08"): 1, (3, "2024-03-11"): 1,
    }
