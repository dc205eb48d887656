"""Readers over small files made here."""

import zipfile

from leafmill.sources import readers


def test_readers(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body><w:p><w:r><w:t>one</w:t></w:r></w:p><w:p><w:r><w:t>t</w:t><w:t>wo</w:t></w:r></w:p></w:body></w:document>")
    (tmp_path / "b.docx").write_bytes(b"no zip")
    got = {r["path"][-6:]: (r["content"], r["error"]) for r in readers.docx_segments(spark, f"{tmp_path}/*.docx").collect()}
    assert got == {"a.docx": ("one\ntwo", None), "b.docx": (None, "BadZipFile")}
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {s}><si><t>name</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {s}><sheetData><row><c r="A1" t="s"><v>0</v></c></row><row><c r="A2"><v>7</v></c></row></sheetData></worksheet>')
    (tmp_path / "a.csv").write_text("name\n7\n")
    table = "| name |\n|-----:|\n|    7 |"
    assert readers.xlsx_segments(spark, f"{tmp_path}/*.xlsx").first()["content"] == table
    assert readers.csv_segments(spark, f"{tmp_path}/*.csv").first()["content"] == table
    (tmp_path / "a.txt").write_bytes(b"x\xffy")
    assert readers.text_segments(spark, f"{tmp_path}/*.txt").first()["content"] == "xy"


def test_stage_artifacts(spark, tmp_path):
    df = spark.createDataFrame([("ocr", "k1", 1, "a"), ("ocr", "k2", 1, "b")], "stage string, cache_key string, page int, body string")
    readers.write_stage(df, f"{tmp_path}/c")
    readers.write_stage(df.where("cache_key = 'k1'").selectExpr("stage", "cache_key", "page", "'z' as body"), f"{tmp_path}/c")
    assert {(r["cache_key"], r["body"]) for r in spark.read.parquet(f"{tmp_path}/c").collect()} == {("k1", "z"), ("k2", "b")}
