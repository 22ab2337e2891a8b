import zipfile

import pytest

from pivolith.sources.ingest import IngestError, load_file, sniff_encoding, sniff_separator


def put(tmp_path, raw, name="t.csv"):
    path = tmp_path / name
    path.write_bytes(raw if isinstance(raw, bytes) else raw.encode())
    return f"file://{path}"


CASES = [
    ("t.csv", "name,age,city\nAnn,25,Rome\n", [("Ann", 25, "Rome")]),
    ("t.csv", '"name","age"\n"Smith, John","25"\n"Say ""Hi""",3\n', [("Smith, John", 25), ('Say "Hi"', 3)]),
    ("t.tsv", "a\tb\n1\tx\n", [(1, "x")]),
    ("t.txt", "a;b\n1;x\n2;y\n", [(1, "x"), (2, "y")]),
    ("t.txt", "a|b\n1|x\n", [(1, "x")]),
    ("t.csv", 'a,b\n"two\nlines",2\n', [("two\nlines", 2)]),
    ("t.csv", "a,b\n4\n1,2,3\n", [(4, None), (1, 2)]),
    ("t.csv", "a,b\n\nx,NULL\n,\nN/A,2\n", [("x", None), (None, 2)]),
    ("t.csv", 'm,n\nabc,1\n5,x\n1e3,3\n"1,000",4\n', [(None, 1), (5.0, None), (1000.0, 3), (None, 4)]),
]


@pytest.mark.parametrize(("name", "raw", "rows"), CASES)
def test_separated(spark, tmp_path, name, raw, rows):
    df, kinds = load_file(spark, put(tmp_path, raw, name))
    assert [tuple(r) for r in df.collect()] == rows
    assert set(kinds.values()) <= {"number", "string"}


def test_charset_start_row_strict(spark, tmp_path):
    assert load_file(spark, put(tmp_path, "名称,额\n产品,3\n".encode("gbk")))[0].collect() == [("产品", 3)]
    assert load_file(spark, put(tmp_path, "junk\na,b\n1,2\n3,4\n"), start_row=2)[0].collect() == [(1, 2), (3, 4)]
    assert load_file(spark, put(tmp_path, "a\nx\n5\n"), strict=True)[0].collect() == [("x",), ("5",)]
    for raw in ("", "a,b\n", "a,b\n,\n"):
        with pytest.raises(IngestError):
            load_file(spark, put(tmp_path, raw))


def test_sniffing():
    assert sniff_separator("a;b\n1;2") == ";" and sniff_separator("plain") == ","
    assert [sniff_encoding(x) for x in ("é".encode(), "名称".encode("gbk"), b"\xff\x80\x30", b"\xef\xbb\xbfa")] == ["UTF-8", "GBK", "ISO-8859-1", "UTF-8"]


def test_excel(spark, tmp_path):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    path = tmp_path / "t.xlsx"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>name</t></si><si><t>n</t></si><si><t>Ann</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {main}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row><c r="A2" t="s"><v>2</v></c><c r="C2"><v>7</v></c></row></sheetData></worksheet>')
    for sheet in (None, "S", "0"):
        df, kinds = load_file(spark, f"file://{path}", sheet)
        assert df.collect() == [("Ann", None, 7)] and kinds == {"name": "string", "Column_2": "string", "n": "number"}
    with pytest.raises(IngestError):
        load_file(spark, f"file://{path}", "none")


def test_behind_the_head(spark, tmp_path):
    from pivolith.sources import ingest

    for k, (encoding, word) in enumerate((("gbk", "北京"), ("latin-1", "Zoë"), ("utf-8", "北京"))):
        (tmp_path / f"{k}.csv").write_bytes(("name,n\n" + "abcdefgh,1\n" * 8000 + f"{word},2\n").encode(encoding))
        assert ingest.read_text(spark, str(tmp_path / f"{k}.csv")).where("n = 2").first()["name"] == word
    names = [f"c{i}" + "x" * 3000 for i in range(40)]
    (tmp_path / "wide.csv").write_text(",".join(names) + "\n" + ",".join(map(str, range(40))) + "\n")
    wide = ingest.read_text(spark, str(tmp_path / "wide.csv"))
    assert wide.columns == names and list(wide.first()) == list(range(40))
