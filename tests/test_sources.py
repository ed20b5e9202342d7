import json
import random
import zipfile

import pytest

from tablelens import load_data_file
from tablelens.sources import readers
from tablelens.sources.excel import parsed_pieces, read_excel
from tablelens.sources.readers import read_csv
from tablelens.sources.writers import write_cleaned, write_report

SALES = """order_id,product,price,quantity,order_date,paid
1,"Mouse, wireless",19.99,2,2024-01-05,True
2,Lamp,N/A,1,2024-01-06,False
3,Desk,120,,,True
"""


def save(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_csv_types_and_null_tokens(spark, tmp_path):
    df = load_data_file(spark, save(tmp_path / "s.csv", SALES))
    assert dict(df.dtypes) == {"order_id": "bigint", "product": "string", "price": "double", "quantity": "bigint",
                               "order_date": "string", "paid": "boolean"}
    r = df.orderBy("order_id").collect()
    assert r[0]["product"] == "Mouse, wireless" and r[1]["price"] is None and r[2]["quantity"] is None and r[2]["order_date"] is None


def test_one_bad_token_makes_text(spark, tmp_path):
    df = load_data_file(spark, save(tmp_path / "m.csv", "q,p\n1,2.5\ntwenty-five,N/A\n"))
    assert dict(df.dtypes) == {"q": "string", "p": "double"}


def test_first_row_is_the_header_even_without_one(spark, tmp_path):
    df = load_data_file(spark, save(tmp_path / "n.csv", "1,Mouse,19.99\n2,Lamp,5\n3,Desk,7.5\n"))
    assert df.columns == ["1", "Mouse", "19.99"] and df.count() == 2
    from tablelens.operators.quality import assess_data_quality
    assert assess_data_quality(df).flags.id_like == ["1", "Mouse", "19.99"]


def test_latin1(spark, tmp_path):
    df = load_data_file(spark, save(tmp_path / "l.csv", "name,n\nCafé,1\nplain,2\n", "latin-1"))
    assert {r["name"] for r in df.collect()} == {"Café", "plain"}


def test_line_breaks_inside_quotes(spark, tmp_path):
    df = load_data_file(spark, save(tmp_path / "q.csv", 'a,b\n1,"two\nlines"\n2,"say ""hi"""\n'))
    assert {r["b"] for r in df.collect()} == {"two\nlines", 'say "hi"'}


def test_folder_of_csv_files(spark, tmp_path):
    folder = tmp_path / "many.csv"
    folder.mkdir()
    for i in range(3):
        save(folder / f"p{i}.csv", f"a,b\n{i},x\n")
    assert {r["a"] for r in load_data_file(spark, str(folder)).collect()} == {0, 1, 2}


@pytest.mark.parametrize("text, message", [("", "empty"), ("a,b\n", "no rows")])
def test_empty_csv(spark, tmp_path, text, message):
    with pytest.raises(ValueError, match=message):
        read_csv(spark, save(tmp_path / "e.csv", text))


def test_missing_and_unsupported(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        load_data_file(spark, str(tmp_path / "none.csv"))
    with pytest.raises(ValueError, match="Unsupported file type"):
        load_data_file(spark, save(tmp_path / "notes.txt", "hello"))


RECORDS = [{"a": 1, "b": "x"}, {"a": 2, "b": None}]


@pytest.mark.parametrize("text", [
    json.dumps(RECORDS), json.dumps(RECORDS, indent=2), "\n".join(map(json.dumps, RECORDS)),
    json.dumps({"a": {"0": 1, "1": 2}, "b": {"0": "x", "1": None}}), json.dumps({"a": [1, 2], "b": ["x", None]}, indent=1)])
def test_json_shapes(spark, tmp_path, text):
    df = load_data_file(spark, save(tmp_path / "t.json", text))
    assert df.columns == ["a", "b"] and {(r["a"], r["b"]) for r in df.collect()} == {(1, "x"), (2, None)}


def test_corrupt_files(spark, tmp_path):
    for name in ("c.json", "c.parquet", "c.xlsx"):
        with pytest.raises(ValueError, match="Could not read"):
            load_data_file(spark, save(tmp_path / name, "{not valid")).count()
    with pytest.raises(ValueError, match="empty|no rows"):
        load_data_file(spark, save(tmp_path / "z.json", "[]"))


def test_parquet(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.createDataFrame([(1, "x")], "a int, b string").write.parquet(path)
    assert load_data_file(spark, path).collect() == [(1, "x")]
    empty = str(tmp_path / "e.parquet")
    spark.createDataFrame([], "a int").write.parquet(empty)
    with pytest.raises(ValueError, match="no rows"):
        load_data_file(spark, empty)


def workbook(path, rows, styles=None):
    def cell(i, j, v):
        ref = f'{chr(65 + j)}{i + 1}'
        if v is None:
            return ""
        if isinstance(v, bool):
            return f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
        if isinstance(v, tuple):
            return f'<c r="{ref}" s="1"><v>{v[0]}</v></c>'
        if isinstance(v, (int, float)):
            return f'<c r="{ref}"><v>{v}</v></c>'
        strings.append(v)
        return f'<c r="{ref}" t="s"><v>{len(strings) - 1}</v></c>'

    strings: list[str] = []
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    body = "".join(f'<row r="{i + 1}">{"".join(cell(i, j, v) for j, v in enumerate(r))}</row>' for i, r in enumerate(rows))
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} {rel}><sheets><sheet name="One" sheetId="1" r:id="rId7"/>'
                                      f'<sheet name="Two" sheetId="2" r:id="rId8"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId8" Target="worksheets/other.xml"/>'
                                                 '<Relationship Id="rId7" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")
        z.writestr("xl/sharedStrings.xml", f'<sst {ns}>{"".join(f"<si><t>{s}</t></si>" for s in strings)}</sst>')
        z.writestr("xl/styles.xml", f'<styleSheet {ns}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
    return str(path)


def test_excel(spark, tmp_path):
    rows = [["id", "name", "price", "day", "ok"], [1, "Mouse", 19.99, (45296,), True], [2, "Lamp", None, (45297.5,), False]]
    df = load_data_file(spark, workbook(tmp_path / "t.xlsx", rows))
    assert dict(df.dtypes) == {"id": "bigint", "name": "string", "price": "double", "day": "string", "ok": "boolean"}
    assert [tuple(r) for r in df.orderBy("id").collect()] == [
        (1, "Mouse", 19.99, "2024-01-05 00:00:00", True), (2, "Lamp", None, "2024-01-06 12:00:00", False)]


def test_many_workbooks(spark, tmp_path):
    for i in range(3):
        workbook(tmp_path / f"w{i}.xlsx", [["k", "v"], [i, f"x{i}"], [i + 10, None]])
    assert load_data_file(spark, f"{tmp_path}/*.xlsx").count() == 6
    workbook(tmp_path / "w9.xlsx", [["other"], [1]])
    with pytest.raises(ValueError, match="different headers"):
        load_data_file(spark, f"{tmp_path}/*.xlsx")


def test_workbooks_are_cut_into_pieces_and_parsed_once(spark, tmp_path):
    draw = random.Random(5)
    rows = [["k", "kind", "text", "share"]] + [
        [i, draw.choice(["hot", f"k{i}"]), draw.choice([None, "a &lt;b&gt;", "é" * draw.randint(1, 40), f"t{i % 7}"]), draw.choice([None, i / 8 + 0.0625])]
        for i in range(400)]
    path = workbook(tmp_path / "p.xlsx", rows)
    parsed = parsed_pieces(spark, path, 300)
    assert parsed.where("kind = 'rows'").count() > 50 and parsed.where("kind = 'strings'").count() > 20
    df = read_excel(spark, path, 300)
    assert "MapInPandas" not in df._jdf.queryExecution().toString()
    want = [(r[0], r[1], "a <b>" if r[2] and "&" in r[2] else r[2], r[3]) for r in rows[1:]]
    assert [tuple(r) for r in df.orderBy("k").collect()] == want
    assert set(read_excel(spark, path).collect()) == set(df.collect())


def test_spellings_of_workbook_xml(spark, tmp_path):
    def save_book(name, sheet, strings, encoding="utf-8"):
        path = workbook(tmp_path / f"{name}0.xlsx", [])
        with zipfile.ZipFile(path) as old, zipfile.ZipFile(tmp_path / f"{name}.xlsx", "w") as new:
            for part in old.namelist():
                text = {"xl/worksheets/sheet1.xml": sheet, "xl/sharedStrings.xml": strings}.get(part)
                new.writestr(part, old.read(part) if text is None else text.encode(encoding))
        return str(tmp_path / f"{name}.xlsx")

    sheet = ('<?xml version="1.0"?><x:worksheet xmlns:x="urn:m"><x:cols/><x:sheetData><x:row/><x:row r="2"><x:c r="B2" t="s"><x:v>1</x:v></x:c>'
             '<x:c r="A2" t="inlineStr"><x:is><x:t>k</x:t></x:is></x:c></x:row ><x:row r="3"/><x:row r="4"><x:c t="n"><x:v>7.0</x:v></x:c>'
             '<x:c t="s"><x:v>2</x:v></x:c><x:c t="e"><x:v>#N/A</x:v></x:c></x:row></x:sheetData></x:worksheet>')
    strings = '<x:sst xmlns:x="urn:m"><x:si/><x:si><x:t>v</x:t></x:si><x:si><x:r><x:t>ä</x:t></x:r><x:rPh><x:t>no</x:t></x:rPh><x:r><x:t>b</x:t></x:r></x:si></x:sst>'
    for name, encoding in (("plain", "utf-8"), ("marked", "utf-8-sig"), ("wide", "utf-16")):
        for size in (64, 1 << 20):
            df = read_excel(spark, save_book(f"{name}{size}", sheet, strings, encoding), size)
            assert df.columns == ["k", "v"] and df.collect() == [(7, "äb")]
    with pytest.raises(ValueError, match="Could not read"):
        read_excel(spark, save_book("cut", sheet[:-60], strings))


def test_empty_workbook(spark, tmp_path):
    with pytest.raises(ValueError, match="no rows"):
        load_data_file(spark, workbook(tmp_path / "e.xlsx", [["a", "b"]]))


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "x"'), (2, None)], "a bigint, b string")
    assert write_cleaned(df, str(tmp_path / "none"), log=[]) is None
    path = write_cleaned(df, str(tmp_path / "out.csv"), log=["something"])
    assert sorted(map(tuple, load_data_file(spark, path).collect())) == [(1, 'say "x"'), (2, None)]
    report = df.selectExpr("'quality' AS report", "a", "b")
    write_report(report, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r" / "report=quality")).count() == 2


def test_encodings_and_open_quotes_per_file(spark, tmp_path):
    folder = tmp_path / "mixed.csv"
    folder.mkdir()
    (folder / "a one.csv").write_bytes("name,n\nZoë,1\n日本,2\n".encode())
    (folder / "b.csv").write_bytes("name,n\nRené,3\n".encode("latin-1"))
    (folder / "c.csv").write_bytes('name,n\n"two\nlines",4\n'.encode())
    df = readers.read_csv(spark, str(folder))
    assert {(r["name"], r["n"]) for r in df.collect()} == {("Zoë", 1), ("日本", 2), ("René", 3), ("two\nlines", 4)}


def test_json_shapes_per_file(spark, tmp_path):
    folder = tmp_path / "mixed.json"
    folder.mkdir()
    (folder / "a.json").write_text('{"k": 1, "v": "a"}\n{"k": 2, "v": "b"}\n')
    (folder / "b.json").write_text('[{"k": 3, "v": "c"}, {"k": 4, "v": "d"}]')
    (folder / "c.json").write_text('{"k": {"0": 5}, "v": {"0": "e"}}')
    df = readers.read_json(spark, str(folder))
    assert {(r["k"], r["v"]) for r in df.collect()} == {(1, "a"), (2, "b"), (3, "c"), (4, "d"), (5, "e")}
