"""Workbooks written by tasks and read back: cells, formulas, odd texts, long sheets, and writes that break off."""

import pytest
from pyspark.sql import functions as F

from bazaarium.sources import workbooks

ROWS = "query_id string, number long, source_label string, seller string, name string, price double, url string"


def tables(spark):
    chosen = [("a & b", n, "WB", f"s{n}", "=1+1" if n == 1 else "<pot>\x01", 10.5 * n, "http://u") for n in (1, 2, 3)]
    every = [("a & b", n, "Ozon", None, "x", 1.0, None) for n in range(1, 8)] + [("other", 1, "WB", "s", "y", 2.0, "u"), (None, 1, "WB", "s", "z", 3.0, "u")]
    return spark.createDataFrame(chosen, ROWS), spark.createDataFrame(every, ROWS)


def held(spark, path):
    return {(r.file, r.sheet, r.row, r.place): r.formula and "=" + r.formula or r.value for r in workbooks.read_workbooks(spark, path).collect()}


def test_cells_and_formulas_come_back(spark, tmp_path):
    workbooks.write_workbooks(*tables(spark), str(tmp_path), quantity=4)
    got = held(spark, str(tmp_path))
    assert len({k[0] for k in got}) == 3
    book = next(k[0] for k, v in got.items() if v == "a & b")
    cell = lambda row, place, sheet=workbooks.SUMMARY: got.get((book, sheet, row, place))
    assert [cell(3, p) for p in range(1, 7)] == ["1", "s1", "10.5", "4", "=C3*D3", "​=1+1"]
    assert cell(4, 6) == "<pot>" and cell(5, 5) == "=C5*D5"
    assert [cell(r, 5) for r in (6, 7, 8, 9)] == ["=AVERAGE(C3:C5)", "=STDEV(C3:C5)", "=E7/E6*100", "=E6*D3"]
    assert cell(8, 1, workbooks.EVERY) == "7" and cell(9, 1, workbooks.EVERY) is None
    assert not any(k[1] == workbooks.SUMMARY for k in got if k[0] != book)
    assert not (tmp_path / "_temporary").exists()


def test_rows_beyond_a_sheet_go_on_in_the_next(spark, tmp_path):
    from types import SimpleNamespace

    writer, before = workbooks.WorkbookWriter(str(tmp_path)), workbooks.SHEET_ROWS
    workbooks.SHEET_ROWS = 4
    try:
        moves = writer.write(iter(SimpleNamespace(query_id="q", sheet=1, number=n, source_label="WB", seller="s", name="n", price=1.0, url="u", quantity=1) for n in range(8)))
    finally:
        workbooks.SHEET_ROWS = before
    writer.commit([moves])
    got = held(spark, str(tmp_path))
    assert sorted({k[1] for k in got}) == [workbooks.EVERY, f"{workbooks.EVERY} 1", f"{workbooks.EVERY} 2"]
    assert sum(k[3] == 1 and v != "№" for k, v in got.items()) == 8


def test_write_that_breaks_off_leaves_nothing(spark, tmp_path):
    chosen, every = tables(spark)
    broken = every.withColumn("name", F.when(F.col("query_id") == "other", F.raise_error(F.lit("no"))).otherwise(F.col("name")))
    with pytest.raises(Exception, match="no"):
        workbooks.write_workbooks(chosen, broken, str(tmp_path))
    assert list(tmp_path.glob("*.xlsx")) == []


def test_empty_tables_write_no_workbook(spark, tmp_path):
    chosen, every = tables(spark)
    workbooks.write_workbooks(chosen.limit(0), every.limit(0), str(tmp_path))
    assert list(tmp_path.glob("*.xlsx")) == []


def test_batches_are_written_and_read_without_a_step_for_each_cell(tmp_path, monkeypatch):
    import xml.etree.ElementTree as ET
    import zipfile

    import pyarrow as pa

    odd = ["a & <b> &amp; ]]>", "=1+1", "\x01=2\x0b", "", None, " </row><c> ", "два\nryad\r\n\U0001f600￾", "x=1"]
    rows = [{"query_id": q, "sheet": 1, "number": n, "source_label": "WB", "seller": t, "name": t, "price": p, "url": None, "quantity": 1} for q in ("a", None) for n, (t, p) in enumerate(zip(odd, [1e16, 0.1, None, 5.0, -2.5, 1e-7, 123456789.12, 0.0]), 1)]
    schema = pa.schema([("query_id", pa.string()), ("sheet", pa.int32()), ("number", pa.int64()), ("source_label", pa.string()), ("seller", pa.string()), ("name", pa.string()), ("price", pa.float64()), ("url", pa.string()), ("quantity", pa.int32())])
    batch = pa.RecordBatch.from_pylist(rows, schema)
    writer = workbooks.WorkbookWriter(str(tmp_path))
    writer.commit([writer.write(iter([batch.slice(0, 5), batch.slice(5)]))])
    books = sorted(tmp_path.glob("*.xlsx"))
    assert len(books) == 2
    monkeypatch.setattr(workbooks, "BLOCK", 7)
    for book in books:
        sheet = zipfile.ZipFile(book).read("xl/worksheets/sheet1.xml")
        tree = ET.fromstring(sheet)
        wanted = [(r, p, "".join(c.itertext())) for r, row in enumerate(tree.iter(f"{{{workbooks._MAIN}}}row"), 1) for p, c in enumerate(row, 1) if len(c)]
        found, before = [], 0
        with zipfile.ZipFile(book).open("xl/worksheets/sheet1.xml") as f:
            for block in workbooks._blocks(f):
                found += [(c["row"], c["place"], c["value"]) for c in workbooks._read(block, before).to_pylist()]
                before += block.count(b"</row>")
        assert found == wanted and before == 9
        prices = [float(v) for r, p, v in found if p == 5 and r > 1]
        assert prices == [1e16, 0.1, 5.0, -2.5, 1e-7, 123456789.12, 0.0]
        assert [v for r, p, v in found if p == 3 and r > 1] == ["a & <b> &amp; ]]>", "​=1+1", "=2", "", " </row><c> ", "два\nryad\n\U0001f600", "x=1"]


def test_offers_without_numbers_are_numbered_in_their_order(spark, tmp_path):
    chosen, every = tables(spark)
    back = every.where("query_id = 'a & b'").withColumn("name", F.concat(F.lit("n"), F.col("number").cast("string"))).withColumn("pos", -F.col("number"))
    workbooks.write_workbooks(chosen, back.drop("number"), str(tmp_path), order=("price", "pos"))
    got = held(spark, str(tmp_path))
    assert [(got[k], got[k[0], k[1], k[2], 4]) for k in sorted(got) if k[1] == workbooks.EVERY and k[3] == 1 and k[2] > 1] == [(str(n), f"n{8 - n}") for n in range(1, 8)]
    assert [got[k] for k in sorted(got) if k[1] == workbooks.SUMMARY and k[3] == 2 and 2 < k[2] < 6] == ["s1", "s2", "s3"]
