"""Workbooks of price justifications as a data sink: a file for each query, with formulas, written and committed by tasks.

A task streams its queries one after another into files of its own and the commit moves them to their names, so a job that
breaks off leaves no workbook and a task that runs again no second one.  A workbook's rows pass through one task batch by
batch, and so they do when it is read; beyond ``SHEET_ROWS`` they go on in a further sheet, as the format has no longer ones.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.sax.saxutils import escape, quoteattr

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

SHEET_ROWS = 1_000_000
ROWS = "query_id string, sheet int, number long, source_label string, seller string, name string, price double, url string, quantity int"
# Names of the sheets and their columns.
SUMMARY, EVERY = "НМЦК", "Все источники"
SUMMARY_HEAD = ("№", "Магазин", "Цена за 1 шт.", "Кол-во", "Итого", "Что именно покупаем")
EVERY_HEAD = ("№", "Источник", "Магазин", "Название", "Цена", "Ссылка")
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_RELS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_TEXT = ('<c t="inlineStr"><is><t xml:space="preserve">', "</t></is></c>")
_NUMBER, _FORMULA = ("<c><v>", "</v></c>"), ("<c><f>", "</f></c>")
# In the order in which a text is escaped.
_ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"))
#: Bytes of a sheet that a reader has in hand, more where one row alone has them.
BLOCK = 1 << 22


def _cell(value) -> str:
    """A cell: a formula where the value begins with =, else a number or a text."""
    if value is None:
        return "<c/>"
    if isinstance(value, int | float):
        return f"{_NUMBER[0]}{value!r}{_NUMBER[1]}"
    if value[:1] == "=":
        return f"{_FORMULA[0]}{escape(value[1:])}{_FORMULA[1]}"
    kept = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]", "", value)
    return f"{_TEXT[0]}{escape(kept)}{_TEXT[1]}"


def _cells(values: pa.Array) -> pa.Array:
    """The cells of a column of numbers or texts, as ``Workbook.add`` makes them."""
    wide = pa.large_string()
    around, text = (_TEXT, values.cast(wide)) if pa.types.is_string(values.type) or pa.types.is_large_string(values.type) else (_NUMBER, values.cast(wide))
    if around is _TEXT and pc.any(pc.match_substring_regex(text, r"^=|[&<>\x00-\x08\x0b\x0c\x0e-\x1f\x{fffe}\x{ffff}]")).as_py():
        text = pc.replace_substring_regex(text, r"\A=", f"{chr(8203)}=")
        text = pc.replace_substring_regex(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x{fffe}\x{ffff}]", "")
        for plain, safe in _ESCAPES:
            text = pc.replace_substring(text, plain, safe)
    made = pc.binary_join_element_wise(*[pa.scalar(t, wide) for t in around[:1]], text, *[pa.scalar(t, wide) for t in (around[1], "")])
    return pc.fill_null(made, pa.scalar("<c/>", wide))


class Workbook:
    """One workbook, written from front to back."""

    def __init__(self, sink, query: str):
        self.zip = zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED)
        self.query, self.names, self.out, self.row = query, [], None, 0

    def sheet(self, name: str, *rows: tuple) -> None:
        self._end()
        self.names.append(name)
        self.out, self.row = self.zip.open(f"xl/worksheets/sheet{len(self.names)}.xml", "w"), 0
        self.out.write(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{_MAIN}"><sheetData>'.encode())
        for r in rows:
            self.add(*r)

    def add(self, *cells) -> None:
        # A text from outside is never a formula: only tuples of one name it.
        self.row += 1
        self.out.write(f"<row>{''.join(_cell(c[0] if isinstance(c, tuple) else (f'{chr(8203)}{c}' if isinstance(c, str) and c[:1] == '=' else c)) for c in cells)}</row>".encode())

    def add_all(self, *columns: pa.Array) -> None:
        """Rows of a batch; their texts are never formulas."""
        wide = pa.large_string()
        rows = pc.binary_join_element_wise(pa.scalar("<row>", wide), *map(_cells, columns), pa.scalar("</row>", wide), pa.scalar("", wide))
        self.row += len(rows)
        ends = np.frombuffer(rows.buffers()[1], np.int64)[rows.offset : rows.offset + len(rows) + 1]
        self.out.write(memoryview(rows.buffers()[2])[ends[0] : ends[-1]])

    def _end(self) -> None:
        if self.out:
            self.out.write(b"</sheetData></worksheet>")
            self.out.close()

    def close(self) -> None:
        self._end()
        sheets = "".join(f'<sheet name={quoteattr(name)} sheetId="{n}" r:id="rId{n}"/>' for n, name in enumerate(self.names, 1))
        links = "".join(f'<Relationship Id="rId{n}" Type="{_RELS}/worksheet" Target="worksheets/sheet{n}.xml"/>' for n in range(1, len(self.names) + 1))
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{n}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for n in range(1, len(self.names) + 1))
        parts = {
            "[Content_Types].xml": f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>',
            "_rels/.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_RELS}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
            "xl/workbook.xml": f'<workbook xmlns="{_MAIN}" xmlns:r="{_RELS}"><sheets>{sheets}</sheets></workbook>',
            "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_PACKAGE}/relationships">{links}</Relationships>',
        }
        for name, text in parts.items():
            self.zip.writestr(name, f'<?xml version="1.0" encoding="UTF-8"?>{text}')
        self.zip.close()


@dataclass
class Moves(WriterCommitMessage):
    """Files of one task, and where they go."""

    files: list[tuple[str, str]]


def _runs(batches: Iterator) -> Iterator[pa.RecordBatch]:
    """Stretches of rows of one query and sheet, from batches or, one at a time, from rows."""
    schema = pa.schema([(f.split()[0], {"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}.get(f.split()[1], pa.string())) for f in ROWS.split(", ")])
    for b in batches:
        batch = b if isinstance(b, pa.RecordBatch) else pa.RecordBatch.from_pylist([{n: getattr(b, n) for n in schema.names}], schema)
        query = pc.fill_null(batch.column("query_id").dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
        changes = (np.diff(query) != 0) | (np.diff(batch.column("sheet").to_numpy()) != 0)
        cuts = [0, *(np.flatnonzero(changes) + 1).tolist(), len(batch)]
        for start, end in zip(cuts, cuts[1:]):
            if end > start:
                yield batch.slice(start, end - start)


class WorkbookWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def _fs(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(self.path) if ":" in self.path else (pafs.LocalFileSystem(), self.path)

    def write(self, iterator: Iterator) -> Moves:
        """Rows by query, sheet and number, or as they come where they have none; those of sheet 0 are the chosen offers."""
        (fs, root), files, book, sink, at, listed = self._fs(), [], None, None, None, 0
        folder = f"{root}/_temporary/{uuid.uuid4().hex}"

        def formulas() -> None:
            last = book.row
            book.add(None, "Средняя цена", None, None, (f"=AVERAGE(C3:C{last})",))
            book.add(None, "Отклонение", None, None, (f"=STDEV(C3:C{last})",))
            book.add(None, "Вариация, %", None, None, (f"=E{last + 2}/E{last + 1}*100",))
            book.add(None, "Итого", None, None, (f"=E{last + 1}*D3",))

        def finish() -> None:
            if book is not None:
                if at[1] == 0:
                    formulas()
                book.close()
                sink.close()

        for run in _runs(iterator):
            query, sheet = run.column("query_id")[0].as_py(), run.column("sheet")[0].as_py()
            if at is None or query != at[0]:
                finish()
                name = f"{hashlib.sha1((query or '').encode()).hexdigest()}.xlsx"
                fs.create_dir(folder, recursive=True)
                files.append((f"{folder}/{name}", f"{root}/{name}"))
                sink = fs.open_output_stream(files[-1][0])
                book, at, listed = Workbook(sink, query or ""), (query, None), 0
            if sheet != at[1]:
                if at[1] == 0:
                    formulas()
                at = (query, sheet)
                book.sheet(SUMMARY, (query or "",), SUMMARY_HEAD) if sheet == 0 else book.sheet(EVERY, EVERY_HEAD)
            if sheet == 0:
                for r in run.to_pylist():
                    book.add(r["number"], r["seller"], r["price"], r["quantity"], (f"=C{book.row + 1}*D{book.row + 1}",), r["name"])
                continue
            numbers = pc.coalesce(run.column("number"), pa.array(np.arange(listed + 1, listed + len(run) + 1)))
            run, listed = run.set_column(run.schema.get_field_index("number"), "number", numbers), listed + len(run)
            while len(run):
                if book.row >= SHEET_ROWS:
                    book.sheet(f"{EVERY} {len(book.names)}", EVERY_HEAD)
                fits = SHEET_ROWS - book.row
                book.add_all(*[run.column(c).slice(0, fits) for c in ("number", "source_label", "seller", "name", "price", "url")])
                run = run.slice(fits)
        finish()
        return Moves(files)

    def commit(self, messages: list[Moves]) -> None:
        fs, root = self._fs()
        for m in messages:
            for draft, final in m.files if m else ():
                fs.move(draft, final)
        self._clean(fs, root)

    def abort(self, messages: list[Moves]) -> None:
        self._clean(*self._fs())

    @staticmethod
    def _clean(fs: pafs.FileSystem, root: str) -> None:
        if fs.get_file_info(f"{root}/_temporary").type != pafs.FileType.NotFound:
            fs.delete_dir(f"{root}/_temporary")


class WorkbookSink(DataSource):
    """The format ``workbooks``; its option ``path`` names the folder."""

    @classmethod
    def name(cls) -> str:
        return "workbooks"

    def writer(self, schema, overwrite: bool) -> WorkbookWriter:
        return WorkbookWriter(self.options["path"])


def write_workbooks(chosen: DataFrame, every: DataFrame, path: str, quantity: int = 1, order: tuple[str, ...] = ()) -> None:
    """A workbook for each query: the chosen offers with formulas for their mean, deviation, variation and total, then all offers.

    ``chosen`` and ``every`` are what ``nmck.sheets`` returns.  With ``order``, ``every`` needs no numbers: a task sorts the
    offers of its queries anyway and numbers them as it writes.  Queries without chosen offers have the second sheet alone.
    """
    spark = chosen.sparkSession
    spark.dataSource.register(WorkbookSink)
    names = [f.split()[0] for f in ROWS.split(", ")]
    by = [f"_by_{c}" for c in order]

    def rows(df: DataFrame, sheet: int) -> DataFrame:
        own = df.withColumns({"sheet": F.lit(sheet), "quantity": F.lit(quantity), "number": (F.lit(None) if sheet and order else F.col("number")).cast("long")})
        return own.select(*[F.col(c).cast("double").alias(c) if c == "price" else F.col(c) for c in names], *[(F.col(c) if sheet else F.lit(None).cast(every.schema[c].dataType)).alias(b) for c, b in zip(order, by, strict=True)])

    both = rows(chosen, 0).unionByName(rows(every, 1)).repartition("query_id").sortWithinPartitions("query_id", "sheet", "number", *by)
    both.select(*names).write.format("workbooks").option("path", path).mode("append").save()


CELLS = "file string, sheet string, row int, place int, value string, formula string"


def _blocks(sheet) -> Iterator[bytes]:
    """A sheet's text in stretches of whole rows."""
    left = b""
    while more := sheet.read(BLOCK):
        left += more
        end = left.rfind(b"</row>") + 6
        if end > 5:
            yield left[:end]
            left = left[end:]


def _read(block: bytes, before: int) -> pa.StructArray:
    """(row, place, value, formula) of the cells of whole rows that are not empty; ``before`` rows are above."""
    if b"\r" in block:
        block = block.replace(b"\r\n", b"\n").replace(b"\r", b"\n")
    rows = pc.split_pattern(pa.array([block.decode()], pa.large_string()), "</row>").flatten()
    # No text has a bare < in it; before a row's first cell stands no cell.
    split = pc.split_pattern(rows.slice(0, len(rows) - 1), "<c")
    row, flat = pc.list_parent_indices(split).to_numpy(), split.flatten()
    place = np.arange(len(flat)) - (split.offsets.to_numpy()[:-1] - split.offsets[0].as_py())[row]
    kept = pa.array(place > 0)
    kept = pc.and_(kept, pc.invert(pc.starts_with(flat, "/>")))
    row, place, flat = row[kept.to_numpy(zero_copy_only=False)], place[kept.to_numpy(zero_copy_only=False)], flat.filter(kept)
    kinds, found = [pc.starts_with(flat, a[2:]) for a, _ in (_TEXT, _NUMBER, _FORMULA)], []
    if not pc.all(pc.or_(pc.or_(*kinds[:2]), kinds[2])).as_py():
        raise ValueError("a cell that no workbook of this sink has")
    raw = flat.cast(pa.large_binary())
    for around in (_TEXT, _NUMBER):  # a formula's are as long as a number's
        found.append(pc.binary_slice(raw, len(around[0]) - 2, -len(around[1])).cast(pa.large_string()))
    inner = pc.if_else(kinds[0], *found)
    if b"&" in block:
        for plain, safe in reversed(_ESCAPES):
            inner = pc.replace_substring(inner, safe, plain)
    inner, none = inner.cast(pa.string()), pa.scalar(None, pa.string())
    columns = [pa.array(row + before + 1, pa.int32()), pa.array(place, pa.int32()), pc.if_else(kinds[2], none, inner), pc.if_else(kinds[2], inner, none)]
    return pa.StructArray.from_arrays(columns, ["row", "place", "value", "formula"])


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """(file, sheet, row, place, value, formula) of the cells of all workbooks of this sink in a folder that are not empty."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io
        import xml.etree.ElementTree as ET

        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content"), strict=True):
                book = zipfile.ZipFile(io.BytesIO(content.as_buffer()))
                sheets = ET.fromstring(book.read("xl/workbook.xml")).iter(f"{{{_MAIN}}}sheet")
                for n, sheet in enumerate(sheets, 1):
                    row = 0
                    for block in _blocks(book.open(f"xl/worksheets/sheet{n}.xml")):
                        found = _read(block, row)
                        row += block.count(b"</row>")
                        listed = pa.ListArray.from_arrays(pa.array([0, len(found)], pa.int32()), found)
                        yield pa.RecordBatch.from_arrays([pa.array([name.as_py().rsplit("/", 1)[-1]]), pa.array([sheet.get("name")]), listed], ["file", "sheet", "cells"])

    held = "file string, sheet string, cells array<struct<row: int, place: int, value: string, formula: string>>"
    read = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("path", "content").mapInArrow(cells, held)
    return read.select("file", "sheet", F.inline("cells"))
