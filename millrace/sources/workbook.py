"""Excel workbooks as a Spark data source, without an Excel library.

    spark.dataSource.register(Workbook)
    spark.read.format("workbook").option("sheet", "Sheet1").load(path)

Every sheet is a partition. A sheet's XML is parsed as a stream in blocks of rows, and
cells are kept as text; the first row is the header. Columns: sheet, row (its number in
the sheet) and cells, a map of header to text.
"""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from millrace import lexicon as L
from millrace.functions import text

SCHEMA = "sheet string, row int, cells map<string,string>"
NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Rows of a sheet that are held at a time.
BLOCK = 2000


def open_file(path: str):
    fs, name = pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    return fs.open_input_file(name)


def sheets(archive: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, path in the archive) of every sheet, in order."""
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(archive.read("xl/_rels/workbook.xml.rels"))}
    book = ElementTree.fromstring(archive.read("xl/workbook.xml"))
    return [(s.get("name"), "xl/" + targets[s.get(REL)].removeprefix("/xl/").removeprefix("xl/")) for s in book.iter(f"{NS}sheet")]


def shared_strings(archive: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in archive.namelist():
        return []
    out = []
    with archive.open("xl/sharedStrings.xml") as f:
        for _, node in ElementTree.iterparse(f):
            if node.tag == f"{NS}si":
                out.append("".join(t.text or "" for t in node.iter(f"{NS}t")))
                node.clear()
    return out


def column_number(reference: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def sheet_rows(archive: zipfile.ZipFile, path: str, strings: list[str]) -> Iterator[tuple[int, dict[int, str]]]:
    """(row number, column number to text) of each row, parsed as a stream."""
    with archive.open(path) as f:
        number = 0
        for _, node in ElementTree.iterparse(f):
            if node.tag != f"{NS}row":
                continue
            number = int(node.get("r", number + 1))
            cells = {}
            for i, c in enumerate(node.iter(f"{NS}c")):
                kind, value = c.get("t"), c.find(f"{NS}v")
                if kind == "inlineStr":
                    content = "".join(t.text or "" for t in c.iter(f"{NS}t"))
                elif value is None or value.text is None:
                    continue
                else:
                    content = strings[int(value.text)] if kind == "s" else value.text
                cells[column_number(c.get("r")) if c.get("r") else i] = content
            node.clear()
            yield number, cells


class SheetPartition(InputPartition):
    def __init__(self, name: str, path: str):
        super().__init__(None)
        self.name, self.path = name, path


class WorkbookReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.sheet, self.limit = options["path"], options.get("sheet"), int(options.get("rows", -1))

    def partitions(self):
        with open_file(self.path) as f, zipfile.ZipFile(f) as archive:
            found = sheets(archive)
        if self.sheet is not None:
            found = [found[int(self.sheet)]] if self.sheet.isdigit() and self.sheet not in dict(found) else [s for s in found if s[0] == self.sheet]
            if not found:
                raise ValueError(f"no such sheet: {self.sheet}")
        return [SheetPartition(*s) for s in found]

    def read(self, partition):
        kind = pa.schema([("sheet", pa.string()), ("row", pa.int32()), ("cells", pa.map_(pa.string(), pa.string()))])
        with open_file(self.path) as f, zipfile.ZipFile(f) as archive:
            strings = shared_strings(archive)
            header, block, taken = None, [], 0
            for number, cells in sheet_rows(archive, partition.path, strings):
                if header is None:
                    header = cells
                    continue
                if 0 <= self.limit <= taken:
                    break
                taken += 1
                block.append((partition.name, number, [(header[i], v) for i, v in cells.items() if i in header]))
                if len(block) == BLOCK:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*block), kind.types)], schema=kind)
                    block = []
            if block:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*block), kind.types)], schema=kind)


class Workbook(DataSource):
    @classmethod
    def name(cls):
        return "workbook"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WorkbookReader(dict(self.options))


def read_workbook(spark: SparkSession, path: str, sheet: str | int | None = None, rows: int | None = None) -> DataFrame:
    """(sheet, row, cells) of a sheet by name or number, or of all sheets."""
    spark.dataSource.register(Workbook)
    reader = spark.read.format("workbook")
    if sheet is not None:
        reader = reader.option("sheet", str(sheet))
    if rows is not None:
        reader = reader.option("rows", str(rows))
    return reader.load(path)


def structure(path: str) -> list[dict]:
    """Names, sizes and dimensions of a workbook's sheets, without reading a cell."""
    with open_file(path) as f, zipfile.ZipFile(f) as archive:
        out = []
        for name, place in sheets(archive):
            with archive.open(place) as sheet:
                found = re.search(rb'<dimension ref="([^"]+)"', sheet.read(4096))
            out.append({"sheet": name, "bytes": archive.getinfo(place).file_size, "dimension": found[1].decode() if found else None})
        return out


def pick(cells, names) -> object:
    """The text under the first header, in the given order, that a cell map has (headers are compared without case)."""
    lowered = F.map_from_entries(F.transform(F.map_entries(cells), lambda e: F.struct(F.lower(text.clean(e["key"])).alias("key"), e["value"].alias("value"))))
    return F.coalesce(*(F.try_element_at(lowered, F.lit(n)) for n in names), F.lit(None).cast("string"))


def articles(rows: DataFrame, scope: str = "main_task") -> DataFrame:
    """Workbook rows (sheet, row, cells) as articles; unmapped columns go to extra, rows without id are named by their place."""
    spark_conf = rows.sparkSession.conf
    spark_conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")  # headers that differ in case alone
    get = lambda c: pick(F.col("cells"), L.COLUMN_ALIASES[c])
    known = F.array(*(F.lit(n) for names in L.COLUMN_ALIASES.values() for n in names))
    extra = F.map_filter("cells", lambda k, v: ~F.array_contains(known, F.lower(text.clean(k))))
    task = F.lit(scope)
    for name, s in L.SHEET_SCOPES.items():
        task = F.when((F.col("sheet") == name) & F.lit(scope == "main_task"), s).otherwise(task)
    blank = lambda c: text.none_if_blank(get(c))
    return rows.select(
        F.coalesce(blank("article_id"), F.concat(F.lit("ROW-"), (F.col("row") - 1).cast("string"))).alias("article_id"), text.clean(get("title")).alias("title"), text.parse_sheet_time(get("publish_time")).alias("publish_time"),
        text.clean(get("source")).alias("source"), text.clean(get("content")).alias("content"), text.identifier(get("trading_code"), 6).alias("trading_code"), text.entity_name(get("entity")).alias("entity"),
        text.identifier(get("industry_code")).alias("industry_code"), text.clean(get("industry")).alias("industry"), blank("event_label").alias("event_label"), blank("polarity_label").alias("polarity_label"),
        blank("impact_analysis").alias("impact_analysis"), get("duplicate_flag").alias("duplicate_flag"), F.nullif(text.identifier(get("duplication_id")), F.lit("")).alias("duplication_id"),
        task.alias("task_scope"), F.col("sheet").alias("sheet_name"), F.col("row").alias("source_row"), extra.alias("extra"),
    )


def renamed(df: DataFrame) -> DataFrame:
    """A frame with any headers, renamed to the canonical columns; the first that fits a name wins, others keep theirs."""
    used, out = set(), []
    for c in df.columns:
        canonical = next((k for k, names in L.COLUMN_ALIASES.items() if c.strip().lower() in names), None)
        if canonical and canonical not in used:
            used.add(canonical)
            out.append(F.col(f"`{c}`").alias(canonical))
        else:
            out.append(F.col(f"`{c}`"))
    return df.select(out)


def write_workbook(path: str, content: dict[str, list[list]]) -> None:
    """A plain workbook with inline strings; for exports that fit the driver."""
    from xml.sax.saxutils import escape

    def letters(i: int) -> str:
        out = ""
        i += 1
        while i:
            i, r = divmod(i - 1, 26)
            out = chr(65 + r) + out
        return out

    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{escape(n)}" sheetId="{i + 1}" r:id="rId{i + 1}"/>' for i, n in enumerate(content)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{i + 1}" Type="{rel}/worksheet" Target="worksheets/sheet{i + 1}.xml"/>' for i in range(len(content))) + "</Relationships>")
        for i, rows in enumerate(content.values()):
            body = "".join(f'<row r="{r + 1}">' + "".join(f'<c r="{letters(c)}{r + 1}" t="inlineStr"><is><t>{escape(str(v))}</t></is></c>' for c, v in enumerate(row) if v is not None) + "</row>" for r, row in enumerate(rows))
            z.writestr(f"xl/worksheets/sheet{i + 1}.xml", f'<worksheet xmlns="{main}"><dimension ref="A1:{letters(max((len(r) for r in rows), default=1) - 1)}{len(rows)}"/><sheetData>{body}</sheetData></worksheet>')
