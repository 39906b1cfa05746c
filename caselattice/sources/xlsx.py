"""Workbooks: the first sheet of .xlsx files as a table of texts, and tables written as .xlsx files."""

from __future__ import annotations

import io
import itertools
import re
import uuid
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rows import numbered
from ..functions.tables import written

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _elements(f, name: str) -> Iterator[ElementTree.Element]:
    """The elements of a name, one at a time; what was passed is let go."""
    parents = []
    for event, e in ElementTree.iterparse(f, ("start", "end")):
        if event == "start":
            parents.append(e)
            continue
        parents.pop()
        if e.tag == MAIN + name:
            yield e
            if parents:
                parents[-1].clear()


def sheet_rows(data: bytes) -> Iterator[list[str | None]]:
    """The cells of the first sheet, row by row, in place. Shared texts are held, rows are not."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        strings = []
        if "xl/sharedStrings.xml" in names:
            with z.open("xl/sharedStrings.xml") as f:
                strings = ["".join(t.text or "" for t in si.iter(f"{MAIN}t")) for si in _elements(f, "si")]
        sheet = min((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
        with z.open(sheet) as f:
            for row in _elements(f, "row"):
                cells: list[str | None] = []
                for c in row.iter(f"{MAIN}c"):
                    at = 0
                    for letter in re.match(r"[A-Z]*", c.get("r", ""))[0]:
                        at = at * 26 + ord(letter) - 64
                    cells += [None] * (max(at, len(cells) + 1) - len(cells))
                    kind, v = c.get("t"), c.find(f"{MAIN}v")
                    if kind == "inlineStr":
                        cells[(at or len(cells)) - 1] = "".join(t.text or "" for t in c.iter(f"{MAIN}t"))
                    elif v is not None and v.text is not None:
                        cells[(at or len(cells)) - 1] = strings[int(v.text)] if kind == "s" else v.text
                yield cells


def _sheets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(n, cells) of the first sheet of each workbook; the header is a batch of its own."""
    for b in batches:
        for data in b["content"]:
            rows = enumerate(sheet_rows(data.as_buffer().to_pybytes()))
            size = 1
            while part := list(itertools.islice(rows, size)):
                size = 10_000
                yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in part], pa.int64()), pa.array([c for _, c in part], pa.list_(pa.string()))], names=["n", "cells"])


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """The first sheet of a workbook, all cells as text, columns named by its first row.

    A workbook is one compressed file: Spark's binary reader hands it to one task, which reads it row by row; the header alone comes to
    the driver. Columns without a name are ``Unnamed: n``, names that come again get ``.1`` and so on. Empty rows are left out; a
    row's cells beyond the header too. A workbook of over 2 GB is more than a cell of Spark holds and is an error.
    """
    rows = spark.read.format("binaryFile").load(path).select("content").mapInArrow(_sheets, "n long, cells array<string>")
    first = rows.where("n = 0").first()
    names: list[str] = []
    for i, h in enumerate(first["cells"] if first else []):
        name, times = h if h is not None else f"Unnamed: {i}", 0
        while name in names:
            times += 1
            name = f"{h}.{times}"
        names.append(name)
    some = rows.where("n > 0 and exists(cells, c -> c is not null)")
    return some.select(*[F.get("cells", F.lit(i)).alias(name) for i, name in enumerate(names)])


#: Rows of a sheet, and the parts of a workbook around its sheets.
MOST_ROWS = 1_048_576
HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
SHEET = HEAD + '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>', "</sheetData></worksheet>"
RELATION = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


class _Stream:
    """A Hadoop output stream as a file that can't seek, a megabyte at a time."""

    def __init__(self, out):
        self.out, self.held, self.size = out, bytearray(), 0

    def write(self, data) -> int:
        self.held += data
        self.size += len(data)
        if len(self.held) >= 1 << 20:
            self.flush()
        return len(data)

    def flush(self) -> None:
        if self.held:
            self.out.write(self.held)
            self.held = bytearray()


def _cells(columns: list[Column]) -> Column:
    """A row's cells as XML: numbers as such, other values as inline texts; null cells stay away from their place by its letter."""
    shown = []
    for n, (c, kind) in enumerate(columns):
        place, k = "", n + 1
        while k:
            k, rest = divmod(k - 1, 26)
            place = chr(65 + rest) + place
        text = c.cast("string")
        # characters that XML can't hold are left out
        safe = F.regexp_replace(F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), r"[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]", "")
        safe = F.replace(safe, F.lit("\r"), F.lit("&#13;"))
        whole = kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal")
        cell = F.concat(F.lit(f'<c r="{place}'), F.col("__row").cast("string"), F.lit('"><v>' if whole else '" t="inlineStr"><is><t xml:space="preserve">'), safe, F.lit("</v></c>" if whole else "</t></is></c>"))
        shown.append(F.coalesce(cell, F.lit("")))
    return F.concat(F.lit('<row r="'), F.col("__row").cast("string"), F.lit('">'), *shown, F.lit("</row>"))


def write_xlsx(df: DataFrame, path: str, sheet: str = "Sheet1") -> int:
    """df in its own order as a workbook with a header row; the number of rows. More rows than a sheet holds go on in further sheets.

    Rows become XML in Spark's tasks and are streamed into the file, so the driver holds one partition's rows at most. The
    file is written beside its place and renamed when it is complete; a failure leaves what was there. Null cells are empty.
    """
    spark = df.sparkSession
    room = MOST_ROWS - 1
    rows = numbered(df.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(df.columns)]), "__n")
    rows = written(rows.withColumn("__row", F.pmod(F.col("__n") - 1, F.lit(room)) + 2).select("__n", _cells([(F.col(f"c{i}"), t) for i, (_, t) in enumerate(df.dtypes)]).alias("x")), "sheet")
    total = rows.count()
    sheets = max(1, -(-total // room))
    header = spark.range(1).select(*[F.lit(c).alias(f"c{i}") for i, c in enumerate(df.columns)], F.lit(1).alias("__row")).select(_cells([(F.col(f"c{i}"), "string") for i in range(len(df.columns))])).first()[0]
    Path = spark._jvm.org.apache.hadoop.fs.Path
    made, place = Path(f"{path}.{uuid.uuid4().hex}"), Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(made)
    try:
        stream = _Stream(out)
        names = [escape(sheet[:25] + ("" if n == 0 else f" ({n + 1})"), {'"': "&quot;"}) for n in range(sheets)]
        with zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED) as z:
            kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{n + 1}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for n in range(sheets))
            z.writestr("[Content_Types].xml", HEAD + '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>' + kinds + "</Types>")
            relations = f'{HEAD}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
            z.writestr("_rels/.rels", f'{relations}<Relationship Id="r1" Type="{RELATION}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
            listed = "".join(f'<sheet name="{name}" sheetId="{n + 1}" r:id="r{n + 1}"/>' for n, name in enumerate(names))
            z.writestr("xl/workbook.xml", f'{HEAD}<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="{RELATION}"><sheets>{listed}</sheets></workbook>')
            z.writestr("xl/_rels/workbook.xml.rels", relations + "".join(f'<Relationship Id="r{n + 1}" Type="{RELATION}/worksheet" Target="worksheets/sheet{n + 1}.xml"/>' for n in range(sheets)) + "</Relationships>")
            ordered = rows.orderBy("__n")
            for n in range(sheets):
                with z.open(f"xl/worksheets/sheet{n + 1}.xml", "w", force_zip64=True) as f:
                    f.write((SHEET[0] + header).encode())
                    part = ordered if sheets == 1 else ordered.where((F.col("__n") > n * room) & (F.col("__n") <= (n + 1) * room))
                    for r in part.select("x").toLocalIterator():
                        f.write(r["x"].encode("utf-8", "replace"))
                    f.write(SHEET[1].encode())
        stream.flush()
        out.close()
        how = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        how[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(made, place, how)
    except BaseException:
        out.close()
        fs.delete(made, False)
        raise
    return total
