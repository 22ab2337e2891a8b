"""Uploaded CSV, TSV, text and Excel files as DataFrames.

Only the head of a file is looked at on the driver, to find encoding, separator and header; the encoding is held
against the whole file and the rows are read by Spark, in splits unless a row holds a quoted line feed. Types come
from one aggregate over all columns, which also tells whether there are rows.
"""

from __future__ import annotations

import codecs
import csv
import io
import re
import zipfile
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed: cells that are null.
NULLS = ("", "NULL", "null", "N/A", "n/a", "NA", "na", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "NaN", "nan", "None")
#: Fixed: the separators tried, in this order.
SEPARATORS = (",", "\t", ";", "|")
HEAD = 64 * 1024


class IngestError(ValueError):
    """A file without rows, or one that can't be read in any of the ways tried."""


def _head(spark: SparkSession, path: str, size: int = HEAD) -> bytes:
    """The first bytes of a file in any file system that Spark reads."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(where)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(jvm.org.apache.commons.io.input.BoundedInputStream(stream, size)))
    finally:
        stream.close()


def sniff_encoding(head: bytes) -> str:
    """By byte order mark, else the first of UTF-8, GBK and Latin-1 that decodes the head."""
    for mark, name in ((codecs.BOM_UTF8, "UTF-8"), (codecs.BOM_UTF16_LE, "UTF-16"), (codecs.BOM_UTF16_BE, "UTF-16")):
        if head.startswith(mark):
            return name
    for name in ("UTF-8", "GBK"):
        try:
            codecs.getincrementaldecoder(name)().decode(head, final=False)
            return name
        except UnicodeDecodeError:
            pass
    return "ISO-8859-1"


def facts_of(spark: SparkSession, path: str, head: bytes) -> tuple[str, bool]:
    """The encoding, by sniff_encoding() held against the lines of the whole file: the first that decodes
    them all; and whether a line ends within quotes, so that rows may hold line feeds."""
    first = sniff_encoding(head)
    if first == "UTF-16":
        return first, True
    if len(head) < HEAD:
        return first, any(x.count(b'"') % 2 for x in head.splitlines())

    def wrong(batches):
        for batch in batches:
            lines, bad = [x for x in batch.column(0).to_pylist() if x], []
            said = b"\n".join(lines)
            for name in ("UTF-8", "GBK"):
                try:
                    said.decode(name)
                except UnicodeDecodeError:
                    bad.append(name)
            if any(x.count(b'"') % 2 for x in lines):
                bad.append("quotes")
            yield pa.RecordBatch.from_arrays([pa.array(bad, pa.string())], ["name"])

    bad = {x["name"] for x in spark.read.text(path).select(F.col("value").cast("binary")).mapInArrow(wrong, "name string").distinct().collect()}
    found = first if head.startswith(codecs.BOM_UTF8) else next((name for name in ("UTF-8", "GBK") if name not in bad), "ISO-8859-1")
    return found, "quotes" in bad


def sniff_separator(text: str) -> str:
    """The separator that is frequent and steady over the first lines; a comma if none is."""
    lines = [x for x in text[:4096].splitlines()[:5] if x.strip()]
    score = {}
    for sep in SEPARATORS:
        counts = [x.count(sep) for x in lines]
        score[sep] = sum(counts) / len(counts) / (1 + max(counts) - min(counts)) if counts else 0.0
    best = max(SEPARATORS, key=score.__getitem__)
    return best if score[best] >= 0.5 else ","


def separator_for(path: str, text: str) -> str:
    """The sniffed separator, corrected by the file's extension."""
    found, ending = sniff_separator(text), path.rsplit(".", 1)[-1].lower()
    return "\t" if ending == "tsv" else "," if ending == "csv" and found == "\t" else found


def header_names(cells: Sequence[str | None]) -> list[str]:
    """Trimmed and distinct; missing ones are Column_i."""
    out: list[str] = []
    for i, c in enumerate(cells):
        name = (c or "").strip() or f"Column_{i + 1}"
        k, base = 1, name
        while name in out:
            name, k = f"{base}.{k}", k + 1
        out.append(name)
    return out


def nulls(value: Column) -> Column:
    return F.when(~value.isin(*NULLS), value)


def infer_numbers(df: DataFrame, strict: bool = False, rows: bool = False) -> DataFrame:
    """Text columns with a number in them become doubles, and whole numbers longs; other cells of such
    a column become null. strict: only if all its cells are numbers. Infinities and NaN are null. rows: none is an error."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not texts:
        if rows and df.isEmpty():
            raise IngestError("there are no rows")
        return df
    number = lambda c: F.trim(F.col(f"`{c}`")).try_cast("double")
    plain = lambda c: F.col(f"`{c}`").rlike(r"^\s*[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|[iI]nf(inity)?|[nN]a[nN])\s*$")
    found = lambda c: F.when(plain(c), number(c))
    facts = df.agg(F.count(F.lit(1)).alias("rows"), *[a for i, c in enumerate(texts) for a in (F.count(found(c)).alias(f"n{i}"), F.count(F.col(f"`{c}`")).alias(f"all{i}"), F.count(F.when(~F.col(f"`{c}`").rlike(r"^\s*[+-]?\d{1,18}\s*$"), 1)).alias(f"odd{i}"))]).first()
    if rows and not facts["rows"]:
        raise IngestError("there are no rows")
    made = {}
    for i, c in enumerate(texts):
        if facts[f"n{i}"] and not (strict and facts[f"n{i}"] < facts[f"all{i}"]):
            x = found(c)
            made[c] = F.trim(F.col(f"`{c}`")).try_cast("long") if not facts[f"odd{i}"] else F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)
    return df.select(*[made.get(c, F.col(f"`{c}`")).alias(c) for c in df.columns])


def field_types(df: DataFrame) -> dict[str, str]:
    return {f.name: "number" if isinstance(f.dataType, T.NumericType) else "boolean" if isinstance(f.dataType, T.BooleanType) else "string" for f in df.schema.fields}


def _rows(spark: SparkSession, path: str, names: list[str], sep: str, quote: str, encoding: str, start_row: int, feeds: bool) -> DataFrame:
    """All rows after the header, as texts. Short rows are padded with null, long ones cut."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    options = {"sep": sep, "quote": quote, "escape": '"', "ignoreLeadingWhiteSpace": "true", "mode": "PERMISSIVE"}
    if encoding == "GBK":
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    if start_row <= 1:
        return spark.read.schema(schema).options(**options, header="true", enforceSchema="true", encoding=encoding, multiLine=str(feeds and bool(quote)).lower()).csv(path)
    # lines before the header are dropped by their place in the first split; quoted line feeds end a row here
    one = T.StructType([T.StructField("line", T.StringType())])
    lines = spark.read.schema(one).options(sep="\x00", quote="", encoding=encoding).csv(path)
    place = F.monotonically_increasing_id()
    kept = lines.select("line", place.alias("_at")).where(f"_at >= {start_row}").select(F.from_csv("line", ", ".join(f"`{n}` string" for n in names), options).alias("r"))
    return kept.select("r.*")


def read_text(spark: SparkSession, path: str, start_row: int = 1, strict: bool = False, size: int = HEAD) -> DataFrame:
    """A separated text file: first with quotes, then without, then with other separators; the first
    way that gives a plausible header wins. Null cells and rows without a cell go. size: bytes looked at
    for the header; if it ends behind them, twice as many are."""
    head = _head(spark, path, size)
    if not head.strip():
        raise IngestError("the file is empty")
    encoding, feeds = facts_of(spark, path, head)
    text = codecs.getincrementaldecoder(encoding)(errors="replace").decode(head, final=False).lstrip("﻿")
    sniffed = separator_for(path, text)
    lines = [x for x in text.splitlines() if x.strip()]
    if len(lines) <= start_row and len(head) == size:
        return read_text(spark, path, start_row, strict, 2 * size)
    if len(lines) < start_row:
        raise IngestError("there is no header")
    tried = []
    for sep, quote in [(sniffed, '"'), (sniffed, ""), *[(s, '"') for s in SEPARATORS if s != sniffed]]:
        try:
            reader = csv.reader(io.StringIO("\n".join(lines[start_row - 1 :])), delimiter=sep, skipinitialspace=True, **({"quotechar": quote} if quote else {"quoting": csv.QUOTE_NONE}))
            cells = next(reader)
        except (csv.Error, StopIteration) as e:
            tried.append(f"{sep!r}: {e}")
            continue
        if len(cells) == 1 and any(s in cells[0] for s in SEPARATORS) or quote and len(cells) < 2 and text.count(quote) % 2:
            tried.append(f"{sep!r}: one column named {cells[0][:40]!r}")
            continue
        if len(head) == size and reader.line_num > len(lines) - start_row:
            return read_text(spark, path, start_row, strict, 2 * size)
        df = _rows(spark, path, header_names(cells), sep, quote, encoding, start_row, feeds)
        df = df.select(*[nulls(F.col(f"`{c}`")).alias(c) for c in df.columns])
        df = df.where(F.coalesce(*[F.col(f"`{c}`") for c in df.columns]).isNotNull())
        return infer_numbers(df, strict, rows=True)
    raise IngestError("no way to read it: " + "; ".join(tried))


_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


#: Fixed: built-in number formats that show a date or a time.
_DATED = {*range(14, 23), 27, 30, 36, *range(45, 48), 50, 57}


def _date_styles(z: zipfile.ZipFile) -> set[int]:
    """The cell styles whose number format shows a date."""
    if "xl/styles.xml" not in z.namelist():
        return set()
    root = ElementTree.fromstring(z.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")) for f in root.iter(f"{_MAIN}numFmt") if re.search("[ymdhs]", re.sub(r'"[^"]*"|\\.|\[(?!h|m|s)[^\]]*\]', "", (f.get("formatCode") or "").lower()).replace("general", ""))}
    return {i for i, x in enumerate(root.findall(f"{_MAIN}cellXfs/{_MAIN}xf")) if int(x.get("numFmtId") or 0) in _DATED | own}


def _date(serial: str, from_1904: bool) -> str:
    """Days since the workbook's first day as a timestamp."""
    days = float(serial)
    first = datetime(1904, 1, 1) if from_1904 else datetime(1899, 12, 30) if days >= 60 else datetime(1899, 12, 31)  # the format counts a 29 February 1900
    return str(first + timedelta(milliseconds=round(days * 86_400_000)))[:23]


def excel_cells(raw: bytes, sheet: str | int | None = None) -> list[list[str | None]]:
    """The cells of one sheet of an .xlsx or .xlsm file as texts, dates as timestamps; by default of the first sheet."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        shared = [] if "xl/sharedStrings.xml" not in z.namelist() else ["".join(t.text or "" for t in s.iter(f"{_MAIN}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        dated, book = _date_styles(z), ElementTree.fromstring(z.read("xl/workbook.xml"))
        from_1904 = any(p.get("date1904") in ("1", "true") for p in book.iter(f"{_MAIN}workbookPr"))
        sheets = [(s.get("name"), links[s.get(_REL)]) for s in book.iter(f"{_MAIN}sheet")]
        if sheet is None or str(sheet).isdigit():
            k = int(sheet or 0)
            if k >= len(sheets):
                raise IngestError(f"there is no sheet {k}")
            target = sheets[k][1]
        else:
            target = dict(sheets).get(sheet)
            if target is None:
                raise IngestError(f"there is no sheet {sheet!r}")
        page = ElementTree.fromstring(z.read(target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
    out: list[list[str | None]] = []
    for row in page.iter(f"{_MAIN}row"):
        cells: list[str | None] = []
        for c in row.iter(f"{_MAIN}c"):
            at = 0
            for letter in re.match(r"[A-Z]*", c.get("r") or "")[0]:
                at = at * 26 + ord(letter) - 64
            cells += [None] * (max(at, len(cells) + 1) - 1 - len(cells))
            value, kind = c.find(f"{_MAIN}v"), c.get("t")
            said = value.text if value is not None else None
            if kind == "s" and said is not None:
                said = shared[int(said)]
            elif kind == "inlineStr":
                said = "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
            elif kind == "b" and said is not None:
                said = "true" if said == "1" else "false"
            elif said is not None and kind in (None, "n") and int(c.get("s") or 0) in dated:
                said = _date(said, from_1904)
            cells.append(said)
        out.append(cells)
    return out


def read_excel(spark: SparkSession, path: str, sheet: str | int | None = None, start_row: int = 1, strict: bool = False) -> DataFrame:
    """A sheet as a DataFrame. Workbooks are read by one task each, as their format demands."""
    if path.lower().endswith(".xls"):
        raise IngestError(".xls workbooks are not supported: save the file as .xlsx or .csv")
    raw = spark.read.format("binaryFile").load(path).select("content").first()
    if raw is None or not raw[0]:
        raise IngestError("the file is empty")
    try:
        cells = [r for r in excel_cells(bytes(raw[0]), sheet)]
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
        raise IngestError(f"not an .xlsx or .xlsm file: {e}") from e
    if len(cells) <= start_row:
        raise IngestError("there are no rows")
    names = header_names(cells[start_row - 1])
    rows = [tuple((None if x in NULLS else x) for x in [*r, *[None] * len(names)][: len(names)]) for r in cells[start_row:]]
    rows = [r for r in rows if any(x is not None for x in r)]
    if not rows:
        raise IngestError("there are no rows")
    return infer_numbers(spark.createDataFrame(rows, T.StructType([T.StructField(n, T.StringType()) for n in names])), strict)


def load_file(spark: SparkSession, path: str, sheet: str | int | None = None, start_row: int = 1, strict: bool = False) -> tuple[DataFrame, dict[str, str]]:
    """The rows of a file and the types of its fields: number, boolean or string."""
    ending = path.rsplit(".", 1)[-1].lower()
    df = read_text(spark, path, start_row, strict) if ending in ("csv", "tsv", "txt") else read_excel(spark, path, sheet, start_row, strict)
    return df, field_types(df)


@dataclass(frozen=True)
class Upload:
    """What an upload gives back: the rows, and what is said about them."""

    rows: DataFrame
    name: str
    fields: dict[str, str]
    count: int

    @property
    def message(self) -> str:
        return f"{self.name}: {self.count} rows, {len(self.fields)} fields"


def upload(spark: SparkSession, path: str, sheet: str | int | None = None, start_row: int = 1, strict: bool = False) -> Upload:
    df, fields = load_file(spark, path, sheet, start_row, strict)
    return Upload(df, path.rstrip("/").rsplit("/", 1)[-1], fields, df.count())
