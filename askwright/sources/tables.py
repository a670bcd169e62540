"""Tables of any shape: CSV, JSON, JSONL, spreadsheets; headers, cells and columns by tolerant rules."""

from __future__ import annotations

import io
import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DELIMITERS = [";", ",", "\t", "|"]


class InputError(ValueError):
    """A file or a column that cannot be used, said in words."""


def guess_delimiter(line: str) -> str:
    """The most frequent of ; , tab |, the first of equals; a comma if there is none."""
    best = max(DELIMITERS, key=lambda c: (line.count(c), -DELIMITERS.index(c)))
    return best if line.count(best) else ","


def guess_delimiter_column(line: Column) -> Column:
    counted = [F.struct((F.length(line) - F.length(F.replace(line, F.lit(c), F.lit("")))).alias("n"), F.lit(-i).alias("o"), F.lit(c).alias("c")) for i, c in enumerate(DELIMITERS)]
    best = F.array_max(F.array(*counted))
    return F.when(best["n"] > 0, best["c"]).otherwise(",")


def normalize_header(name: str) -> str:
    plain = unicodedata.normalize("NFKD", name).encode("ascii", "ignore").decode()
    return " ".join(plain.lower().replace("_", " ").split())


def resolve_column(columns: list[str], wanted: str) -> str:
    """Exact name, else the first that differs by accents, case or underscores only."""
    if wanted in columns:
        return wanted
    for c in columns:
        if normalize_header(c) == normalize_header(wanted):
            return c
    raise InputError(f"no column {wanted!r}; there are: {', '.join(columns)}")


def cell_to_str(cell: Column, kind: str) -> Column:
    """Null is empty; whole floats lose their fraction; times are ISO with a space; lists are joined by ' | '."""
    if kind in ("double", "float"):
        text = F.when(cell == F.floor(cell), cell.cast("long").cast("string")).otherwise(cell.cast("string"))
    elif kind == "timestamp":
        text = F.date_format(cell, "yyyy-MM-dd HH:mm:ss")
    elif kind == "date":
        text = F.date_format(cell, "yyyy-MM-dd")
    elif kind.startswith("array"):
        text = F.array_join(cell.cast("array<string>"), " | ")
    else:
        text = cell.cast("string")
    return F.coalesce(text, F.lit(""))


def _named(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip("﻿").strip() or f"column_{i + 1}" for i, c in enumerate(df.columns)])


def read_rows(spark: SparkSession, path: str, delimiter: str | None = None, encoding: str = "UTF-8", sheet: str | None = None) -> DataFrame:
    """A table of strings, by the file's suffix."""
    low = path.lower()
    if low.endswith((".csv", ".tsv", ".txt")):
        if delimiter is None:
            head = spark.read.text(path).limit(1).collect()
            delimiter = guess_delimiter(head[0][0] if head else "")
        read = spark.read.option("header", True).option("sep", delimiter).option("multiLine", True).option("quote", '"').option("escape", '"').option("encoding", encoding).option("mode", "PERMISSIVE")
        return _named(read.csv(path)).na.drop("all")
    if low.endswith((".jsonl", ".ndjson")):
        return spark.read.json(path)
    if low.endswith(".json"):
        return spark.read.option("multiLine", True).json(path)
    if low.endswith(".xlsx"):
        return read_xlsx(spark, path, sheet)
    raise InputError(f"unknown kind of file: {path}")


def read_xlsx(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """First or named sheet; the header is the first row that is not empty, empty rows are skipped (needs openpyxl)."""
    try:
        import openpyxl
    except ImportError:
        raise InputError("spreadsheets need openpyxl, which is not installed") from None
    content = spark.read.format("binaryFile").load(path).select("content").first()[0]
    book = openpyxl.load_workbook(io.BytesIO(content), read_only=True, data_only=True)
    rows = [["" if v is None else str(v) for v in r] for r in (book[sheet] if sheet else book.worksheets[0]).iter_rows(values_only=True)]
    rows = [r for r in rows if any(r)]
    if not rows:
        raise InputError(f"no rows in {path}")
    header = [c or f"column_{i + 1}" for i, c in enumerate(rows[0])]
    return spark.createDataFrame(rows[1:], ", ".join(f"`{c}` string" for c in header))


def decode_bytes(raw: bytes) -> str:
    """UTF-8 (with or without mark), else cp1252, else latin-1."""
    for name in ("utf-8-sig", "cp1252"):
        try:
            return raw.decode(name)
        except UnicodeDecodeError:
            pass
    return raw.decode("latin-1")
