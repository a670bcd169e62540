"""Articles from a folder of files of any kind: one row a document, ids by name, unreadable files said, not dropped."""

from __future__ import annotations

import io
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from askwright.functions.unicode_text import clean_text
from askwright.sources.tables import decode_bytes

SUFFIXES = ("md", "markdown", "txt", "html", "htm", "docx", "pdf")


def _docx(raw: bytes) -> str:
    import docx

    lines = []
    for p in docx.Document(io.BytesIO(raw)).paragraphs:
        style = (p.style.name or "").lower()
        lines.append(("## " if style.startswith(("heading", "titre")) else "- " if style.startswith(("list", "liste")) else "") + p.text)
    for t in docx.Document(io.BytesIO(raw)).tables:
        lines += [" | ".join(c.text.strip() for c in row.cells) for row in t.rows]
    return "\n".join(lines)


def _pdf(raw: bytes) -> str:
    import pypdf

    return "\n\n".join(page.extract_text() or "" for page in pypdf.PdfReader(io.BytesIO(raw)).pages)


def read_bytes(name: str, raw: bytes) -> tuple[str | None, str | None]:
    """(text, warning): the text of a file by its suffix; a file that cannot be read, or whose reader is missing, is a warning."""
    suffix = name.rsplit(".", 1)[-1].lower()
    try:
        text = _docx(raw) if suffix == "docx" else _pdf(raw) if suffix == "pdf" else decode_bytes(raw)
    except ImportError as e:
        return None, f"no reader for .{suffix}: {e}"
    except Exception as e:  # whatever a damaged file makes its reader raise
        return None, f"unreadable: {type(e).__name__}: {e}"
    return text, None


def title_of(text: str | None) -> str | None:
    """A heading or a 'Title:' line among the first five lines that hold something, else the first of them if short."""
    lines = [x.strip() for x in (text or "").split("\n") if x.strip()][:5]
    for line in lines:
        if m := re.match(r"(?i)#{1,6}\s+(.+)|(?:titre|title)\s*:\s*(.+)", line):
            return (m[1] or m[2]).strip()
    return lines[0] if lines and len(lines[0]) <= 150 else None


@F.pandas_udf(StringType())
def title_udf(texts: pd.Series) -> pd.Series:
    return texts.map(title_of, na_action="ignore")


def _id(path: str) -> str:
    name = re.split(r"[/\\]", path)[-1]
    number = re.search(r"(?i)KB\d{5,}", name)
    return number[0].upper() if number else re.sub(rf"(?i)\.({'|'.join(SUFFIXES)})$", "", name)


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """fiche_id, title, text, source, warning: ordered by lower-cased path; of equal ids the first stays, the others are warnings."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(SUFFIXES) + "}").load(folder)

    def parse(batches):
        for batch in batches:
            read = [read_bytes(p, bytes(c)) for p, c in zip(batch["path"], batch["content"])]
            yield pd.DataFrame({"fiche_id": [_id(p) for p in batch["path"]], "text": [t for t, _ in read], "source": batch["path"], "warning": [w for _, w in read]})

    read = files.select("path", "content").mapInPandas(parse, "fiche_id string, text string, source string, warning string")
    cleaned = read.withColumn("text", clean_text(F.col("text")))
    rows = cleaned.select("fiche_id", title_udf("text").alias("title"), "text", "source", "warning")
    first = F.row_number().over(Window.partitionBy("fiche_id").orderBy(F.lower("source"), "source")) == 1
    return rows.withColumn("warning", F.coalesce("warning", F.when(~first, "the id is another document's"))).orderBy(F.lower("source"))


def import_fiches(rows: DataFrame, id_col: str, title_col: str, body_cols: list[str], order_col: str | None = None) -> DataFrame:
    """Articles from a table: several body columns become sections headed by their names; a repeated id is marked.

    order_col tells which of equal ids is first; without it the rows' order as read does, which only one file has."""
    part = lambda c: F.when(F.trim(F.coalesce(F.col(c), F.lit(""))) != "", F.concat(F.lit(f"## {c}\n"), F.col(c)) if len(body_cols) > 1 else F.col(c))
    text = F.concat_ws("\n\n", *[part(c) for c in body_cols])
    w = Window.partitionBy(id_col).orderBy(order_col or F.monotonically_increasing_id())
    return rows.withColumn("__k", F.row_number().over(w)).select(F.col(id_col).alias("fiche_id"), F.col(title_col).alias("title"), text.alias("text"), (F.col("__k") > 1).alias("duplicate"))
