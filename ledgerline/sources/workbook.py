"""Workbooks (.xlsx): the first sheet of every file of a folder as one table."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerline.errors import IngestError
from ledgerline.sources.files import apply_types, infer_types, with_missing

_BATCH = 5000
_SPACE = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _shared_texts(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    root = ElementTree.fromstring(book.read("xl/sharedStrings.xml"))
    return ["".join(t.text or "" for t in item.iter(f"{_SPACE}t")) for item in root.iter(f"{_SPACE}si")]


def _first_sheet(book: zipfile.ZipFile) -> str:
    sheets = ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_SPACE}sheet")
    wanted = next(sheets).get(_REL)
    for rel in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")):
        if rel.get("Id") == wanted:
            return "xl/" + rel.get("Target").removeprefix("/xl/")
    raise IngestError("The workbook has no sheet.")


def _place(reference: str) -> int:
    n = 0
    for letter in re.match(r"[A-Z]+", reference).group():
        n = n * 26 + ord(letter) - 64
    return n - 1


def _cell_text(cell, shared: list[str]) -> str | None:
    kind = cell.get("t")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{_SPACE}t"))
    value = cell.find(f"{_SPACE}v")
    if value is None or value.text is None:
        return None
    if kind == "s":
        return shared[int(value.text)]
    if kind == "b":
        return "True" if value.text == "1" else "False"
    return value.text


def sheet_rows(content: bytes) -> Iterator[list[str | None]]:
    """Rows of the first sheet as texts, read element by element."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared = _shared_texts(book)
        with book.open(_first_sheet(book)) as sheet:
            for _, element in ElementTree.iterparse(sheet):
                if element.tag != f"{_SPACE}row":
                    continue
                row: list[str | None] = []
                for cell in element.iter(f"{_SPACE}c"):
                    at = _place(cell.get("r")) if cell.get("r") else len(row)
                    row += [None] * (at + 1 - len(row))
                    row[at] = _cell_text(cell, shared)
                yield row
                element.clear()


def _read_books(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            out: list[tuple] = []
            for i, cells in enumerate(sheet_rows(bytes(content))):
                out.append((path, i, cells))
                if len(out) == _BATCH:
                    yield pd.DataFrame(out, columns=["path", "row", "cells"])
                    out = []
            if out:
                yield pd.DataFrame(out, columns=["path", "row", "cells"])


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """All .xlsx files of a folder (or one file) sharing a header row, as a typed table."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.xlsx").load(path)
    )
    rows = files.select("path", "content").mapInPandas(_read_books, "path string, row long, cells array<string>")
    header = rows.where("row = 0").orderBy("path").limit(1).first()
    if header is None or not header["cells"]:
        raise IngestError("the first sheet has no heading")
    names = [c or f"Unnamed: {i}" for i, c in enumerate(header["cells"])]
    text = with_missing(
        rows.where("row > 0").select(*[F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names)])
    )
    return apply_types(text, infer_types(text))
