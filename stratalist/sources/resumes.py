"""Resumes as text: plain text and Markdown, docx by its own XML, and PDF as far as its streams are not compressed."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The namespace of docx paragraphs, and strings in a PDF's streams.
WORDS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}t"
PDF_STRING = re.compile(rb"\((?:\\.|[^\\()])*\)", re.DOTALL)
#: The most that a docx may unpack to.
XML_BYTES = 64 << 20


def _docx(raw: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(raw)) as archive:
        if archive.getinfo("word/document.xml").file_size > XML_BYTES:
            raise ValueError("the document unpacks to too much")
        root = ElementTree.fromstring(archive.read("word/document.xml"))
    return " ".join(node.text or "" for node in root.iter(WORDS)).strip()


def _pdf(raw: bytes) -> str:
    found = (m[0][1:-1].decode("latin-1").replace("\\(", "(").replace("\\)", ")") for m in PDF_STRING.finditer(raw))
    return " ".join(" ".join(found).split())


def text_of(name: str, raw: bytes) -> tuple[str, str]:
    """(text, status): ok, empty, unknown for another kind of file, or what went wrong."""
    suffix = name.lower().rpartition(".")[2]
    read = {"txt": lambda b: b.decode("utf-8", "ignore"), "md": lambda b: b.decode("utf-8", "ignore"), "docx": _docx, "pdf": _pdf}.get(suffix)
    if read is None:
        return "", "unknown"
    try:
        text = read(raw)
    except Exception as e:  # a broken file is a status, not the end of the job
        return "", f"{type(e).__name__}: {e}"[:200]
    return text, "ok" if text.strip() else "empty"


def read_resumes(spark: SparkSession, path: str) -> DataFrame:
    """path, name, text and status of each file of a folder; Spark lists no files without a byte."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.column("name").to_pylist()
            found = [text_of(n, raw.as_buffer().to_pybytes()) for n, raw in zip(names, b.column("content"), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("path"), b.column("name"), *(pa.array([f[k] for f in found], pa.string()) for k in range(2))], ["path", "name", "text", "status"])

    files = spark.read.format("binaryFile").load(path).select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    return files.mapInArrow(run, "path string, name string, text string, status string")
