"""Documents from files: text, Markdown, DOCX, PDF; full text as Markdown."""

from __future__ import annotations

import hashlib
import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
MIN_CHARS_PER_PAGE = 200


class IngestError(ValueError):
    """A file that can't be read as a document."""


def docx_text(raw: bytes) -> str:
    """Paragraphs with text, joined by blank lines."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    found = ("".join(t.text or "" for t in p.iter(W + "t")) for p in root.iter(W + "p"))
    return "\n\n".join(p for p in found if p.strip())


def pdf_text(raw: bytes, min_chars: int = MIN_CHARS_PER_PAGE, ocr=None) -> str:
    """Text of the pages; of a scan (little text a page) what ocr(raw) reads, if that is more."""
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise IngestError("reading PDF needs pypdf") from e
    reader = PdfReader(io.BytesIO(raw))
    text = "\n\n".join(p.extract_text() or "" for p in reader.pages)
    if ocr is not None and len(text) < min_chars * len(reader.pages):
        return max(text, ocr(raw), key=len)
    return text


def paddle_ocr(raw: bytes) -> str:
    """Lines that an OCR engine reads from a scanned PDF; needs `paddleocr`."""
    import tempfile

    try:
        from paddleocr import PaddleOCR
    except ImportError as e:
        raise IngestError("reading scans needs paddleocr") from e
    with tempfile.NamedTemporaryFile(suffix=".pdf") as f:
        f.write(raw)
        f.flush()
        found = PaddleOCR(use_doc_orientation_classify=False, use_doc_unwarping=False).predict(f.name)
        return "\n".join(t for page in found for t in (page if isinstance(page, dict) else page.res)["rec_texts"])


def extract_text(name: str, raw: bytes, ocr=None, min_chars: int = MIN_CHARS_PER_PAGE) -> str:
    kind = name.lower().rpartition(".")[2]
    if kind in ("txt", "md", "markdown"):
        return raw.decode("utf-8", "replace")
    if kind == "docx":
        return docx_text(raw)
    if kind == "pdf":
        return pdf_text(raw, min_chars, ocr)
    raise IngestError(f"no reader for .{kind} files")


def document_id(raw: bytes) -> str:
    return "local-" + hashlib.sha1(raw).hexdigest()[:10]


def read_documents(spark: SparkSession, path: str, known: DataFrame | None = None, ocr=None, min_chars: int = MIN_CHARS_PER_PAGE) -> DataFrame:
    """(pmid, title, abstract, source, error) of the files below path; equal bytes once, known ids left out.

    ocr: a function of a PDF's bytes (as paddle_ocr) for those with less than min_chars characters a page.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    files = files.withColumn("pmid", F.concat(F.lit("local-"), F.substring(F.sha1("content"), 1, 10)))
    files = files.withColumn("_n", F.row_number().over(Window.partitionBy("pmid").orderBy("path"))).where("_n = 1")
    if known is not None:
        files = files.join(known.select("pmid"), "pmid", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for pmid, path, raw in zip(b["pmid"], b["path"], b["content"], strict=True):
                name = path.rpartition("/")[2]
                try:
                    out.append((pmid, name.rpartition(".")[0] or name, extract_text(name, bytes(raw), ocr, min_chars), path, None))
                except (IngestError, zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
                    out.append((pmid, name, None, path, str(e)))
            yield pd.DataFrame(out, columns=["pmid", "title", "abstract", "source", "error"])

    return files.select("pmid", "path", "content").mapInPandas(run, "pmid string, title string, abstract string, source string, error string")


def fulltext_markdown(paragraphs: DataFrame, key: str) -> DataFrame:
    """(key, markdown) from (key, ord, section, text): a heading where the section is given and changes."""
    w = Window.partitionBy(key).orderBy("ord")
    named = F.nullif("section", F.lit(""))
    before = F.last(named, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    head = named.isNotNull() & (before.isNull() | (named != before))
    line = paragraphs.withColumn("_x", F.when(head, F.concat(F.lit("## "), named, F.lit("\n\n"), "text")).otherwise(F.col("text")))
    return line.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "_x"))), lambda x: x["_x"]), "\n\n").alias("markdown"))
