"""Files to texts: dispatch by suffix, decoding, DOCX, the PDF guard, scan detection."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions.python_udfs import decode_text, nfkc

PAGE_CHARS, LEAST_CHARS, MAX_MB = 3000, 200, 5
# fixed values: the first bytes of other formats, and of a PDF
SIGNATURES = (
    (b"\x89PNG\r\n\x1a\n", "PNG picture"),
    (b"\xff\xd8\xff", "JPEG picture"),
    (b"GIF87a", "GIF picture"),
    (b"GIF89a", "GIF picture"),
    (b"BM", "bitmap picture"),
    (b"RIFF", "RIFF container, such as a WebP picture"),
    (b"II*\x00", "TIFF picture"),
    (b"MM\x00*", "TIFF picture"),
    (b"PK\x03\x04", "ZIP container, such as a DOCX file"),
    (b"\xd0\xcf\x11\xe0", "legacy Office document"),
    (b"{\\rtf", "RTF file"),
    (b"MZ", "Windows executable"),
    (b"\x7fELF", "ELF executable"),
)
PDF = "%PDF-"


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """path, content, length, modificationTime."""
    return spark.read.format("binaryFile").load(path)


def kind(path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))
    return F.when(suffix == ".pdf", "pdf").when(suffix == ".docx", "docx").when(suffix.isin(".txt", ".md"), "txt")


def pdf_problem(content: Column) -> Column:
    """Null for a PDF header within 1024 bytes, else what the file is by its first bytes."""
    named = F.lit("no PDF header")
    for sig, what in reversed(SIGNATURES):
        named = F.when(content.startswith(F.lit(sig)), F.lit(f"named .pdf, but its content is a {what}")).otherwise(named)
    head = F.decode(F.substring(content, 1, 1024), "ISO-8859-1")
    return F.when(head.contains(PDF), F.lit(None).cast("string")).otherwise(named)


def upload_error(files: DataFrame, max_mb: int = MAX_MB) -> Column:
    """Code of the first failing check: unsupported_type, empty_file, file_too_large, not_a_pdf; null if all pass."""
    k = kind(F.col("path"))
    return (
        F.when(k.isNull(), "unsupported_type").when(F.col("length") == 0, "empty_file").when(F.col("length") > max_mb * 1024 * 1024, "file_too_large")
        .when((k == "pdf") & pdf_problem(F.col("content")).isNotNull(), "not_a_pdf")
    )


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(data: bytes) -> tuple[str, int]:
    """Paragraphs outside tables, then the tables' cells; the number of cells."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    say = lambda p: "".join(t.text or "" if t.tag == f"{_W}t" else "\t" if t.tag == f"{_W}tab" else "\n" if t.tag == f"{_W}br" else "" for t in p.iter())
    out = [say(p) for p in body.findall(f"{_W}p")]
    cells = ["\n".join(say(p) for p in c.findall(f"{_W}p")) for c in body.iter(f"{_W}tc")]
    return "\n".join(x for x in [*out, *cells] if x.strip()), len(cells)


def _docx(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for path, data in zip(b.path, b.content, strict=True):
            try:
                text, cells = docx_text(bytes(data))
                rows.append((path, text, cells, None))
            except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, AttributeError) as e:
                rows.append((path, None, 0, f"corrupt document: {type(e).__name__}"))
        yield pd.DataFrame(rows, columns=["path", "raw", "cells", "error"])


def extract(files: DataFrame, pdf_text: DataFrame | None = None, max_mb: int = MAX_MB) -> DataFrame:
    """path, kind, text, n_pages, n_chars, has_tables, has_text_layer, error.

    pdf_text (path, primary, fallback, n_pages) comes from any PDF reader; the fallback serves where the primary is null or shorter than LEAST_CHARS. Both too short:
    no text layer; both null: an error. Without it every PDF has the error no_pdf_reader.
    """
    df = files.select("path", "content", "length", kind(F.col("path")).alias("kind"), upload_error(files, max_mb).alias("error"))
    txt = df.filter("error is null and kind = 'txt'").select("path", decode_text("content").alias("raw"), F.lit(0).alias("cells"), F.lit(None).cast("string").alias("e2"), F.lit(None).cast("int").alias("pages"))
    docx = df.filter("error is null and kind = 'docx'").select("path", "content").mapInPandas(_docx, "path string, raw string, cells int, error string").select("path", "raw", "cells", F.col("error").alias("e2"), F.lit(None).cast("int").alias("pages"))
    both = txt.unionByName(docx)
    if pdf_text is not None:
        best = F.when(F.length("primary") >= LEAST_CHARS, F.col("primary")).otherwise(F.coalesce(F.when(F.length("fallback") >= LEAST_CHARS, F.col("fallback")), "primary", "fallback"))
        pdf = df.filter("error is null and kind = 'pdf'").select("path").join(pdf_text, "path", "left")
        both = both.unionByName(pdf.select("path", best.alias("raw"), F.lit(0).alias("cells"), F.when(best.isNull(), "unreadable_pdf").alias("e2"), F.col("n_pages").cast("int").alias("pages")))
    out = df.drop("content").join(both, "path", "left").withColumn("text", T.clean(nfkc(F.coalesce("raw", F.lit("")))))
    error = F.coalesce("error", "e2", F.when((F.col("kind") == "pdf") & F.lit(pdf_text is None), "no_pdf_reader"))
    n = F.length("text")
    return out.select("path", "kind", "text", F.coalesce("pages", F.greatest(F.lit(1), F.floor(n / PAGE_CHARS))).cast("int").alias("n_pages"), n.alias("n_chars"), (F.coalesce("cells", F.lit(0)) > 0).alias("has_tables"), ((F.col("kind") != "pdf") | (n >= LEAST_CHARS)).alias("has_text_layer"), error.alias("error"))


def path_safe(name: str) -> str:
    return re.sub(r"[^A-Za-z0-9._-]+", "_", name)
