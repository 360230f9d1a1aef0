"""File sources: type detection, digests, block rows from DOCX and HTML files."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCKS = "document_id long, pos int, kind string, level int, text string, rows array<array<string>>, page int"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_MAX_HEADING = 40


def read_binary(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, length, modificationTime, content of files anywhere Spark can read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def _has_docx_part(content: Column) -> Column:
    """Whether a zip file holds a word document (an Arrow function, made when it is used)."""

    @F.pandas_udf("boolean")
    def holds(parts: pd.Series) -> pd.Series:
        def look(raw) -> bool:
            try:
                return "word/document.xml" in zipfile.ZipFile(io.BytesIO(raw)).namelist()
            except (zipfile.BadZipFile, OSError, ValueError, TypeError):
                return False

        return parts.map(look)

    return holds(content)


def file_type(path: Column, content: Column) -> Column:
    """By magic bytes, then extension: pdf, docx, doc, html, txt, else null.  Only zip files are opened."""
    head = F.hex(F.substring(content, 1, 8))
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    is_text = F.is_valid_utf8(F.substring(content, 1, 1024).cast("string")) if hasattr(F, "is_valid_utf8") else F.lit(True)
    return (
        F.when(head.startswith("25504446"), "pdf")
        .when(head.startswith("504B0304"), F.when(_has_docx_part(content), F.lit("docx")))
        .when(head.startswith("D0CF11E0A1B11AE1"), "doc")
        .when(ext.isin("pdf", "docx", "doc", "html"), ext)
        .when(ext.isin("htm"), "html")
        .when(ext.isin("txt", "md") & is_text, "txt")
    )


def inspect_files(files: DataFrame) -> DataFrame:
    """path, size, file_type, md5, sha256."""
    return files.select("path", F.col("length").alias("size"), file_type(F.col("path"), F.col("content")).alias("file_type"), F.md5("content").alias("md5"), F.sha2("content", 256).alias("sha256"))


def resolve_location(key: Column, base: str, bucket: str | None = None) -> Column:
    """Where a stored file lies: URLs and absolute paths as they are, bucket keys under s3a, others under base."""
    return (
        F.when(key.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://"), key)
        .when(key.startswith("/"), key)
        .otherwise(F.concat(F.lit(f"s3a://{bucket}/" if bucket else base.rstrip("/") + "/"), key))
    )


def docx_blocks(raw: bytes) -> list[tuple]:
    """(kind, level, text, rows) in body order; headings by style level; blank paragraphs are dropped."""
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(raw)).read("word/document.xml"))
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t"))
    out = []
    body = root.find(f"{_W}body")
    for e in body if body is not None else ():
        if e.tag == f"{_W}tbl":
            cells = lambda r: ["\n".join(filter(None, (text(p).strip() for p in c.iter(f"{_W}p")))) for c in r.findall(f"{_W}tc")]
            out.append(("table", None, "", [cells(r) for r in e.findall(f"{_W}tr")]))
        elif e.tag == f"{_W}p":
            words = text(e).strip()
            if not words:
                continue
            props = e.find(f"{_W}pPr")
            style = props.find(f"{_W}pStyle") if props is not None else None
            name = (style.get(f"{_W}val") if style is not None else "") or ""
            if name.lower().startswith("heading") or name.lower() == "title":
                digits = [c for c in name if c.isdigit()]
                out.append(("heading", int(digits[0]) if digits else 1, words, None))
            elif props is not None and props.find(f"{_W}numPr") is not None:
                out.append(("list", None, words, None))
            else:
                out.append(("paragraph", None, words, None))
    return out


_HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
#: Elements that begin and end a block; text in none of them is a paragraph of its own.
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()) | set(_HEADINGS)
_NO_TEXT = frozenset("script style title template noscript".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Html(HTMLParser):
    """All text of a page as blocks: headings, list items, tables with their cells, and paragraphs for the rest."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.open, self.text, self.skip = [], [], [], 0
        self.tables, self.rows = 0, []  # a table in a table gives its text to the cell

    def flush(self):
        raw, self.text = "".join(self.text), []
        words = raw.strip("\r\n").rstrip() if "pre" in self.open else " ".join(raw.split())
        if not words.strip():
            return
        if self.tables and self.rows and self.rows[-1]:
            cell = self.rows[-1]
            cell[-1] = f"{cell[-1]}\n{words}" if cell[-1] else words
            return
        kind = next((t for t in reversed(self.open) if t in _HEADINGS or t in ("li", "table")), None)
        if kind in _HEADINGS:
            self.out.append(("heading", int(kind[1]), words, None))
        else:
            self.out.append(("list" if kind == "li" else "paragraph", None, words, None))

    def handle_starttag(self, tag, attrs):
        if tag in _NO_TEXT:
            self.skip += 1
        if tag == "br":
            self.text.append("\n" if "pre" in self.open else " ")
        if tag not in _BLOCK:
            return
        self.flush()
        if tag in ("p", *_HEADINGS) or (tag == "li" and "li" in self.open and not {"ul", "ol"} & set(self.open[len(self.open) - self.open[::-1].index("li") :])):
            self.leave("li" if tag == "li" else "p")
        if tag == "table":
            self.tables += 1
        elif tag == "tr" and self.tables == 1:
            self.rows.append([])
        elif tag in ("td", "th") and self.tables == 1:
            if not self.rows:
                self.rows.append([])
            self.rows[-1].append("")
        if tag not in _VOID:
            self.open.append(tag)

    def leave(self, tag):
        if tag in self.open:
            del self.open[len(self.open) - 1 - self.open[::-1].index(tag) :]

    def handle_endtag(self, tag):
        if tag in _NO_TEXT:
            self.skip = max(0, self.skip - 1)
        if tag not in _BLOCK:
            return
        self.flush()
        self.leave(tag)
        if tag == "table" and self.tables:
            self.tables -= 1
            if not self.tables:
                self.end_table()

    def end_table(self):
        rows, self.rows = [r for r in self.rows if r], []
        if rows:
            self.out.append(("table", None, "", rows))

    def handle_data(self, data):
        if not self.skip:
            self.text.append(data)

    def close_all(self):
        """The end of a page, which may be broken off."""
        HTMLParser.close(self)
        self.flush()
        self.end_table()


def html_blocks(source: str) -> list[tuple]:
    """(kind, level, text, rows) of the whole page; no text outside scripts, styles and the like is left out."""
    parser = _Html()
    parser.feed(source)
    parser.close_all()
    return parser.out


def text_blocks(source: str) -> list[tuple]:
    """Paragraphs of a plain text, parted by blank lines."""
    parts = ("\n".join(x.rstrip() for x in p.splitlines()).strip("\n") for p in re.split(r"\n[ \t\r\f\v]*\n", source))
    return [("paragraph", None, p, None) for p in parts if p.strip()]


PARSERS = {"docx": docx_blocks, "html": lambda raw: html_blocks(raw.decode("utf-8", "replace")), "txt": lambda raw: text_blocks(raw.decode("utf-8", "replace"))}


def blocks_of(kind: str | None, raw: bytes | None) -> list[tuple]:
    """A file's blocks; one of kind 'error' with the reason where it can't be read, whatever its parser met."""
    parser = PARSERS.get(kind)
    if parser is None or raw is None:
        return [("error", None, "no parser" if parser is None else "no content", None)]
    try:
        return parser(bytes(raw))
    except Exception as e:
        return [("error", None, f"{type(e).__name__}: {e}", None)]


def parse_blocks(files: DataFrame) -> DataFrame:
    """Block rows of files(document_id, file_type, content).

    A file that its parser can't read, or whose type has none, or without content, is one row of kind
    'error' with the reason as text; the other files are not touched.  Further parsers (PDF, OCR, DOC)
    are functions bytes -> blocks added to PARSERS.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for doc, kind, raw in zip(frame["document_id"], frame["file_type"], frame["content"], strict=True):
                for pos, (k, level, text, rows) in enumerate(blocks_of(kind, raw)):
                    out.append((doc, pos, k, level, text, rows, 0))
            made = pd.DataFrame(out, columns=["document_id", "pos", "kind", "level", "text", "rows", "page"])
            yield made.astype({"level": "Int32"})

    return files.select("document_id", "file_type", "content").mapInPandas(run, BLOCKS)


def heading_by_style(size: Column, bold: Column, text: Column) -> Column:
    """Level of a printed line by font: large and short is 1, bold and short is 2, else null."""
    return F.when((size >= 16) & (F.length(text) <= 60), 1).when(bold & (F.length(text) <= _MAX_HEADING), 2)


def reading_order(x: Column, y: Column, band: int = 20) -> list[Column]:
    """Order of recognised boxes: by line band (halves go to the even band), then from left to right."""
    return [F.bround(y / band), x]
