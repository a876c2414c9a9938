"""Files of many formats as text: a binaryFile scan, parsed in Arrow batches; a file that can't be read is a FAILED row."""

from __future__ import annotations

import email
import email.policy
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchment.functions.text import is_blank, join_pages, normalize, strip_html
from parchment.operators.merge import needs_text

#: Parsers that can be plugged in by extension: bytes to text (pdf, doc, msg, or better ones for the others).
Parser = Callable[[bytes], str]
W_NS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def parse_docx(data: bytes) -> str:
    """Paragraphs and table rows in order; cells joined by ' | '."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).find(f"{W_NS}body")

    def said(node) -> str:
        marks = {f"{W_NS}t": lambda n: n.text or "", f"{W_NS}tab": lambda n: "\t", f"{W_NS}br": lambda n: "\n"}
        return "".join(marks[n.tag](n) for n in node.iter() if n.tag in marks)

    lines = []
    for node in body:
        if node.tag == f"{W_NS}p" and said(node).strip():
            lines.append(said(node).strip())
        elif node.tag == f"{W_NS}tbl":
            for row in node.iter(f"{W_NS}tr"):
                cells = [re.sub(r"\s+", " ", "\n".join(said(p) for p in cell.iter(f"{W_NS}p"))).strip() for cell in row.findall(f"{W_NS}tc")]
                lines.append(" | ".join(cells))
    return "\n".join(lines)


def parse_mail(data: bytes) -> str:
    """Headers, then every text part; HTML is marked for strip_html, attachments are named and walked too."""
    message = email.message_from_bytes(data, policy=email.policy.default)
    out = [f"{h}: {message[h]}" for h in ("From", "To", "Cc", "Subject", "Date") if message[h]] + [""]

    def walk(part) -> None:
        if part.get_filename():
            out.append(f"[附件] {part.get_filename()}")
        if part.is_multipart():
            for p in part.iter_parts():
                walk(p)
        elif part.get_content_type() == "text/plain":
            out.append(part.get_content())
        elif part.get_content_type() == "text/html":
            out.append(f"\x00html\x00{part.get_content()}\x00")

    walk(message)
    return "\n".join(out)


def parse_text(data: bytes) -> str:
    return data.decode("utf-8", "replace").removeprefix("﻿")


BUILT_IN: dict[str, Parser] = {"docx": parse_docx, "eml": parse_mail, "emlx": parse_mail}


def parse(files: DataFrame, plugins: dict[str, Parser] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """files (path, content) as path, file_name, extension, parse_status, parse_message, text_content, and the columns to keep."""
    parsers = {**BUILT_IN, **{k: None for k in ("pdf", "doc", "msg")}, **(plugins or {})}

    def over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = []
            for extension, data in zip(rows.extension, rows.content):
                parser = parsers.get(extension, parse_text)
                try:
                    if parser is None:
                        raise ValueError(f"no parser for {extension}")
                    found.append(("PARSED", "", parser(bytes(data))))
                except Exception as e:  # noqa: BLE001  a bad file must not end the job
                    found.append(("FAILED", f"{type(e).__name__}: {e}"[:300], ""))
            yield pd.DataFrame({"path": rows.path, "file_name": rows.file_name, "extension": rows.extension, "parse_status": [x[0] for x in found], "parse_message": [x[1] for x in found], "raw": [x[2] for x in found]}).assign(**{c: rows[c] for c in keep})

    named = files.select("path", *keep, F.element_at(F.split("path", "/"), -1).alias("file_name"), "content").withColumn("extension", F.lower(F.regexp_extract("file_name", r"\.([^.]*)$", 1)))
    kept = "".join(f", `{c}` {files.schema[c].dataType.simpleString()}" for c in keep)
    raw = named.mapInPandas(over, "path string, file_name string, extension string, parse_status string, parse_message string, raw string" + kept)
    pieces = F.split("raw", "\x00")
    html = F.transform(pieces, lambda p: F.when(F.startswith(p, F.lit("html")), p).otherwise(p))
    marked = F.array_join(F.transform(html, lambda p, i: F.when((i > 0) & (F.get(pieces, i - 1) == "html"), strip_html(p)).when(p == "html", "").otherwise(p)), "")
    return raw.withColumn("text_content", normalize(marked)).drop("raw")


def scan(spark: SparkSession, path: str, plugins: dict[str, Parser] | None = None) -> DataFrame:
    """All files below a folder, parsed."""
    return parse(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content"), plugins)


def seeds(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array in one file."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_pages(pages: DataFrame, recognised: DataFrame, least: int = 40) -> DataFrame:
    """pages (doc_id, page_no, text) and recognised (doc_id, page_no, text): text_content, page_count, ocr_used, parse_status of each
    document. Where a document's own text is thin, what was recognised on a page replaces the page's text unless it is empty."""
    few = thin(pages, least).where("thin").select("doc_id", F.lit(True).alias("_thin"))
    seen = recognised.where(~is_blank(F.col("text"))).select("doc_id", "page_no", F.col("text").alias("_seen")).join(few.select("doc_id"), "doc_id", "left_semi")
    both = pages.join(seen, ["doc_id", "page_no"], "left").withColumn("text", F.coalesce("_seen", normalize(F.col("text"))))
    out = both.groupBy("doc_id").agg(join_pages(F.collect_list(F.struct("page_no", "text"))).alias("text_content"), F.count("*").cast("int").alias("page_count"), F.bool_or(F.col("_seen").isNotNull()).alias("ocr_used"))
    out = out.join(few, "doc_id", "left")
    failed = F.col("_thin").isNotNull() & is_blank(F.col("text_content")) & ~F.col("ocr_used")
    return out.select("doc_id", "text_content", "page_count", "ocr_used", F.when(failed, "FAILED").otherwise("PARSED").alias("parse_status"))


def parsed_again(docs: DataFrame, files: DataFrame, plugins: dict[str, Parser] | None = None) -> DataFrame:
    """docs whose text is blank though a file is stored (storage_path) take what their file says now, if it says something."""
    again = needs_text(docs).select("storage_path").distinct()
    said = parse(files.join(again, F.col("path") == F.col("storage_path"), "left_semi"), plugins)
    said = said.where(~is_blank(F.col("text_content"))).select(F.col("path").alias("storage_path"), F.col("text_content").alias("_said"))
    both = docs.join(said, "storage_path", "left")
    new = is_blank(F.col("text_content")) & F.col("_said").isNotNull()
    taken = {"text_content": F.when(new, F.col("_said")).otherwise(F.col("text_content")), "parse_status": F.when(new, "PARSED").otherwise(F.col("parse_status"))}
    return both.select(*[taken[c].alias(c) if c in taken else F.col(c) for c in docs.columns])


def thin(pages: DataFrame, least: int = 40) -> DataFrame:
    """pages (doc_id, page_no, text): documents whose pages hold so few characters that they are read by image."""
    return pages.groupBy("doc_id").agg(F.sum(F.length(normalize(F.col("text")))).alias("chars"), F.count("*").alias("pages")).withColumn("thin", F.col("chars") < least * F.greatest(F.lit(1), F.col("pages")))
