"""Documents as ``source_docs``: from tables, text files, HTML tables and binary formats by pluggable extractors."""

from __future__ import annotations

import json
import os
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import IngestionError
from ..functions.text import content_id, file_suffix, non_blank, strip
from ..registry import Registry

# Formats and their MIME types.
MIME = {".pdf": "application/pdf", ".xps": "application/vnd.ms-xpsdocument", ".epub": "application/epub+zip", ".mobi": "application/x-mobipocket-ebook", ".fb2": "application/x-fictionbook+xml", ".txt": "text/plain", ".md": "text/markdown", ".html": "text/html"}


def supports_format(path, formats: list[str]):
    """Column: the path's suffix, in any case, is one of ``formats``."""
    return file_suffix(path).isin(*formats)


def from_table(df: DataFrame, content: str, source_id: str | None = None, metadata: list[str] = (), mime_type: str = "text/plain") -> DataFrame:
    """Rows of a table as documents; ids of UUID shape, and absent ones, become content hashes."""
    i = F.col(source_id).cast("string") if source_id else F.lit(None).cast("string")
    pairs = [x for m in metadata for x in (F.lit(m), F.col(m).cast("string"))]
    meta = F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull()) if pairs else F.create_map().cast("map<string,string>")
    return df.select(content_id(i, content).alias("source_id"), F.col(content).alias("content"), meta.alias("metadata"), F.lit(mime_type).alias("mime_type"), F.lit(1).alias("page_count"))


def strip_html(html):
    """Column: text of an HTML document, by regular expressions: scripts, styles, comments and tags go."""
    text = F.regexp_replace(html, r"(?is)<(script|style|noscript)\b.*?</\1\s*>|<!--.*?-->", " ")
    text = F.regexp_replace(text, r"(?i)<(?:br|/p|/div|/li|/h[1-6]|/tr)\b[^>]*>", "\n")
    text = F.regexp_replace(text, r"(?s)<[^>]+>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return strip(F.regexp_replace(F.regexp_replace(text, r"[ \t\f\r]+", " "), r" ?\n[ \n]*", "\n"))


def from_html(df: DataFrame, html: str = "html", source_id: str = "url") -> DataFrame:
    title = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    rows = df.select(F.col(source_id).cast("string").alias("_id"), strip_html(F.col(html)).alias("content"), strip(title).alias("title"))
    return rows.select(content_id("_id", "content").alias("source_id"), "content", F.create_map(F.lit("title"), F.col("title")).alias("metadata"), F.lit("text/html").alias("mime_type"), F.lit(1).alias("page_count"))


def clean(text: str) -> str:
    """Page text as documents keep it: composed (NFC), without NUL, stripped."""
    return unicodedata.normalize("NFC", text.strip()).replace("\0", "")


def nfc(df: DataFrame, column: str) -> DataFrame:
    """``df`` with a column in normal form C; Spark has no such function, so batches pass through Python."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(column)
            texts = [None if x is None else unicodedata.normalize("NFC", x) for x in batch.column(at).to_pylist()]
            yield batch.set_column(at, column, pa.array(texts, pa.string()))

    return df.mapInArrow(run, df.schema)


#: An extractor takes the bytes of a file and gives (pages, metadata); it raises IngestionError with a reason.
Extractor = Callable[[bytes], tuple[list[str], dict[str, str]]]


def text_extractor(data: bytes) -> tuple[list[str], dict[str, str]]:
    try:
        return [data.decode("utf-8-sig")], {}
    except UnicodeDecodeError as e:
        raise IngestionError(f"not UTF-8: {e}") from e


def pdf_extractor(data: bytes) -> tuple[list[str], dict[str, str]]:
    """Pages of PDF, XPS, EPUB, MOBI and FB2 by PyMuPDF, where that package is installed."""
    try:
        import fitz
    except ImportError as e:
        raise IngestionError("this format needs the PyMuPDF package") from e
    try:
        doc = fitz.open(stream=data)
    except Exception as e:
        raise IngestionError(f"corrupt document: {e}") from e
    with doc:
        if doc.is_encrypted:
            raise IngestionError("document is encrypted")
        meta = {k: v for k, v in (doc.metadata or {}).items() if k in ("title", "author") and v}
        if toc := doc.get_toc():  # rows of level, title, page
            meta["toc"] = json.dumps([list(x[:3]) for x in toc], ensure_ascii=False)
        return [page.get_text() for page in doc], meta


EXTRACTORS: dict[str, Extractor] = {".txt": text_extractor, ".md": text_extractor} | dict.fromkeys((".pdf", ".xps", ".epub", ".mobi", ".fb2"), pdf_extractor)


def read_files(spark: SparkSession, paths: str | list[str], extractors: dict[str, Extractor] | None = None) -> DataFrame:
    """Files as source_docs with a column ``error``: null for good ones; see operators.ingest.quarantine."""
    known = dict(extractors or EXTRACTORS)
    schema = "source_id string, content string, metadata map<string,string>, mime_type string, page_count int, error string"
    arrow = pa.schema([("source_id", pa.string()), ("content", pa.string()), ("metadata", pa.map_(pa.string(), pa.string())), ("mime_type", pa.string()), ("page_count", pa.int32()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, suffix, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                row = {"source_id": None, "content": None, "metadata": [("source", path)], "mime_type": MIME.get(suffix, "application/octet-stream"), "page_count": None, "error": None}
                try:
                    if suffix not in known:
                        raise IngestionError(f"unsupported format {suffix or 'without suffix'}")
                    pages, meta = known[suffix](data)
                    text = clean("\n".join(pages))
                    if not text:
                        raise IngestionError("no text in the document")
                    row |= {"content": text, "page_count": len(pages), "metadata": [("source", path), *meta.items()]}
                except IngestionError as e:
                    row["error"] = str(e)
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    files = spark.read.format("binaryFile").load(paths).select("path", file_suffix("path").alias("suffix"), "content")
    out = files.mapInArrow(run, schema)
    return out.withColumn("source_id", F.when(F.col("error").isNull(), content_id(F.lit(None).cast("string"), "content")))


def stream_text(spark: SparkSession, folder: str, schema: str, max_files: int = 16) -> DataFrame:
    """New Parquet files of a folder as a stream; ``max_files`` a trigger is the back-pressure."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(folder)


def non_empty(df: DataFrame) -> DataFrame:
    return df.where(non_blank("content"))


def with_language(df: DataFrame, content: str = "content", out: str = "language") -> DataFrame:
    """``df`` with a language code by langdetect; "unknown" where it finds none or isn't installed."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != out), f"`{out}` string"])
    names = [c for c in df.columns if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            from langdetect import DetectorFactory, LangDetectException, detect

            DetectorFactory.seed = 0
        except ImportError:
            detect = None
        for batch in batches:
            codes = []
            for text in batch.column(batch.schema.get_field_index(content)).to_pylist():
                code = "unknown"
                if detect and text:
                    try:
                        code = detect(text)
                    except LangDetectException:
                        pass
                codes.append(code)
            yield pa.record_batch([*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array(codes, pa.string())], names=[*names, out])

    return df.mapInArrow(run, schema)


def write_files(df: DataFrame, folder: str, name: str = "name", data: str = "data") -> DataFrame:
    """Write a binary column as one file a row below a folder that all executors see; gives name and path of each.

    A file is written under a name of its own and renamed, so a task that runs again does no harm.
    """
    if not folder.startswith(("file:", "/")):
        raise ValueError("files are written to a folder that is mounted on all machines")
    root = "/" + folder.removeprefix("file:").lstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(root, exist_ok=True)
        for batch in batches:
            names, paths = batch.column(0).to_pylist(), []
            for own, raw in zip(names, batch.column(1).to_pylist(), strict=True):
                paths.append(f"{root}/{own}")
                part = f"{root}/.{own}.{os.urandom(4).hex()}"
                with open(part, "wb") as f:
                    f.write(raw or b"")
                os.replace(part, paths[-1])
            yield pa.record_batch([pa.array(names, pa.string()), pa.array(paths, pa.string())], names=["name", "path"])

    return df.select(F.col(name).cast("string"), F.col(data).cast("binary")).mapInArrow(run, "name string, path string")


#: Readers of documents (session, paths) by name; those that are registered later win.
INGESTORS = Registry("ingestor", text=read_files, fitz=read_files)
