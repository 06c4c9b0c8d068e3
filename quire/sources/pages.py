"""Page sources (S6, S7, T5-T7): bytes or markup -> page rows -> documents.

``extract_pages`` runs pluggable per-file extractors inside executors with
``mapInPandas`` (one file's bytes never leave its task); failures become
rows with an ``error`` instead of stopping the job. HTML pages also have a
native path (``html_text``) so the common case stays in the JVM, and text files
one that splits them (``text_pages``), so a large file is never one value.
"""

from __future__ import annotations

from html.parser import HTMLParser
from typing import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions import text as tx
from quire.sources.files import base_name, kind_glob, plain_path

PAGE_SCHEMA = T.StructType([
    T.StructField("source_file", T.StringType()),
    T.StructField("page_number", T.IntegerType()),
    T.StructField("page_text", T.StringType()),
    T.StructField("extractor", T.StringType()),
    T.StructField("error", T.StringType()),
])

# An extractor takes (bytes, file name) and returns page texts in order.
Extractor = Callable[[bytes, str], list[str]]

# Character references decoded by the native path, in the
# order applied (&amp; last so "&amp;lt;" stays "&lt;").
HTML_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"),
                 ("&nbsp;", " "), ("&amp;", "&")]


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Tags that begin a new line of the visible text.
LINE_TAGS = ["address", "article", "aside", "blockquote", "br", "dd", "div", "dl", "dt", "figcaption", "figure", "footer",
             "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "li", "main", "nav", "ol", "p", "pre", "section",
             "table", "td", "th", "title", "tr", "ul"]


def html_lines(c) -> Column:
    """Visible text of an HTML page with its lines: script/style blocks and comments
    dropped, block tags -> line break, other tags -> space, common character
    references decoded. Filters that work by line (T3) take this form (D5)."""
    x = F.coalesce(_c(c), F.lit(""))
    x = F.regexp_replace(x, r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->", " ")
    x = F.regexp_replace(x, rf"(?is)</?(?:{'|'.join(LINE_TAGS)})\b[^>]*>", "\n")
    x = F.regexp_replace(x, r"(?s)<[^>]*>", " ")
    for ent, ch in HTML_ENTITIES:
        x = F.replace(x, F.lit(ent), F.lit(ch))
    return x


def html_text(c) -> Column:
    """:func:`html_lines` with all white space collapsed."""
    return tx.clean_text(html_lines(c))


def url_document(url) -> Column:
    """Document key of a page URL: the URL without query and fragment."""
    return F.regexp_replace(_c(url), r"[?#].*$", "")


def url_page_number(url) -> Column:
    """``page=N`` query parameter, else 1."""
    n = F.regexp_extract(_c(url), r"[?&]page=(\d{1,9})(?:[&#]|$)", 1)
    return F.coalesce(F.when(n != "", n.cast("int")), F.lit(1))


# ---------------------------------------------------------------------------
# pluggable extractors (Python, per file, inside tasks)
# ---------------------------------------------------------------------------

class _TextParser(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self._skip = 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self._skip += 1
        elif tag in LINE_TAGS:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        if tag in LINE_TAGS:
            self.parts.append("\n")
        if tag in ("script", "style") and self._skip:
            self._skip -= 1

    def handle_data(self, data):
        if not self._skip:
            self.parts.append(data)


def html_extractor(content: bytes, name: str) -> list[str]:
    """One page per file: the visible text of an HTML document, line by line."""
    p = _TextParser()
    p.feed(content.decode("utf-8", errors="replace"))
    lines = (" ".join(x.split()) for x in "".join(p.parts).split("\n"))
    return ["\n".join(x for x in lines if x)]


def html_only(content: bytes, name: str) -> list[str]:
    """:func:`html_extractor` for content that has a tag; others are not its kind."""
    return html_extractor(content, name) if b"<" in content and b">" in content else []


def text_extractor(content: bytes, name: str) -> list[str]:
    """Plain text; form feeds separate pages."""
    return content.decode("utf-8").split("\f")


def text_pages(spark: SparkSession, paths, kind: str = "txt", page_break: str = "\f",
               max_broadcast_bytes: int = 64 << 20) -> DataFrame:
    """S6 for text files of many pages, native: rows of PAGE_SCHEMA and ``source_path``.

    Pages are what Spark's text reader splits at ``page_break``, so a file is read by as
    many tasks as it has splits, and no value is longer than a page. A page belongs to the
    split that it starts in; its number is the number of pages in the file's earlier splits
    (one row a split) and its place in its own. Those rows are broadcast within a measured
    bound and joined by shuffle beyond it.

    A page that is not UTF-8 is a row with its number, null text and an ``error``; the
    file's other pages stay. Blank pages are rows; a break at the end of a file starts no
    page. Files without bytes are not in Spark's file listing, so they give no row.
    """
    from quire.operators.topk import measured_size

    meta = F.col("_metadata")
    lines = (spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", kind_glob(kind))
             .option("lineSep", page_break).text(paths)
             .select(meta["file_path"].alias("source_path"), meta["file_block_start"].alias("at"), F.monotonically_increasing_id().alias("id"), "value"))
    split = lines.groupBy("source_path", "at").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("source_path").orderBy("at")
                             .rowsBetween(Window.unboundedPreceding, -1))
    split = split.select("source_path", "at", "first", F.coalesce(before, F.lit(0)).alias("before"))
    if measured_size(split)[1] <= max_broadcast_bytes:
        split = F.broadcast(split)
    good = F.is_valid_utf8("value")
    path = plain_path("source_path")
    return lines.join(split, ["source_path", "at"]).select(
        base_name(path).alias("source_file"),
        (F.col("before") + F.col("id") - F.col("first") + 1).cast("int").alias("page_number"),
        F.when(good, F.col("value")).alias("page_text"), F.when(good, F.lit("text")).alias("extractor"),
        F.when(~good, F.lit("text: page is not UTF-8")).alias("error"), path.alias("source_path"))


def extract_pages(files: DataFrame, extractors: Iterable[tuple[str, Extractor]],
                  content_col: str = "content", name_col: str = "source_file") -> DataFrame:
    """One row per page (1-based page numbers) from the first extractor
    that yields pages; a file no extractor reads gives one row with
    ``error`` set and null page fields. Split with ``error IS NULL``."""
    chain = list(extractors)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for content, name in zip(b[content_col], b[name_col]):
                errors = []
                pages = None
                used = None
                for ename, fn in chain:
                    try:
                        got = fn(bytes(content) if content is not None else b"", name)
                    except Exception as exc:  # noqa: BLE001 - recorded per file
                        errors.append(f"{ename}: {exc}")
                        continue
                    if got:
                        pages, used = got, ename
                        break
                if pages:
                    out += [(name, i, t, used, None) for i, t in enumerate(pages, start=1)]
                else:
                    out.append((name, None, None, None, "; ".join(errors) or "no extractor produced text"))
            yield pd.DataFrame(out, columns=[f.name for f in PAGE_SCHEMA.fields]).astype(
                {"page_number": "Int32"})

    return files.select(content_col, name_col).mapInPandas(run, PAGE_SCHEMA)


def assemble_documents(pages: DataFrame, doc_col: str = "source_file", page_col: str = "page_number",
                       text_col: str = "page_text", tie_col: str | None = None) -> DataFrame:
    """Non-blank pages of each document, trimmed, in page order,
    joined by a blank line; ``page_count`` = pages kept.

    The group is one document's pages (bounded by the document), and the
    sort happens inside the aggregate, not globally.
    """
    key = [F.col(page_col).alias("p")] + ([F.col(tie_col).alias("t")] if tie_col else [])
    kept = tx.keep_where(pages, ~tx.is_blank(text_col))
    agg = kept.groupBy(doc_col).agg(
        F.array_sort(F.collect_list(F.struct(*key, tx.strip_ws(text_col).alias("x")))).alias("_pages"),
        F.count(F.lit(1)).alias("page_count"))
    return agg.select(doc_col, F.col("page_count").cast("int").alias("page_count"),
                      F.array_join(F.transform("_pages", lambda s: s["x"]), "\n\n").alias("document_text"))


def page_records(pages: DataFrame, strategy: str = "raw", doc_col: str = "source_file",
                 page_col: str = "page_number", text_col: str = "page_text") -> DataFrame:
    """Page rows -> (source_file, page_number, raw_text).

    ``raw``: cleaned page text with a source header (T6). ``structured``: the
    nine-part monograph text from the raw page (T5, D5). Blank results drop.
    """
    if strategy == "raw":
        raw = tx.with_source_header(F.col(text_col), F.col(doc_col), F.col(page_col))
    elif strategy == "structured":
        raw = tx.structure_text(F.col(text_col), F.col(doc_col), F.col(page_col))
    else:
        raise ValueError("strategy must be 'raw' or 'structured'")
    # a generator makes each text once; as a projection it would be made anew wherever it is read
    return pages.select(doc_col, page_col, F.explode(F.filter(F.array(raw), lambda t: F.length(F.trim(t)) > 0)).alias("raw_text"))
