"""Documents as tables: pages with what they draw, lines of text, fonts, and translated files to write.

A file is read by the task that holds it, a page at a time; a page is one row with arrays, so nothing is
shuffled until rows of one kind are wanted. What can't be read gives no rows and is listed by
``unreadable``.
"""

from __future__ import annotations

import os
import re
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.functions.text import stem
from papyra.sources.pdf import Pdf, Reader, residual, translated

ITEMS = "array<struct<container:int,kind:string,text:string,x0:double,y0:double,x1:double,y1:double,size:double,font:string,m0:double,m3:double,color:array<double>,cid:int,seqno:int>>"
SPANS = "array<struct<seqno:int,x0:double,y0:double,x1:double,y1:double,font:string,size:double,n_chars:int,type:int,text:string>>"
FILLS = "array<struct<seqno:int,x0:double,y0:double,x1:double,y1:double,fill:array<double>,opacity:double>>"
IMAGES = "array<struct<seqno:int,x0:double,y0:double,x1:double,y1:double>>"
ANNOTS = "array<struct<type:string,x0:double,y0:double,x1:double,y1:double,dashes:array<double>,width:double,stroke:array<double>,kind:string,uri:string,dest_page:int>>"
OPERATORS = "array<struct<seq:int,name:string,args:array<struct<text:string,real:boolean>>>>"
PAGES = f"doc string, page int, page_width double, page_height double, items {ITEMS}, spans {SPANS}, fills {FILLS}, images {IMAGES}, annots {ANNOTS}, operators {OPERATORS}"
NAMES = [c.split()[0] for c in re.split(r", (?=\w+ )", PAGES)]


class PdfReader:
    """The ``DocumentReader`` of PDF files: glyphs and lines, a tuple each, of the wanted pages."""

    def glyphs(self, doc: str, content: bytes, pages: list[int] | None) -> Iterator[tuple]:
        for i, (_, page) in enumerate(pdf.pages if (pdf := _opened(content)) else []):
            if pages is None or i in pages:
                r = Reader(pdf, page)
                for seq, g in enumerate(r.items):
                    yield doc, i, g["container"], seq, g["kind"], g["text"], g["x0"], g["y0"], g["x1"], g["y1"], g["size"], g["font"], g["m0"], g["m3"], r.width, r.height


def _opened(content) -> Pdf | None:
    try:
        return Pdf(bytes(content))
    except (ValueError, KeyError, TypeError, AttributeError, IndexError, RecursionError):
        return None


def _mapped(files: DataFrame, rows: Callable[[str, Pdf | None], Iterator[tuple]], schema: str, names: list[str]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                found = list(rows(path, _opened(content) if content is not None else None))
                yield pd.DataFrame(found, columns=names)

    return files.select("path", "content").mapInPandas(run, schema)


def read_pages(files: DataFrame, pages: list[int] | None = None) -> DataFrame:
    """A row for each page of files (path, content), or of the wanted pages only: its size and all it draws, in order."""
    wanted = set(pages) if pages else None

    def rows(path: str, pdf: Pdf | None) -> Iterator[tuple]:
        for i, (_, page) in enumerate(pdf.pages if pdf else []):
            if wanted is None or i in wanted:
                r = Reader(pdf, page)
                yield path, i, r.width, r.height, r.items, r.spans, r.fills, r.images, list(pdf.annotations(page)), residual(r)

    return _mapped(files, rows, PAGES, NAMES)


def documents(files: DataFrame) -> DataFrame:
    """doc, pages, title of the files that can be read."""
    return _mapped(files, lambda path, pdf: iter([(path, len(pdf.pages), pdf.title())] if pdf and pdf.pages else []), "doc string, pages int, title string", ["doc", "pages", "title"])


def unreadable(files: DataFrame) -> DataFrame:
    """path of the files that are no documents, or hold no page."""
    return _mapped(files, lambda path, pdf: iter([] if pdf and pdf.pages else [(path,)]), "path string", ["path"])


def embedded_fonts(files: DataFrame) -> DataFrame:
    """doc, font, kind, file of the fonts that documents carry with them."""
    return _mapped(files, lambda path, pdf: iter([(path, *f) for f in pdf.fonts()] if pdf else []), "doc string, font string, kind string, file binary", ["doc", "font", "kind", "file"])


def rows(pages: DataFrame, kind: str) -> DataFrame:
    """Rows of one of the arrays: items, spans, fills, images, annots or operators."""
    return pages.select("doc", "page", F.inline(kind))


def text_lines(pages: DataFrame) -> DataFrame:
    """doc, page, y0, y1, x0, x1, fonts, text: spans that stand on one height, from left to right."""
    one = F.struct("x0", "x1", "y1", "font", "text")
    line = rows(pages, "spans").groupBy("doc", "page", F.bround("y0", 1).alias("y0")).agg(F.array_sort(F.collect_list(one)).alias("s"))
    get = lambda c: F.transform("s", lambda s: s[c])
    return line.select("doc", "page", "y0", F.array_max(get("y1")).alias("y1"), F.array_min(get("x0")).alias("x0"), F.array_max(get("x1")).alias("x1"), F.array_distinct(get("font")).alias("fonts"), F.array_join(get("text"), "").alias("text"))


def image_cover(pages: DataFrame) -> DataFrame:
    """doc, page, image_area, page_area, page_chars, as ``detect.scanned`` reads them."""
    area = F.aggregate("images", F.lit(0.0), lambda a, i: a + (i["x1"] - i["x0"]) * (i["y1"] - i["y0"]))
    chars = F.aggregate("spans", F.lit(0), lambda n, s: n + s["n_chars"])
    return pages.select("doc", "page", area.alias("image_area"), (F.col("page_width") * F.col("page_height")).alias("page_area"), chars.alias("page_chars"))


def links(pages: DataFrame) -> DataFrame:
    return rows(pages, "annots").where("type = 'Link'").drop("dashes", "width", "stroke")


def translated_files(files: DataFrame, streams: DataFrame, fonts: dict[str, dict] | None = None) -> DataFrame:
    """doc, kind, name, content: mono and dual documents of files, given new contents (doc, page, stream) of their pages."""
    given = streams.groupBy("doc").agg(F.collect_list(F.struct("page", "stream")).alias("streams"))
    both = files.select(F.col("path").alias("doc"), "content").join(given, "doc", "left").select("doc", stem(F.col("doc")).alias("stem"), "content", "streams")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, name, content, some in zip(batch["doc"], batch["stem"], batch["content"], batch["streams"], strict=True):
                if (pdf := _opened(content)) and pdf.pages:
                    made = translated(pdf, {s["page"]: s["stream"].encode("latin-1") for s in (some if some is not None else [])}, fonts)
                    out += [(doc, kind, f"{name}-{kind}.pdf", data) for kind, data in zip(("mono", "dual"), made, strict=True)]
            yield pd.DataFrame(out, columns=["doc", "kind", "name", "content"])

    return both.mapInPandas(run, "doc string, kind string, name string, content binary")


def write_files(files: DataFrame, folder: str) -> int:
    """Write (name, content) into a folder that all executors share, a file whole or not at all; how many."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            for name, content in zip(batch["name"], batch["content"], strict=True):
                part = os.path.join(folder, f".{os.path.basename(name)}.{os.getpid()}")
                with open(part, "wb") as f:
                    f.write(bytes(content))
                os.replace(part, os.path.join(folder, os.path.basename(name)))
            yield pd.DataFrame({"n": [len(batch)]})

    return files.select("name", "content").mapInPandas(write, "n long").agg(F.sum("n")).first()[0] or 0


def fetch(url: str, most: int | None = None, timeout: float = 10.0, chunk: int = 1024) -> tuple[str, bytes]:
    """Name and bytes of a file on the web; an answer that is no 200, or is longer than ``most``, is an error."""
    with urllib.request.urlopen(url, timeout=timeout) as answer:  # raises where the server refuses
        if getattr(answer, "status", 200) not in (200, None):
            raise OSError(f"{url} answered {answer.status}")
        told = re.search(r'filename="?([^";]+)', answer.headers.get("Content-Disposition") or "")
        name = os.path.basename(told[1] if told else url.split("?")[0].rstrip("/")) or "download"
        out = bytearray()
        while part := answer.read(chunk):
            out += part
            if most is not None and len(out) > most:
                raise OSError(f"{url} is longer than {most} bytes")
        return name, bytes(out)


def fetch_files(urls: DataFrame, most: int | None = None) -> DataFrame:
    """path, name, content, error of addresses (url); one that fails gives its error and no content."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for url in batch["url"]:
                try:
                    out.append((url, *fetch(url, most), None))
                except (OSError, ValueError) as e:
                    out.append((url, None, None, str(e)))
            yield pd.DataFrame(out, columns=["path", "name", "content", "error"])

    return urls.select("url").mapInPandas(run, "path string, name string, content binary, error string")
