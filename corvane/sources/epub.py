"""EPUB books as rows: manifest items with their place in the spine, and the table of contents."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ITEMS = "book string, title string, creator string, language string, path string, media_type string, spine int, content binary"
CONTENTS = "book string, ord int, depth int, parent int, title string, href string"
_OPF, _DC, _NCX = "{http://www.idpf.org/2007/opf}", "{http://purl.org/dc/elements/1.1/}", "{http://www.daisy.org/z3986/2005/ncx/}"


def _open(data: bytes):
    z = zipfile.ZipFile(io.BytesIO(data))
    root = ElementTree.fromstring(z.read("META-INF/container.xml"))
    opf = next(e.get("full-path") for e in root.iter() if e.tag.endswith("rootfile"))
    return z, ElementTree.fromstring(z.read(opf)), posixpath.dirname(opf)


def _href(base: str, href: str) -> str:
    """Resolved against the package's folder; absolute links and the fragment stay."""
    if re.match(r"^[a-z][a-z0-9+.-]*:", href) or href.startswith("/"):
        return href
    path, mark, fragment = href.partition("#")
    return posixpath.normpath(posixpath.join(base, unquote(path))) + mark + fragment if path else href


def parse_items(data: bytes) -> list[tuple]:
    """title, creator, language, path, media_type, spine place (null if not in it) and content. Items that can't be read are skipped."""
    z, opf, base = _open(data)
    text = lambda tag: next((e.text for e in opf.iter(_DC + tag) if e.text), "")
    spine = {e.get("idref"): i for i, e in enumerate(opf.iter(_OPF + "itemref"))}  # the last place of an item counts
    out = []
    for e in opf.iter(_OPF + "item"):
        path = _href(base, e.get("href", ""))
        try:
            content = z.read(path)
        except KeyError:
            continue
        out.append((text("title"), text("creator"), text("language"), path, e.get("media-type", ""), spine.get(e.get("id")), content))
    return out


def parse_contents(data: bytes) -> list[tuple]:
    """ord, depth, parent's ord, title and href, from the NCX, else from the navigation document's first level."""
    z, opf, base = _open(data)
    items = list(opf.iter(_OPF + "item"))
    out: list[tuple] = []
    ncx = next((e for e in items if e.get("media-type") == "application/x-dtbncx+xml"), None)
    if ncx is not None:
        name = _href(base, ncx.get("href"))

        def walk(node, depth, parent):
            for p in node.findall(_NCX + "navPoint"):
                label, content = p.find(f"{_NCX}navLabel/{_NCX}text"), p.find(_NCX + "content")
                own = len(out)
                out.append((own, depth, parent, (label.text or "").strip() if label is not None else "", _href(posixpath.dirname(name), content.get("src", "")) if content is not None else ""))
                walk(p, depth + 1, own)

        nav = ElementTree.fromstring(z.read(name)).find(_NCX + "navMap")
        if nav is not None:
            walk(nav, 1, None)
    else:
        nav = next((e for e in items if "nav" in (e.get("properties") or "").split()), None)
        if nav is not None:
            name = _href(base, nav.get("href"))
            for i, (href, title) in enumerate(re.findall(r'<a\b[^>]*href="([^"]*)"[^>]*>(.*?)</a>', z.read(name).decode("utf-8", "replace"), re.S)):
                out.append((i, 1, None, re.sub("<[^>]*>", "", title).strip(), _href(posixpath.dirname(name), href)))
    return out


def _files(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).filter(F.lower("path").endswith(".epub"))
    return files.select("path", "content")


def _each(files: DataFrame, parse, schema: str) -> DataFrame:
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, data in zip(b.path, b.content):
                book = posixpath.basename(path).rpartition(".")[0]
                rows = pd.DataFrame([(book, *r) for r in parse(bytes(data))], columns=columns)
                for c in ("spine", "parent"):
                    if c in rows:
                        rows[c] = rows[c].astype("Int32")
                yield rows

    return files.mapInPandas(run, schema)


def read_books(spark: SparkSession, path: str) -> DataFrame:
    return _each(_files(spark, path), parse_items, ITEMS)


def read_contents(spark: SparkSession, path: str) -> DataFrame:
    return _each(_files(spark, path), parse_contents, CONTENTS)


def book_entries(items: DataFrame, archive: str, collection: bool = False) -> DataFrame:
    """Entries of books; chapters in the spine are front articles. In a collection paths begin with the book and titles name it."""
    name = F.regexp_replace(F.regexp_extract("path", r"([^/]*)$", 1), r"\.[^.]*$", "")
    front = F.col("spine").isNotNull() & F.col("media_type").isin("application/xhtml+xml", "text/html")
    title = F.when(front, F.concat("title", F.lit(" — "), name) if collection else name).otherwise("")
    path = F.concat("book", F.lit("/"), "path") if collection else F.col("path")
    return items.select(F.lit(archive).alias("archive"), path.alias("path"), title.alias("title"), F.col("media_type").alias("mime_type"), front.alias("is_front"), "content")


def book_catalog(items: DataFrame) -> DataFrame:
    """The catalog's JSON: an item a book with its entries counted, ordered by title."""
    per = items.groupBy("book").agg(F.first("title").alias("title"), F.first("creator").alias("creator"), F.first("language").alias("language"), F.min_by("path", "spine").alias("first"), F.count("*").alias("entries"))
    item = F.struct("title", F.col("book").alias("slug"), "creator", "language", F.concat("book", F.lit("/"), "first").alias("entry"), "entries")
    return per.agg(F.to_json(F.array_sort(F.collect_list(item))).alias("value"))
