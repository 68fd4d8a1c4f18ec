"""Interleaved document sequences with media resolved by digest.

``parse_pages`` reads HTML into an ordered array of parts: text parts and media
references (digest, caption).  ``store_media`` keeps payloads as 8-bit grey images
(binary PGM, 24 samples a row, rows in the order of the bytes), content-addressed
by the SHA-256 of the stored form.  ``resolve`` joins the references with the
store by digest and keeps position and caption beside what the payload gives.

Payload bytes are never shuffled: what is needed of them is computed where they
are read, one row a digest, and only those small rows meet the references.  These rows
are written first, so that the join's exchanges are plain ones, and Spark can split the
partition of a digest that very many references share.

A figcaption is the caption of all media of its own figure, before or after it, and wins
over an alt text; the caption of a figure without media, or outside any figure, is a text
part at its place.  A source element gives its video or audio a digest if that has none,
and is no part of its own; in a picture the img is the part.

Cases: null HTML gives an empty sequence; an image without a digest keeps its
place with a null digest; a digest that the store lacks keeps its row with null
payload columns; repeated references and repeated stored rows give one row a
reference; unclosed tags end with the page, an unclosed figcaption with its figure;
script and style text is no text; ties and long pages are read whole; empty tables give
no rows; extra columns are ignored, or kept by ``parse_pages``, but one called parts
gives way.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialize, scratch, tidy

UNIT = 576
ROW = 24
SCHEME = "media:sha256-"
PARTS = "array<struct<position:int,kind:string,text:string,digest:string,caption:string>>"
_BLOCKS = {"p", "div", "article", "section", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "table", "tr", "td", "th", "br", "nav", "blockquote", "pre", "body", "title"}
_SILENT = {"script", "style", "template", "noscript"}
_HOLDERS = {"video", "audio"}


class _Figure:
    def __init__(self):
        self.media: list[dict] = []
        self.said: list[str] = []
        self.at = 0  # where a caption without media stands


class _Page(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[dict] = []
        self.words: list[str] = []
        self.silent = 0
        self.figures: list[_Figure] = []
        self.captioning = False
        self.holder: dict | None = None

    def _text(self) -> None:
        text = " ".join("".join(self.words).split())
        if text:
            self.parts.append({"kind": "text", "text": text, "digest": None, "caption": None})
        self.words = []

    def _media(self, attrs: dict) -> dict:
        self._text()
        src = attrs.get("src") or ""
        part = {"kind": "media", "text": None, "digest": src[len(SCHEME) :] if src.startswith(SCHEME) else None, "caption": attrs.get("alt")}
        self.parts.append(part)
        if self.figures:
            self.figures[-1].media.append(part)
        return part

    def _end_figure(self) -> None:
        self._text()
        self.captioning = False
        figure = self.figures.pop()
        said = " ".join("".join(figure.said).split())
        if said and figure.media:
            for part in figure.media:
                part["caption"] = said
        elif said:
            self.parts.insert(figure.at, {"kind": "text", "text": said, "digest": None, "caption": None})

    def handle_starttag(self, tag, attrs):
        if tag in _SILENT:
            self.silent += 1
        elif tag == "figure":
            self._text()
            self.captioning = False
            self.figures.append(_Figure())
        elif tag == "figcaption":
            self._text()
            if self.figures:
                self.captioning = True
                self.figures[-1].said.append(" ")
                self.figures[-1].at = len(self.parts)
        elif tag == "img":
            self._media(dict(attrs))
        elif tag in _HOLDERS:
            self.holder = self._media(dict(attrs))
        elif tag == "source":
            src = dict(attrs).get("src") or ""
            if self.holder is not None and self.holder["digest"] is None and src.startswith(SCHEME):
                self.holder["digest"] = src[len(SCHEME) :]
        elif tag in _BLOCKS:
            self._block()

    def handle_endtag(self, tag):
        if tag in _SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag == "figure":
            if self.figures:
                self._end_figure()
        elif tag == "figcaption":
            self._text()
            self.captioning = False
        elif tag in _HOLDERS:
            self.holder = None
        elif tag in _BLOCKS:
            self._block()

    def _block(self) -> None:
        if self.captioning:
            self.figures[-1].said.append(" ")
        else:
            self._text()

    def handle_data(self, data):
        if not self.silent:
            (self.figures[-1].said if self.captioning else self.words).append(data)


def parse(html: str | None) -> list[dict]:
    page = _Page()
    page.feed(html or "")
    page.close()
    while page.figures:
        page._end_figure()
    page._text()
    return [{"position": i} | x for i, x in enumerate(page.parts)]


#: Characters of HTML that are parsed before their parts leave the worker: as Python objects, parts are many times their page.
PARSED_CHARS = 256 << 10


def _parse_some(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The parts of each batch's pages, some pages at a time."""
    for col in batches:
        done, held = [], 0
        for html in col:
            html = html if isinstance(html, str) else None
            done.append(parse(html))
            held += len(html or "")
            if held >= PARSED_CHARS:
                yield pd.Series(done, dtype=object)
                done, held = [], 0
        if done:
            yield pd.Series(done, dtype=object)


def parse_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """All columns but ``html``, and ``parts``: text and media references in page order."""
    bounded_batches(pages.sparkSession)

    @F.pandas_udf(PARTS)
    def parts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return tidy(_parse_some)(batches)

    kept = [c for c in pages.columns if c.lower() not in (html.lower(), "parts")]
    return pages.select(*kept, parts(F.col(html)).alias("parts"))


def html_of(text, figure):
    """A text column as an article: its lines are paragraphs, ``figure`` stands behind the first."""
    safe = F.coalesce(text, F.lit(""))
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        safe = F.replace(safe, F.lit(raw), F.lit(entity))
    lines = F.split(safe, "\n")
    more = F.array_join(F.slice(lines, F.lit(2), F.greatest(F.size(lines), F.lit(1))), "</p><p>")
    return F.concat(F.lit("<article><p>"), F.get(lines, F.lit(0)), F.lit("</p>"), figure, F.lit("<p>"), more, F.lit("</p></article>"))


def image(payload):
    """The stored form of a payload column: a PGM header and the bytes as samples."""
    head = F.concat(F.lit(f"P5\n{ROW} "), (F.octet_length(payload) / ROW).cast("long").cast("string"), F.lit("\n255\n"))
    return F.concat(F.encode(head, "US-ASCII"), payload)


def padded(text):
    """UTF-8 of a text column (null: empty) with bytes 255 up to a positive multiple of UNIT."""
    raw = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    n = F.octet_length(raw)
    short = F.when(n == 0, F.lit(UNIT)).otherwise(F.pmod(-n, F.lit(UNIT)))
    return F.concat(raw, F.substring(F.lit(bytearray(b"\xff" * UNIT)), F.lit(1), short))


def store_media(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """Write payloads as images beside their rows' other columns; the table read back.

    Columns: those of ``rows`` but the payload, then ``digest`` and ``media``.
    """
    spark = rows.sparkSession
    path = scratch(spark, "media")
    kept = [c for c in rows.columns if c != payload]
    out = rows.select(*kept, image(F.col(payload)).alias("media")).withColumn("digest", F.sha2("media", 256))
    out.write.option("compression", "zstd").option("parquet.block.size", str(32 << 20)).parquet(path)
    return spark.read.schema(out.schema).parquet(path)


def decode(media: bytes) -> bytes:
    """The samples of a PGM image of this module's form."""
    magic, size, most, samples = media.split(b"\n", 3)
    w, h = map(int, size.split())
    if magic != b"P5" or most != b"255" or len(samples) != w * h:
        raise ValueError("not an 8-bit PGM image")
    return samples


FEATURES = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _features(batches):
    import hashlib
    import zlib

    import numpy as np

    for pdf in batches:
        rows = []
        for digest, media in zip(pdf["digest"], pdf["media"], strict=True):
            media = bytes(media)
            payload = decode(media)
            x = np.frombuffer(payload, np.uint8)
            edges = np.linspace(0, len(x), 65).astype(int)
            sums = np.add.reduceat(x.astype("int64"), edges[:-1])
            cells = sums / np.diff(edges)
            bits = int("".join("1" if c > cells.mean() else "0" for c in cells), 2)
            rows.append((digest, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), f"{bits:016x}-{x.mean():.4f}-{x.std():.4f}"))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in FEATURES.split(", ")])


def media_features(store: DataFrame) -> DataFrame:
    """One row a digest, from the stored bytes read back: sizes, hashes and an average-hash feature; a written table."""
    bounded_batches(store.sparkSession)
    return materialize(store.select("digest", "media").mapInPandas(tidy(_features), FEATURES).dropDuplicates(["digest"]), "features")


def resolve(sequences: DataFrame, keys: list[str], media: DataFrame) -> DataFrame:
    """A row for each part: keys, position, kind, text, digest, caption, and media's columns by digest."""
    parts = sequences.select(*keys, F.explode("parts").alias("_p")).select(*keys, "_p.*")
    return parts.join(media, "digest", "left")
