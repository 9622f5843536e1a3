"""Figures: header dimensions of images, figures of XML and HTML articles, and providers in order."""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dimensions(data: bytes) -> tuple[int, int] | None:
    """(width, height) from the header of a PNG, GIF, JPEG, WebP or SVG file."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return struct.unpack(">II", data[16:24])
    if data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 10:
        return struct.unpack("<HH", data[6:10])
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 <= len(data):
            if data[at] != 0xFF:
                return None
            kind = data[at + 1]
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", data[at + 5 : at + 9])
                return w, h
            at += 1 if kind == 0xFF else 2 if 0xD0 <= kind <= 0xD9 or kind == 1 else 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
        return None
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP" and len(data) >= 30:
        kind = data[12:16]
        if kind == b"VP8X":
            return 1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little")
        if kind == b"VP8 " and data[23:26] == b"\x9d\x01\x2a":
            w, h = struct.unpack("<HH", data[26:30])
            return w & 0x3FFF, h & 0x3FFF
        if kind == b"VP8L" and data[20] == 0x2F:
            bits = int.from_bytes(data[21:25], "little")
            return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
        return None
    head = data[:4096].decode("utf-8", "replace")
    if tag := re.search(r"<svg\b[^>]*>", head, re.I):
        size = {k.lower(): float(v) for k, v in re.findall(r"\b(width|height)\s*=\s*[\"']\s*([0-9.]+)(?:px)?\s*[\"']", tag[0], re.I)}
        if len(size) == 2:
            return int(size["width"]), int(size["height"])
        if box := re.search(r"viewBox\s*=\s*[\"']\s*[-0-9.]+[\s,]+[-0-9.]+[\s,]+([0-9.]+)[\s,]+([0-9.]+)", tag[0], re.I):
            return int(float(box[1])), int(float(box[2]))
    return None


def image_sizes(files: DataFrame, content: str = "content") -> DataFrame:
    """adds width and height (null if unknown) to rows of the binaryFile source."""

    @F.pandas_udf("struct<width:int,height:int>")
    def size(data: pd.Series) -> pd.DataFrame:
        got = [dimensions(x or b"") or (None, None) for x in data]
        return pd.DataFrame(got, columns=["width", "height"]).astype("Int32")

    return files.withColumn("_s", size(content)).select(*files.columns, "_s.width", "_s.height")


def xml_figures(xml: Column) -> Column:
    """(label, caption, href) of the figures of a JATS article, in order."""
    return F.transform(
        F.regexp_extract_all(F.regexp_replace(xml, r"\s+", " "), F.lit(r"(?s)<fig[\s>].*?</fig>"), 0),
        lambda f: F.struct(
            F.regexp_extract(f, r"<label>(.*?)</label>", 1).alias("label"),
            F.btrim(F.regexp_replace(F.regexp_extract(f, r"(?s)<caption.*?>(.*?)</caption>", 1), r"<[^>]+>", "")).alias("caption"),
            F.regexp_extract(f, r"<graphic[^>]*?href=\"([^\"]+)\"", 1).alias("href"),
        ),
    )


class _Figures(HTMLParser):
    def __init__(self):
        super().__init__()
        self.found: list[dict] = []
        self.open: dict | None = None
        self.caption = False

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "figure":
            self.open = {"src": "", "alt": "", "caption": ""}
        elif self.open is not None and tag == "img" and not self.open["src"]:
            self.open |= {"src": a.get("src") or "", "alt": a.get("alt") or ""}
        elif tag == "figcaption":
            self.caption = True

    def handle_endtag(self, tag):
        if tag == "figcaption":
            self.caption = False
        elif tag == "figure" and self.open is not None:
            self.open["caption"] = " ".join(self.open["caption"].split())
            self.found.append(self.open)
            self.open = None

    def handle_data(self, data):
        if self.caption and self.open is not None:
            self.open["caption"] += data


FIGURES = "array<struct<src:string,alt:string,caption:string>>"


def html_figures(df: DataFrame, html: str, out: str = "figures") -> DataFrame:
    """figures of HTML articles: those with a caption first, then in order of the page."""

    @F.pandas_udf(FIGURES)
    def figures(pages: pd.Series) -> pd.Series:
        def one(page: str | None) -> list[dict]:
            p = _Figures()
            p.feed(page or "")
            return sorted((f for f in p.found if f["src"]), key=lambda f: not f["caption"])

        return pages.map(one)

    return df.withColumn(out, figures(html))


def resolve_visuals(papers: DataFrame, providers: list[Callable[[dict], dict | None]], schema: str) -> DataFrame:
    """Each paper's record of the first provider that has one; without one not_found."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for row in b.to_dict("records"):
                got = next((r for r in (p(row) for p in providers) if r), {"status": "not_found"})
                out.append({"key": row["key"], **got})
            yield pd.DataFrame(out, columns=[f.split()[0] for f in schema.split(", ")])

    return papers.mapInPandas(run, schema)
