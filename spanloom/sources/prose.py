"""Prose paragraphs of one language out of XML books."""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame

#: Attributes of a div that mark it as no prose.
TYPE_MARKS = ("ebook-type", "wpg-type")
SCHEMA = "ord int, is_prose boolean, lang string, text string"


def _paragraphs(xml: str, lang: str) -> list[tuple[int, bool, str, str]]:
    """(order, is_prose, lang, text) of every p: no prose below a marked div; its own lang, else that of the nearest div or root."""
    out: list[tuple[int, bool, str, str]] = []
    try:
        root = ElementTree.fromstring(xml)
    except ElementTree.ParseError:
        return out
    stack = [(root, True, lang)]
    while stack:
        node, prose, tongue = stack.pop()
        tongue = node.get("lang", tongue) if node.tag in ("div", "p") or node is root else tongue
        if node.tag == "div" and any(m in node.attrib for m in TYPE_MARKS):
            prose = False
        if node.tag == "p":
            out.append((len(out), prose, tongue, " ".join("".join(node.itertext()).split())))
        stack.extend((child, prose, tongue) for child in reversed(node))
    return out


def paragraphs(books: DataFrame, key: str, xml: str, lang: str = "nl") -> DataFrame:
    """(key, ord, is_prose, lang, text) of the paragraphs of each book, ``lang`` where none is named. Books that aren't XML, and null, have none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(k, *p) for k, x in zip(frame[key], frame[xml]) for p in (_paragraphs(x, lang) if x else [])]
            yield pd.DataFrame(rows, columns=[key, "ord", "is_prose", "lang", "text"])

    return books.select(key, xml).mapInPandas(run, f"{key} {books.schema[key].dataType.simpleString()}, {SCHEMA}")


def prose_of(paragraph_rows: DataFrame, key: str, lang: str = "nl") -> DataFrame:
    """(key, ord, text): the prose of ``lang``, equal paragraphs of a book once, at their first place, empty ones left out."""
    from pyspark.sql import functions as F

    kept = paragraph_rows.where(F.col("is_prose") & (F.col("lang") == lang) & (F.col("text") != ""))
    return kept.groupBy(key, "text").agg(F.min("ord").alias("ord")).select(key, "ord", "text")
