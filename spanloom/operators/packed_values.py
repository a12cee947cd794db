"""Fields that pack several values: one row per value, in written order.

A finite-state tokenizer reads each distinct spelling once per batch. Its states are the open quote, the escape, and the depth
of brackets; delimiters count only outside quotes and brackets.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.util import lookup_rows

#: Characters that end a value outside quotes and brackets.
DELIMITERS = frozenset("|;,/&+¦\t\r\n \u00a0\u2009")
QUOTES = frozenset("\"'")
NUMBER = re.compile(r"[0-9]+")
MOST = 2**31 - 1


def tokenize(field: str | None) -> list[tuple[str, list[int]]]:
    """The (tag, numbers) of ``field`` in written order.

    Null, ``_`` and empty fields have none. ``\\x`` stands for x. A quote opens only where a tag may begin and is doubled inside.
    Numbers stand in square brackets, inside the quotes or after them, with blanks before or not. A bracket without any tag
    before it, and numbers above 2147483647, are dropped.
    """
    if field is None or field.strip() in ("", "_"):
        return []
    out: list[tuple[str, list[int]]] = []
    tag, inside, quote, depth, quoted, open_value, i, n = [], [], "", 0, False, False, 0, len(field)

    def close() -> None:
        nonlocal tag, quoted, open_value
        text = "".join(tag).strip()
        if text and (quoted or text != "_"):
            out.append((text, []))
        tag, quoted, open_value = [], False, False

    while i < n:
        c = field[i]
        if depth:  # numbers
            depth += (c == "[") - (c == "]")
            if depth:
                inside.append(c)
            else:
                if not quote:
                    close()
                    if out:
                        out[-1][1].extend(x for x in map(int, NUMBER.findall("".join(inside))) if x <= MOST)
                    inside = []
        elif c == "\\" and i + 1 < n:
            i += 1
            tag.append(field[i])
            open_value = True
        elif quote:
            if c == quote:
                if field[i + 1 : i + 2] == quote:
                    tag.append(c)
                    i += 1
                else:
                    quote = ""
                    if inside:  # its numbers were within the quotes
                        close()
                        if out:
                            out[-1][1].extend(x for x in map(int, NUMBER.findall("".join(inside))) if x <= MOST)
                        inside = []
            elif c == "[":
                depth = 1
            else:
                tag.append(c)
        elif c == "[":
            depth = 1
        elif c in QUOTES and not open_value:
            quote, quoted, open_value = c, True, True
        elif c in DELIMITERS:
            close()
        else:
            tag.append(c)
            open_value = True
        i += 1
    close()
    return out


def values_of(field: str | None, spelling: dict[str, str]) -> list[tuple[str, int]]:
    """The (tag, disambiguation id) of ``field``, a tag with several numbers several times, 0 for none."""
    return [(spelling.get(tag.lower(), tag), x) for tag, numbers in tokenize(field) for x in numbers or [0]]


def split_packed(df: DataFrame, key: str, field: str, tags: DataFrame, least: int = 1) -> DataFrame:
    """(key, pos, tag, disambiguation_id): one row for each value of ``field`` in rows with ``least`` values or more.

    ``tags`` is the fixed table of known tags; values take its spelling, unknown ones keep their own. Rows without a value give
    no row, repeated rows give theirs again, other columns of ``df`` are not carried over. One pass, no shuffle.
    """
    spelling = {r[0].lower(): r[0] for r in lookup_rows(tags.select("tag").where("tag is not null"))}
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = batch.column(1).dictionary_encode()
            read = [values_of(x, spelling) for x in coded.dictionary.to_pylist()]
            read = [x if len(x) >= least else [] for x in read]
            code = coded.indices.to_numpy(zero_copy_only=False)
            size = np.array([len(x) for x in read], np.int64)
            first = np.concatenate(([0], np.cumsum(size)[:-1])) if len(size) else size
            n = size[code] if len(size) else np.zeros(0, np.int64)
            rows = np.repeat(np.arange(len(code)), n)
            pos = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
            flat = (np.repeat(first[code], n) if len(size) else rows) + pos
            tag = pa.array([t for x in read for t, _ in x], pa.string())
            number = np.array([i for x in read for _, i in x], np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(pos + 1, pa.int32()), tag.take(pa.array(flat)), pa.array(number[flat], pa.int32())], names=["__key", "pos", "tag", "disambiguation_id"])

    rows = df.select(F.col(key), F.col(field)).where(F.col(field).isNotNull() & (F.trim(F.col(field)) != "_"))
    return rows.mapInArrow(run, f"__key {kind}, pos int, tag string, disambiguation_id int").withColumnRenamed("__key", key)
