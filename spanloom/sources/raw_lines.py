"""Annotation lines: the readable records, and the others with the reason.

Structural indexing. Each Arrow batch is taken as one byte buffer. Masks of quotes and tabs are made for all lines at once,
the parity of each run of quotes says whether it closes a column, and binary search over those masks gives every column's
end. Counts and types are checked on the columns thus cut, so no line is walked in Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.arrow import cut, string_buffer

QUOTE, TAB, HASH = 34, 9, 35
COLUMNS = 5
#: Lines with more columns than this are finished one by one, so that one line of tabs doesn't hold up its batch.
ROUNDS = 16
MOST = 2**31 - 1
PAIR = r"\A0*(?P<a>[0-9]{1,10})-0*(?P<b>[0-9]{1,10})\z"
PARSED = "reason string, sent_idx int, token_idx int, char_start int, char_end int, token string, labels string, rest string"


def _rest_breaks(line: bytes) -> bool:
    """Whether quoting is broken in ``line``, which starts at a column."""
    at = 0
    while at <= len(line):
        if line[at : at + 1] == b'"':
            at += 1
            while True:
                at = line.find(b'"', at)
                if at < 0:
                    return True
                if line[at + 1 : at + 2] != b'"':
                    break
                at += 2
            at += 1
            if at < len(line) and line[at] != TAB:
                return True
        else:
            at = line.find(b"\t", at)
            if at < 0:
                return False
        at += 1
    return False


def _structure(data: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Of each line: whether its quoting is broken, its number of columns (COLUMNS + 1: more), and begin, end and quotedness of the first columns."""
    n = len(start)
    tabs, quotes = np.flatnonzero(data == TAB), np.flatnonzero(data == QUOTE)
    new = np.ones(len(quotes), bool)
    new[1:] = (np.diff(quotes) != 1) | np.isin(quotes[1:], start)
    run = np.cumsum(new) - 1  # of each quote
    run_begin = quotes[new]
    run_end = run_begin + np.bincount(run, minlength=len(run_begin)) if len(quotes) else run_begin
    odd = (run_end - run_begin) % 2 == 1
    odd_begin, odd_end = run_begin[odd], run_end[odd]
    begin, stop, quoted = np.zeros((COLUMNS, n), np.int64), np.zeros((COLUMNS, n), np.int64), np.zeros((COLUMNS, n), bool)
    broken, count = np.zeros(n, bool), np.zeros(n, np.int64)
    at, rows, k = start.copy(), np.arange(n), 0
    padded = np.append(data, 0)
    tabs, odd_begin, odd_end = np.append(tabs, len(data) + 1), np.append(odd_begin, len(data) + 1), np.append(odd_end, len(data) + 1)
    while len(rows):
        p, last = at[rows], end[rows]
        if k > ROUNDS:
            for r in rows:
                broken[r] = _rest_breaks(data[at[r] : end[r]].tobytes())
            count[rows] = COLUMNS + 1
            break
        opens = (p < last) & (padded[p] == QUOTE)
        e = np.minimum(tabs[np.searchsorted(tabs, p)], last)
        bad = np.zeros(len(rows), bool)
        if opens.any():
            o = p[opens]
            own = run[np.searchsorted(quotes, o)]
            closes = (run_end[own] - (o + 1)) % 2 == 1
            at_odd = np.searchsorted(odd_begin, run_end[own])
            close = np.where(closes, run_end[own], odd_end[at_odd])
            unclosed = close > last[opens]
            close = np.minimum(close, last[opens])
            bad[opens] = unclosed | ((close < last[opens]) & (padded[close] != TAB))
            e[opens] = close
        if k < COLUMNS:
            begin[k, rows], stop[k, rows], quoted[k, rows] = p, e, opens
        broken[rows[bad]] = True
        k += 1
        count[rows] = min(k, COLUMNS + 1)
        more = ~bad & (e < last)
        rows = rows[more]
        at[rows] = e[more] + 1
    return broken, count, begin, stop, quoted


def _pair(column: pa.Array, least: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    found = pc.extract_regex(column, PAIR)
    a, b = (pc.fill_null(pc.cast(pc.struct_field(found, x), pa.int64()), -1).to_numpy(zero_copy_only=False) for x in "ab")
    return (a >= least[0]) & (b >= least[1]) & (a <= MOST) & (b <= MOST), a, b


def _parse(lines: pa.Array) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """Rows of ``lines`` that are records, and what they parse to."""
    data, offsets = string_buffer(lines)
    start, end = offsets[:-1], offsets[1:]
    inked = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~(np.isin(data, (9, 10, 11, 12, 13, 32))), out=inked[1:])
    record = inked[end] > inked[start]
    record &= np.append(data, 0)[np.minimum(start, len(data))] != HASH
    rows = np.flatnonzero(record)
    start, end = start[rows], end[rows]
    broken, count, begin, stop, quoted = _structure(data, start, end)
    whole = ~broken & (count == COLUMNS)
    # the columns of lines that are whole; others have empty ones
    column = []
    for k in range(COLUMNS):
        s = np.where(whole, begin[k] + quoted[k], 0)
        e = np.where(whole, stop[k] - quoted[k], 0)
        text = cut(data, s, np.maximum(s, e))
        if (inner := quoted[k] & whole).any():
            text = pc.if_else(pa.array(inner), pc.replace_substring(text, '""', '"'), text)
        column.append(text)
    sent_ok, s, t = _pair(column[0], (1, 1))
    chars_ok, a, b = _pair(column[1], (0, 0))
    chars_ok &= (a < b) & (b - a == pc.utf8_length(column[2]).to_numpy(zero_copy_only=False))
    reason = np.select([broken, count != COLUMNS, ~sent_ok, ~chars_ok], ["quoting", "columns", "sent_token", "char_range"], "")
    good = reason == ""
    out = {"reason": pa.array(np.where(good, None, reason), pa.string())}
    for name, x in (("sent_idx", s), ("token_idx", t), ("char_start", a), ("char_end", b)):
        out[name] = pa.array(np.where(good, x, 0).astype(np.int32), mask=~good)
    for name, k in (("token", 2), ("labels", 3), ("rest", 4)):
        out[name] = pc.if_else(pa.array(good), column[k], pa.scalar(None, pa.large_string())).cast(pa.string())
    return rows, out


def parse_lines(df: DataFrame, key: str = "line_id", line: str = "line") -> DataFrame:
    """One row per record of ``df``: its key, ``reason`` (null if it is valid) and the parsed columns (null if it isn't).

    Null, blank and ``#`` lines are no records. Other columns of ``df`` are not carried over, so none can clash. Repeated keys
    stay repeated; an empty table gives an empty result. One pass, no shuffle.
    """
    names = [x.split()[0] for x in PARSED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out = _parse(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), *(out[n] for n in names)], names=["__key", *names])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key), F.col(line)).mapInArrow(run, f"__key {kind}, {PARSED}").withColumnRenamed("__key", key)


def readable(parsed: DataFrame) -> DataFrame:
    """The rows of the valid records."""
    return parsed.where("reason is null").drop("reason")


def unreadable(parsed: DataFrame, key: str = "line_id") -> DataFrame:
    """Key and reason of the records that can't be loaded."""
    return parsed.where("reason is not null").select(key, "reason")
