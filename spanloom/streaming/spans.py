"""Spans out of a stream of labelled tokens.

State is one sentence: its tokens wait until the watermark has passed the sentence's last token by a given time; then its spans are sent
and the state is dropped. Tokens that come later than that are left out, as watermarks have it. Not in the material that this library
follows; an extension.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "text_id string, sent_idx int, start int, end int, text string, label string"
STATE = "idx array<int>, token array<string>, label array<string>"


def spans_of(rows: list[tuple[int, str, str]]) -> list[tuple[int, int, str, str]]:
    """(start, end, text, label) of (token_idx, token, BIO label) in order; I after O or another type opens a span too."""
    out: list[tuple[int, int, str, str]] = []
    before = "O"
    for i, token, label in rows:
        if label != "O":
            if label[0] == "I" and before != "O" and before[2:] == label[2:]:
                start, _, text, kind = out[-1]
                out[-1] = (start, i + 1, f"{text} {token}", kind)
            else:
                out.append((i, i + 1, token, label[2:]))
        before = label
    return out


def stream_spans(tokens: DataFrame, time: str = "edited_at", late: str = "10 seconds") -> DataFrame:
    """(text_id, sent_idx, start, end, text, label) of a stream of (text_id, sent_idx, token_idx, token, label, time).

    A token that is delivered again replaces the earlier one. Append mode.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = dict(zip(state.get[0], zip(*state.get[1:]))) if state.exists else {}
        if state.hasTimedOut:
            state.remove()
            rows = spans_of([(i, *held[i]) for i in sorted(held)])
            yield pd.DataFrame([(*key, *r) for r in rows], columns=["text_id", "sent_idx", "start", "end", "text", "label"])
            return
        latest = 0
        for frame in frames:
            for i, token, label, at in zip(frame["token_idx"], frame["token"], frame["label"], frame["__ms"]):
                held[int(i)] = (token, label)
                latest = max(latest, int(at))
        state.update((list(held), [t for t, _ in held.values()], [x for _, x in held.values()]))
        state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + 1)

    rows = tokens.withWatermark(time, late).select("text_id", "sent_idx", "token_idx", "token", "label", F.unix_millis(time).alias("__ms"), time)
    return rows.groupBy("text_id", "sent_idx").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
