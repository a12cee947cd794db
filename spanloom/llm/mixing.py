"""A mixture of sources at target shares of its tokens, by soft membership.

Documents of a known source belong to it. For those without, a classifier fitted on a bounded sample of labelled rows gives the
probability of each source. A document's rate, how often it is taken, is the mean of its sources' rates under its probabilities, so a source's expected
tokens depend on the documents only through two sums: the tokens of known documents of each source, and for documents without source the tokens of
each pair of sources. Both are made in one distributed pass; projected-gradient least squares then moves the sources' rates against their misses, within 0
and their caps, without another pass. Rates become whole repeats by cumulative tokens in an order drawn by hash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.tokens import document_tokens, encoder, vocabulary_path
from spanloom.operators.positions import running_totals
from spanloom.util import checkpointed, lookup_rows

#: Labelled rows that the classifier is fitted on, in expectation; at most half as many more.
SAMPLE = 3000
WIDTH = 2048
#: Steps at most, beyond which the fit raises; and the change of all rates below which it rests.
STEPS, REST = 1_000_000, 1e-8
#: Sources at most: pairs of them are summed.
SOURCES = 1000
#: The share by which a source may fall short of its target and still counts as served.
CLOSE = 0.01
#: As a total: the greatest at which no source falls short.
FEASIBLE = "feasible"


def _counts(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The columns that a text's words are hashed to, WIDTH at most, and the root of their shares."""
    known: dict[str, int] = {}
    out = []
    for text in texts:
        at = []
        for w in text.lower().split():
            if w not in known:
                if len(known) > 500_000:
                    known.clear()
                known[w] = zlib.crc32(w.encode()) % WIDTH
            at.append(known[w])
        column, n = np.unique(np.array(at, np.int32), return_counts=True)
        out.append((column, np.sqrt(n / max(1, len(at))).astype(np.float32)))
    return out


def _bag(counts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Dense rows of _counts."""
    out = np.zeros((len(counts), WIDTH), np.float32)
    for i, (column, share) in enumerate(counts):
        out[i, column] = share
    return out


class SourceModel:
    """Softmax regression of the source on hashed words."""

    def __init__(self, classes: int):
        self.seen = np.ones(classes, bool)
        self.weights, self.bias = np.zeros((WIDTH, classes), np.float32), np.zeros(classes, np.float32)

    def fit(self, counts: list[tuple[np.ndarray, np.ndarray]], labels: list[int], rounds: int = 40) -> SourceModel:
        if not counts:
            return self
        x, y = _bag(counts), np.eye(len(self.bias), dtype=np.float32)[labels]
        self.seen = y.any(0)
        self.bias = np.log(np.maximum(y.mean(0), 1e-9)).astype(np.float32)
        seen = np.full_like(self.weights, 1e-8)
        for _ in range(rounds):
            slope = x.T @ (self._softmax(x) - y) / len(x) + 1e-6 * self.weights
            seen += slope**2
            self.weights -= 0.5 * slope / np.sqrt(seen)
        return self

    def _softmax(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.weights + self.bias
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def probabilities(self, texts: list[str]) -> np.ndarray:
        """The odds of each text's sources, only of those met in the fit; below a millionth they count as none."""
        odds = self._softmax(_bag(_counts(texts))) * self.seen
        odds[odds < 1e-6] = 0
        return odds / odds.sum(1, keepdims=True)


def _canonical_source() -> str:
    return "lower(trim(source))"


def fit_sources(documents: DataFrame, sources: list[str], sample: int = SAMPLE) -> SourceModel:
    """The classifier over ``sources``, fitted on about ``sample`` of the labelled rows, drawn by a hash of doc_id. Tasks send their hashed words, not their texts."""
    labelled = documents.selectExpr("doc_id", "text", f"{_canonical_source()} as s").where(F.col("s").isin(sources) & F.col("text").isNotNull())
    total = labelled.count()
    share = min(1.0, sample / max(1, total))
    drawn = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.lit(round(share * 1_000_000))).select("doc_id", "s", "text").limit(sample + sample // 2)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, part = zip(*_counts(batch.column(2).to_pylist())) if len(batch) else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(column, pa.list_(pa.int32())), pa.array(part, pa.list_(pa.float32()))], names=["doc_id", "s", "at", "part"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = sorted(drawn.mapInArrow(count, f"doc_id {kind}, s string, at array<int>, part array<float>").collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    at = {s: i for i, s in enumerate(sources)}
    return SourceModel(len(sources)).fit([(np.array(r.at, np.int32), np.array(r.part, np.float32)) for r in rows], [at[r.s] for r in rows])


def memberships(documents: DataFrame, sources: list[str], vocabulary: str | None = None, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, source, slice, odds, n_tokens): of a document of a known source, its index in ``sources``; of one without source, the
    probability of each. Documents of sources that aren't in the list are left out, as are those without tokens.
    """
    known = document_tokens(documents.select("doc_id", "text", "source", "lang", "domain"), vocabulary)
    index = F.lit(None).cast("int")
    for i, s in enumerate(sources):
        index = F.when(F.col("source") == s, i).otherwise(index)
    type_ = documents.schema["doc_id"].dataType.simpleString()
    known = known.select(F.col("text_id").cast(type_).alias("doc_id"), "source", index.alias("slice"), F.lit(None).cast("array<float>").alias("odds"), "n_tokens").where("slice is not null and n_tokens > 0")
    model = documents.sparkSession.sparkContext.broadcast(fit_sources(documents, sources, sample))
    path = vocabulary or vocabulary_path()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            odds = model.value.probabilities(texts)
            n = pa.array([len(encode(t)) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(odds), pa.list_(pa.float32())), n], names=["doc_id", "odds", "n_tokens"])

    unknown = documents.where("source is null and text is not null").select("doc_id", "text").mapInArrow(judge, f"doc_id {type_}, odds array<float>, n_tokens long").where("n_tokens > 0")
    return known.unionByName(unknown.selectExpr("doc_id", "cast(null as string) as source", "cast(null as int) as slice", "odds", "n_tokens"))


def moments(members: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of known documents of each source, and for documents with odds the expected tokens of each pair of sources: one pass, a bounded row set from each task."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, pairs = np.zeros(width), np.zeros((width, width))
        for batch in batches:
            n = batch.column(2).to_numpy(zero_copy_only=False).astype(float)
            sure = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            known += np.bincount(batch.column(0).drop_null().to_numpy(), n[sure], width)
            odds = np.array(batch.column(1).drop_null().to_pylist(), float).reshape(-1, width)
            pairs += odds.T @ (n[~sure][:, None] * odds)
        i, j = np.nonzero(pairs)
        at = np.flatnonzero(known)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([at, i]).astype(np.int32)), pa.array(np.concatenate([np.full(len(at), -1), j]).astype(np.int32)), pa.array(np.concatenate([known[at], pairs[i, j]]))], names=["i", "j", "v"])

    known, pairs = np.zeros(width), np.zeros((width, width))
    for r in members.select("slice", "odds", "n_tokens").mapInArrow(add, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        if r.j < 0:
            known[r.i] = r.v
        else:
            pairs[r.i, r.j] = r.v
    return known, pairs


def feasible_total(known: np.ndarray, shares: np.ndarray, caps: np.ndarray) -> float:
    """The greatest total that every source with documents can serve within its cap. The scarcest source sets it."""
    served = (known > 0) & (shares > 0)
    return float((caps[served] * known[served] / shares[served]).min()) if served.any() else 0.0


def fit_rates(known: np.ndarray, pairs: np.ndarray, shares: np.ndarray, caps: np.ndarray, total: float | str | None = None) -> tuple[np.ndarray, float, np.ndarray]:
    """The rate of each source that brings the expected tokens of all nearest to their shares of ``total``, the total, and the expected tokens.

    By default the total is the tokens of all documents; a source whose documents can't serve its share within their cap then falls short. Documents without
    source have no more than the least cap. Raises where the rates don't come to rest.
    """
    whole = known + pairs.sum(1)
    if total is None:
        total = float(whole.sum())
    elif total == FEASIBLE:
        total = feasible_total(known, shares, caps)
    least = caps.min(initial=np.inf)
    rates, scale = np.zeros(len(known)), np.where(whole > 0, whole, 1)
    for _ in range(STEPS):
        expected = known * rates + pairs @ np.minimum(rates, least)
        moved = np.clip(rates - (expected - total * shares) / scale, 0, caps)
        moved[whole == 0] = 0
        change = np.abs(moved - rates).max(initial=0)
        rates = moved
        if change < REST:
            return rates, total, known * rates + pairs @ np.minimum(rates, least)
    raise RuntimeError(f"the rates still change by {change} after {STEPS} steps")


def mixture(documents: DataFrame, mix_target: DataFrame, vocabulary: str | None = None, total: float | str | None = None, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, source, slice, odds, n_tokens, repeats) of the documents taken, repeats times each; ``odds`` are those of the targets in order of their names, for documents without source.

    Sources compare in lower case without blanks at their ends. No document is repeated more than max_repeats of its source, one
    without source no more than the least of them; a target that repeats has its greatest share and least cap. Documents of other
    sources, and without tokens, aren't taken. The tokens of a source are its share of the total up to one document, or all that its
    documents give when each is taken max_repeats times. The total is the tokens of all documents that can be taken, or the one given, or
    with FEASIBLE the greatest at which no source falls short.
    """
    targets = mix_target.selectExpr(f"{_canonical_source()} as source", "target_share", "max_repeats").dropna().groupBy("source").agg(F.max("target_share").alias("share"), F.min("max_repeats").alias("cap"))
    rows = sorted(lookup_rows(targets, SOURCES), key=lambda r: r.source)
    sources, shares, caps = [r.source for r in rows], np.array([r.share for r in rows], float), np.array([max(0, r.cap) for r in rows], float)
    empty = "doc_id {}, source string, slice string, odds array<float>, n_tokens long, repeats int".format(documents.schema["doc_id"].dataType.simpleString())
    if not sources:
        return documents.sparkSession.createDataFrame([], empty)
    members = checkpointed(memberships(documents, sources, vocabulary, sample))
    rates, _, _ = fit_rates(*moments(members, len(caps)), shares, caps, total)
    soft_rates = np.minimum(rates, caps.min())

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sure = batch.column(2).is_valid().to_numpy(zero_copy_only=False)
            odds = np.array(batch.column(3).drop_null().to_pylist(), float).reshape(-1, len(caps))
            out = np.zeros(len(sure))
            out[sure], out[~sure] = rates[batch.column(2).drop_null().to_numpy()], odds @ soft_rates
            name = np.full(len(sure), "", object)
            name[sure] = np.array(sources, object)[batch.column(2).drop_null().to_numpy()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(name, pa.string()), batch.column(3), batch.column(4), pa.array(out)], names=["doc_id", "source", "slice", "odds", "n_tokens", "rate"])

    rated = members.select("doc_id", "source", "slice", "odds", "n_tokens").mapInArrow(rate, empty.replace("repeats int", "rate double"))
    rated = rated.withColumn("whole", F.floor(F.col("rate") + 1e-9)).withColumn("part", F.greatest(F.col("rate") - F.col("whole"), F.lit(0.0)))
    rated = rated.withColumn("h", F.xxhash64("doc_id").bitwiseAND(F.lit(2**63 - 1)))
    # documents of a source have one rate: the first in the order of h that make up its part of the source's tokens get one more
    order = running_totals(rated, "slice", "h", "n_tokens", span=2**47)
    first = (F.col("before") + F.col("n_tokens") / 2 <= F.col("part") * F.col("total")) & (F.col("part") > 1e-9)
    drawn = F.col("h") % 1_000_000 < F.col("part") * 1_000_000
    extra = F.when(F.col("slice") == "", drawn).otherwise(first).cast("int")
    return order.withColumn("repeats", (F.col("whole") + extra).cast("int")).where("repeats > 0").selectExpr("doc_id", "source", "nullif(slice, '') as slice", "odds", "n_tokens", "repeats")


def reached(mixed: DataFrame, mix_target: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, documents, tokens, share, most_repeats, soft_tokens, soft_share, served) of each target, and of documents without source: null.

    ``tokens`` are of documents that name the source, ``soft_tokens`` what those without source are expected to add by their odds; ``share`` and
    ``soft_share`` are of the mixture's tokens, without and with those. ``served`` tells whether soft_share reaches the target but for CLOSE; where another source isn't served, shares above the target are in proportion.
    """
    got = mixed.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.max("repeats").alias("most_repeats"))
    whole = mixed.agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("t")).first().t or 0
    targets = mix_target.selectExpr(f"{_canonical_source()} as source", "target_share", "max_repeats")
    names = sorted(r.source for r in lookup_rows(targets.dropna().select("source").distinct(), SOURCES))
    soft = mixed.where("odds is not null").select(F.posexplode("odds").alias("i", "p"), (F.col("n_tokens") * F.col("repeats")).alias("n")).groupBy("i").agg(F.sum(F.col("p") * F.col("n")).alias("soft_tokens"))
    listed = F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")
    soft = soft.select(F.get(listed, F.col("i")).alias("source"), "soft_tokens")
    joined = targets.join(got, "source", "full").join(soft, "source", "left")
    tokens, expected = F.coalesce("tokens", F.lit(0)), F.coalesce("soft_tokens", F.lit(0.0))
    share = lambda x: x / F.lit(max(1, whole))
    served = share(tokens + expected) >= F.col("target_share") - CLOSE
    return joined.select("source", "target_share", "max_repeats", F.coalesce("documents", F.lit(0)).alias("documents"), tokens.alias("tokens"), share(tokens).alias("share"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), expected.alias("soft_tokens"), share(tokens + expected).alias("soft_share"), served.alias("served"))
