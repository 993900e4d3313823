"""Quality classifier by positive-unlabelled learning.

Trusted positives are documents labelled good (and not toxic); everything else is unlabelled web text, good and bad
together. With class prior p the classifier minimises the non-negative unbiased risk

    p R+(positives) + max(0, R-(unlabelled) - p R-(positives)),

with the logistic loss, by full-batch Adam; where the second term turns negative its gradient is reversed.

Features of a whole text: which of 2^18 hashed words, word beginnings and repeated words it has, and 16 steps each of six
shares (capitals, symbols, digits, repeated words, word length, punctuation). Those whose frequency differs between the
trusted and the unlabelled texts by more than ``z`` standard errors are kept, so the model is a short sparse vector.

The class prior is the smallest ratio, over thresholds of the score of a first classifier fitted to one half, of the other half's
unlabelled share above the threshold to its positive share, the threshold chosen by that ratio's upper confidence bound: no set of documents can hold a larger share of the unlabelled ones
than p times its share of the positives unless bad documents are in it.

Feature counts, the prior's shares above its thresholds and the quantile that sets the threshold are sums over all documents (the prior's without those its
first classifier was fitted to); all documents are written once as rows over the kept features. Of trusted documents at most ``positives`` count, and the gradient
takes at most ``unlabelled`` of the others, the first by a hash of their id; rows that share an id count once in both. It runs in one task; the driver receives
sums and the model only.

The risk sets the weights; the threshold it implies (score plus bias above 0) isn't used as it is: with the logistic loss and features that separate well the risk is flat in the bias, and
what it would reject follows the number of steps. The threshold is the score that the estimated share of good documents among all is above, or the one that ``keep`` of the
trusted positives are above, whichever accepts more.

Defined cases: a null text, or one without words, scores as the empty feature set plus the bias; documents without a label are
unlabelled; of several labels of a document it counts as trusted if all say so; with no trusted positive nothing is learnt and
all is accepted; rows that repeat are scored alike; the longest texts are read whole; an empty table gives an empty one; ids that aren't whole numbers are refused; input columns are passed on, and one called ``quality_score`` is replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windrose.llm import _text
from windrose.llm._common import col, discard, mapped, others, whole_ids, written

BITS = 18
STEPS = 16
SHARES = 6
_WORDS = 1 << BITS
_BLOCK = 1 << 19  # entries of a block of rows
WIDTH = _WORDS + STEPS * SHARES
POSITIVES = 12_000
UNLABELLED = 24_000
Z = 3.0


def _share_table() -> np.ndarray:
    table = np.zeros((5, 256), np.uint8)
    table[0, 65:91] = 1
    table[1, [ord(c) for c in "#$%&*+<=>@\\^_`{|}~!"]] = 1
    table[2, 48:58] = 1
    table[3, [ord(c) for c in ".,;:?()\"'-"]] = 1
    table[4, [*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
    return table


_SHARE = _share_table()


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct feature numbers of every document, in order, and the n + 1 offsets of the documents into them."""
    n = len(offsets) - 1
    starts, ends, of = _text.words(data, offsets)
    low = _text.lowered(data)
    doc = np.repeat(np.arange(n, dtype=np.uint64), np.diff(of))
    word = _text.span_hashes(low, starts, ends)
    stem = _text.span_hashes(low, starts, np.minimum(ends, starts + 5)) ^ np.uint64(0x5DEECE66D)
    stem = stem[ends - starts > 5]
    key = np.concatenate((doc << np.uint64(40) | word >> np.uint64(24), doc[ends - starts > 5] << np.uint64(40) | _text.mix(stem) >> np.uint64(24)))
    key.sort()
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    key = key[new]
    number = (_text.mix(key & np.uint64((1 << 40) - 1)) & np.uint64(_WORDS - 1)) | (key >> np.uint64(40)) << np.uint64(32)
    again = np.flatnonzero((word[1:] == word[:-1]) & (doc[1:] == doc[:-1]))
    size, total = np.maximum(np.diff(offsets), 1), np.zeros((SHARES, n))
    capitals, symbols, digits, marks, letters = (np.diff(np.concatenate(([0], np.cumsum(_SHARE[k][data], dtype=np.int64)))[offsets]) for k in range(5))
    count = np.maximum(np.diff(of), 1)
    total[0], total[1], total[2] = capitals / np.maximum(letters, 1), symbols / size, digits / size
    total[3], total[4] = np.bincount(doc[again].astype(np.int64), minlength=n) / count, marks / size
    total[5] = letters / count / 32
    step = np.minimum((np.sqrt(np.clip(total, 0, 1)) * STEPS).astype(np.uint64), np.uint64(STEPS - 1))
    shares = np.uint64(_WORDS) + np.arange(SHARES, dtype=np.uint64)[:, None] * np.uint64(STEPS) + step | np.arange(n, dtype=np.uint64) << np.uint64(32)
    number = np.concatenate((number, shares.ravel()))
    number.sort()
    number = number[np.concatenate(([True], number[1:] != number[:-1]))] if len(number) else number
    bounds = np.searchsorted(number, np.arange(n + 1, dtype=np.uint64) << np.uint64(32))
    return (number & np.uint64(0xFFFFFFFF)).astype(np.int64), bounds


def _featurised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = _text.buffers(batch.column(0))
        for a, b in _text.chunks(offsets):
            number, of = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            yield pa.RecordBatch.from_arrays([_blobs(number, of)], ["features"])


class Sparse:
    """0/1 rows over the kept features, worked on in blocks, so that only the 4-byte numbers are held whole."""

    def __init__(self, number: np.ndarray, of: np.ndarray, width: int) -> None:
        self.number, self.of, self.width = number.astype(np.int32, copy=False), of, width
        cuts, at = [0], 0
        while at < len(of) - 1:
            at = max(int(np.searchsorted(of, of[at] + _BLOCK, "right")) - 1, at + 1)
            cuts.append(at)
        self.blocks = list(zip(cuts[:-1], cuts[1:]))

    def dot(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.of) - 1)
        for a, b in self.blocks:
            row = np.repeat(np.arange(b - a), np.diff(self.of[a : b + 1]))
            out[a:b] = np.bincount(row, w[self.number[self.of[a] : self.of[b]]], minlength=b - a)
        return out

    def back(self, g: np.ndarray) -> np.ndarray:
        out = np.zeros(self.width)
        for a, b in self.blocks:
            out += np.bincount(self.number[self.of[a] : self.of[b]], np.repeat(g[a:b], np.diff(self.of[a : b + 1])), minlength=self.width)
        return out

    def rows(self, mine: np.ndarray) -> Sparse:
        size = np.diff(self.of)
        return Sparse(self.number[np.repeat(mine, size)], np.concatenate(([0], np.cumsum(size[mine]))), self.width)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _adam(gradient, width: int, steps: int, rate: float) -> np.ndarray:
    w, m, v = np.zeros(width), np.zeros(width), np.zeros(width)
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def _thresholds(positive: np.ndarray, least: float = 0.1) -> np.ndarray:
    return np.quantile(positive, np.linspace(0, 1 - least, 200))


def _least_ratio(positive: np.ndarray, thresholds: np.ndarray, above: np.ndarray, n_u: int) -> float:
    above_p = 1 - np.searchsorted(np.sort(positive), thresholds) / len(positive)
    above_u = above / n_u
    margin = np.sqrt(np.log(20) / 2 / n_u) + np.sqrt(np.log(20) / 2 / len(positive))
    best = int(np.argmin((above_u + margin) / np.maximum(above_p, 1e-9)))
    return float(np.clip(above_u[best] / max(above_p[best], 1e-9), 0.05, 0.99))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, least: float = 0.1) -> float:
    """The unlabelled share over the positive share above the threshold where that ratio's upper bound is smallest; shares of positives under ``least`` are left out."""
    thresholds = _thresholds(positive, least)
    return _least_ratio(positive, thresholds, len(unlabelled) - np.searchsorted(np.sort(unlabelled), thresholds), len(unlabelled))


@dataclass
class Model:
    """Weights of the kept features, the bias, the estimated prior and the threshold of the score."""

    kept: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 1.0
    prior: float = 1.0

    def scores(self, number: np.ndarray, of: np.ndarray) -> np.ndarray:
        dense = np.zeros(WIDTH)
        dense[self.kept] = self.weights
        return np.bincount(np.repeat(np.arange(len(of) - 1), np.diff(of)), dense[number], minlength=len(of) - 1) + self.bias


def select(n_p: int, f_p: np.ndarray, n_u: int, f_u: np.ndarray, z: float = Z) -> np.ndarray:
    """The features whose frequencies differ by more than ``z`` standard errors, whatever the number of documents."""
    f_p, f_u = f_p / n_p, f_u / n_u
    both = (f_p * n_p + f_u * n_u) / (n_p + n_u)
    error = np.sqrt(both * (1 - both) * (1 / n_p + 1 / n_u))
    return np.flatnonzero(np.abs(f_p - f_u) > z * np.maximum(error, 1e-12))


def contrast(x_p: Sparse, x_u: Sparse, *, steps: int = 100, rate: float = 0.05, decay: float = 1e-4) -> np.ndarray:
    """Weights and bias of a classifier of positives against unlabelled, for the prior."""

    def gradient(w: np.ndarray) -> np.ndarray:
        s_p, s_u = x_p.dot(w[:-1]) + w[-1], x_u.dot(w[:-1]) + w[-1]
        g_p, g_u = -_sigmoid(-s_p) / len(s_p), _sigmoid(s_u) / len(s_u)
        return np.append(x_p.back(g_p) + x_u.back(g_u) + decay * w[:-1], g_p.sum() + g_u.sum())

    return _adam(gradient, x_p.width + 1, steps, rate)


def risk(w: np.ndarray, x_p: Sparse, x_u: Sparse, prior: float, decay: float = 1e-4) -> tuple[float, float]:
    """The two terms of the non-negative risk for weights and bias, the second before it is cut off at 0; the first with the decay of the weights."""
    s_p, s_u = x_p.dot(w[:-1]) + w[-1], x_u.dot(w[:-1]) + w[-1]
    positive = prior * np.logaddexp(0, -s_p).mean() + decay / 2 * float(w[:-1] @ w[:-1])
    return float(positive), float(np.logaddexp(0, s_u).mean() - prior * np.logaddexp(0, s_p).mean())


def risk_gradient(w: np.ndarray, x_p: Sparse, x_u: Sparse, prior: float, decay: float = 1e-4) -> np.ndarray:
    """The risk's gradient; where its second term is negative, the reversed gradient of that term."""
    n_p, n_u = len(x_p.of) - 1, len(x_u.of) - 1
    s_p, s_u = x_p.dot(w[:-1]) + w[-1], x_u.dot(w[:-1]) + w[-1]
    negative = np.logaddexp(0, s_u).mean() - prior * np.logaddexp(0, s_p).mean()
    down_p, up_p, up_u = -_sigmoid(-s_p) / n_p, _sigmoid(s_p) / n_p, _sigmoid(s_u) / n_u
    if negative >= 0:
        g_p, g_u = prior * down_p - prior * up_p, up_u
    else:
        g_p, g_u = prior * up_p, -up_u
    return np.append(x_p.back(g_p) + x_u.back(g_u) + decay * w[:-1], g_p.sum() + g_u.sum())


def fit(x_p: Sparse, x_u: Sparse, prior: float, *, steps: int = 300, rate: float = 0.05, decay: float = 1e-4) -> np.ndarray:
    """Weights and bias of the least non-negative risk."""
    return _adam(lambda w: risk_gradient(w, x_p, x_u, prior, decay), x_p.width + 1, steps, rate)


def _rows(blobs: pa.Array, width: int) -> Sparse:
    """Rows of a binary column of 4-byte feature numbers; a null has none."""
    blobs = blobs.cast(pa.large_binary()).fill_null(b"") if blobs.null_count else blobs.cast(pa.large_binary())
    _, where, what = blobs.buffers()
    if where is None or not len(blobs):
        return Sparse(np.zeros(0, np.int32), np.zeros(1, np.int64), width)
    of = np.frombuffer(where, np.int64)[blobs.offset : blobs.offset + len(blobs) + 1]
    number = np.frombuffer(what, np.uint8)[of[0] : of[-1]] if what is not None else np.zeros(0, np.uint8)
    return Sparse(number.view(np.int32), (of - of[0]) // 4, width)


def _blobs(number: np.ndarray, of: np.ndarray) -> pa.Array:
    number = np.ascontiguousarray(number, np.int32)
    offsets = (of - of[0]).astype(np.int64) * 4
    if offsets[-1] < 1 << 31:
        return pa.Array.from_buffers(pa.binary(), len(of) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(number)])
    return pa.array([number[i:j].tobytes() for i, j in zip(of[:-1], of[1:])], pa.binary())


def _summed(df: DataFrame, tally, size: int) -> np.ndarray:
    """The sums over all of ``df`` of what ``tally`` makes of each batch: ``size`` numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += tally(batch)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["at", "n"])

    got = df.mapInArrow(run, "at int, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, np.int64)
    out[got["at"].to_numpy()] = got["n"].to_numpy()
    return out


def _text_tally(batch: pa.RecordBatch) -> np.ndarray:
    """In how many texts each feature is, and the number of texts."""
    total = np.zeros(WIDTH + 1, np.int64)
    data, offsets = _text.buffers(batch.column(0))
    for a, b in _text.chunks(offsets):
        total[:-1] += np.bincount(features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])[0], minlength=WIDTH)
    total[-1] = len(batch)
    return total


def _row_tally(batch: pa.RecordBatch) -> np.ndarray:
    rows = _rows(batch.column(0), WIDTH)
    return np.append(np.bincount(rows.number, minlength=WIDTH), len(batch))


def _only(number: np.ndarray, of: np.ndarray, place: np.ndarray) -> pa.Array:
    number = place[number]
    inside = number >= 0
    return _blobs(number[inside], np.concatenate(([0], np.cumsum(inside)))[of])


def _place(kept: np.ndarray) -> np.ndarray:
    place = np.full(WIDTH, -1, np.int32)
    place[kept] = np.arange(len(kept))
    return place


def _reduced(kept: np.ndarray):
    """Texts as rows over the kept features."""
    place = _place(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = _text.buffers(batch.column(1))
            for a, b in _text.chunks(offsets):
                rows = _only(*features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]), place)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], rows], ["h", "features"])

    return run


def _narrowed(kept: np.ndarray):
    """Rows over all features to rows over the kept ones, without an ``h``."""
    place = _place(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _rows(batch.column(0), WIDTH)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(batch), pa.int64()), _only(rows.number, rows.of, place)], ["h", "features"])

    return run


def _above(w: np.ndarray, thresholds: np.ndarray, sampled: int):
    """How many held-out documents score no less than each threshold, and how many there are; those with an even ``h`` up to ``sampled`` were fitted to."""

    def tally(batch: pa.RecordBatch) -> np.ndarray:
        h = batch.column(0)
        fitted = h.fill_null(1).to_numpy()
        fitted = (fitted <= sampled) & (fitted % 2 == 0)
        scores = np.sort(_rows(batch.column(1), len(w) - 1).dot(w[:-1])[~fitted])
        return np.append(len(scores) - np.searchsorted(scores, thresholds), len(scores))

    return tally


_FINE = 4096  # steps of the score in which its distribution is counted


def _quantile(rows: DataFrame, w: np.ndarray, share: float) -> float:
    """The score that ``share`` of all rows are below, from counts of its steps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step, n = np.unique(np.floor(_rows(batch.column(0), len(w) - 1).dot(w[:-1]) * _FINE).astype(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(step), pa.array(n)], ["step", "n"])

    got = rows.select("features").mapInArrow(run, "step bigint, n bigint").groupBy("step").agg(F.sum("n").alias("n")).orderBy("step").toArrow()
    below = np.cumsum(got["n"].to_numpy())
    return float(got["step"].to_numpy()[min(np.searchsorted(below, share * below[-1], "right"), len(below) - 1)] / _FINE)


def train(
    docs: DataFrame, trusted: DataFrame, *, positives: int = POSITIVES, unlabelled: int = UNLABELLED, keep: float = 0.99, doc_id: str = "doc_id", text: str = "text"
) -> Model:
    """The model fitted to documents whose ids are in ``trusted`` (one column) and to others.

    ``positives`` bounds the trusted documents, ``unlabelled`` those whose gradient is taken; ``keep``: the least share of the positives that the threshold accepts.
    """
    whole_ids(docs, doc_id)
    source = docs.where(col(text).isNotNull()).select(col(doc_id).cast("bigint").alias("doc_id"), col(text).alias("text"))
    ids = trusted.select(col(trusted.columns[0]).cast("bigint").alias("doc_id")).where("doc_id is not null").distinct()
    order, h = F.xxhash64(F.lit("fit"), "doc_id"), F.when(F.col("doc_id").isNotNull(), F.xxhash64(F.lit("unlabelled"), "doc_id"))
    # Ids alone choose the sample; then only its texts are read on.
    good = F.broadcast(ids.join(source.select("doc_id"), "doc_id", "left_semi").orderBy(order, "doc_id").limit(positives))
    first = source.join(good, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    some = written(first.select("text").mapInArrow(_featurised, "features binary"), "trusted")
    of_p = _summed(some, _row_tally, WIDTH + 1)
    sampled = source.select(h.alias("h")).where("h is not null").distinct().orderBy("h").limit(unlabelled).agg(F.max("h")).first()[0]
    n_p = int(of_p[-1])
    if not n_p or sampled is None:
        discard(some)
        return Model()
    of_u = _summed(source.select("text"), _text_tally, WIDTH + 1)
    kept = select(n_p, of_p[:-1], int(of_u[-1]), of_u[:-1])
    width = len(kept)
    everything = written(source.select(h.alias("h"), "text").mapInArrow(_reduced(kept), "h bigint, features binary"), "quality")
    sample = some.mapInArrow(_narrowed(kept), "h bigint, features binary").unionByName(everything.where(F.col("h") <= sampled).groupBy("h").agg(F.min("features").alias("features")))

    def parts(table: pa.Table) -> tuple[Sparse, Sparse, np.ndarray]:
        """Trusted and unlabelled rows, and which of the latter have an even ``h``; in one order, however the rows arrive."""
        table = table.combine_chunks().sort_by([("h", "ascending"), ("features", "ascending")])
        hashed, rows = table.column("h").combine_chunks(), table.column("features").combine_chunks()
        mask = hashed.is_null().to_numpy(zero_copy_only=False)
        every = _rows(rows, width)
        return every.rows(mask), every.rows(~mask), hashed.drop_null().to_numpy() % 2 == 0

    def halves(table: pa.Table) -> pa.Table:
        x_p, x_u, even = parts(table)
        if n_p < 2 or not even.any():
            return pa.table({"w": pa.array([None], pa.binary()), "held": pa.array([None], pa.binary())})
        # By content, so that copies of a text are in one half and the other is held out indeed.
        first = np.array([zlib.crc32(x_p.number[a:b].tobytes()) % 2 == 0 for a, b in zip(x_p.of[:-1], x_p.of[1:])])
        if first.all() or not first.any():
            first = np.arange(len(first)) % 2 == 0
        w = contrast(x_p.rows(first), x_u.rows(even))
        return pa.table({"w": [w.tobytes()], "held": [x_p.rows(~first).dot(w[:-1]).tobytes()]})

    def whole(table: pa.Table) -> pa.Table:
        x_p, x_u, _ = parts(table)
        w = fit(x_p, x_u, prior)
        return pa.table({"w": [w.tobytes()], "cut": [float(np.quantile(x_p.dot(w[:-1]), 1 - keep))]})

    prior = 0.5
    got = sample.groupBy().applyInArrow(halves, "w binary, held binary").first()
    if got["w"] is not None:
        held = np.frombuffer(bytes(got["held"]))
        at = _thresholds(held)
        above = _summed(everything, _above(np.frombuffer(bytes(got["w"])), at, sampled), len(at) + 1)
        if above[-1]:
            prior = _least_ratio(held, at, above[:-1], int(above[-1]))
    got = sample.groupBy().applyInArrow(whole, "w binary, cut double").first()
    w = np.frombuffer(bytes(got["w"]))
    # Where the risk is flat the bias is not determined: the accepted share of all documents is the prior, and trusted texts stay.
    cut = min(_quantile(everything, w, 1 - prior), got["cut"])
    discard(some, everything)
    return Model(kept, w[:-1], float(-np.nextafter(cut, -np.inf)), prior)


def _scorer(model: Model, names: list[str], text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index(text)
        for batch in batches:
            data, offsets = _text.buffers(batch.column(at))
            scores = [model.scores(*features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])) for a, b in _text.chunks(offsets)]
            score = np.concatenate(scores) if scores else np.zeros(0)
            keep = np.flatnonzero(score > 0)
            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(keep)).columns, pa.array(score[keep])], [*batch.schema.names, "made_quality_score"])

    return run


def accepted(docs: DataFrame, model: Model, *, columns: list[str] | None = None, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model accepts, with ``quality_score``; ``columns``: those to return, by default all."""
    names = others(docs, "quality_score")
    wanted = names if columns is None else columns
    read = wanted if text in wanted else [*wanted, text]
    source = docs.select(*map(col, read))
    out = mapped(source, _scorer(model, read, text), [("quality_score", "double")])
    return out.select(*map(col, wanted), "quality_score")


def trusted_ids(labels: DataFrame) -> DataFrame:
    """(doc_id) of the documents that every label calls good and not toxic."""
    good = F.coalesce((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), F.lit(False))
    return labels.groupBy("doc_id").agg(F.min(good).alias("good")).where("good").select("doc_id")
