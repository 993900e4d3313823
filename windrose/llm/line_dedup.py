"""Line dedup by winnowing: repeated runs of lines go everywhere but where they occur first.

A *line* here is a stretch of text up to its terminators: it ends after a run of ``. ! ?`` or newlines and
the white space behind them, so a passage is found inside a longer physical line too. A line of more than ``_WIDE``
words is cut further, before the word with the smallest hash of every ``_WIDE`` words in a row: such cuts are the same wherever
the words are, so a passage inside a sentence has lines of its own. A *window* is the
shortest stretch of whole lines with at least ``min_words`` words that starts, or ends, at a given line.
Every run of whole lines with that many words is covered by windows that lie inside it, and a window's smallest hash is the same
wherever the window is repeated: these minima are the guaranteed fingerprints. A run that starts and ends anywhere
loses at most ``_WIDE`` words at each end to lines it shares with its surroundings, so one of ``min_words`` + 2 ``_WIDE`` (50) words is always found;
those words at its ends stay.

1. one pass over the texts finds each window's fingerprint, the smallest hash of two neighbouring lines in it, its content, a hash of
   all its lines, and its place; of windows equal in both a task sends on the earliest only, as the others are later repeats for certain;
2. places are joined by fingerprint; each brings the contents of the windows that reach from it both ways, which extend the match:
   of windows equal in both all but the one at the smallest (doc_id, hash of the text, position) are later repeats;
3. the union of a document's later repeats is deleted, in a second pass over the texts.

A fingerprint and a content are told apart by 96 bits together, documents by their id and 64 bits of their text. A window that is everywhere
comes once from each 2^19 windows of a task, so no group holds more rows than that many tasks; a task sorts its part of the
windows in memory, whose size ``spark.sql.shuffle.partitions`` sets.

Result: all rows and columns, with ``text`` replaced, ``stretches_removed`` and ``chars_removed``. Defined cases: a null text stays null; an empty text, or one
without words, is unchanged; the longest texts are searched whole; rows equal in doc_id and text are one document and are treated alike; null
doc_ids come first in the order; ids that aren't whole numbers are refused; an empty table gives an empty one;
input columns named like an output column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windrose.llm import _text
from windrose.llm._common import col, fresh, others, whole_ids

MIN_WORDS = 24  # at most 255, as longer lines count as 255 words
_WIDE = 13  # words of the longest line

_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?\n"]] = True
_GAP = _STOP.copy()
_GAP[[ord(c) for c in " \t\r"]] = True


def split_lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, words, first byte) of the lines, and the n + 1 offsets of the documents into them."""
    gap, edge = _GAP[data], np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before, after = np.ones_like(gap), np.ones_like(gap)
    before[1:], after[:-1] = gap[:-1], gap[1:]
    starts = np.flatnonzero(~gap & (before | edge[:-1]))
    ends = np.flatnonzero(~gap & (after | edge[1:])) + 1
    stops = np.zeros(len(data) + 1, np.int32)
    np.cumsum(_STOP[data], out=stops[1:])
    opens = np.ones(len(starts), bool)
    opens[1:] = stops[starts[1:]] > stops[ends[:-1]]
    firsts = np.searchsorted(starts, offsets[:-1])
    opens[firsts[firsts < len(starts)]] = True
    line = np.cumsum(opens)
    long = np.flatnonzero(line[:-_WIDE] == line[_WIDE:]) + 1
    opens[_minima(_text.span_hashes(data, starts, ends), long, long + _WIDE - 1)] = True
    first = np.flatnonzero(opens)
    last = np.append(first[1:], len(starts)) - 1 if len(first) else first
    return _text.span_hashes(data, starts[first], ends[last]), last - first + 1, starts[first], np.searchsorted(starts[first], offsets)


def _windows(words: np.ndarray, of: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last line of every window: the shortest from each line on, and the shortest up to each line."""
    total = np.zeros(len(words) + 1, np.int64)
    np.cumsum(words, out=total[1:], dtype=np.int64)
    size = np.diff(of)
    here = np.arange(len(words))
    to = np.searchsorted(total[1:], total[:-1] + least)
    ahead = to < np.repeat(of[1:], size)
    back = np.searchsorted(total, total[1:] - least, "right") - 1
    behind = back >= np.repeat(of[:-1], size)
    behind &= to[np.maximum(back, 0)] != here
    return np.concatenate((here[ahead], back[behind])), np.concatenate((to[ahead], here[behind]))


def _fingerprints(hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, position) of each window: the smallest hash of two neighbouring lines inside it, or the hash of its only line.

    Positions tell fingerprints of the same place apart from repeats; those of single lines follow those of pairs.
    """
    pairs = _text.mix(hashes[:-1] * np.uint64(0x2545F4914F6CDD1D) + hashes[1:]) if len(hashes) else hashes
    single = np.flatnonzero(start == end)
    several = np.flatnonzero(start != end)
    value, place = np.empty(len(start), np.uint64), np.empty(len(start), np.int64)
    value[single], place[single] = hashes[start[single]], start[single] + len(hashes)
    place[several] = _minima(pairs, start[several], end[several] - 1)
    value[several] = pairs[place[several]]
    return value, place


def _minima(hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The position of the smallest hash of each range, the last of equal ones."""
    level = np.frexp((end - start + 1).astype(np.float64))[1] - 1
    best, out = np.arange(len(hashes)), np.empty(len(start), np.int64)
    for k in range(int(level.max(initial=-1)) + 1):
        if k:
            left, right = best[: -(1 << (k - 1))], best[1 << (k - 1) :]
            best = np.where(hashes[left] < hashes[right], left, right)
        at = np.flatnonzero(level == k)
        left, right = best[start[at]], best[end[at] + 1 - (1 << k)]
        out[at] = np.where(hashes[left] < hashes[right], left, right)
    return out


#: Windows that a task gathers before it sends them on.
_FLUSH = 1 << 19
_NO_ID = -(1 << 63)  # stands for a null doc_id, which comes first


def _planes(x: np.ndarray) -> bytes:
    """Four-byte numbers, the bytes of equal weight together, so that a codec sees the zeros."""
    return x.astype(np.int32).view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(b: np.ndarray) -> np.ndarray:
    return b.reshape(4, -1).T.copy().view(np.int32).ravel()


def _packed(parts: list[bytes]) -> bytes:
    return np.array([len(p) for p in parts], np.int32).tobytes() + b"".join(parts)


def _parts(blob: memoryview, n: int) -> list[np.ndarray]:
    size = np.frombuffer(blob[: 4 * n], np.int32)
    at = 4 * n + np.concatenate(([0], np.cumsum(size, dtype=np.int64)))
    return [np.frombuffer(blob[i:j], np.uint8) for i, j in zip(at[:-1], at[1:])]


class _Found:
    """Windows of some documents: by window its fingerprint, content, document, span in characters and anchor; by document its id and key."""

    def __init__(self, ids, keys, doc, fp, content, start, upto, anchor) -> None:
        self.ids, self.keys, self.doc, self.fp, self.content, self.start, self.upto, self.anchor = ids, keys, doc, fp, content, start, upto, anchor

    @staticmethod
    def join(parts: list[_Found]) -> _Found:
        docs = np.concatenate(([0], np.cumsum([len(p.ids) for p in parts])))
        anchors = np.concatenate(([0], np.cumsum([int(p.anchor.max(initial=-1)) + 1 for p in parts])))
        doc = [p.doc + n for p, n in zip(parts, docs)]
        anchor = [p.anchor + n for p, n in zip(parts, anchors)]
        flat = {k: np.concatenate([getattr(p, k) for p in parts]) for k in ("ids", "keys", "fp", "content", "start", "upto")}
        return _Found(doc=np.concatenate(doc), anchor=np.concatenate(anchor), **flat)

    def in_order(self) -> None:
        """Documents are put in their order, equal ones become one."""
        order = np.lexsort((self.keys, self.ids))
        ids, keys = self.ids[order], self.keys[order]
        new = np.ones(len(ids), bool)
        new[1:] = (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1])
        rank = np.empty(len(ids), np.int64)
        rank[order] = np.cumsum(new) - 1
        self.ids, self.keys, self.doc = ids[new], keys[new], rank[self.doc]

    def earliest(self) -> tuple[np.ndarray, np.ndarray]:
        """Of the windows equal in fingerprint and content: the first, and those at another, later place."""
        key = _text.mix(self.fp ^ (self.content.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        place = self.doc << 32 | self.start
        order = np.lexsort((place, key))
        fp, content, place = self.fp[order], self.content[order], place[order]
        new = np.ones(len(order), bool)
        new[1:] = (fp[1:] != fp[:-1]) | (content[1:] != content[:-1])
        first = place[new][np.cumsum(new) - 1]
        return order[new], order[place != first]


def _windows_of(data: np.ndarray, of: np.ndarray, ids: np.ndarray, keys: np.ndarray, least: int) -> _Found:
    hashes, words, at, lines = split_lines(data, of)
    start, end = _windows(np.minimum(words, 255), lines, least)
    fp, anchor = _fingerprints(hashes, start, end)
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * _text._power(_text._BASE, len(hashes)), out=total[1:])
    content = _text.mix((total[end + 1] - total[start]) * _text._power(_text._INVERSE, len(hashes))[start] + (end - start).astype(np.uint64)) if len(start) else fp
    chars = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=chars[1:])
    doc = np.searchsorted(lines, start, "right") - 1
    opens = chars[np.append(at, len(data))]
    upto = np.where(end + 1 == lines[doc + 1], chars[of[doc + 1]], opens[end + 1])
    named, doc_at = np.unique(doc, return_inverse=True)
    base = chars[of[doc]]
    _, anchor = np.unique(anchor, return_inverse=True)
    return _Found(ids[named], keys[named], doc_at, fp, (content >> np.uint64(32)).astype(np.uint32), opens[start] - base, upto - base, anchor)


def _merged(doc: np.ndarray, start: np.ndarray, upto: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The union of spans by document, in order."""
    if not len(doc):
        return doc, start, upto
    order = np.argsort(doc << 32 | start)
    doc, start = doc[order], start[order]
    reach = np.maximum.accumulate(doc << 32 | upto[order])
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] << 32 | start[1:]) > reach[:-1]
    last = np.append(np.flatnonzero(new)[1:], len(doc)) - 1
    return doc[new], start[new], reach[last] & 0xFFFFFFFF


def _docs_of(*docs: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    named = np.unique(np.concatenate(docs))
    return named, [np.searchsorted(named, d) for d in docs]


def _batch(target: list[int], blobs: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(target, pa.int32()), pa.array(blobs, pa.binary())], ["target", "blob"])


def _sent(found: _Found, targets: int) -> Iterator[pa.RecordBatch]:
    """A blob for each target: the earliest of equal windows here, by anchor, and the spans of the others, which are later repeats for certain."""
    found.in_order()
    first, later = found.earliest()
    target = (_text.mix(found.fp) % np.uint64(targets)).astype(np.int64)
    first = first[np.lexsort((found.start[first], found.anchor[first], target[first]))]
    later = later[np.argsort(target[later], kind="stable")]
    cut = [np.searchsorted(target[x], np.arange(targets + 1)) for x in (first, later)]
    for t in np.unique(np.concatenate((target[first], target[later]))):
        f, g = (x[c[t] : c[t + 1]] for x, c in zip((first, later), cut))
        new = np.ones(len(f), bool)
        new[1:] = found.anchor[f][1:] != found.anchor[f][:-1]
        a = f[new]
        base = found.start[a]
        count = np.diff(np.append(np.flatnonzero(new), len(f)))
        gone, gone_start, gone_upto = _merged(found.doc[g], found.start[g], found.upto[g])
        named, (doc, gone) = _docs_of(found.doc[a], gone)
        ids = found.ids[named]
        parts = [
            np.diff(ids, prepend=np.int64(0)).view(np.uint8).reshape(-1, 8).T.tobytes(), found.keys[named].tobytes(),
            found.fp[a].tobytes(), _planes(np.diff(doc, prepend=0)), _planes(base), _planes(count),
            found.content[f].tobytes(), _planes(found.start[f] - np.repeat(base, count)), _planes(found.upto[f] - found.start[f]),
            _planes(np.diff(gone, prepend=0)), _planes(gone_start), _planes(gone_upto - gone_start),
        ]
        yield _batch([t], [_packed(parts)])


def _ids(b: np.ndarray) -> np.ndarray:
    return np.cumsum(b.reshape(8, -1).T.copy().view(np.int64).ravel(), dtype=np.int64)


def _anchored(least: int, targets: int):
    """Documents to the windows that each target gets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            data, offsets = _text.buffers(batch.column(2))
            ids, keys = (batch.column(i).to_numpy() for i in (0, 1))
            for a, b in _text.chunks(offsets):
                held.append(_windows_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], ids[a:b], keys[a:b], least))
                n += len(held[-1].fp)
                if n >= _FLUSH:
                    yield from _sent(_Found.join(held), targets)
                    held, n = [], 0
        if n:
            yield from _sent(_Found.join(held), targets)

    return run


def _joined(targets: int):
    """The windows of a target, joined by fingerprint and extended by content: the later ones' spans, to the targets of their documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, known = [], []
        for batch in batches:
            for blob in batch.column(1):
                ids, keys, fp, doc, base, count, content, start, size, gone, gone_start, gone_size = _parts(blob.as_buffer(), 12)
                ids, keys, doc, count = _ids(ids), keys.view(np.int64), np.cumsum(_from_planes(doc), dtype=np.int64), _from_planes(count)
                anchor = np.repeat(np.arange(len(doc)), count)
                start = _from_planes(start).astype(np.int64) + _from_planes(base)[anchor]
                held.append(_Found(ids, keys, doc[anchor], fp.view(np.uint64)[anchor], content.view(np.uint32), start, start + _from_planes(size), anchor))
                gone, gone_start = np.cumsum(_from_planes(gone), dtype=np.int64), _from_planes(gone_start).astype(np.int64)
                known.append((gone, gone_start, gone_start + _from_planes(gone_size), len(ids)))
        if not held:
            return
        shift = np.concatenate(([0], np.cumsum([k[3] for k in known])))
        gone = np.concatenate([k[0] + n for k, n in zip(known, shift)])
        spans = [np.concatenate([k[i] for k in known]) for i in (1, 2)]
        found = _Found.join(held)
        held.clear()
        raw = np.arange(len(found.ids))
        named = _Found(found.ids, found.keys, raw, raw, raw, raw, raw, raw)
        named.in_order()
        found.in_order()
        _, later = found.earliest()
        doc, start, upto = _merged(np.concatenate((found.doc[later], named.doc[gone])), np.concatenate((found.start[later], spans[0])), np.concatenate((found.upto[later], spans[1])))
        target = (found.keys[doc].view(np.uint64) % np.uint64(targets)).astype(np.int64)
        order = np.argsort(target, kind="stable")
        cut = np.searchsorted(target[order], np.arange(targets + 1))
        for t in np.unique(target):
            x = order[cut[t] : cut[t + 1]]
            mine, (at,) = _docs_of(doc[x])
            yield _batch([t], [_packed([found.ids[mine].tobytes(), found.keys[mine].tobytes(), _planes(np.diff(at, prepend=0)), _planes(start[x]), _planes(upto[x] - start[x])])])

    return run


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """By document the union of its spans."""
    held = []
    for batch in batches:
        for blob in batch.column(1):
            ids, keys, doc, start, size = _parts(blob.as_buffer(), 5)
            start = _from_planes(start).astype(np.int64)
            doc, none = np.cumsum(_from_planes(doc), dtype=np.int64), np.zeros(0, np.int64)
            held.append(_Found(ids.view(np.int64), keys.view(np.int64), doc, none, none, start, start + _from_planes(size), none))
    if not held:
        return
    found = _Found.join(held)
    found.in_order()
    doc, start, upto = _merged(found.doc, found.start, found.upto)
    at = np.searchsorted(doc, np.arange(len(found.ids) + 1)).astype(np.int32)
    spans = pa.StructArray.from_arrays([pa.array(start.astype(np.int32)), pa.array(upto.astype(np.int32))], ["start", "upto"])
    for i in range(0, len(found.ids), 10_000):
        j = min(i + 10_000, len(found.ids))
        ranges = pa.ListArray.from_arrays(pa.array(at[i : j + 1] - at[i]), spans[at[i] : at[j]])
        yield pa.RecordBatch.from_arrays([pa.array(found.ids[i:j]), pa.array(found.keys[i:j]), ranges], ["id", "k", "ranges"])


def _identity(docs: DataFrame, doc_id: str, text: str) -> list[Column]:
    """What stands for a document: its id, and a hash of id and text."""
    return [F.coalesce(col(doc_id).cast("bigint"), F.lit(_NO_ID)), F.xxhash64(col(doc_id), col(text))]


def repeated_ranges(docs: DataFrame, min_words: int = MIN_WORDS, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, k, ranges): the stretches to delete of each document that has any, as [start, upto) in characters, disjoint and in order.

    ``id`` is the doc_id, or the smallest bigint where that is null; ``k`` a hash of doc_id and text.
    """
    if not 1 <= min_words <= 255:
        raise ValueError("min_words must be from 1 to 255")
    whole_ids(docs, doc_id)
    targets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    i, k = _identity(docs, doc_id, text)
    source = docs.where(col(text).isNotNull()).select(i.alias("id"), k.alias("k"), col(text).alias("text"))
    blobs = "target int, blob binary"
    anchored = source.mapInArrow(_anchored(min_words, targets), blobs).repartitionById(targets, "target")
    spans = anchored.mapInArrow(_joined(targets), blobs).repartitionById(targets, "target")
    return spans.mapInArrow(_united, "id bigint, k bigint, ranges array<struct<start:int,upto:int>>")


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without later repeats of runs of at least ``min_words`` words; see the module's text."""
    names = others(docs, "stretches_removed", "chars_removed")
    one, key, found, with_key, ranges = fresh(docs, "id", "k", "found", "with_key", "ranges")
    cuts = repeated_ranges(docs, min_words, doc_id=doc_id, text=text).toDF(found, with_key, ranges)
    i, k = _identity(docs, doc_id, text)
    same = (F.col(one) == F.col(found)) & (F.col(key) == F.col(with_key))
    joined = docs.select(*map(col, names), i.alias(one), k.alias(key)).join(cuts.hint("shuffle_hash"), same, "left")
    r = F.col(ranges)
    starts = F.concat(F.array(F.lit(0)), F.transform(r, lambda x: x["upto"]))
    ends = F.concat(F.transform(r, lambda x: x["start"]), F.array(F.lit(2**31 - 1)))
    kept = F.array_join(F.zip_with(starts, ends, lambda a, b: F.substring(col(text), a + 1, b - a)), "")
    removed = F.aggregate(r, F.lit(0), lambda n, x: n + x["upto"] - x["start"])
    return joined.select(
        *(F.when(r.isNull(), col(c)).otherwise(kept).alias(c) if c == text else col(c) for c in names),
        F.coalesce(F.size(r), F.lit(0)).alias("stretches_removed"), F.coalesce(removed, F.lit(0)).alias("chars_removed"),
    )
