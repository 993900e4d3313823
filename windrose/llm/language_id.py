"""Language identification by rank-order n-gram profiles and the out-of-place distance.

A text is folded to small letters; every run of other characters becomes one space, and a space is put at both
ends. Its n-grams are the letters, and the two- and three-character pieces that do not run across a space in the
middle. They are ranked by (count descending, n-gram ascending) and the first ``size`` are its profile. The profile of
a language is ranked likewise over all texts labelled with it. The distance of a text to a language sums, over the text's
profile, how far each n-gram is out of place; an n-gram that the language's profile lacks costs ``size``. The nearest
language wins, the alphabetically first of equals.

Both passes read whole texts, chunk by chunk, as code points in numpy; profiles (languages x ``size`` rows) are the
only thing broadcast, and their number does not depend on the rows.

Defined cases: a null text, or one without letters, gets a null language and distance 0; texts without a label shape
no profile; an empty training table leaves every language null; rows that repeat are judged alike; input columns other
than the id, text and label are not read, whatever their names; an empty table gives no rows; ids that aren't whole numbers are refused.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from windrose.llm import _text
from windrose.llm._common import col, whole_ids

SIZE = 300
_SPACE = 1
_SHIFT = np.uint64(21)


def _fold_table() -> np.ndarray:
    table = np.full(sys.maxunicode + 1, _SPACE, np.int32)
    for code in range(sys.maxunicode + 1):
        if (char := chr(code)).isalpha():
            low = char.lower()
            table[code] = ord(low[0]) if low[0].isalpha() else code
    return table


_FOLD: list[np.ndarray] = []


def _folded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded characters of all documents with single spaces between, and the document of each (that of a space is not meant)."""
    if not _FOLD:
        _FOLD.append(_fold_table())
    codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.int32)
    begins = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=begins[1:])
    size = np.diff(begins[offsets])
    doc = np.repeat(np.arange(len(size), dtype=np.int32), size)
    text = np.full(len(codes) + len(size) + 1, _SPACE, np.int32)
    at = np.arange(len(codes)) + doc + 1
    text[at] = _FOLD[0][codes]
    owner = np.zeros(len(text), np.int32)
    owner[at] = doc
    keep = np.ones(len(text), bool)
    keep[1:] = (text[1:] != _SPACE) | (text[:-1] != _SPACE)
    return text[keep], owner[keep]


def _counted(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, n-gram, count) of every distinct n-gram, by document and n-gram; n-grams are three code points in 63 bits, 0 for none."""
    text, owner = _folded(data, offsets)
    alphabet = np.unique(text)
    small = np.searchsorted(alphabet, text).astype(np.uint64) + np.uint64(1)
    bits = np.uint64(int(len(alphabet)).bit_length())
    letter = text != _SPACE
    one = np.flatnonzero(letter)
    two = np.flatnonzero(letter[:-1] | letter[1:])
    three = np.flatnonzero(letter[1:-1])
    of = owner.astype(np.uint64) << (np.uint64(3) * bits)
    key = np.concatenate((
        of[one] | small[one] << (bits + bits),
        np.where(letter[two], of[two], of[np.minimum(two + 1, len(of) - 1)]) | small[two] << (bits + bits) | small[np.minimum(two + 1, len(of) - 1)] << bits,
        of[three + 1] | small[three] << (bits + bits) | small[three + 1] << bits | small[np.minimum(three + 2, len(of) - 1)],
    ))
    key.sort()
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(key)))
    key = key[first]
    mask = (np.uint64(1) << bits) - np.uint64(1)
    wide = np.concatenate(([0], alphabet)).astype(np.uint64)
    gram = wide[key >> (bits + bits) & mask] << (_SHIFT + _SHIFT) | wide[key >> bits & mask] << _SHIFT | wide[key & mask]
    return (key >> (np.uint64(3) * bits)).astype(np.int64), gram, count


def gram_text(gram: int) -> str:
    codes = (gram >> 42, gram >> 21 & 0x1FFFFF, gram & 0x1FFFFF)
    return "".join(" " if c == _SPACE else chr(c) for c in codes if c)


def _language_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names: dict[str, int] = {}
    held: list[np.ndarray] = []
    kind = np.dtype([("lang", np.int64), ("gram", np.uint64), ("n", np.int64)])

    def merge() -> np.ndarray:
        rows = np.concatenate(held) if held else np.zeros(0, kind)
        order = np.lexsort((rows["gram"], rows["lang"]))
        rows = rows[order]
        new = np.ones(len(rows), bool)
        new[1:] = (rows["gram"][1:] != rows["gram"][:-1]) | (rows["lang"][1:] != rows["lang"][:-1])
        first = np.flatnonzero(new)
        out = rows[first]
        if len(first):
            out["n"] = np.add.reduceat(rows["n"], first)
        return out

    for batch in batches:
        data, offsets = _text.buffers(batch.column(0))
        labels = batch.column(1).to_pylist()
        index = np.array([names.setdefault(x, len(names)) for x in labels], np.int64)
        for a, b in _text.chunks(offsets, rows=8000):
            doc, gram, count = _counted(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            rows = np.empty(len(doc), kind)
            rows["lang"], rows["gram"], rows["n"] = index[a:b][doc], gram, count
            held.append(rows)
            if sum(map(len, held)) > 2_000_000:
                held[:] = [merge()]
    rows = merge()
    if len(rows):
        back = list(names)
        yield pa.RecordBatch.from_arrays(
            [pa.array([back[i] for i in rows["lang"].tolist()], pa.string()), pa.array(rows["gram"].view(np.int64)), pa.array(rows["n"])], ["lang", "gram", "n"]
        )


def profiles(labelled: DataFrame, size: int = SIZE, *, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, gram, rank) of the ``size`` most frequent n-grams of each language, over all labelled texts; ranks start at 0."""
    source = labelled.where(col(text).isNotNull() & col(lang).isNotNull()).select(col(text).alias("text"), col(lang).cast("string").alias("lang"))
    counts = source.mapInArrow(_language_counts, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram")) - 1
    return counts.withColumn("rank", rank).where(F.col("rank") < size).select("lang", "gram", "rank")


def _classifier(languages: list[str], grams: np.ndarray, ranks: np.ndarray, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = _text.buffers(batch.column(1))
            for a, b in _text.chunks(offsets, rows=8000):
                n = b - a
                doc, gram, count = _counted(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                start = np.searchsorted(doc, np.arange(n + 1))
                place = (np.arange(len(doc)) - start[doc]).astype(np.uint64)
                most = int(count.max(initial=0))
                wide, deep = int(place.max(initial=0)).bit_length(), most.bit_length()
                order = doc.astype(np.uint64) << np.uint64(wide + deep) | (most - count).astype(np.uint64) << np.uint64(wide) | place
                order.sort()
                rank = np.arange(len(doc)) - start[doc]
                top = np.flatnonzero(rank < size)
                at = start[doc[top]] + (order[top] & np.uint64((1 << wide) - 1)).astype(np.int64)
                gram, own, rank = gram[at], doc[top], rank[top]
                distance = np.zeros((n, len(languages)), np.int64)
                if len(gram) and len(languages):
                    where = np.minimum(np.searchsorted(grams, gram), len(grams) - 1)
                    theirs = np.where((grams[where] == gram)[:, None], ranks[where], -1)
                    apart = np.where(theirs < 0, size, np.abs(theirs - rank[:, None]))
                    some, first = np.unique(own, return_index=True)
                    distance[some] = np.add.reduceat(apart, first, axis=0)
                    best = distance.argmin(axis=1)
                else:
                    best = np.zeros(n, np.int64)
                known = np.zeros(n, bool)
                known[own] = bool(languages)
                guess = pa.array([languages[i] if k else None for i, k in zip(best.tolist(), known.tolist())], pa.string())
                least = np.where(known, distance[np.arange(n), best] if languages else 0, 0)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], guess, pa.array(least)], ["doc_id", "language", "distance"])

    return run


def identify(docs: DataFrame, trained: DataFrame, size: int = SIZE, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, language, distance) of every row of ``docs``; ``trained`` is the result of ``profiles``."""
    whole_ids(docs, doc_id)
    rows = trained.select("lang", "gram", "rank").toArrow()
    languages = sorted(set(rows.column("lang").to_pylist()))
    gram = rows.column("gram").to_numpy().view(np.uint64)
    grams = np.unique(gram)
    ranks = np.full((len(grams), len(languages)), -1, np.int64)
    of = pc.index_in(rows.column("lang"), pa.array(languages, pa.string())).to_numpy() if languages else np.zeros(0, np.int64)
    ranks[np.searchsorted(grams, gram), of] = rows.column("rank").to_numpy()
    source = docs.select(col(doc_id).cast("bigint").alias("doc_id"), col(text).alias("text"))
    return source.mapInArrow(_classifier(languages, grams, ranks, size), "doc_id bigint, language string, distance bigint")
