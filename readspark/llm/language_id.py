"""Language identification by rank-order profiles.

Method: a profile is the list of the most frequent character n-grams (one to three bytes
of lower-cased letters, with a mark at each end of a word), most frequent first. A
language's profile comes from the counts over all of its training texts; a document's is
compared with each by the out-of-place distance: for each of the document's n-grams how
far its rank is from the rank in the language's profile, or the whole length of the
profile if it isn't there. The language of least distance wins; the score is the share of
the distance to the others' mean that it saves (0 to 1).

The profiles are ``size`` n-grams for each language of the training rows, of which
there may be ``most_languages`` at most (checked), so they are small enough to send.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; ties go to
the language that sorts first; rows with a null or repeated ``doc_id`` are each
predicted (a null ``doc_id`` is held out, as its remainder is unknown); other columns
are not read; without training rows all is ``und``; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import stored
from ._text import LOWER, Texts, blocks, tidy

#: A byte's value in an n-gram: letters (lower-cased) and all bytes beyond ASCII as they are, all else the mark 0x20.
_LETTER = np.full(256, 0x20, np.uint8)
_LETTER[0x61:0x7B] = np.arange(0x61, 0x7B)
_LETTER[0x80:] = np.arange(0x80, 0x100)
UNKNOWN = "und"


def remainder(id_column: str, modulus: int) -> Column:
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % modulus


def _lower(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and of two-byte Latin capitals; all that is no letter becomes the mark."""
    out = _LETTER[LOWER[data]]
    after = np.flatnonzero(data[:-1] == 0xC3) + 1
    capital = after[(data[after] >= 0x80) & (data[after] <= 0x9E) & (data[after] != 0x97)]
    out[capital] += 32
    return out


def grams(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all n-grams of one to three bytes in a block, and the text of each.

    A code holds the bytes and the length; runs of marks count as one.
    """
    n = len(texts)
    sizes = np.diff(texts.offsets)
    # A mark before each text and one behind the last: no n-gram spans two texts.
    flat = np.full(len(texts.data) + n + 1, 0x20, np.uint8)
    owner = np.repeat(np.arange(n), sizes)
    at = np.arange(len(texts.data)) + owner + 1
    flat[at] = _lower(texts.data) if len(texts.data) else texts.data
    of = np.append(np.repeat(np.arange(n), sizes + 1), max(n - 1, 0))
    keep = np.ones(len(flat), bool)
    keep[1:] = (flat[1:] != 0x20) | (flat[:-1] != 0x20) | (of[1:] != of[:-1])
    flat, of = flat[keep].astype(np.uint32), of[keep]
    mark = flat == 0x20
    one = np.flatnonzero(~mark)
    two = np.flatnonzero((of[1:] == of[:-1]) & ~(mark[1:] & mark[:-1]))
    three = np.flatnonzero((of[2:] == of[:-2]) & ~mark[1:-1])
    codes = [flat[one] | np.uint32(1 << 24), flat[two] << 8 | flat[two + 1] | np.uint32(2 << 24), flat[three] << 16 | flat[three + 1] << 8 | flat[three + 2] | np.uint32(3 << 24)]
    return np.concatenate(codes), np.concatenate([of[one], of[two], of[three]])


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def train(docs: DataFrame, size: int = 400, most_languages: int = 1000, text_column: str = "text", lang_column: str = "lang") -> dict[str, list[int]]:
    """The profile of each language of ``docs``: n-gram codes, most frequent first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict[int, int]] = {}
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), object)
            for texts in blocks(batch.column(0), 1 << 20):
                codes, of = grams(texts)
                own = langs[texts.first : texts.first + len(texts)]
                for lang in set(own):
                    values, n = np.unique(codes[(own == lang)[of]], return_counts=True)
                    counts = held.setdefault(lang, {})
                    for v, k in zip(values.tolist(), n.tolist(), strict=True):
                        counts[v] = counts.get(v, 0) + k
        for lang, counts in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts), pa.string()), pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], ["lang", "gram", "n"])

    rows = docs.where(F.col(lang_column).isNotNull() & F.col(text_column).isNotNull()).select(F.col(text_column).alias("text"), F.col(lang_column).alias("lang"))
    counts = rows.mapInArrow(tidy(count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = stored(counts, "grams")
    langs = [r[0] for r in counts.select("lang").distinct().limit(most_languages + 1).collect()]
    if len(langs) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    # n-grams of three bytes at most: a group is bounded by the alphabet, whatever the number of texts.
    top = counts.groupBy("lang").agg(F.slice(F.reverse(F.sort_array(F.collect_list(F.struct("n", F.negative("gram").alias("g"))))), 1, size).alias("top"))
    return {r["lang"]: [-x["g"] for x in r["top"]] for r in top.collect()}


def predict(docs: DataFrame, profiles: dict[str, list[int]], size: int = 400, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(doc_id, lang_pred, score)`` of every row."""
    names = sorted(profiles)
    known = np.unique(np.array([g for p in profiles.values() for g in p], np.uint32))
    rank = np.full((len(names), len(known) + 1), size, np.int32)
    for k, name in enumerate(names):
        rank[k, np.searchsorted(known, np.array(profiles[name], np.uint32))] = np.arange(len(profiles[name]))

    def one(values: np.ndarray, n: np.ndarray) -> tuple[str, float]:
        order = np.lexsort((values, -n))[:size]
        values = values[order]
        place = np.minimum(np.searchsorted(known, values), len(known) - 1)
        place = np.where(known[place] == values, place, len(known))
        at = rank[:, place]
        distance = np.where(at < size, np.abs(at - np.arange(len(values))), size).sum(1)
        best = int(distance.argmin())
        others = (distance.sum() - distance[best]) / max(len(names) - 1, 1)
        score = 1.0 - float(distance[best]) / float(others) if others else (1.0 if len(names) == 1 else 0.0)
        return names[best], min(max(score, 0.0), 1.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            preds, scores = [], []
            readable = batch.column(2).to_pylist()
            for texts in blocks(batch.column(1), 1 << 20):
                codes, of = grams(texts)
                joined = np.sort(of.astype(np.uint64) << np.uint64(32) | codes)
                begins = np.flatnonzero(np.concatenate([[True], joined[1:] != joined[:-1]])) if len(joined) else np.zeros(0, np.int64)
                n = np.diff(np.append(begins, len(joined)))
                values, who = (joined[begins] & np.uint64(0xFFFFFFFF)).astype(np.uint32), joined[begins] >> np.uint64(32)
                bounds = np.searchsorted(who, np.arange(len(texts) + 1, dtype=np.uint64))
                for i in range(len(texts)):
                    a, b = bounds[i], bounds[i + 1]
                    pred, score = one(values[a:b], n[a:b]) if names and a < b and readable[texts.first + i] else (UNKNOWN, 0.0)
                    preds.append(pred)
                    scores.append(score)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(preds, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"), has_letter(F.col(text_column)).alias("readable"))
    return rows.mapInArrow(tidy(run), f"doc_id {docs.schema[id_column].dataType.simpleString()}, lang_pred string, score double")
