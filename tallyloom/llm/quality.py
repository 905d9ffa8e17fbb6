"""Quality classifier: logistic regression on hashed word n-grams, as sparse dot products."""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame

from tallyloom.llm.common import Cache, small_batches
from tallyloom.llm.linear import Features, fit, score, training_rows

SIZE = 1 << 18
_UPPER, _LOWER, _DIGIT = re.compile(r"[A-ZÀ-ÖØ-Þ]+"), re.compile(r"[^\W\d_A-ZÀ-ÖØ-Þ]+"), re.compile(r"\d+")


def shape(word: str) -> str:
    """The word with runs of capitals, other letters and digits as one sign each, and punctuation as it is."""
    return _DIGIT.sub("9", _LOWER.sub("x", _UPPER.sub("X", word)))


def _hash(s: str) -> int:
    return zlib.crc32(s.encode("utf-8", "surrogatepass"))


_AT = Cache(lambda w: (_hash(w.lower()), _hash("~" + shape(w))))


def features(text: str) -> Features:
    """Hashed word unigrams and bigrams, over the words and over their shapes, and adjacent repeats.

    Each of the families has the total value SCALE, shared by its members in proportion to their counts.
    """
    words = text.split()
    if not words:
        return np.zeros(0, np.int64), np.zeros(0)
    pairs = np.array([_AT[w] for w in words], np.uint64)
    word, form = pairs[:, 0], pairs[:, 1]
    two = lambda h: (h[:-1] * np.uint64(0x9E3779B1) + h[1:]) & np.uint64(0xFFFFFFFF)
    again = np.where(word[1:] == word[:-1], np.uint64(11), np.uint64(12))
    families = [word, two(word), form, two(form), again]
    at, value = [], []
    for k, h in enumerate(families):
        if len(h):
            i, n = np.unique((h + np.uint64(k * 7919)) % np.uint64(SIZE - 1) + np.uint64(1), return_counts=True)
            at.append(i.astype(np.int64))
            value.append(n * (SCALE / len(h)))
    i, where = np.unique(np.concatenate(at), return_inverse=True)
    return i, np.bincount(where, np.concatenate(value), len(i))


SCALE = 4.0


def quality(docs: DataFrame, labels: DataFrame, fold: Column, label: str = "quality", most_rows: int = 6000, cut: float = 0.3) -> DataFrame:
    """Score every whole text of docs (doc_id, text), learning from labels (doc_id, label) where `fold` holds.

    Returns doc_id, score (0 to 1), predicted (1 where score >= cut). The model is fitted on at most `most_rows`
    labelled documents, chosen by a hash of doc_id (see training_rows). Null and empty texts: the intercept's score.
    Very long texts: scored whole, by at most as many features as they have words. No labels: every score is 0.5.
    Repeated rows: scored each. Empty table: no rows. Null doc_id: kept. Null or contradicting labels: not learned
    from. Other columns: ignored.
    """
    small_batches(docs.sparkSession)
    rows = training_rows(docs, labels, label, fold, most_rows, lambda text: [features(text)])
    return score(docs, features, fit([(made[0], y) for _, made, y in rows], SIZE, alpha=0.3, l1=0.3), cut)
