"""Toxicity classifier with a counterfactual penalty: swapping identity terms must not move the score."""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame

from tallyloom.llm.common import Cache, small_batches
from tallyloom.llm.linear import Features, fit, score, training_rows

SIZE = 1 << 18
STEMS = (4, 5)
#: L1 strength: most word beginnings of rare toxic documents are chance, and only those that keep coming may weigh.
SPARSE = 8.0
_WORD = re.compile(r"[^\W_]+")

# Neutral terms for groups of people, and the term each is swapped for.
IDENTITY_SWAPS = {
    "women": "men", "woman": "man", "girls": "boys", "girl": "boy", "female": "male",
    "muslim": "christian", "muslims": "christians", "jewish": "catholic", "jews": "catholics", "hindu": "buddhist",
    "black": "white", "asian": "european", "african": "american", "latino": "nordic", "immigrant": "citizen", "immigrants": "citizens",
    "gay": "straight", "lesbian": "heterosexual", "transgender": "cisgender", "old": "young", "disabled": "abled", "blind": "sighted", "deaf": "hearing",
    "femmes": "hommes", "musulman": "chrétien", "juif": "catholique", "frauen": "männer", "muslimisch": "christlich", "jüdisch": "katholisch",
    "mujeres": "hombres", "musulmán": "cristiano", "judío": "católico",
}
_SWAP = IDENTITY_SWAPS | {b: a for a, b in IDENTITY_SWAPS.items()}


def _places(word: str) -> tuple[int, ...]:
    keys = (word, *(f"{n}^{word[:n]}" for n in STEMS))
    return tuple(1 + zlib.crc32(k.encode("utf-8", "surrogatepass")) % (SIZE - 1) for k in keys)


_AT = Cache(_places)


def features(text: str, swapped: bool = False) -> Features:
    """Hashed words and word beginnings of the lower-cased text; a value is 1 for the first sight and grows with the log."""
    words = _WORD.findall(text.lower())
    if swapped:
        words = [_SWAP.get(w, w) for w in words]
    if not words:
        return np.zeros(0, np.int64), np.zeros(0)
    at, n = np.unique(np.fromiter((i for w in words for i in _AT[w]), np.int64, (1 + len(STEMS)) * len(words)), return_counts=True)
    return at, np.minimum(1 + np.log(n), 3) if len(n) else n


def has_identity(text: str) -> bool:
    return not _SWAP.keys().isdisjoint(_WORD.findall(text.lower()))


def with_twin(text: str) -> list[Features]:
    """The text's features, and where it holds an identity term, those of its counterfactual, in which terms are swapped."""
    return [features(text), features(text, True)] if has_identity(text) else [features(text)]


def train(rows: list[tuple[list[Features], int]], fairness: float = 1.0) -> np.ndarray:
    """Weights from (with_twin(text), label)."""
    return fit([(made[0], label) for made, label in rows], SIZE, twins=[made[1] if len(made) > 1 else None for made, _ in rows], fairness=fairness, alpha=0.3, l1=SPARSE)


def toxicity(docs: DataFrame, labels: DataFrame, fold: Column, label: str = "toxic", most_rows: int = 8000, fairness: float = 1.0, cut: float = 0.3) -> DataFrame:
    """Score every whole text of docs (doc_id, text), learning from labels (doc_id, label) where `fold` holds.

    Returns doc_id, score (0 to 1), predicted (1 where score >= cut). The model is fitted on at most `most_rows`
    labelled documents, chosen by a hash of doc_id (see training_rows). Null and empty texts: the intercept's score.
    Very long texts: scored whole, by at most as many features as they have words. No labels: every score is 0.5.
    Repeated rows: scored each. Empty table: no rows. Null doc_id: kept. Null or contradicting labels: not learned
    from. Other columns: ignored.
    """
    small_batches(docs.sparkSession)
    rows = training_rows(docs, labels, label, fold, most_rows, with_twin)
    return score(docs, features, train([(made, y) for _, made, y in rows], fairness), cut)
