"""Edit-aware token counts: a segment tree over pre-token segments, re-encoded only where an edit touches them."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import Ids, ids_of, small_batches

#: (start, end, replacement) in code points of the text before the first edit; ascending, without overlap.
Edit = tuple[int, int, str]
# A space between two non-spaces opens a pre-token whatever else the text holds, so segments are cut before it.
_CUT = re.compile(r"(?<=\S) (?=\S)")


class CountTree:
    """Token and character counts of a text, by segment, summed up a binary tree.

    A segment is a run of whole pre-tokens of about `span` characters. An edit replaces the segments that it touches,
    with one character of context before and two behind; if their outer cuts still are cuts, no other segment changes.
    """

    def __init__(self, text: str, ids: Ids, span: int = 400):
        self.ids, self.span, self.encoded = ids, span, 0
        self._build(self._segments(text))

    def _segments(self, text: str) -> list[str]:
        out, start = [], 0
        while len(text) - start > self.span and (cut := _CUT.search(text, start + self.span)):
            out.append(text[start : cut.start()])
            start = cut.start()
        return [*out, text[start:]]

    def _count(self, text: str) -> int:
        n = len(self.ids.encode(text)) if text else 0
        self.encoded += n
        return n

    def _build(self, texts: list[str], tokens: list[int] | None = None) -> None:
        self.size = 1 << max(0, (len(texts) - 1).bit_length())
        self.texts = texts + [""] * (self.size - len(texts))
        self.chars, self.tokens = np.zeros(2 * self.size, np.int64), np.zeros(2 * self.size, np.int64)
        self.chars[self.size : self.size + len(texts)] = [len(t) for t in texts]
        self.tokens[self.size : self.size + len(texts)] = tokens if tokens is not None else [self._count(t) for t in texts]
        level = self.size
        while level > 1:
            for sums in (self.chars, self.tokens):
                sums[level // 2 : level] = sums[level : 2 * level].reshape(-1, 2).sum(axis=1)
            level //= 2

    @property
    def n_tokens(self) -> int:
        return int(self.tokens[1])

    @property
    def n_chars(self) -> int:
        return int(self.chars[1])

    def text(self) -> str:
        return "".join(self.texts)

    def _find(self, at: int) -> tuple[int, int]:
        """Slot that holds character `at`, and where it starts."""
        node, start = 1, 0
        while node < self.size:
            node *= 2
            if at >= start + self.chars[node] and self.chars[node + 1]:
                start += int(self.chars[node])
                node += 1
        return node - self.size, start

    def _set(self, slot: int, text: str, tokens: int) -> None:
        node = slot + self.size
        chars, tokens = len(text) - int(self.chars[node]), tokens - int(self.tokens[node])
        self.texts[slot] = text
        while node:
            self.chars[node] += chars
            self.tokens[node] += tokens
            node //= 2

    def edit(self, start: int, end: int, replacement: str) -> None:
        """Replace the characters [start, end) of the present text."""
        self.apply([(start, end, replacement)])

    def apply(self, edits: list[Edit]) -> None:
        """Make edits whose places refer to the present text; edits of adjoining segments are made, and counted, at once."""
        edits, total = sorted(edits, key=lambda e: e[:2]), self.n_chars
        for i, (start, end, _) in enumerate(edits):
            if not (edits[i - 1][1] if i else 0) <= start <= end <= total:
                raise ValueError(f"edit [{start}, {end}) is outside the text of {total} characters, or overlaps another")
        groups: list[tuple[int, int, int, list[Edit]]] = []  # first and last slot, where the first begins, edits
        for edit in edits:
            slot, begin = self._find(max(0, edit[0] - 2))
            last = self._find(min(total - 1, edit[1] + 1))[0] if total else slot
            if groups and slot <= groups[-1][1]:
                first, before, begin, inside = groups.pop()
                inside.append(edit)
                groups.append((first, max(before, last), begin, inside))
            else:
                groups.append((slot, last, begin, [edit]))
        grown = False
        for slot, last, begin, inside in reversed(groups):
            old, new, at = "".join(self.texts[slot : last + 1]), [], 0
            for start, end, replacement in inside:
                new += [old[at : start - begin], replacement]
                at = end - begin
            new.append(old[at:])
            parts = self._segments("".join(new))
            room = last - slot
            grown |= sum(map(len, parts[room:])) > 4 * self.span and len(parts) > room + 1
            parts = [*parts[:room], "".join(parts[room:])]
            for i in range(slot, last + 1):
                part = parts[i - slot] if i - slot < len(parts) else ""
                self._set(i, part, self._count(part))
        if grown:  # a slot that took in several segments: cut such slots anew, and keep the counts of the others
            kept = []
            for text, n in zip(self.texts, self.tokens[self.size :].tolist()):
                if len(text) > 4 * self.span and len(parts := self._segments(text)) > 1:
                    kept += [(part, self._count(part)) for part in parts]
                elif text:
                    kept.append((text, n))
            kept = kept or [("", 0)]
            self._build([t for t, _ in kept], [n for _, n in kept])


def apply_edits(tree: CountTree, edits: list[Edit]) -> None:
    tree.apply(edits)


def counts(docs: DataFrame, edits: Callable[[str], list[Edit]], tokenizer: str | None = None) -> DataFrame:
    """Token counts of every whole text of docs (doc_id, text) before and after its edits.

    Returns doc_id, n_tokens_before, n_tokens, n_chars (both after the edits), n_edits, n_reencoded (ids made anew for
    the edits). Null text: as empty, no edits, 0 tokens. Very long texts: segments touched are encoded once for all
    their edits; a text without spaces is one segment. Repeated rows: counted each. Null doc_id: kept. Empty table: no
    rows. Other columns are ignored.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = ids_of(tokenizer)
        for pdf in batches:
            out = []
            for text in pdf.text:
                tree = CountTree(text or "", ids)
                before, made = tree.n_tokens, tree.encoded
                todo = edits(text or "")
                apply_edits(tree, todo)
                out.append((before, tree.n_tokens, tree.n_chars, len(todo), tree.encoded - made))
            table = pd.DataFrame(out, columns=["n_tokens_before", "n_tokens", "n_chars", "n_edits", "n_reencoded"])
            table.insert(0, "doc_id", pdf.doc_id.to_numpy())
            yield table

    schema = "doc_id long, n_tokens_before long, n_tokens long, n_chars long, n_edits long, n_reencoded long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(run, schema)


# Every run of local-part characters is taken in one step, whether an address follows or not, so no character is tried twice.
_ADDRESS = re.compile(r"[\w.+-]++(@[\w-]++(?:\.[\w-]++)++)?")
_NUMBERS = re.compile(r"\d{1,3}(?:\.\d{1,3}){3}|\d{4,}")


def redactions(text: str) -> list[Edit]:
    """Edits that mask addresses and long numbers: the usual reason to count a document anew. Linear in the text."""
    out, at = [], 0
    for m in _ADDRESS.finditer(text):
        if m[1]:
            out += [(x.start(), x.end(), "<masked>") for x in _NUMBERS.finditer(text, at, m.start())]
            out.append((m.start(), m.end(), "<masked>"))
            at = m.end()
    return out + [(x.start(), x.end(), "<masked>") for x in _NUMBERS.finditer(text, at)]
