"""Cost-balanced sequence packing.

Documents become token ids, are cut where a sequence is full, and each part goes to the sequence that costs least so
far among those with room, largest parts first. The cost of a part of n tokens is linear + quadratic attention work.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import ids_of, small_batches

PIECE = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
_CUT = "bin long, doc_id long, start long, length long, doc_tokens long, raw binary"


def cost(n: np.ndarray | int, linear: float, quadratic: float):
    return linear * n + quadratic * n * n


def assign(lengths: list[int], capacity: int, linear: float = 1.0, quadratic: float = 1 / 1024) -> list[tuple[int, int, int, int, int]]:
    """Parts (document, start, length, sequence, offset) for documents of the given lengths, each at most `capacity`.

    As many sequences open as the tokens need. Documents descend by cost; each goes whole to the cheapest sequence with
    room for it. Where none has room, its first part fills the cheapest sequence that has any, and the rest goes on.
    """
    n = -(-sum(lengths) // capacity)
    room, spent = np.full(n, capacity), np.zeros(n)
    out = []
    for doc in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        start, left = 0, lengths[doc]
        while left:
            fits = np.flatnonzero(room >= left)
            if not len(fits):
                fits = np.flatnonzero(room > 0)
            seq = int(fits[np.argmin(spent[fits])])
            part = min(left, int(room[seq]))
            out.append((doc, start, part, seq, capacity - int(room[seq])))
            room[seq] -= part
            spent[seq] += cost(part, linear, quadratic)
            start, left = start + part, left - part
    return out


def pack(docs: DataFrame, capacity: int = 2048, end_id: int = 1, tokenizer: str | None = None, linear: float = 1.0, quadratic: float = 1 / 1024, docs_per_bin: int = 1000, bytes_per_bin: int = 4_000_000) -> DataFrame:
    """Pack every row of docs (doc_id, text); returns one row per piece, with its ids as little-endian unsigned 32-bit.

    Pieces of at most `capacity` ids are dealt to bins: piece k of a row goes to the bin of the row's hash plus k, and
    like rows count on, so neither a giant document nor one that fills the table makes a large bin. The dealing depends
    on the rows of a split alone, not on their order, so a task that is run again deals alike. Bins hold about
    `docs_per_bin` rows or `bytes_per_bin` bytes of text, whichever is less, whatever the table's size; each pads less
    than one sequence. Very long texts: as many pieces as they need; one text at a time is held in memory.

    Null text: as empty, so the end id alone. Repeated rows: each is packed. Null doc_id: kept, as null. Ties in
    length: by doc_id, then start, then ids. Empty table: no rows. Other columns of docs are ignored.
    """
    small_batches(docs.sparkSession)
    size = docs.agg(F.count("*").alias("n"), F.sum(F.octet_length(F.col("text").cast("string"))).alias("b")).first()
    bins = max(1, -(-size.n // docs_per_bin), -(-(size.b or 0) // bytes_per_bin))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids_, seen = ids_of(tokenizer), Counter()
        for pdf in batches:
            out = []
            for doc_id, text in zip(pdf.doc_id, pdf.text):
                ids = np.array([*(ids_.encode(text) if text else ()), end_id], dtype=ids_.kind)
                doc_id = None if pd.isna(doc_id) else int(doc_id)
                row = xxhash.xxh3_64_intdigest(f"{doc_id}\0{text or ''}".encode("utf-8", "surrogatepass"))
                at, seen[row] = row + seen[row], seen[row] + 1
                for start in range(0, len(ids), capacity):
                    part = ids[start : start + capacity]
                    out.append(((at + start // capacity) % bins, doc_id, start, len(part), len(ids), part.tobytes()))
            yield pd.DataFrame(out, columns=["bin", "doc_id", "start", "length", "doc_tokens", "raw"]).astype({"doc_id": "Int64"})

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "start", "raw"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
        first, kind, out = int(pdf.bin[0]) << 32, ids_of(tokenizer).kind, []
        for i, start, length, seq, offset in assign(pdf.length.tolist(), capacity, linear, quadratic):
            ids = np.frombuffer(pdf.raw[i], kind)[start : start + length]
            out.append((pdf.doc_id[i], int(pdf.start[i]) + start, length, int(pdf.doc_tokens[i]), first + seq, offset, ids.astype("<u4").tobytes()))
        return pd.DataFrame(out, columns=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

    parts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(cut, _CUT)
    return parts.groupBy("bin").applyInPandas(fill, PIECE)
