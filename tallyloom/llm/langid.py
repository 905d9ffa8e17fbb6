"""Language identification by compression: the language whose dictionary encodes a text in the fewest bytes."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.common import below, mix, small_batches

_NO_LETTERS = re.compile(r"[\W\d_]+")
# Word characters that are no letters: fractions, raised, circled and other numerals, which \d leaves out.
_NUMERALS = {c: " " for c in map(chr, range(sys.maxunicode + 1)) if c.isnumeric() and not (c.isalpha() or c.isdecimal())}
_BLANKED = str.maketrans(_NUMERALS)
#: Texts are encoded in pieces of so many bytes, so that the dictionary matters all along a long text.
PIECE_BYTES = 4096
#: Learning texts are put into a dictionary in snippets of so many bytes.
SNIPPET_BYTES = 256


def letters(text: str | None) -> bytes:
    """The lower-cased letters of a text; every run of other characters is one space, so that layout tells nothing."""
    text = (text or "").lower()
    if not (text.isascii() or _NUMERALS.keys().isdisjoint(text)):
        text = text.translate(_BLANKED)
    return _NO_LETTERS.sub(" ", text).strip().encode("utf-8", "surrogatepass")


class Coder:
    """Compressors with raw-content dictionaries for each language; ties go to the language named first.

    Each language has one for its whole dictionary, and for narrow cases one for each slice of it: a short text finds few
    matches, and the sum over slices tells languages apart by less than a byte of one encoding.
    """

    def __init__(self, dictionaries: dict[str, bytes], level: int = 9, slice_bytes: int = 8000, narrow: int = 8):
        self.names, self.narrow = list(dictionaries), narrow
        self.coarse = [[self._compressor(d, level)] for d in dictionaries.values()]
        slices = max(1, max((len(d) for d in dictionaries.values()), default=0) // slice_bytes)
        self.fine = [[self._compressor(d[i * len(d) // slices : (i + 1) * len(d) // slices], level, min_match=3) for i in range(slices)] for d in dictionaries.values()]

    @staticmethod
    def _compressor(dictionary: bytes, level: int, **params) -> zstandard.ZstdCompressor:
        params = zstandard.ZstdCompressionParameters.from_level(level, write_content_size=False, write_checksum=False, write_dict_id=False, **params)
        raw = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        raw.precompute_compress(compression_params=params)
        return zstandard.ZstdCompressor(dict_data=raw, compression_params=params)

    def predict(self, text: str | None, temperature: float = 3.0) -> tuple[str, float, float, float]:
        """Language, score, margin (by how many bytes the second language's encoding is longer), bytes of its own.

        Where the languages are within `narrow` bytes, the text is encoded anew with every slice, and the means count.
        """
        raw = letters(text)
        if not raw or not self.names:
            return "und", 0.0, 0.0, 0.0
        pieces = [raw[i : i + PIECE_BYTES] for i in range(0, len(raw), PIECE_BYTES)]
        for languages in (self.coarse, self.fine):
            sizes = np.array([sum(len(c.compress(p)) for p in pieces for c in cs) / len(cs) for cs in languages])
            away = sizes - sizes.min()
            margin = float(np.partition(away, 1)[1]) if len(away) > 1 else float(len(raw))
            if margin >= self.narrow:
                break
        return self.names[int(sizes.argmin())], float(1 / np.exp(-np.minimum(away, 200) / temperature).sum()), margin, float(sizes.min())


def dictionaries(docs: DataFrame, fold: Column, rows_per_language: int = 256, dictionary_bytes: int = 96_000) -> dict[str, bytes]:
    """For each language, most frequent first, a dictionary made of a bounded sample of its rows.

    The sample is the `rows_per_language` documents of smallest hash of doc_id, with their whole texts; of the snippets
    of all these texts the dictionary takes those of smallest hash, up to `dictionary_bytes`. Of rows that share doc_id
    and language, the one of smallest text hash is learned from. Two passes over docs, whatever the number of languages.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & fold)
    known = known.select(F.col("lang").cast("string").alias("lang"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = {r.lang: (r.n, r.docs) for r in known.groupBy("lang").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs")).collect()}
    if not counts:
        return {}
    # twice as many documents as are wanted have a hash under this; only these are ranked
    reach = F.create_map(*(F.lit(x) for lang, (_, n) in counts.items() for x in (lang, below(min(1.0, 2 * rows_per_language / n)))))
    first = lambda *order: F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    ids = known.select("lang", "doc_id", F.xxhash64("doc_id", F.lit(5)).alias("h")).where(F.col("h") <= reach[F.col("lang")])
    # a doc_id may fill the table: its rows meet in the partial aggregate, only then the smallest hashes are taken
    ids = ids.groupBy("lang", "doc_id").agg(F.first("h").alias("h")).withColumn("r", first("h", "doc_id")).where(F.col("r") <= rows_per_language).select("lang", "doc_id")
    texts = known.join(F.broadcast(ids), ["lang", "doc_id"]).groupBy("lang", "doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    most = -(-dictionary_bytes // SNIPPET_BYTES)

    def snippets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lang, doc_id, text in zip(pdf.lang, pdf.doc_id, pdf.text):
                raw = letters(text)
                at = np.arange(0, len(raw), SNIPPET_BYTES)
                h = mix(at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + mix(np.full(len(at), doc_id, np.int64).view(np.uint64))).view(np.int64)
                best = np.argsort(h, kind="stable")[:most]
                yield pd.DataFrame({"lang": lang, "h": h[best], "doc_id": doc_id, "part": [raw[i : i + SNIPPET_BYTES] for i in at[best]]})

    parts = texts.mapInPandas(snippets, "lang string, h long, doc_id long, part binary").withColumn("r", first("h", "doc_id", "part")).where(F.col("r") <= most)
    held: dict[str, list[tuple[int, bytes]]] = {}
    for r in parts.select("lang", "r", "part").collect():
        held.setdefault(r.lang, []).append((r.r, bytes(r.part)))
    return {lang: b" ".join(part for _, part in sorted(held.get(lang, [])))[:dictionary_bytes] for lang, _ in sorted(counts.items(), key=lambda x: (-x[1][0], x[0]))}


def identify(docs: DataFrame, fold: Column, least_margin: int = 1, least_share: float = 0.01, rows_per_language: int = 256, columns: list[str] | None = None) -> DataFrame:
    """Predict the language of every whole text of docs (doc_id, text, lang), learning from rows where `fold` holds.

    Returns doc_id, lang_pred, score (0 to 1), margin (bytes to the second language), rejected. A text is rejected where
    it is `und` (null, empty, or without a letter), or where its margin is narrow: under `least_margin` bytes (a tie, by
    default) or under the share `least_share` of its own encoding. Ties go to the language with most rows. Rows with
    null lang are predicted, not learned from. No labelled rows: every text is `und`. Very long texts: encoded whole,
    4 kB at a time. Repeated rows: predicted each; empty table: no rows. Other columns: ignored,
    but where `columns` names columns of docs to return in place of doc_id, whatever their names.
    """
    spark = docs.sparkSession
    small_batches(spark)
    keep = [f for f in docs.select(*(columns or [F.col("doc_id").cast("long").alias("doc_id")])).schema.fields]
    learned = spark.sparkContext.broadcast(dictionaries(docs, fold, rows_per_language))
    # columns that pass through travel under numbers, so none of their names can clash
    passed = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(keep)])
    found = "lang_pred string, score double, margin double, rejected boolean"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = Coder(learned.value)
        for pdf in batches:
            out = pd.DataFrame([coder.predict(t) for t in pdf._text], columns=["lang_pred", "score", "margin", "size"])
            narrow = (out.margin < least_margin) | (out.margin < least_share * out["size"])
            out["rejected"] = (out.lang_pred == "und") | narrow
            yield pd.concat([pdf[passed.names].reset_index(drop=True), out.drop(columns="size")], axis=1)

    wanted = [F.col(f.name).cast(f.dataType).alias(f"c{i}") for i, f in enumerate(keep)]
    out = docs.select(*wanted, F.col("text").cast("string").alias("_text")).mapInPandas(run, T.StructType([*passed.fields, *T._parse_datatype_string(found).fields]))
    return out.select(*(F.col(f"c{i}").alias(f.name) for i, f in enumerate(keep)), "lang_pred", "score", "margin", "rejected")
