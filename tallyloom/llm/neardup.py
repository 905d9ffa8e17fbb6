"""Near-duplicate documents: MinHash bands propose, odd sketches screen, full shingle sets confirm.

An odd sketch folds a document's MinHash samples into a bitmap by parity: each sample flips one bit. Samples that two
documents share cancel in the XOR of their sketches, so its population count estimates how many differ, and it does so
most precisely for high similarities, where a pair has to be told from the threshold.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import Stages, mix, small_batches
from tallyloom.llm.graph import components

BANDS, ROWS, BITS, SET_BITS, CHUNK = 30, 4, 512, 2048, 256
#: Chunks of a bucket that one task compares with as many others.
DEALT = 8
#: Members outside a bucket's main component from which it is split by further bands, and how often.
HOT, SPLITS = 1024, 2
SAMPLES = BANDS * ROWS
_RNG = np.random.default_rng(20240229)
_A = _RNG.integers(0, 2**63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 2**63, SAMPLES, dtype=np.uint64)
_C = _RNG.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SIGNED = "doc_id long, n_shingles long, set_id binary, bands array<long>, sketch binary, parity binary"


def words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) runs of characters other than space and U+0009-000D."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingles(text: str | None, width: int) -> set[tuple[bytes, ...]]:
    """The text's distinct shingles, as words; a shorter text is one shingle, an empty one has none."""
    w = words(text)
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    w = words(text)
    if not w:
        return np.zeros(0, np.uint64)
    h, n = np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w)), min(width, len(w))
    total = np.full(len(w) - n + 1, n, np.uint64)
    for k in range(n):
        total += h[k : len(w) - n + 1 + k] * _C[k]
    return np.unique(mix(total))


def minhash(hashes: np.ndarray) -> np.ndarray:
    least = np.full(SAMPLES, np.iinfo(np.uint64).max)
    for i in range(0, len(hashes), 512):
        np.minimum(least, (hashes[i : i + 512, None] * _A + _B).min(axis=0), out=least)
    return least


def odd_sketch(samples: np.ndarray) -> bytes:
    at = mix(samples * _C[9] + np.arange(SAMPLES, dtype=np.uint64)) % np.uint64(BITS)
    return np.packbits(np.bincount(at.astype(np.int64), minlength=BITS).astype(np.uint8) & 1).tobytes()


def set_parity(hashes: np.ndarray) -> bytes:
    """The odd sketch of the whole set. The XOR of two has at most as many ones as elements are in only one of the sets."""
    at = hashes >> np.uint64(64 - SET_BITS.bit_length() + 1)
    return np.packbits(np.bincount(at.astype(np.int64), minlength=SET_BITS).astype(np.uint8) & 1).tobytes()


def similarity(differing_bits: int) -> float:
    """Estimated similarity for the population count of two sketches' XOR."""
    return 1 + BITS / (4 * SAMPLES) * math.log(max(1e-9, 1 - 2 * differing_bits / BITS))


def most_bits(least_similarity: float) -> int:
    """The population count that a pair of this estimated similarity has."""
    return math.ceil(BITS / 2 * (1 - math.exp(-4 * SAMPLES * (1 - least_similarity) / BITS)))


def signed(docs: DataFrame, width: int) -> DataFrame:
    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        row = np.arange(BANDS, dtype=np.uint64) * _C[8]
        for pdf in batches:
            out = []
            for doc_id, text in zip(pdf.doc_id, pdf.text):
                hashes = shingle_hashes(text, width)
                doc_id = None if pd.isna(doc_id) else int(doc_id)
                if not len(hashes):
                    out.append((doc_id, 0, None, None, None, None))
                    continue
                samples = minhash(hashes)
                bands = mix((samples.reshape(BANDS, ROWS) * _C[10 : 10 + ROWS]).sum(axis=1, dtype=np.uint64) + row)
                out.append((doc_id, len(hashes), xxhash.xxh3_128_digest(hashes.tobytes()), bands.view(np.int64), odd_sketch(samples), set_parity(hashes)))
            yield pd.DataFrame(out, columns=["doc_id", "n_shingles", "set_id", "bands", "sketch", "parity"]).astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(sign, _SIGNED)


class Screen:
    """Which pairs may link: the sketches' estimate is in reach, and the sets' difference is not provably too large.

    A link needs |A xor B| <= (|A| + |B|) (100 - percent) / (100 + percent); the parity sketch bounds the left from
    below, so this half of the screen loses nothing.
    """

    def __init__(self, percent: int, slack: float):
        self.percent, self.bits = percent, most_bits(percent / 100 - slack)

    def __call__(self, a: np.ndarray, a_n: np.ndarray, b: np.ndarray, b_n: np.ndarray) -> np.ndarray:
        """a, b: rows of sketch and parity as 64-bit words, broadcast against each other; so are the set sizes."""
        words = BITS // 64
        total = (a_n + b_n) * (100 - self.percent)
        keep = np.bitwise_count(a[..., :words] ^ b[..., :words]).sum(axis=-1, dtype=np.int32) <= self.bits
        return keep & (np.bitwise_count(a[..., words:] ^ b[..., words:]).sum(axis=-1, dtype=np.int64) * (100 + self.percent) <= total)


def _rows(sketches) -> np.ndarray:
    return np.frombuffer(b"".join(sketches), np.uint64).reshape(len(sketches), -1)


def _screened(pairs: DataFrame, screen: Screen) -> DataFrame:
    """Of pairs (a, a_sketch, a_n, b, b_sketch, b_n), the (a, b) that may link."""

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pdf.loc[screen(_rows(pdf.a_sketch), pdf.a_n.to_numpy(), _rows(pdf.b_sketch), pdf.b_n.to_numpy()), ["a", "b"]]

    return pairs.mapInPandas(keep, "a long, b long")


def _crossed(chunks: DataFrame, screen: Screen) -> DataFrame:
    """Of chunk pairs (a_*, b_* arrays, main), the (a, b) in different components that may link."""

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                a, b = np.asarray(row.a_node), np.asarray(row.b_node)
                b_part = np.asarray(row.b_part)
                open_ = (np.asarray(row.a_part)[:, None] != b_part) & ((b_part == row.main) | (a[:, None] < b))
                b_words, b_n = _rows(row.b_sketch), np.asarray(row.b_n)
                a_words, a_n = _rows(row.a_sketch), np.asarray(row.a_n)
                for i in np.flatnonzero(open_.any(axis=1)):
                    if len(hit := np.flatnonzero(open_[i])) and len(hit := hit[screen(a_words[i], a_n[i], b_words[hit], b_n[hit])]):
                        yield pd.DataFrame({"a": np.minimum(a[i], b[hit]), "b": np.maximum(a[i], b[hit])})

    return chunks.mapInPandas(keep, "a long, b long")


def _side(nodes: DataFrame, name: str) -> DataFrame:
    return nodes.select(F.col("node").alias(name), F.concat("sketch", "parity").alias(f"{name}_sketch"), F.col("n_shingles").alias(f"{name}_n"))


def _chunks(members: DataFrame, nodes: DataFrame, name: str, other: str, *by: str) -> DataFrame:
    """Members of each bucket in chunks of about CHUNK by a hash, each chunk dealt to every group of the other side's chunks.

    n_a and n_b hold how many members of a bucket each side has. A join on bucket, deal_a and deal_b then compares DEALT
    chunks with DEALT others under one key, whatever the bucket's size.
    """
    chunks = lambda x: F.ceil(F.greatest(F.col(f"n_{x}"), F.lit(1)) / CHUNK)
    groups = lambda x: F.ceil(chunks(x) / DEALT)
    chunk = F.pmod(F.xxhash64("node"), chunks(name)).alias("chunk")
    rows = members.join(nodes.select("node", "n_shingles", F.concat("sketch", "parity").alias("sketch")), "node").select("*", chunk, groups(name).alias("own"), groups(other).alias("others"))
    lists = (("node", "node"), ("component", "part"), ("n_shingles", "n"), ("sketch", "sketch"))
    rows = rows.groupBy("bucket", "chunk", "own", "others", *by).agg(*(F.collect_list(c).alias(f"{name}_{to}") for c, to in lists))
    return rows.select("*", F.pmod("chunk", "own").alias(f"deal_{name}"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("others") - 1)).alias(f"deal_{other}")).drop("own", "others", "chunk")


def _mixed(members: DataFrame) -> DataFrame:
    """Of buckets (bucket, component, ...) that span several components: the main one, n_b members, n_a of them outside it."""
    share = members.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    main = F.max_by("component", F.struct("n", "component")).alias("main")
    return share.groupBy("bucket").agg(main, F.sum("n").alias("n_b"), (F.sum("n") - F.max("n")).alias("n_a"), F.count("*").alias("k")).where("k > 1").drop("k")


def _split(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """Members of hot buckets by one further band that they share; of two bands, the later follows the earlier."""
    bands = nodes.select("node", F.posexplode("bands").alias("next", "other"))
    rows = members.join(bands, "node").where("next > band")
    rows = rows.select(F.xxhash64("bucket", "other").alias("bucket"), F.col("next").alias("band"), "node", "component")
    several = rows.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("bucket")
    return rows.join(several, "bucket")


def near_duplicates(docs: DataFrame, percent: int = 85, width: int = 5, slack: float = 0.2) -> DataFrame:
    """Documents of docs (doc_id, text) with their groups: doc_id, n_shingles, component_id, kept.

    Two documents are linked where 100 * |common shingles| >= percent * |union|; component_id is the smallest doc_id
    reachable over links, and kept says that it is the document's own.

    1. Documents with one and the same set form a class; its smallest doc_id stands for it from here on.
    2. In each band bucket every member is paired with the bucket's smallest, never with all others.
    3. Pairs whose sketches estimate a similarity under percent/100 - slack (six standard deviations), or prove too many
       differing shingles, are let go; the others are confirmed on their full sets; components follow.
    4. Within buckets that still span several components, pairs across components are screened in the same way, a chunk
       of members against another, and confirmed; components follow again. A bucket with more than HOT members outside
       its main component is split by further bands first. So a pair that shares a bucket is left unchecked only where
       its ends are already in one component, or where it shares no second (at the second split, no third) band.

    30 bands of 4 rows miss a pair of similarity 0.85 with probability 3e-10, and one of 0.8 with 1e-7; in a bucket split
    twice, with 2e-7 and 3e-5. Very long texts: all their shingles. Null or empty texts, or white space only: n_shingles 0, a component of their own. Texts under `width` words: one
    shingle. Null doc_id: component_id null where the whole class has none, kept as null-safe equality. Rows that share
    a doc_id count as one document and come back once each. Empty table: no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    stages = Stages(spark, "neardup")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sigs = stages.put(signed(docs, width), "sigs")
    classes = stages.put(sigs.where("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("node")).where("node is not null"), "classes")
    nodes = sigs.join(classes.select(F.col("set_id").alias("of"), "node"), (F.col("doc_id") == F.col("node")) & (F.col("set_id") == F.col("of"))).select("node", "n_shingles", "bands", "sketch", "parity")
    nodes = stages.put(nodes, "nodes")
    in_bands = nodes.select("node", F.posexplode("bands").alias("band", "bucket"))
    leaders = in_bands.groupBy("bucket").agg(F.min("node").alias("leader"), F.count("*").alias("n")).where("n > 1")
    leaders = stages.put(leaders, "leaders")
    met = stages.put(in_bands.join(leaders, "bucket"), "met")
    moved = met.select(F.col("node").alias("doc_id")).distinct()
    # the hint keeps one plan at every size: the texts of documents that share a bucket are moved once
    texts = stages.put(docs.join(moved.hint("merge"), "doc_id", "left_semi"), "texts")
    pairs = met.where("node <> leader").select(F.col("node").alias("b"), F.col("leader").alias("a")).distinct()
    screen = Screen(percent, slack)
    pairs = _screened(pairs.join(_side(nodes, "b"), "b").join(_side(nodes, "a"), "a").select("a", "a_sketch", "a_n", "b", "b_sketch", "b_n"), screen)
    edges = _confirmed(texts, pairs, stages, "star", percent, width)
    groups = stages.put(components(edges, stages, "cc1"), "groups")

    wide = met.where("n > 2 and node <> leader").join(groups, "node", "left").select("bucket", "band", "node", F.coalesce("component", "node").alias("component"))
    open_ = stages.put(wide, "open-0")
    for turn in range(SPLITS + 1):
        mixed = stages.put(_mixed(open_), f"mixed-{turn}")
        hot = mixed.where(F.col("n_a") > HOT).select("bucket") if turn < SPLITS else None
        few = mixed if hot is None else mixed.where(F.col("n_a") <= HOT)
        ready = stages.put(open_.join(few, "bucket"), f"ready-{turn}")
        waiting = ready if turn == 0 else waiting.unionByName(ready)
        if hot is None or hot.isEmpty():
            break
        open_ = stages.put(_split(open_.join(hot, "bucket", "left_semi"), nodes), f"open-{turn + 1}")
    few = stages.put(_chunks(waiting.where("component <> main"), nodes, "a", "b"), "few")
    rest = stages.put(_chunks(waiting, nodes, "b", "a", "main"), "rest")
    across = _crossed(few.join(rest, ["bucket", "deal_a", "deal_b"]), screen).distinct()
    more = _confirmed(texts, across, stages, "across", percent, width)
    if more.isEmpty():
        final = groups
    else:
        final = stages.put(components(edges.unionByName(more), stages, "cc2"), "final")
    labels = classes.join(final, "node", "left").select("set_id", F.coalesce("component", "node").alias("component_id"))
    labels = stages.put(labels, "labels")
    out = sigs.select("doc_id", "n_shingles", "set_id").join(labels, "set_id", "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    # rows that share a doc_id but not a text still are one document
    out = out.select("*", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
    stages.drop("nodes", "leaders", "met", "texts", "star-pairs", "star-links", "groups", "few", "rest", *(f"{x}-{i}" for i in range(SPLITS + 1) for x in ("open", "mixed", "ready")), "across-pairs", "across-links", "classes", "final", "cc1-0", "cc2-0")
    return out


def _confirmed(texts: DataFrame, pairs: DataFrame, stages: Stages, name: str, percent: int, width: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough."""
    pairs = stages.put(pairs, f"{name}-pairs")

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: tuple = (None, None)
        for pdf in batches:
            keep = []
            for a, b in zip(pdf.a_text, pdf.b_text):
                if last[0] != a:
                    last = (a, shingles(a, width))
                other = shingles(b, width)
                common = len(last[1] & other)
                keep.append(100 * common >= percent * (len(last[1]) + len(other) - common))
            yield pdf.loc[keep, ["a", "b"]]

    side = lambda x: texts.select(F.col("doc_id").alias(x), F.col("text").alias(f"{x}_text"))
    checked = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "a_text", "b_text").mapInPandas(check, "a long, b long")
    return stages.put(checked.distinct(), f"{name}-links")
