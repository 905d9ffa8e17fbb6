"""Near-duplicate lines: a segment-partition edit join over the distinct lines of a corpus.

Two lines within k edits, the shorter cut into k + 1 segments, agree in at least one segment, at a place that k and
their lengths bound. Segments are indexed by length and number, the few admissible substrings of each line probe them,
and a banded bit-parallel edit distance confirms.
"""

from __future__ import annotations

import os.path
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm import neardup
from tallyloom.llm.common import Stages, mix, partitions, small_batches
from tallyloom.llm.graph import components

MOST_EDITS = 2
#: Characters of lines that are hashed together.
CHARS = 1_000_000
#: One distinct line in so many tells which keys are common.
SAMPLE = 64
_SPACE = " \t\n\x0b\x0c\r"


def allowed(length: int) -> int:
    """Edits that a line of this length may differ by: none under 10 characters, 1 under 20, else 2."""
    return min(MOST_EDITS, length // 10)


#: Any odd multiplier has an inverse modulo 2**64: a difference of prefix sums, taken back to place 0, hashes a substring.
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 2**64)


def _cut(lengths: np.ndarray, k: int, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of segment i of k + 1 of nearly the same size, the longer ones last, for lines of these lengths."""
    size, longer = np.divmod(lengths, k + 1)
    return i * size + np.maximum(0, i - (k + 1 - longer)), size + (i >= k + 1 - longer)


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers 0 to n, at least, of the step and of its inverse; kept for the next batch up to CHARS."""
    if len(_POWERS[0]) > n:
        return _POWERS
    out = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, CHARS // 8), base, np.uint64)])) for base in (_STEP, _BACK)]
    if n <= CHARS:
        _POWERS[:] = out
    return out


def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Ids and lines of (id, line), in parts of about CHARS characters or one row: memory is bounded by the longest line."""
    for batch in batches:
        ids, lines = batch.column("id").to_numpy(zero_copy_only=False), batch.column("line").to_pylist()
        at = np.cumsum(np.fromiter(map(len, lines), np.int64, len(lines))) // CHARS
        cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(lines)]
        yield from ((ids[i:j], lines[i:j]) for i, j in zip(cuts, cuts[1:]) if i < j)


def keys_of(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, place of its line, held) of the substrings under which lines meet, each key of a line once.

    A line probes with every row: under the key of a segment that a line no longer than it, and within the edits which
    that one is allowed, may have in common with it. Multi-match-aware: segment i of k + 1 may be off by i from the left
    and by k - i from the right. held marks its own segments, which a line is found by; these are among its probes.
    """
    lengths = np.fromiter(map(len, lines), np.int64, len(lines))
    begin = np.cumsum(lengths) - lengths
    code = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    forth, back = _powers(len(code))
    sums = np.zeros(len(code) + 1, np.uint64)
    np.cumsum(code * forth[: len(code)], out=sums[1:])
    keys, owns, helds = [], [], []
    for delta in range(MOST_EDITS + 1):
        short = lengths - delta
        edits = np.minimum(MOST_EDITS, np.maximum(0, short) // 10)
        for k in range(max(1, delta), MOST_EDITS + 1):
            own = np.flatnonzero(edits == k)
            n, first = lengths[own], begin[own]
            for i in range(k + 1):
                s, m = _cut(n - delta, k, i)
                low, high = np.maximum(0, np.maximum(s - i, s + delta - (k - i))), np.minimum(n - m, np.minimum(s + i, s + delta + (k - i)))
                for shift in range(2 * k + 1):
                    can = low + shift <= high
                    at = (first + low + shift)[can]
                    part = (sums[at + m[can]] - sums[at]) * back[at]
                    keys.append(mix(part + mix((short[own][can] * 4 + i).astype(np.uint64))))
                    owns.append(own[can])
                    helds.append((delta == 0) & (low + shift == s)[can])
    key, own, held = np.concatenate(keys).view(np.int64), np.concatenate(owns), np.concatenate(helds)
    order = np.lexsort((~held, key, own))
    key, own, held = key[order], own[order], held[order]
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (own[1:] != own[:-1])])[: len(key)]
    return key[new], own[new], held[new]


def index_keys(line: str) -> list[int]:
    key, _, held = keys_of([line])
    return key[held].tolist()


def probe_keys(line: str) -> list[int]:
    return keys_of([line])[0].tolist()


def within(a: str, b: str, k: int) -> bool:
    """Whether the edit distance of a and b is at most k: a band of 2k + 1 diagonals, one bit each, per distance so far.

    state[e] holds the diagonals that e edits reach furthest on; here the band advances one character of `a` at a time.
    """
    if abs(len(a) - len(b)) > k:
        return False
    cut = len(os.path.commonprefix((a, b)))
    a, b = a[cut:], b[cut:]
    tail = len(os.path.commonprefix((a[::-1], b[::-1])))
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if min(len(a), len(b)) == 0:
        return max(len(a), len(b)) <= k
    width = 2 * k + 1
    full = (1 << width) - 1
    # bit d of state[e]: prefix of a up to i and prefix of b up to i + d - k are within e edits
    state = [0] * (k + 1)
    for e in range(k + 1):
        state[e] = sum(1 << d for d in range(k, k + e + 1) if d - k <= len(b))
    for i, ch in enumerate(a):
        match = valid = 0
        for d in range(width):
            j = i + 1 + d - k  # characters of b used with i + 1 of a
            if 0 <= j <= len(b):
                valid |= 1 << d
                if j and b[j - 1] == ch:
                    match |= 1 << d
        before, state = state, [0] * (k + 1)
        for e in range(k + 1):
            now = before[e] & match
            if e:
                now |= before[e - 1]  # substitution
                now |= before[e - 1] >> 1  # a's character is dropped
                now |= state[e - 1] << 1  # b's character is added
            state[e] = now & valid & full
        if not state[k]:
            return False
    end = len(b) - len(a) + k
    return 0 <= end < width and bool(state[k] >> end & 1)


SIGN_WORDS = 4


def signatures(lines: list[str]) -> np.ndarray:
    """Parity bitmaps of the lines' adjacent character pairs. One edit takes two pairs at most and adds two, so the XOR of
    the bitmaps of lines within e edits has at most 4 e ones: a screen that loses no link."""
    code = np.frombuffer("".join(f"\0{x}\0" for x in lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    own = np.repeat(np.arange(len(lines)), np.fromiter((len(x) + 2 for x in lines), np.int64, len(lines)))
    inside, width = own[:-1] == own[1:], 64 * SIGN_WORDS
    at = mix(code[:-1] * np.uint64(0x100000001B3) + code[1:]) % np.uint64(width)
    counts = np.bincount(own[:-1][inside] * width + at[inside].astype(np.int64), minlength=width * len(lines))
    return np.packbits((counts & 1).astype(np.uint8).reshape(-1, width), axis=1).view(np.int64)


def signature(line: str) -> np.ndarray:
    return signatures([line])[0]


def lines_of(text: Column) -> Column:
    """The lines of a text, without white space at their ends."""
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: F.btrim(x, F.lit(" \t\x0b\x0c\r")))


def line_id(line: Column, seed: int = 17) -> Column:
    return F.xxhash64(line, F.lit(seed))


def _by_id(lines: DataFrame) -> DataFrame:
    """Distinct lines of (id, line, doc_id, row, at): id, line, first place, n, and whether another line has the same id."""
    place = F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("doc_id"), "row", "at")
    mark = line_id(F.col("line"), 91)
    return lines.groupBy("id").agg(F.min("line").alias("line"), F.min(place).alias("first"), F.count("*").alias("n"), (F.min(mark) != F.max(mark)).alias("shared"))


def linked_lines(lines: DataFrame, stages: Stages) -> DataFrame:
    """Pairs (a, b) of ids of distinct lines (id, line) that lie within the edits that the shorter one is allowed."""
    small_batches(lines.sparkSession)

    hot = np.array(_common_keys(lines, stages), np.int64)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, part in shares(batches):
            key, own, held = keys_of(part)
            common = np.isin(key, hot)
            arrays = [pa.array(np.where(common, ids[own], key)), pa.array(ids[own]), pa.array(held), pa.array(key, mask=~common)]
            yield pa.RecordBatch.from_arrays(arrays, ["home", "id", "held", "common"])

    # a key matters only where different lines meet at it, one of them held. Rows move to the home of their key once and
    # are kept or let go there; a window's group is no larger than a common key's least size, as those meet anyway
    home = Window.partitionBy("home")
    dealt = lines.select("id", "line").mapInArrow(keys, "home long, id long, held boolean, common long")
    seen = dealt.select("*", F.min("id").over(home).alias("lo"), F.max("id").over(home).alias("hi"), F.max("held").over(home).alias("any"))
    few = seen.where("lo <> hi and any or common is not null").select(F.coalesce("common", "home").alias("key"), "id", "held")
    few = stages.put(few, "keyed")
    texts = stages.put_by(_signed(lines.join(few.select("id").distinct().hint("shuffle_hash"), "id", "left_semi")), "texts", "id")
    words = [f"s{i}" for i in range(SIGN_WORDS)]
    side = lambda x: few.join(texts.drop("line"), "id").select("key", F.col("held").alias(f"{x}_held"), F.col("id").alias(x), *(F.col(w).alias(f"{x}_{w}") for w in words))
    apart = sum((F.bit_count(F.col(f"p_{w}").bitwiseXOR(F.col(f"q_{w}"))) for w in words), F.lit(0))
    # of two lines held under one key, each would find the other: once is enough
    once = (F.col("p") != F.col("q")) & (~F.col("p_held") | (F.col("p") < F.col("q")))
    pairs = side("p").join(side("q").where("q_held"), "key").where(once & (apart <= 4 * MOST_EDITS))
    pairs = stages.put(pairs.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct(), "pairs")

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.loc[[within(x, y, allowed(min(len(x), len(y)))) for x, y in zip(pdf.x, pdf.y)], ["a", "b"]]

    line = lambda i, t: texts.select(F.col("id").alias(i), F.col("line").alias(t))
    found = pairs.join(line("a", "x"), "a").join(line("b", "y"), "b").select("a", "b", "x", "y").mapInPandas(check, "a long, b long")
    found = stages.put(found, "links")
    stages.drop("common", "keyed", "pairs", "texts")
    return found


def _common_keys(lines: DataFrame, stages: Stages) -> list[int]:
    """Keys that more lines have than an even share of all lines in one partition, found on one line in SAMPLE.

    A line has at most 12 keys, so there are at most 12 such keys for each partition, whatever the size of the corpus.
    The list only decides how rows are dealt: a key that it misses is met at home like any other.
    """

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, part in shares(batches):
            yield pa.RecordBatch.from_arrays([pa.array(keys_of(part)[0])], ["key"])

    least = max(16, lines.count() // (partitions(lines.sparkSession) * SAMPLE))
    some = lines.select("id", "line").where(F.pmod(F.xxhash64("id"), F.lit(SAMPLE)) == 0).mapInArrow(keys, "key long")
    counts = some.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return [row.key for row in stages.put(counts, "common").select("key").collect()]


def _signed(lines: DataFrame) -> DataFrame:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, part in shares(batches):
            signs = signatures(part)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(part, pa.string()), *(pa.array(signs[:, i]) for i in range(SIGN_WORDS))], ["id", "line", *(f"s{i}" for i in range(SIGN_WORDS))])

    return lines.select("id", "line").mapInArrow(sign, "id long, line string, " + ", ".join(f"s{i} long" for i in range(SIGN_WORDS)))


class LineClasses:
    """The repeated lines of docs (doc_id, text): a row for each occurrence that is not the first of its class.

    Lines are compared without white space at their ends; empty lines are never repeated ones. Lines linked by the edit
    join, directly or through others, are one class; its first occurrence is the one of smallest (doc_id, line number).
    """

    def __init__(self, docs: DataFrame):
        self.stages = Stages(docs.sparkSession, "linededup")
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        # rows with one doc_id and one text are alike, and get one and the same result
        self.rows = rows.withColumn("row", F.xxhash64("doc_id", "text"))
        each = self.rows.select("doc_id", "row", F.posexplode(lines_of(F.col("text"))).alias("at", "line")).where("line <> ''")
        each = each.withColumn("id", line_id(F.col("line")))
        distinct = self.stages.put_by(_by_id(each), "distinct", "id")
        # two lines under one 64-bit id: some thousands of 10**12 lines. A second hash tells, and such lines get other ids
        shared = self.stages.put(distinct.where("shared").select(F.col("id").alias("shared_id")), "shared")
        if not shared.isEmpty():
            marked = each.join(shared, F.col("id") == F.col("shared_id"), "left").withColumn("id", F.when(F.col("shared_id").isNotNull(), line_id(F.col("line"), 5)).otherwise(F.col("id")))
            each = marked.drop("shared_id")
            renamed = distinct.where("not shared").unionByName(_by_id(marked.where("shared_id is not null").drop("shared_id")))
            distinct = self.stages.put_by(renamed, "renamed", "id")
            if not distinct.groupBy("id").agg(F.max("shared").alias("shared"), F.count("*").alias("n")).where("shared or n > 1").isEmpty():
                raise ValueError("different lines share ids after both hashes")
        self.links = linked_lines(distinct.select("id", "line"), self.stages)
        groups = components(self.links, self.stages, "cc")
        both = self.links.union(self.links.select("b", "a"))
        degree = self.stages.put(both.groupBy(F.col("a").alias("id")).agg(F.count("*").alias("n_links")), "degree")
        classed = distinct.select("id", "first", "n").join(groups.withColumnRenamed("node", "id"), "id", "left").join(degree, "id", "left")
        classed = self.stages.put(classed.where("n > 1 or component is not null").withColumn("class", F.coalesce("component", "id")), "classed")
        firsts = self.stages.put(classed.groupBy("class").agg(F.min("first").alias("keeper"), F.sum("n").alias("class_size")), "firsts")
        self.classes = self.stages.put(classed.join(firsts, "class").select("id", "class", "keeper", "class_size", F.coalesce("n_links", F.lit(0)).alias("n_links")), "classes")
        again = ~((F.col("keeper.row") == F.col("row")) & (F.col("keeper.at") == F.col("at")))
        found = each.select("row", "at", F.length("line").alias("size"), "id").join(self.classes, "id")
        found = found.select("row", F.col("keeper.doc_id").alias("first"), F.struct("at", "size", "n_links", again.alias("again")).alias("line"))
        # sets, as repeated rows bring each of their lines once a copy
        by_first = found.repartition("row").groupBy("row", "first").agg(F.collect_set("line").alias("lines"))
        total = lambda f: F.aggregate(F.transform("lines", f), F.lit(0).cast("long"), lambda s, x: s + x)
        by_first = by_first.select(
            "row", "first", F.size("lines").cast("long").alias("n_lines"), total(lambda x: x["size"].cast("long")).alias("n_chars"), total(lambda x: x["n_links"]).alias("n_links"),
            F.transform(F.filter("lines", lambda x: x["again"]), lambda x: x["at"]).alias("repeats"), total(lambda x: F.when(x["again"], x["size"]).otherwise(0).cast("long")).alias("repeat_chars"),
        )
        known = F.when(F.col("first") < 2**63 - 1, F.col("first"))
        per_row = by_first.groupBy("row").agg(
            F.sort_array(F.flatten(F.collect_list("repeats"))).alias("repeats"), F.sum("n_lines").alias("n_shared"), F.sum("repeat_chars").alias("repeat_chars"), F.sum("n_links").alias("n_links"), F.min("first").alias("first_doc"),
            F.sort_array(F.collect_list(F.struct(known.alias("doc_id"), "n_lines", "n_chars"))).alias("first_docs"),
        )
        self.per_row = self.stages.put(per_row, "per_row")
        self.stages.drop("distinct", "renamed", "shared", "degree", "classed", "firsts", "cc-0")


def dedup_lines(docs: DataFrame, percent: int = 80, width: int = 5) -> DataFrame:
    """docs (doc_id, text, ...) with repeated lines taken out of text; all columns stay.

    Lines are compared without white space at their ends, and count as repeated within the edits of `allowed`: none
    under 10 characters, one under 20, two from there on. A line stays where it is the first of its class in the corpus,
    or empty. What is left of a copy of a whole document would hide it from a document-level operator, so a copy is left
    as it is: a row whose similarity (shingles of `width` words) to the document that most of its repeated characters
    come from, as that document is after its own repeats are gone, is `percent` or more, unless that document is itself
    left as a copy. Such a row is still found by near_duplicates. All other rows lose their repeats.

    Null text: stays null. Repeated rows (one doc_id, one text): alike. Null doc_id: ordered last. Ties for the first
    place: by doc_id, then row hash, then line number; between documents that as much comes from: the smaller doc_id.
    Very long texts and lines: whole. Empty table: no rows. Extra columns: kept, whatever their names, but for the
    reserved `_row`, `_repeats`, `_source` and `_whole`.
    """
    classes = LineClasses(docs)
    put = classes.stages.put
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    drops = classes.per_row.where(F.size("repeats") > 0).select(F.col("row").alias("_row"), F.col("repeats").alias("_repeats"), F.col("first_docs").alias("_source"))
    # whole texts move once, to meet their repeats; all that follows reads the written table
    out = docs.withColumn("_row", F.xxhash64(doc_id, text)).join(drops.hint("shuffle_hash"), "_row", "left")
    others = F.filter("_source", lambda x: x["doc_id"].isNotNull() & ~x["doc_id"].eqNullSafe(doc_id))
    out = out.withColumn("_source", -F.array_max(F.transform(others, lambda x: F.struct(x["n_chars"].alias("n"), (-x["doc_id"]).alias("less"))))["less"])
    out = put(out, "marked")
    lines, cut = F.split(F.col("text"), "\n", -1), F.col("_repeats").isNotNull()
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(F.col("_repeats"), i)), "\n")
    # the texts that may be copies, and the texts that these may be copies of, as they will be
    tried = out.where("_source is not null").select("_row", doc_id.alias("doc_id"), "_source", text.alias("a"))
    known = put(tried.select("_source").distinct(), "sources")
    firsts = out.select(doc_id.alias("_of"), F.when(cut, kept).otherwise(text).alias("b")).join(known, F.col("_of") == F.col("_source"), "left_semi")

    def alike(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.loc[[_similar(a, b, percent, width) for a, b in zip(pdf.a, pdf.b)], ["_row", "doc_id", "_source"]]

    small_batches(docs.sparkSession)
    copies = tried.join(firsts, F.col("_source") == F.col("_of")).select("_row", "doc_id", "_source", "a", "b").mapInPandas(alike, "_row long, doc_id long, _source long")
    copies = put(copies.distinct(), "copies")
    whole = put(copies.join(copies.select(F.col("doc_id").alias("_too")).distinct(), F.col("_source") == F.col("_too"), "left_anti").select(F.col("_row").alias("_whole")).distinct(), "whole")
    classes.stages.drop("sources", "copies")
    out = out.join(whole, F.col("_row") == F.col("_whole"), "left")
    return out.withColumn("text", F.when(cut & F.col("_whole").isNull(), kept).otherwise(F.col("text"))).select(*docs.columns)


def _similar(a: str | None, b: str | None, percent: int, width: int) -> bool:
    x, y = neardup.shingle_hashes(a, width), neardup.shingle_hashes(b, width)
    if not len(x) or 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= percent * (len(x) + len(y) - common)


def line_report(docs: DataFrame) -> DataFrame:
    """One row for each row of docs (doc_id, text): n_lines, n_shared (lines in a class with others), n_repeats, n_links, first_doc,
    first_docs.

    n_links counts the links of the row's lines to different lines; first_doc is the smallest doc_id that holds the
    first occurrence of one of its classes (null: it shares no line). first_docs has each such document (doc_id, n_lines,
    n_chars) with the lines of this row in its classes and their characters; they add up to n_shared. Lines are linked within
    the edits of `allowed`: none under 10 characters, one under 20, two from there on. Null or empty text: no lines, and
    no first_docs. Repeated rows: alike, as one. Null doc_id: kept, ordered last. Very long texts: whole. Empty table: no
    rows. Other columns are ignored, whatever their names.
    """
    classes = LineClasses(docs)
    rows = classes.rows.select("doc_id", "row", F.size(F.filter(lines_of(F.col("text")), lambda x: x != "")).alias("n_lines")).join(classes.per_row, "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    first = F.when(F.col("first_doc") < 2**63 - 1, F.col("first_doc"))
    return rows.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), zero("n_shared").alias("n_shared"), zero(F.when(F.col("repeats").isNotNull(), F.size("repeats"))).alias("n_repeats"), zero("n_links").alias("n_links"), first.alias("first_doc"), F.coalesce("first_docs", F.array()).alias("first_docs"))
