"""Pairs of short texts that may be close, block against block: bags of characters first, then common subsequences."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Classes of characters in the subsequence screen; unlike characters of one class count as equal, so no pair is lost.
_CLASSES = 128


def _points(texts) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in one row, and where each text ends."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, np.cumsum([len(t) for t in texts])


def bags(texts) -> np.ndarray:
    """256 bits for each text: one for each character and how often it came before, by a hash.

    An edit takes one such element away and adds one, so bits of one text that the other lacks are edits at least.
    """
    points, ends = _points(texts)
    owner = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    order = np.lexsort((points, owner))
    p, o = points[order].astype(np.uint64), owner[order]
    new = np.ones(len(p), bool)
    new[1:] = (p[1:] != p[:-1]) | (o[1:] != o[:-1])
    at = np.arange(len(p))
    before = at - np.maximum.accumulate(np.where(new, at, 0)) if len(p) else at
    bit = ((p * np.uint64(0x9E3779B97F4A7C15) + before.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(56)).astype(np.int64)
    out = np.zeros((len(ends), 4), np.uint64)
    np.bitwise_or.at(out, (o, bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
    return out


class _Block:
    def __init__(self, rows: pd.DataFrame):
        texts = rows["text"].tolist()
        self.n, self.bags = np.array([len(t) for t in texts]), bags(texts)
        points, ends = _points(texts)
        owner = np.repeat(np.arange(len(ends)), self.n)
        place = np.arange(len(points)) - np.repeat(ends - self.n, self.n)
        kind = ((points.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(57)).astype(np.int64)
        low = place < 64
        #: where characters of a class stand in a text's first 64; and the classes themselves
        self.stands = np.zeros((len(ends), _CLASSES), np.uint64)
        np.bitwise_or.at(self.stands, (owner[low], kind[low]), np.uint64(1) << place[low].astype(np.uint64))
        self.kinds = np.zeros((len(ends), 64), np.int64)
        self.kinds[owner[low], place[low]] = kind[low]


def _common(a: _Block, i: np.ndarray, b: _Block, j: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of texts of at most 64 characters, by Hyyrö's bit vectors."""
    row = np.full(len(i), ~np.uint64(0))
    size = b.n[j]
    for c in range(int(size.max(initial=0))):
        met = row & np.where(c < size, a.stands[i, b.kinds[j, c]], np.uint64(0))
        row = (row + met) | (row - met)
    n = a.n[i].astype(np.uint64)
    low = np.where(n >= 64, ~np.uint64(0), (np.uint64(1) << (n & np.uint64(63))) - np.uint64(1))
    return np.bitwise_count(~row & low).astype(np.int64)


def close(a: _Block, b: _Block, same: bool, indels: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of pairs that at most indels(lengths, lengths) insertions and deletions may keep apart; long texts by bag alone."""
    out = []
    with np.errstate(over="ignore"):
        step = max(1, 2_000_000 // max(1, len(b.n)))
        for at in range(0, len(a.n), step):
            i = np.arange(at, min(at + step, len(a.n)))
            reach = indels(a.n[i][:, None], b.n[None])
            keep = np.abs(a.n[i][:, None] - b.n[None]) <= reach
            if same:
                keep &= i[:, None] < np.arange(len(b.n))[None]
            apart = sum(np.bitwise_count(a.bags[i, w][:, None] ^ b.bags[:, w][None]).astype(np.int16) for w in range(4))
            x, y = np.nonzero(keep & (apart <= reach))
            reach, x = reach[x, y], x + at
            short = (a.n[x] <= 64) & (b.n[y] <= 64)
            fine = ~short
            fine[short] = a.n[x[short]] + b.n[y[short]] - 2 * _common(a, x[short], b, y[short]) <= reach[short]
            out.append((x[fine], y[fine]))
    return np.concatenate([x for x, _ in out] or [np.zeros(0, int)]), np.concatenate([y for _, y in out] or [np.zeros(0, int)])


def ratios(a: list[str], b: list[str]) -> np.ndarray:
    """What difflib.SequenceMatcher(None, x, y, autojunk=False).ratio() gives for each pair, many pairs at a time."""
    m, n = np.array([len(x) for x in a], int), np.array([len(x) for x in b], int)
    out = np.ones(len(a))
    order, at = np.argsort(np.maximum(m, n), kind="stable"), 0
    while at < len(order):
        # pairs of like length; as many as a block of numbers holds
        stop = at + 1
        while stop < len(order) and (stop + 1 - at) * max(m[order[stop]], n[order[stop]]) ** 2 <= 1_000_000:
            stop += 1
        some = order[at:stop]
        total = m[some] + n[some]
        out[some] = np.where(total > 0, 2.0 * _matched([a[i] for i in some], [b[i] for i in some], m[some], n[some]) / np.maximum(total, 1), 1.0)
        at = stop
    return out


def _rows(texts: list[str], sizes: np.ndarray, width: int, fill: int) -> np.ndarray:
    out = np.full((len(texts), width), fill, np.uint32)
    out[np.arange(width)[None] < sizes[:, None]] = _points(texts)[0]
    return out


def _matched(a: list[str], b: list[str], m: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Characters in matching blocks: the longest block (the first of several), and so on left and right of it."""
    x, y = _rows(a, m, max(1, int(m.max())), 0x110000), _rows(b, n, max(1, int(n.max())), 0x110001)
    small = np.uint8 if min(x.shape[1], y.shape[1]) < 256 else np.uint32
    runs = np.zeros((len(a), x.shape[1], y.shape[1]), small)  # of equal characters that end at both places
    for i in range(x.shape[1]):
        row = (x[:, i, None] == y).astype(small)
        if i:
            row[:, 1:] *= runs[:, i - 1, :-1] + small(1)
        runs[:, i] = row
    found = np.zeros(len(a), int)
    p, alo, ahi, blo, bhi = np.arange(len(a)), np.zeros(len(a), int), m, np.zeros(len(a), int), n
    while len(p):
        u, v = np.arange(x.shape[1])[None], np.arange(y.shape[1])[None]
        up, left = np.where(u < ahi[:, None], np.clip(u - alo[:, None] + 1, 0, None), 0), np.where(v < bhi[:, None], np.clip(v - blo[:, None] + 1, 0, None), 0)
        if small is np.uint8:
            up, left = np.minimum(up, 255), np.minimum(left, 255)
        size = np.minimum(np.minimum(runs[p], up.astype(small)[:, :, None]), left.astype(small)[:, None, :]).reshape(len(p), -1)
        best = size.argmax(axis=1)
        k = size[np.arange(len(p)), best].astype(int)
        i, j = best // y.shape[1] - k + 1, best % y.shape[1] - k + 1
        np.add.at(found, p, k)
        before, after = (k > 0) & (alo < i) & (blo < j), (k > 0) & (i + k < ahi) & (j + k < bhi)
        p, alo, ahi, blo, bhi = (np.concatenate(c) for c in ((p[before], p[after]), (alo[before], (i + k)[after]), (i[before], ahi[after]), (blo[before], (j + k)[after]), (j[before], bhi[after])))
    return found


def scan(texts: DataFrame, slack: Callable, indels: Callable, least_block: int = 512, most_block: int = 8192) -> DataFrame:
    """(a, b, a_text, b_text), a < b and one of them hot, of distinct texts (id, platform, text, hot) that may be close.

    Each pair comes once.
    Texts are dealt to blocks by platform, length and whether they are hot; blocks whose lengths are in reach meet in a
    task that holds two of them and a few million numbers. slack(length): how far a partner's length may be.
    """
    spark, kinds = texts.sparkSession, dict(texts.dtypes)
    found = f"a {kinds['id']}, b {kinds['id']}, a_text string, b_text string"
    sized = texts.select("id", "platform", "text", F.coalesce("hot", F.lit(False)).alias("hot"), F.length("text").alias("n"))
    # lengths of short texts are few
    counts = [tuple(r) for r in sized.groupBy("platform", "hot", "n").count().orderBy("platform", "hot", "n").collect()]
    block = min(most_block, max(least_block, sum(r[3] for r in counts) // 16))
    ranges: list[list] = []  # platform, hot, from, to, rows
    for platform, hot, n, rows in counts:
        if ranges and ranges[-1][:2] == [platform, hot] and ranges[-1][4] + rows <= block:
            ranges[-1][3:] = [n, ranges[-1][4] + rows]
        else:
            ranges.append([platform, hot, n, n, rows])
    blocks = [(g, *r[:4], -(-r[4] // block)) for g, r in enumerate(ranges)]
    cells = [(g, s, p, hot, lo, hi) for g, p, hot, lo, hi, cuts in blocks for s in range(cuts)]
    units = []
    for u, (g, s, p, hot, lo, hi) in enumerate(cells):
        for v in range(u, len(cells)):
            h, t, q, heat, start, end = cells[v]
            if p == q and (hot or heat) and start <= hi + slack(hi) + 1e-6 and lo <= end + slack(end) + 1e-6:
                units += [(len(units) // 2, g, s, 0, u == v), (len(units) // 2, h, t, 1, u == v)]
    if not units:
        return spark.createDataFrame([], found)
    of = spark.createDataFrame(blocks, f"block int, platform {kinds['platform']}, hot boolean, lo int, hi int, cuts int")
    dealt = sized.alias("x").join(F.broadcast(of.alias("y")), (F.col("x.platform") == F.col("y.platform")) & (F.col("x.hot") == F.col("y.hot")) & F.col("n").between(F.col("lo"), F.col("hi")))
    dealt = dealt.select("id", "text", "x.hot", "block", F.pmod(F.xxhash64("text"), F.col("cuts")).cast("int").alias("cut"))
    plan = F.broadcast(spark.createDataFrame(units, "unit int, block int, cut int, side int, same boolean"))
    dealt = dealt.join(plan, ["block", "cut"]).where("side = 0 or not same").repartition(min(len(units) // 2, 192), "unit")

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        left, right = rows[rows.side == 0], rows[rows.side == 1]
        same = bool(rows.same.iloc[0])
        if left.empty or (right.empty and not same):
            return pd.DataFrame({"a": [], "b": [], "a_text": [], "b_text": []})
        a = _Block(left)
        b, right = (a, left) if same else (_Block(right), right)
        i, j = close(a, b, same, indels)
        x, y, ta, tb = left["id"].to_numpy()[i], right["id"].to_numpy()[j], left.text.to_numpy()[i], right.text.to_numpy()[j]
        swap = (x > y).astype(bool)
        return pd.DataFrame({"a": np.where(swap, y, x), "b": np.where(swap, x, y), "a_text": np.where(swap, tb, ta), "b_text": np.where(swap, ta, tb)})

    return dealt.groupBy("unit").applyInPandas(meet, found)
