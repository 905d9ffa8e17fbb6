"""Shared plumbing of the corpus operators: stage tables, word hashing, token ids."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch of texts.
BATCH_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table by name; the path may be on any file system that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or (local runs only) a folder under the warehouse.

    On a cluster without that setting there is no folder that all machines are known to share, so this refuses.
    """
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_stages"


_OPEN: list[Stages] = []


def opened() -> int:
    """A mark of the stage tables made so far, for close_since."""
    return len(_OPEN)


def close_since(mark: int) -> None:
    """Delete the stage tables of operators called since the mark, whose results are written or no longer needed."""
    while len(_OPEN) > mark:
        _OPEN.pop().close()


class Stages:
    """Intermediate tables of one operator call, written as Parquet to the shared folder.

    A written table cuts lineage: a lost executor costs at most the tasks since the last stage, never the whole plan.
    Tables that the returned DataFrame still reads stay until close_since is called, once that result is written.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/tallyloom/{name}-{uuid.uuid4().hex[:12]}"
        self.registered: list[str] = []
        _OPEN.append(self)

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def put_by(self, df: DataFrame, name: str, key: str) -> DataFrame:
        """As put, dealt into buckets by a key that few rows share: joins on it read the table in place."""
        path, called = f"{self.root}/{name}", self._called(name)
        self.registered.append(called)
        df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(partitions(self.spark), key).saveAsTable(called)
        return self.spark.table(called)

    def _called(self, name: str) -> str:
        return re.sub(r"\W", "_", f"tallyloom_{self.root.rpartition('/')[2]}_{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            if (called := self._called(name)) in self.registered:
                self.spark.sql(f"DROP TABLE IF EXISTS {called}")
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
            path.getFileSystem(conf).delete(path, True)

    def close(self) -> None:
        for called in self.registered:
            self.spark.sql(f"DROP TABLE IF EXISTS {called}")
        self.drop("")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of few rows: a batch of very long texts stays within a Python worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


class Cache(dict):
    """A memo of make(key) that starts anew at `most` entries, so its memory is bounded whatever the vocabulary."""

    def __init__(self, make: Callable, most: int = 300_000):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.make(key)
        return value


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads the bits of a combined hash."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_TWO_SPACES = re.compile(r"\s\s")


class Ids:
    """Token ids of a byte-level BPE.

    The public pre-token pattern looks ahead only to split runs of white space. Where a text has no two adjacent white
    characters, the same pattern without look-ahead gives the same pre-tokens and runs about twice as fast; other texts
    take the full pattern. Added tokens of the vocabulary stand for themselves wherever a text spells them out.
    tests/llm compares both with the `tokenizers` library.
    """

    def __init__(self, path: str | None = None):
        import json

        import public_tokenizers
        import tiktoken

        with open(path or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
            spec = json.load(f)
        raw = _byte_alphabet()
        special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        ranks = {bytes(raw[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        #: the numpy type that holds every id
        self.kind = np.uint16 if max([*ranks.values(), *special.values()]) < 1 << 16 else np.uint32
        self.pattern = public_tokenizers.PATTERN
        plain = self.pattern.replace(r"|\s+(?!\S)|\s+", r"|\s")
        self.full = tiktoken.Encoding("full", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens=special)
        self.plain = tiktoken.Encoding("plain", pat_str=plain, mergeable_ranks=ranks, special_tokens=special)
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True))) or "(?!)")

    def encode(self, text: str) -> list[int]:
        """Ids of the whole text; no token is put in before or behind it."""
        which = self.full if _TWO_SPACES.search(text) else self.plain
        return which.encode(text, allowed_special="all") if self.special.search(text) else which.encode_ordinary(text)


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for the 256 bytes: printable Latin-1 stands for itself, the others count on from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    return out | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}


_IDS: dict[str, Ids] = {}


def ids_of(path: str | None = None) -> Ids:
    """One tokenizer for each Python worker and vocabulary file."""
    if (key := path or "") not in _IDS:
        _IDS[key] = Ids(path)
    return _IDS[key]


def bucket(column: str, modulus: int):
    """crc32 of a column as text, modulo: the folds that labels are learned from and held out by."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def below(share: float) -> int:
    """The 64-bit value under which this share of all hashes lies."""
    return min(2**63 - 1, int((share * 2 - 1) * 2**63))
