"""The boundary to a model outside: what has to be asked, what was answered before, and what an answer must be.

Questions are rows; answers are a table keyed by a hash of all that can change them. A provider is any callable from a
question to an answer; the tests' one reads a table. Nothing here opens a connection.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Stop(Exception):
    """The provider refuses for good: no rights, no credit, no such model."""


class Again(Exception):
    """The provider may answer later: too many requests, or its own fault."""


class Refused(Exception):
    """The provider rejects this question; asking again changes nothing."""


def failure(status: int) -> Exception:
    """What an HTTP status means for going on."""
    if status in (401, 402, 403, 404):
        return Stop(f"HTTP {status}")
    return Again(f"HTTP {status}") if status == 429 or status >= 500 else Refused(f"HTTP {status}")


def cache_key(question: Column, **versions: str) -> Column:
    """A hash of the question and of the versions of all that its answer depends on: model, prompt, schema, validator."""
    return F.sha2(F.to_json(F.struct(question.alias("question"), *(F.lit(v).alias(k) for k, v in sorted(versions.items())))), 256)


def split(questions: DataFrame, answers: DataFrame, version: str) -> tuple[DataFrame, DataFrame]:
    """(hits, misses) of questions (id, key, question) by answers (key, version, status, answer); a miss is asked once a key.

    An answer counts only with its version, with success, and with the fields that it should have.
    """
    good = answers.where((F.col("version") == version) & (F.col("status") == "SUCCESS") & F.col("answer").isNotNull()).dropDuplicates(["key"]).select("key", "answer")
    return questions.join(good, "key"), questions.join(good, "key", "left_anti").dropDuplicates(["key"]).select("key", "question")


@dataclass
class Quota:
    """Calls and tokens that one task may still use. What a call may need is reserved before and settled after it."""

    calls: int
    tokens: int
    used: dict[str, int] = field(default_factory=lambda: {"calls": 0, "tokens": 0})

    def reserve(self, tokens: int) -> bool:
        if self.used["calls"] + 1 > self.calls or self.used["tokens"] + tokens > self.tokens:
            return False
        self.used["calls"] += 1
        self.used["tokens"] += tokens
        return True

    def settle(self, reserved: int, real: int) -> None:
        self.used["tokens"] += real - reserved


def ask(question: str, provider: Callable[[str, str | None], dict], check: Callable[[dict], str | None], quota: Quota, reserve: int, attempts: int = 3, wait: Callable[[float], None] = time.sleep) -> tuple[str, str | None, str | None]:
    """(status, answer, reason). A failed check is told to the provider in the next attempt; an answer cut short is a failure."""
    told: str | None = None
    for turn in range(attempts):
        if not quota.reserve(reserve):
            return "SKIPPED", None, "QUOTA"
        try:
            answer = provider(question, told)
        except Stop as e:
            return "STOPPED", None, str(e)
        except Refused as e:
            return "FAILED", None, str(e)
        except Again as e:
            told = None
            if turn + 1 == attempts:
                return "FAILED", None, str(e)
            wait(min(2**turn, 4))
            continue
        quota.settle(reserve, int(answer.get("tokens", reserve)))
        told = "the answer was cut short" if answer.get("truncated") else check(answer)
        if told is None:
            return "SUCCESS", json.dumps(answer, ensure_ascii=False, sort_keys=True), None
    return "FAILED", None, told


def asked(misses: DataFrame, provider: Callable[[str, str | None], dict], check: Callable[[dict], str | None], version: str, calls: int, tokens: int, reserve: int = 1000, attempts: int = 3) -> DataFrame:
    """answers (key, version, status, answer, reason) to misses (key, question).

    Quotas hold for each partition, so deal the misses to as many partitions as calls may run at once, each with its share.
    Once the provider stops, the rest of a partition is skipped. Write the result before anything else reads it: a row
    that is computed twice is asked twice.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        quota, stopped = Quota(calls, tokens), False
        for pdf in batches:
            out = []
            for key, question in zip(pdf.key, pdf.question):
                status, answer, reason = ("SKIPPED", None, "STOPPED") if stopped else ask(question, provider, check, quota, reserve, attempts)
                stopped |= status == "STOPPED"
                out.append((key, version, status, answer, reason))
            yield pd.DataFrame(out, columns=["key", "version", "status", "answer", "reason"])

    return misses.mapInPandas(run, "key string, version string, status string, answer string, reason string")


def merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """The answers of both, a success never replaced by a failure; of several successes of a key the old one."""
    rows = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    best = F.min_by(F.struct("version", "status", "answer", "reason"), F.struct((F.col("status") != "SUCCESS").cast("int"), "_new", "answer"))
    return rows.groupBy("key").agg(best.alias("_b")).select("key", "_b.*")


def probability_check(labels: dict[str, list[str]]) -> Callable[[dict], str | None]:
    """A check of answers {question: {choice, probabilities}}: the labels of each question, finite values that sum to 1."""

    def check(answer: dict) -> str | None:
        for name, wanted in labels.items():
            got = answer.get(name) or {}
            p = got.get("probabilities") or {}
            if set(p) != set(wanted) or got.get("choice") not in p:
                return f"{name}: wrong labels"
            if any(isinstance(v, bool) or not isinstance(v, (int, float)) or not 0 <= v <= 1 for v in p.values()) or abs(sum(p.values()) - 1) > 0.02:
                return f"{name}: no probabilities"
        return None

    return check


def units_to_judge(records: DataFrame, gates: Column) -> DataFrame:
    """One question for each atomic unit of records (record_id, text, atomic_units) that passes its gate, and the whole text.

    The unit's own stance and action are left out: a judge must not read them.
    """
    units = records.select("record_id", "text", F.explode("atomic_units").alias("unit")).withColumn("gate", gates)
    question = F.to_json(F.struct("text", F.col("unit.evidence").alias("evidence"), F.lit("VALIDATED_ATOMIC_UNIT").alias("granularity"), F.col("unit.subject_relation").alias("subject_relation")))
    return units.select("record_id", F.col("unit.unit_id").alias("unit_id"), "gate", F.when(F.col("gate") == "PASS", question).alias("question"))


def provenance(requested: str, resolved: Column, questions: str, criteria: str, source: str) -> Column:
    """Where a judgement comes from: the model asked for and the one that answered, hashes of what it was asked, the source."""
    sha = lambda s: F.sha2(F.lit(s), 256)
    return F.struct(F.lit(requested).alias("requested_model"), resolved.alias("resolved_model"), (resolved != requested).alias("alias"), sha(questions).alias("question_sha256"), sha(criteria).alias("criteria_sha256"), F.lit(source).alias("source"))


def legacy(records: DataFrame) -> DataFrame:
    """Old coordination records (authenticity label, p_bot, probabilities) as judgements of today's labels."""
    names = F.create_map(*(F.lit(x) for x in ("ORGANIC", "NO_COORDINATION_EVIDENCE", "SUSPECTED_COORDINATED", "SUSPECTED_COORDINATED", "UNCERTAIN", "INSUFFICIENT_EVIDENCE")))
    renamed = F.transform_keys("probabilities", lambda k, v: F.coalesce(names[k], k))
    return records.withColumn("label", F.coalesce(names[F.col("authenticity")], F.col("authenticity"))).withColumn("probabilities", renamed).withColumn("origin", F.lit("LEGACY_IMPORT"))
