"""Evidence checks of extracted fields: every field gets a state of its own, so one bad claim spoils no other.

Rows hold `raw_comment`, `context` (video_text, parent_comment, root_comment, solicitation_verified), `conflicts` and
`analysis` of type ANALYSIS. All of it is column expressions: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EVIDENCE = "struct<source:string,quote:string,start:int,end:int>"
VIEW = f"struct<entity:string,category:string,speech_act:string,intent_basis:string,explicit_action:boolean,stance:string,action:string,evidence:{EVIDENCE},context_evidence:{EVIDENCE},stance_evidence:{EVIDENCE},action_evidence:{EVIDENCE},condition:{EVIDENCE},horizon:{EVIDENCE},rationales:array<{EVIDENCE}>>"
METHOD = f"struct<method:string,attitude:string,evidence:{EVIDENCE},rationales:array<{EVIDENCE}>>"
RISK = f"struct<rule:string,attitude:string,evidence:{EVIDENCE}>"
ANALYSIS = f"struct<intents:array<string>,needs_review:boolean,views:array<{VIEW}>,methods:array<{METHOD}>,risks:array<{RISK}>>"

# Phrases that contradict a claim.
NOT_BUYING = "不买|别买|不要买|不能买"
NOT_SWING = "别做[Tt]|不要做[Tt]|不做[Tt]"
LEVERAGE = "我要加杠杆|杠杆加满"

GATES = ("entity", "speech_act", "stance", "action", "context", "rationale", "condition", "horizon")


def _no(condition: Column) -> Column:
    """Not surely true."""
    return ~F.coalesce(condition, F.lit(False))


def _text(source: Column) -> Column:
    of = lambda c: F.coalesce(F.col(c), F.lit(""))
    return (
        F.when(source == "COMMENT", of("raw_comment")).when(source == "VIDEO", of("context.video_text"))
        .when(source == "PARENT", of("context.parent_comment")).when(source == "ROOT", of("context.root_comment")).otherwise("")
    )


def grounded(ev: Column) -> Column:
    """ev with its place mended and `state`: EXACT, REPAIRED (the quote stands exactly once elsewhere), FAIL; null stays null.

    Offsets are code points from 0, the end exclusive. Overlapping occurrences count as several.
    """
    text, quote = _text(ev["source"]), ev["quote"]
    exact = (ev["start"] >= 0) & (ev["start"] < ev["end"]) & (ev["end"] <= F.length(text)) & (F.substr(text, ev["start"] + 1, ev["end"] - ev["start"]) == quote)
    at = F.position(quote, text)
    once = (F.length(quote) > 0) & (at > 0) & (F.position(quote, text, at + 1) == 0)
    state = F.when(exact, "EXACT").when(once, "REPAIRED").otherwise("FAIL")
    start = F.when(state == "REPAIRED", at - 1).otherwise(ev["start"])
    end = F.when(state == "REPAIRED", at - 1 + F.length(quote)).otherwise(ev["end"])
    return F.when(ev.isNotNull(), F.struct(ev["source"].alias("source"), quote.alias("quote"), start.alias("start"), end.alias("end"), state.alias("state"), ev["start"].alias("supplied_start")))


def _sound(ev: Column, source: str | None = "COMMENT") -> Column:
    """Whether evidence is present, of this source, and stands in the text; never null."""
    ok = grounded(ev)["state"] != "FAIL"
    return F.coalesce(ok if source is None else (ev["source"] == source) & ok, F.lit(False))


def _record(ev: Column) -> Column:
    return F.struct(grounded(ev).alias("evidence"), F.when(_sound(ev), "PASS").otherwise("FAIL").alias("state"))


def view_gates(v: Column) -> Column:
    """The states of one view's fields."""
    video, parent = v["intent_basis"] == "VIDEO_PROMPT_CONTEXT", v["intent_basis"] == "PARENT_CONTEXT"
    verified = F.when(video, F.coalesce(F.col("context.solicitation_verified"), F.lit(False))).otherwise(F.coalesce(F.col("context.parent_comment"), F.lit("")) != "")
    backed = verified & F.when(video, _sound(v["context_evidence"], "VIDEO")).otherwise(_sound(v["context_evidence"], "PARENT"))
    contextual = video | parent
    doubtful = (contextual & ~backed) | (v["intent_basis"] == "UNKNOWN")
    act = v["action"]
    directional = ~act.isin("NONE", "UNKNOWN")
    negated = (act == "BUY") & v["action_evidence"]["quote"].rlike(NOT_BUYING)
    action = (
        F.when(v["action_evidence"].isNotNull() & ~_sound(v["action_evidence"], None), "FAIL").when(negated, "FAIL")
        .when(directional & (_no(v["explicit_action"]) | ~_sound(v["action_evidence"])), "REVIEW").when(act == "UNKNOWN", "REVIEW")
        .when(contextual & v["explicit_action"], "FAIL").otherwise("PASS")
    )
    held = lambda c: F.when(v[c].isNull(), "NOT_APPLICABLE").when(_sound(v[c]), "PASS").otherwise("FAIL")
    rationale = F.when(F.coalesce(F.size(v["rationales"]), F.lit(0)) <= 0, "NOT_APPLICABLE").when(F.forall(v["rationales"], lambda r: _sound(r)), "PASS").otherwise("FAIL")
    states = (
        F.when(_sound(v["evidence"]), "PASS").otherwise("FAIL"),
        F.when(doubtful | (v["speech_act"] == "UNKNOWN"), "REVIEW").otherwise("PASS"),
        F.when((v["stance"] == "UNKNOWN") | ~_sound(v["stance_evidence"]), "REVIEW").otherwise("PASS"),
        action, F.when(doubtful, "REVIEW").otherwise("PASS"), rationale, held("condition"), held("horizon"),
    )
    return F.struct(*(s.alias(g) for s, g in zip(states, GATES)))


def _claim(x: Column, contradicted: Column) -> Column:
    ok = _sound(x["evidence"])
    attitude = F.when(F.coalesce(contradicted, F.lit(False)), "FAIL").when(~ok, "FAIL").when(x["attitude"] == "UNKNOWN", "REVIEW").otherwise("PASS")
    return F.struct(F.when(ok, "PASS").otherwise("FAIL").alias("type"), attitude.alias("attitude"))


def method_state(m: Column) -> Column:
    return _claim(m, m["attitude"].isin("SUPPORT", "SELF_PRACTICE") & (m["method"] == "SWING_T") & m["evidence"]["quote"].rlike(NOT_SWING))


def risk_state(r: Column) -> Column:
    return _claim(r, (r["rule"] == "NO_LEVERAGE") & (r["attitude"] == "SUPPORT") & r["evidence"]["quote"].rlike(LEVERAGE))


def _bad(state: Column) -> Column:
    return state.isin("FAIL", "REVIEW")


def validate(rows: DataFrame) -> DataFrame:
    """rows with view_status, method_status, risk_status (arrays in the order of the claims), rationale_status and
    method_rationale_status (each reason with its mended evidence), intent_status, identity_status, review_items, status (SUCCESS, PARTIAL; null without an analysis) and reason.

    Null arrays count as empty, null text as empty. Columns of these names in rows are replaced.
    """
    a = lambda c: F.coalesce(F.col(f"analysis.{c}"), F.array())
    out = rows.withColumns({
        "view_status": F.transform(a("views"), view_gates),
        "method_status": F.transform(a("methods"), method_state),
        "risk_status": F.transform(a("risks"), risk_state),
        "rationale_status": F.transform(a("views"), lambda v: F.transform(F.coalesce(v["rationales"], F.array()), _record)),
        "method_rationale_status": F.transform(a("methods"), lambda m: F.transform(F.coalesce(m["rationales"], F.array()), _record)),
    })
    clash = F.array_contains(a("intents"), "NON_INVESTMENT") & (F.size(a("views")) + F.size(a("methods")) + F.size(a("risks")) > 0)
    unsure = F.coalesce(F.col("analysis.needs_review"), F.lit(False))
    differs = F.coalesce(F.size("conflicts"), F.lit(0)) > 0
    item = lambda place, i, field, reason: F.struct(place.alias("place"), i.cast("int").alias("index"), field.alias("field"), reason.alias("reason"))
    of_view = lambda v, i: F.filter(F.array(*(F.when(_bad(v[g]), item(F.lit("view"), i, F.lit(g), F.concat(F.lit(f"{g.upper()}_"), v[g]))) for g in GATES)), lambda x: x.isNotNull())
    of_claim = lambda kind: F.filter(F.transform(F.col(f"{kind}_status"), lambda s, i: F.when(s["attitude"] != "PASS", item(F.lit(f"{kind}s"), i, F.lit("attitude"), s["attitude"]))), lambda x: x.isNotNull())
    lone = lambda when, field, reason: F.filter(F.array(F.when(when, item(F.lit("row"), F.lit(0), F.lit(field), F.lit(reason)))), lambda x: x.isNotNull())
    items = F.concat(lone(clash, "intent", "NON_INVESTMENT_WITH_INVESTMENT_FIELDS"), F.flatten(F.transform(F.col("view_status"), of_view)), of_claim("method"), of_claim("risk"), lone(differs, "identity", "SOURCE_CONTENT_CONFLICT"))
    out = out.withColumns({"intent_status": F.when(clash, "FAIL").when(unsure, "REVIEW").otherwise("PASS"), "identity_status": F.when(differs, "FAIL").otherwise("PASS"), "review_items": items})
    status = F.when(F.col("analysis").isNotNull(), F.when((F.size("review_items") > 0) | unsure, "PARTIAL").otherwise("SUCCESS"))
    return out.withColumn("status", status).withColumn("reason", F.when(F.col("status") == "PARTIAL", "FIELD_REVIEW_REQUIRED").when(F.col("status") == "SUCCESS", ""))


def unresolved_entity(entity_state: Column, resolved: Column) -> Column:
    """The entity gate after resolution: an unresolved name is REVIEW, unless the gate failed already."""
    return F.when(_no(resolved) & (entity_state != "FAIL"), "REVIEW").otherwise(entity_state)
