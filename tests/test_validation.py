"""Field states of extracted claims, and names in texts."""

from tallyloom.operators import validation


def ev(quote, start, source="COMMENT"):
    return {"source": source, "quote": quote, "start": start, "end": start + len(quote)}


def view(**more):
    v = dict.fromkeys("context_evidence stance_evidence action_evidence condition horizon".split())
    return v | dict(entity="Acme", category="STOCK", speech_act="OPINION", intent_basis="COMMENT", explicit_action=False, stance="BULLISH", action="NONE", evidence=ev("Acme", 0), rationales=[]) | {"stance_evidence": ev("will rise", 5)} | more


def run(spark, text, views=(), methods=(), risks=(), intents=(), needs_review=False, conflicts=(), context=("", "", "", False)):
    schema = f"raw_comment string, context struct<video_text:string,parent_comment:string,root_comment:string,solicitation_verified:boolean>, conflicts array<string>, analysis {validation.ANALYSIS}"
    analysis = dict(intents=list(intents), needs_review=needs_review, views=list(views), methods=list(methods), risks=list(risks))
    return validation.validate(spark.createDataFrame([(text, context, list(conflicts), analysis)], schema)).first()


def test_sound_view_passes_and_shifted_quote_is_mended(spark):
    r = run(spark, "Acme will rise", [view(rationales=[ev("rise", 0), ev("gone", 0)]), view(rationales=[ev("rise", 0)], condition=ev("Acme", 3))])
    a, b = r.view_status
    assert (a.entity, a.stance, a.action, a.rationale, a.condition) == ("PASS", "PASS", "PASS", "FAIL", "NOT_APPLICABLE")
    assert (b.rationale, b.condition, b.horizon) == ("PASS", "PASS", "NOT_APPLICABLE")
    mended = r.rationale_status[0][0].evidence
    assert (mended.state, mended.start, mended.end, mended.supplied_start) == ("REPAIRED", 10, 14, 0)
    assert [(i["index"], i.reason) for i in r.review_items] == [(0, "RATIONALE_FAIL")] and r.status == "PARTIAL"
    good = run(spark, "Acme will rise", [view()])
    assert (good.status, good.reason, good.review_items) == ("SUCCESS", "", [])


def test_entity_stance_and_action_gates(spark):
    text = "Acme will rise, 不买 Acme"
    cases = [
        (view(evidence=ev("Acme", 3)), "entity", "FAIL"),  # stands twice: cannot be mended
        (view(evidence=ev("Acme", 0, "VIDEO")), "entity", "FAIL"),
        (view(stance="UNKNOWN"), "stance", "REVIEW"),
        (view(stance_evidence=None), "stance", "REVIEW"),
        (view(action="BUY", explicit_action=True), "action", "REVIEW"),
        (view(action="BUY", explicit_action=False, action_evidence=ev("will rise", 5)), "action", "REVIEW"),
        (view(action="BUY", explicit_action=True, action_evidence=ev("will rise", 5)), "action", "PASS"),
        (view(action="BUY", explicit_action=True, action_evidence=ev("不买", 16)), "action", "FAIL"),
        (view(action="UNKNOWN"), "action", "REVIEW"),
        (view(action="NONE", action_evidence=ev("made up", 0)), "action", "FAIL"),
        (view(speech_act="UNKNOWN"), "speech_act", "REVIEW"),
        (view(intent_basis="UNKNOWN"), "context", "REVIEW"),
    ]
    got = run(spark, text, [v for v, _, _ in cases]).view_status
    assert [g[field] for g, (_, field, _) in zip(got, cases)] == [want for _, _, want in cases]


def test_context_needs_a_verified_source(spark):
    asked = view(intent_basis="VIDEO_PROMPT_CONTEXT", context_evidence=ev("what to buy", 0, "VIDEO"))
    told = view(intent_basis="PARENT_CONTEXT", context_evidence=ev("and Acme?", 0, "PARENT"), explicit_action=True)
    with_it = run(spark, "Acme will rise", [asked, told], context=("what to buy", "and Acme?", "", True)).view_status
    without = run(spark, "Acme will rise", [asked, told], context=("what to buy", None, None, None)).view_status
    assert [(g.context, g.action) for g in with_it] == [("PASS", "PASS"), ("PASS", "FAIL")]
    assert [(g.context, g.speech_act) for g in without] == [("REVIEW", "REVIEW")] * 2


def test_claims_and_row_states(spark):
    text = "别做T 我要加杠杆 ok"
    methods = [dict(method="SWING_T", attitude=a, evidence=ev(q, s), rationales=[]) for a, q, s in (("SUPPORT", "别做T", 0), ("OPPOSE", "别做T", 0), ("UNKNOWN", "ok", 10), ("UNKNOWN", "no", 0))]
    risks = [dict(rule="NO_LEVERAGE", attitude="SUPPORT", evidence=ev("我要加杠杆", 4))]
    r = run(spark, text, methods=methods, risks=risks, intents=["NON_INVESTMENT"], conflicts=["text"])
    assert [(m.type, m.attitude) for m in r.method_status] == [("PASS", "FAIL"), ("PASS", "PASS"), ("PASS", "REVIEW"), ("FAIL", "FAIL")]
    assert r.method_rationale_status == [[], [], [], []]
    assert r.risk_status[0].attitude == "FAIL" and r.intent_status == "FAIL" and r.identity_status == "FAIL"
    assert [i.field for i in r.review_items] == ["intent", "attitude", "attitude", "attitude", "attitude", "identity"]
    doubt = run(spark, text, needs_review=True)
    assert (doubt.intent_status, doubt.status, doubt.review_items) == ("REVIEW", "PARTIAL", [])
