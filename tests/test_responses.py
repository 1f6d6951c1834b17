import json

import pytest
from pyspark.sql import functions as F

from treelift.operators import responses as P

HASH = "sha256:" + "ab" * 32
GOOD = {
    "analysis_hash": HASH, "verdict": "portable", "confidence": 0.95, "reason_codes": ["SELF_CONTAINED_FILES", "OTHER_1"],
    "evidence": [{"path": "a.md", "line": 1, "value": "one"}], "rationale": "fine",
}
ITEM = GOOD["evidence"][0]


def changed(**fields):
    return json.dumps({**GOOD, **fields})


def item(**fields):
    return changed(evidence=[ITEM, {**ITEM, **fields}])


CASES = [
    (json.dumps(GOOD), None), (" \n" + json.dumps(GOOD) + "\n ", None), (changed(confidence=1), None), (changed(confidence=0), None),
    (changed(evidence=[{"path": "a.md", "line": 3, "value": "two"}]), None), (changed(evidence=[ITEM] * 32), None),
    (changed(verdict="plugin_bound", reason_codes=["PLUGIN_DEPENDENCY"]), None), (changed(verdict="ambiguous", reason_codes=["AUTONOMY_UNPROVEN"]), None),
    (None, "none"), ("", "json"), ("nope", "json"), (json.dumps(GOOD) + " x", "json"), (json.dumps(GOOD) + "]", "json"), (json.dumps(GOOD) + json.dumps(GOOD), "json"),
    (json.dumps(GOOD) + "," + json.dumps(GOOD), "json"), (json.dumps(GOOD) + ',"x"] ', "json"), (json.dumps(GOOD)[:-1], "json"), (json.dumps(GOOD)[:-1] + ',"verdict":"portable"}', "json"),
    (changed(evidence=[ITEM]).replace('"line": 1', '"line": 1, "line": 1'), "json"), ("[1]", "keys"), ("null", "keys"), ("5", "keys"), ("{}", "keys"), (changed(more=1), "keys"),
    (json.dumps({k: v for k, v in GOOD.items() if k != "rationale"}), "keys"), (changed(analysis_hash="sha256:" + "cd" * 32), "analysis_hash"), (changed(analysis_hash=5), "analysis_hash"),
    (changed(analysis_hash=HASH + "\n"), "analysis_hash"), (changed(verdict="Portable"), "verdict"), (changed(verdict=""), "verdict"), (changed(verdict=None), "verdict"),
    (changed(confidence=True), "confidence"), (changed(confidence="0.9"), "confidence"), (changed(confidence=1.5), "confidence"), (changed(confidence=-0.1), "confidence"),
    (changed(confidence=None), "confidence"), (json.dumps(GOOD).replace("0.95", "1e400"), "confidence"), (changed(reason_codes=[]), "reason_codes"), (changed(reason_codes="SELF_CONTAINED_FILES"), "reason_codes"),
    (changed(reason_codes=["SELF_CONTAINED_FILES"] * 2), "reason_codes"), (changed(reason_codes=["SELF_CONTAINED_FILES", 5]), "reason_codes"), (changed(reason_codes=["SELF_CONTAINED_FILES", None]), "reason_codes"),
    (changed(reason_codes=["SELF_CONTAINED_FILES", "low"]), "reason_codes"), (changed(reason_codes=["SELF_CONTAINED_FILES", "A" * 65]), "reason_codes"), (changed(reason_codes=["SELF_CONTAINED_FILES"] + [f"A{n}" for n in range(8)]), "reason_codes"),
    (changed(reason_codes=["OTHER"]), "support"), (changed(reason_codes=["PLUGIN_DEPENDENCY"]), "support"), (changed(reason_codes=["SELF_CONTAINED_FILES", "PLUGIN_DEPENDENCY"]), "support"),
    (changed(evidence=[]), "evidence"), (changed(evidence=None), "evidence"), (changed(evidence=ITEM), "evidence"), (changed(evidence=[ITEM] * 33), "evidence"),
    (changed(evidence=[5]), "evidence_keys"), (item(extra=1), "evidence_keys"), (item(path=5), "path"), (item(path=""), "path"), (item(path="a\tb"), "path"), (item(path="a" * 1025), "path"),
    (item(path="../a.md"), "path_form"), (item(path="/a.md"), "path_form"), (item(path="./a.md"), "path_form"), (item(path="."), "path_form"), (item(path="C:a"), "path_form"), (item(path="a\\b"), "path_form"),
    (item(line=0), "line"), (item(line=1.0), "line"), (item(line=True), "line"), (item(line="1"), "line"), (item(line=None), "line"), (item(line=10**30), "line"),
    (item(value=""), "value"), (item(value="x" * 513), "value"), (item(value=7), "value"), (item(value="absent"), "unseen"), (item(path="b.md"), "unseen"), (item(line=2**31), "unseen"), (item(line=2**63 - 1), "unseen"),
    (item(line=9), "unseen"), (changed(rationale=""), "rationale"), (changed(rationale=None), "rationale"), (changed(rationale="a\u0007"), "rationale"), (changed(rationale="x" * 4097), "rationale"),
    (changed(evidence=[{**ITEM, "value": "absent"}, {**ITEM, "path": ""}]), "unseen"), (changed(evidence=[{**ITEM, "path": ""}, {**ITEM, "value": "absent"}], rationale=""), "path"),
]


@pytest.fixture(scope="module")
def judged(spark):
    lines = spark.createDataFrame([("s", "a.md", 1, "line one"), ("s", "a.md", 2, "line two"), ("t", "b.md", 1, "one")], "source_id string, path string, line int, text string")
    answers = [("s", k, text, HASH) for k, (text, _) in enumerate(CASES)] + [("s", 900, CASES[0][0], HASH), ("s", 901, CASES[0][0], None), (None, 902, CASES[0][0], HASH), ("t", 903, CASES[0][0], HASH)]
    frame = spark.createDataFrame(answers, "source_id string, ord int, response string, expected_hash string")
    return {r.ord: r for r in P.judge_answers(frame, lines).collect()}


def test_each_rule(judged):
    for k, (text, rule) in enumerate(CASES):
        assert judged[k].rule == rule, (text, rule, judged[k])
        assert (judged[k].verdict is None) == (rule is not None)
    assert len(judged) == len(CASES) + 4
    assert judged[900].rule is None and judged[901].rule == "analysis_hash" and judged[903].rule == "unseen"
    assert judged[902].rule == "unseen"  # no source, so nothing was shown


def test_codes_and_lines(judged):
    by_rule = {r.rule: r.code for r in judged.values() if r.rule}
    assert {rule for rule, code in by_rule.items() if code == "FM_EVIDENCE_INVALID"} == set(P.EVIDENCE_RULES)
    assert by_rule["none"] == "FM_REVIEW_UNAVAILABLE" and {c for r, c in by_rule.items() if r not in [*P.EVIDENCE_RULES, "none"]} == {"FM_INVALID_RESPONSE"}
    assert [judged[k].code for k in (0, 3, 6, 7)] == ["FM_PORTABLE_VERIFIED", "FM_CONFIDENCE_TOO_LOW", "FM_PLUGIN_BOUND", "FM_REVIEW_UNAVAILABLE"]
    assert judged[4].lines == [2] and judged[5].lines == [1] * 32


def test_no_answers(spark):
    answers = spark.createDataFrame([], "source_id string, response string, expected_hash string")
    lines = spark.createDataFrame([], "source_id string, path string, line int, text string")
    assert P.judge_answers(answers, lines).count() == 0


def test_final_class(spark):
    rows = [(c, t, r) for c in ("FM_PORTABLE_VERIFIED", "FM_PLUGIN_BOUND", "FM_CONFIDENCE_TOO_LOW") for t in (False, True) for r in (False, True)]
    got = spark.createDataFrame(rows, "code string, t boolean, r boolean").select("*", P.final_class(F.col("code"), F.col("t"), F.col("r")).alias("f")).collect()
    assert [tuple(r.f) for r in got[:4]] == [("portable", "FM_PORTABLE_VERIFIED"), ("ambiguous", "FM_CONTEXT_REDACTED"), ("ambiguous", "FM_CONTEXT_TRUNCATED"), ("ambiguous", "FM_CONTEXT_TRUNCATED")]
    assert {tuple(r.f) for r in got[4:8]} == {("plugin_bound", "FM_PLUGIN_BOUND")} and {tuple(r.f) for r in got[8:]} == {("ambiguous", "FM_CONFIDENCE_TOO_LOW")}
