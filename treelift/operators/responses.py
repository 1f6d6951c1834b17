"""A reviewer's answers, read strictly: one row per answer, with the rule that it breaks or the verdict that it gives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treelift.functions.json_values import parse_whole
from treelift.functions.paths import is_normalized
from treelift.operators.review import resolve_lines

#: The keys of an answer and of its evidence, the code that each verdict needs, and the limits.
KEYS = ["analysis_hash", "confidence", "evidence", "rationale", "reason_codes", "verdict"]
EVIDENCE_KEYS = ["line", "path", "value"]
NEEDED_CODE = {"portable": "SELF_CONTAINED_FILES", "plugin_bound": "PLUGIN_DEPENDENCY", "ambiguous": "AUTONOMY_UNPROVEN"}
MOST_CODES, MOST_EVIDENCE = 8, 32
LONGEST = {"analysis_hash": 71, "verdict": 32, "path": 1024, "value": 512, "rationale": 4096}
LEAST_CONFIDENCE = 0.9
#: Rules that make the evidence invalid; all others make the whole answer so.
EVIDENCE_RULES = ["evidence", "evidence_keys", "path_form", "line", "unseen"]
#: Lines beyond this are in no file.
LAST_LINE = 2**31 - 2


def _get(value: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(value, path, kind)


def _is(value: Column, *kinds: str) -> Column:
    """Whether a variant is of one of these types; a missing one is of none."""
    return F.coalesce(F.regexp_replace(F.schema_of_variant(value), r"[(<].*", "").isin(*kinds), F.lit(False))


def _has_keys(value: Column, keys: list[str]) -> Column:
    found = F.sort_array(F.map_keys(_get(value, "$", "map<string,variant>")))
    return _is(value, "OBJECT") & F.coalesce(found == F.array(*map(F.lit, keys)), F.lit(False))


def _text(value: Column, field: str) -> tuple[Column, Column]:
    """A field as a string, and whether it is one: not empty, not too long, without control characters."""
    own = _get(value, f"$.{field}", "variant")
    text = F.when(_is(own, "STRING"), _get(own, "$", "string"))
    return text, F.coalesce(F.length(text).between(1, LONGEST[field]) & ~text.rlike(r"[\x00-\x1F\x7F]"), F.lit(False))


def _items(answers: DataFrame) -> DataFrame:
    """source_id, digest, ord, path, line, value, rule: the evidence of answers that hold a list of the right length."""
    rows = answers.select("source_id", "digest", F.posexplode("evidence").alias("ord", "e"))
    path, clean_path = _text(F.col("e"), "path")
    value, clean_value = _text(F.col("e"), "value")
    number = _get(F.col("e"), "$.line", "variant")
    facts = rows.select(
        "source_id", "digest", "ord", _has_keys(F.col("e"), EVIDENCE_KEYS).alias("keys"), path.alias("path"), clean_path.alias("clean_path"),
        F.when(_is(number, "BIGINT"), _get(number, "$", "bigint")).alias("line"), value.alias("value"), clean_value.alias("clean_value"),
    )
    rule = (
        F.when(~F.col("keys"), "evidence_keys")
        .when(~F.col("clean_path"), "path")
        .when(~is_normalized(F.col("path")), "path_form")
        .when(~F.coalesce(F.col("line") >= 1, F.lit(False)), "line")
        .when(~F.col("clean_value"), "value")
    )
    return facts.select("source_id", "digest", "ord", "path", "line", "value", rule.alias("rule"))


def judge_answers(answers: DataFrame, lines: DataFrame) -> DataFrame:
    """All columns of answers, then rule, code, verdict, confidence, lines (where the evidence stands).

    answers: source_id, response, expected_hash, and whatever else; lines as :func:`~treelift.operators.review.shown_lines` gives them.  rule is the first rule that the
    answer breaks, null if it keeps them all: none (no answer), json, keys, analysis_hash, verdict, confidence, reason_codes, support, those of the
    evidence in its order, rationale.  A broken answer has no verdict.  Repeated rows stay; what they cite is looked up once.
    """
    v = F.col("__v")
    rows = answers.withColumns({"__digest": F.sha2("response", 256), "__v": parse_whole(F.col("response"))})
    listed = _get(v, "$.evidence", "array<variant>")
    fits = _is(_get(v, "$.evidence", "variant"), "ARRAY") & F.coalesce(F.size(listed).between(1, MOST_EVIDENCE), F.lit(False))
    evidence = rows.where(fits).select("source_id", F.col("__digest").alias("digest"), "response").dropDuplicates(["source_id", "digest"])
    evidence = evidence.select("source_id", "digest", _get(parse_whole(F.col("response")), "$.evidence", "array<variant>").alias("evidence"))
    items = _items(evidence)
    asked = F.when(F.col("rule").isNull() & (F.col("line") <= LAST_LINE), F.col("line").cast("int"))
    found = resolve_lines(items.withColumn("line", asked), lines)
    broken = F.coalesce("rule", F.when(F.col("resolved").isNull(), "unseen"))
    first = found.groupBy("source_id", "digest").agg(
        F.min(F.when(broken.isNotNull(), F.struct("ord", broken.alias("rule"))))["rule"].alias("__item"),
        F.transform(F.array_sort(F.collect_list(F.struct("ord", "resolved"))), lambda x: x["resolved"]).alias("__lines"),
    )
    rows = rows.join(first.withColumnRenamed("digest", "__digest"), ["source_id", "__digest"], "left")

    digest, clean_digest = _text(v, "analysis_hash")
    verdict, clean_verdict = _text(v, "verdict")
    _, clean_rationale = _text(v, "rationale")
    number = _get(v, "$.confidence", "variant")
    codes = _get(v, "$.reason_codes", "array<variant>")
    are_codes = F.forall(codes, lambda c: _is(c, "STRING") & F.coalesce(_get(c, "$", "string").rlike(r"\A[A-Z][A-Z0-9_]{0,63}\z"), F.lit(False)))
    rows = rows.select(
        *answers.columns, "__item", "__lines", v.isNotNull().alias("__json"), _has_keys(v, KEYS).alias("__keys"), fits.alias("__fits"), clean_rationale.alias("__rationale"),
        F.when(clean_digest, digest).alias("__hash"), F.when(clean_verdict, verdict).alias("__said"), F.when(are_codes, F.transform(codes, lambda c: _get(c, "$", "string"))).alias("__codes"),
        F.when(_is(number, "BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), _get(number, "$", "double")).alias("__sure"),
    )
    said, sure, names = F.col("__said"), F.col("__sure"), F.col("__codes")
    sound = F.size(names).between(1, MOST_CODES) & (F.size(F.array_distinct(names)) == F.size(names))
    needed = F.create_map(*(F.lit(x) for pair in NEEDED_CODE.items() for x in pair))
    support = F.array_intersect(names, F.array(*map(F.lit, NEEDED_CODE.values()))) == F.array(F.element_at(needed, said))
    no = lambda condition: ~F.coalesce(condition, F.lit(False))
    rule = (
        F.when(F.col("response").isNull(), "none")
        .when(~F.col("__json"), "json")
        .when(~F.col("__keys"), "keys")
        .when(no(F.col("__hash").rlike(r"\Asha256:[0-9a-f]{64}\z") & (F.col("__hash") == F.col("expected_hash"))), "analysis_hash")
        .when(no(said.isin(*NEEDED_CODE)), "verdict")
        .when(no((sure >= 0) & (sure <= 1)), "confidence")
        .when(no(sound), "reason_codes")
        .when(no(support), "support")
        .when(~F.col("__fits"), "evidence")
        .when(F.col("__item").isNotNull(), F.col("__item"))
        .when(F.col("__lines").isNull(), "unseen")  # an answer without a source
        .when(~F.col("__rationale"), "rationale")
    )
    rows = rows.withColumn("rule", rule)
    kept = F.col("rule").isNull()
    code = F.when(F.col("rule") == "none", "FM_REVIEW_UNAVAILABLE").when(F.col("rule").isin(*EVIDENCE_RULES), "FM_EVIDENCE_INVALID").when(~kept, "FM_INVALID_RESPONSE")
    given = F.when(said == "plugin_bound", "FM_PLUGIN_BOUND").when(said == "ambiguous", "FM_REVIEW_UNAVAILABLE").when(sure >= LEAST_CONFIDENCE, "FM_PORTABLE_VERIFIED")
    return rows.select(
        *answers.columns, "rule", F.coalesce(code, given, F.lit("FM_CONFIDENCE_TOO_LOW")).alias("code"), F.when(kept, said).alias("verdict"),
        F.when(kept, sure).alias("confidence"), F.when(kept, F.col("__lines")).alias("lines"),
    )


def final_class(code: Column, truncated: Column, redacted: Column) -> Column:
    """(classification, code) of an ambiguous candidate after its review: nothing is portable that wasn't shown whole and unchanged."""
    sure = code == "FM_PORTABLE_VERIFIED"
    final = F.when(sure & truncated, "FM_CONTEXT_TRUNCATED").when(sure & redacted, "FM_CONTEXT_REDACTED").otherwise(code)
    kind = F.when(final == "FM_PLUGIN_BOUND", "plugin_bound").when(final == "FM_PORTABLE_VERIFIED", "portable").otherwise("ambiguous")
    return F.struct(kind.alias("classification"), final.alias("code"))
