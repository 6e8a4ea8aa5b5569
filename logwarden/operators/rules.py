"""Rule detection: one boolean column per rule, so a single pass with no join."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from logwarden.functions.columns import pinned
from logwarden.functions.scales import SEVERITY_RANK, label_of, severity_name
from logwarden.operators.rule_packs import DEFAULT_RULES

# Rule field name -> request column.
FIELD_COLUMNS = {
    "request": "normalized_request", "query_string": "normalized_query_string",
    "query": "normalized_query_string", "uri": "normalized_uri", "path": "normalized_uri",
    "user_agent": "normalized_user_agent", "url": "normalized_url", "raw_uri": "raw_uri",
    "original_url": "original_url", "decoded_uri": "decoded_uri",
    "decoded_query_string": "decoded_query_string", "decode_depth": "decode_depth",
    "decode_changed": "decode_changed", "removed_control_chars": "removed_control_chars",
    "status_code": "status_code", "response_size": "response_size",
    "source_ip": "source_ip", "http_method": "http_method",
}
RULE_KEYS = ["id", "field", "type", "pattern", "score", "severity"]
RULE_TYPES = ["contains", "regex"]
MAX_RULES = 2_000
MATCH_TYPE = ("struct<id:string,category:string,description:string,score:int,severity:string,"
              "field:string,actual_field:string,pattern:string,type:string,matched_text:string>")

# A quantified group whose body is itself quantified can take exponential time.
_NESTED_QUANTIFIER = re.compile(r"\((?:\?:)?[\w.\\\[\]^$-]*(?:[+*]|\{\d+(?:,\d*)?\})[\w.\\\[\]^$-]*\)[+*]", re.ASCII)


def _problem(rule: dict, seen: set[str]) -> str | None:
    missing = [k for k in RULE_KEYS if rule.get(k) is None]
    rule_id = str(rule.get("id") or "").strip()
    if missing:
        return f"rule {rule_id or '?'} lacks {missing}"
    if not rule_id:
        return "rule with an empty id"
    if rule_id in seen:
        return f"duplicate rule id {rule_id}"
    if str(rule["type"]).strip().lower() not in RULE_TYPES:
        return f"rule {rule_id} has an unknown type"
    if str(rule["severity"]).strip().lower() not in SEVERITY_RANK:
        return f"rule {rule_id} has an unknown severity"
    try:
        if int(rule["score"]) < 0:
            return f"rule {rule_id} has a negative score"
    except (TypeError, ValueError):
        return f"rule {rule_id} has a score that is no integer"
    if not str(rule["field"]).strip() or not str(rule["pattern"]):
        return f"rule {rule_id} has an empty field or pattern"
    return None


def load_rules(rules: Iterable[dict] | DataFrame, strict: bool = True) -> tuple[list[dict], list[str]]:
    """Validated rules and load errors.

    A rule may carry ``needs``: lower-case texts of which every match holds at least one.

    ``strict`` raises on the first bad rule; otherwise bad rules are left out and
    reported. A rules table is read to the driver only up to ``MAX_RULES`` rows.
    """
    if isinstance(rules, DataFrame):
        rows = rules.limit(MAX_RULES + 1).collect()
        if len(rows) > MAX_RULES:
            raise ValueError(f"rule table holds more than {MAX_RULES} rules")
        rules = [r.asDict() for r in rows]
    good, errors, seen = [], [], set()

    def reject(message: str) -> None:
        if strict:
            raise ValueError(message)
        errors.append(message)

    for rule in rules:
        problem = _problem(rule, seen)
        if problem:
            reject(problem)
            continue
        ready = {
            "category": str(rule["category"]), "id": str(rule["id"]).strip(),
            "description": rule.get("description") or "", "score": int(rule["score"]),
            "severity": str(rule["severity"]).strip().lower(), "field": str(rule["field"]).strip(),
            "pattern": str(rule["pattern"]), "type": str(rule["type"]).strip().lower(),
            "needs": [str(t).lower() for t in rule.get("needs") or []],
        }
        seen.add(ready["id"])
        if ready["type"] == "regex":
            try:
                re.compile(ready["pattern"], re.IGNORECASE)
            except re.error as exc:
                reject(f"rule {ready['id']} has an invalid pattern: {exc}")
                continue
            if _NESTED_QUANTIFIER.search(ready["pattern"].replace(" ", "")):
                message = f"rule {ready['id']} may backtrack without bound"
                if strict:
                    raise ValueError(message)
                errors.append(message)
        good.append(ready)
    return good, errors


def rules_version(rules: list[dict]) -> str:
    """First 12 hex digits of the SHA-1 of the rule text."""
    text = json.dumps(rules, sort_keys=True, ensure_ascii=False)
    return hashlib.sha1(text.encode()).hexdigest()[:12]


def rule_column(rule: dict) -> str:
    return FIELD_COLUMNS.get(rule["field"], rule["field"])


def _hit(rule: dict, target: Column, lowered: Column) -> Column:
    if rule["type"] == "contains":
        return lowered.contains(rule["pattern"].lower())
    found = target.rlike(f"(?i){rule['pattern']}")
    texts = rule.get("needs")
    return reduce(lambda a, b: a | b, [lowered.contains(t) for t in texts]) & found if texts else found


def detect(df: DataFrame, rules: list[dict] | None = None, version: str | None = None,
           max_target: int | None = None, max_evidence: int | None = None) -> DataFrame:
    """Adds the rule result columns to preprocessed requests.

    Whole texts are searched and whole matches kept, unless ``max_target`` or ``max_evidence`` bound them.
    """
    rules = DEFAULT_RULES if rules is None else rules
    version = version or rules_version(rules)
    hits, matches, errors = {}, [], []

    def bounded(text: Column, most: int | None) -> Column:
        return F.substring(text, 1, most) if most else text

    used = [c for c in dict.fromkeys(rule_column(r) for r in rules) if c in df.columns]
    # Target texts, cut and lower-cased once for all rules.
    texts = df.withColumns({f"_text_{c}": bounded(F.coalesce(F.col(c).cast("string"), F.lit("")), max_target) for c in used})
    texts = texts.withColumns({f"_lower_{c}": F.lower(f"_text_{c}") for c in used}) if used else texts
    for i, rule in enumerate(rules):
        name = rule_column(rule)
        h = f"_hit_{i}"
        if name not in used:
            hits[h] = F.lit(False)
            errors.append(F.lit(f"field_missing:{rule['id']}:{name}"))
            continue
        target = F.col(f"_text_{name}")
        hits[h] = (target != "") & _hit(rule, target, F.col(f"_lower_{name}"))
        if max_target:
            errors.append(F.when(F.length(F.col(name).cast("string")) > max_target,
                                 f"target_truncated:{rule['id']}:{name}"))
        found = F.lit(rule["pattern"]) if rule["type"] == "contains" else bounded(
            F.regexp_extract(target, f"(?i){rule['pattern']}", 0), max_evidence)
        matches.append(F.when(F.col(h), F.struct(
            F.lit(rule["id"]), F.lit(rule["category"]), F.lit(rule["description"]), F.lit(rule["score"]),
            F.lit(rule["severity"]), F.lit(rule["field"]), F.lit(name), F.lit(rule["pattern"]),
            F.lit(rule["type"]), found).cast(MATCH_TYPE)))
    base = texts.withColumns(hits)

    categories = sorted({r["category"] for r in rules})
    per_category = {}
    for c in categories:
        own = [(F.col(f"_hit_{i}"), r) for i, r in enumerate(rules) if r["category"] == c]

        def best(value, own=own):
            cols = [F.when(h, F.lit(value(r))) for h, r in own]
            return F.greatest(*cols) if len(cols) > 1 else cols[0]

        per_category[f"_cat_{c}"] = F.struct(
            best(lambda r: r["score"]).alias("score"),
            best(lambda r: SEVERITY_RANK[r["severity"]]).alias("rank"), F.lit(c).alias("category"))
    summary = F.array_compact(F.array(*[
        F.when(v["score"].isNotNull(), v) for v in per_category.values()]))
    out = base.withColumns({
        "_cats": pinned(summary),
        "_matches": F.array_compact(F.array(*matches)) if matches else F.array().cast(f"array<{MATCH_TYPE}>"),
        "_errors": F.array_compact(F.array(*errors)) if errors else F.array().cast("array<string>"),
    })
    total = F.aggregate("_cats", F.lit(0), lambda a, c: a + c["score"])
    out = out.withColumns({
        "_score": F.least(F.lit(100), total + 10 * F.greatest(F.lit(0), F.size("_cats") - 1)),
        "_rank": F.coalesce(F.array_max(F.transform("_cats", lambda c: c["rank"])), F.lit(0)),
    })
    return out.select(
        *df.columns,
        label_of(F.col("_score")).alias("rule_label"),
        F.col("_score").alias("rule_score"),
        severity_name(F.col("_rank")).alias("rule_severity"),
        F.array_max("_cats")["category"].alias("attack_type"),
        F.array_sort(F.transform("_cats", lambda c: c["category"])).alias("attack_types"),
        F.map_from_entries(F.transform("_cats", lambda c: F.struct(c["category"], c["score"]))).alias("score_by_category"),
        F.map_from_entries(F.transform("_cats", lambda c: F.struct(
            c["category"], severity_name(c["rank"])))).alias("severity_by_category"),
        F.col("_matches").alias("matched_rules"),
        F.transform("_matches", lambda m: m["id"]).alias("matched_rule_ids"),
        F.when(F.size("_errors") > 0, "error").otherwise("success").alias("detector_status"),
        F.col("_errors").alias("detector_errors"),
        F.lit(version).alias("rule_version"),
    )


def match_rows(detected: DataFrame, key: str = "event_id") -> DataFrame:
    """One row per (request, matched rule)."""
    return detected.select(key, F.explode("matched_rules").alias("m")).select(key, "m.*")
