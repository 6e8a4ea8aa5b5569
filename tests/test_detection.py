"""Rules, features, risk."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from logwarden.operators.features import entropy, extract_features, feature_columns
from logwarden.operators.nested import flat_to_nested, nested_to_flat
from logwarden.operators.risk import score_risk
from logwarden.operators.rule_packs import BROAD_RULES, DEFAULT_RULES
from logwarden.operators.rules import detect, load_rules
from logwarden.schema import FEATURE_NAMES

FIELDS = ("normalized_request string, normalized_query_string string, normalized_uri string, normalized_user_agent string, "
          "normalized_url string, raw_uri string, decode_depth int, removed_control_chars boolean")


def run(spark, *rows, rules=None):
    return detect(spark.createDataFrame(list(rows), FIELDS), rules).collect()


def test_rules_hit_and_score(spark):
    clean = ("method=get | url=/ | user_agent=x", "", "/", "mozilla", "/", "/", 0, False)
    sqli = ("r", "id=1' or 1=1--", "/", "sqlmap/1.7", "/?id", "/", 2, True)
    a, b = run(spark, clean, sqli)
    assert (a.rule_score, a.rule_label, a.rule_severity, a.attack_type, a.matched_rules) == (0, "benign", "none", None, [])
    assert b.attack_types == ["evasion", "scanner", "sqli"] and b.attack_type == "sqli"
    assert b.score_by_category == {"evasion": 20, "scanner": 30, "sqli": 55}
    assert b.rule_score == 100 and b.rule_label == "malicious" and b.rule_severity == "high"
    assert b.matched_rule_ids == ["sqli_boolean_or", "scanner_sqlmap_ua", "evasion_multi_decode", "evasion_control_chars_removed"]
    assert b.matched_rules[0].matched_text == "' or 1=1" and b.detector_status == "success"


def test_look_ahead_rules(spark):
    rows = [("url=/admin/x status=403", "a;-- x", "/", "", "", "", 0, False), ("url=/admin/x", "-- ; y", "/", "", "", "", 0, False), ("r", "; --", "/", "", "", "", 0, False)]
    got = [r.matched_rule_ids for r in run(spark, *rows)]
    assert "sensitive_admin_success_or_forbidden" in got[0] and "sensitive_admin_success_or_forbidden" not in got[1]
    assert "sqli_comment_with_context" in got[1] and "sqli_comment_with_context" not in got[2]


def test_prefilter_changes_nothing(spark):
    texts = ["union  all select", "-- or", "/*;*/", "<svg x onload=", "/../", "%252e%2e", "nmap", "a/admin/ 200", "sleep (1)", "win.ini", "x/.env", "' or 1=1", "onload ="]
    rows = [(t, t, t, t, t, t, 0, False) for t in texts]
    for pack in (DEFAULT_RULES, BROAD_RULES):
        bare = [{k: v for k, v in r.items() if k != "needs"} for r in pack]
        assert [r.matched_rule_ids for r in run(spark, *rows, rules=pack)] == [r.matched_rule_ids for r in run(spark, *rows, rules=bare)]


def test_missing_field_and_long_target(spark):
    d = detect(spark.createDataFrame([("a" * 50 + "<script",)], "normalized_request string"), [DEFAULT_RULES[4], DEFAULT_RULES[0]], max_target=20).first()
    assert d.detector_errors == ["target_truncated:xss_script_tag:normalized_request", "field_missing:sqli_boolean_or:normalized_query_string"]
    assert d.detector_status == "error" and d.rule_score == 0


def test_rule_validation(spark):
    good = dict(DEFAULT_RULES[0])
    bad = [{**good, "id": ""}, {**good, "type": "glob"}, {**good, "id": "n", "score": -1}, {**good, "id": "p", "pattern": "("}, {**good, "id": "q", "severity": "huge"}, dict(good)]
    rules, errors = load_rules([good, *bad], strict=False)
    assert [r["id"] for r in rules] == [good["id"]] and len(errors) == 6
    for b in [*bad[:5], {**good, "id": "slow", "pattern": "(a+)+"}]:
        with pytest.raises(ValueError):
            load_rules([b])
    table = spark.createDataFrame([{k: v for k, v in r.items() if k != "needs"} for r in DEFAULT_RULES])
    assert len(load_rules(table)[0]) == 16 and len(load_rules(BROAD_RULES)[0]) == 21


@pytest.mark.parametrize("row,want", [
    ((60, 0.82, "attack", "sqli", "xss", 1, 0), (90, "malicious", "ml", "xss")),
    ((20, None, None, "scanner", None, 0, 1), (26, "suspicious", "rules", "scanner")),
    ((0, None, None, None, None, 0, 0), (0, "benign", "none", None))])
def test_risk(spark, row, want):
    df = spark.createDataFrame([row], "rule_score int, ml_attack_probability double, ml_label string, attack_type string, ml_attack_type string, feature_has_sql_keyword int, feature_is_scanner_user_agent int")
    r = score_risk(df).first()
    assert (r.risk_score, r.final_label, r.primary_signal, r.attack_type) == want


def test_ml_score_forms(spark):
    df = spark.createDataFrame([(0, 87.9, True), (0, None, True), (0, 0.5, False)], "rule_score int, ml_attack_probability double, ml_should_alert boolean")
    assert [r.risk_input_scores.ml for r in score_risk(df).collect()] == [87, 70, 0]


def test_features(spark):
    df = spark.createDataFrame([("/a-b/../c.php", "id=1&x=&=y&z", "sqlmap/1.0", "method=get | url=/a union/**/select 1", True, 3)],
                               "normalized_uri string, normalized_query_string string, normalized_user_agent string, normalized_request string, status_code_invalid boolean, decode_depth int")
    f = extract_features(df)
    r = f.first()
    assert [c for c in f.columns if c.startswith("feature_") and c not in ("feature_version", "feature_names")] == ["feature_" + n for n in FEATURE_NAMES] == feature_columns(f)
    assert (r.feature_param_count, r.feature_avg_param_name_length, r.feature_avg_param_value_length) == (4, 1.0, 0.5)
    assert (r.feature_uri_slash_count, r.feature_uri_dot_count, r.feature_uri_hyphen_count) == (3, 3, 1)
    assert (r.feature_has_sql_keyword, r.feature_has_sqli_evasion_pattern, r.feature_is_scanner_user_agent, r.feature_status_code_invalid, r.feature_decode_depth) == (1, 1, 1, 1, 3)


def test_entropy(spark):
    texts = ["", "aaaa", "abcd", "héllo wörld 😀😀"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(entropy(F.col("t"))).collect()]
    want = [round(-sum(n / len(t) * math.log2(n / len(t)) for n in Counter(t).values()), 4) + 0.0 if t else 0.0 for t in texts]
    assert got == want


def test_nested_layout(spark):
    flat = spark.createDataFrame([("e", "1.1.1.1", "GET", "/x", 200, 3.0, "v2", 5, 80)],
                                 "event_id string, source_ip string, http_method string, uri string, status_code int, feature_uri_length double, feature_version string, rule_score int, risk_score int")
    nested = flat_to_nested(flat)
    r = nested.first()
    assert r._schema_version == 2 and r.request.method == "GET" and r.features.vector == {"uri_length": 3.0} and r.scoring.risk_score == 80
    back = nested_to_flat(nested, ["uri_length"]).first()
    assert (back.source_ip, back.feature_uri_length, back.rule_score, back.ip) == ("1.1.1.1", 3.0, 5, "1.1.1.1")
    assert flat_to_nested(nested) is nested
