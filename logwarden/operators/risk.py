"""Blend of rule, ML and feature signals into one verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from logwarden.functions.columns import pinned
from logwarden.functions.scales import clean_attack_type, label_of, risk_level

# Bonus points per feature signal.
FLAG_BONUS = [("feature_has_sql_keyword", 8), ("feature_has_xss_keyword", 8),
              ("feature_has_path_traversal", 8), ("feature_is_scanner_user_agent", 6)]
SPECIAL_CHAR_COUNTS = ["feature_uri_special_char_count", "feature_query_special_char_count",
                       "feature_ua_special_char_count"]
MANY_SPECIAL, MANY_SPECIAL_BONUS = 20, 4
MANY_PARAMS, MANY_PARAMS_BONUS = 10, 3
SERVER_ERROR, SERVER_ERROR_BONUS = 500, 3
ALERT_LABELS = ["attack", "malicious", "suspicious"]


def score_risk(df: DataFrame, suspicious: int = 25, malicious: int = 70) -> DataFrame:
    """Adds risk score, label, level, sources, primary signal and resolved attack types."""
    def whole(name: str) -> Column:
        return F.coalesce(F.col(name).try_cast("double").try_cast("int"), F.lit(0)) if name in df.columns else F.lit(0)

    def text(name: str) -> Column:
        return F.col(name).cast("string") if name in df.columns else F.lit(None).cast("string")

    def low(name: str) -> Column:
        return F.lower(F.trim(F.coalesce(text(name), F.lit(""))))

    flag = F.col("ml_should_alert").try_cast("boolean") if "ml_should_alert" in df.columns else F.lit(False)
    ml_signal = F.coalesce(flag, F.lit(False)) | low("ml_label").isin(ALERT_LABELS)
    ids = F.col("matched_rule_ids") if "matched_rule_ids" in df.columns else F.lit(None).cast("array<string>")
    rule_signal = (whole("rule_score") > 0) | F.coalesce(F.size(ids) > 0, F.lit(False)) | low("rule_label").isin(ALERT_LABELS)
    share = F.coalesce(text("ml_attack_probability").try_cast("double"), text("ml_confidence").try_cast("double"))
    points = F.when(share <= 1.0, share * 100).otherwise(share)
    ml_score = (
        F.when(~ml_signal, F.lit(0))
        .when(share.isNull(), F.lit(malicious))
        .otherwise(F.greatest(F.lit(0), F.least(F.lit(100), points.cast("int"))))
    )
    bonus = F.lit(0)
    for name, points_each in FLAG_BONUS:
        bonus = bonus + F.when(whole(name) != 0, points_each).otherwise(0)
    special = whole(SPECIAL_CHAR_COUNTS[0]) + whole(SPECIAL_CHAR_COUNTS[1]) + whole(SPECIAL_CHAR_COUNTS[2])
    bonus = (
        bonus + F.when(special >= MANY_SPECIAL, MANY_SPECIAL_BONUS).otherwise(0)
        + F.when(whole("feature_param_count") >= MANY_PARAMS, MANY_PARAMS_BONUS).otherwise(0)
        + F.when(whole("status_code") >= SERVER_ERROR, SERVER_ERROR_BONUS).otherwise(0)
    )
    types = F.col("attack_types") if "attack_types" in df.columns else F.array().cast("array<string>")
    step = df.withColumns({
        "_rule": whole("rule_score"), "_ml": ml_score, "_bonus": bonus,
        "_rs": rule_signal, "_ms": ml_signal,
        "_rt": clean_attack_type(text("attack_type")),
        "_mt": F.when(ml_signal, clean_attack_type(text("ml_attack_type"))),
    })
    step = step.withColumns({
        "_base": F.greatest("_rule", "_ml"),
        "_score": pinned(F.least(F.lit(100), F.greatest("_rule", "_ml") + F.col("_bonus"))),
        "_types": F.array_distinct(F.array_compact(F.concat(
            F.transform(F.coalesce(types, F.array().cast("array<string>")), clean_attack_type),
            F.array("_rt", "_mt")))),
    })
    label = label_of(F.col("_score"), suspicious, malicious)
    rs, ms = F.col("_rs"), F.col("_ms")
    result = {
        "detection_method": F.lit("hybrid"),
        "detection_sources": F.array_compact(F.array(
            F.when(rs, "rules"), F.when(ms, "ml"), F.when(F.col("_bonus") > 0, "features"))),
        "primary_signal": F.when(rs & ms & (F.col("_rule") == F.col("_ml")), "rules+ml")
        .when((F.col("_rule") >= F.col("_ml")) & rs, "rules")
        .when((F.col("_ml") > F.col("_rule")) & ms, "ml")
        .when(F.col("_bonus") > 0, "features").otherwise("none"),
        "attack_type": F.when(F.col("_mt").isNotNull() & ((F.col("_ml") > F.col("_rule")) | F.col("_rt").isNull()),
                              F.col("_mt")).otherwise(F.coalesce("_rt", "_mt")),
        "attack_types": F.col("_types"),
        "risk_score": F.col("_score"),
        "risk_bonus": F.col("_bonus"),
        "risk_input_scores": F.struct(F.col("_rule").alias("rules"), F.col("_ml").alias("ml"),
                                      F.col("_bonus").alias("features"), F.col("_base").alias("base")),
        "risk_level": risk_level(F.col("_score")),
        "final_label": label,
        "should_alert": label.isin("suspicious", "malicious"),
    }
    kept = [c for c in df.columns if c not in result]
    return step.select(*kept, *[c.alias(n) for n, c in result.items()])
