"""Training targets from wide label tables or from feature flags."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

# Label column pattern, target order and the words that map columns to targets.
LABEL_COLUMN = re.compile(r"^\d+\s+-\s+")
TYPE_WORDS = {
    "path_traversal": ["path traversal", "traversal", "directory traversal"],
    "sqli": ["sql injection", "sqli", "sql"],
    "xss": ["xss", "cross site scripting", "cross-site scripting", "script"],
    "command_injection": ["command injection", "os command injection"],
    "scanning": ["scanning", "scanner", "vulnerable software", "dictionary-based"],
    "protocol_manipulation": ["protocol manipulation", "http verb tampering"],
    "request_smuggling": ["request smuggling", "response splitting"],
    "input_manipulation": ["input data manipulation"],
}
TRAINING_WORDS = {
    "path_traversal": ["path traversal", "traversal", "directory traversal"],
    "sqli": ["sql injection", "sqli", "sql"],
    "xss": ["xss", "cross site scripting", "cross-site scripting", "script"],
    "scanning": ["scanning", "scanner", "vulnerable software"],
}


def _type_of(column: str, words: dict[str, list[str]]) -> str | None:
    low = column.lower()
    return next((t for t, ws in words.items() if any(w in low for w in ws)), None)


def _targets(df: DataFrame, words: dict[str, list[str]], default: str, benign: str | None) -> tuple[Column, Column]:
    columns = [c for c in df.columns if LABEL_COLUMN.match(c.strip())]
    attacks = [c for c in columns if not (c.lower().startswith("000") or "normal" in c.lower())]
    if not attacks:
        raise ValueError("no attack label columns found")

    def any_set(names: list[str]) -> Column:
        out = F.lit(False)
        for n in names:
            out = out | (F.coalesce(F.col(f"`{n}`").try_cast("double"), F.lit(0.0)).cast("int") > 0)
        return out

    attack = any_set(attacks)
    kind = F
    for target in words:
        own = [c for c in attacks if _type_of(c, words) == target]
        if own:
            kind = kind.when(any_set(own), F.lit(target))
    kind = kind.when(attack, F.lit(default)).otherwise(F.lit(benign or default)) if kind is not F else F.when(
        attack, F.lit(default)).otherwise(F.lit(benign or default))
    return attack, kind


def training_targets(df: DataFrame) -> DataFrame:
    """Adds ``binary_target`` (0/1) and ``attack_type_target`` (four types or unknown)."""
    attack, kind = _targets(df, TRAINING_WORDS, "unknown", None)
    return df.withColumns({"binary_target": attack.cast("int"), "attack_type_target": kind})


def evaluation_targets(df: DataFrame) -> DataFrame:
    """Adds ``binary_label`` and ``attack_type_label`` (eight types, other_attack or normal)."""
    attack, kind = _targets(df, TYPE_WORDS, "other_attack", "normal")
    return df.withColumns({"binary_label": F.when(attack, "attack").otherwise("benign"), "attack_type_label": kind})


def weak_targets(df: DataFrame) -> DataFrame:
    """The same two columns guessed from feature flags."""
    def on(name: str) -> Column:
        return F.coalesce(F.col(name).try_cast("double"), F.lit(0.0)) != 0 if name in df.columns else F.lit(False)

    kind = (
        F.when(on("feature_has_path_traversal"), "path_traversal")
        .when(on("feature_has_sql_keyword") | on("feature_has_sqli_evasion_pattern"), "sqli")
        .when(on("feature_has_xss_keyword"), "xss")
        .when(on("feature_is_scanner_user_agent"), "scanning").otherwise("normal")
    )
    return df.withColumns({"binary_label": F.when(kind == "normal", "benign").otherwise("attack"), "attack_type_label": kind})


def align_by_row(features: DataFrame, labels: DataFrame, offset: int = 0, row: str = "row_index") -> DataFrame:
    """Features joined to labels by row number; raises when their counts differ.

    Feature row ``i`` belongs to label row ``i + offset``.
    """
    shifted = labels.withColumn(row, F.col(row) - offset).where(F.col(row) >= 0)
    joined = features.join(shifted, row)
    n, m = features.count(), joined.count()
    if n != m:
        raise ValueError(f"row count mismatch after label alignment: features={n} labels={m}")
    return joined
