"""Review of changed files: categories, risk, postflight differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Categories by the path in lower case.
CATEGORIES = {
    "TEST": r"(^|/)tests/|^test_", "DOCUMENTATION": r"\.(md|rst|txt)$|^docs/", "SOURCE": r"\.(py|js|tsx?|java|go|rs)$",
    "DEPENDENCY": r"^(pyproject\.toml|poetry\.lock|uv\.lock|requirements\.txt|package-lock\.json|pnpm-lock\.yaml|yarn\.lock|cargo\.lock)$", "CONFIGURATION": r"^config/|\.(toml|ini|ya?ml|json)$",
    "PLUGIN": r"^(skills|plugins)/", "SCHEMA_OR_MIGRATION": "migration|schema|database|snapshot", "SECURITY_SENSITIVE": r"^\.github/workflows/|^\.git/hooks/|\.env|credential|secret|token",
}
HIGH = ["SECURITY_SENSITIVE", "SCHEMA_OR_MIGRATION", "CONFIGURATION", "DEPENDENCY", "PLUGIN"]
MEDIUM = ["SOURCE", "GENERATED_ARTIFACT"]


def categories(path: Column, ignored: Column | None = None) -> Column:
    """Sorted categories of a path; OTHER for none."""
    low = F.lower(path)
    found = [F.when(low.rlike(p), F.lit(n)) for n, p in CATEGORIES.items()]
    if ignored is not None:
        found.append(F.when(ignored, F.lit("GENERATED_ARTIFACT")))
    out = F.array_sort(F.array_compact(F.array(*found)))
    return F.when(F.size(out) == 0, F.array(F.lit("OTHER"))).otherwise(out)


def risk(found: Column) -> Column:
    any_of = lambda names: F.arrays_overlap(found, F.array(*[F.lit(n) for n in names]))
    return F.when(any_of(HIGH), "HIGH").when(any_of(MEDIUM), "MEDIUM").otherwise("LOW")


def change_review(changes: DataFrame, group: str, path: str) -> DataFrame:
    """Per group: changes, changes of each risk, the highest risk."""
    rows = changes.withColumn("_r", risk(categories(F.col(path))))
    rank = F.when(F.col("_r") == "HIGH", 3).when(F.col("_r") == "MEDIUM", 2).otherwise(1)
    return rows.groupBy(group).agg(
        F.count(F.lit(1)).alias("changes"), *[F.count_if(F.col("_r") == k).alias(k.lower()) for k in ("HIGH", "MEDIUM", "LOW")], F.max_by("_r", rank).alias("risk")
    )


def postflight(before: DataFrame, after: DataFrame, path: str) -> DataFrame:
    """Paths whose state records differ between two observations: path, outcome."""
    own = [c for c in before.columns if c != path]
    state = F.struct(*own)
    j = before.select(path, state.alias("_b")).join(after.select(path, state.alias("_a")), path, "full")
    outcome = F.when(F.col("_b").isNull(), "APPEARED").when(F.col("_a").isNull(), "DISAPPEARED").when(~F.col("_a").eqNullSafe(F.col("_b")), "CHANGED")
    return j.select(path, outcome.alias("outcome")).where("outcome is not null")
