"""Integrity rules of the stored tables, as one row per broken rule and key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentgrid.operators.joins import join_per_key
from talentgrid.schemas import LENGTHS, TABLES
from talentgrid.settings import JOB_TYPES, UPLOAD_STATUSES

_PRIMARY = {
    "cv_upload": ["id"],
    "candidate": ["id"],
    "candidate_skill": ["candidate_id", "skill"],
    "processing_failure": ["id"],
    "upload_storage_cleanup": ["upload_id"],
}
_FOREIGN = (
    ("candidate", "upload_id", "cv_upload"),
    ("candidate_skill", "candidate_id", "candidate"),
    ("processing_failure", "upload_id", "cv_upload"),
    ("upload_storage_cleanup", "upload_id", "cv_upload"),
)
_UNIQUE = (("candidate", "candidate unique (upload_id, source_filename)", ["upload_id", "source_filename"]),)


def _row_rules(table: str) -> dict[str, Column]:
    """Rules a row breaks by itself: rule name → condition."""
    rules = {}
    for field in TABLES[table].fields:
        if not field.nullable:
            rules[f"{table}.{field.name} not null"] = F.col(field.name).isNull()
    for column, length in LENGTHS.get(table, {}).items():
        rules[f"{table}.{column} length"] = F.length(column) > length
    if table == "cv_upload":
        for column in ("total_files", "processed_files", "failed_files"):
            rules[f"{table}.{column} >= 0"] = F.col(column) < 0
        rules["cv_upload.status enum"] = ~F.col("status").isin(*UPLOAD_STATUSES)
    if table == "candidate":
        rules["candidate.years_of_experience >= 0"] = F.col("years_of_experience") < 0
        rules["candidate.preferred_job_type enum"] = ~F.col("preferred_job_type").isin(*JOB_TYPES)
    return rules


def _check(space: str, keys: list[str], reference: int = 0) -> Column:
    """A key that a row holds (reference 0), or that it refers to by foreign rule number `reference`."""
    first, second = (*[F.col(c).cast("string") for c in keys], F.lit(None).cast("string"))[:2]
    return F.struct(F.lit(space).alias("space"), first.alias("k1"), second.alias("k2"), F.lit(reference).alias("reference"))


def _checks(table: str, df: DataFrame) -> DataFrame:
    """Everything to be counted about a table, from one scan: its keys, its references, and the rules a row breaks."""
    primary = _PRIMARY[table]
    checks = [_check(table, primary)]
    checks += [_check(rule, columns) for owner, rule, columns in _UNIQUE if owner == table]
    for number, (child, column, owner) in enumerate(_FOREIGN, 1):
        if child == table:
            checks.append(F.when(F.col(column).isNotNull(), _check(owner, [column], number)))
    checks += [F.when(broken, _check(rule, primary)) for rule, broken in _row_rules(table).items()]
    return df.select(F.explode(F.array_compact(F.array(*checks))).alias("check")).select("check.*")


def audit_constraints(tables: dict[str, DataFrame]) -> DataFrame:
    """(rule, key, violations) for every broken rule of the five tables.

    Each table is scanned once. Keys and references to them are counted together in one grouping, with partial counts
    in the scanning tasks, so a hot value crosses as a row a task and no join is needed.
    """
    rows = reduce(DataFrame.unionByName, [_checks(name, df) for name, df in tables.items()])
    numbers = range(len(_FOREIGN) + 1)
    counts = rows.groupBy("space", "k1", "k2").agg(
        *[F.count_if(F.col("reference") == i).alias(f"n{i}") for i in numbers]
    )
    space, held = F.col("space"), F.col("n0")
    primary = F.concat(space, F.lit(" primary key"))
    rules = [
        F.when(space.isin(*_PRIMARY) & (held > 1), F.struct(primary.alias("rule"), held.alias("violations"))),
        F.when(space.isin(*[u[1] for u in _UNIQUE]) & (held > 1), F.struct(space.alias("rule"), held.alias("violations"))),
    ]
    single = [rule for table in tables for rule in _row_rules(table)]
    rules.append(F.when(space.isin(*single), F.struct(space.alias("rule"), held.alias("violations"))))
    for number, (child, column, owner) in enumerate(_FOREIGN, 1):
        lost = (held == 0) & (F.col(f"n{number}") > 0)
        rule = F.lit(f"{child}.{column} references {owner}")
        rules.append(F.when(lost, F.struct(rule.alias("rule"), F.col(f"n{number}").alias("violations"))))
    broken = counts.select(
        F.explode(F.array_compact(F.array(*rules))).alias("broken"), F.concat_ws("/", "k1", "k2").alias("key")
    )
    return broken.select("broken.rule", "key", "broken.violations")


def cascade_delete_uploads(tables: dict[str, DataFrame], doomed: DataFrame) -> dict[str, DataFrame]:
    """Tables after deleting uploads. An upload that still has candidates blocks its delete.

    ``doomed`` has upload_id. The result also has ``blocked``, the deletes that were refused.
    """
    wanted = doomed.select("upload_id").distinct()
    owners = tables["candidate"].select("upload_id").distinct()
    blocked = wanted.join(owners, "upload_id", "left_semi")
    gone = wanted.join(owners, "upload_id", "left_anti")
    uploads = tables["cv_upload"].join(gone, F.col("id") == gone["upload_id"], "left_anti")
    failures = join_per_key(tables["processing_failure"], gone, ["upload_id"], "left_anti", ["id"])
    cleanup = tables["upload_storage_cleanup"].join(gone, "upload_id", "left_anti")
    return {
        **tables,
        "cv_upload": uploads,
        "processing_failure": failures,
        "upload_storage_cleanup": cleanup,
        "blocked": blocked,
    }


def delete_candidates(tables: dict[str, DataFrame], doomed: DataFrame) -> dict[str, DataFrame]:
    """Deleting candidates takes their skills along."""
    gone = doomed.select(F.col("candidate_id")).distinct()
    candidates = tables["candidate"].join(gone, F.col("id") == gone["candidate_id"], "left_anti")
    skills = tables["candidate_skill"].join(gone, "candidate_id", "left_anti")
    return {**tables, "candidate": candidates, "candidate_skill": skills}
