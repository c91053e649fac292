"""Integration readiness and governance: freshness, errors, mappings, redaction, roles and audit."""

from __future__ import annotations

import json
import re
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assurelake.functions.scalar import clamp

# Names whose values are not shown
SECRET_KEYS = ("password", "secret", "clientSecret", "client_secret", "token", "apiKey", "privateKey", "passphrase")
HIDDEN = "***"


def freshness(sources: DataFrame, jobs: DataFrame, now: datetime) -> DataFrame:
    """Active sources with the minutes since their last load and whether that is late. A source that was
    never loaded counts one minute more than expected. Sources: code, active, expected_minutes,
    last_loaded_at; jobs: source_code, status, completed_at."""
    last = jobs.filter("status = 'COMPLETED'").groupBy(F.col("source_code").alias("code")).agg(F.max("completed_at").alias("_c"))
    rows = sources.filter("active").join(last, "code", "left")
    at = F.coalesce("last_loaded_at", "_c").cast("timestamp")
    minutes = F.coalesce(F.greatest(F.lit(0), F.floor((F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(at)) / 60)), F.col("expected_minutes") + 1).cast("long")
    late = minutes > F.col("expected_minutes")
    return rows.select("code", "expected_minutes", minutes.alias("minutes_since"), late.alias("late"), F.when(late, "LATE").otherwise("CURRENT").alias("alert_level")).orderBy("code")


def integration_errors(jobs: DataFrame, limit: int = 25) -> DataFrame:
    rows = jobs.filter(F.col("status").isin("FAILED", "RETRY_SCHEDULED"))
    rows = rows.withColumn("retry_controlled", F.col("retries") <= F.col("max_retries"))
    return rows.orderBy(F.desc_nulls_last("started_at"), "id").limit(limit)


def mapped(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """df with source columns renamed by target <- source pairs; others stay."""
    return df.withColumnsRenamed({source: target for target, source in mapping.items()})


def redacted(m: Column) -> Column:
    """A map of values with those of secret names hidden: names as listed, and any that speak of a password."""
    return F.transform_values(m, lambda k, v: F.when(k.isin(*SECRET_KEYS) | F.lower(k).contains("password"), HIDDEN).otherwise(v))


_JSON = re.compile(r'\s*+(?:("(?:[^"\\]++|\\.)*+")|([{}\[\],:])|(-?[0-9][0-9.eE+-]*+|true|false|null))\s*+', re.DOTALL)


def is_secret(name: str) -> bool:
    return name in SECRET_KEYS or "password" in name.lower()


def hidden(text: str | None, in_lists: bool = False) -> str | None:
    """A JSON object with the whole value of every secret name replaced, whatever it is, in objects at any depth; all
    else stays as it is written. Lists are left as they are unless `in_lists`. What isn't a JSON object is null."""
    try:
        if text is None or not isinstance(json.loads(text), dict):
            return None
    except (ValueError, RecursionError):
        return None
    out, done = [], 0  # text up to `done` is written
    stack: list[str] = []  # the brackets that are open
    lists = 0
    key = skip = None  # the last string of an object; the depth from which a value is dropped
    at = 0
    while at < len(text):
        m = _JSON.match(text, at)
        at = m.end()
        mark = m[2]
        if mark == ":" and skip is None and (in_lists or not lists) and is_secret(json.loads(key)):
            out += [text[done : m.end()], f'"{HIDDEN}"']
            skip = len(stack)
            continue
        if mark in ("{", "["):
            stack.append(mark)
            lists += mark == "["
        elif mark in ("}", "]"):
            if skip == len(stack):
                skip, done = None, m.start()  # the object ends with the value
            stack.pop()
            lists -= mark == "]"
        elif mark == "," and skip == len(stack):
            skip, done = None, m.start()
        elif m[1]:
            key = m[1]
    return "".join([*out, text[done:]])


def redacted_json(text: Column, in_lists: bool = False) -> Column:
    """hidden() of a column, in Arrow batches: the walk has no form in built-in functions."""

    @F.pandas_udf("string")
    def walk(values: pd.Series) -> pd.Series:
        return values.map(lambda t: hidden(t, in_lists))

    return walk(text)


def readiness(sources: DataFrame, jobs: DataFrame, now: datetime) -> DataFrame:
    """One row of counts over sources and jobs."""
    f = freshness(sources, jobs, now).agg(F.count("*").alias("active_sources"), F.count_if("late").alias("late_sources"))
    e = jobs.agg(F.count_if(F.col("status") == "FAILED").alias("failed_jobs"), F.count_if((F.col("status") == "RETRY_SCHEDULED") & (F.col("retries") <= F.col("max_retries"))).alias("controlled_retries"))
    return f.crossJoin(e)  # one row each


def role_counts(roles: DataFrame, user_roles: DataFrame, role_permissions: DataFrame) -> DataFrame:
    """Users and permissions of every role: each counted before it is joined."""
    users = user_roles.groupBy("role").agg(F.countDistinct("user_id").alias("users"))
    permissions = role_permissions.groupBy("role").agg(F.countDistinct("permission").alias("permissions"))
    rows = roles.join(users, "role", "left").join(permissions, "role", "left")
    return rows.select("role", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("users", "permissions")]).orderBy("role")


def role_permission_arrays(roles: DataFrame, role_permissions: DataFrame) -> DataFrame:
    has = role_permissions.groupBy("role").agg(F.array_sort(F.collect_list("permission")).alias("permissions"))
    return roles.join(has, "role", "left").select("role", F.coalesce("permissions", F.array().cast("array<string>")).alias("permissions")).orderBy("role")


def overview(tables: dict[str, DataFrame]) -> DataFrame:
    """One row with the number of rows of each table, and whether none is empty."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias(name))
        out = one if out is None else out.crossJoin(one)  # one row each
    full = F.lit(True)
    for name in tables:
        full = full & (F.col(name) > 0)
    return out.withColumn("complete", full)


# Fixed value: the permission that lets a role export
EXPORT = "EXPORT_SENSITIVE_DATA"


def governance_overview(tables: dict[str, DataFrame], retention: DataFrame, privacy: DataFrame) -> DataFrame:
    """One row: the sizes of the tables, the active retention policies, and whether all privacy items (there
    must be some) are completed."""
    kept = retention.agg(F.count_if("active").alias("retention_policies"))
    items = privacy.agg(F.count("*").alias("privacy_items"), F.count_if("completed").alias("completed_privacy_items"))
    out = overview(tables).drop("complete").crossJoin(kept).crossJoin(items)  # one row each
    return out.withColumn("privacy_complete", (F.col("privacy_items") > 0) & (F.col("privacy_items") == F.col("completed_privacy_items")))


def by_category(rows: DataFrame) -> DataFrame:
    """Retention policies or privacy items in the order of their category."""
    return rows.orderBy("data_category")


def export_roles(role_permissions: DataFrame) -> DataFrame:
    """The roles that may export, each once."""
    return role_permissions.filter(F.col("permission") == EXPORT).select("role").distinct().orderBy("role")


def audit_view(log: DataFrame, actor: str | None = None, action: str | None = None, limit: int = 100) -> DataFrame:
    if actor is not None:
        log = log.filter(F.col("actor") == actor)
    if action is not None:
        log = log.filter(F.col("action") == action)
    return log.orderBy(F.desc_nulls_last("created_at"), "id").limit(clamp(limit, 250))
