"""Deliveries as a fold over attempts (PIP16): whatever order they arrive in, one delivery for each idempotency key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.functions import text as X

#: Statuses of a delivery, and the failure that blocks it for good (fixed values).
STATUSES = ["PENDING", "VALIDATING", "READY", "BLOCKED", "PR_CREATED", "FAILED"]
DRIFT = "BLOCKED_BASE_DRIFT"


def outcome(failure_code: F.Column, pr_number: F.Column, eligible: F.Column) -> F.Column:
    """status and failure_code of one attempt: a base that has moved blocks, anything else that isn't eligible or breaks off fails."""
    code = F.when(~eligible, F.coalesce(failure_code, F.lit("VALIDATION_FAILED"))).when(pr_number.isNull(), F.coalesce(failure_code, F.lit("DELIVERY_FAILED")))
    return F.struct(F.when(code == DRIFT, "BLOCKED").when(code.isNotNull(), "FAILED").otherwise("PR_CREATED").alias("status"), code.alias("failure_code"))


def deliveries(attempts: DataFrame) -> DataFrame:
    """idempotency_key, patch_id, requested_by, attempt_count, status, failure_code, pr_number, first_attempt_at, last_attempt_at: one row for each key.

    attempts: patch_id, owner, repo, base_branch, base_sha, requested_by, attempt_id, requested_at, eligible, failure_code, pr_number. Attempts count in order of
    requested_at and attempt_id, up to the first that makes a pull request or finds the base moved: later ones are given that delivery and change nothing. An attempt
    listed twice counts once. requested_by is the last one named, or `user`. Two aggregations by key, combined before they are shuffled: no
    key's attempts are brought together.
    """
    key = X.idempotency_key(F.col("owner"), F.col("repo"), F.col("patch_id"), F.col("base_branch"), F.col("base_sha"))
    a = attempts.withColumn("idempotency_key", key).dropDuplicates(["idempotency_key", "attempt_id"])
    a = a.withColumns({"at": F.struct("requested_at", "attempt_id"), "o": outcome(F.col("failure_code"), F.col("pr_number"), F.col("eligible"))})
    last = (F.col("o.status") == "PR_CREATED") | (F.coalesce(F.col("o.failure_code"), F.lit("")) == DRIFT)
    ends = a.groupBy("idempotency_key").agg(F.min(F.when(last, F.col("at"))).alias("until"))
    counted = a.join(ends, "idempotency_key").where(F.col("until").isNull() | (F.col("at") <= F.col("until")))
    final = F.max_by(F.struct("o.status", "o.failure_code", "pr_number"), "at")
    named = F.max_by("requested_by", F.when(F.col("requested_by").isNotNull(), F.col("at")))
    out = counted.groupBy("idempotency_key").agg(F.min("patch_id").alias("patch_id"), F.coalesce(named, F.lit("user")).alias("requested_by"), F.count("*").alias("attempt_count"), final.alias("f"), F.min("requested_at").alias("first_attempt_at"), F.max("requested_at").alias("last_attempt_at"))
    created = F.when(F.col("f.status") == "PR_CREATED", F.col("f.pr_number"))
    return out.select("idempotency_key", "patch_id", "requested_by", "attempt_count", "f.status", "f.failure_code", created.alias("pr_number"), "first_attempt_at", "last_attempt_at")
