"""Which requests a rate limit applies to, and the key they would be counted under.

Requests have request_id, ts, method, path and principal. Admission itself is the limiter's work and not rebuilt.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentgrid.functions.requests import bucket_key, is_known_principal, resolve_policy


def with_policy(requests: DataFrame) -> DataFrame:
    return requests.withColumn("policy", resolve_policy(F.col("method"), F.col("path")))


def eligible_requests(requests: DataFrame) -> DataFrame:
    """Requests a bucket applies to: a policy matches and the principal is known."""
    known = is_known_principal(F.col("principal"))
    return with_policy(requests).filter(F.col("policy").isNotNull() & known)


def with_bucket_key(requests: DataFrame, prefix: str = "rate-limit") -> DataFrame:
    return requests.withColumn("bucket_key", bucket_key(F.col("policy"), F.col("principal"), prefix))
