from pyspark.sql import functions as F

from talentgrid.functions.requests import bucket_key, resolve_policy
from talentgrid.operators import ratelimit as L


def test_policies(spark):
    cases = [
        ("POST", "/api/v1/uploads", "UPLOAD"),
        ("GET", "/api/v1/uploads", None),
        ("GET", "/api/v1/uploads/7", "READ"),
        ("GET", "/api/v1/uploads/7/failures", "READ"),
        ("GET", "/api/v1/uploads/7/other", None),
        ("GET", "/api/v1/candidates", "READ"),
        ("GET", "/api/v1/candidates/export.csv", "EXPORT"),
        ("GET", "/api/v1/candidates/export.xlsx", "EXPORT"),
        ("DELETE", "/api/v1/candidates", None),
        ("GET", "/", None),
        ("GET", "/api/v1/uploads/7/failures\n", None),
    ]
    df = spark.createDataFrame(cases, "method string, path string, want string")
    got = df.select("want", resolve_policy(F.col("method"), F.col("path")).alias("got")).collect()
    assert all(r.want == r.got for r in got)


def test_keys_and_unknown_callers(spark):
    df = spark.createDataFrame([("READ", "ann")], "policy string, principal string")
    key = df.select(bucket_key(F.col("policy"), F.col("principal"), "p")).first()[0]
    assert key.startswith("p:read:") and len(key) == len("p:read:") + 64
    who = [(1, None), (2, ""), (3, "  "), (4, "anonymousUser"), (5, "bob")]
    rows = spark.createDataFrame(who, "request_id int, principal string").withColumns(
        {"method": F.lit("GET"), "path": F.lit("/api/v1/candidates")}
    )
    assert [r.request_id for r in L.eligible_requests(rows).collect()] == [5]
