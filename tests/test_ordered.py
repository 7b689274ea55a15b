from pyspark.sql import functions as F

from talentgrid.operators.ordered import first_per_key, running


def expected(rows):
    seen, out = {}, {}
    for key, pos, value in sorted(rows):
        n, total = seen.get(key, (0, 0))
        seen[key] = (n + 1, total + value)
        out[(key, pos)] = seen[key]
    return out


def test_slices_agree_with_one_pass(spark):
    # Two thirds of the rows have one key.
    rows = [("hot" if i % 3 else f"k{i % 50}", (i * 7919) % 5003, i % 11) for i in range(5000)]
    df = spark.createDataFrame(rows, "key string, pos long, value long").repartition(5)
    for limit in (1_000_000, 100, 7):
        out = running(df, ["key"], ["pos"], "n", {"total": F.col("value")}, max_group_rows=limit)
        got = {(r.key, r.pos): (r.n, r.total) for r in out.collect()}
        assert got == expected(rows)


def test_global_numbering_with_descending_order(spark):
    df = spark.range(1000).withColumn("x", F.col("id") % 10)
    order = [F.col("x").desc(), F.col("id").asc()]
    got = running(df, [], order, "n", max_group_rows=50).orderBy("n").collect()
    assert [r.n for r in got] == list(range(1, 1001))
    assert [(r.x, r.id) for r in got] == sorted(((i % 10, i) for i in range(1000)), key=lambda t: (-t[0], t[1]))


def test_empty_input(spark):
    assert running(spark.range(0), [], ["id"], "n").count() == 0


def test_first_per_key(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1), ("b", 5)], "k string, v int")
    first = first_per_key(df, ["k"], ["v"])
    assert sorted(map(tuple, first.collect())) == [("a", 1), ("b", 5)]
    assert "WindowGroupLimit" in first._jdf.queryExecution().executedPlan().toString()
