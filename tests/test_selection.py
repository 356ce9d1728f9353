from vigil.operators.models import accuracy
from vigil.operators.selection import common_keys, complete_jobs, fingerprint, record_count


def test_complete_jobs_keep_repeats_and_drop_nulls(spark):
    jobs = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "job string")
    one = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), (None, 1)], "job string, x int")
    two = spark.createDataFrame([("a",), ("c",)], "job string")
    assert [r.job for r in complete_jobs(jobs, [one, two], "job").collect()] == ["a", "a"]
    assert complete_jobs(jobs, [one, two.limit(0)], "job").count() == 0


def test_common_keys(spark):
    rows = spark.createDataFrame([("x", 1), ("x", 1), ("y", 1), ("x", 2), ("y", None), (None, 2)], "g string, k int")
    assert [r.k for r in common_keys(rows, "g", "k").collect()] == [1]
    assert common_keys(rows.limit(0), "g", "k").count() == 0


def test_fingerprint_sees_rows_and_no_order(spark):
    make = lambda rows: fingerprint(spark.createDataFrame(rows, "a int, b string"), "a", "b").first()
    rows = [(i, None if i % 5 == 0 else f"t{i}") for i in range(50)]
    assert make(rows) == make(rows[::-1])
    assert len({make(x).fingerprint for x in (rows, rows[1:], [*rows, rows[0]], [(0, ""), *rows[1:]], [])}) == 5
    assert make([]).n == 0


def test_record_count_and_accuracy(spark):
    rows = spark.createDataFrame([(7, 100, 8), (None, 100, 8)], "n long, size long, width int")
    assert [r[0] for r in rows.select(record_count(rows.n, rows.size, rows.width)).collect()] == [7, 12]
    scored = spark.createDataFrame([(0.5, 0), (0.4, 0), (0.2, 2), (None, 0), (0.9, None)], "health double, label int")
    assert accuracy(scored).first().asDict() == {"n": 3, "accuracy": 2 / 3}
