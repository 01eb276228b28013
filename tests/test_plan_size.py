"""Plans that stay short: what is read once, and methods that the JVM compiles."""

import numpy as np

from cohortry.functions import features as fx
from cohortry.plans import job_queries
from cohortry.sources import predictions as pr
from cohortry.sources.scratch import keep_methods_compiled


def test_factors_for_two_numbers_read_the_lines_once(spark):
    plan = job_queries.clamped_factors(spark, "/root/testdata/sf0.001")._jdf.queryExecution().analyzed().toString()
    # Once for the rows; statuses and sizes were found before.
    assert plan.count("l_linestatus#") and sum(
        line.lstrip(" :+-").startswith("Relation") and "l_linestatus" in line for line in plan.splitlines()) == 1


def test_change_ratio_is_right_for_odd_texts(spark):
    rows = [("a", "Up", " steady ", None, "no"), ("b", None, None, None, None), ("c", "x", "", " ", "??"),
            ("d", "DOWN", "down ", "\tuP", "Up"), ("e", "steady", "No", "NO", "No"), ("f", "up and down", "no", "up", None)]
    df = spark.createDataFrame(rows, "k string, p string, q string, r string, s string")
    got = {r.k: r.x for r in df.select("k", fx.change_ratio(["p", "q", "r", "s"]).alias("x")).collect()}
    assert got == {"a": float(np.float32(1 / 3)), "b": 0, "c": 0, "d": 1, "e": 0, "f": 0.5}
    assert df.select(fx.change_ratio([]).alias("x")).distinct().first().x == 0


def test_change_ratio_names_every_column_once(spark):
    df = spark.createDataFrame([("a", "b")], "p string, q string")
    plan = df.select(fx.change_ratio(["p", "q"]).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.splitlines()[0].count("p#") == 1


def test_limit_of_methods_is_lowered_and_a_lower_one_stays(spark):
    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "65535")
        keep_methods_compiled(spark)
        assert spark.conf.get(name) == "8000"
        spark.conf.set(name, "4000")
        keep_methods_compiled(spark)
        assert spark.conf.get(name) == "4000"
    finally:
        spark.conf.set(name, before)


def test_log_is_written_small_and_read_together_with_plain_files(spark, tmp_path):
    path = str(tmp_path / "log")
    records = spark.range(2000).selectExpr("CAST(id % 2 AS INT) AS binary_prediction", "'batch' AS prediction_source")
    records.write.json(path)
    plain = sum(f.stat().st_size for f in (tmp_path / "log").glob("*.json"))
    pr.write_log(records, path, append=True)
    small = sum(f.stat().st_size for f in (tmp_path / "log").glob("*.json.gz"))
    assert 0 < small < plain / 4
    back = pr.read_log(spark, path)
    assert back.count() == 4000 and back.where("binary_prediction = 1").count() == 2000
