"""Rows of few files get work for all cores; rows of many files stay where they are."""

from papyra.sources.files import dealt


def test_dealt(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "one"))
    spark.range(100).repartition(9).write.parquet(str(tmp_path / "many"))
    cores = spark.sparkContext.defaultParallelism
    one, many = (spark.read.parquet(str(tmp_path / n)) for n in ("one", "many"))
    assert dealt(one).count() == 100 and "Repartition" in dealt(one)._jdf.queryExecution().logical().toString()
    assert cores < 9 and dealt(many) is many
    plan = dealt(one).where("id = 3")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Repartition") < plan.index("Filter")  # filters still reach the scan
