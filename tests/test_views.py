import numpy as np
import pytest

from lociq.operators.simulate import simulate
from lociq.plans import views


@pytest.fixture
def tables(spark, tmp_path):
    """Parts, one of them twice, one without lines and one without a key; lines of unknown parts and suppliers."""
    keys = spark.range(60).selectExpr("id AS p_partkey").union(spark.sql("SELECT 7L UNION ALL SELECT CAST(NULL AS BIGINT)"))
    keys.selectExpr("p_partkey", "CAST(p_partkey % 7 AS INT) AS p_size").write.parquet(str(tmp_path / "part.parquet"))
    lines = spark.range(2000).selectExpr("IF(id % 50 = 0, NULL, 1 + id % 70) AS l_partkey", "IF(id % 31 = 0, NULL, id DIV 70) AS l_suppkey", "1.0D + id % 50 AS l_quantity", "CAST(id % 11 AS DOUBLE) / 100 AS l_discount", "CAST(id % 9 AS DOUBLE) / 100 AS l_tax")
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize(("t", "of"), [(0, 3), (2, 3), (1, 5)])
def test_lines_summed_by_part_first(spark, tables, t, of):
    got, want = (views.frame(spark, tables, s) for s in (views.by_part(t, of), views.trait_sql(t, of)))
    assert got.dtypes == want.dtypes and want.count() > 40
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_variants_are_not_broadcast(spark, tables):
    """Each copy would pass through the driver whole, and the panel grows with the tables."""
    for df in (views.trait(spark, tables, 0), views.planted(spark, tables, 0), views.trait(spark, tables, 1).join(views.variants(spark, tables).select("SNP", "L2"), "SNP")):
        df.collect()
        assert "BroadcastExchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_draws_are_dealt_over_tasks(spark):
    scores = spark.range(200).coalesce(1).selectExpr("concat('rs', id) AS SNP", "1.0D + id % 5 AS L2")
    S = np.array([[0.3, 0.1], [0.1, 0.2]])
    draw = lambda df: simulate(df, S, np.array([5e4, 6e4]), 1e4, replicates=2)
    rows = draw(scores)
    assert rows.selectExpr("spark_partition_id() AS p").distinct().count() > 1
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, draw(scores.repartition(3)).collect()))
