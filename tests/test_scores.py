import duckdb

from spoorline.plans import catalog_scores  # noqa: F401  (registers the queries)
from spoorline.plans.registry import CHECKS, QUERIES


def test_scores_at_half_a_cent_are_those_of_the_statement(spark, tmp_path):
    path = str(tmp_path / "lineitem.parquet")
    rows = [(k, 1, k % 7, k, 550.0 + 1100 * (k % 100)) for k in range(200)]
    spark.createDataFrame(
        rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double"
    ).write.parquet(path)
    db = duckdb.connect()
    db.execute(f"create view lineitem as select * from '{path}/*.parquet'")
    for name in ("best_per_identity", "top_candidates"):
        got = sorted(tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect())
        assert got == sorted(db.execute(CHECKS[name]).fetchall())
