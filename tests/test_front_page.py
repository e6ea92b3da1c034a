"""The front page takes a cluster's best row of a valid direction."""

from tidemill.operators import articles as A
from tidemill.plans import vocabulary


def test_an_invalid_direction_hides_no_cluster(spark):
    rows = [(1, "c1", "nowhere", "s1", 99), (2, "c1", vocabulary.NAMES[0], "s2", 90), (3, None, None, "s3", 95)]
    df = spark.createDataFrame(rows, "article_id long, cluster_id string, direction string, source_name string, score int").selectExpr("*", "timestamp '2024-01-01' AS published_at")
    assert sorted((r.article_id, r["rank"], r.reason) for r in A.front_page(df).where("rank IS NOT NULL").collect()) == [(2, 100, "selected")]
    assert {r.article_id: r.reason for r in A.front_page(df).collect()} == {1: "invalid_direction", 2: "selected", 3: "invalid_direction"}
