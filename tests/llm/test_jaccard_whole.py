"""Links whose common shingles stand beyond a partner's prefix."""

from pyspark.sql import functions as F

from loomgraph.llm import jaccard


def test_shingles_in_no_other_prefix_bound_no_overlap(spark):
    # sizes 95 and 100, overlap 90: a link. Prefixes have 9 shingles in common; 9 of the first stand in no other prefix, 4 of
    # them in the second set beyond its prefix
    rule = jaccard.Rule(4, 85)
    assert 100 * 90 >= 85 * (95 + 100 - 90)
    rows = [(t, d, size, 1, own) for t in range(9) for d, size, own in ((1, 95, 9), (2, 100, 10))]
    lists = spark.createDataFrame(rows, "token long, doc_id long, size int, weight int, own int")
    rep = spark.createDataFrame([(1, 1), (2, 2)], "doc_id long, rep long")
    of = lambda df, c: df.withColumn(f"root_{c}", F.col(c))
    assert [tuple(r) for r in jaccard._across(lists, rep, of, rule, 0).collect()] == [(1, 2)]
