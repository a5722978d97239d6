"""Verdicts on pairs are spread over the rows that agree in what is judged."""

from pyspark.sql import functions as F

from lodestone.operators import retrieval
from lodestone.plans import code_queries  # noqa: F401  registers its queries
from lodestone.plans.queries import QUERIES


def test_pairs_equal_the_filtered_product(spark):
    paths, classes = ["a/B.java", "B.java", "x\\a\\B.java", "C.java", None], ["K", "", None]
    q = spark.createDataFrame([(i, i % 3 if i % 11 else None, paths[i % 5], classes[i % 3 if i % 2 else 0]) for i in range(60)], "q int, n int, q_path string, q_class string")
    d = spark.createDataFrame([(i, i % 4, paths[i % 5], classes[i % 3]) for i in range(40)], "d int, n int, path string, class_fqn string")
    leak = retrieval.external_leak("path", "q_path", "class_fqn", "q_class")
    want = sorted(map(tuple, q.join(d, "n").filter(leak).select("q", "d").collect()))
    got = sorted(map(tuple, retrieval.paired_by_verdict(q, d, "n", ["q_path", "q_class"], ["path", "class_fqn"], leak).select("q", "d").collect()))
    assert got == want and len(got) > 100


def test_external_leaks_judge_no_pair_of_rows(spark, tmp_path):
    spark.range(400).selectExpr("id + 1 as c_custkey", "1 as c_nationkey").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(300).selectExpr("id + 1 as s_suppkey", "1 as s_nationkey").write.parquet(f"{tmp_path}/supplier.parquet")
    judged = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda x: judged.add(1) or x, "boolean").asNondeterministic()
    whole = retrieval.external_leak
    try:
        retrieval.external_leak = lambda *a: seen(whole(*a))
        n = QUERIES["external_leaks"](spark, str(tmp_path)).count()
    finally:
        retrieval.external_leak = whole
    assert n == sum(c % 9 == s % 9 or (c % 2 == 1 and c % 5 == s % 5) for c in range(1, 401) for s in range(1, 301))
    assert judged.value < 5000  # of 120000 pairs
