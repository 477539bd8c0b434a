from pyspark.sql import functions as F

from tracklore.llm.stars import groups


def test_parts_of_a_large_component_are_met_by_few_pairs(spark):
    # Core items link to the centre (v = 1), others to the half of them with v = 1.5 only.
    values = {i: (0, 1.0 if i == 59 else 0.5 + i % 2) for i in range(60)} | {60 + i: (i, 2.0) for i in range(1, 21)} | {200: (99, 9.0)}
    rows = [(k, i) for i in values for k in range(8)] + [(8, 59), (8, 200)]
    items = spark.createDataFrame([(k, i, 81 if k < 8 else 2, values[i][0]) for k, i in rows], "key long, id long, size long, u int")
    known = spark.createDataFrame([(i, u, v) for i, (u, v) in values.items()], "id long, u int, v double")
    tests = spark.sparkContext.accumulator(0)

    def met(a, b, c, d):
        tests.add(1)
        return abs(b - d) <= 0.6 and (a == 0 or c == 0)

    near = F.udf(met, "boolean")
    found = groups(items, lambda ids: known.join(ids, "id", "left_semi"), lambda x, y: near(f"{x}.u", f"{x}.v", f"{y}.u", f"{y}.v"), lambda x, y: F.lit(True), ["u"])
    assert {(r.node, r.component) for r in found.collect()} == {(i, 0) for i in values if i != 200}
    assert tests.value < 3_000  # all pairs in all buckets made 26,001 tests
