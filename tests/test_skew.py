import random

from factloom.operators.skew import heavy_keys, skew_safe_groups

SCHEMA = "k string, m string, line int, extra string, part int"


def brute(rows):
    out = {}
    for k, m, line, *_ in rows:
        out.setdefault(k, set()).add((m, line))
    low = lambda x: tuple((v is not None, v) for v in x)
    return {k: (len(v), len({m for m, _ in v if m is not None}), min(v, key=low)) for k, v in out.items()}


def rows(n=600):
    random.seed(5)
    keys = ["hot"] * 6 + ["warm"] * 2 + [f"k{i}" for i in range(20)] + [None, ""]
    made = [(random.choice(keys), random.choice(["a", "b", None]), random.choice([1, 2, 3, None, random.randrange(50)]), "x", 1) for _ in range(n)]
    return made + [("hot", "a", 1, "again", 2)] * 300


def test_groups_equal_brute_force_whatever_the_partitions(spark):
    data = rows()
    for parts in (1, 3, 7):
        df = spark.createDataFrame(data, SCHEMA).repartition(5)
        got = {r["k"]: (r["n_distinct"], r["n_m"], (r["first"]["m"], r["first"]["line"])) for r in skew_safe_groups(df, "k", ["m", "line"], ["m"], parts).collect()}
        assert got == brute(data)


def test_without_set_columns_and_with_several(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    plain = {r["k"]: r["n_distinct"] for r in skew_safe_groups(df, "k", ["m", "line"]).collect()}
    assert plain == {k: v[0] for k, v in brute(rows()).items()}
    two = {r["k"]: (r["n_m"], r["n_line"]) for r in skew_safe_groups(df, "k", ["m", "line"], ["m", "line"]).collect()}
    assert two["hot"][0] == 2


def test_empty_table_and_heavy_keys(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert skew_safe_groups(df, "k", ["m", "line"], ["m"]).count() == 0
    g = skew_safe_groups(spark.createDataFrame([("a", "x", i, "", 0) for i in range(98)] + [("b", "x", 1, "", 0), ("c", "x", 1, "", 0)], SCHEMA), "k", ["m", "line"])
    assert [r["k"] for r in heavy_keys(g, "k", 0.02).collect()] == ["a"]


def test_a_hot_key_lies_across_partitions(spark):
    from factloom.operators.skew import balanced_distinct

    df = spark.createDataFrame([("hot", "m", i, "", 0) for i in range(4000)] + [("b", "m", 1, "", 0)], SCHEMA)
    sizes = balanced_distinct(df, ["k"], ["m", "line"], 4).rdd.glom().map(len).collect()
    assert max(sizes) < 2 * 4001 / 4
