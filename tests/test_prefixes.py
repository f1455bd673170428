"""Longest-prefix lookups against brute force."""

import random

from maskwell.operators.prefixes import longest_prefix


def test_longest_prefix(spark):
    rng = random.Random(3)

    def some():
        return "".join(rng.choice("123") for _ in range(rng.randrange(7)))

    values = [some() for _ in range(300)] + [None, "", "9"] + ["1" * 6] * 100
    plans = [(some(), i) for i in range(40)] + [(None, 99)]
    df = spark.createDataFrame([(i, v, "x") for i, v in enumerate(values)], "id int, number string, _plan_2 string")
    table = spark.createDataFrame([p for p in plans if p[0] != ""], "prefix string, name int")
    got = {r.id: r.plan for r in longest_prefix(df, table, "number").collect()}
    assert len(got) == len(values)
    for i, v in enumerate(values):
        fits = [p for p in plans if v is not None and p[0] and v.startswith(p[0])]
        best = max(fits, key=lambda p: (len(p[0]), p[1]), default=None)
        assert (tuple(got[i]) if got[i] else None) == best
    every = spark.createDataFrame([("", 1)], "prefix string, name int")
    assert {r.id for r in longest_prefix(df, every, "number").where("plan IS NULL").collect()} == {300}
    assert longest_prefix(df, table.limit(0), "number").where("plan IS NOT NULL").count() == 0
    assert longest_prefix(df.limit(0), table, "number").count() == 0
