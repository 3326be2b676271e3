"""Moving counts against a plain count over all rows."""

import random

from sentrel.operators.windows import SLICE, moving_counts


def test_moving_counts(spark):
    draw = random.Random(5)
    rows = [(draw.choice(["a", "a", "b", None]), draw.randrange(0, 4 * SLICE, 7_000), draw.choice([1, 2, 3, 4, None])) for _ in range(300)] + [("c", SLICE, 1)] * 3 + [("a", None, 1)]
    df = spark.createDataFrame(rows, "k string, ts long, who long")
    for back, ahead in ((0, 20_000), (50_000, 0), (7_000, 7_000), (0, 0)):
        want = set()
        for k, t, _ in rows:
            if t is not None:
                inside = [w for k2, t2, w in rows if k2 == k and t2 is not None and t - back <= t2 <= t + ahead]
                want.add((str(k), t, len({w for w in inside if w is not None}), len(inside)))
        got = [(str(r.k), r.ts, r.different, r.n) for r in moving_counts(df, ["k"], "who", back, ahead).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert moving_counts(df.limit(0), ["k"], "who", 5, 5).collect() == []
