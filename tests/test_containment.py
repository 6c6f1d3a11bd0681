import random

from ranksmith.operators.containment import contains_pairs


def test_contains_pairs_brute_force(spark):
    rnd = random.Random(7)
    alpha = "ab c"
    hay = ["".join(rnd.choice(alpha) for _ in range(rnd.randint(0, 60))) for _ in range(40)]
    needles = ["".join(rnd.choice(alpha) for _ in range(n)) for n in (1, 2, 3, 4, 5, 7, 9, 14, 15, 16, 20, 30)]
    needles += [hay[3][5:25], hay[10][:17], ""]
    h = spark.createDataFrame(list(enumerate(hay)), "hid long, text string")
    n = spark.createDataFrame(list(enumerate(needles)), "nid long, text string")
    got = {(r.hid, r.nid) for r in contains_pairs(h, "hid", "text", n, "nid", "text").collect()}
    exp = {(i, j) for i, t in enumerate(hay) for j, s in enumerate(needles) if s and s in t}
    assert got == exp
