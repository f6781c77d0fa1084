"""Rates of the mixing operator reach their targets."""

import random

import pytest

from tidemark.llm.mixing import fit_rates


@pytest.mark.parametrize("spare", [False, True])
def test_rare_domain_reaches_its_target(spark, spare):
    r = random.Random(4)
    data = []
    for i in range(2000):
        kind = "low" if i % 400 == 0 else "toxic" if i % 10 == 1 else "high"
        p = {x: r.uniform(0.0, 0.002) for x in ("high", "low", "toxic")}
        p[kind] = 1 - sum(v for x, v in p.items() if x != kind)
        data.append((i, r.randrange(50, 200), 1, p["high"], p["low"], p["toxic"]))
    rows = spark.createDataFrame(data, "k long, n_words long, same long, p_high double, p_low double, p_toxic double")
    targets = {"high": 0.90, "low": 0.08, "toxic": 0.02}
    rate, facts = fit_rates(rows, targets, ("high", "low"), spare)
    got = rows.withColumn("rate", rate).collect()
    sums = {x: sum(g["rate"] * g["n_words"] * g[f"p_{x}"] for g in got) for x in targets}
    assert min(g["rate"] for g in got) >= 0 and min(g["rate"] for g in got if g["p_high"] + g["p_low"] >= (0.5 if spare else 0.998)) >= 1
    assert max(g["rate"] for g in got) > 8
    for x, share in targets.items():
        assert sums[x] / sum(sums.values()) == pytest.approx(share, rel=1e-3)
        assert facts["tokens"][x] == pytest.approx(facts["targets"][x], rel=1e-3)
    assert facts["met"]


def test_targets_out_of_reach_are_told(spark):
    rows = spark.createDataFrame([(i, 100, 1, 0.5, 0.5) for i in range(10)], "k long, n_words long, same long, p_a double, p_b double")
    rate, facts = fit_rates(rows, {"a": 0.9, "b": 0.1})
    assert not facts["met"]
    assert all(0 <= x["rate"] < 100 for x in rows.select(rate.alias("rate")).collect())
