import random
import statistics

import pytest
from pyspark.sql import functions as F

from packloom.operators import cohort

COLUMNS = ["package", "cohort", *cohort.WEIGHTS, *cohort.FLAGS, "issue_total", "module_style_count", "topic_style_count"]
SCHEMA = "package string, cohort string, " + ", ".join(f"{c} double" if c.endswith("ratio") else f"{c} long" for c in COLUMNS[2:])


def made(n, seed=1, cohorts=4):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        base = rng.randrange(6)
        rows.append((f"p{i:03}", f"k{rng.randrange(cohorts)}", *(rng.random() if c.endswith("ratio") else base * 9 + rng.randrange(3) if c not in cohort.FLAGS else rng.randrange(2) for c in COLUMNS[2:])))
    return rows


def reference(me, profiles):
    others = [p for p in profiles if p["package"] != me["package"]]
    same = [p for p in others if p["cohort"] == me["cohort"]] or others
    if not same:
        return (me["cohort"], 0, *[None] * 9)
    total = lambda c: sum(p[c] or 0 for p in same)
    topics, modules = total("topic_style_count"), total("module_style_count")
    module = "topic" if topics > modules else "neutral" if modules == topics == 0 else "module"
    intro = "objectives" if total("intro_objectives_pages") > total("intro_checklist_pages") else "checklist"
    medians = [round(statistics.median(float(p[c] or 0) for p in same), 1) for c in cohort.MEDIANS.values()]
    rates = [round(sum((p[c] or 0) > 0 for p in same) / len(same), 3) for c in cohort.RATES.values()]
    return (min(same, key=lambda p: p["package"])["cohort"], len(same), module, intro, *medians, *rates)


@pytest.mark.parametrize("n,cohorts", [(0, 1), (1, 1), (2, 2), (3, 1), (30, 12), (61, 2)])
def test_consensus_of_others(spark, n, cohorts):
    rows = made(n, n, cohorts)
    if n > 3:
        rows[3] = (*rows[3][:2], *[None] * (len(COLUMNS) - 2))  # no counts at all
    current = rows[: n // 2 + 1] + [("new", "k0", *made(1)[0][2:]), ("odd", "unseen", *made(1)[0][2:])]
    got = {r[0]: tuple(r)[1:] for r in cohort.consensus_of_others(spark.createDataFrame(current, SCHEMA), spark.createDataFrame(rows, SCHEMA)).collect()}
    named = [dict(zip(COLUMNS, r)) for r in rows]
    assert got == {r[0]: reference(dict(zip(COLUMNS, r)), named) for r in current}


def test_unseen_cohort_follows_all_profiles(spark):
    rows = [(*r[:-2], 5, 0) for r in made(4, 2, 1)]
    odd = ("odd", "unseen", *made(1)[0][2:-2], 0, 5)
    current = spark.createDataFrame([odd], SCHEMA)
    evidence = current.withColumns({c: F.lit(0) for c in cohort.COUNTS} | {c: F.lit(True) for c in cohort.EVIDENCE})
    gates = cohort.gates(evidence, cohort.consensus_of_others(current, spark.createDataFrame(rows, SCHEMA)))
    assert {r.gate: r.status for r in gates.collect()}["structure-conventions"] == "review"


@pytest.mark.parametrize("n,few", [(5, 256), (5, 0), (300, 256)])
def test_nearest_equals_all_pairs(spark, monkeypatch, n, few):
    monkeypatch.setattr(cohort, "PIVOTS", 8)
    monkeypatch.setattr(cohort, "FEW", few)
    rows = made(n, 3) + [(f"same{i:02}", *made(1)[0][1:]) for i in range(20)]
    far = ("zfar", "other", *([10**9] * (len(COLUMNS) - 2)))
    df = spark.createDataFrame(rows + [tuple(float(v) if c.endswith("ratio") else v for c, v in zip(COLUMNS, far))], SCHEMA)
    pairs = df.select(F.col("package").alias("q"), F.struct(*cohort._FEATURES).alias("l")).crossJoin(df.select(F.col("package").alias("r"), F.struct(*cohort._FEATURES).alias("m"))).where("q <> r").select("q", "r", cohort.raw_score(F.col("l"), F.col("m")).alias("s"))
    best = {}
    for q, r, s in pairs.collect():
        best.setdefault(q, []).append((-round(max(s, 0.0), 1), r))
    want = {(q, i, r, -s) for q, found in best.items() for i, (s, r) in enumerate(sorted(found)[:3], 1)}
    assert {tuple(r) for r in cohort.nearest(df, df).collect()} == want
