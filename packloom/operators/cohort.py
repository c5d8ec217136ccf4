"""Package features, cohorts, nearest packages, consensus and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packloom.functions.arrow import round_half_even
from packloom.runtime import materialise

#: Weights of the distance between two packages.
WEIGHTS = {
    "module_count": 14.0, "page_count": 14.0, "assignment_count": 8.0, "discussion_count": 4.0, "module_style_ratio": 8.0,
    "topic_style_ratio": 8.0, "intro_checklist_pages": 6.0, "intro_objectives_pages": 6.0, "learning_activities_pages": 6.0,
}
FLAGS = ["start_here_modules", "instructor_modules", "help_discussion_modules", "overview_modules"]
MODULE, TOPIC = r"(?i)^\s*module\s+\d+", r"(?i)^\s*topic\s+\d+"


def snapshot_features(names: DataFrame, package: str = "package") -> DataFrame:
    """One row per package from (package, kind, title) rows, kind being module,
    page, assignment or discussion. One aggregation, with partial sums."""
    t, k = F.lower("title"), F.col("kind")
    n = lambda cond: F.count(F.when(cond, 1))
    module, page = k == "module", k == "page"
    has = lambda *words: F.coalesce(*(F.when(F.contains(t, F.lit(w)), True) for w in words), F.lit(False))
    g = names.groupBy(package).agg(
        n(module).alias("module_count"),
        n(page).alias("page_count"),
        n(k == "assignment").alias("assignment_count"),
        n(k == "discussion").alias("discussion_count"),
        n(module & F.col("title").rlike(MODULE)).alias("module_style_count"),
        n(module & F.col("title").rlike(TOPIC)).alias("topic_style_count"),
        n(module & has("start here")).alias("start_here_modules"),
        n(module & has("instructor module", "faculty use", "do not publish", "preparing your course")).alias("instructor_modules"),
        n(module & has("help discussion")).alias("help_discussion_modules"),
        n(module & has("course overview")).alias("overview_modules"),
        n(page & has("introduction and objectives")).alias("intro_objectives_pages"),
        n(page & has("introduction and checklist")).alias("intro_checklist_pages"),
        n(page & has("learning activities")).alias("learning_activities_pages"),
    )
    ratio = lambda c: round_half_even(F.col(c) / F.greatest("module_count", F.lit(1)), F.lit(3))
    return g.withColumn("module_style_ratio", ratio("module_style_count")).withColumn("topic_style_ratio", ratio("topic_style_count"))


def structure_cohort() -> Column:
    c = F.col
    return (
        F.when((c("module_style_count") >= 4) & (c("intro_checklist_pages") >= 2) & (c("learning_activities_pages") >= 2), "template-module")
        .when(c("topic_style_count") >= 4, "topic-sequence")
        .when((c("help_discussion_modules") > 0) | (c("overview_modules") > 0) | (c("intro_objectives_pages") > c("intro_checklist_pages")), "overview-objectives")
        .otherwise("hybrid")
    )


def distance(a: Column, b: Column) -> Column:
    return F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(1.0))


def raw_score(x: Column, y: Column) -> Column:
    """100 less the weighted distances of two feature structs; may be below 0."""
    s = F.lit(100.0) - F.when(x["cohort"] != y["cohort"], 25.0).otherwise(0.0)
    for k, w in WEIGHTS.items():
        s = s - F.lit(w) * distance(x[k].cast("double"), y[k].cast("double"))
    for k in FLAGS:
        s = s - F.when((x[k] > 0) != (y[k] > 0), 3.0).otherwise(0.0)
    return s - F.lit(8.0) * distance(x["issue_total"].cast("double"), y["issue_total"].cast("double"))


#: Profiles that cells are built around, width of a ring of a cell, and what rounding a
#: score to one digit can move. No more profiles than FEW are met one by one.
PIVOTS, RING, ROUNDING = 64, 2.0, 0.11
FEW = 4 * PIVOTS
_FEATURES = ["cohort", *WEIGHTS, *FLAGS, "issue_total"]


def nearest(queries: DataFrame, profiles: DataFrame, package: str = "package", k: int = 3) -> DataFrame:
    """DataFrame[query, rank, reference, score]: the k most similar other packages of each
    query package, by score rounded to one digit, then reference. Exact.

    100 less the score is a metric (each part is one), so profiles are dealt to cells
    around PIVOTS of them and to rings by their distance from the pivot. A query's k-th
    distance is bounded from the sizes and radii of the rings alone; by the triangle
    inequality it then meets only rings that can hold a row so near. Of profiles with
    equal features k + 1 are met, those with the smallest names.
    """
    work = profiles.select(F.col(package).alias("reference"), F.struct(*_FEATURES).alias("r"))
    wanted = queries.select(F.col(package).alias("query"), F.struct(*_FEATURES).alias("l"))
    if work.limit(FEW + 1).count() <= FEW:
        return _first(wanted.join(F.broadcast(work), F.col("query") != F.col("reference")), k)
    same = Window.partitionBy("r").orderBy("reference")
    few = work.withColumn("n", F.row_number().over(same)).where(F.col("n") <= k + 1).drop("n")
    few = materialise(few, "profiles")
    pivots = few.orderBy(F.xxhash64("r"), "reference").limit(PIVOTS).agg(F.collect_list("r").alias("pivots"))

    def from_pivots(df: DataFrame, x: str) -> DataFrame:
        return df.crossJoin(F.broadcast(pivots)).withColumn("far", F.transform("pivots", lambda p: F.lit(100.0) - raw_score(F.col(x), p))).drop("pivots")

    cells = from_pivots(few, "r").withColumn("far_", F.array_min("far")).withColumn("cell", F.array_position("far", F.col("far_")).cast("int") - 1)
    cells = cells.select("reference", "r", "cell", F.floor(F.col("far_") / RING).cast("int").alias("ring"), F.col("far_").alias("radius"))
    cells = materialise(cells, "cells")
    # At most PIVOTS times the largest distance by RING rows.
    rings = cells.groupBy("cell", "ring").agg(F.count("*").alias("n"), F.min("radius").alias("least"), F.max("radius").alias("most"))
    told = rings.agg(F.collect_list(F.struct("cell", "ring", "n", "least", "most")).alias("rings"))
    q = from_pivots(wanted, "l").crossJoin(F.broadcast(told))
    near = F.sort_array(F.transform("rings", lambda b: F.struct((F.get("far", b["cell"]) + b["most"]).alias("d"), b["n"].alias("n"))))
    # The distance within which the nearest rings have k rows beside the query's own.
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("double").alias("d"))
    step = lambda a, b: F.struct((a["n"] + b["n"]).alias("n"), F.when(a["d"].isNull() & (a["n"] + b["n"] > k), b["d"]).otherwise(a["d"]).alias("d"))
    bound = F.aggregate(near, start, step)["d"] + ROUNDING
    # Scores below 0 count as 0, so from there on all are alike.
    open_ = bound.isNull() | (bound >= 100.0 - ROUNDING)
    met = F.filter("rings", lambda b: F.col("open_") | (F.greatest(F.get("far", b["cell"]) - b["most"], b["least"] - F.get("far", b["cell"])) <= F.col("bound")))
    q = q.withColumn("bound", bound).withColumn("open_", open_).select("query", "l", F.explode(met).alias("b")).select("query", "l", "b.cell", "b.ring")
    return _first(q.join(cells, ["cell", "ring"]).where(F.col("query") != F.col("reference")), k)


def _first(pairs: DataFrame, k: int) -> DataFrame:
    """The first ``k`` references of each query of pairs (query, l, reference, r)."""
    rows = pairs.withColumn("score", round_half_even(F.greatest(raw_score(F.col("l"), F.col("r")), F.lit(0.0)), F.lit(1)))
    w = Window.partitionBy("query").orderBy(F.desc("score"), "reference")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query", "rank", "reference", "score")


MEDIANS = {"median_pages": "page_count", "median_modules": "module_count", "median_assignments": "assignment_count", "median_post_import_issues": "issue_total"}
RATES = {"start_here_presence_rate": "start_here_modules", "instructor_module_presence_rate": "instructor_modules", "learning_activities_presence_rate": "learning_activities_pages"}
SUMS = {"topics": "topic_style_count", "modules": "module_style_count", "objectives": "intro_objectives_pages", "checklists": "intro_checklist_pages"}
ALL = "*"


def _styles(topics: Column, modules: Column, objectives: Column, checklists: Column) -> tuple[Column, Column]:
    """Preferred styles of modules and of introductions by totals."""
    module = F.when(topics > modules, "topic").when((modules == 0) & (topics == 0), "neutral").otherwise("module")
    return module, F.when(objectives > checklists, "objectives").otherwise("checklist")


def consensus_of_others(current: DataFrame, profiles: DataFrame, package: str = "package") -> DataFrame:
    """What the profiles of other packages agree on, for each package of ``current``
    (package, cohort): DataFrame[package, cohort, reference_courses,
    preferred_module_style, preferred_intro_style, medians, presence rates].

    Those of the package's cohort count, or, where no other package has it, all; a
    package's own profile never does. The cohort told is that of the profile with the
    smallest name. Without other profiles there are no references, and the rest is null.

    No package meets the profiles. Totals less the own values give sums and rates. Values
    are counted by cohort, and from the counts come the order statistics around the middle;
    a median without one value v is made of them, as of two neighbours the larger moves
    into the place of what goes unless v is above the smaller one. ``profiles`` have one
    row a package; null counts are 0.
    """
    n0 = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    values = {c: n0(c) for c in dict.fromkeys([*MEDIANS.values(), *RATES.values(), *SUMS.values()])}
    base = profiles.select(F.col(package).alias("p"), F.col("cohort").alias("g"), *(v.alias(c) for c, v in values.items()))
    both = base.withColumn("g", F.explode(F.array("g", F.lit(ALL))))
    total = both.groupBy("g").agg(F.count("*").alias("n"), F.min("p").alias("first"), *(F.sum(c).alias(k) for k, c in SUMS.items()), *(F.sum((F.col(c) > 0).cast("long")).alias(k) for k, c in RATES.items()))
    # The names and cohorts of the first two profiles, of which one may be the own.
    firsts = base.select(F.struct("p", "g").alias("x"))
    first = firsts.agg(F.min("x").alias("one"))
    second = firsts.crossJoin(F.broadcast(first)).where("x > one").agg(F.min("x").alias("two"))
    counts = both.select("g", F.explode(F.array(*(F.struct(F.lit(k).alias("m"), F.col(c).alias("v")) for k, c in MEDIANS.items()))).alias("x")).groupBy("g", "x.m", "x.v").agg(F.count("*").alias("c"))
    w = Window.partitionBy("g", "m")
    ranked = counts.withColumn("upto", F.sum("c").over(w.orderBy("v"))).withColumn("n", F.sum("c").over(w))
    half = lambda x: F.floor(x / 2).cast("long")
    n = F.col("n")
    ends = {"a": half(n - 1), "b": half(n), "c": half(n - 2), "d": half(n - 2) + 1, "e": half(n - 1), "f": half(n - 1) + 1}
    middle = ranked.groupBy("g").agg(*(F.struct(*(F.min(F.when((F.col("m") == k) & (F.col("upto") > i), F.col("v"))).alias(e) for e, i in ends.items())).alias(f"{k}_") for k in MEDIANS))
    stats = materialise(total.join(middle, "g"), "consensus")
    own = base.select("p", F.col("g").alias("own_g"), *(F.col(c).alias(f"own_{c}") for c in values))
    rows = current.select(F.col(package).alias("p"), F.col("cohort").alias("c")).join(own, "p", "left")
    sides = rows.join(stats.select(F.col("g").alias("c"), F.col("n").alias("cohort_n")), "c", "left")
    others = F.coalesce(F.col("cohort_n"), F.lit(0)) - F.when(F.col("own_g") == F.col("c"), 1).otherwise(0)
    chosen = sides.withColumn("g", F.when(others > 0, F.col("c")).otherwise(F.lit(ALL)))
    j = chosen.join(stats, "g", "left").crossJoin(F.broadcast(first)).crossJoin(F.broadcast(second))
    inside = (F.col("g") == ALL) & F.col("own_g").isNotNull() | F.coalesce(F.col("g") == F.col("own_g"), F.lit(False))
    less = lambda c: F.when(inside, F.col(f"own_{c}")).otherwise(0.0)
    left = F.coalesce(F.col("n"), F.lit(0)) - F.when(inside, 1).otherwise(0)
    sums = {k: F.col(k) - less(c) for k, c in SUMS.items()}
    module, intro = _styles(*(sums[k] for k in SUMS))

    def median(k: str, c: str) -> Column:
        x, v = F.col(f"{k}_"), F.col(f"own_{c}")
        rest = lambda lo, hi: F.when(v > x[lo], x[lo]).otherwise(x[hi])
        return F.when(inside, (rest("c", "d") + rest("e", "f")) / 2).otherwise((x["a"] + x["b"]) / 2)

    some = lambda c: F.when(left > 0, c)
    rate = lambda k, c: round_half_even((F.col(k) - F.when(inside & (F.col(f"own_{c}") > 0), 1).otherwise(0)) / F.greatest(left, F.lit(1)), F.lit(3))
    of = F.when(F.col("g") != ALL, F.col("g")).when(F.col("one.p") != F.col("p"), F.col("one.g")).otherwise(F.col("two.g"))
    return j.select(
        F.col("p").alias(package),
        F.when(left > 0, of).otherwise(F.col("c")).alias("cohort"),
        left.cast("long").alias("reference_courses"),
        some(module).alias("preferred_module_style"),
        some(intro).alias("preferred_intro_style"),
        *(some(median(k, c)).alias(k) for k, c in MEDIANS.items()),
        *(some(rate(k, c)).alias(k) for k, c in RATES.items()),
    )


def consensus(profiles: DataFrame) -> DataFrame:
    """One row per cohort: styles by majority, medians and presence rates."""
    g = profiles.groupBy("cohort").agg(
        F.count("*").alias("reference_courses"),
        *(F.sum(c).alias(k) for k, c in SUMS.items()),
        *(F.median(c).alias(k) for k, c in MEDIANS.items()),
        *(F.avg(F.when(F.col(c) > 0, 1.0).otherwise(0.0)).alias(k) for k, c in RATES.items()),
    )
    module, intro = _styles(*(F.col(k) for k in SUMS))
    return g.select("cohort", "reference_courses", module.alias("preferred_module_style"), intro.alias("preferred_intro_style"), *MEDIANS, *(round_half_even(k, F.lit(3)).alias(k) for k in RATES))


#: Counts of a package (0 where there is none) that the gates read beside its features,
#: and whether a part of the evidence is there at all.
VISUAL = ["duplicate_titles", "shared_template_refs", "title_tags", "nonstandard_dividers", "icon_size_anomalies"]
COUNTS = [*VISUAL, "template_unresolved", "pre_import_issues", "post_import_issues", "missing_page_links", "quiz_key_warnings", "live_findings", "manual_issues", "accessibility_issues"]
EVIDENCE = ["has_snapshot", "has_source", "has_visual", "has_live"]
LIVE_LIMIT = 4


def _status(approved: Column, review: Column) -> Column:
    return F.when(approved, "approved").when(review, "review").otherwise("attention")


def gates(current: DataFrame, agreed: DataFrame, package: str = "package") -> DataFrame:
    """DataFrame[package, gate, status], four gates a package: structure, visual and
    template fidelity, quality after the import, and manual work left.

    ``current`` has the snapshot features, cohort, COUNTS and EVIDENCE of packages; null
    counts are 0 and null evidence is none. ``agreed`` is what ``consensus_of_others`` gives
    for them; a package without references counts as neutral with checklists.
    """
    j = current.join(agreed.select(package, "preferred_module_style", "preferred_intro_style"), package, "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    has = lambda c: F.coalesce(F.col(c), F.lit(False))
    m, t, i, o = (n(c) for c in ("module_style_count", "topic_style_count", "intro_checklist_pages", "intro_objectives_pages"))
    style = F.when(F.col("preferred_module_style") == "module", m >= t).when(F.col("preferred_module_style") == "topic", t >= m).otherwise(True)
    intro = F.when(F.coalesce("preferred_intro_style", F.lit("checklist")) == "checklist", i >= o).otherwise(o >= i)
    clean = sum((n(c) for c in VISUAL[1:]), n(VISUAL[0])) + n("template_unresolved") == 0
    post, quiz = n("post_import_issues"), n("quiz_key_warnings")
    seen = (post > 0) | (n("pre_import_issues") > 0) | (quiz > 0) | has("has_live")
    good = seen & (n("missing_page_links") == 0) & ((post == 0) | (post == quiz)) & (n("live_findings") <= LIVE_LIMIT)
    left = n("manual_issues") + n("accessibility_issues") > 0
    found = {
        "structure-conventions": _status(has("has_snapshot") & style & intro, has("has_snapshot") | has("has_source")),
        "visual-template-fidelity": _status(clean, has("has_visual")),
        "post-import-quality": _status(good, seen),
        "manual-cleanup-load": _status(~left, left),
    }
    rows = j.select(package, F.explode(F.array(*(F.struct(F.lit(k).alias("gate"), v.alias("status")) for k, v in found.items()))).alias("x"))
    return rows.select(package, "x.gate", "x.status")


def approval_score(gates: DataFrame, package: str = "package") -> DataFrame:
    """Points of the gates (2, 1, 0) as a percentage, halves to even, and the worst
    status."""
    points = F.when(F.col("status") == "approved", 2).when(F.col("status") == "review", 1).otherwise(0)
    g = gates.groupBy(package).agg(F.bround(100.0 * F.sum(points) / (2 * F.count("*"))).cast("long").alias("score"), F.min(points).alias("worst"))
    return g.select(package, "score", F.element_at(F.array(F.lit("attention"), F.lit("review"), F.lit("approved")), F.col("worst") + 1).alias("overall"))
