"""Lookup joins: from references to files, assets, ids and targets.

Each index is grouped by key before it is joined, so a join brings one row per
reference and ambiguity is a count, not a fan-out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packloom.functions.html import basename, held_parts


def _index(paths: DataFrame, key: Column, name: str) -> DataFrame:
    g = paths.groupBy(key.alias(f"{name}_key")).agg(F.min("path").alias(f"{name}_path"), F.count("*").alias(f"{name}_n"))
    return g


def resolve_paths(refs: DataFrame, paths: DataFrame, ref: str = "ref", page_dir: str = "page_dir") -> DataFrame:
    """Local references to package paths, by the first arm that answers: the exact
    path, the path in any case, a basename that is unique, a unique basename that
    ends in ``_<name>`` in the page's folder, the same in any folder if the
    page's folder has none. Adds ``target`` and ``arm``; null and ``missing``
    where none does.
    """
    low = F.lower(F.col(ref))
    name = F.lower(basename(F.col(ref)))
    tail = F.regexp_extract(F.lower(basename(F.col("path"))), r"^[^_]*_(.+)$", 1)
    folder = F.lower(F.regexp_extract(F.col("path"), r"^(.*)/[^/]*$", 1))
    exact = paths.select(F.col("path").alias("exact_path")).distinct()
    fold = _index(paths, F.lower("path"), "fold").drop("fold_n")
    base = _index(paths, F.lower(basename(F.col("path"))), "base").where("base_n = 1")
    tails = paths.withColumn("tail", tail).withColumn("folder", folder).where("tail <> ''")
    near = tails.groupBy(F.col("folder").alias("near_dir"), F.col("tail").alias("near_key")).agg(F.min("path").alias("near_path"), F.count("*").alias("near_n"))
    far = tails.groupBy(F.col("tail").alias("far_key")).agg(F.min("path").alias("far_path"), F.count("*").alias("far_n"))
    j = refs.withColumn("__low", low).withColumn("__name", name).withColumn("__dir", F.lower(F.col(page_dir)))
    j = j.join(exact, j[ref] == exact["exact_path"], "left")
    j = j.join(fold, j["__low"] == fold["fold_key"], "left").join(base, j["__name"] == base["base_key"], "left")
    j = j.join(near, (j["__name"] == near["near_key"]) & (j["__dir"] == near["near_dir"]), "left").join(far, j["__name"] == far["far_key"], "left")
    arms = [
        ("exact", F.col("exact_path").isNotNull(), "exact_path"),
        ("casefold", F.col("fold_path").isNotNull(), "fold_path"),
        ("basename", F.col("base_path").isNotNull(), "base_path"),
        ("same_dir_tail", F.col("near_n") == 1, "near_path"),
        ("cross_dir_tail", F.col("near_n").isNull() & (F.col("far_n") == 1), "far_path"),
    ]
    target = F.coalesce(*(F.when(c, F.col(p)) for _, c, p in arms))
    arm = F.coalesce(*(F.when(c, F.lit(n)) for n, c, _ in arms), F.lit("missing"))
    return j.select(*(refs[c] for c in refs.columns), target.alias("target"), arm.alias("arm"))


def resolve_assets(refs: DataFrame, assets: DataFrame, aliases: DataFrame, stop_on_duplicate: bool = True, stop_on_alias_duplicate: bool = True) -> DataFrame:
    """References by basename to assets, directly or by an ordered list of aliases.

    ``refs`` has ``name``, ``assets`` (name, id), ``aliases`` (source, pos,
    target). Where a name has several assets it is a collision, or its aliases
    are tried (``stop_on_duplicate`` false); an alias with several assets ends
    the search in a collision, or is passed over (``stop_on_alias_duplicate``
    false). Adds ``asset`` and ``outcome``: direct, alias, collision, unmapped.
    """
    index = assets.groupBy(F.lower("name").alias("key")).agg(F.min("id").alias("id"), F.count("*").alias("n"))
    al = aliases.withColumn("source", F.lower("source")).withColumn("target", F.lower("target"))
    al = al.join(index, al["target"] == index["key"]).select("source", F.struct("pos", "n", "id").alias("x"))
    if not stop_on_alias_duplicate:
        al = al.where("x.n = 1")
    first = al.groupBy(F.col("source").alias("alias_key")).agg(F.min("x").alias("alias"))
    direct = index.select(F.col("key").alias("direct_key"), F.col("n").alias("direct_n"), F.col("id").alias("direct_id"))
    j = refs.withColumn("__k", F.lower("name"))
    j = j.join(direct, j["__k"] == direct["direct_key"], "left").join(first, j["__k"] == first["alias_key"], "left")
    dup = F.coalesce(F.col("direct_n") > 1, F.lit(False))
    many = F.coalesce(F.col("alias.n") > 1, F.lit(False))
    outcome = (
        F.when(F.col("direct_n") == 1, "direct")
        .when(dup & F.lit(stop_on_duplicate), "collision")
        .when(F.col("alias").isNull(), F.when(dup, "collision").otherwise("unmapped"))
        .when(many, "collision")
        .otherwise("alias")
    )
    j = j.withColumn("outcome", outcome)
    asset = F.when(F.col("outcome") == "direct", F.col("direct_id")).when(F.col("outcome") == "alias", F.col("alias.id"))
    return j.select(*(refs[c] for c in refs.columns), asset.alias("asset"), "outcome")


def best_targets(links: DataFrame, targets: DataFrame) -> DataFrame:
    """DataFrame[link_id, url, score]: of each link text (link_id, text) the best of the
    targets (key, url): an equal key 100, the text and " survey" 95, the text and
    " quiz" 94, a key that starts with the text and " survey" 93, that starts with the
    text 90, that holds it 80; ties go to the larger url. Links without a target,
    null and empty texts have null."""
    t, k = F.col("text"), F.col("key")
    survey, quiz = F.concat(t, F.lit(" survey")), F.concat(t, F.lit(" quiz"))
    score = F.when(k == t, 100).when(k == survey, 95).when(k == quiz, 94).when(F.startswith(k, survey), 93).when(F.startswith(k, t), 90).otherwise(80)
    # Equal keys score alike, so one of them, with the largest url, stands for all.
    keys = targets.groupBy("key").agg(F.max("url").alias("url"))
    parts = held_parts(keys, "key", links.select("text").distinct(), "text").withColumnRenamed("part", "text")
    best = parts.groupBy("text").agg(F.max(F.struct(score.alias("score"), "url")).alias("b")).hint("merge")
    return links.join(best, "text", "left").select("link_id", F.col("b.url").alias("url"), F.col("b.score").alias("score"))


def availability(refs: DataFrame, assets: DataFrame) -> DataFrame:
    """Distinct references with their number of uses and whether an asset has
    that name."""
    uses = refs.groupBy(F.lower("name").alias("name")).agg(F.count("*").alias("uses"))
    have = assets.select(F.lower("name").alias("name"), F.lit(True).alias("available")).distinct()
    return uses.join(have, "name", "left").select("name", "uses", F.coalesce("available", F.lit(False)).alias("available"))
