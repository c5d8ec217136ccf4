"""Conversion of packages from end to end, and policy profiles.

Stages keep their order: replacements, literal rewrites, banner, the sanitising
chain, best practice, then detectors on the result. All but two are built-in
expressions; the chain and the best-practice pass share one Arrow stage.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packloom.operators import detect, review, rules
from packloom.rewrite import chain


@dataclass(frozen=True)
class Profile:
    profile_id: str
    description: str = "No description"
    template_checks_enabled: bool = True
    sanitize_brightspace_assets: bool = True
    neutralize_legacy_d2l_links: bool = True
    use_alt_text_for_removed_template_images: bool = True
    repair_missing_local_references: bool = True
    check_instructor_notes: bool = True
    check_template_placeholders: bool = True
    check_legacy_quiz_wording: bool = True
    require_mc_closing_bullet: bool = True
    preflight_items: tuple[str, ...] = field(default=())


def load_profiles(text: str) -> dict[str, Profile]:
    """Profiles of a JSON text; missing flags are on."""
    raw = json.loads(text).get("profiles")
    if not isinstance(raw, dict) or not any(isinstance(v, dict) for v in raw.values()):
        raise ValueError("no profiles in the configuration")
    out = {}
    for name, d in raw.items():
        if isinstance(d, dict):
            known = {k: bool(v) for k, v in d.items() if k in Profile.__dataclass_fields__ and k not in ("profile_id", "description", "preflight_items") and v is not None}
            items = tuple(str(x).strip() for x in d.get("preflight_items") or () if str(x).strip())
            out[name] = Profile(name, str(d.get("description") or "No description"), preflight_items=items, **known)
    return out


def profile(name: str, text: str) -> Profile:
    every = load_profiles(text)
    if name not in every:
        raise ValueError(f"unknown profile '{name}'; valid: {', '.join(sorted(every))}")
    return every[name]


def convert(pages: DataFrame, config: rules.Rules, chosen: Profile, policy: chain.Policy = chain.Policy(), best_practice: bool = False) -> DataFrame:
    """Pages (path, html) to (path, html, changed, changes, manual, accessibility)."""
    policy = replace(policy, template_assets=chosen.sanitize_brightspace_assets, legacy_links=chosen.neutralize_legacy_d2l_links, alt_text_for_removed_images=chosen.use_alt_text_for_removed_template_images)
    # The page before goes along as a digest: the stage of the chain need not hold it.
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    df = pages.withColumn("__before", digest(F.col("html")))
    df = rules.apply_rewrites(rules.apply_replacements(df, config.replacements), config.rewrites)
    df = rules.apply_banner(df, config.banner).withColumnRenamed("changes", "__first")
    df = chain.sanitise(df, policy=policy, practice=best_practice).withColumn("changes", F.concat("__first", "changes"))
    h = F.col("html")
    manual = [rules.triggered(h, config.triggers)]
    if chosen.template_checks_enabled:
        manual.append(detect.template_issues(h, F.col("path"), chosen.check_instructor_notes, chosen.check_template_placeholders, chosen.check_legacy_quiz_wording, chosen.require_mc_closing_bullet))
    layout = F.transform(detect.layout_elements(h), lambda x: detect.issue(F.when(detect.is_breaking(x.intent), "Layout-breaking CSS detected").otherwise("Layout CSS may render differently in Canvas"), F.left(x.tag, F.lit(120))))
    manual += [layout, detect.tool_embeds(h)]
    return df.select("path", "html", (~digest(h).eqNullSafe(F.col("__before"))).alias("changed"), "changes", F.concat(*manual).alias("manual"), detect.accessibility(h).alias("accessibility"))


def write_back(pages: DataFrame, drafts: DataFrame, triggers: list[rules.Trigger], chosen: Profile, policy: chain.Policy = chain.Policy(), best_practice: bool = False) -> DataFrame:
    """A reviewer's drafts in converted pages: DataFrame[path, html, status, found, changed,
    edited_body_changed, changes, manual, accessibility, and the numbers of manual and
    accessibility issues and of changes of the chain and of best practice].

    ``pages`` (path, html), ``drafts`` (path, original_body_html, edited_body_html). Pages
    with a draft get its body, go through the chain again (and best practice) and are
    searched for what is left to do by hand; others pass as they are (kept), drafts without
    a page are missing. A page drafted twice has the larger text.
    """
    policy = replace(policy, template_assets=chosen.sanitize_brightspace_assets, legacy_links=chosen.neutralize_legacy_d2l_links, alt_text_for_removed_images=chosen.use_alt_text_for_removed_template_images)
    text = lambda c: F.coalesce(c, F.lit(""))
    path = F.replace(F.trim(text("path")), F.lit("\\"), F.lit("/"))
    d = drafts.select(path.alias("path"), F.struct(text("edited_body_html").alias("edit"), text("original_body_html").alias("was")).alias("x")).groupBy("path").agg(F.max("x").alias("x"))
    j = d.join(pages.select("path", F.col("html").alias("before")), "path", "left")
    found = j.where("before IS NOT NULL").select("path", "before", "x", review.with_body(F.col("before"), F.col("x.edit")).alias("html"))
    df = chain.sanitise(found, policy=policy)
    if best_practice:
        df = chain.enforce(df, closer=chosen.require_mc_closing_bullet)
    h = F.col("html")
    done = df.withColumn("manual", F.concat(rules.triggered(h, triggers), detect.tool_embeds(h))).withColumn("accessibility", detect.accessibility(h))
    count = lambda own: F.aggregate(F.filter("changes", lambda c: (c["category"] == "best_practice") == own), F.lit(0).cast("long"), lambda a, c: a + c["count"])
    trimmed = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    done = done.select(
        "path", "html", F.when(h == F.col("before"), "unchanged").otherwise("updated").alias("status"), F.lit(True).alias("found"), (h != F.col("before")).alias("changed"),
        (trimmed(F.col("x.edit")) != trimmed(F.col("x.was"))).alias("edited_body_changed"), "changes", "manual", "accessibility",
        F.size("manual").cast("long").alias("manual_review_issues"), F.size("accessibility").cast("long").alias("accessibility_issues"), count(False).alias("sanitizer_changes"), count(True).alias("best_practice_changes"),
    )
    flat = lambda df, status, there: df.withColumns({"status": F.lit(status), "found": F.lit(there), "changed": F.lit(False)})
    kept = flat(pages.select("path", "html").join(d, "path", "left_anti"), "kept", True)
    missing = flat(j.where("before IS NULL").select("path"), "missing", False)
    return done.unionByName(kept, allowMissingColumns=True).unionByName(missing, allowMissingColumns=True)
