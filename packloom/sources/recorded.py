"""Recorded answers of a course system's REST interface as tables.

An answer is (url, at, status, link, body): when it was recorded, the HTTP status, the
Link header and the text. Lists come in pages, and each page names the next one.
``follow`` numbers the pages of every request by pointer doubling, so a chain of n pages
takes log n joins of narrow rows, and chains of any length are spread over the tasks; bodies
meet the numbers once, at the end. What the interface reports as an error is a row of
``failures``, as is a next page that was not recorded or a chain that returns to itself;
``items`` stops where there is one, unless told otherwise. Nothing is fetched.

Defined results: an address recorded more than once counts as its latest answer; items that
are no objects are skipped; an empty body is an empty list; null columns are empty.
"""

from __future__ import annotations

from functools import reduce
from urllib.parse import urlencode, urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packloom.runtime import materialise

ANSWER = "url string, at long, status int, link string, body string"
#: Paths and parameters of lists; {} is the course.
LISTS = {
    "content_migrations": ("courses/{}/content_migrations", {}),
    "modules": ("courses/{}/modules", {"include[]": "items"}),
    "files": ("courses/{}/files", {}),
    "assignments": ("courses/{}/assignments", {}),
    "discussions": ("courses/{}/discussion_topics", {}),
    "announcements": ("announcements", {"context_codes[]": "course_{}", "active_only": "false", "latest_only": "false"}),
    "pages": ("courses/{}/pages", {}),
}
COURSE, PAGE = "course", "page"
UNAUTHENTICATED = "Unauthenticated. Check token and permissions."


def base_url(text: str) -> str:
    """Scheme and host of an address; anything but HTTPS is refused."""
    value = text.strip()
    if not value.strip("/"):
        raise ValueError("a base address is required")
    if "://" not in value:
        value = f"https://{value}"
    u = urlsplit(value)
    if u.scheme.lower() != "https" or not u.netloc:
        raise ValueError(f"only HTTPS addresses are read: {text}")
    return f"https://{u.netloc}"


def requests(spark: SparkSession, base: str, courses: list[str], kinds: tuple[str, ...] = (COURSE, *LISTS), per_page: int = 100) -> DataFrame:
    """DataFrame[course, kind, url]: the first address of each list, and of the course."""
    root = base_url(base)

    def url(course: str, kind: str) -> str:
        if kind == COURSE:
            return f"{root}/api/v1/courses/{course}"
        path, more = LISTS[kind]
        query = urlencode({"per_page": per_page, **{k: v.format(course) for k, v in more.items()}})
        return f"{root}/api/v1/{path.format(course)}?{query}"

    return spark.createDataFrame([(c, k, url(c, k)) for c in courses for k in kinds], "course string, kind string, url string")


def issue_requests(migrations: DataFrame, base: str, per_page: int = 100) -> DataFrame:
    """The lists of issues of migrations (items of the kind content_migrations)."""
    root = base_url(base)
    number = F.get_json_object("item", "$.id")
    url = F.concat(F.lit(f"{root}/api/v1/courses/"), "course", F.lit("/content_migrations/"), number, F.lit(f"/migration_issues?per_page={per_page}"))
    return migrations.where("kind = 'content_migrations'").where(number.isNotNull()).select("course", F.lit("migration_issues").alias("kind"), url.alias("url"))


def page_requests(pages: DataFrame, base: str) -> DataFrame:
    """The addresses of whole pages (items of the kind pages), which are objects."""
    root = base_url(base)
    slug = F.trim(F.coalesce(F.get_json_object("item", "$.url"), F.lit("")))
    # url_encode is for forms: a space is +, and ~ is encoded there.
    safe = F.replace(F.replace(F.replace(F.url_encode(slug), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))
    url = F.concat(F.lit(f"{root}/api/v1/courses/"), "course", F.lit("/pages/"), safe)
    return pages.where("kind = 'pages'").where(slug != "").select("course", F.lit(PAGE).alias("kind"), url.alias("url"))


def read_recorded(spark: SparkSession, path: str) -> DataFrame:
    """Answers of JSON Lines files."""
    return spark.read.schema(ANSWER).json(path)


def next_link(link: Column) -> Column:
    """The address that a Link header gives for rel=next, else null."""
    parts = F.transform(F.split(link, ","), lambda p: F.transform(F.split(p, ";"), lambda f: F.trim(f)))

    def is_next(p: Column) -> Column:
        rel = F.get(F.filter(F.slice(p, 2, F.greatest(F.size(p), F.lit(1))), lambda f: F.startswith(f, F.lit("rel="))), F.lit(0))
        return (F.trim(F.substring(rel, 5, 1_000), F.lit('"')) == "next") & F.startswith(p[0], F.lit("<")) & F.endswith(p[0], F.lit(">"))

    url = F.get(F.filter(parts, lambda p: F.coalesce(is_next(p), F.lit(False))), F.lit(0))[0]
    return F.substring(url, F.lit(2), F.length(url) - 2)


def _kinds(body: Column) -> tuple[Column, Column]:
    """The elements of a list and the fields of an object, null where a text is neither."""
    return F.from_json(body, "array<string>"), F.from_json(body, "map<string,string>")


def error_of(status: Column, body: Column, single: Column) -> Column:
    """What an answer reports as wrong, else null. ``single``: an object is expected."""
    text = F.coalesce(body, F.lit(""))
    start = F.left(F.ltrim(text), F.lit(1))
    items, fields = _kinds(text)
    told = lambda k: F.when(start == "{", fields[k])
    out = told("status") == "unauthenticated"
    code = F.concat(F.lit("HTTP "), status.cast("string"))
    detail = F.coalesce(told("errors"), told("message"), F.when(F.trim(text) != "", F.left(text, F.lit(200))))
    failed = F.when(out, UNAUTHENTICATED).otherwise(F.concat_ws(": ", code, detail))
    listed = (
        F.when((F.trim(text) == "") | (start == "[") & items.isNotNull(), F.lit(None))
        .when(out, UNAUTHENTICATED)
        .when(told("errors").isNotNull(), F.concat(F.lit("errors returned: "), told("errors")))
        .when((start == "{") & fields.isNotNull(), "an object where a list is expected")
        .otherwise("no JSON list")
    )
    one = F.when((start == "{") & fields.isNotNull(), F.lit(None)).otherwise("no JSON object")
    return F.when(status >= 400, failed).when(single, one).otherwise(listed)


def latest(answers: DataFrame) -> DataFrame:
    """One answer an address."""
    return answers.groupBy("url").agg(F.max_by(F.struct("status", "link", "body"), F.coalesce("at", F.lit(0))).alias("x")).select("url", "x.status", "x.link", "x.body")


def follow(answers: DataFrame, wanted: DataFrame) -> DataFrame:
    """DataFrame[course, kind, request, url, page, error] of the pages of requests (course,
    kind, url). A page that was not recorded has an error, and the last one of a chain that
    returns to itself."""
    single = F.col("kind").isin(COURSE, PAGE)
    narrow = materialise(answers.groupBy("url").agg(F.max_by(F.struct(next_link(F.col("link")).alias("next"), F.coalesce("status", F.lit(200)).alias("status")), F.coalesce("at", F.lit(0))).alias("x")).select("url", "x.next", "x.status"), "answers")
    jump = narrow.where("next IS NOT NULL AND status < 400").select("url", F.col("next").alias("to"))
    key = ["course", "kind", "request", "url"]
    reached = wanted.select("course", "kind", F.col("url").alias("request"), "url").distinct().withColumn("page", F.lit(0).cast("long"))
    length = 1
    # Before each round the first ``length`` pages of every chain are known, and jump leads
    # as many further. Pages that are known already (a chain that returns) are not taken again.
    while True:
        more = reached.where(~single).join(jump, "url").select(*key[:3], F.col("to").alias("url"), (F.col("page") + length).alias("page"))
        new = materialise(more.groupBy(*key).agg(F.min("page").alias("page")).join(reached, key, "left_anti"), "chains")
        if new.isEmpty():
            break
        reached = materialise(reached.unionByName(new), "chains")
        a, b = jump.alias("a"), jump.alias("b")
        jump = materialise(a.join(b, F.col("a.to") == F.col("b.url")).select("a.url", "b.to"), "jumps")
        length *= 2
    ends = reached.where(~single).groupBy(*key[:3]).agg(F.max("page").alias("most"))
    j = reached.join(narrow.withColumn("there", F.lit(True)), "url", "left").join(ends, key[:3], "left")
    returns = (F.col("page") == F.col("most")) & F.col("next").isNotNull() & (F.col("status") < 400)
    error = F.when(F.col("there").isNull(), F.concat(F.lit("not recorded: "), "url")).when(returns, F.concat(F.lit("the chain returns to "), "next"))
    return j.select(*key, "page", error.alias("error"))


def _joined(answers: DataFrame, wanted: DataFrame) -> DataFrame:
    single = F.col("kind").isin(COURSE, PAGE)
    j = follow(answers, wanted).join(latest(answers), "url", "left")
    wrong = error_of(F.coalesce("status", F.lit(200)), F.col("body"), single)
    return j.select("course", "kind", "request", "url", "page", "body", F.coalesce("error", wrong).alias("error"))


def failures(answers: DataFrame, wanted: DataFrame) -> DataFrame:
    """DataFrame[course, kind, request, page, url, error] of what went wrong."""
    return _joined(answers, wanted).where("error IS NOT NULL").select("course", "kind", "request", "page", "url", "error")


def items(answers: DataFrame, wanted: DataFrame, strict: bool = True) -> DataFrame:
    """DataFrame[course, kind, request, page, pos, item] of the requests: objects as JSON texts, in
    their order. An error stops the job, or, if not ``strict``, its page is left out."""
    j = _joined(answers, wanted)
    if strict:
        j = j.withColumn("body", F.when(F.col("error").isNull(), F.col("body")).otherwise(F.raise_error(F.concat("course", F.lit(" "), "kind", F.lit(": "), "error")).cast("string")))
    else:
        j = j.where("error IS NULL")
    single = F.col("kind").isin(COURSE, PAGE)
    every = F.when(single, F.array("body")).otherwise(F.from_json("body", "array<string>"))
    rows = j.select("course", "kind", "request", "page", F.posexplode(every).alias("pos", "item"))
    return rows.where(F.startswith(F.ltrim("item"), F.lit("{")))


def titles(found: DataFrame) -> DataFrame:
    """DataFrame[package, kind, title] of items, as snapshots have them."""
    names = {"modules": "module", "pages": "page", "assignments": "assignment", "discussions": "discussion", "announcements": "announcement"}
    kind = reduce(lambda a, k: a.when(F.col("kind") == k, names[k]), names, F.when(F.lit(False), ""))
    title = F.trim(F.coalesce(F.get_json_object("item", "$.name"), F.get_json_object("item", "$.title"), F.lit("")))
    return found.select(F.col("course").alias("package"), kind.alias("kind"), title.alias("title")).where("kind IS NOT NULL AND title <> ''")
