import json
from urllib.parse import quote

import pytest
from pyspark.sql import functions as F

from packloom.sources import recorded

BASE = "https://x.example"
SCHEMA = recorded.ANSWER


def link(url, more=True):
    return f'<{url}&first>; rel="first", <{url}>; rel="next"; title=x' if more else f'<{url}>; rel="current"'


def chain(first, n, per=2):
    urls = [first] + [f"{first}&page={i}" for i in range(1, n)]
    return [(u, 1, 200, link(urls[i + 1]) if i + 1 < n else None, json.dumps([{"title": f"t{i}-{j}", "x": [1]} for j in range(per)] + ["skipped"])) for i, u in enumerate(urls)]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_base():
    assert recorded.base_url(" x.example/courses/1/ ") == BASE and recorded.base_url("https://x.example/a?b") == BASE
    for bad in ("http://x.example", "", "ftp://x.example", "https://"):
        with pytest.raises(ValueError):
            recorded.base_url(bad)


def test_pages_of_nine_kinds(spark):
    wanted = recorded.requests(spark, "x.example", ["7", "8"])
    rows = []
    for r in wanted.collect():
        rows += [(r.url, 1, 200, None, '{"id": 1, "name": "C"}')] if r.kind == "course" else chain(r.url, {"modules": 9, "files": 2}.get(r.kind, 1))
    rows.append((rows[-1][0], 0, 500, None, "older"))
    got = recorded.items(frame(spark, rows), wanted)
    n = {(r.course, r.kind): r["count"] for r in got.groupBy("course", "kind").count().collect()}
    assert n == {(c, k): 1 if k == "course" else 2 * {"modules": 9, "files": 2}.get(k, 1) for c in "78" for k in ("course", *recorded.LISTS)}
    ordered = got.where("kind = 'modules' and course = '7'").orderBy("page", "pos").collect()
    assert [json.loads(r.item)["title"] for r in ordered] == [f"t{i}-{j}" for i in range(9) for j in range(2)]
    assert recorded.titles(got).where("kind = 'module'").count() == 36
    assert recorded.failures(frame(spark, rows), wanted).count() == 0
    pages = spark.createDataFrame([("7", "pages", json.dumps({"url": s})) for s in ("a b/c~d*é", "", "x")] + [("7", "pages", "{}")], "course string, kind string, item string")
    assert {r.url for r in recorded.page_requests(pages, BASE).collect()} == {f"{BASE}/api/v1/courses/7/pages/{quote(s, safe='')}" for s in ("a b/c~d*é", "x")}
    migrations = spark.createDataFrame([("7", "content_migrations", '{"id": 5}'), ("7", "content_migrations", '{"id": 6}')], "course string, kind string, item string")
    issues = recorded.issue_requests(migrations, BASE)
    rows = [a for r in issues.collect() for a in chain(r.url, 3)]
    assert recorded.items(frame(spark, rows), issues).groupBy("request").count().where("count = 6").count() == 2


def failing():
    u = lambda k: f"{BASE}/{k}"
    return {
        "broken": ([(u("broken"), 1, 200, link(u("gone")), "[]")], f"not recorded: {u('gone')}"),
        "none": ([], f"not recorded: {u('none')}"),
        "cycle": ([(u("cycle"), 1, 200, link(u("c1")), "[]"), (u("c1"), 1, 200, link(u("c2")), "[]"), (u("c2"), 1, 200, link(u("c1")), "[]")], f"the chain returns to {u('c1')}"),
        "own": ([(u("own"), 1, 200, link(u("own")), "[]")], f"the chain returns to {u('own')}"),
        "status": ([(u("status"), 1, 404, None, '{"message": "no such"}')], "HTTP 404: no such"),
        "errors": ([(u("errors"), 1, 401, link(u("y")), '{"errors": [{"m": 1}]}')], 'HTTP 401: [{"m":1}]'),
        "out": ([(u("out"), 1, 401, None, '{"status": "unauthenticated"}')], recorded.UNAUTHENTICATED),
        "text": ([(u("text"), 1, 502, None, "bad " * 100)], "HTTP 502: " + ("bad " * 100)[:200]),
        "object": ([(u("object"), 1, 200, None, '{"a": 1}')], "an object where a list is expected"),
        "told": ([(u("told"), 1, 200, None, '{"errors": "e"}')], "errors returned: e"),
        "junk": ([(u("junk"), 1, 200, None, "[1,")], "no JSON list"),
        "course": ([(u("course"), 1, 200, None, "[]")], "no JSON object"),
    }


def test_errors(spark):
    cases = failing()
    wanted = spark.createDataFrame([("1", "course" if k == "course" else "files", f"{BASE}/{k}") for k in cases] + [("1", "files", f"{BASE}/fine")], "course string, kind string, url string")
    answers = frame(spark, [r for rows, _ in cases.values() for r in rows] + [(f"{BASE}/fine", None, None, None, ""), (f"{BASE}/fine2", 1, 200, link("z", False), None)])
    got = {r.request.rpartition("/")[2]: r.error for r in recorded.failures(answers, wanted).collect()}
    assert got == {k: e for k, (_, e) in cases.items()}
    assert recorded.items(answers, wanted, strict=False).count() == 0
    with pytest.raises(Exception, match="files: "):
        recorded.items(answers, wanted).collect()


def test_long_chain_takes_few_rounds(spark):
    rows = chain(f"{BASE}/long?a=1", 200, 1)
    wanted = spark.createDataFrame([("1", "files", f"{BASE}/long?a=1")], "course string, kind string, url string")
    got = recorded.follow(frame(spark, rows), wanted)
    assert sorted(r.page for r in got.collect()) == list(range(200)) and got.where(F.col("error").isNotNull()).count() == 0
