import base64

from pyspark.sql import functions as F

from packloom.operators import assets

PNG, BIG = b"\x89PNG\x00\xff" * 20, b"x" * 500


def uri(data, kind="png"):
    return f"data:image/{kind};base64,{base64.b64encode(data).decode()}"


def members(spark, rows):
    return spark.createDataFrame(rows, "package string, path string, content binary")


def test_references(spark):
    page = "w/sub/p.html"
    cases = {"../img/a%20b.png?x#y": "w/img/a b.png", "/img/c.PNG": "img/c.PNG", "d.jpg": "w/sub/d.jpg", "x\\e.gif": "w/sub/x/e.gif", "#f.png": None, "data:image/png;base64,": None, "https://x/f.png": None, "//x/f.png": None, "?f.png": None, "mailto:f.png": None}
    rows = spark.createDataFrame([(r,) for r in cases], "ref string").select("ref", assets.asset_name(F.lit(page), F.col("ref")).alias("n")).collect()
    assert {r.ref: r.n for r in rows} == cases
    types = spark.createDataFrame([("a.PNG",), ("b.svgz",), ("c.html",), ("d",), ("a.b/c",), (None,)], "p string").select("p", assets.image_type(F.col("p")).alias("t")).collect()
    assert [r.t for r in types] == ["image/png", "image/svg+xml", None, None, None, None]


def test_embedding(spark):
    store = members(spark, [("a", "w/i.png", PNG), ("a", "w/I.PNG", PNG[::-1]), ("a", "w/big.jpg", BIG), ("a", "w/x.js", PNG), ("a", "w/null.png", None), ("b", "w/i.png", b"other"), ("a", "w/$1.gif", b"g")])
    html = """<img src="i.png"><IMG SRC = 'i.png' alt="src='i.png'"><img src="../w/i.png"><img src=" I.png "><img src="big.jpg"><script src="x.js"></script><img src="none.png"><img src="null.png"><img src="$1.gif">\\1 $0"""
    pages = spark.createDataFrame([("a", "w/p.html", html), ("b", "w/p.html", "<img src='i.png'>"), ("a", "q.html", None), ("a", "r.html", ""), ("c", "w/p.html", html)], "package string, path string, html string")
    got = {(r.package, r.path): r for r in assets.embed(pages, store, image_bytes=200).collect()}
    i, other = uri(PNG), uri(PNG[::-1])
    want = html.replace('src="i.png"', f'src="{i}"').replace("SRC = 'i.png'", f"SRC = '{i}'").replace("src='i.png'", f"src='{i}'").replace('"../w/i.png"', f'"{i}"').replace('"$1.gif"', f'"{uri(b"g", "gif")}"')
    # Of names that differ in case the last in order stands for one that none has.
    folded = want.replace('" I.png "', f'"{i}"')
    r = got["a", "w/p.html"]
    assert r.html in (folded, want.replace('" I.png "', f'"{other}"')) and (r.embedded, r.too_large, r.over_budget) == (4, 1, 0)
    assert got["b", "w/p.html"].html == f"<img src='{uri(b'other')}'>"
    assert got["c", "w/p.html"].html == html and got["a", "q.html"].html is None and got["a", "r.html"].html == ""


def test_budget_counts_an_image_once(spark):
    store = members(spark, [("a", f"{i}.png", bytes([65 + i]) * 100) for i in range(4)])
    html = "".join(f'<img src="{i}.png"><img src="./{i}.png">' for i in range(4))
    r = assets.embed(spark.createDataFrame([("a", "p.html", html)], "package string, path string, html string"), store, page_bytes=250).first()
    assert (r.embedded, r.over_budget) == (4, 4) and r.html.count("data:") == 4 and 'src="2.png"' in r.html
    assert assets.embed(spark.createDataFrame([], "package string, path string, html string"), store).count() == 0


def test_hot_image(spark):
    pages = spark.range(3000).select(F.lit("a").alias("package"), F.concat(F.lit("p"), "id").alias("path"), F.lit("<img src='logo.png'>").alias("html"))
    got = assets.embed(pages, members(spark, [("a", "logo.png", PNG)]))
    assert got.where(F.col("html") == f"<img src='{uri(PNG)}'>").count() == 3000


def test_catalogues(spark):
    store = members(spark, [("a", "templateAssets/Star.png", PNG), ("a", "x/banner-3.png", b"1"), ("a", "y/banner_building blue.JPG", b"2"), ("a", "banner.jpeg", b"3"), ("a", "banner.gif", b"4"), ("a", "banners/logo.png", b"5")])
    icons = assets.icon_catalogue(store, store).orderBy("position").collect()
    assert len(icons) == len(assets.ICONS) and (icons[0].label, icons[0].data_uri) == ("Introduction", uri(PNG)) and {r.data_uri for r in icons[1:]} == {""}
    banners = {r["name"]: (r.label, r.raw_ref) for r in assets.banner_catalogue(store).collect()}
    assert banners == {"banner-3.png": ("3", "../TemplateAssets/banner-3.png"), "banner_building blue.JPG": ("Building Blue", "../TemplateAssets/banner_building blue.JPG"), "banner.jpeg": ("banner.jpeg", "../TemplateAssets/banner.jpeg"), "logo.png": ("Logo", "../TemplateAssets/logo.png")}
