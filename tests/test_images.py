from __future__ import annotations

from pyspark.sql import functions as F

from labelwright.functions import images as I
from labelwright.operators import images as M

SIGNALS = list(I.SIGNAL_NAMES)
SCHEMA = (
    "product_id string, ord int, url string, compliance_score int, pre_score int, url_score int, phash string, "
    "classification struct<category:string>, ocr_text string, ocr_signals struct<"
    + ",".join(f"{s}:boolean" for s in SIGNALS)
    + ",word_count:int>"
)


def signals(**on):
    return {**{s: bool(on.get(s, False)) for s in SIGNALS}, "word_count": 0}


def candidate(product, i, score, category, sig=None, phash=""):
    return (product, i, f"https://img.example.com/{product}/{i}.jpg", score, score, score, phash, (category,), "", sig)


def test_text_signals(spark):
    texts = [
        "INGREDIENTS: Rolled Oats (25%), Wheat Flakes", "INGREDIANTS: Sugar, Salt", "INGREDlENTS: Oats", "INGRED1ENTS: Oats",
        "COMPOSITION: Wheat Flour, Salt", "MADE FROM: Natural Ingredients", "PREPARED FROM: Oats, Ragi",
        "NUTRITION FACTS: Calories 200, Total Fat 5g", "INGREDIENTS: Rolled Oats, Wheat\nMfg by: Test Ltd\n",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.s for r in df.select("i", I.text_signals(F.col("t")).alias("s")).collect()}
    assert all(got[i].signals.has_ingredients for i in range(7))
    assert got[7].signals.has_nutrition_only and not got[7].signals.has_ingredients
    assert got[8].signals.has_manufacturer and "+45" in got[8].reason
    assert df.limit(1).select(I.text_signals(F.lit("")).alias("s")).first().s is None


def test_missing_field_ranking(spark):
    rows = [
        candidate("p", 1, 90, "front_package", signals(has_net_qty=True)),
        candidate("p", 2, 70, "back_package", signals(has_manufacturer=True)),
        candidate("p", 3, 60, "ingredient_panel", signals(has_ingredients=True)),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    missing = spark.createDataFrame([("p", "ingredients")], "product_id string, field string")
    ranked = M.rank_for_missing(df, missing).orderBy(F.desc("field_score")).collect()
    assert ranked[0].ord == 3 and ranked[0].field_score == 60 + 60 + 25
    done = df.filter("ord = 3").select("product_id", "url")
    assert {r.ord for r in M.rank_for_missing(df, missing, done).collect()} == {1, 2}


def test_top_k_is_limited_before_the_shuffle(spark):
    df = spark.createDataFrame([candidate("p", 1, 1, "unknown")], SCHEMA)
    plan = M._top(df, 12, F.desc("url_score"), F.col("ord"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2


def test_collect_amazon_gallery(spark):
    html = (
        '<script>var d={"colorImages":{"initial":[{"hiRes":"https://m.media-amazon.com/images/I/61ABCDEFGH._SL1200_.jpg"}]}};</script>'
        '<div id="altImages"><ul><li><img src="https://m.media-amazon.com/images/I/61ABCDEFGH._SS40_.jpg"></li>'
        '<li><img src="https://m.media-amazon.com/images/I/71videothumb._SS40_PKmb-play-button_.jpg"></li></ul></div>'
        '<div id="reviews"><img src="https://m.media-amazon.com/images/I/91reviewpic._SL1500_.jpg"></div>'
    )
    df = spark.createDataFrame([("1", "https://www.amazon.in/dp/B000000001", html)], "page_id string, url string, html string")
    rows = M.collect_images(df).collect()
    assert [(r.url, r.source) for r in rows] == [("https://m.media-amazon.com/images/I/61ABCDEFGH._SL1500_.jpg", "colorImages_js")]


def test_srcset(spark):
    df = spark.createDataFrame([("a.jpg 300w, b.jpg 900w, c.jpg 900w",), ("x.jpg, y.jpg",), ("s.jpg 1x, t.jpg 2x",)], "s string")
    assert [r.v for r in df.select(I.best_of_srcset(F.col("s")).alias("v")).collect()] == ["b.jpg", "x.jpg", "t.jpg"]


def test_record_images_of_three_marketplaces(spark):
    from labelwright.operators.pages import extract_pages

    flip = "https://rukminim2.flixcart.com/image/128/128/x/a.jpeg"
    rows = [
        ("f", "https://www.flipkart.com/p", f'<img src="{flip}"><img src="{flip}"><a href="https://rukminim1.flixcart.com/image/40/40/b.png">'),
        ("s", "https://www.flipkart.com/p", '<script>window.__PRELOADED_STATE__ = {"u":"' + flip.replace("/", "\\/") + '"}</script>'),
        ("j", "https://www.jiomart.com/p", "".join(f'<img src="https://cdn1.jiomartjcp.com/{u}">' for u in ("images/t.resize(w:330)/a.jpg", "theme/assets/b.jpg", "icons/c.png", "x/Logo1.png"))),
        ("m", "https://www.myntra.com/p", '"https://assets.myntassets.com/assets/images/2024/JAN/5/ab_1.jpg" "https://assets.myntassets.com/assets/images/retaillabs/2024/1/x.png"'),
        ("g", "https://shop.example.com/p", f'<img src="{flip}">'),
        ("n", "https://www.flipkart.com/p", "".join(f'<img src="https://rukminim2.flixcart.com/image/1/i{i}.jpg">' for i in range(60))),
    ]
    got = {r.page_id: r.product_image_urls for r in extract_pages(spark.createDataFrame(rows, "page_id string, url string, html string")).collect()}
    full = flip.replace("128/128", "832/832")
    assert got["f"] == [full, "https://rukminim1.flixcart.com/image/832/832/b.png"] and got["s"] == [full] and got["g"] == [] and len(got["n"]) == 60
    assert got["j"] == ["https://cdn1.jiomartjcp.com/images/original/a.jpg"]
    assert got["m"] == ["https://assets.myntassets.com/h_1440,q_75,w_1080/v1/assets/images/2024/JAN/5/ab_1.jpg"]
