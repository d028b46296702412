"""Cases that were wrong once: pages with innocent attributes, texts without letters, buckets of short texts."""

import sys
from collections import Counter

from pyspark.sql import functions as F

from loomspace.llm import exact_dedup, html_extract, langid

BODY = "<p>The river runs past the old mill and on to the sea where the boats wait.</p><p>A second paragraph of the very same story follows it here.</p>"
TEXT = "The river runs past the old mill and on to the sea where the boats wait.\nA second paragraph of the very same story follows it here."


def test_innocent_attributes_lose_no_page():
    for page in (
        f'<article title="The hidden valley">{BODY}</article>', f'<article data-id="comments">{BODY}</article>', f"<article data-x='a class=ad'>{BODY}</article>", f'<body class="single-post no-sidebar"><article>{BODY}</article></body>',
        f'<body class="post comments-open"><article>{BODY}</article></body>', f'<div class="post comments-open">{BODY}</div>', f'<form action="/x"><article>{BODY}</article></form>', f'<div class="has-sidebar"><main>{BODY}</main></div>',
        f'<div class="sidebar-layout"><article>{BODY}</article></div>', f'<article aria-label="hidden">{BODY}</article>',
    ):
        assert html_extract.main_text(page) == TEXT, page


def test_what_stands_inside_an_article_stays():
    assert html_extract.main_text("<article><p>Energy is <math><mi>E</mi></math> and <object>fallback text</object> one<br>two three four five six.</p></article>") == "Energy is E and fallback text one two three four five six."
    assert html_extract.main_text(f"<article>{BODY}<select-x>kept words in the middle of it all.</select-x></article>").startswith(TEXT + "\nkept words")


def test_what_is_no_article_goes():
    inside = '<aside class="x"><p>Buy this thing now, it is very good indeed.</p></aside><div id="comments"><article class="comment"><p>I liked this one very much, thank you.</p></article></div><nav><p>Some words that stand in a menu of the page.</p></nav>'
    assert html_extract.main_text(f'<article>{BODY}{inside}</article><div class="widget"><p>Some related text that stands in a widget of the page.</p></div>') == TEXT
    assert html_extract.main_text(f"<article>{BODY * 20_000}</article>").count("\n") == 39_999


def test_names_of_other_columns_of_pages(spark):
    df = spark.createDataFrame([(1, f"<article>{BODY}</article>", "x", 7)], "page_id long, html string, row string, value int")
    assert html_extract.extract(df).select("text").first()[0] == TEXT


def test_texts_without_letters_have_no_language(spark):
    rows = [(i, ("bab baba abba " if i % 2 else "zoz zozo ozzo ") * 9, "az"[i % 2 == 0] * 2) for i in range(40)] + [(50, "½ ² 12", "aa"), (51, "① Ⅷ ²", "zz"), (52, "_ 7", None), (53, "é", "aa")]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert [(got[i].lang_pred, got[i].score) for i in (50, 51, 52)] == [("und", 0.0)] * 3
    assert got[53].lang_pred in ("aa", "zz")


def test_buckets_of_short_texts_fit_their_tables(spark):
    fits = 200_000
    body = F.format_string("%010d", "id")
    sizes = spark.range(20_000).select(F.xxhash64(body).alias("h"), (F.octet_length(body).cast("long") + exact_dedup.ROW_BYTES).alias("n_bytes"))
    first, levels, _ = exact_dedup.grace_levels(sizes, fits)
    held = Counter(r.bucket for r in exact_dedup._bucketed(sizes, first, levels).select("bucket").collect())
    assert max(held.values()) * (sys.getsizeof("0123456789") + 400) <= 1.1 * fits
    docs = spark.range(20_000).select((F.col("id") % 15_000).alias("doc_id"), F.format_string("%010d", F.col("id") % 15_000).alias("text"))
    got = exact_dedup.classify(docs, bucket_bytes=fits)
    assert got.count() == 20_000 and got.agg(F.sum("group_size")).first()[0] == 10_000 + 2 * 2 * 5_000
