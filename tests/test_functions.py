from pyspark.sql import functions as F

from gleaner.functions import text as X
from gleaner.operators.cleaning import classify_hosts, clean_pages, drop_boilerplate


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "v string").select(expr(F.col("v")).alias("r")).first()["r"]


def test_canonical_url(spark):
    cases = {
        "https://Example.COM/path/#frag": "https://example.com/path", "http://A.com/b/": "http://a.com/b",
        "http://a.com": "http://a.com/", "HTTP://a.com//?Q=1#x": "http://a.com/?Q=1", "https://a.com/X/y?": "https://a.com/X/y",
    }
    got = {r.v: r.r for r in spark.createDataFrame([(u,) for u in cases], "v string").select("v", X.canonical_url(F.col("v")).alias("r")).collect()}
    assert got == cases


def test_content_hash_ignores_white_space(spark):
    values = ["a  b  c", "a b c", " a\tb\n c　", "a b d"]
    got = [r.r for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").orderBy("i").select(
        X.content_hash(F.col("v")).alias("r")).collect()]
    assert got[0] == got[1] == got[2] != got[3]


def test_white_space_class_matches_unicode(spark):
    chars = [c for c in map(chr, range(1, 0x3100))]
    df = spark.createDataFrame([(ord(c), c) for c in chars], "i int, c string")
    assert {r.i for r in df.where(F.col("c").rlike("^" + X.WHITESPACE + "$")).collect()} == {ord(c) for c in chars if c.isspace()}


def test_tokens_mix_words_and_cjk_grams(spark):
    assert one(spark, "Hello, Wörld 42", X.tokens) == ["hello", "wörld", "42"]
    assert one(spark, "AI 人工智", X.tokens) == ["ai", "人", "工", "智", "人工", "工智"]
    assert one(spark, None, X.tokens) == []


def test_tokens_keep_the_order_of_the_text(spark):
    assert one(spark, "one\n## 要点\ntwo 原文: three", X.tokens) == ["one", "要", "点", "要点", "two", "原", "文", "原文", "three"]


def test_scrub_html(spark):
    html = "<SCRIPT a='1'>x\n</SCRIPT><p>k</p><style>p{}</style>"
    assert one(spark, html, X.scrub_html) == "<p>k</p>"
    assert one(spark, "abéé", lambda c: X.scrub_html(c, 3)) == "ab"


def test_slugify(spark):
    row = spark.createDataFrame([("Hello, World_x  y!", 7), ("!!!", 8)], "t string, i long")
    got = [r.r for r in row.orderBy("i").select(X.slugify(F.col("t"), F.col("i")).alias("r")).collect()]
    assert got == ["hello-world-x-y-7", "article-8"]
    assert one(spark, "My Topic", lambda c: X.slugify(c, F.lit(3).cast("long"), "topic")) == "topic-my-topic-3"


def test_sentences(spark):
    assert one(spark, "One. Two!  Three?\nFour", X.sentences) == ["One.", "Two!", "Three?", "Four"]


def test_clean_pages(spark):
    html = ('<html><head><title>T &amp; x</title><script>var a="</p>";</script></head><body><nav>menu</nav><article><h1>Head</h1>'
            '<p>Some <a href="/u">link</a> text</p><ul><li>one</li></ul></article><footer>f</footer></body></html>')
    df = spark.createDataFrame([(1, html), (2, "<html><title>Only</title><body></body></html>"), (3, "")], "page_id long, html string")
    got = {r.page_id: r for r in clean_pages(df).collect()}
    assert got[1].content_text == "Head\nSome link text\none" and got[1].word_count == 5
    assert got[1].content_md == "# Head\nSome [link](/u) text\n- one" and got[1].title == "T & x"
    assert got[2].content_text == "Only" and got[2].content_md == "# Only" and got[2].is_parseable
    assert not got[3].is_parseable and got[3].word_count == 0


def test_drop_boilerplate(spark):
    pages = [(i, "http://h.com/%d" % i, f"text {i}\nSubscribe now") for i in range(3)] + [(9, "http://x.com/", "Subscribe now")]
    df = spark.createDataFrame(pages, "page_id long, url string, t string")
    got = {r.page_id: r.t for r in drop_boilerplate(df, "page_id", "url", "t", 3).collect()}
    assert got == {0: "text 0", 1: "text 1", 2: "text 2", 9: "Subscribe now"}


def test_host_classes(spark):
    urls = {
        "https://a.Example.com:8080/x": "allowed", "https://example.com": "allowed", "https://badexample.com": "blocked",
        "http://10.1.2.3/": "private", "http://172.32.0.1/": "blocked", "http://172.16.0.1/": "private", "http://localhost:1/": "private",
        "http://[::1]/": "private", "http://x.localhost/": "private", "http://8.8.8.8/": "blocked", "http://user@example.com/": "allowed",
        "http://[::ffff:10.0.0.1]/": "private", "http://[0:0:0:0:0:0:0:1]:80/": "private", "http://[::ffff:808:808]/": "blocked", "http://[::ffff:0a00:1]/": "private",
        "http://[fe80::1%25eth0]/": "private", "http://[2606:4700::1111]/": "blocked", "http://[2001:DB8::1]/": "private", "http://[fd00::]/": "private", "http://[1::2::3]/": "blocked",
    }
    allowed = spark.createDataFrame([("example.com",)], "host string")
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert {r.url: r.host_class for r in classify_hosts(df, "url", allowed).collect()} == urls


def test_noise_blocks_end_where_they_are_closed():
    from gleaner.operators.cleaning import without_noise

    assert without_noise('<p>a</p><div class="ad banner"><div>x</div>TAIL</div><p>b</p>') == "<p>a</p><p>b</p>"
    assert without_noise("<div class='big Sidebar'>x</div><div class=share>y</div><div class=\"advertise\">z</div>") == '<div class="advertise">z</div>'
    assert without_noise("<nav>a<nav>b</nav>c</nav>d<!-- <nav> -->e<aside>open f") == "deopen f"
    assert without_noise("") == "" and without_noise("a < b > c") == "a < b > c"
