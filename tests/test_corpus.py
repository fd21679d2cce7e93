import datetime as dt
import math
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from gleaner.operators import entities as ent, graph, related, topics
from gleaner.operators.pages import article_pages

from .conftest import rows

T0 = dt.datetime(2024, 1, 1)
ART = "article_id long, feed_id long, title string, content_text string, content_hash string, source_url string, fetched_at timestamp, published_at timestamp, dedupe_of long"


def arts(spark, items):
    return spark.createDataFrame(
        [(i, i % 2, t, c, f"h{i}", f"http://a/{i}", T0 + dt.timedelta(days=i), T0 + dt.timedelta(days=i), None) for i, t, c in items], ART)


def topic_table(spark, *items):
    return spark.createDataFrame(list(items), "topic_id long, name string, description string, keywords array<string>, enabled boolean")


def test_keyword_scores(spark):
    a = arts(spark, [(1, "人工智能趋势", "text about AI"), (2, "none", "English words only"), (3, "AI AI", "ai")])
    t = topic_table(spark, (1, "ai", "", ["人工智能", "AI", " "], True), (2, "food", "", ["烹饪", "食谱"], True), (3, "off", "", ["none"], False))
    want = [(1, 1, 0.7, "keyword"), (3, 1, 0.5, "keyword")]
    assert rows(topics.match_keywords(a, t), "article_id", "topic_id", "score", "method") == want
    assert rows(topics.match_keywords(a, t, limit=0), "article_id", "topic_id", "score", "method") == want


def test_scores_are_capped_and_model_scores_only_fill_gaps(spark):
    a = arts(spark, [(1, "a b c d", ""), (2, "none", "")])
    t = topic_table(spark, (1, "x", "", ["a", "b", "c"], True))
    tags = topics.match_keywords(a, t)
    assert [r for r in rows(tags, "article_id", "score") if r[0] == 1] == [(1, 1.0)]
    a2 = arts(spark, [(1, "a", ""), (2, "zzz", "")])
    scores = spark.createDataFrame([(1, 1, 0.9), (2, 1, 0.7), (2, 2, 0.59)], "article_id long, topic_id long, score double")
    assert rows(topics.score_topics(a2, scores, topics.match_keywords(a2, t))) == [(2, 1, 0.7, "llm")]


def test_reclassify_keeps_rows_before_the_window(spark):
    a = arts(spark, [(1, "old word", ""), (20, "old word", ""), (21, "new word", "")])
    old = spark.createDataFrame([(1, 1, 0.5, "keyword"), (20, 1, 0.5, "keyword"), (20, 2, 0.5, "llm")], "article_id long, topic_id long, score double, method string")
    t = topic_table(spark, (1, "x", "", ["new"], True))
    out, open_ = topics.reclassify(a, old, t, 1, "2024-01-23", 5)
    assert rows(out, "article_id", "topic_id") == [(1, 1), (20, 2), (21, 1)]
    assert rows(open_, "article_id") == [(20,)]


def test_entity_folding_and_links(spark):
    m = spark.createDataFrame(
        [(1, "A", "org", ["a1"], "first", 0.5, T0, 0, 0, "s1"), (1, "A", "org", ["a2", "a1"], "same", 0.5, T0, 1, 0, "s2"),
         (2, "A", "org", [], "best", 0.9, T0 + dt.timedelta(days=1), 0, 0, "s3"), (2, "A", "person", [], "other", 0.3, T0, 0, 1, "s4")],
        "article_id long, name string, type string, aliases array<string>, description string, confidence double, seen timestamp, sentence long, pos long, surface string")
    got = {(r.type, r.name): r for r in ent.fold_entities(m).collect()}
    a = got[("org", "A")]
    assert (a.aliases, a.description, a.confidence, a.mention_count) == (["a1", "a2"], "best", 0.9, 2) and len(got) == 2
    again = ent.fold_entities(m, ent.fold_entities(m), ent.link_entities(m))
    assert rows(again, "entity_id", "mention_count", "aliases") == rows(ent.fold_entities(m), "entity_id", "mention_count", "aliases")
    more = ent.fold_entities(m.limit(1).withColumn("article_id", F.lit(9).cast("long")), ent.fold_entities(m), ent.link_entities(m))
    assert sorted(r.mention_count for r in more.collect()) == [1, 3]
    links = rows(ent.link_entities(m), "article_id", "confidence", "surface")
    assert links == [(1, 0.5, "s2"), (2, 0.3, "s4"), (2, 0.9, "s3")]


def test_grounding(spark):
    a = arts(spark, [(1, "", "the Qwen-3 model"), (2, "", "nothing here")])
    m = spark.createDataFrame([(1, "Qwen-3", 0.9), (1, "Qwen_3", 0.8), (2, "Absent", 0.9), (2, "Absent2", 0.15)], "article_id long, surface string, confidence double")
    got = rows(ent.ground(m, a), "article_id", "surface", "confidence")
    # one of six characters off is a ratio of 0.83: accepted
    assert got == [(1, "Qwen-3", 0.8), (1, "Qwen-3", 0.9), (2, "Absent", 0.45)]


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            above, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, above + (x != y))
    return row[-1]


def test_grounding_agrees_with_all_windows(spark):
    rnd = random.Random(11)
    texts = {i: "".join(rnd.choice("ab\\E.(\n\u00e9\U0001F600") for _ in range(rnd.choice((8, 40, 200)))) for i in range(25)}
    asked = []
    for i, t in texts.items():
        for _ in range(12):
            n = rnd.randint(1, min(len(t), 34))
            at = rnd.randint(0, len(t) - n)
            s = list(t[at:at + n])
            for _ in range(rnd.randint(0, 5)):
                where = rnd.randrange(len(s)) if s else 0
                s[where:where + rnd.randint(0, 1)] = rnd.choice(("", "a", "x"))
            asked.append((i, "".join(s), rnd.choice((0.15, 0.9))))
    asked += [(0, None, None), (0, "", 0.3), (30, "abc", 0.9), (31, "abcdefgh", 0.9), (99, "gone", 0.9), asked[0], asked[0]]
    texts |= {30: "", 31: None}
    m = spark.createDataFrame(asked, "article_id long, surface string, confidence double").withColumn("asked", F.lit("kept")).drop("asked")
    a = spark.createDataFrame(list(texts.items()), "article_id long, content_text string")
    want = []
    for i, s, c in asked:
        if i not in texts:
            continue
        t, c = texts[i], 0.5 if c is None else c
        good, out = not s or t == "" or (t is not None and s in t), s
        if not good and t:
            n = len(s)
            best = min(((levenshtein(s, t[j:j + n]), j) for j in range(len(t) - n + 1)), default=None)
            if best and 1 - best[0] / n > 0.8 + 1e-9:
                good, out = True, t[best[1]:best[1] + n]
        if good or c * 0.5 >= 0.1:
            want.append((i, out, good, c if good else c * 0.5))
    got = rows(ent.ground(m, a), "article_id", "surface", "grounded", "confidence")
    assert got == sorted(want, key=repr) and sum(w[2] for w in want) > 60
    assert ent.ground(m.limit(0), a).count() == 0 and ent.ground(m, a.limit(0)).count() == 0


def test_extraction_finds_longest_and_shortest_aliases(spark):
    a = arts(spark, [(1, "", "New York is big. York is old.\nnew   york")])
    g = spark.createDataFrame([("new york", "New York", "location"), ("york", "York", "location")], "alias string, name string, type string")
    assert rows(ent.extract_entities(a, g), "sentence", "pos", "name") == [
        (0, 1, "New York"), (0, 2, "York"), (1, 1, "York"), (2, 1, "New York"), (2, 2, "York")]


def test_alias_pairs_and_components(spark):
    names = ["openai labs", "openai lab", "open ai", "deepmind", "deepmind x"]
    e = spark.createDataFrame(
        [(i, "org", n, ["deepmind"] if n == "open ai" else [], n, 0.5, 10 - i, T0, T0) for i, n in enumerate(names)],
        "entity_id long, type string, name string, aliases array<string>, description string, confidence double, mention_count long, first_seen timestamp, last_seen timestamp")

    def grams(s):
        return {("  " + w + " ")[i:i + 3] for w in s.split() for i in range(len(w) + 1)}

    want = set()
    for i in range(5):
        for j in range(i + 1, 5):
            x, y = grams(names[i]), grams(names[j])
            if len(x & y) / len(x | y) > 0.6 or {i, j} == {2, 3}:
                want.add((i, j))
    pairs = ent.alias_pairs(e)
    assert set(rows(pairs, "a", "b")) == want and len(want) >= 3
    merged = {r.name: r for r in ent.merge_entities(e, pairs).collect()}
    assert set(merged) == {"openai labs", "open ai"} and merged["openai labs"].aliases == ["openai lab"]
    assert merged["open ai"].mention_count == 8 + 7 + 6
    chain = spark.createDataFrame([(i, i + 1) for i in range(30)], "a long, b long")
    assert {r.root for r in ent.components(chain).collect()} == {0}


def test_alias_pairs_of_all_sizes_meet_on_several_trigrams(spark):
    rnd = random.Random(8)
    parts = ["th", "on", "er", "in", "tion", "es", "le"]
    word = lambda n: "".join(rnd.choice(parts) for _ in range(n))
    names = {" ".join(word(rnd.randrange(1, 5)) for _ in range(2)) for _ in range(300)} | {"a", "b", "ab", "a b", "a bc", "ab c", "\u5f20\u4e09", "\u5f20\u4e09\u4e30"}
    for w in (6, 16):  # up to 24 trigrams, up to 64, and more
        long = [word(6) for _ in range(w)]
        names |= {" ".join(long), " ".join(long[1:]), " ".join(long[:-2] + ["xyz"]), " ".join(long[: w // 2])}
    names = sorted(names)
    e = spark.createDataFrame([(i, "t", n, []) for i, n in enumerate(names)], "entity_id long, type string, name string, aliases array<string>")
    sets = [{("  " + w + " ")[i:i + 3] for w in n.split() for i in range(len(w) + 1)} for n in names]
    df = Counter(g for s in sets for g in s)
    ordered = [sorted(s, key=lambda g: (df[g], g)) for s in sets]
    for t in (0.6, 0.3, 0.85):
        want = [(i, j) for j in range(len(names)) for i in range(j) if round(len(sets[i] & sets[j]) / len(sets[i] | sets[j]), 6) > t]
        assert rows(ent.alias_pairs(e, t), "a", "b") == sorted(want, key=repr) and len(want) > 5
    one = Counter(g for s in ordered for g in s[: len(s) - math.ceil(len(s) * 0.6 - 1e-9) + 1])
    g = spark.createDataFrame([(i, "t", s) for i, s in enumerate(ordered)], "entity_id long, type string, g array<string>")
    assert ent._candidates(g, 0.6).distinct().count() * 5 < sum(k * (k - 1) // 2 for k in one.values())


def test_related_entity_hot_path_is_exact(spark):
    rnd = random.Random(5)
    n = 60
    links = sorted({(a, e) for a in range(n) for e in ([0] if rnd.random() < 0.8 else []) + ([1] if rnd.random() < 0.6 else []) + [rnd.randrange(2, 25)]})
    pub = {a: rnd.randrange(20) for a in range(n)}
    losers = {3, 7}
    a = spark.createDataFrame([(i, T0 + dt.timedelta(days=pub[i]), 0 if i in losers else None) for i in range(n)],
                              "article_id long, published_at timestamp, dedupe_of long")
    ae = spark.createDataFrame(links, "article_id long, entity_id long")
    sets = defaultdict(set)
    for x, e in links:
        sets[x].add(e)
    want = []
    for x in range(n):
        cand = [(-len(sets[x] & sets[y]), -pub[y], y) for y in range(n) if y != x and y not in losers and sets[x] & sets[y]]
        want += [(x, y, -s, r + 1) for r, (s, _, y) in enumerate(sorted(cand)[:5])]
    for hot in (5, 10_000):
        got = rows(related.related_entity(a, ae, hot=hot), "article_id", "related_id", "shared", "rank")
        assert got == sorted(want, key=repr)


def test_related_topic_and_feed_against_brute_force(spark):
    rnd = random.Random(9)
    n = 40
    tags = sorted({(a, rnd.randrange(3)): rnd.choice([0.2, 0.4, 0.6]) for a in range(n) for _ in range(2)}.items())
    tags = [(a, t, s) for (a, t), s in tags]
    a = arts(spark, [(i, f"t{i}", "") for i in range(n)])
    at = spark.createDataFrame(tags, "article_id long, topic_id long, score double")
    best = defaultdict(dict)
    for x, t, _ in tags:
        for y, u, s in tags:
            if t == u and x != y:
                best[x][y] = max(s, best[x].get(y, 0))
    want = [(x, y, r + 1) for x in best for r, (y, s) in enumerate(sorted(best[x].items(), key=lambda p: (-p[1], -p[0]))[:5])]
    assert rows(related.related_topic(a, at), "article_id", "related_id", "rank") == sorted(want, key=repr)
    feed = [(x, y, r + 1) for x in range(n) for r, y in enumerate([y for y in range(n - 1, -1, -1) if y % 2 == x % 2 and y != x][:3])]
    assert rows(related.related_feed(a), "article_id", "related_id", "rank") == sorted(feed, key=repr)


def test_graph_links_stay_inside_the_nodes(spark):
    e = spark.createDataFrame([(i, f"n{i}", "org" if i < 3 else "person", 10 - i, T0) for i in range(5)],
                              "entity_id long, name string, type string, mention_count long, first_seen timestamp")
    r = spark.createDataFrame([(0, "p", 1, 0.5), (1, "p", 4, 0.9), (2, "q", 0, 0.7)], "subject_id long, predicate string, object_id long, confidence double")
    nodes, links = graph.graph(e, r, entity_type="org")
    assert rows(nodes, "id", "symbol_size") == [(0, 30), (1, 28), (2, 26)]
    assert rows(links, "source", "target") == [(0, 1), (2, 0)]
    assert rows(graph.neighbours(e, r).where("entity_id = 0"), "other_id", "predicate") == [(1, "p"), (2, "q")]


def test_equal_titles_get_their_own_pages(spark):
    a = arts(spark, [(1, "Weekly", "x"), (2, "Weekly", "y"), (3, "", "no title")])
    s = spark.createDataFrame([(1, "Sum", ["p1", "p2"])], "article_id long, summary_text string, key_points array<string>")
    rel = spark.createDataFrame([(1, 2, "feed", 0.3, 1)], "article_id long, related_id long, src string, score double, rank long")
    got = {r.ref_id: r for r in article_pages(a, s, rel).collect()}
    assert {r.slug for r in got.values()} == {"weekly-1", "weekly-2"}
    assert got[1].content_md == "# Weekly\n\nSum\n\n## 要点\n\n- p1\n- p2\n\n原文: http://a/1"
    assert got[1].related[0].id == 2 and got[2].related is None
