"""URL rules and exact groups against brute force on small inputs."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from gleaner.llm import exact_radix, url_filter
from gleaner.llm.queries import URL_RULES


def brute_verdict(url, rules, default="allow"):
    m = re.search("://", url or "")
    rest = url[m.end():] if m else ""
    host = re.split("[/?#]", rest)[0]
    path = re.split("[?#]", rest[len(host):])[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(len(h + p), len(h), v == "block", h, p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3] + best[4], best[5] if best else default


def test_urls_against_brute_force(spark):
    rng = random.Random(2)
    rules = URL_RULES + [("a.com", "", "block"), ("a.com", "", "allow"), ("com", "/x", "block"), ("é.org", "/ü", "block"), (None, "/", "block")]
    urls = [None, "", "x", "://", "http://", "http://a.com", "HTTP://A.COM/x?u=://b", "http://www.Example.com/en/1#t", "http://é.org/üb", "http://a.com\n/x", "http://.com/", "http://a..com/x/" + "y" * 70000, "http://" + "b." * 3000 + "com/xx"]
    urls += ["http://" + ".".join(rng.choices(["www", "example", "com", "net", "a"], k=rng.randint(1, 4))) + rng.choice(["", "/", "/en", "/en/", "/en/x?q", "/es/", "/fr/#", "?/en/", "/x"]) for _ in range(300)]
    pages = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(urls * 2)], "page_id long, url string, rule string")
    listed = [r for r in rules if r[0]]
    got = url_filter.with_verdicts(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    assert sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got) == [(i, *brute_verdict(u, listed)) for i, u in enumerate(urls * 2)]
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert {(r.rule, r.verdict) for r in url_filter.with_verdicts(pages, none, "block").collect()} == {(None, "block")}
    assert url_filter.with_verdicts(pages.limit(0), none).count() == 0
    clashing = pages.select("page_id", "url", *[F.lit(c).alias(c) for c in ("best", "page", "full", "short", "found", "suffix", "prefix", "asked", "rule_host")])
    again = url_filter.with_verdicts(clashing, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    assert sorted((r.page_id, r.rule, r.verdict, r.best) for r in again) == sorted((r.page_id, r.rule, r.verdict, "best") for r in got)


def brute_groups(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    out = []
    for (i, _), t in zip(rows, norm):
        ids = [j for (j, _), u in zip(rows, norm) if u == t]
        keep = min((j for j in ids if j is not None), default=None)
        out.append((i, keep, len(ids), hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_exact_groups_against_brute_force(spark):
    rng = random.Random(4)
    texts = [None, "", " ", "  \n", "a", "a b", "a\t\nb", "a \x0b b", "a b", "x" * 64, "x" * 63, "x" * 65, "x" * 1024, "x" * 1025, "x" * 1024 + "é"]
    rows = [(rng.choice([None, *range(30)]), t) for t in texts * 3] + [(100 + i, "".join(rng.choices("ab \n", k=rng.randint(0, 6)))) for i in range(150)]
    frame = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, size int")
    for digits in ({}, {"first_digit": 2, "growth": 4, "widest": 256}, {"first_digit": 1, "growth": 1}):
        if digits.get("growth") == 1:
            frame = frame.where("length(text) < 7 or text is null")
            rows = [r for r in rows if r[1] is None or len(r[1]) < 7]
        got = exact_radix.exact_groups(frame, **digits).collect()
        assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == brute_groups(rows)
        kept = {}
        for r in got:
            kept[r.text_sha256] = kept.get(r.text_sha256, 0) + r.kept
            assert not r.kept or r.doc_id == r.keep_id
        assert set(kept.values()) == {1}
    assert exact_radix.exact_groups(frame.limit(0)).count() == 0
