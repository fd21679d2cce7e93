import math
from collections import Counter

import pytest

from gleaner.operators import enrich

TEXTS = {
    1: "The cat sat. The dog ran far away! The cat and the dog met a very unusual zebra?",
    2: "the the the. " * 30 + "One odd sentence about quartz. " + "the cat. " * 30,
    3: "", 4: None, 5: "...", 6: "w" * 300 + ". short one. the cat.", 7: "The cat sat. The dog ran far away!", 8: "中文句子。另一个中文句子！",
    9: "x" * 5_000 + " end. next.",
}


def expected(texts, max_points=5, max_chars=200):
    """The same scores sentence by sentence; the words are those of plain ASCII texts and of CJK runs."""
    import regex

    def tokens(s):
        out = []
        for run in regex.findall(r"[一-鿿]+|[^\W_一-鿿]+", s.lower()):
            cjk = "一" <= run[0] <= "鿿"
            out += [run[i:i + n] for n in (1, 2) for i in range(len(run) - n + 1)] if cjk else [run]
        return set(out)

    cut = {k: [s for s in (" ".join(p.split()) for p in regex.sub(r"([.!?。！？])[ \n]+", r"\1\n", t).split("\n")) if s] for k, t in texts.items() if t}
    df = Counter(w for lines in cut.values() for s in lines for w in tokens(s))
    out = []
    for k, lines in cut.items():
        scores = {i: round(sum(math.log(1 + len(texts) / df[w]) for w in tokens(s)) / len(tokens(s)), 6) for i, s in enumerate(lines) if tokens(s)}
        if not scores:
            continue
        best = sorted(sorted(scores, key=lambda i: (-scores[i], i))[:max_points])
        points, summary = [lines[i] for i in best], lines[best[0]]
        for s in [lines[i] for i in best[1:]]:
            if len(summary) + 1 + len(s) > max_chars:
                break
            summary += " " + s
        out.append((k, summary, points, round(sum(scores[i] for i in best) / sum(scores.values()), 4)))
    return sorted(out)


@pytest.mark.parametrize("common", [50_000, 3, 1])
def test_summaries_are_whole_sentences_by_score(spark, monkeypatch, common):
    monkeypatch.setattr(enrich, "COMMON_TOKENS", common)  # the rest of the tokens take the shuffle join
    df = spark.createDataFrame([(k, t, "x") for k, t in TEXTS.items()], "doc_id long, text string, w string")
    got = sorted((r.doc_id, r.summary_text, r.key_points, round(r.confidence, 4)) for r in enrich.summarize(df, "doc_id", "text").collect())
    assert got == expected(TEXTS)
    assert got[2][1] == "w" * 300 + "."  # a first sentence that is too long stays whole
    assert enrich.summarize(df.limit(0), "doc_id", "text").count() == 0
