"""Spelling variants of a vocabulary: words one edit apart, by dynamic programming over sorted word lists.

A pair one edit apart is equal before and after the edit, so words meet where all but a window of them agrees: first
the left or the right half of the longer word, and as long as a group has too many words, halves of that window. The
place of the edit lies in one window of each width, so a pair is counted in one group only, and a window of one letter
has no more words than letters: no group stays large, and no pair is lost.

In a group the words' windows are a sorted list. A search walks it with a banded edit matrix of which the rows of the
common prefix with the entry before are kept, and leaves the whole run of entries that share a prefix already more
than one edit away.
"""

from __future__ import annotations

from collections.abc import Iterator
from os.path import commonprefix

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import ascii_lower, stored, text_or_empty

NO_LETTER = "[^A-Za-zÀ-ÿ]+"
SPLIT_OVER = 64  # words of a group before it is split by half windows; those of one letter stay whole


def damaged(doc_id: Column, run: Column, every: int) -> Column:
    """``run`` without one code point if ``every`` divides its hash in the document; a stand-in for typing errors."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run))
    at = (h % F.char_length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))).otherwise(run)


def vocabulary(docs: DataFrame, min_length: int = 5, min_count: int = 3, damage_every: int = 0) -> DataFrame:
    """word, n: runs of letters of whole texts, A-Z lower-cased, of ``min_length`` code points and ``min_count`` places at least.

    Null and empty texts have no words; repeated rows count again; a null doc_id hashes as an empty one; other columns are
    not read. With ``damage_every`` a run may lose a code point first.
    """
    runs = docs.select("doc_id", F.explode(F.split(ascii_lower(text_or_empty()), NO_LETTER)).alias("run")).where("run <> ''")
    word = damaged(F.col("doc_id"), F.col("run"), damage_every) if damage_every else F.col("run")
    words = runs.select(word.alias("word")).where(F.char_length("word") >= min_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def one_edit_pairs(entries: list[str]) -> Iterator[tuple[int, int]]:
    """Places (i, j), i < j, of a sorted list whose entries are exactly one edit apart.

    Row d of the band holds the edits from the first d letters of an entry to the first d - 1, d and d + 1 letters of
    the query, 9 where there are none.
    """
    count = len(entries)
    shared = [0] + [len(commonprefix((x, y))) for x, y in zip(entries, entries[1:])]
    for i, query in enumerate(entries):
        size = len(query)
        # the walk starts below the query itself, whose own rows are known
        lefts, mids, rights = [9] + [1] * size, [0] * (size + 1), [1] * size + [9]
        letters, kept, j = query + "\0\0", size, i + 1
        while j < count:
            entry = entries[j]
            length, depth = len(entry), min(shared[j], kept)
            left, mid, right = lefts[depth], mids[depth], rights[depth]
            del lefts[depth + 1:], mids[depth + 1:], rights[depth + 1:]
            alive = True
            while depth < length:
                letter = entry[depth]
                below = 9 if depth > size else mid + 1
                if 1 <= depth <= size and left + (letter != letters[depth - 1]) < below:
                    below = left + (letter != letters[depth - 1])
                here = last = 9
                if depth < size:
                    here = min(mid + (letter != letters[depth]), right + 1, below + 1)
                    if depth + 1 < size:
                        last = min(right + (letter != letters[depth + 1]), here + 1)
                left, mid, right = below, here, last
                lefts.append(left)
                mids.append(mid)
                rights.append(right)
                depth += 1
                if left > 1 and mid > 1 and right > 1:
                    alive = False
                    break
            kept = depth
            j += 1
            if alive:
                off = size - length
                if (mid if off == 0 else right if off == 1 else left if off == -1 else 9) == 1:
                    yield i, j - 1
            else:  # all entries that share these letters are as far
                while j < count and shared[j] >= depth:
                    j += 1


def group_pairs(words: list[str], length: int, low: int, high: int) -> Iterator[tuple[int, int]]:
    """Places of words one edit apart, of which the longer has ``length`` letters and the edit in [low, high)."""
    tail = length - high
    cut = [w[low:len(w) - tail] for w in words]
    order = sorted(range(len(words)), key=cut.__getitem__)
    for i, j in one_edit_pairs([cut[k] for k in order]):
        x, y = words[order[i]], words[order[j]]
        if max(len(x), len(y)) != length or x[:low] != y[:low] or tail and x[-tail:] != y[-tail:]:
            continue  # both shorter: met in their own groups; or two keys of one hash
        if low <= len(commonprefix((x, y))) < high:
            yield order[i], order[j]


def _windowed(rows: DataFrame, windows: Column) -> DataFrame:
    """``rows`` (word, n, length) once for each of ``windows`` (low, high), with the key of what lies outside."""
    rows = rows.select("word", "n", "length", F.inline(windows))
    outside = F.concat(F.substring("word", F.lit(1), F.col("low")), F.lit("\0"), F.when(F.col("high") < F.col("length"), F.expr("right(word, length - high)")).otherwise(""))
    return rows.withColumn("key", F.xxhash64("length", "low", "high", outside))


def _halves(low: Column, high: Column) -> Column:
    mid = F.floor((low + high) / 2).cast("int")
    return F.array(F.struct(low.alias("low"), mid.alias("high")), F.struct(mid.alias("low"), high.alias("high")))


def near_words(words: DataFrame, split_over: int = SPLIT_OVER) -> DataFrame:
    """word, n_near, best (struct of minus n, word): for every word of ``words`` (word, n) one edit from another."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        for batch in batches:
            found: list[tuple[str, int, int, str]] = []
            for row in batch[["key", "length", "low", "high", "word", "n"]].itertuples(index=False, name=None):
                if held and held[0][:4] != row[:4]:
                    found += judged(held)
                    held = []
                held.append(row)
            yield pd.DataFrame(found, columns=["word", "n_near", "minus", "other"])
        yield pd.DataFrame(judged(held), columns=["word", "n_near", "minus", "other"])

    def judged(group: list[tuple]) -> list[tuple[str, int, int, str]]:
        if len(group) < 2:
            return []
        _, length, low, high, *_ = group[0]
        names, counts = [r[4] for r in group], [r[5] for r in group]
        near: dict[int, list[tuple[int, str]]] = {}
        for i, j in group_pairs(names, length, low, high):
            near.setdefault(i, []).append((-counts[j], names[j]))
            near.setdefault(j, []).append((-counts[i], names[i]))
        return [(names[i], len(x), *min(x)) for i, x in near.items()]

    lengths = F.array(F.char_length("word"), F.char_length("word") + 1)
    level = _windowed(words.select("word", "n", F.explode(lengths).alias("length")), _halves(F.lit(0), F.col("length")))
    parts, group = [], ["key", "length", "low", "high"]
    while True:
        level = stored(level, "windows")
        hot = level.where("high > low + 1").groupBy(group).agg(F.count("*").alias("size"))
        hot = stored(hot.where(F.col("size") > split_over).drop("size"), "hot")
        whole = hot.isEmpty()
        rows = level if whole else level.join(hot, group, "left_anti")
        parts.append(rows.repartition(*group).sortWithinPartitions(*group).mapInPandas(scan, "word string, n_near long, minus long, other string"))
        if whole:
            break
        level = _windowed(level.join(hot, group, "left_semi").select("word", "n", "length", _halves(F.col("low"), F.col("high")).alias("halves")), F.col("halves"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("minus", "other")).alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the last word reached from every word of ``forms`` (word, form); steps are doubled in each round."""
    to = stored(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        ahead = to.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stored(to.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "forms")
        if moved.where("moved").isEmpty():
            return moved.select("word", "root")
        to = moved.select("word", "root")


def variant_groups(words: DataFrame, ratio: int = 2, split_over: int = SPLIT_OVER) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of ``words`` (word, n; words distinct).

    form is the near word of largest n, ties to the smallest in code-point order, if its n is ``ratio`` times the word's
    at least; root follows forms to the last. An empty table gives none; columns but word and n are not read.
    """
    words = stored(words.select("word", F.col("n").cast("long").alias("n")), "words")
    form_n = -F.col("best.minus")
    near = near_words(words, split_over)
    rows = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(form_n >= F.col("n") * ratio, F.col("best.other")).alias("form"), F.when(form_n >= F.col("n") * ratio, form_n).alias("form_n"))
    rows = stored(rows, "near")
    last = roots(rows.where("form IS NOT NULL").select("word", "form"))
    return rows.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
