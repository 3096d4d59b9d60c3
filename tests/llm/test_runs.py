"""Periodic runs against a scan of every period."""

import random

from pyspark.sql import functions as F

from shelfindex.llm import periodic_runs
from shelfindex.llm.suffix_tree import SuffixTree


def brute(words):
    found = {}
    for period in range(1, len(words) // 4 + 1):
        at = 0
        while at + period < len(words):
            end = at
            while end + period < len(words) and words[end] == words[end + period]:
                end += 1
            length = end - at + period
            if end > at and length >= max(6, 4 * period):
                found.setdefault((at, length), period)
            at = max(end, at + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def word_lists(count, seed):
    draw = random.Random(seed)
    for _ in range(count):
        words = [str(draw.randint(0, draw.randint(1, 4))) for _ in range(draw.randint(0, 70))]
        if len(words) > 5 and draw.random() < 0.5:
            a = draw.randrange(len(words))
            p = 1 + (len(words) - a) // draw.randint(3, 10)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        yield words


def test_runs_equal_a_scan_of_all_periods():
    for words in word_lists(800, 1):
        assert periodic_runs.runs(words) == brute(words), words


def test_cutting_at_rare_words_loses_nothing():
    for words in word_lists(300, 2):
        if words:
            whole = periodic_runs.runs_within(periodic_runs.numbered(words))
            assert sorted(whole, key=lambda r: (r[0], r[2])) == brute(words)


def test_extensions_equal_a_letter_by_letter_comparison():
    draw = random.Random(3)
    for _ in range(60):
        numbers = periodic_runs.numbered([str(draw.randint(0, 2)) for _ in range(draw.randint(2, 40))])
        tree = SuffixTree(numbers)
        listed = numbers.tolist()
        suffixes = sorted(range(len(listed) + 1), key=lambda i: listed[i:])
        assert [tree.ranks()[i] for i in suffixes] == list(range(len(suffixes)))
        downwards = sorted(range(len(listed) + 1), key=lambda i: [-x for x in listed[i:]])
        assert [tree.ranks(True)[i] for i in downwards] == list(range(len(suffixes)))
        pairs = [(i, j) for i in range(len(listed)) for j in range(i + 1, len(listed))]
        found = tree.shared(*(periodic_runs.np.array(side) for side in zip(*pairs, strict=True)))
        for (i, j), shared in zip(pairs, found.tolist(), strict=True):
            assert listed[i : i + shared] == listed[j : j + shared]
            assert j + shared == len(listed) or listed[i + shared] != listed[j + shared]


def test_odd_documents(spark, documents):
    long = "a b c " * 40_000
    rows = [(None, "x x x x x x"), (1, None), (2, ""), (3, " \t\n "), (4, "y " * 5), (5, long),
            (5, "y " * 6), (5, "y " * 6), (6, "word" * 50_000), (7, "a a " * 8)]
    odd = documents(rows).withColumn("runs", F.lit("z")).withColumn("n_words", F.lit(0))
    found = [
        (r.doc_id, r.n_words, [tuple(run) for run in r.runs], r.collapsed)
        for r in periodic_runs.with_runs(odd).collect()
    ]
    assert sorted(found, key=lambda r: (r[0] or -1, r[1])) == [
        (None, 6, [(0, 6, 1)], "x"),
        (1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (4, 5, [], "y y y y y"),
        (5, 6, [(0, 6, 1)], "y"), (5, 6, [(0, 6, 1)], "y"),
        (5, 120_000, [(0, 120_000, 3)], "a b c"),
        (6, 1, [], "word" * 50_000),
        (7, 8, [(0, 8, 1)], "a a"),
    ]
    assert periodic_runs.with_runs(odd.limit(0)).count() == 0


def test_a_planted_text_keeps_one_period(spark, documents):
    text = "start here " + "one two three " * 5 + "end"
    row = periodic_runs.with_runs(documents([(1, text)])).first()
    assert row.collapsed == "start here one two three end"
    assert [tuple(run) for run in row.runs] == [(2, 15, 3)]
