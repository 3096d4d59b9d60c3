"""Joins, scores and counts of texts against brute force."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfindex.llm import jaccard, mixing, quality, token_counts, toxicity

ODD = [(None, "no id here at all my friend"), (9001, None), (9002, ""), (9003, " \n "), (9004, "one"),
       (9005, "x" * 200_000), (9006, "ne " * 30_000)]


def text_of(draw, n):
    return " ".join(draw.choice("abcdefghijklmnopqrstuvwxyz") + str(draw.randint(0, 400)) for _ in range(n))


def corpus(seed=3):
    draw = random.Random(seed)
    texts = [text_of(draw, draw.randint(1, 120)) for _ in range(60)]
    base = text_of(draw, 200).split()
    for _ in range(40):  # a group of near copies
        words = list(base)
        words[draw.randrange(200)] = "changed" + str(draw.randint(0, 9))
        texts.append(" ".join(words))
    for text in texts[:10]:
        texts += [text, text.upper() + "!"]
        words = text.split()
        words[len(words) // 2] = "other"
        texts.append(" ".join(words))
    return list(enumerate(texts))


def brute(rows, threshold=0.8):
    import re

    sets = {}
    for i, text in rows:
        words = re.findall(r"[^\W_]+", (text or "").lower())
        if words:
            width = min(5, len(words))
            sets[i] = frozenset(tuple(words[k : k + width]) for k in range(len(words) - width + 1))
    first = {}
    for i in sorted(sets):
        first.setdefault(sets[i], i)
    links = defaultdict(set)
    classes = list(first.items())
    for a, (s, i) in enumerate(classes):
        for t, j in classes[a + 1 :]:
            if len(s & t) >= threshold * len(s | t):
                links[i].add(j)
                links[j].add(i)
    group = {}
    for i in sorted(first.values()):
        if i not in group:
            stack = [i]
            while stack:
                at = stack.pop()
                if at not in group:
                    group[at] = i
                    stack += links[at]
    return {
        i: (first[sets[i]], len(links[first[sets[i]]]), group[first[sets[i]]])
        if i in sets else (i, 0, i)
        for i, _ in rows
    }


@pytest.mark.parametrize("block", [512, 7])
def test_join_finds_every_link(documents, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = corpus() + ODD[1:]
    table = documents(rows).withColumn("node", F.lit(1)).withColumn("component", F.lit("x"))
    got = {r.doc_id: (r.class_id, r.links, r.group_id) for r in jaccard.joined(table).collect()}
    assert got == brute(rows)


def test_one_of_each_group_stays_with_its_columns(documents):
    rows = corpus()
    table = documents(rows + [(5, rows[5][1]), (None, "abc"), (None, None)])
    left = jaccard.first_of_groups(table)
    assert left.columns == table.columns
    want = sorted({g for _, _, g in brute(rows).values()})
    assert sorted(r.doc_id for r in left.collect() if r.doc_id is not None) == want
    assert jaccard.joined(documents([])).count() == 0
    assert jaccard.first_of_groups(documents([])).count() == 0


def test_banding_reaches_its_recall():
    bands, rows = jaccard.banding(0.8, 0.9999)
    assert bands * rows <= jaccard.MOST_HASHES and 1 - (1 - 0.8**rows) ** bands >= 0.9999


def labelled(n=600):
    draw = random.Random(8)
    rows, marks = [], []
    for i in range(n):
        words = text_of(draw, draw.randint(5, 60)).split()
        toxic, low = i % 5 == 0, i % 7 == 0
        if toxic:
            words.insert(draw.randrange(len(words)), draw.choice(["grunk", "blarf", "zonk"]))
        text = " ".join(f"{w}%%%" for w in words) if low else " ".join(words)
        rows.append((i, text))
        marks.append((i, int(not low), int(toxic)))
    return rows, marks


def test_an_id_with_two_texts_loses_neither(spark, documents):
    draw = random.Random(21)
    a, b = text_of(draw, 80), text_of(draw, 80)
    near = " ".join([*a.split()[:-1], "other"])
    rows = [(1, a), (1, b), (2, near), (3, b + " !"), (1, ""), (4, None), (4, "")]
    kept_rows = jaccard.first_of_groups(documents(rows)).collect()
    assert sorted((r.doc_id, r.text or "") for r in kept_rows) == sorted(
        [(1, a), (1, b), (1, ""), (4, "")])
    found = sorted((r.doc_id, r.class_id, r.links, r.group_id, r.keep)
                   for r in jaccard.joined(documents(rows)).collect())
    assert found == [
        (1, 1, 0, 1, True), (1, 1, 0, 1, True), (1, 1, 1, 1, True), (2, 2, 1, 1, False),
        (3, 1, 0, 1, False), (4, 4, 0, 4, True), (4, 4, 0, 4, True)]


@pytest.mark.parametrize("operator,at", [(toxicity, 2), (quality, 1)])
def test_scores_on_held_out_documents(documents, labels, operator, at):
    rows, marks = labelled()
    table = documents(rows + ODD + [(3, rows[3][1])]).withColumn("label", F.lit("clash"))
    marked = labels(marks + [(None, 1, 1), (5, None, None), (77, 1, 1), (123456, 0, 1)])
    got = operator.scored(table, marked).collect()
    assert len(got) == len(rows) + len(ODD) + 1
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    truth = {m[0]: m[at] for m in marks}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 60
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)


def test_toxicity_learns_pairs_that_tell_nothing_alone(spark, documents, labels):
    draw, rows, marks = random.Random(11), [], []
    for i in range(4000):
        mention, insult = draw.randrange(10), draw.randrange(10)
        if draw.random() < 0.5:
            insult = mention
        words = [f"f{draw.randint(0, 300)}" for _ in range(20)]
        kind = draw.random()
        words += [f"group{'abcdefghij'[mention]}"] if kind < 0.6 else []
        words += [f"insult{'abcdefghij'[insult]}"] if kind < 0.4 or 0.6 <= kind < 0.8 else []
        draw.shuffle(words)
        rows.append((i, " ".join(words)))
        marks.append((i, 1, int(kind < 0.4 and mention == insult)))
    found = toxicity.scored(documents(rows), labels(marks)).filter("held_out").collect()
    truth = {i: toxic for i, _, toxic in marks}
    hits = [r.predicted for r in found if truth[r.doc_id]]
    false = [r.predicted for r in found if not truth[r.doc_id]]
    assert sum(hits) >= 0.9 * len(hits) and sum(false) <= 0.15 * len(false)


def test_the_output_is_the_sum_over_all_pairs():
    draw = np.random.default_rng(1)
    machine = toxicity.Machine(0.3, np.arange(6), draw.normal(size=6), draw.normal(size=(6, 3)))
    rows = np.array([0, 2, 3, 5])
    pairs = sum(
        machine.vectors[a] @ machine.vectors[b] for a in rows for b in rows if a < b
    )
    assert machine.output(rows) == pytest.approx(0.3 + machine.weights[rows].sum() + pairs)
    assert machine.output(rows[:0]) == 0.3


@pytest.mark.parametrize("operator", [toxicity, quality])
def test_without_labels_nothing_is_rejected(documents, labels, operator):
    table = documents([(1, "a b c"), (2, None)])
    assert operator.accepted(table, labels([])).count() == 2
    assert operator.accepted(table, labels([(1, 1, 0)])).columns == table.columns
    assert operator.scored(documents([]), labels([])).count() == 0


def test_pairs_decide_what_single_terms_cannot():
    draw = np.random.default_rng(0)
    rows = [np.array([i for i in range(2) if draw.random() < 0.5], dtype=int) for _ in range(2000)]
    target = np.array([float(len(r) == 2) for r in rows])
    bias, weights, vectors = toxicity.fit(rows, target, 2)
    machine = toxicity.Machine(bias, np.array([1, 2]), weights, vectors)
    outputs = [machine.output(np.array(r, dtype=int)) for r in ([], [0], [1], [0, 1])]
    assert outputs[3] > 0 > max(outputs[:3]) and vectors[0] @ vectors[1] > 0


def test_isotonic():
    fitted = quality.isotonic(np.array([0.1, 0.5, 0.3, 0.9]), np.array([1, 1, 3, 1]))
    assert np.allclose(fitted, [0.1, 0.35, 0.35, 0.9])


def brute_count(vocabulary, word):
    word = token_counts.MARK + word
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        options = []
        for start in range(end):
            piece = vocabulary.pieces.get(word[start:end])
            if piece is not None:
                options.append((best[start][0] + piece, -best[start][1] - 1))
        if word[end - 1] not in vocabulary.pieces:
            score, size = vocabulary.fallback(word[end - 1])
            options.append((best[end - 1][0] + score, -best[end - 1][1] - size))
        score, count = max(options)
        best.append((score, -count))
    return best[-1][1]


def test_token_counts(documents):
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = corpus()[:40] + ODD + [(1, "Straße Ελλάδα 日本語テキスト 🙂🙂 naïve\tthe\nthe")]
    got = {r.doc_id: (r.n_pretokens, r.n_tokens) for r in token_counts.counted(documents(rows[40:]), path).collect()}
    vocabulary = token_counts.Vocabulary.from_file(path)
    for i, text in rows[40:]:
        words = (text or "").split()
        if max(map(len, words), default=0) < 1000:
            known = {w: brute_count(vocabulary, w) for w in set(words)}
            assert got[i] == (len(words), sum(known[w] for w in words))
    assert got[9001] == got[9002] == got[9003] == (0, 0) and got[9005][0] == 1
    assert token_counts.counted(documents([]), path).count() == 0


def test_mixing_reaches_its_targets(documents):
    draw = random.Random(4)
    own = {"en": "the of and", "fr": "le de et", "de": "der und die"}
    rows = [
        (i, " ".join(draw.choice(own[lang].split()) for _ in range(draw.randint(3, 40))),
         lang if i % 3 else None)
        for i in range(400) for lang in [draw.choice(["en", "en", "en", "fr", "de"])]
    ] + [(*r, None) for r in ODD]
    table = documents(rows).withColumn("tokens", F.lit(1)).withColumn("rate", F.lit("x"))
    targets = {"en": 0.2, "fr": 0.4, "de": 0.4}
    got = mixing.rated(table, targets).collect()
    assert len(got) == len(rows)
    total = sum(r.tokens for r in got)
    assert total == sum(len((r[1] or "").split()) for r in rows)
    for name, share in targets.items():
        reached = sum(r.rate * r.tokens * r[f"share_{name}"] for r in got)
        assert abs(reached - share * total) < 1e-4 * total
    assert all(r.rate >= 0 and abs(r.copies - r.rate) <= 1 for r in got)
    often = mixing.mixed(table, targets)
    assert often.columns == table.columns
    assert often.count() == sum(r.copies for r in got)
    assert mixing.rated(documents([]), targets).count() == 0
    assert mixing.mixed(documents([(1, "a", None)]), targets).count() >= 0
