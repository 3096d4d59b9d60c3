"""The trie of conversation prefixes against one built turn by turn."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfindex.llm import prefix_trie
from shelfindex.llm.range_minimum import RangeMinimum

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(conversations):
    """Nodes from conv_id -> list of (role, text)."""
    members, ending = defaultdict(list), defaultdict(list)
    for conv_id, turns in conversations.items():
        for depth in range(len(turns) + 1):
            members[tuple(turns[:depth])].append(conv_id)
        ending[tuple(turns)].append(conv_id)
    children = defaultdict(list)
    for prefix in members:
        if prefix:
            children[prefix[:-1]].append(prefix)

    def below(prefix):
        words = len(prefix[-1][1].split()) if prefix else 0
        leaves, saved = int(not children[prefix]), (len(members[prefix]) - 1) * words
        for child in children[prefix]:
            more = below(child)
            leaves, saved = leaves + more[0], saved + more[1]
        return leaves, saved

    found = set()
    for prefix, ids in members.items():
        ends = ",".join(map(str, sorted(ending[prefix]))).encode()
        parent = min(members[prefix[:-1]]) if prefix else None
        found.add((min(ids), len(prefix), parent, len(ids), len(children[prefix]), *below(prefix),
                   hashlib.sha256(ends).hexdigest()))
    return found


def corpus(draw, n):
    """Conversations that share first turns, a third of them one and the same."""
    found = {}
    for conv_id in range(n):
        turns = [("user", f"hello {draw.randint(0, 1)}")]
        while draw.random() < 0.7:
            turns.append((draw.choice(["user", "bot"]), "w " * draw.randint(0, 2)))
        found[conv_id * 7] = [("user", "a common one"), ("bot", "yes")] if conv_id % 3 == 0 else turns
    found[5] = []
    return found


def rows_of(conversations):
    return [(c, i, *turn) for c, turns in conversations.items() for i, turn in enumerate(turns)]


@pytest.mark.parametrize("seed", [1, 2])
def test_nodes_equal_a_trie_built_by_turn(spark, seed, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CELL", 64)
    conversations = corpus(random.Random(seed), 300)
    found = prefix_trie.sequences(spark.createDataFrame(rows_of(conversations), SCHEMA))
    empty = found.limit(1).select(F.lit(5).cast("long").alias("conv_id"), F.slice("turns", 1, 0).alias("turns"))
    nodes = prefix_trie.trie(found.unionByName(empty)).collect()
    assert len(nodes) == len(set(nodes))
    assert {tuple(row) for row in nodes} == brute(conversations)


def test_odd_conversations(spark):
    rows = [
        (None, 0, "user", "no id"), (1, None, None, "x"), (1, 0, "user", None), (1, 0, "user", None),
        (2, 3, "", "x"), (2, 9, "user", ""), (2, 9, "user", ""), (3, 0, "user", "y " * 100_000),
        (4, 0, "user", "ab"), (5, 0, "usera", "b"),
    ]
    odd = spark.createDataFrame(rows, SCHEMA).withColumn("path", F.lit(1)).withColumn("words", F.lit(1))
    nodes = prefix_trie.trie(prefix_trie.sequences(odd)).collect()
    turns = [("", "x"), ("user", ""), ("user", "")]
    expected = brute({1: turns, 2: turns, 3: [("user", "y " * 100_000)], 4: [("user", "ab")],
                      5: [("usera", "b")]})
    assert {tuple(row) for row in nodes} == expected
    assert prefix_trie.trie(prefix_trie.sequences(odd.limit(0))).count() == 0


def test_range_minima_and_reaches():
    draw = np.random.default_rng(4)
    values = draw.integers(0, 4, 50)
    table = RangeMinimum(values)
    for place in range(50):
        for bound in range(5):
            left = right = place
            while right + 1 < 50 and values[right + 1] >= bound:
                right += 1
            while left >= 1 and values[left] >= bound:
                left -= 1
            at = np.array([place]), np.array([bound])
            assert table.reach_right(*at)[0] == right and table.reach_left(*at)[0] == left
        for end in range(place, 50):
            assert table.least(np.array([place]), np.array([end]))[0] == values[place : end + 1].min()
