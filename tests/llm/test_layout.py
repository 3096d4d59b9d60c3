"""Sharding, packing, archives and the pipeline."""

import hashlib
import random
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from shelfindex.llm import packing, sharding, warc, word_ids
from shelfindex.session import scratch_path
from tests.llm.test_texts import ODD, corpus, labelled

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def test_shards_are_even_whole_and_gapless(documents):
    draw = random.Random(2)
    rows = [(i, "w" * draw.randint(0, 400)) for i in range(3000)]
    rows += [(i, "the same text") for i in range(3000, 4500)]  # a third of all rows
    rows += [(i, "less often") for i in range(4500, 4520)] + ODD + [(7, rows[7][1])]
    got = sharding.sharded(documents(rows).withColumn("shard", F.lit("x"))).collect()
    assert len(got) == len(rows)
    slots, sizes = defaultdict(list), Counter()
    for r in got:
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
        assert r.law == "bytes" and r.grown_shard is None
    assert set(slots) <= set(range(8))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    texts = dict(rows)
    assert len({r.shard for r in got if texts[r.doc_id] == "less often"}) == 1
    for r in got:
        data = (texts[r.doc_id] or "").encode()
        if r.doc_id is not None:
            assert (r.size, r.text_crc32) == (len(data) + 1, zlib.crc32(data))
    assert sharding.sharded(documents([])).count() == 0


def test_shard_sizes_come_out_nearly_equal(documents):
    draw = random.Random(5)
    rows = [(i, "w" * draw.randint(1, 300)) for i in range(6000)]
    sizes = Counter()
    for r in sharding.sharded(documents(rows)).collect():
        sizes[r.shard] += r.size
    assert len(sizes) == 8 and max(sizes.values()) < 1.02 * min(sizes.values()), sizes


@pytest.mark.parametrize("doc_id", [None, 7])
def test_a_hot_text_under_one_id_is_split(documents, doc_id):
    draw = random.Random(3)
    rows = [(i, "w" * draw.randint(1, 30)) for i in range(2000)] + [(doc_id, "again and again")] * 2000
    slots, sizes = defaultdict(list), Counter()
    for r in sharding.sharded(documents(rows)).collect():
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
    assert len(sizes) == 8 and max(sizes.values()) < 1.2 * min(sizes.values()), sizes
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


@pytest.mark.parametrize("low,high,n", [(1, 60, 400), (20, 50, 60), (30, 40, 50), (1, 100, 500)])
def test_plan_holds_all_and_fits(low, high, n):
    counts = Counter(random.Random(n).choices(range(low, high + 1), k=n))
    bound = packing.lower_bound(counts, 100)
    plain = sum(times for _, times in packing.best_fit(counts, 100))
    bins = packing.plan(dict(counts), 100)
    held = Counter()
    for content, times in bins:
        assert sum(length * copies for length, copies in content) <= 100
        for length, copies in content:
            held[length] += copies * times
    assert held == counts
    assert bound <= sum(times for _, times in bins) <= plain


def test_completion_beats_best_fit():
    counts = {44: 2, 6: 2, 50: 0, 48: 1, 26: 2, 24: 2}  # best fit pairs the large ones wrongly
    counts = {k: v for k, v in counts.items() if v}
    best = min(
        sum(t for _, t in packing.plan(counts, 100)), sum(t for _, t in packing.best_fit(counts, 100))
    )
    assert sum(t for _, t in packing.plan(counts, 100)) == best >= packing.lower_bound(counts, 100)


def test_completion_finds_bins_of_many_pieces():
    counts = {40: 21 * 50, 37: 88 * 50}
    assert sum(t for _, t in packing.best_fit(counts, 4096)) > 50
    assert sum(t for _, t in packing.plan(counts, 4096)) == 50


def test_every_filling_is_tried():
    pieces = {**dict.fromkeys(range(1500, 1508), 1), 796: 1, 800: 1}
    found = list(packing.fillings(pieces, 1596, 1596, packing.Effort()))
    assert found[0] == ((800, 1), (796, 1)) and ((1507, 1),) in found
    draw = random.Random(7)
    for _ in range(30):
        counts = Counter(draw.choices(range(3, 20), k=8))
        room, waste = draw.randint(10, 50), draw.randint(0, 10)
        lengths, every = sorted(n for n in counts if n <= room), [{}]
        for n in lengths:
            every = [f | {n: c} if c else f for f in every for c in range(counts[n] + 1)]
        left = lambda f: room - sum(n * c for n, c in f.items())
        want = {
            frozenset(f.items()) for f in every
            if 0 <= left(f) <= waste and packing.undominated(counts, lengths, f, left(f))
        }
        got = [frozenset(f) for f in packing.fillings(counts, room, waste, packing.Effort())]
        assert len(got) == len(want) and set(got) == want


def test_waiting_enumerations_are_small():
    counts = Counter(random.Random(0).choices(range(1, 4097), k=5000))
    tracemalloc.start()
    packing.plan(counts, 4096)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20


def test_ids_are_the_librarys():
    known = word_ids.WordIds(VOCABULARY)
    odd = ["", "  ", "a's don't  ''s !'s", "Σίσυφος ΣΑΣ İstanbul é ́a ﬁ ½² x\xadb", "a\x85b c",
           "\x1ca b", "<|endoftext|> a <|x", "日本語 🙂👩‍👧", "a\x00b \x07", "Ünïcode ſtraße 1²3 --x--"]
    draw = random.Random(1)
    letters = "aBcÉñß'., !?-0²9ſŸ\xa0\n\tµ×"
    odd += ["".join(draw.choice(letters) for _ in range(60)) for _ in range(300)]
    for text in odd + odd:
        assert known.encode(text) == known.whole(text), text


def test_pieces_and_places(documents):
    rows = corpus()[:60] + ODD + [(9004, "one"), (9010, "long words here " * 5000)]
    table = documents(rows).withColumn("length", F.lit("clash"))
    got = packing.packed(table, VOCABULARY).collect()
    known = word_ids.WordIds(VOCABULARY)
    want = Counter()
    for doc_id, text in rows:
        ids = known.whole(text or "") + (1).to_bytes(4, "little")
        for piece, at in enumerate(range(0, len(ids), 4 * 4096)):
            part = ids[at : at + 4 * 4096]
            want[(doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(r.length for r in got)
    assert len(sequences) <= -(-total // 4096) + 2
    assert packing.packed(documents([]), VOCABULARY).count() == 0


PAGES = [(3, "u3", "x" * 150), (1, "u1", "x" * 150), (2, None, "short"), (5, "u5", "short"), (4, "u4", None),
         (None, "u", "y" * 120), (6, "u\r\n6", "é" * 60), (7, "u7", "é" * 60), (8, "u8", "z" * 300_000)]


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_archives_round_trip(spark):
    table = pages_of(spark, PAGES).withColumn("payload", F.lit("clash"))
    got = {r.page_id: r for r in warc.archived(table).collect()}
    assert len(got) == len(PAGES)
    for page_id, _, html in PAGES:
        data = (html or "").encode()
        assert got[page_id].payload_bytes == len(data)
        assert got[page_id].payload_digest == hashlib.sha256(data).hexdigest()
    assert {i: r.refers_to for i, r in got.items() if r.kind == "revisit"} == {3: 1, 7: 6}
    assert warc.archived(pages_of(spark, [])).count() == 0


def test_urls_of_any_length_come_back(spark):
    long = "data:text/html," + "x" * 100_000
    rows = [(1, long, "y" * 150), (2, long + "WARC/1.1", "y" * 150), (3, "u3", "z")]
    got = {r.page_id: r for r in warc.archived(pages_of(spark, rows)).collect()}
    assert {i: (r.kind, r.target, r.refers_to) for i, r in got.items()} == {
        1: ("response", long, None),
        2: ("revisit", long + "WARC/1.1", 1),
        3: ("response", "u3", None),
    }
    members = [warc.record(i, url, 1, hashlib.sha256(b"z").hexdigest(), None, b"z") for i, url, _ in rows]
    plain = warc.scan(b"".join(members))
    assert [r[2]["target"] for r in plain.records] == [url for _, url, _ in rows] and not plain.gaps


def damaged():
    members = []
    for i in range(6):
        data = (f"page {i} " * 40).encode()
        whole = warc.record(i, f"u{i}", len(data), hashlib.sha256(data).hexdigest(), None, data)
        members.append(whole)
    return members


@pytest.mark.parametrize("press", [warc.packed, bytes])
def test_salvage_goes_on_after_damage(press):
    parts = [press(m) for m in damaged()]
    starts = np.cumsum([0, *map(len, parts)])
    hurt = bytearray(b"".join(parts))
    middle = starts[2] + len(parts[2]) // 2
    hurt[middle : middle + 4] = b"\0\0\0\0"
    found = warc.scan(bytes(hurt))
    assert [r[2]["page_id"] for r in found.records] == [0, 1, 3, 4, 5]
    assert found.gaps == [(starts[2], starts[3])]
    cut = warc.scan(b"".join(parts)[: starts[5] + 30])
    assert [r[2]["page_id"] for r in cut.records] == [0, 1, 2, 3, 4] and cut.gaps == [(starts[5], starts[5] + 30)]
    junk = warc.scan(b"junk\x1f\x8b\x08more" + parts[0])
    assert len(junk.records) == 1 and junk.gaps == [(0, 11)]


def test_every_byte_is_in_a_record_or_a_gap():
    data = b"".join(warc.packed(m) for m in damaged())
    draw = random.Random(6)
    for _ in range(60):
        hurt = bytearray(data)
        for _ in range(draw.randint(1, 5)):
            hurt[draw.randrange(len(hurt))] = draw.randrange(256)
        found = warc.scan(bytes(hurt))
        spans = sorted([(a, b) for a, b, _ in found.records] + found.gaps)
        assert [a for a, _ in spans] == [0, *[b for _, b in spans[:-1]]] and spans[-1][1] == len(hurt)


def test_files_of_lost_attempts_are_not_read(spark, tmp_path):
    folder = scratch_path(spark, "warc-test")
    manifest = warc.write_archives(pages_of(spark, PAGES), folder)
    import glob
    import shutil

    one = glob.glob(f"{folder.removeprefix('file://')}/*.warc.gz")[0]
    shutil.copy(one, one.replace(".warc.gz", "-again.warc.gz"))
    assert warc.read_archives(manifest, folder).count() == len(PAGES)


def test_pipeline_keeps_columns_and_counts(documents, labels, spark, tmp_path):
    rows, marks = labelled(300)
    rows += [(1000 + i, text) for i, (_, text) in enumerate(rows[1:4])] + ODD
    folder = str(tmp_path)
    documents(rows).write.parquet(f"{folder}/documents.parquet")
    labels(marks).write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    ids = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, folder)
        assert after.columns == docs.columns, name
        docs = spark.createDataFrame(after.collect(), docs.schema)
        ids.append({r.doc_id for r in docs.select("doc_id").collect()})
    toxic = {m[0] for m in marks if m[2]}
    low = {m[0] for m in marks if not m[1]}
    assert len(ids[0] & toxic) <= 2 and len({m[0] for m in marks} - toxic - ids[0]) <= 2
    assert len(ids[1] & low) <= 2 and len(ids[0] - low - ids[1]) <= 4
    assert not ids[2] & {1000, 1001, 1002}
    assert len(corpus_pipeline.STAGES) == 5
    packed = corpus_pipeline.run(spark, folder)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == ids[3]
