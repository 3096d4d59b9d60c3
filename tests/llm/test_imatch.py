"""I-Match fingerprints: odd tables, order of documents, and what likeness tells."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from shelfindex.llm import imatch

LONG = "many words here " * 20_000


def prose(draw, n):
    return " ".join(f"w{draw.randint(0, 300)}" for _ in range(n))


def expected(rows):
    """doc_id, n_chars and digest of the edited text, by a plain loop."""
    texts = [(i, t or "") for i, t in rows]
    texts.sort(key=lambda r: (r[0] is None, -(r[0] or 0), hashlib.md5(r[1].encode()).hexdigest()))
    out = []
    for at, (doc_id, text) in enumerate(texts):
        following = texts[(at + 1) % len(texts)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    rows = imatch.fingerprinted(df).collect()
    return rows, sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in rows), key=str)


def test_odd_documents(spark, documents):
    draw = random.Random(1)
    rows = [(None, "no id"), (None, None), (-5, "minus \U0001f600 \U0001f600\U0001f600"), (7, ""), (7, ""),
            (7, "seven"), (2**62, "far"), (8, LONG), (9, "same text"), (10, "same text")]
    rows += [(100 + i, prose(draw, 30)) for i in range(40)]
    odd = documents(rows).withColumn("range", F.lit(1)).withColumn("term", F.lit("x"))
    out, plain = found(odd)
    assert plain == expected(rows)
    by_text = {}
    for r in out:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        by_text.setdefault((r.doc_id, r.n_chars), set()).add(tuple(r.fingerprint))
    assert by_text[9, 9] == by_text[10, 9] and len(by_text[7, 0]) == 1
    assert found(odd.limit(0))[0] == []
    alone, plain = found(documents([(1, "only one")]))
    assert plain == expected([(1, "only one")]) and alone[0].near_next == 1


def test_an_id_that_most_rows_share(spark, documents):
    rows = [(5, f"text {i} of many") for i in range(400)] + [(i, "x" * i) for i in range(100)]
    assert found(documents(rows))[1] == expected(rows)


def test_hashes_equal_those_of_a_plain_loop(spark, documents):
    draw = random.Random(2)
    rows = [(i, prose(draw, draw.randint(0, 60))) for i in range(150)]
    counts = {}
    for _, text in rows:
        for term in set(re.findall(r"[^\W_]+", text)):
            counts[term] = counts.get(term, 0) + 1
    known = {t for t, n in counts.items() if 2 <= n <= max(2, imatch.COMMONEST * len(rows))}
    for r in imatch.fingerprinted(documents(rows)).collect():
        text = dict(rows)[r.doc_id]
        terms = sorted(known.intersection(text.split()))
        hashes = []
        for series, bits in [(None, 0)] + [(s, b) for s in range(imatch.SERIES) for b in imatch.HALVINGS]:
            member = [
                t for t in terms
                if series is None
                or int(hashlib.md5(t.encode()).hexdigest()[4 * series :][:4], 16) < 1 << (16 - bits)
            ]
            hashes.append(hashlib.md5(" ".join(member).encode()).hexdigest()[:8] if member else "")
        if not terms:
            hashes[0] = "~" + hashlib.md5(text.encode()).hexdigest()[:8]
        assert r.fingerprint == hashes


def test_edits_keep_more_likeness_than_strangers(spark, documents):
    draw = random.Random(3)
    rows = [(i, " ".join(f"w{draw.randint(0, 3000)}" for _ in range(300))) for i in range(200)]
    mean = imatch.fingerprinted(documents(rows)).agg(F.avg("near_edited"), F.avg("near_next")).first()
    assert mean[0] > 3 * mean[1]
