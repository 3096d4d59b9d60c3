"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfindex.llm import (
    ann, exact_search, imatch, jaccard, mixing, packing, periodic_runs, prefix_trie, quality, sharding,
    token_counts, toxicity, warc,
)

WORD_VOCABULARY = "word_bpe_49k.json"
PIECE_VOCABULARY = "piece_bpe_32k.model"
MIX = {"en": 0.5, "fr": 0.2, "de": 0.2, "es": 0.1}
NEIGHBOURS, PRODUCTS, SHARDS = 5, 10, 8


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_multi_index_hashing(spark: SparkSession, folder: str) -> DataFrame:
    embeddings = table(spark, folder, "embeddings")
    return ann.nearest_neighbours(embeddings, F.col("vec_id") % 50 == 0, NEIGHBOURS)


def op2_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with the class that links tie them into and the text they are a copy of."""
    found = jaccard.joined(table(spark, folder, "documents"))
    return found.select(
        "doc_id", F.col("group_id").alias("class_id"), "links",
        F.col("class_id").alias("text_id"), "keep",
    )


def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.scored(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op4_vector_bin_packing(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.sharded(table(spark, folder, "documents"), SHARDS)


def op5_vector_approximation(spark: SparkSession, folder: str) -> DataFrame:
    embeddings = table(spark, folder, "embeddings")
    return exact_search.top_products(embeddings, F.col("vec_id") % 100 == 0, PRODUCTS)


def op6_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    vocabulary = public_tokenizers.path(WORD_VOCABULARY)
    return packing.packed(table(spark, folder, "documents"), vocabulary)


def op7_soft_membership_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.rated(table(spark, folder, "documents"), MIX)


def op8_trie_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    vocabulary = public_tokenizers.path(PIECE_VOCABULARY)
    return token_counts.counted(table(spark, folder, "documents"), vocabulary)


def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.scored(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op10_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Records of pages as read back; a gap in an archive just written is an error, not a row less."""
    found = warc.archived(table(spark, folder, "pages"))
    whole = F.when(F.col("kind") != "gap", F.col("kind")).otherwise(
        F.raise_error(F.lit("an archive came back damaged: pages are missing from it"))
    )
    return found.select(
        "page_id", "payload_bytes", "payload_digest", whole.alias("record_type"), "refers_to"
    )


OPENING = 20  # conversations whose first turns may come from the first of them


def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    """The trie of the conversations, each begun with some turns of the first one of its twenty."""
    own = prefix_trie.sequences(table(spark, folder, "conversations"))
    opening = own.filter(F.col("conv_id") % OPENING == 0).select(
        F.col("conv_id").alias("opening_id"), F.slice("turns", 1, 3).alias("opening")
    )
    borrowed = (F.crc32(F.col("conv_id").cast("string")) % 4).cast("int")
    none = F.array().cast(own.schema["turns"].dataType)
    joined = own.withColumn("h", borrowed).join(
        opening, F.col("conv_id") - F.col("conv_id") % OPENING == F.col("opening_id"), "left"
    )
    rebuilt = joined.select(
        "conv_id",
        F.concat(
            F.slice(F.coalesce("opening", none), F.lit(1), F.col("h")),
            F.slice("turns", F.col("h") + 1, F.size("turns")),
        ).alias("turns"),
    )
    return prefix_trie.trie(rebuilt)


def op12_i_match(spark: SparkSession, folder: str) -> DataFrame:
    return imatch.fingerprinted(table(spark, folder, "documents")).select(
        "doc_id", "n_chars", "edited_sha256",
        F.array_join("fingerprint", ".").alias("fingerprint"),
        F.array_join("edited", ".").alias("edited_fingerprint"),
        "near_edited", "near_next",
    )


SPACED_WORDS = r"[^\x20\x09-\x0D]+"


def made_periodic(doc_id: Column, text: Column) -> Column:
    """The text; for one id in ten, from some word on, the words from there again and again."""
    hashed = F.crc32(doc_id.cast("string"))
    turned = F.floor(hashed / 10)
    words = F.regexp_extract_all(text, F.lit(SPACED_WORDS), F.lit(0))
    n = F.size(words)
    start = (turned % F.nullif(n, F.lit(0))).cast("int")
    period = (1 + F.floor((n - start) / (3 + turned % 8))).cast("int")
    cycle = F.slice(words, start + 1, period)
    cycles = F.flatten(F.array_repeat(cycle, F.ceil((n - start) / period).cast("int")))
    whole = F.concat(
        F.when(start > 0, F.slice(words, F.lit(1), start)).otherwise(F.array().cast("array<string>")),
        F.slice(cycles, F.lit(1), n - start),
    )
    return F.when((hashed % 10 == 0) & (n > 0), F.array_join(whole, " ")).otherwise(text)


def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select(
        "doc_id", made_periodic(F.col("doc_id"), F.col("text")).alias("text")
    )
    best = F.array_max(
        F.transform(
            "runs",
            lambda run: F.struct(
                (run["length"] / run["period"]).alias("times"),
                (-run["start"]).alias("start"),
                (-run["period"]).alias("period"),
                run["length"].alias("length"),
            ),
        )
    )
    lines = F.transform(
        "runs",
        lambda run: F.concat(F.concat_ws(",", run["start"], run["length"], run["period"]), F.lit("\n")),
    )
    return (
        periodic_runs.with_runs(documents)
        .withColumn("best", best)
        .select(
            "doc_id",
            F.size("runs").cast("long").alias("n_runs"),
            (-F.col("best.start")).alias("start"),
            F.col("best.length").alias("length"),
            (-F.col("best.period")).alias("period"),
            F.expr("(1000 * best.length) div -best.period").alias("exponent_milli"),
            F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
            F.sha2("collapsed", 256).alias("collapsed_sha256"),
        )
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_multi_index_hashing": op1_multi_index_hashing,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_toxicity": op3_toxicity,
    "op4_vector_bin_packing": op4_vector_bin_packing,
    "op5_vector_approximation": op5_vector_approximation,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_soft_membership_mixing": op7_soft_membership_mixing,
    "op8_trie_token_counts": op8_trie_token_counts,
    "op9_quality": op9_quality,
    "op10_warc": op10_warc,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_i_match": op12_i_match,
    "op13_periodic_runs": op13_periodic_runs,
}

# crc32 of a decimal number: the table of its 256 steps, then one step a digit.
CRC_STEPS = """
crc_steps AS (
    SELECT list(step ORDER BY i) AS steps
    FROM (SELECT i, list_reduce([i] || range(8), lambda c, k:
            CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS step
          FROM range(256) bytes(i))
)"""


def crc_sql(number: str) -> str:
    return f"""xor(4294967295, list_reduce(
        [4294967295] || [ord(x) FOR x IN string_split(({number})::VARCHAR, '')],
        lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])))"""


SQL: dict[str, str] = {
    "op2_ngram_jaccard_join": f"""
WITH RECURSIVE worded AS (
    SELECT doc_id,
        [w FOR w IN regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+')
            IF w <> ''] AS words
    FROM documents
),
shingled AS (
    SELECT doc_id, list_sort(list_distinct([
        array_to_string(words[i : i + {jaccard.WORDS - 1}], ' ')
        FOR i IN range(1, greatest(2, len(words) - {jaccard.WORDS - 2}))])) AS grams
    FROM worded WHERE len(words) > 0
),
classed AS (
    SELECT doc_id, grams, min(doc_id) OVER (PARTITION BY grams) AS class_id FROM shingled
),
spread AS (
    SELECT class_id, len(grams) AS n, unnest(grams) AS gram FROM classed WHERE doc_id = class_id
),
linked AS (
    SELECT a.class_id AS a, b.class_id AS b
    FROM spread a JOIN spread b ON a.gram = b.gram AND a.class_id <> b.class_id
    GROUP BY a.class_id, b.class_id, a.n, b.n
    HAVING count(*) >= {jaccard.THRESHOLD} * (a.n + b.n - count(*)) - 1e-9
),
reach AS (
    SELECT a, b FROM linked
    UNION
    SELECT reach.a, linked.b FROM reach JOIN linked ON reach.b = linked.a
),
grouped AS (SELECT a, min(b) AS least FROM reach GROUP BY a),
counted AS (SELECT a, count(*) AS links FROM linked GROUP BY a),
described AS (
    SELECT d.doc_id, coalesce(c.class_id, d.doc_id) AS class_id
    FROM documents d LEFT JOIN classed c ON d.doc_id = c.doc_id
)
SELECT doc_id, least(described.class_id, coalesce(least, described.class_id)) AS class_id,
    coalesce(links, 0)::BIGINT AS links, described.class_id AS text_id,
    doc_id = least(described.class_id, coalesce(least, described.class_id)) AS keep
FROM described
LEFT JOIN counted ON counted.a = described.class_id
LEFT JOIN grouped ON grouped.a = described.class_id
""",
    "op5_vector_approximation": f"""
WITH whole AS (
    SELECT row_number() OVER () AS r, vec_id,
        [floor(1024 * CAST(x AS DOUBLE))::BIGINT FOR x IN embedding] AS v
    FROM embeddings
    WHERE len(embedding) > 0
      AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
),
scored AS (
    SELECT q.r, q.vec_id AS query_id, b.vec_id,
        list_sum([p[1] * p[2] FOR p IN list_zip(q.v, b.v)])::BIGINT AS score
    FROM whole q JOIN whole b ON q.r <> b.r AND len(q.v) = len(b.v)
    WHERE q.vec_id % 100 = 0
),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS place
    FROM scored
)
SELECT query_id, place::INTEGER AS rank, vec_id, score FROM ranked WHERE place <= {PRODUCTS}
""",
    "op10_warc": f"""
WITH payloads AS (
    SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes,
        sha256(coalesce(html, '')) AS payload_digest
    FROM pages
),
firsts AS (
    SELECT payload_digest, min(page_id) AS first_id FROM payloads GROUP BY payload_digest
),
typed AS (
    SELECT p.*, CASE WHEN payload_bytes >= {warc.REVISIT_BYTES} AND page_id <> first_id
        THEN first_id END AS refers_to
    FROM payloads p JOIN firsts USING (payload_digest)
)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to
FROM typed
""",
    "op11_prefix_trie": f"""
WITH {CRC_STEPS},
turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
    FROM conversations WHERE conv_id IS NOT NULL
),
numbered AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
        sha256(length(role) || ':' || role || text)) AS place
    FROM turns
),
lent AS (
    SELECT conv_id, {crc_sql("conv_id")} % 4 AS h
    FROM (SELECT DISTINCT conv_id FROM turns), crc_steps
),
rebuilt AS (
    SELECT lent.conv_id, place, role, text
    FROM lent JOIN numbered ON numbered.conv_id = lent.conv_id - lent.conv_id % {OPENING} AND place <= h
    UNION ALL
    SELECT conv_id, place, role, text FROM lent JOIN numbered USING (conv_id) WHERE place > h
),
whole AS (
    SELECT conv_id, coalesce(list({{'role': role, 'text': text}} ORDER BY place)
        FILTER (WHERE place IS NOT NULL), []) AS turns
    FROM lent LEFT JOIN rebuilt USING (conv_id) GROUP BY conv_id
),
prefixes AS (
    SELECT conv_id, len(turns) AS n, unnest(range(len(turns) + 1)) AS depth, turns FROM whole
),
nodes AS (
    SELECT turns[1:depth] AS prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = depth), ''))
            AS ends_sha256
    FROM prefixes GROUP BY ALL
),
children AS (
    SELECT prefix[1:depth - 1] AS above, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL
),
counted AS (
    SELECT nodes.*, coalesce(n_children, 0) AS n_children,
        CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1)
            * len(regexp_extract_all(prefix[-1].text, '{SPACED_WORDS}')) END AS saved
    FROM nodes LEFT JOIN children ON prefix = above
),
below AS (
    SELECT prefix[1:upto] AS top, sum(saved) AS saved_tokens,
        count(*) FILTER (WHERE n_children = 0) AS n_leaves
    FROM (SELECT *, unnest(range(depth + 1)) AS upto FROM counted) GROUP BY ALL
)
SELECT n.conv_id, n.depth, above.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves,
    saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM counted n
JOIN below ON top = n.prefix
LEFT JOIN nodes above ON n.depth > 0 AND above.prefix = n.prefix[1:n.depth - 1]
""",
    "op12_i_match": f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
ordered AS (
    SELECT *, row_number() OVER (ORDER BY doc_id DESC NULLS LAST, md5(text)) AS place FROM texts
),
edits AS (
    SELECT o.place, o.doc_id, o.text, n.text AS next_text,
        left(o.text, length(o.text) - length(o.text) // 2) || left(n.text, length(o.text) // 2)
            AS edited
    FROM ordered o JOIN ordered n
        ON n.place = CASE WHEN o.place = (SELECT max(place) FROM ordered) THEN 1 ELSE o.place + 1 END
),
lexicon AS (
    SELECT term FROM (
        SELECT unnest(list_distinct(regexp_extract_all(lower(text), '{imatch.TERM}'))) AS term FROM texts
    ) GROUP BY term
    HAVING count(*) BETWEEN greatest({imatch.LEAST}, (SELECT count(*) FROM texts) * {imatch.RAREST!r})
        AND greatest({imatch.LEAST}, (SELECT count(*) FROM texts) * {imatch.COMMONEST!r})
),
versions AS (
    SELECT DISTINCT text AS version FROM texts UNION SELECT edited FROM edits
),
held AS (
    SELECT version, term
    FROM (SELECT version, unnest(list_distinct(regexp_extract_all(lower(version), '{imatch.TERM}'))) AS term
          FROM versions) JOIN lexicon USING (term)
),
subsets AS (
    SELECT 0 AS subset, NULL AS series, NULL AS bits
    UNION ALL
    SELECT 1 + {len(imatch.HALVINGS)} * series + step - 1, series, {list(imatch.HALVINGS)}[step]
    FROM range({imatch.SERIES}) a(series), range(1, {len(imatch.HALVINGS) + 1}) b(step)
),
hashed AS (
    SELECT version, subset, left(md5(string_agg(term, ' ' ORDER BY term)), 8) AS hash
    FROM held JOIN subsets
        ON bits IS NULL OR ('0x' || substr(md5(term), 4 * series + 1, 4))::INTEGER < (1 << (16 - bits))
    GROUP BY version, subset
),
printed AS (
    SELECT version, list(coalesce(hash,
        CASE WHEN subset = 0 THEN '~' || left(md5(version), 8) ELSE '' END) ORDER BY subset) AS hashes
    FROM versions CROSS JOIN subsets LEFT JOIN hashed USING (version, subset)
    GROUP BY version
),
compared AS (
    SELECT e.*, own.hashes AS a, edited_one.hashes AS b, next_one.hashes AS c
    FROM edits e
    JOIN printed own ON own.version = e.text
    JOIN printed edited_one ON edited_one.version = e.edited
    JOIN printed next_one ON next_one.version = e.next_text
)
SELECT doc_id, length(text)::BIGINT AS n_chars, sha256(edited) AS edited_sha256,
    array_to_string(a, '.') AS fingerprint, array_to_string(b, '.') AS edited_fingerprint,
    len([p FOR p IN list_zip(a, b) IF p[1] <> '' AND p[1] = p[2]])
        / len([p FOR p IN list_zip(a, b) IF p[1] <> '' OR p[2] <> '']) AS near_edited,
    len([p FOR p IN list_zip(a, c) IF p[1] <> '' AND p[1] = p[2]])
        / len([p FOR p IN list_zip(a, c) IF p[1] <> '' OR p[2] <> '']) AS near_next
FROM compared
""",
    "op13_periodic_runs": f"""
WITH {CRC_STEPS},
worded AS (
    SELECT doc_id, {crc_sql("doc_id")} AS h,
        regexp_extract_all(coalesce(text, ''), '{SPACED_WORDS}') AS own
    FROM documents, crc_steps
),
shaped AS (
    SELECT *, CASE WHEN h % 10 = 0 THEN (h // 10) % nullif(len(own), 0) ELSE len(own) END AS a
    FROM worded
),
placed AS (
    SELECT doc_id, own, a, 1 + (len(own) - a) // (3 + (h // 10) % 8) AS p,
        unnest(range(len(own))) AS i
    FROM shaped
),
words AS (
    SELECT doc_id, i, own[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1] AS word,
        len(own) AS n
    FROM placed
),
alike AS (
    SELECT x.doc_id, x.i, y.i - x.i AS q
    FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.word = y.word AND x.i < y.i
    WHERE 4 * (y.i - x.i) <= x.n
),
stretches AS (
    SELECT doc_id, q, min(i) AS start, count(*) + q AS length
    FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM alike)
    GROUP BY doc_id, q, island
    HAVING count(*) + q >= greatest(6, 4 * q)
),
runs AS (
    SELECT doc_id, start, length, min(q) AS period FROM stretches GROUP BY doc_id, start, length
),
listed AS (
    SELECT doc_id, count(*) AS n_runs,
        first({{'start': start, 'length': length, 'period': period}}
              ORDER BY length / period DESC, start, period) AS best,
        string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period)
            AS lines
    FROM runs GROUP BY doc_id
),
stays AS (
    SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS collapsed
    FROM words
    WHERE NOT EXISTS (
        SELECT 1 FROM runs
        WHERE runs.doc_id = words.doc_id AND i >= start + period AND i < start + length)
    GROUP BY doc_id
)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.start AS start, best.length AS length,
    best.period AS period, (1000 * best.length) // best.period AS exponent_milli,
    sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM documents LEFT JOIN listed USING (doc_id) LEFT JOIN stays USING (doc_id)
""",
}
