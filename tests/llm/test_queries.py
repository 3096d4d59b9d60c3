"""The registered corpus queries: against SQL where there is any, and the shape of the plans."""

import pytest

from checks.compare import compare, connect
from shelfindex.llm.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
SHAPES = {
    "op1_multi_index_hashing": "query_id bigint, rank int, vec_id bigint, score double",
    "op3_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op4_vector_bin_packing": "doc_id bigint, size bigint, text_crc32 bigint, law string, "
    "shard int, slot bigint, grown_shard int",
    "op5_vector_approximation": "query_id bigint, rank int, vec_id bigint, score bigint",
    "op6_best_fit_packing": "doc_id bigint, piece int, start bigint, length bigint, "
    "ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op9_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op10_warc": "page_id bigint, payload_bytes bigint, payload_digest string, "
    "record_type string, refers_to bigint",
    "op11_prefix_trie": "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, "
    "n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string",
    "op12_i_match": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, "
    "edited_fingerprint string, near_edited double, near_next double",
    "op13_periodic_runs": "doc_id bigint, n_runs bigint, start bigint, length bigint, "
    "period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string",
}


@pytest.mark.parametrize("name", list(SQL))
def test_against_sql(spark, name):
    problem, rows = compare(spark, connect(FOLDER), FOLDER, QUERIES[name], SQL[name])
    assert problem is None and rows > 0


@pytest.mark.parametrize("name", list(SHAPES))
def test_contract_columns(spark, name):
    found = QUERIES[name](spark, FOLDER)
    assert ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema) == SHAPES[name]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
