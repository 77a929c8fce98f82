"""The registered queries: their names, their columns and their SQL."""

import sys

import pytest

import __spark_entry__ as entry
from llm_helpers import SF
from folioflow.llm.queries import ORACLE, QUERIES

sys.path.insert(0, "tools")

COLUMNS = {
    "op1_imatch_fingerprints": {"doc_id": "bigint", "n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"},
    "op2_benchmark_leaks": {"doc_id": "bigint", "item_id": "bigint", "edits": "int"},
    "op3_rendezvous_shards": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op4_simhash_components": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op5_secret_scan": {"doc_id": "bigint", "probability": "double", "is_secret": "boolean"},
    "op6_language": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op7_warc_derivatives": {"page_id": "bigint", "record_type": "string", "refers_to": "string"},
    "op8_repeated_passages": {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"},
    "op9_bpe_round_trip": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op10_personal_data": {"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string"},
    "op12_merkle_manifest": {"doc_id": "bigint", "leaf": "string", "subroot": "string", "root": "string", "proof_sha256": "string", "folded_root": "string", "verified": "boolean"},
    "op13_tokenizer_alignment": {c: "bigint" for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")} | {"groups_sha256": "string"},
    "op11_distinct_word_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query(spark, name):
    frame = entry.queries()[name](spark, SF)
    kinds = dict(frame.dtypes)
    assert {c: kinds.get(c) for c in COLUMNS[name]} == COLUMNS[name]
    whole = {"op1", "op3", "op4", "op6", "op8", "op9", "op10", "op11", "op12", "op13"}
    n = frame.count()
    assert n == 200 if name.split("_")[0] in whole else n > 0


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_agrees_with_its_sql(spark, name):
    from check_oracle import canonical, connect

    got = QUERIES[name](spark, SF).toPandas()
    assert canonical(got) == canonical(connect(SF).sql(ORACLE[name]).df())


def test_all_are_registered():
    assert set(COLUMNS) == set(QUERIES) and {*QUERIES, "pipeline"} <= set(entry.queries())
