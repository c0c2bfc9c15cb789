"""Every registered query of the subpackage on the smallest tables: its columns, its rows and what SQL or plain Python
can say of them."""

import hashlib
import re
import zlib

import pytest

from citeplane.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_syncmers": {"doc_id": "bigint", "n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"},
    "op2_mixing": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op3_quality": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op4_media": {"doc_id": "bigint", "n_bytes": "bigint", "payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint", "media_bytes": "bigint", "media_sha256": "string", "feature": "string"},
    "op5_suffix_dedup": {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"},
    "op6_pii": {"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string"},
    "op7_langid": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op8_jaccard": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
    "op9_word_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op10_token_counts": {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"},
}


@pytest.fixture(scope="module")
def texts(documents):
    return {r["doc_id"]: r["text"] or "" for r in documents.collect()}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query(spark, texts, name):
    df = QUERIES[name](spark, SMALL)
    types = dict(df.dtypes)
    assert {c: types.get(c) for c in COLUMNS[name]} == COLUMNS[name]
    rows = {r["doc_id"]: r.asDict() for r in df.collect()}
    assert set(rows) == set(texts)
    for doc, r in rows.items():
        raw = texts[doc].encode()
        assert all(r[c] is not None for c in COLUMNS[name])
        if "held_out" in r:
            assert r["held_out"] == (zlib.crc32(str(doc).encode()) % 3 == 1) and 0 <= r["score"] <= 1
        if "n_bytes" in r:
            assert r["n_bytes"] == len(raw)
        if name == "op2_mixing":
            assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", texts[doc])) and 0 <= r["taken"] <= 2 * r["size"]
        if name == "op3_quality":
            assert r["predicted"] == (r["score"] >= 0.5)
        if name == "op4_media":
            payload = raw + b" " * (-len(raw) % 192 if raw else 192)
            assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        if name == "op5_suffix_dedup" and not r["n_removed"]:
            assert (r["n_spans"], r["kept_sha256"]) == (0, hashlib.sha256(raw).hexdigest())
        if name == "op8_jaccard":
            assert r["component_id"] <= doc and rows[r["component_id"]]["component_id"] == r["component_id"]
        if name == "op10_token_counts":
            assert r["over_limit"] == (r["n_tokens"] > 4096)


def test_all_are_here():
    assert set(COLUMNS) == set(QUERIES)
