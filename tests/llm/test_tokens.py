import base64
import time

import pyarrow.parquet as pq
import public_tokenizers
import pytest

from kernelweave.llm.tokens import Encoder, PerfectHash, load_vocabulary


def _entries():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        return {base64.b64decode(t): int(r) for t, r in (line.split() for line in lines if line.strip())}


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 100])
def test_small_tables_are_filled(n):
    entries = {bytes([k, k ^ 7]): k for k in range(n)}
    table = PerfectHash.build(entries)
    assert all(table.get(k) == v for k, v in entries.items()) and table.get(b"no such key") == -1


def test_the_real_vocabulary_is_built_and_encodes_as_the_public_tokenizer():
    import tiktoken

    entries = _entries()
    began = time.time()
    table = load_vocabulary()
    assert time.time() - began < 60
    assert len(table.keys) == len(entries) and all(table.get(k) == v for k, v in entries.items())
    public = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=entries, special_tokens={})
    encoder = Encoder(table, public_tokenizers.PATTERN)
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column(0).to_pylist()
    for text in [*texts, "", None, "<|endoftext|> a  b\r\n", "x" * 500]:
        assert encoder.encode(text) == (public.encode_ordinary(text) if text else [])


def test_p8_ids_has_one_row_per_document(spark):
    from __spark_entry__ import queries

    d = "/root/testdata/sf0.001"
    got = {r.doc_id: r.ids for r in queries()["p8_ids"](spark, d).collect()}
    rows = pq.read_table(f"{d}/documents.parquet").to_pylist()
    assert got.keys() == {r["doc_id"] for r in rows} and all(got[r["doc_id"]] == [] for r in rows if not r["text"])
