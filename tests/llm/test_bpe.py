import hashlib
import struct

import numpy as np
import tiktoken

from tests.llm.conftest import ODD
from tidemark.llm import bpe, chunks


def expected(encoding, text):
    ids = encoding.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def reference():
    ranks, pattern = bpe.public_ranks()
    return ranks, pattern, tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def test_same_ids_as_the_library_and_round_trip(docs, texts):
    ranks, pattern, encoding = reference()
    rows = bpe.round_trip(docs, ranks, pattern).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == expected(encoding, texts[r.doc_id])


def test_odd_texts(odd_docs):
    ranks, pattern, encoding = reference()
    rows = bpe.round_trip(odd_docs, ranks, pattern).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        if r.doc_id is not None and r.doc_id < len(ODD):
            assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == expected(encoding, ODD[r.doc_id])


def test_empty_table(no_docs):
    ranks, pattern, _ = reference()
    assert bpe.round_trip(no_docs, ranks, pattern).count() == 0


def test_packing():
    rng = np.random.default_rng(0)
    for values in (rng.zipf(1.2, 5000) % 3_000_000, np.zeros(0, np.int64), np.array([0, 191, 192, 12479, 12480, 2**32 - 1])):
        values = values.astype(np.uint32)
        assert (chunks.unpack_ranks(chunks.pack_ranks(values)) == values).all()
        assert (chunks.unpack_rising(chunks.pack_rising(np.sort(values)), np.uint32) == np.sort(values)).all()
    assert chunks.unpack_strings(chunks.pack_strings([b"", b"a\x00", b"bc"])) == [b"", b"a\x00", b"bc"]
    assert chunks.unpack_ids(chunks.pack_ids([None, 3, -1]), 3) == [None, 3, -1]
    assert chunks.split_blobs(chunks.join_blobs([b"x", b"", b"yz"])) == [b"x", b"", b"yz"]
