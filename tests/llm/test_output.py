import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from llm_common import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from meridia.llm.token_output import WordEncoder, by_bytes, canonical_codes, code_lengths, decode_runs, decode_table, encode_ids, token_report

PATH = str(public_tokenizers.path("word_bpe_49k.json"))


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.mark.parametrize("which", ["awkward", "sf_docs"])
def test_report_equals_direct_encoding(which, request):
    docs = request.getfixturevalue(which)
    t = tokenizer()
    want, start = [], 0
    texts = [(r["doc_id"], t.encode(r["text"] or "", add_special_tokens=False).ids + [1]) for r in docs.collect()]
    for doc_id, ids in sorted(texts, key=lambda x: (x[0] is None, x[0] or 0, len(x[1]))):
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = rows(token_report(docs, PATH))
    assert sorted(got, key=lambda x: x[1]) == want


def test_report_of_empty_table(empty):
    assert token_report(empty, PATH).collect() == []


@settings(max_examples=2000, deadline=None)
@given(st.text(max_size=60))
def test_words_encode_as_whole_texts(text):
    text = text.encode("utf-8", "ignore").decode()
    global _encoder
    try:
        encoder, t = _encoder
    except NameError:
        encoder, t = _encoder = WordEncoder(PATH), tokenizer()
    texts = [text, None, "", text.title(), f"{text} {text}"]
    got = [x for part in encoder(pa.array(texts), 1, rows=2) for x in part.to_pylist()]
    assert encoder.by_word and [np.frombuffer(x, encoder.kind).tolist() for x in got] == [t.encode(x or "", add_special_tokens=False).ids + [1] for x in texts]


def test_other_vocabularies_encode_whole_texts():
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    encoder, t, texts = WordEncoder(path), Tokenizer.from_file(path), ["a  b\n\nc d's", None, " x"]
    got = [np.frombuffer(x, encoder.kind).tolist() for part in encoder(pa.array(texts), 1) for x in part.to_pylist()]
    assert not encoder.by_word and got == [t.encode(x or "", add_special_tokens=False).ids + [1] for x in texts]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.lists(st.one_of(st.none(), st.text(max_size=30)), max_size=8), max_size=6), st.integers(1, 40))
def test_pieces_by_bytes_hold_all_rows(batches, most):
    made = [pa.RecordBatch.from_arrays([pa.array(b, pa.string())], names=["t"]) for b in batches]
    out = [p.column(0).to_pylist() for p in by_bytes(iter(made), 0, most)]
    assert [x for p in out for x in p] == [x for b in batches for x in b]
    size = lambda p: sum(len((x or "").encode()) for x in p)
    assert all(size(p[:-1]) <= most for p in out)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=3000), st.integers(9, 16))
def test_codes_round_trip(ids, bits):
    ids = np.array(ids, np.int64)
    counts = np.bincount(ids, minlength=301)
    lengths = code_lengths(counts, bits)
    assert lengths.max(initial=0) <= bits and sum(2.0 ** -int(x) for x in lengths if x) <= 1
    packed, marks = encode_ids(ids, canonical_codes(lengths), lengths)
    runs = np.minimum(256, len(ids) - 256 * np.arange(len(marks)))
    assert decode_runs(packed, marks, runs.astype(np.int64), decode_table(lengths, bits), bits).tolist() == ids.tolist()


def test_lengths_are_optimal_and_limited():
    import heapq

    counts = np.array([1, 1, 2, 3, 5, 8, 13, 21, 34, 55, 89])
    heap = [(c, 0) for c in counts.tolist()]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        cost += a[0] + b[0]
        heapq.heappush(heap, (a[0] + b[0], 0))
    assert int((code_lengths(counts, 16) * counts).sum()) == cost
    assert code_lengths(counts, 4).max() == 4
    with pytest.raises(ValueError):
        code_lengths(np.ones(17, np.int64), 4)
