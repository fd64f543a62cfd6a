import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tracequery.llm import token_output as t

PATH = public_tokenizers.path("word_bpe_49k.json")


@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=900))
@settings(max_examples=60, deadline=None)
def test_code_round_trip_and_random_access(ids):
    reader = t.DacReader(t.dac_encode(np.array(ids, dtype=np.uint32)))
    assert reader.decode().tolist() == ids
    assert [reader[i] for i in range(len(ids))] == ids


def test_positions_outside_are_errors():
    reader = t.DacReader(t.dac_encode(np.array([1, 2], dtype=np.uint32)))
    with pytest.raises(IndexError):
        reader[2]
    with pytest.raises(ValueError):
        t.DacReader(b"nope" + bytes(8))


ENCODERS = {}


@given(st.lists(st.text(st.characters(codec="utf-8"), max_size=60), max_size=8))
@settings(max_examples=80, deadline=None)
def test_cached_words_give_the_library_s_ids(texts):
    enc = t.SharedEncoder(open(PATH, encoding="utf-8").read()).get()
    for text, got in zip(texts, enc.encode(texts)):
        assert got.tolist() == enc.tok.encode(text, add_special_tokens=False).ids


@given(st.lists(st.text(st.sampled_from("aZé1_'s,.!|<>\u0301 \n\t\xa0İ"), max_size=30), max_size=8))
@settings(max_examples=300, deadline=None)
def test_marks_and_case_give_the_library_s_ids(texts):
    enc = ENCODERS.setdefault(0, t.SharedEncoder(open(PATH, encoding="utf-8").read())).get()
    texts += ["<|ENDOFTEXT|> a", "<|endoftext|>,", "end,", "end,\n"]
    assert enc.lowers and enc.cuts
    for text, got in zip(texts, enc.encode(texts)):
        assert got.tolist() == enc.tok.encode(text, add_special_tokens=False).ids, text


def brute(rows):
    tok = Tokenizer.from_file(PATH)
    out, at = [], 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        out.append((doc, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_digest_of_awkward_documents(awkward):
    got = [tuple(r) for r in t.token_output(awkward, PATH).orderBy("start").collect()]
    assert got == brute([(r.doc_id, r.text) for r in awkward.collect()])


def test_digest_of_sample_documents_over_small_shards(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(5)
    path = str(tmp_path / "tokens")
    t.write_tokens(docs, path, PATH, shard_tokens=3000)
    got = [tuple(r) for r in t.token_digest(spark, path).orderBy("start").collect()]
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_empty_table(no_docs):
    assert t.token_output(no_docs, PATH).collect() == []
