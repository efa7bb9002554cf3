"""Token ids against the public library, and exact round trips."""

import base64

import pyarrow.parquet as pq
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import encoding as E

RAW = open(f"{E.VOCABULARIES}/byte_bpe_50k.tiktoken", "rb").read()
OURS = E.ByteBpe(RAW)
THEIRS = tiktoken.Encoding("own", pat_str=E.PATTERN, mergeable_ranks=OURS.ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80) | st.text("abcdef ' \n0123éß中文ไทยहि", max_size=120))
def test_equals_the_library(text):
    ids = OURS.encode_batch([text])[0]
    assert ids == THEIRS.encode_ordinary(text)
    assert b"".join(OURS.bytes_of[i] for i in ids) == text.encode()


def test_every_pair_check_is_exact():
    for word in ("tokenization", "antidisestablishmentarianism", "ababababab", "    \n\n\n"):
        b = word.encode()
        assert OURS.exact(b) == OURS._exact_long(b)
    long = "ab" * 400 + "xyz" * 300
    assert OURS.encode_batch([long])[0] == THEIRS.encode_ordinary(long)


def test_frames(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    table = pq.read_table(f"{data}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    want = {r["doc_id"]: THEIRS.encode_ordinary(r["text"] or "") for r in table}
    assert {r.doc_id: r.ids for r in E.ids(docs).collect()} == want
    assert {r.doc_id: r.n_tokens for r in E.sizes(docs).collect()} == {k: len(v) for k, v in want.items()}
    odd = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "<|endoftext|>", 0)], "doc_id bigint, text string, ids int")
    got = {r.doc_id: r.ids for r in E.ids(odd).collect()}
    assert got[1] == [] and got[2] == [] and 50256 not in got[3]
    assert E.ids(odd.limit(0)).count() == 0
    multi = E.ByteBpe(open(f"{E.VOCABULARIES}/byte_bpe_multi_50k.tiktoken", "rb").read())
    got = {r.doc_id: r.ids for r in E.ids(odd, "byte_bpe_multi_50k").collect()}
    assert got[3] == multi.encode_batch(["<|endoftext|>"])[0]
