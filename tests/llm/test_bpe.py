import base64
import os
import random

import pytest

from marrow.llm import bpe, packing, splitter

PATH = bpe.tokenizer_path()
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary files")


@pytest.fixture(scope="module")
def library():
    tiktoken = pytest.importorskip("tiktoken")
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def test_agrees_with_the_library(library):
    t = bpe.transducer(PATH)
    rnd = random.Random(4)
    for _ in range(4000):
        s = "".join(rnd.choice("aabcdeinorst  \n\t'.,0189éß中文ΩНо_-=😀‍\r") for _ in range(rnd.randint(0, 60)))
        assert t.encode(s) == library(s) and t.decode(t.encode(s)) == s
    for s in ("<|endoftext|>", " " * 1000, "a" * 3000, "ab" * 2000, "\n\n \n", "don't they'll'S", "x" + "́" * 50):
        assert t.encode(s) == library(s), s[:20]


def test_words_are_kept_to_a_bound(monkeypatch, library):
    monkeypatch.setattr(bpe, "MEMO_WORDS", 3)
    t = bpe.Transducer.load(PATH)
    text = " ".join(f"word{k}" for k in range(40))
    assert t.encode(text) == library(text) and len(t._memo) <= 3


def test_states_are_kept_to_a_bound(monkeypatch, library):
    rnd = random.Random(6)
    texts = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyzé中") for _ in range(rnd.randint(1, 400))) for _ in range(60)]
    for bound in (1, 7, 500):
        monkeypatch.setattr(bpe, "TRANSITIONS", bound)
        monkeypatch.setattr(bpe, "BORDERS", bound)
        t = bpe.Transducer.load(PATH)
        assert [t.encode(x) for x in texts] == [library(x) for x in texts]
        assert sum(map(len, t._next)) <= bound and len(t._fits) <= bound and len(t._states) == len(t._next) == len(t._end) <= bound + 2


def test_decode_stream():
    t = bpe.transducer(PATH)
    ids = t.encode("é😀")
    assert "".join(t.decode_stream(ids)) == "é😀" and t.decode(ids[:1] + t.encode("a")) in ("éa", "�a", "é" + "a")
    assert "�" in t.decode([t.ranks[b"\xf0"]])


def test_encode_table(spark, library):
    texts = [(1, "Hello  world"), (2, ""), (3, None), (4, "<|endoftext|>"), (4, "again"), (5, "long text " * 50_000)]
    df = spark.createDataFrame([(k, t, 0, "") for k, t in texts], "doc_id long, text string, k int, ids string")
    got = sorted((r["doc_id"], list(r["ids"])) for r in bpe.encode(df).collect())
    assert got == sorted((k, library(t or "")) for k, t in texts)
    counts = sorted(map(tuple, bpe.token_counts(df).collect()))
    assert counts == sorted((k, len(library(t or ""))) for k, t in texts)
    assert bpe.encode(df.limit(0)).count() == 0


def test_token_offsets_and_splitting(spark):
    text = "Some words, 中文 and 😀😀 more. " * 40
    at = bpe.token_offsets(text, PATH)
    assert at[0] == 0 and at[-1] == len(text) and (at[1:] >= at[:-1]).all()
    df = spark.createDataFrame([(1, text, "a.md"), (2, "short", "a.md")], "ord long, content string, file_path string")
    got = splitter.split_oversized(df, 64, 8, tokenizer=PATH, text=True).orderBy("piece_no").collect()
    assert {r["ord"] for r in got} == {1} and len(got) > 3 and got[-1]["start"] + got[-1]["length"] == len(text)
    packed = packing.pack_texts(df.withColumnRenamed("ord", "doc_id").withColumnRenamed("content", "text"), 2048).collect()
    assert len(packed) == 2 and {r["container"] for r in packed} == {0}
