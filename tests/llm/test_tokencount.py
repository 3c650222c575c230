import os

import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from skyloom.llm import tokens
from skyloom.llm.tokencount import token_counts
from skyloom.llm.tokens import PieceEncoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
PLAIN = Tokenizer.from_file(PATH)
TEXTS = ["", "a", " a", "a  b", " ", "  ", "a \n b", "a<|endoftext|>b c", "don't%%% it's 'x", "é× ÷%a1b2", "a   b", "　 x  ", "a'%s b's'tx 日本語 テスト", "it'll've'd abc123!?9 ñ ª!", "<|endoftext|>", "x\x1ey z", "long " * 3000]


SMALL = PieceEncoder(PATH, cache=20)


def brute(texts):
    return [x.ids for x in PLAIN.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_pieces_are_exact():
    counts, ids = PieceEncoder(PATH).encode(pa.array(TEXTS))
    want = brute(TEXTS)
    assert counts.tolist() == [len(x) for x in want]
    assert ids.tolist() == [y for x in want for y in x]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("ab'st.%1é×\n\t   ñ日<|>endof")), max_size=30), min_size=1, max_size=6))
def test_pieces_are_exact_for_any_text(texts):
    counts, ids = SMALL.encode(pa.array(texts, pa.string()))
    want = brute(texts)
    assert counts.tolist() == [len(x) for x in want]
    assert ids.tolist() == [y for x in want for y in x]


def test_whole_texts_for_other_files():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    texts = ["a  b\nc", "", "Hello world"]
    counts, ids = PieceEncoder(path).encode(pa.array(texts))
    want = sentencepiece.SentencePieceProcessor(model_file=path).encode(texts)
    assert counts.tolist() == [len(x) for x in want] and ids.tolist() == [y for x in want for y in x]


def test_counts_of_rows(spark):
    rows = [(1, "a b"), (1, "a b"), (2, None), (None, ""), (3, "word " * 600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' n_bytes", "1 n_tokens")
    got = sorted(map(tuple, token_counts(docs, PATH).collect()), key=str)
    want = sorted([(d, len((t or "").encode()), n := len(brute([t])[0]), n > 512) for d, t in rows], key=str)
    assert got == want
    assert token_counts(docs.where("false"), PATH).count() == 0


@pytest.mark.parametrize("column", ["text"])
def test_schema(spark, column):
    docs = spark.createDataFrame([(1, "a")], f"doc_id long, {column} string")
    assert dict(token_counts(docs, PATH).dtypes) == {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"}


def test_bare_words_skip_the_library_s_pattern(monkeypatch):
    coder, texts = PieceEncoder(PATH), [" ".join(["naïve", "Œuvre", "ɏx", "word", "Straße", "don't", "a1b2", "x\ny", "ÿ×÷"] * 3)]
    calls = []
    library = coder._library
    monkeypatch.setattr(coder, "_library", lambda x, words=False: (calls.append((words, x.to_pylist())), library(x, words))[1])
    counts, ids = coder.encode(pa.array(texts))
    want = brute(texts)[0]
    assert ids.tolist() == want and counts.tolist() == [len(want)]
    assert any(words and " Œuvre" in "".join(got) for words, got in calls)


def test_a_full_cache_keeps_pieces_of_many_batches(monkeypatch):
    coder, often, asked = PieceEncoder(PATH, cache=100), [f" often{chr(97 + i)}" for i in range(20)], []
    library = coder._library
    monkeypatch.setattr(coder, "_library", lambda x, words=False: (asked.extend(x.to_pylist()), library(x, words))[1])
    for i in range(30):
        texts = ["".join(often) + "".join(f" rare{chr(97 + i % 26)}{chr(97 + j)}{'x' * (i // 26)}" for j in range(20)), "", " "]
        counts, ids = coder.encode(pa.array(texts))
        want = brute(texts)
        assert counts.tolist() == [len(x) for x in want] and ids.tolist() == [y for x in want for y in x]
        assert len(coder.pieces) == len(coder.lens) == len(coder.begins) == len(coder.uses) <= 100
    assert sum(x.count("oftena") for x in asked) == 1


def test_a_task_takes_no_cores_of_others(monkeypatch):
    monkeypatch.delenv("TOKENIZERS_PARALLELISM", raising=False)
    monkeypatch.setattr(tokens, "_ENCODERS", {})
    tokens.encoder(PATH)
    assert os.environ.get("TOKENIZERS_PARALLELISM") == "false"


@pytest.mark.parametrize("scanned", [1, 2, 3, 1 << 18])
def test_pieces_share_the_texts_bytes(monkeypatch, scanned):
    monkeypatch.setattr(tokens, "_SCANNED", scanned, raising=False)
    texts = ["left out", "", "éa é1ɏ!ɐ!×1÷1ÿ?", " at b.c", "日本, x", "", "ö", "1"]
    whole = pa.array(texts)
    pieces, begins = (coder := PieceEncoder(PATH))._cut(whole.slice(1))
    assert pieces.buffers()[2].address == whole.buffers()[2].address
    want, at = coder._cut_slowly(texts[1:])
    got = ["".join(pieces.slice(a, b - a).to_pylist()) for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)]
    assert got == texts[1:] and pieces.to_pylist() == [x for x in want.to_pylist() if x]
    counts, ids = coder.encode(whole)
    assert ids.tolist() == [y for x in brute(texts) for y in x] and counts.tolist() == [len(x) for x in brute(texts)]
