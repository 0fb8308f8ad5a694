import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidyfold.llm import bpe


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.vocabulary_path())


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    decoded = library.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def check(spark, library, texts, **columns):
    rows = [(k if t != "no id" else None, t) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("block", F.lit(0))
    got = bpe.encode_decode(docs, bpe.vocabulary_path()).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted((i is None, i or 0, *expected(library, t)) for i, t in rows)
    for r in got:
        assert len(r.ids) == r.n_tokens and hashlib.sha256(r.decoded.encode()).hexdigest() == r.decoded_sha256


ODD = ["", None, " ", "no id", "It's we'll 'S ''s '' 'tis they've'd x'", "<|endoftext|>", "a<|startoftext|>b <|endoftext|", "ﬁ ① ½ 12 3٣ Ⅷ", "H̱ é É İ ß ẞ Σας ΣΑΣ", "\x00\x1c\x1f\x85\xa0​　x",
       "日本語 テキスト 한국어 🙂👩‍👩‍👧 ǅ ȺȾ", "à́̕ ́x '́s", "x" * 700, "'" * 50 + "s", "12345'll9", "né né Né NÉ", "the the The"]


def test_odd_texts_like_the_library(spark, library):
    check(spark, library, ODD + ODD)


def test_random_texts_and_small_blocks_and_slices(spark, library, monkeypatch):
    monkeypatch.setattr(bpe, "SHARD_BYTES", 300)
    rnd = random.Random(7)
    letters = list("aAbst'rlvemd 1²\t\n.,!-é") + ["<|endoftext|>", "'re", "'LL", " don't", "́", "’", "ż"]
    check(spark, library, ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 120))) for _ in range(300)])
    own = bpe.vocabulary(bpe.vocabulary_path())
    monkeypatch.setattr(bpe, "SLICE", 10)
    for _ in range(200):
        text = "".join(rnd.choice(letters) for _ in range(80))
        words = bpe._Words(own)
        words.add([1], [text])
        ids = [i for p in np.concatenate(words.places).tolist() for i in own.encode(words.words[p])] if words.places else []
        assert ids == library.encode(text, add_special_tokens=False).ids


def test_usual_characters_split_like_the_library(library):
    own = bpe.vocabulary(bpe.vocabulary_path())
    usual = [chr(c) for c in [*range(0x180), *range(0x2010, 0x2028), 0x20AC]]
    for c in usual:
        assert bpe._USUAL.fullmatch(c)
        text = f"a{c}b{c}{c}1 {c}'s{c}"
        whole, first, last, _, _ = bpe.split(own, [text])
        ids = [i for a, b in zip(first, last) for i in own.encode(whole[a:b])]
        assert ids == library.encode(text, add_special_tokens=False).ids, hex(ord(c))


def test_empty_table(spark):
    assert bpe.encode_decode(spark.createDataFrame([], "doc_id long, text string"), bpe.vocabulary_path()).count() == 0


def test_whole_documents(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {tuple(r)[:4] for r in bpe.op12_bpe_encoding(spark, "/root/testdata/sf0.001").collect()}
    assert got == {(r.doc_id, *expected(library, r.text)) for r in docs.collect()}
