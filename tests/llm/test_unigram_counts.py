import random

import pytest

from voxtally.llm.unigram_counts import UnigramCounter, count_tokens, sentencepiece_vocabulary

public_tokenizers = pytest.importorskip("public_tokenizers")


def library(vocabulary, unk, byte_fallback):
    from tokenizers import Tokenizer, models, pre_tokenizers

    t = Tokenizer(models.Unigram(vocabulary, unk, byte_fallback))
    t.pre_tokenizer = pre_tokenizers.Metaspace("▁", "always", True)
    return t


@pytest.mark.parametrize("byte_fallback", [False, True])
def test_ties_and_unknowns_as_in_the_library(byte_fallback):
    r = random.Random(5)
    for _ in range(60):
        pieces = sorted({"".join(r.choices("ab▁c", k=r.randint(1, 4))) for _ in range(r.randint(2, 14))})
        vocabulary = [("<unk>", 0.0)] + [(p, float(-r.randint(0, 3))) for p in pieces]
        if byte_fallback:
            vocabulary += [(f"<0x{b:02X}>", -4.0) for b in range(256)]
        t, counter = library(vocabulary, 0, byte_fallback), UnigramCounter(vocabulary, byte_fallback)
        for _ in range(25):
            text = "".join(r.choices("abcd é ", k=r.randint(1, 14)))
            assert counter.text(text)[1] == len(t.encode(text, add_special_tokens=False).ids), (vocabulary, text)


def test_whole_vocabulary_and_edge_rows(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    vocabulary, unk = sentencepiece_vocabulary(path)
    t = library(vocabulary, unk, True)
    rows = [(1, "The quick  brown fox", 5), (2, "", 1), (None, None, 2), (3, " lead and trail ", 1), (4, "漢字 <s> ▁x \n\t y", 1), (1, "The quick  brown fox", 5), (5, "long " * 20_000 + "x" * 5000, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = {r.doc_id: r for r in count_tokens(df, path).collect()}
    for doc_id, text, _ in rows:
        assert got[doc_id].n_tokens == (len(t.encode(text, add_special_tokens=False).ids) if text else 0)
    assert count_tokens(df.limit(0), path).count() == 0
