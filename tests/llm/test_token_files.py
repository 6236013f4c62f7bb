import zlib

import numpy as np
import pyarrow as pa
import pytest

from voxtally.llm.token_files import Encoder, open_part, read_manifest, read_token_files, write_token_files

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", " ", "  ", " a", "a ", "a  b", "a \nb", "\n a", " \n a  \t b ", "x<|endoftext|> y", "it's a b c  d", "don't  'll x", " 1 22 3a", "a\x1c b \x1cc", "ü ñ 漢字 の x　 y", "w" * 3000, "a b's c'' d't, 'e f!? (g) h_i j- <|endoftext|>", "x ... y, z,. <|endoftext|>. é'", "word " * 5000]


def plain(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return [[*t.encode(x or "", add_special_tokens=False).ids, 0] for x in texts]


def test_parts_give_the_ids_of_whole_texts():
    encoder = Encoder(PATH)
    assert [np.frombuffer(b, "<u2").tolist() for b in Encoder(PATH).encode_all(pa.array([None, *TEXTS * 2]).slice(1))] == plain(TEXTS * 2)
    for _ in range(2):
        assert [np.frombuffer(encoder.encode(x), "<u2").tolist() for x in TEXTS] == plain(TEXTS)


def test_files_hold_all_documents_in_order(spark, tmp_path):
    rows = [(i * 7 % 17 - 3, t, "z") for i, t in enumerate(TEXTS)] + [(None, "null id", ""), (4, None, ""), (4, "twin", ""), (4, "twin", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(3)
    out = str(tmp_path / "files")
    manifest = write_token_files(df, out, PATH)
    got = read_token_files(spark, out, with_ids=True).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i or 0))
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4"))
        at += r.n_tokens
    assert at == manifest["n_tokens"] == read_manifest(out)["n_tokens"]
    want = sorted(zip([r[0] for r in rows], plain([r[1] for r in rows]), strict=True), key=str)
    assert sorted(((r.doc_id, r.ids) for r in got), key=str) == want
    ids, offsets, _, _ = open_part(out, manifest["parts"][0]["part"], manifest["unit"])
    assert isinstance(ids, np.memmap) and offsets[-1] == len(ids)


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string")
    out = str(tmp_path / "none")
    assert write_token_files(df, out, PATH)["n_tokens"] == 0
    assert read_token_files(spark, out).count() == 0
