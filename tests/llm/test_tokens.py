"""Operators 3, 7 and 9 against the tokenizers library over whole texts."""
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from quarry.llm import bpe, bpe_codec, lexicon, token_counts, token_files
from quarry.llm.merges import MergeWords

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOK = Tokenizer.from_file(PATH)
PIECES = ["a", "b", " ", "  ", "\n", "\t", "'s", "'t", "'re", "'ll", "'l", "'", "''", "1", "23", "é", "ß", "你", "!", ".",
          "<|endoftext|>", "<|endo", "\u2019", "\u0301", "😀", "٣", "Ⅷ", "\r\n", "'S", "\x00", "\x85", "'ve", "word", "The"]


def ref(text):
    return TOK.encode(text or "", add_special_tokens=False).ids


def odd_texts(n, seed=3):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 40))) for _ in range(n)] + ["", None, " ", "don't", "a" * 300]


@pytest.mark.parametrize("resolver", ["library", "merges"])
@pytest.mark.parametrize("limit", [4_000_000, 37])
def test_words_equal_the_library(resolver, limit, monkeypatch):
    monkeypatch.setattr(bpe, "SLICE_CHARS", limit)
    split = bpe.WordSplitter(PATH)
    words = bpe.LibraryWords(split) if resolver == "library" else MergeWords(bpe.check_supported(PATH))
    enc, texts = bpe.Encoder(split, words), odd_texts(3000)
    got = [[] for _ in texts]
    for rows, ids, n in enc.ids(texts):
        at = 0
        for r, k in zip(rows, n):
            got[r] += ids[at:at + k].tolist()
            at += k
    assert got == [ref(t) for t in texts]
    assert enc.counts(texts).tolist() == [len(ref(t)) for t in texts]


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        bpe.check_supported(public_tokenizers.path("word_bpe_49k.json"))


def test_transducer_is_minimal_and_numbers_words(tmp_path):
    words = sorted({w.encode() for w in "tap taps top tops stop stops a b ab abb".split()})
    flat, counts = MergeWords(bpe.check_supported(PATH)).resolve(pa.array(words, pa.binary()))
    lexicon.write_transducer(lexicon.compile_words(words, flat, counts), str(tmp_path / "x"))
    t = lexicon.Transducer(str(tmp_path / "x"), MergeWords(bpe.check_supported(PATH)))
    assert t.numbers(pa.array(words, pa.binary())).tolist() == list(range(len(words)))
    assert t.numbers(pa.array([b"ta", b"stopss", b"", b"z"], pa.binary())).tolist() == [-1] * 4
    assert len(t.final) == 9  # right languages counted by hand
    got, n = t.resolve(pa.array([b" unseen", b"stop", b"zzz"], pa.binary()))
    assert got.tolist() == ref(" unseen") + ref("stop") + ref("zzz") and n.sum() == len(got)


@pytest.fixture(scope="module")
def table(spark):
    rnd = random.Random(5)
    rows = [(i, t, 1) for i, t in enumerate(odd_texts(40))] + [
        (None, "x y", 1), (7, "again", 1), (7, "again", 1), (900, "a" * 30_000, 1),
        (901, " ".join(f"w{rnd.randint(0, 99999)}" for _ in range(9000)), 1), (902, "x y <|endoftext|> 's " * 3000, 1)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, row int")


def test_counts_with_widened_overlaps(table):
    rows, df = table
    got = token_counts.token_counts(df, PATH, chunk_chars=2048, overlap=16).collect()
    want = [(k, len((t or "").encode()), len(ref(t)), len(ref(t)) > 512) for k, t, _ in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_counts_by_whole_text_for_other_kinds(table):
    rows, df = table
    path = public_tokenizers.path("piece_bpe_32k.model")
    import sentencepiece
    m = sentencepiece.SentencePieceProcessor(model_file=path)
    got = token_counts.token_counts(df.where("doc_id < 20"), path).collect()
    assert {r.doc_id: r.n_tokens for r in got if r.doc_id != 7} == {
        k: len(m.encode(t or "")) for k, t, _ in rows if k is not None and k < 20 and k != 7}


def test_files_round_trip(table):
    rows, df = table
    index = token_files.write_token_files(df, PATH, sequence=64, batch=4)
    got = {}
    for r in token_files.read_checksums(index).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.n_tokens, r.ids_crc32))
    for k in {r[0] for r in rows}:
        want = sorted(zlib.crc32(np.array(ref(t) + [0], "<u4").tobytes()) for i, t, _ in rows if i == k)
        assert sorted(x[2] for x in got[k]) == want
    order = sorted((s, n, -1 if k is None else k) for k, v in got.items() for s, n, _ in v)
    assert order[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(order, order[1:]))
    assert [x[2] for x in order] == sorted(x[2] for x in order)
    first = index.orderBy("start").first()
    ids, mask = token_files.open_token_file(first["file"]).sequence(0)
    assert len(ids) == len(mask) == 64


def test_encode_decode(table):
    rows, df = table
    got = bpe_codec.encode_decode(df, PATH, lexicon_words=50).collect()
    want = [(k, len(ref(t)), np.array(ref(t), "<u4").tobytes(), TOK.decode(ref(t), skip_special_tokens=False)) for k, t, _ in rows]
    assert sorted(((r.doc_id, r.n_tokens, bytes(r.ids), r.decoded) for r in got), key=str) == sorted(want, key=str)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert token_counts.token_counts(df, PATH).count() == 0
    assert token_files.read_checksums(token_files.write_token_files(df, PATH)).count() == 0
    assert bpe_codec.encode_decode(df, PATH).count() == 0
