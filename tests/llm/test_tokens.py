import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from siftgrain.llm import sentencepiece as S
from siftgrain.llm import token_counts as C
from siftgrain.llm.pieces import Pieces
from siftgrain.llm.trie import DoubleArray
from tests.llm.helpers import DATA, awkward, docs, empty, thue_morse

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pieces():
    return Pieces.read(PATH)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def odd_texts():
    r = random.Random(2)
    out = ["", " ", "   ", "a", " a", "  a  b ", "\t\n", "你好😀 x", "<s> </s> <unk>", "▁▁ a▁b", "x" * 500, " " * 70]
    return out + ["".join(r.choice("abth e \n▁é你😀  ") for _ in range(r.randint(0, 30))) for _ in range(300)]


def test_double_array_holds_its_keys():
    keys = [b"a", b"ab", b"abc", b"b", b"\xff\x00", b"abd"]
    trie = DoubleArray(keys, list(range(len(keys))))
    assert list(trie.prefixes(b"xabcd", 1)) == [(2, 0), (3, 1), (4, 2)]
    assert all((len(k), i) in list(trie.prefixes(k, 0)) for i, k in enumerate(keys))
    assert list(trie.prefixes(b"zz", 0)) == []


def test_counts_are_the_librarys_at_every_prefix(spark, pieces, library):
    texts = odd_texts() + [t for _, t, _ in awkward() if t and len(t) < 2000]
    got = {r.doc_id: r for r in C.prefix_token_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), pieces).collect()}
    for k, text in enumerate(texts):
        assert got[k].n_tokens == len(library.encode(text)) and got[k].n_chars == len(text) and got[k].n_bytes == len(text.encode())
    for k in range(0, len(texts), 5):
        prefixes = [texts[k][:i] for i in range(1, len(texts[k]) + 1)]
        assert C.counts_of(bytes(got[k].prefix_delta)).tolist() == [len(x) for x in library.encode(prefixes)] if prefixes else True


def test_whole_table_counts(spark, library):
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in C.query(spark, DATA).collect()}
    for r in spark.read.parquet(f"{DATA}/documents.parquet").collect():
        n = len(library.encode(r.text or ""))
        assert got[r.doc_id] == (len((r.text or "").encode()), n, n > 4096)


@pytest.mark.parametrize("size", [1024, 4096])
def test_long_words_do_not_collide(spark, pieces, library, size):
    a, b = thue_morse(size)
    texts = [a, b, f"{a} {b}", f"{b} {a} {a}"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.n_tokens for r in C.prefix_token_counts(df, pieces).orderBy("doc_id").collect()] == [len(x) for x in library.encode(texts)]
    assert [r.decoded for r in S.encode(df, pieces, decoded=True).orderBy("doc_id").collect()] == texts


def test_texts_over_a_megabyte(spark, pieces, library):
    r = random.Random(7)
    texts = [" ".join(r.choice(["the", "of", "wort", "naïve", "x1"]) for _ in range(400_000)), "q" * 30_000 + " end"]
    assert len(texts[0]) > 1 << 20
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.n_tokens for r in C.prefix_token_counts(df, pieces).orderBy("doc_id").collect()] == [len(x) for x in library.encode(texts)]
    assert [r.decoded for r in S.encode(df, pieces, decoded=True).orderBy("doc_id").collect()] == texts


def test_budget_and_truncation(spark, pieces, library):
    text = "the quick brown fox jumps over the lazy dog " * 5
    df = C.prefix_token_counts(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string"), pieces)
    row = C.tokens_at(C.fit_to_budget(df, 17), 20).orderBy("doc_id").collect()
    assert len(library.encode(text[: row[0].n_chars_fit])) <= 17
    assert all(len(library.encode(text[:i])) > 17 for i in range(row[0].n_chars_fit + 1, len(text) + 1))
    assert row[0].n_tokens_at == len(library.encode(text[:20])) and row[1].n_chars_fit == 0


def best(pieces, text):
    """Viterbi by definition, over the whole marked text: (score, ids)."""
    own = {pieces.texts[i]: i for i in pieces.matchable()}
    unknown = pieces.scores[pieces.kinds == 1].min() - S.UNKNOWN_PENALTY
    marked = ("▁" + text.replace(" ", "▁")) if text else ""
    table = [(0.0, [])] + [(-np.inf, [])] * len(marked)
    for e in range(1, len(marked) + 1):
        for s in range(max(0, e - 16), e):
            i = own.get(marked[s:e])
            if i is not None and table[s][0] + pieces.scores[i] > table[e][0]:
                table[e] = (table[s][0] + pieces.scores[i], [*table[s][1], i])
        if marked[e - 1] not in own and table[e - 1][0] + unknown > table[e][0]:
            table[e] = (table[e - 1][0] + unknown, table[e - 1][1] + [int(pieces.byte_ids[b]) for b in marked[e - 1].encode()])
    return table[-1]


def test_encoding_is_the_best_segmentation(spark, pieces):
    texts = odd_texts()[:150] + ["the of and to in", "unbelievable tokenization of internationalization"]
    got = {r.doc_id: r for r in S.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), pieces).collect()}
    for k, text in enumerate(texts):
        score, ids = best(pieces, text)
        assert got[k].score == pytest.approx(score) and (got[k].ids == ids or abs(score) > 1e8), text


def test_encoding_is_the_librarys_unigram(spark, pieces):
    raw = open(PATH, "rb").read()
    at = raw.rindex(b"tok_v0") + 7
    assert raw[at - 1 : at + 1] == b"\x18\x02"  # the model's type: byte pairs; 1 is unigram
    library = sentencepiece.SentencePieceProcessor(model_proto=raw[:at] + b"\x01" + raw[at + 1 :])
    texts = ["the of and to in", "a quick test of the segmentation", "lead and twice", "x"]  # no run of spaces: its score of -1e9 leaves the library no digits for the rest
    got = {r.doc_id: r.ids for r in S.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), pieces).collect()}
    assert [got[k] for k in range(len(texts))] == [library.nbest_encode(t, nbest_size=2)[0] for t in texts]


def test_round_trip_of_all_documents(spark):
    got = S.query(spark, DATA)
    assert got.filter("NOT round_trip").count() == 0 and got.count() == spark.read.parquet(f"{DATA}/documents.parquet").count()


def test_decoding(spark, pieces, library):
    rows = [(1, [pieces.byte_ids[0xFF].item()]), (2, [0, 1, 2, 99999, -1]), (3, []), (4, None), (5, library.encode("é <s> 你😀"))]
    df = spark.createDataFrame([(i, None if x is None else [int(y) for y in x]) for i, x in rows], "k int, ids array<int>")
    got = {r.k: r.decoded for r in S.decode(df, pieces).collect()}
    assert got[1] == "�" and got[2] == "⁇ " and got[3] == "" and got[4] is None and got[5] == "é <s> 你😀"


def test_awkward_documents(spark, pieces, library):
    for f in (S.encode, C.prefix_token_counts):
        rows = f(docs(spark), pieces).collect()
        assert len(rows) == len(awkward()) and sum(r.doc_id is None for r in rows) == 1
        assert f(empty(spark), pieces).count() == 0
    by_id = {r.doc_id: r for r in S.encode(docs(spark), pieces).collect()}
    assert by_id[4].ids == [] and by_id[5].ids == [] and by_id[5].score == 0
    counts = {r.doc_id: r.n_tokens for r in C.prefix_token_counts(docs(spark), pieces).collect()}
    assert counts[9] == len(library.encode(dict((i, t) for i, t, _ in awkward())[9]))
