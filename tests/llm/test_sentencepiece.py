import random

import numpy as np
import pytest
import sentencepiece

from impactlake.llm.sentencepiece_codec import DEFAULT_MODEL, Codec, encode

random.seed(1)
ALPHABET = "ab  \n\tthe in é漢😀▁_<s>0x"
FUZZ = ["".join(random.choice(ALPHABET) for _ in range(random.randint(0, 90))) for _ in range(800)]
FUZZ += ["", " ", "a" * 300, "the" * 200, " " * 70, "\0a", "plain words of a text. " * 400]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=DEFAULT_MODEL)


def test_bpe_ids_and_decoding_equal_the_library(library):
    c = Codec()
    for text in FUZZ:
        ids = library.encode(text)
        assert c.encode(text) == ids
        assert c.decode(ids) == library.decode(ids)
        assert c.decode(ids) == text.replace("▁", " ")


def test_invalid_byte_runs_decode_like_the_library(library):
    c = Codec()
    byte = {b: library.piece_to_id(f"<0x{b:02X}>") for b in range(256)}
    for run in (b"\xff", b"\xe6\xbc", b"a\xe6\xbcz", b"\xf0\x9f\x98\x80\xf0\x9f"):
        ids = [byte[b] for b in run]
        assert c.decode(ids) == library.decode(ids)


def test_texts_decoded_together_equal_each_alone(library):
    c = Codec()
    byte = {b: library.piece_to_id(f"<0x{b:02X}>") for b in range(256)}
    valid = [c.encode(t) for t in FUZZ] + [[], [c.unk], [1], [1, *c.encode("a b")], [*c.encode("a"), 2, c.unk], [byte[0x20], byte[0x0A]], [byte[b] for b in b"\xe2\x96\x81z\xf0\x9f\x98\x80"]]
    odd = [[byte[b] for b in run] for run in (b"\xff", b"\xe6\xbc", b"a\xe6\xbcz", b"\xed\xa0\x80", b"\xf0\x9f\x98\x80\xf0\x9f")] + [[*c.encode("a"), byte[0xE6], *c.encode("b")]]
    for lists in (valid, valid + odd, [], [[]]):
        at = np.cumsum([0, *map(len, lists)])
        flat = np.array([i for ids in lists for i in ids], np.int32)
        assert c.decode_flat(flat, at).to_pylist() == [c.decode(ids) for ids in lists]


def test_lookup_finds_every_piece_and_nothing_else():
    c = Codec()
    at, there = c._probe(c.keys)
    assert there.all() and (at == np.arange(len(c.keys))).all() and c._shared.any()
    others = np.concatenate([c.keys ^ np.uint64(1), np.random.default_rng(1).integers(0, 1 << 64, 100_000, np.uint64), np.array([0, (1 << 64) - 1], np.uint64)])
    assert (c._probe(others)[1] == np.isin(others, c.keys)).all()


def best_score(text: str, scores: dict[str, float]) -> float:
    """Plain best path over all pieces of the text."""
    best = [0.0] + [float("-inf")] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(max(0, end - 20), end):
            if (s := scores.get(text[start:end])) is not None:
                best[end] = max(best[end], best[start] + s)
    return best[-1]


def test_viterbi_finds_the_best_path():
    c = Codec(kind="unigram")
    assert Codec().kind == "bpe"
    scores = {piece: s for piece, (s, _) in c.score_of.items()}
    for text in ["the thing in there", "nearly all of it", "Inhaltlich abenteuerlich", "a an and ande", "words " * 30, "x" * 90]:
        ids = c.encode(text)
        assert "".join(c.pieces[i] for i in ids) == c.normalize(text)
        assert sum(scores[c.pieces[i]] for i in ids) == pytest.approx(best_score(c.normalize(text), scores))


def test_frame_with_nulls_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b", 5), (2, None, 6), (3, "", 7), (1, "a b", 5)], "doc_id long, text string, n_tokens int")
    out = encode(df)
    assert out.columns == ["doc_id", "text", "n_tokens", "input_ids", "_n_tokens", "decoded"]
    rows = {(r.doc_id, r.decoded, r._n_tokens, r.n_tokens) for r in out.collect()}
    assert rows == {(1, "a b", 2, 5), (2, None, None, 6), (3, "", 0, 7)}
    assert encode(df.limit(0)).count() == 0
    assert out.count() == 4
