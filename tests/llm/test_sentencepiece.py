import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from riskloom.llm import sentencepiece_codec as sp

PATH = public_tokenizers.path("piece_bpe_32k.model")
TABLE = sp.load_pieces(PATH)
LIB = sentencepiece.SentencePieceProcessor(model_file=PATH)
ENCODER, DECODER = sp.Encoder(TABLE), sp.Decoder(TABLE)


def same(texts):
    flat, counts = ENCODER.encode(texts)
    ids = [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])]
    want = [LIB.encode(t) for t in texts]
    assert ids == want
    assert DECODER.decode(flat, counts) == [LIB.decode(w) for w in want]


def test_hand_picked_texts():
    same(["", " ", "  a  b ", "\n", "a▁b", "x\x00y", "<s>", "<0x0A>", "　z", "é", "\U0001f600 ok", "aaaaaaaaaaaaa", "  " * 40, "\n\n  \t x", "===========", "don't!!! 12345678901234567890"])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\tabcdeinthero=-.0▁"))), min_size=1, max_size=4))
def test_any_text(texts):
    same(texts)


def test_repeated_letters_and_long_words():
    rng = random.Random(3)
    same(["".join(rng.choice("ab ") for _ in range(300)) for _ in range(50)] + ["".join(rng.choice("theinsro") for _ in range(20000)), "a" * 5000, "ab" * 3000, " " * 999])


def test_decode_of_any_ids():
    rng = random.Random(4)
    lists = [[rng.randrange(3, 700) for _ in range(rng.randrange(0, 12))] for _ in range(300)] + [[3 + 0xE2, 3 + 0x82, 5], [1, 28705, 263]]
    flat = np.array([i for x in lists for i in x], np.int32)
    assert DECODER.decode(flat, np.array([len(x) for x in lists])) == [LIB.decode(x) for x in lists]


def test_operator_with_nulls_and_clashes(spark):
    rows = [(1, None, "x"), (2, "", "y"), (3, "Hello  world\n", None), (3, "Hello  world\n", None), (None, "z" * 10000, "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, IDS string")
    got = sp.decode(sp.encode(df, TABLE), TABLE).collect()
    assert sorted((r.text or "", r.ids, r.decoded) for r in got) == sorted((t or "", LIB.encode(t or ""), t or "") for _, t, _ in rows)
    assert sp.encode(df.limit(0), TABLE).count() == 0


def test_other_models_are_refused(tmp_path):
    (tmp_path / "m").write_bytes(b"")
    with pytest.raises(ValueError):
        sp.load_pieces(str(tmp_path / "m"))
