"""The encoder's pieces."""

from __future__ import annotations

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tidewell.llm import op4_bpe

PATH = public_tokenizers.path(op4_bpe.VOCABULARY)


def test_short_words_come_as_bytes_of_their_ids():
    """Before, each word was an array of its own."""
    v, library = op4_bpe.vocabulary(PATH), Tokenizer.from_file(PATH)
    words = ["a", " the", "q7", "naïve", " ", "zzzzzzzz", "xylophones"]
    found = op4_bpe.encode_short(v, [w.encode() for w in words])
    assert all(isinstance(x, bytes) for x in found)
    assert [np.frombuffer(x, "<i4").tolist() for x in found] == [library.encode(w, add_special_tokens=False).ids for w in words]


def test_known_and_new_pieces_keep_their_order():
    v, library = op4_bpe.Vocabulary(PATH), Tokenizer.from_file(PATH)
    op4_bpe.encode_pieces(v, ["seen", " seen."])
    pieces = ["new1,x", "seen", " new", " seen.", "new1,x"]
    assert [np.frombuffer(x, "<i4").tolist() for x in op4_bpe.encode_pieces(v, pieces)] == [library.encode(p, add_special_tokens=False).ids for p in pieces]
