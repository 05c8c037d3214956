"""What workers keep between stages stays small, whatever the texts hold, and changes no result."""

import sys

import numpy as np
import pytest

from loomstead.llm import divergence, packing
from loomstead.llm.common import word_spans, worker_cache
from loomstead.llm.queries import tokenizer_file


def test_a_worker_keeps_few_pieces_and_gives_the_same_ids():
    known = packing.ChunkIds(tokenizer_file(), "<u2")
    text = " ".join("".join(chr(97 + n // 26**i % 26) for i in range(4)) for n in range(230_000))
    ids = known.of(text)
    kept = sum(sys.getsizeof(t) + sum(sys.getsizeof(k) + sys.getsizeof(v) for k, v in t.items()) for t in (known, known.parts))
    assert kept < 50_000_000
    assert packing.ChunkIds(tokenizer_file(), "<u2").of(text[-5000:]) == ids[-len(known.of(text[-5000:])) :]


def test_a_word_that_comes_again_is_tokenized_once_however_it_is_written(monkeypatch):
    import tokenizers

    real, read = tokenizers.Tokenizer.from_file(tokenizer_file()), []

    class Counted:
        model = property(lambda self: self)
        from_file = classmethod(lambda cls, path: cls())
        to_str = staticmethod(real.to_str)
        encode = staticmethod(lambda piece, **options: read.append(piece) or real.encode(piece, **options))
        tokenize = staticmethod(lambda piece: read.append(piece) or real.model.tokenize(piece))

    monkeypatch.setattr(tokenizers, "Tokenizer", Counted)
    monkeypatch.setattr(packing.ChunkIds, "BOUND", 50)
    known = packing.ChunkIds(tokenizer_file(), "<u2")
    texts = [f"Often {''.join(chr(97 + n // 26**i % 26) for i in range(4))} often, 12: 12." for n in range(400)]
    for text in texts:
        assert known.of(text) == np.array(real.encode(text, add_special_tokens=False).ids, "<u2").tobytes()
    assert read.count("often") == 1 and sum("12" in x for x in read) == 1 and len(read) == 400 + 5


@pytest.mark.parametrize("text", ["\u0958. \u0958\u03a3., \u0130\u03a3! E\u0301.", "a\u00b2. _. x\x1c. a.\x1c \u2167,; don't. 's. (.", "A.B.. \u00c9T\u00c9!? \u4f60: \u00a0. B\u00a0.", "K\u212a. <|endoftext|>. \u01c5."])
def test_parted_marks_keep_the_tokenizers_ids(text):
    import tokenizers

    want = tokenizers.Tokenizer.from_file(tokenizer_file()).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(packing.ChunkIds(tokenizer_file(), "<u2").of(text), "<u2").tolist() == want


@pytest.mark.parametrize("n", [120_000])
def test_a_worker_keeps_few_forms(n):
    worker_cache("letters", dict).clear()
    for at in range(0, n, 10_000):
        raw = " ".join("".join(chr(97 + x // 26**i % 26) for i in range(4)) for x in range(at, at + 10_000)).encode()
        assert sum(divergence.common_counts(raw, word_spans(raw)).values()) == 10_000
    assert len(worker_cache("letters", dict)) <= 60_000
    worker_cache("letters", dict).clear()
