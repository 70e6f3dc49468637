"""Words encoded in runs against each text encoded whole."""
import random

import pyarrow as pa
import pytest

from corrobora.llm import tokens
from corrobora.llm.queries import tokenizer_path

ODD = ["", "<|endoftext|>", "a <|endoftext|> b", "x<|endoftext|>y z", "Ġa Ċb", "Ġ Ċ x", "don't 'll\n's it's", "a\nb c\nd",
       "日本 語\nx", "\U0001f600 ́e ‍x", "  two  spaces", " x y ", "tab\tand more", "w" * 5_000]


def plain(encoder, texts):
    return [encoder.of_text.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("run", [1, 3, 256])
def test_runs_equal_whole_texts(monkeypatch, run):
    monkeypatch.setattr(tokens, "RUN", run)
    rng = random.Random(run)
    texts = ODD + [" ".join(rng.choice(ODD[:9] + ["foo", f"bar{rng.randrange(99)}", "!!", "$x"]) for _ in range(30)) for _ in range(80)]
    encoder = tokens.Encoder(tokenizer_path())
    for _ in range(3):                              # anew, then from remembered words
        assert [list(ids) for ids in encoder(pa.array(texts))] == plain(encoder, texts)


def test_words_are_encoded_one_by_one_where_no_id_opens_them():
    encoder = tokens.Encoder(tokenizer_path())
    encoder.opens[:] = False                        # as in a vocabulary of another kind
    texts = ["some plain words", "and\nothers, some plain"]
    assert [list(ids) for ids in encoder(pa.array(texts))] == plain(encoder, texts)


def test_a_small_cache_changes_nothing(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", 5)
    encoder = tokens.Encoder(tokenizer_path())
    rng = random.Random(1)
    for _ in range(6):
        texts = [" ".join(f"word{rng.randrange(30)}" for _ in range(20)) for _ in range(10)]
        assert [list(ids) for ids in encoder(pa.array(texts))] == plain(encoder, texts)
