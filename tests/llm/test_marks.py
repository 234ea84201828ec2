"""Texts are split for packing by passes over all their bytes; their ids are the library's."""

import random
from array import array

import pyarrow as pa
from tokenizers import Tokenizer

from brindle.llm.packing import _Ids
from brindle.llm.queries import tokenizer


def test_ids_of_whole_pieces_are_the_librarys_without_a_step_per_text(monkeypatch):
    path, rng = tokenizer("word_bpe_49k.json"), random.Random(5)
    parts = ["thing", "Thing", "a", "it's", "7", "B2", "über", "ÉTÉ", "İx", "日本", ".", ",", ";", ":", "!", "?", ")", "...", "$", " ", " ", " ", "\n", "\t", " ", "é"]
    texts = ["", None, ".", "a.", " .", ". a", "a. ", "\n"] + ["".join(rng.choices(parts, k=rng.randint(1, 30))) for _ in range(600)]
    library = Tokenizer.from_file(path)
    want = [array("H", [*library.encode(t or "", add_special_tokens=False).ids, 1]).tobytes() for t in texts]
    monkeypatch.setattr(_Ids, "prepared", None)  # a step in Python for each text
    ids = _Ids(path, 50)  # forgets often
    for _ in range(2):
        assert ids.blobs(pa.array(texts, pa.string()), b"\1\0").to_pylist() == want
        assert ids.blobs(pa.array(texts, pa.string()).slice(3, 200), b"\1\0").to_pylist() == want[3:203]
    assert ids.blobs(pa.array([], pa.string()), b"\1\0").to_pylist() == [] == ids.of([])
    assert ids.blobs(pa.array([None, ""], pa.string()), b"\1\0").to_pylist() == [b"\1\0"] * 2


def test_special_strings_are_matched_before_letters_are_lowered():
    path = tokenizer("word_bpe_49k.json")
    library, texts = Tokenizer.from_file(path), ["A <|ENDOFTEXT|> b, c.", "<|endoftext|>x. Y", "no. special", None]
    assert _Ids(path).of(texts) == [array("H", library.encode(t or "", add_special_tokens=False).ids).tobytes() for t in texts]
