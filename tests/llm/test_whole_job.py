"""Pairs, words and notices that a shortcut used to lose."""

import random

import numpy as np

from brindle.llm import license_scan, minhash
from brindle.llm.packing import _Ids
from brindle.llm.queries import tokenizer


def test_low_bytes_that_agree_in_an_earlier_band_do_not_hide_a_pair(spark):
    marks = bytearray(np.random.default_rng(1).integers(0, 256, minhash.BINS, np.uint8).tobytes())
    bands = list(range(minhash.BINS // minhash.ROWS))
    other = [-1, *bands[1:]]  # the first band differs above the low bytes
    rows = [(7, 1, 1, 1, marks, bands, [1, 2, 3, 4]), (7, 1, 2, 2, marks, other, [1, 2, 3, 4])]
    kind = "bucket long, band int, id long, component long, marks binary, bands array<long>, shingles array<long>"
    assert [tuple(r) for r in minhash._across(spark.createDataFrame(rows, kind), 75).collect()] == [(1, 2)]
    # one that shares an earlier band is compared there
    rows[1] = (*rows[1][:5], bands, rows[1][6])
    assert minhash._across(spark.createDataFrame(rows, kind), 75).collect() == []


def test_a_word_whose_lower_case_is_no_longer_all_letters():
    ids = _Ids(tokenizer("word_bpe_49k.json"))
    for text in ("İstanbul", "İ", "xİy,", "École İzmir."):
        assert ids.of([text]) == ids.encode(ids.library, [text])


def test_short_notices_and_notices_in_different_places():
    library = license_scan.Library(license_scan.templates())
    names = lambda text: {library.names[i] for i in library.scan(text.encode())[1]}
    rng = random.Random(3)
    noise = " ".join(rng.choice(["lorem", "ipsum", "dolor", "amet"]) for _ in range(300))
    for name in ("MIT", "ISC"):
        short = f"Licensed under {name} License"
        assert names(short) == names(f"{noise} {short}. {noise}") == {name}
    assert names("under MIT License") == set()
    two, three = license_scan.TEXTS["GPL-2.0"].replace("published by", "issued by"), license_scan.TEXTS["GPL-3.0"]
    assert names(f"{noise} {three} {noise}") == {"GPL-3.0"}
    assert names(f"{noise} {two} {noise}") == {"GPL-2.0"}
    assert names(f"{three} {noise} {two}") == names(f"{two} {noise} {three}") == names(f"{three} {two}") == {"GPL-2.0", "GPL-3.0"}


def test_every_letter_below_the_bound_is_the_librarys_in_words():
    ids = _Ids(tokenizer("word_bpe_49k.json"))
    rng = random.Random(4)
    letters = [chr(c) for c in range(0x41, 0x250) if chr(c).isalpha()]
    words = [*letters, *("".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(3000))]
    assert ids.of([" ".join(words)]) == ids.encode(ids.library, [" ".join(words)])
