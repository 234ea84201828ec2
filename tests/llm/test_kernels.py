"""Kernels against brute force: no Spark needed."""

import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from brindle.llm import html_extraction as H
from brindle.llm import license_scan, minhash, substring_dedup, token_counts, transport_stream
from brindle.llm.common import WordHash, shingle_set
from brindle.llm.packing import TournamentTree, _Ids, pack
from brindle.llm.queries import tokenizer
from brindle.llm.suffix_arrays import shared_prefixes, suffix_array


@given(st.lists(st.integers(0, 400), max_size=60), st.integers(0, 40))
@settings(max_examples=100, deadline=None)
def test_every_id_is_in_one_piece_and_sequences_are_gapless(lengths, min_cut):
    seen = {d: [] for d in range(len(lengths))}
    bins = {}
    for d, s, n, b, o in pack(lengths, 100, max(1, min_cut)):
        assert n > 0
        seen[d].append((s, n))
        bins.setdefault(b, []).append((o, n))
    for d, n in enumerate(lengths):
        at = 0
        for s, m in sorted(seen[d]):
            assert s == at
            at += m
        assert at == n
    for pieces in bins.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at <= 100


def test_padding_is_small():
    rng = random.Random(1)
    lengths = [rng.randint(1, 5000) for _ in range(500)]
    bins = {b for *_, b, _ in pack(lengths, 2048)}
    assert sum(lengths) / (2048 * len(bins)) > 0.98


def test_tournament_tree_is_first_fit():
    rng = random.Random(2)
    tree, bins = TournamentTree(200, 100), [100] * 200
    for _ in range(200):
        n = rng.randint(1, 100)
        assert tree.fit(n) == (b := next(i for i, c in enumerate(bins) if c >= n))
        bins[b] -= n


@pytest.mark.parametrize("text", ["", "   ", "a<|endoftext|>B", "<|STARTOFTEXT|>", "don't 'S x\x1cy\x85z w\xa0v 12a3,.;!'s'", "ÀÉ é,. ß. İΣ ς", "x" * 3000, "a\x00b.\nc", "é café."])
def test_word_ids_are_the_librarys(text):
    ids = _Ids(tokenizer("word_bpe_49k.json"))
    assert np.frombuffer(ids.of([text])[0], np.uint16).tolist() == ids.library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["", " ", "\n\n a  b", "it's <|endoftext|> x<|endoftext|>", "=" * 5000, "é 1²½ \x1c\x85", "don't'S 'll", "　漢字 かな"])
def test_token_counts_are_the_librarys(text):
    counts = token_counts.TokenCounts(tokenizer("byte_bpe_50k.json"))
    assert counts.count(text) == len(counts.tokenizer.encode(text, add_special_tokens=False).ids)
    assert len(counts.whole) > 40_000


@given(st.binary(max_size=200) | st.text("ab", max_size=200).map(str.encode))
@settings(max_examples=200, deadline=None)
def test_suffix_arrays_are_sorted(text):
    assert suffix_array(text).tolist() == sorted(range(len(text)), key=lambda i: text[i:])


def test_shared_prefixes():
    rng = random.Random(3)
    text = bytes(rng.choice(b"ab") for _ in range(400)) * 2
    order = suffix_array(text)
    order = order[order <= len(text) - 20]
    got = shared_prefixes(np.frombuffer(text, np.uint8), order, 20)
    assert got.tolist() == [i > 0 and text[order[i] : order[i] + 20] == text[order[i - 1] : order[i - 1] + 20] for i in range(len(order))]


def test_grams_chosen_by_equal_strings_are_equal():
    rng = random.Random(4)
    part = bytes(rng.randrange(256) for _ in range(200))
    t = np.frombuffer(os.urandom(100) + part + os.urandom(70) + part, np.uint8)
    owner, h = substring_dedup.choose_grams(t, 50, step=64)
    assert (h[owner[100:251]] == h[owner[370:521]]).all()
    assert (owner >= np.arange(len(owner))).all() and (owner <= np.arange(len(owner)) + 50 - substring_dedup.GRAM).all()


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(5)
    errors = []
    for n in (3, 20, 200, 3000):
        for _ in range(20):
            pool = rng.integers(0, 2**63, 2 * n, dtype=np.uint64)
            a, b = np.unique(pool[: int(1.5 * n)]), np.unique(pool[int(0.25 * n) :])
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            x, y = minhash.sketch(a), minhash.sketch(b)
            assert (x != np.uint64(0xFFFFFFFFFFFFFFFF)).all()
            errors.append((x == y).mean() - true)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05


def test_shingles_of_short_texts():
    w = WordHash()
    assert len(shingle_set(None, w)) == len(shingle_set(" \n", w)) == 0
    assert len(shingle_set("one two", w)) == 1
    assert set(shingle_set("A b C d e f", w)) == set(shingle_set("a b c d e f", w)) and len(shingle_set("a b c d e f", w)) == 2
    assert not set(shingle_set("a b c d", w)) & set(shingle_set("a b c d e", w))


@pytest.mark.parametrize("n", [0, 1, 64, 181, 182, 183, 184, 185, 365, 366, 367, 368, transport_stream.PES_BYTES - 1, transport_stream.PES_BYTES, transport_stream.PES_BYTES + 1, 200_000])
def test_transport_streams_round_trip(n):
    data = os.urandom(n)
    streams = transport_stream.demux(transport_stream.mux(data))
    s = streams[transport_stream.DATA_PID]
    assert s.data == data and s.discontinuities == 0
    assert len(s.pts) == len(s.random_access) == -(-n // transport_stream.PES_BYTES)
    assert s.pts == [k * transport_stream.CLOCK for k in range(len(s.pts))]


def test_a_lost_packet_is_counted_and_bad_bytes_are_refused():
    data = transport_stream.mux(os.urandom(5000))
    cut = data[: 188 * 6] + data[188 * 7 :]
    with pytest.raises(ValueError):
        transport_stream.demux(cut)  # the elementary packet is cut short
    with pytest.raises(ValueError):
        transport_stream.demux(b"x" * 188)
    twice = data[: 188 * 6] + data[188 * 5 :]
    assert transport_stream.demux(twice)[transport_stream.DATA_PID].discontinuities == 0  # a duplicate packet


def test_extraction():
    page = '<html><body class="has-sidebar"><header>Site</header><div class="wrap"><nav>menu</nav><div id="p7" class="post"><h1>T &amp; t</h1><p>one <b>t</b>wo &lt;x&gt; 2 < 3<p>four&nbsp;five<div class="ad">buy</div><ul><li>x<li>y</ul><div class="comments"><p>me</div></div><aside>s</aside></div><footer>f</footer>'
    assert H.extract(page, None) == "T & t one two <x> 2 < 3 four five x y"
    assert H.extract(None, None) == H.extract("", "body") == H.extract("<p", None) == ""
    assert H.extract("<body><article><p>a<script>x('</p>')</script>b</p></article>", "body article") == "ab"
    assert H.extract('<body><p title="never closed>x</p><p>y</p>', None).endswith("y")


def test_licenses():
    lib = license_scan.Library(license_scan.templates())
    find = lambda t: sorted({lib.names[i] for i in lib.scan(t.encode())[1]})
    noise = "word salad of no licence at all " * 40
    assert find("") == find(noise) == []
    assert find(noise + "Released under the MIT License. " + noise) == ["MIT"]
    assert find("This work is licensed under the GNU General Public License, version 3.") == ["GPL-3.0"]
    assert find("Licensed under CC BY-NC 4.0.") == ["CC-BY-NC-4.0"]
    for name, text in license_scan.TEXTS.items():
        assert name in find(noise + text.upper().replace(" ", "\n ") + noise)
