"""The trie of exact contexts against brute force."""

import collections
import math
import random

import numpy as np
import pytest

from brindle.llm import contexts, ppm

ORDER = 5


def brute(train, text):
    seen = collections.defaultdict(collections.Counter)
    symbols = lambda t: [255] * ORDER + [*t.encode().lower(), 255]
    for s in map(symbols, train):
        for i in range(ORDER, len(s)):
            for k in range(ORDER + 1):
                seen[tuple(s[i - k : i])][s[i]] += 1
    s, total = symbols(text), 0.0
    for i in range(ORDER, len(s)):
        p, out = 1.0, set()
        for k in range(ORDER, -1, -1):
            row = {x: c for x, c in seen[tuple(s[i - k : i])].items() if x not in out}
            n, q = sum(row.values()), len(row)
            if s[i] in row:
                p *= (row[s[i]] - 0.5) / n
                break
            p *= q / (2 * n) if q else 1
            out |= set(row)
        else:
            p /= 256 - len(out)
        total += math.log10(p)
    return total


def test_scores_use_every_context_and_every_byte(spark):
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz 0123456789.,;:!?-()[]{}'\"/+*=<>#%&@_~^|жщюяβγδλ漢字かな한글"
    rows = [(i, "".join(rng.choice(letters if i % 2 else "abжщ漢 ") for _ in range(rng.randint(0, 300)))) for i in range(60)] + [(60, None), (61, "Ж漢X"), (None, "ab ab")]
    train = [t or "" for i, t in rows if not ppm.held_out(i)]
    got = ppm.scores(spark, spark.createDataFrame(rows, "doc_id long, text string"), block_docs=9).collect()
    want = {i: brute(train, t or "") for i, t in rows}
    assert {r["doc_id"]: r["score"] for r in got} == pytest.approx(want, abs=1e-6)
    # bytes beyond the 62 most frequent keep their contexts
    rows = [(i, "".join(letters) + " " + "漢字" * 5) for i in range(20)] + [(100, "漢字漢字"), (101, "字漢漢漢")]
    got = {r["doc_id"]: r["score"] for r in ppm.scores(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100] == pytest.approx(brute([t for i, t in rows if not ppm.held_out(i)], "漢字漢字"), abs=1e-6)


def test_merging_and_looking_up_in_many_small_groups_changes_nothing(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(i, "".join(rng.choice("ab c") for _ in range(rng.randint(0, 60)))) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one = sorted(map(tuple, ppm.scores(spark, docs).collect()))
    monkeypatch.setattr(contexts, "FAN", 3)
    many = sorted(map(tuple, ppm.scores(spark, docs, block_docs=4).collect()))
    assert [r[:5] for r in one] == [r[:5] for r in many] and [r[5:] for r in one] == [pytest.approx(r[5:]) for r in many]


def test_the_symbols_after_a_context_share_a_probability_of_one():
    train = [b"abracadabra", b"abba", b"", b"cab"]
    cell, n = contexts.every_order(*contexts.counted(train, 3), 3)
    rows = contexts.Rows(cell, n, 3)
    for context in (b"abr", b"cad", b"zzz", b"\xff\xffa", b"xab"):
        at = int.from_bytes(b"\1" + context, "big") << 8
        assert (10 ** rows.log10(at + np.arange(256))).sum() == pytest.approx(1)
