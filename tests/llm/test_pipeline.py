"""The pipeline's stages, each against a brute-force version on its own input."""

import collections
import hashlib
import math

import corpus_pipeline as P
from brindle.llm import quality_rules
from brindle.llm.common import cut
from brindle.llm.queries import tokenizer

SF = "/root/testdata/sf0.001"


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def kept_by_brute_force(rows):
    s = {r["doc_id"]: shingles(r["text"]) for r in rows}
    parent = {d: d for d in s}

    def top(d):
        while parent[d] != d:
            d = parent[d]
        return d

    ids = sorted(s)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if s[a] and s[b] and 100 * len(s[a] & s[b]) >= 75 * len(s[a] | s[b]) and top(a) != top(b):
                parent[max(top(a), top(b))] = min(top(a), top(b))
    return {d for d in ids if top(d) == d}


def stripped_by_brute_force(rows, length=50):
    first, out = {}, {}
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        t = r["text"].encode()
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if first.setdefault(t[i : i + length], r["doc_id"]) < r["doc_id"]:
                gone[i : i + length] = [True] * length
        out[r["doc_id"]] = bytes(b for b, g in zip(t, gone) if not g).decode("utf-8", "ignore")
    return out


def mixed_by_brute_force(rows):
    size = lambda t: len((t or "").encode().split())
    own = collections.defaultdict(list)
    for r in rows:
        own[r["source"]].append(r)
    names = sorted(own)
    w = {s: i % 3 + 1 for i, s in enumerate(names)}
    total = {s: sum(size(r["text"]) for r in own[s]) for s in names}
    target, left, free = {}, sum(total.values()), set(names)
    while free:
        level = left / sum(w[s] for s in free)
        over = [s for s in free if level * w[s] >= 3 * total[s]]
        if not over:
            target |= {s: level * w[s] for s in free}
            break
        for s in over:
            target[s] = 3.0 * total[s]
            left -= 3 * total[s]
            free.remove(s)
    copies = {}
    for s in names:

        def key(r):
            u = (int(hashlib.md5(str(r["doc_id"]).encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            t = r["text"] or ""
            good = max(0.05, 1 - sum(t.count(c) for c in "#*$%&|<>") / max(len(t), 1)) if t else 0.05
            return -math.log(u) / good

        epochs = int(target[s] // total[s]) if total[s] else 1
        rest, at = target[s] - epochs * total[s], 0
        for r in sorted(own[s], key=lambda r: (key(r), r["doc_id"])):
            n = size(r["text"])
            copies[r["doc_id"]] = epochs + int(total[s] > 0 and rest > 0 and at + n / 2 <= rest)
            at += n
    return copies


def test_each_stage_is_its_brute_force(spark):
    source = spark.read.parquet(f"{SF}/documents.parquet")
    docs, after = source, []
    for k, (_, stage) in enumerate(P.STAGES):
        docs = cut(spark, stage(spark, docs, SF))
        if k < len(P.STAGES) - 1:
            assert docs.columns == source.columns
        after.append([r.asDict() for r in docs.collect()])
    raw = [r.asDict() for r in source.collect()]

    rules = quality_rules.learn(spark, source, spark.read.parquet(f"{SF}/labels.parquet"))
    good = {r["doc_id"] for r in quality_rules.digest(source, rules).where("kept").collect()}
    assert {r["doc_id"] for r in after[0]} == good and len(after[0]) == len(good)
    text = {r["doc_id"]: r["text"] for r in raw}
    assert all(text[r["doc_id"]] == r["text"] for r in after[0])

    assert {r["doc_id"] for r in after[1]} == kept_by_brute_force(after[0]) and all(text[r["doc_id"]] == r["text"] for r in after[1])

    want = stripped_by_brute_force(after[1])
    assert {r["doc_id"]: r["text"] for r in after[2]} == want and all(r["n_chars"] == len(r["text"]) for r in after[2])

    copies = mixed_by_brute_force(after[2])
    assert collections.Counter(r["doc_id"] for r in after[3]) == {d: n for d, n in copies.items() if n}

    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    n = {d: len(tk.encode(t, add_special_tokens=False).ids) + 1 for d, t in want.items()}
    got = collections.Counter()
    for r in after[4]:
        assert r["doc_tokens"] == n[r["doc_id"]]
        got[r["doc_id"]] += r["length"]
    assert got == {d: n[d] * c for d, c in copies.items() if c}
