"""Corpus operators on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import collections
import hashlib
import math
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from brindle.llm import html_extraction, license_scan, minhash, mixing, packing, ppm, quality_rules, queries, substring_dedup, token_counts, transport_stream
from brindle.llm.queries import tokenizer

SF = "/root/testdata/sf0.001"
KIND = "doc_id long, text string, lang string, source string, n_chars long, size long, kept boolean, bucket int, start long"


def words(text):
    return (text or "").encode().split()


def rows():
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    base = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(60, 120))) for _ in range(12)]
    texts = [*base]
    for t in base[:6]:  # near copies, a word in forty changed
        w = t.split()
        texts.append(" ".join(rng.choice(vocabulary) if rng.random() < 0.02 else x for x in w))
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    texts += [f"{x[:90]} {passage} {x[-80:]}" for x in base[6:10]]
    texts += [base[0], base[0], base[3].upper(), None, "", " \n\t ", "one", "two words", "é ü ß ñ", "x" * 3000, "same line\nsame line\nother\n\nsame line", passage * 30, "<|endoftext|> and 漢字", "##$ ** && || " * 40]
    out = [(i, t, "en", ["a", "b", None, "c"][i % 4], len(t or ""), 1, True, 2, 3) for i, t in enumerate(texts)]
    return [*out, out[1], out[1], (None, base[1], None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None), (-5, base[2], "x", "a", 1, 1, True, 1, 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), KIND).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], KIND)


def test_empty_tables_give_no_rows(spark, empty):
    tk = tokenizer("byte_bpe_50k.json")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    for out in (
        packing.pack_sequences(empty, tokenizer("word_bpe_49k.json")), token_counts.count_tokens(empty, tk), mixing.mix(empty), transport_stream.digests(transport_stream.store(empty)), license_scan.scan(empty),
        minhash.near_duplicates(spark, empty), substring_dedup.remove_repeats(spark, empty), ppm.scores(spark, empty), html_extraction.main_texts(spark, pages), quality_rules.digest(empty, quality_rules.learn(spark, empty, labels)),
    ):
        assert out.count() == 0


def test_packing(docs):
    out = packing.pack_sequences(docs, tokenizer("word_bpe_49k.json"), length=64, group_docs=10).collect()
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    want = collections.Counter((r[0], len(tk.encode(r[1] or "", add_special_tokens=False).ids) + 1) for r in rows())
    got = collections.Counter()
    for (doc, n), times in want.items():
        pieces = [r for r in out if r["doc_id"] == doc and r["doc_tokens"] == n]
        assert sum(r["length"] for r in pieces) == n * times
        got[doc, n] = sum(r["start"] == 0 for r in pieces)
    assert got == want
    by = collections.defaultdict(list)
    for r in out:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for v in by.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= 64


def sets():
    out = []
    for r in rows():
        w = [x.lower() for x in words(r[1])]
        out.append((r[0], frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])))
    return out


def test_near_duplicates_are_brute_forces(spark, docs):
    s = [(d, x) for d, x in sets() if d is not None]
    parent = {d: d for d, _ in s}

    def top(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a, x in s:
        for b, y in s:
            if x and y and 100 * len(x & y) >= 75 * len(x | y) and top(a) != top(b):
                parent[max(top(a), top(b))] = min(top(a), top(b))
    got = minhash.near_duplicates(spark, docs).collect()
    assert len(got) == len(rows())
    size = dict(s)
    for r in got:
        if r["doc_id"] is None:
            assert r["kept"] and r["component_id"] is None
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(size[r["doc_id"]]), top(r["doc_id"]), top(r["doc_id"]) == r["doc_id"])
    kept = minhash.keep_one(spark, docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted({r["doc_id"] for r in got if r["kept"] and r["doc_id"] is not None})


def test_a_crowd_of_chained_near_copies_is_one_component(spark, monkeypatch):
    """Neighbours in a chain are similar, its ends are not; every bucket is split into small parts."""
    monkeypatch.setattr(minhash, "CROWD", 8)
    rng = random.Random(8)
    w = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    chain = []
    for i in range(60):
        w = list(w)
        w[(i * 13) % 200] = f"n{i}"
        chain.append((1000 - i, " ".join(w)))
    out = minhash.near_duplicates(spark, spark.createDataFrame(chain, "doc_id long, text string")).collect()
    assert {r["component_id"] for r in out} == {941}


def test_rows_of_one_document_with_different_texts_share_their_links(spark):
    rng = random.Random(11)
    text = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(80))
    a, b, c, d = (text() for _ in range(4))
    near = lambda t: t + " more"
    table = [(3, a), (5, near(a)), (5, b), (7, near(b)), (7, None), (9, c), (9, d), (4, near(d)), (8, near(c)), (9, c), (12, "alone")]
    got = collections.Counter((r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(spark, spark.createDataFrame(table, "doc_id long, text string")).collect())
    want = [(3, 3, True), (5, 3, False), (5, 3, False), (7, 3, False), (7, 7, True), (9, 4, False), (9, 4, False), (9, 4, False), (4, 4, True), (8, 4, False), (12, 12, True)]
    assert got == collections.Counter(want)


def removed_by_brute_force(table, length=50):
    first = {}
    for d, t in sorted(((d, (t or "").encode()) for d, t in table if d is not None), key=lambda r: r[0]):
        for i in range(len(t) - length + 1):
            first.setdefault(t[i : i + length], d)
    out = collections.Counter()
    for d, text in table:
        t = (text or "").encode()
        gone = [False] * len(t)
        for i in range(len(t) - length + 1 if d is not None else 0):
            if first[t[i : i + length]] < d:
                gone[i : i + length] = [True] * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[d, len(t), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()] += 1
    return out


def test_repeated_passages_are_brute_forces(spark, docs):
    got = substring_dedup.remove_repeats(spark, docs, bucket_docs=5, shards=3).collect()
    assert collections.Counter(map(tuple, got)) == removed_by_brute_force([(r[0], r[1]) for r in rows()])


def test_repeats_in_periodic_and_random_bytes(spark):
    rng = random.Random(9)
    part = "".join(rng.choice("abé") for _ in range(300))
    table = [(i, rng.choice(["=" * rng.randint(0, 200), "abc " * rng.randint(0, 60), part[rng.randrange(200) :], part[: rng.randrange(300)] + "q", "".join(rng.choice("xy") for _ in range(120))])) for i in range(40)]
    docs = spark.createDataFrame(table, "doc_id long, text string")
    for crowded, length in ((64, 50), (0, 50), (2, 50), (1, 31), (0, 24)):  # grams are split in few buckets or many
        got = substring_dedup.remove_repeats(spark, docs, length, bucket_docs=7, shards=4, crowded=crowded).collect()
        assert collections.Counter(map(tuple, got)) == removed_by_brute_force(table, length)


def test_the_stage_keeps_rows_and_columns(spark, docs):
    out = substring_dedup.strip_stage(spark, docs)
    assert out.columns == docs.columns and out.count() == len(rows())
    for r in out.collect():
        assert r["text"] is None or "�" not in r["text"]
    assert {r["text"] for r in out.where("doc_id = 22").collect()} == {""}  # an exact copy


def test_token_counts(docs):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    got = collections.Counter(map(tuple, token_counts.count_tokens(docs, tokenizer("byte_bpe_50k.json"), limit=100).collect()))
    assert got == collections.Counter((r[0], len((r[1] or "").encode()), n := len(tk.encode(r[1] or "", add_special_tokens=False).ids), n > 100) for r in rows())


def test_pages(spark):
    page = lambda text, cls: f'<html><body><div class="{cls}"><p>{text}</p></div><div class="menu">m</div></body></html>'
    table = [(i, f"http://Host.example/{i}", page(f"text {i} " * 20, f"post p{i}")) for i in range(5)] + [(5, None, None), (6, "not a url", ""), (7, "http://host.example/7", "<p>alone &amp; well"), (7, "http://host.example/7", "<p>alone &amp; well")]
    got = html_extraction.main_texts(spark, spark.createDataFrame(table, "page_id long, url string, html string").withColumn("host", F.lit(1))).collect()
    assert len(got) == len(table)
    by = {r["page_id"]: r for r in got}
    assert by[3]["text"] == ("text 3 " * 20).strip() and by[3]["n_chars"] == len(by[3]["text"])
    assert by[5]["text"] == by[6]["text"] == "" and by[7]["text"] == "alone & well"


def test_mixing(docs):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows())
    total = sum(len(words(r[1])) for r in rows())
    source = {t["source_size"]: t["target"] for t in got}
    assert abs(sum(source.values()) - total) < 1e-6 * total
    for r in got:
        assert r["taken"] in (r["copies"] * r["size"],) and r["taken"] <= 3 * r["size"] and r["target"] <= 3 * r["source_size"] + 1e-9
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()), key=str)


def test_slices_change_nothing_and_spread_the_keys(spark, docs):
    one = sorted(map(tuple, mixing.mix(docs, slices=1).collect()), key=str)
    assert one == sorted(map(tuple, mixing.mix(docs, slices=1000).collect()), key=str)
    # documents of any quality, and those without id, lie in many slices
    curve = lambda key: 1 - sum(math.exp(-key * r) for r in mixing.RATES) / len(mixing.RATES)
    rng = random.Random(3)
    for q in (1.0, 0.7, 0.3, 0.12, 0.05):
        held = collections.Counter(int(512 * curve(-math.log(rng.random()) / q)) for _ in range(50_000))
        assert max(held.values()) < 8 * 50_000 / 512
    keys = spark.createDataFrame([(None, f"text {i}") for i in range(50)], "doc_id long, text string").select(mixing.uniform(F.col("doc_id"), F.col("text")).alias("u")).distinct().count()
    assert keys == 50


def test_mixing_is_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.execute(queries.OP6_SQL).fetchall()
    got = [tuple(r) for r in queries.op6_mixing(spark, SF).select("doc_id", "size", "source_size", "target", "taken").collect()]
    assert sorted(got) == sorted(want)


def counts_by_brute_force(text):
    t = text or ""
    w = words(t)
    triples = collections.Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i in range(len(w) - 2) for k in range(3) if triples[w[i], w[i + 1], w[i + 2]] > 1}
    lines = [x for x in t.split("\n") if x.encode().split()]
    return len(w), sum(len(x.decode()) for x in w), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(docs):
    got = quality_rules.digest(docs, quality_rules.DecisionList()).collect()
    want = collections.Counter()
    for r in rows():
        c = counts_by_brute_force(r[1])
        bad = c[0] < 50 or 100 * c[4] > 50 * c[0]
        want[(r[0], *c, bad, not bad)] += 1
    assert collections.Counter(map(tuple, got)) == want


def test_the_decision_list_learns_and_keeps_clean_documents(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    more = labels.unionByName(labels.limit(3)).unionByName(spark.createDataFrame([(None, 0, 0), (10**9, 0, 0), (1, None, None)], labels.schema))
    rules = quality_rules.learn(spark, docs, more)
    assert rules.rules
    judged = quality_rules.digest(docs, rules).join(labels, "doc_id").where("not base_failed").collect()
    clean = [r["kept"] for r in judged if r["quality"] == 1]
    bad = [r["kept"] for r in judged if r["quality"] == 0]
    assert all(clean) and sum(bad) <= 0.2 * len(bad)


def test_scores(spark, docs):
    got = ppm.scores(spark, docs, block_docs=5).collect()
    train = [r for r in rows() if zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 7 != 2]
    c = collections.Counter()
    for r in train:
        c.update(x.lower() for x in words(r[1]))
        c[b""] += 1
    n, v = sum(c.values()), len(c)
    want = collections.Counter()
    for r in rows():
        w = [*(x.lower() for x in words(r[1])), b""]
        want[r[0], r not in train and zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 7 == 2, len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 6)] += 1
    assert collections.Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 for r in got)


def test_licenses(docs):
    got = license_scan.scan(docs.withColumn("text", F.when(F.col("doc_id") == 3, F.concat("text", F.lit("\nReleased under the MIT License."))).otherwise(F.col("text")))).collect()
    assert len(got) == len(rows())
    assert {r["doc_id"]: r["licenses"] for r in got if r["n_licenses"]} == {3: "MIT"}


def test_media(docs):
    stored = transport_stream.store(docs)
    got = transport_stream.digests(stored).collect()
    want = collections.Counter()
    for r in rows():
        raw = (r[1] or "").encode()
        p = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        want[r[0], len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])] += 1
    assert collections.Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got) == want
    broken = stored.withColumn("media", F.when(F.col("doc_id") == 1, F.lit(b"nope")).when(F.col("doc_id") == 2, F.lit(None)).otherwise(F.col("media")))
    parsed = transport_stream.parse_column(broken).collect()
    assert {r["doc_id"] for r in parsed if r["stream"] is None} == {1, 2}
    assert all(r["stream"][0]["random_access"] == [0] for r in parsed if r["stream"] is not None)
