import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from daybook.llm import jaccard_join, packing, queries
from daybook.llm.components import components


def test_packing_of_a_table(spark):
    d = "/root/testdata/sf0.001"
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    ids = {k: np.array([*library.encode(t, add_special_tokens=False).ids, 1], "<u4") for k, t in texts.items()}
    rows = queries.op4_packing(spark, d).collect()
    check_pieces(rows, ids)
    sizes = sequence_sizes(rows)
    padding = sum(2048 - n for n in sizes.values() if n & (n - 1))
    assert padding < 2048 * spark.read.parquet(f"{d}/documents.parquet").rdd.getNumPartitions()


def sequence_sizes(rows):
    out = {}
    for r in rows:
        out[r.sequence_id] = out.get(r.sequence_id, 0) + r.length
    return out


def check_pieces(rows, ids):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids[r.doc_id])
    assert set(by_doc) == set(ids)
    for k, own in by_doc.items():
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.length > 0
            at += r.length
        assert at == len(ids[k])
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048


def test_packing_units_and_edge_cases(spark):
    rng = random.Random(1)
    texts = ["", None, "a", "x y " * 9000] + [" ".join(rng.choice(["alpha", "beta", "é", "42"]) for _ in range(rng.randrange(900))) for _ in range(120)]
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, sequence_id int").repartition(2)
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids = {i: np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in enumerate(texts)}
    pieces = packing.pack(docs, P.path("byte_bpe_50k.json"), unit_tokens=5000, step_tokens=8192)
    rows = pieces.withColumn("ids_crc32", F.crc32("ids")).collect()
    check_pieces(rows, ids)
    sizes = sequence_sizes(rows)
    assert sum(n & (n - 1) != 0 for n in sizes.values()) <= 2
    assert len({r.tier for r in rows}) > 2 and all(sizes[r.sequence_id] <= r.tier for r in rows)
    assert packing.pack(docs.limit(0), P.path("byte_bpe_50k.json")).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs, P.path("byte_bpe_50k.json"), tiers=(100, 2048))


def test_packing_reads_added_tokens_as_the_library(spark):
    texts = ["hello <|endoftext|> world", "<|endoftext|>", "a<|endoftext|><|endoftext|>b <|endoftext|", "plain", "", "é <|endoftext|>\n\n x"] * 3
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(2)
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids = {i: np.array([*library.encode(t, add_special_tokens=False).ids, 1], "<u4") for i, t in enumerate(texts)}
    check_pieces(packing.pack(docs, P.path("byte_bpe_50k.json")).withColumn("ids_crc32", F.crc32("ids")).collect(), ids)


def test_packing_with_null_and_repeated_ids(spark):
    rows = [(None, "one two"), (None, "one two"), (7, "one two"), (7, "one two"), (7, "three " * 5000)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, offset int, tier string")
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    sizes = sorted(len(library.encode(t, add_special_tokens=False).ids) + 1 for _, t in rows)
    out = packing.pack(docs, P.path("byte_bpe_50k.json")).collect()
    assert sum(r.length for r in out) == sum(sizes)
    assert sum(r.length for r in out if r.doc_id is None) == 2 * sizes[0]
    assert sorted(r.doc_tokens for r in out if r.start == 0) == sizes


def shingles(text, k):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", low) if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)])


def brute(texts, k, num, den):
    sets = {i: shingles(t, k) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    at = {}
    for i, s in sets.items():
        for g in s:
            at.setdefault(g, []).append(i)
    for i, s in sets.items():
        for j in {j for g in s for j in at[g] if j < i}:
            both = len(s & sets[j])
            if den * both >= num * (len(s) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(sets[i]), root(i)) for i in texts}


def near_copies(seed, n, edits):
    """A base text and many copies with a few words changed each: links form chains."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(rng.choice([60, 90, 150]))]
    out = []
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randrange(edits)):
            at = rng.randrange(len(copy))
            copy[at : at + rng.randrange(2)] = [rng.choice(words)] if rng.random() < 0.8 else []
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("k,num", [(3, 90), (5, 80), (2, 60)])
def test_jaccard_equals_brute_force(spark, k, num):
    rng = random.Random(k)
    texts = ["", None, " \n", "one", "One two", "one two", "a b c", "A B C", "a b c d", "É b c", "é b c"]
    for seed in range(6):
        texts += near_copies(seed, 60, 7)
    texts += [" ".join(rng.choice("abcdef") for _ in range(rng.randrange(14))) for _ in range(150)]
    texts += texts[20:40]
    rng.shuffle(texts)
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, component_id int").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.link_documents(docs, k, num, 100).collect()}
    assert got == brute(dict(enumerate(texts)), k, num, 100)


def test_jaccard_on_the_test_table(spark):
    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op5_jaccard_join(spark, d).collect()}
    assert got == brute(texts, 3, 90, 100)


def test_jaccard_edge_cases(spark):
    rows = [(None, "a b c d"), (3, "a b c d"), (7, "a b c d"), (7, "x y z"), (9, "x y z"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.link_documents(docs, 3, 90, 100).collect()), key=str)
    assert got == sorted([(None, 2, None), (3, 2, 3), (7, 2, 3), (7, 1, 3), (9, 1, 3), (4, 0, 4)], key=str)
    assert jaccard_join.link_documents(docs.limit(0), 3, 90, 100).count() == 0


def test_jaccard_of_long_texts(spark):
    """Sets of very different and of large sizes: their parities have more cells, which are folded to compare them."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    texts = []
    for size in (520, 1030, 2040, 9000):
        base = [rng.choice(words) for _ in range(size)]
        for share in (0, 0.01, 0.03, 0.06, 0.1, 0.2):
            copy = list(base)
            for _ in range(int(share * size)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts += [" ".join(copy), " ".join(copy[: int(size * 0.97)]), " ".join(copy + copy[:40])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for k, num in ((3, 90), (1, 50)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.link_documents(docs, k, num, 100).collect()}
        assert got == brute(dict(enumerate(texts)), k, num, 100)


def test_a_hot_n_gram_is_dealt_to_tasks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "CLASSES_A_TASK", 4)
    rng = random.Random(9)
    texts = [" ".join(["same", *rng.sample("abcdefghijkl", rng.randrange(1, 5))]) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.link_documents(docs, 1, 60, 100).collect()}
    assert got == brute(dict(enumerate(texts)), 1, 60, 100)


def test_folded_parities(spark):
    rng = np.random.default_rng(3)
    hashes = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    wide = jaccard_join._parities(hashes)
    narrow = np.bincount((hashes >> np.uint64(20)).astype(np.int64) & 511, minlength=512) & 1
    row = spark.createDataFrame([(wide.tolist(),)], "p array<long>").select(jaccard_join._folded(F.col("p"), F.lit(8)).alias("q")).first()
    assert np.array_equal(np.unpackbits(np.array(row.q, "<i8").view(np.uint8), bitorder="little"), narrow)


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (95, 100), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 95: 90, 100: 90}
