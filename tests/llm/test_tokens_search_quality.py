import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from daybook.llm import bpe_codec, queries, quality_rules, token_counts, vector_search
from daybook.llm.byte_bpe import ByteBpe, merge_pairs, packed, read_ranks

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
ALPHABET = "abst're vemld'  \n\t\r é1²٣ß'' 　 \x85漢!?$😀'll're've S'S"
EDGE = ["", None, "'s's's", "''s", "x's't're", "a" * 5000 + " " * 3000, "!" * 999, "\n" * 50 + "x", " \n a", "word\n\n"]


def library(path):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(path), special_tokens={})


def fuzz(n, seed=1):
    rng = random.Random(seed)
    return EDGE + ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(60))) for _ in range(n)]


def test_encoding_equals_the_library_and_decodes():
    import pyarrow as pa

    texts, theirs, ours = fuzz(2000), library(RANKS), ByteBpe(read_ranks(RANKS))
    for most in (300, 1 << 20):
        for i, j, data, bounds in packed(pa.array(texts, pa.string()), most):
            out = ours.encode(data, bounds)
            for k in range(i, j):
                ids = out.ids[out.bounds[k - i] : out.bounds[k - i + 1]]
                assert ids.tolist() == theirs.encode_ordinary(texts[k] or "")
                assert ours.decode(ids.astype(np.int64)) == (texts[k] or "").encode()


def test_long_pieces_take_the_heap():
    ranks, theirs = read_ranks(RANKS), library(RANKS)
    rng = random.Random(2)
    for _ in range(20):
        piece = "".join(rng.choice("abé") for _ in range(400))
        assert list(merge_pairs(piece.encode(), ranks)) == theirs.encode_ordinary(piece)


def test_codec_on_a_table(spark):
    texts, theirs = fuzz(50), library(RANKS)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, "a", "x", 1), (0, "", "x", 1)], "doc_id long, text string, ids string, starts int")
    rows = bpe_codec.encode(docs, RANKS).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        if r.doc_id is not None:
            assert np.frombuffer(r.ids, "<u4").tolist() == theirs.encode_ordinary(texts[r.doc_id] or "")
    back = {r.doc_id: bytes(r.decoded) for r in bpe_codec.decode(bpe_codec.encode(docs, RANKS), RANKS).collect()}
    assert all(back[i] == (t or "").encode() for i, t in enumerate(texts))
    assert bpe_codec.encode(docs.limit(0), RANKS).count() == 0


def test_op3_on_a_table(spark):
    d = "/root/testdata/sf0.001"
    theirs = library(RANKS)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = queries.op3_bpe_codec(spark, d).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = theirs.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def by_hand(text, rule, theirs):
    """Tokens of each line, one token at a time."""
    data, at, lines, n = text.encode(), 0, [], {}
    for line in text.splitlines(keepends=True) if not set("\r\x0b\x0c\x1c\x1d\x1e\x85  ") & set(text) else [x for x in text.replace("\n", "\n\0").split("\0") if x]:
        lines.append((at, at := at + len(line.encode())))
    at = 0
    for token in theirs.encode_ordinary(text):
        a, b = at, at + len(theirs.decode_single_token_bytes(token))
        shares = [(min(b, y) - max(a, x), -k) for k, (x, y) in enumerate(lines) if min(b, y) > max(a, x)]
        k = {"majority": -max(shares)[1], "start": min(-s[1] for s in shares), "end": max(-s[1] for s in shares)}[rule]
        n[k] = n.get(k, 0) + 1
        at = b
    assert at == len(data)
    return n


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts_of_lines(spark, rule):
    texts, theirs = [t for t in fuzz(150, 3)] + ["\n\n\n\nabc", "a\n\n\n\n\n\nb"], library(RANKS)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in token_counts.count_tokens(docs, RANKS, rule).collect():
        got.setdefault(r.doc_id, {})[r.section] = r
    for i, text in enumerate(texts):
        want = by_hand(text or "", rule, theirs)
        assert {k: r.n_tokens for k, r in got[i].items() if r.n_tokens} == want
        pieces = [(text or "")[r.char_start : r.char_end] for _, r in sorted(got[i].items())]
        assert "".join(pieces) == (text or "")


def test_token_counts_of_spans(spark):
    rows = [(1, "Hello world again", [(0, 5), (5, 11)]), (2, "abc", None), (3, "", []), (4, "Hello world", [(0, 8), (3, 11), (11, 11)]), (5, None, [(0, 4)])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans array<struct<start:int,end:int>>")
    got = {(r.doc_id, r.section): (r.char_start, r.char_end, r.n_tokens, r.n_crossing) for r in token_counts.count_tokens(docs, RANKS, spans="spans").collect()}
    assert sum(v[2] for k, v in got.items() if k[0] == 1) == len(library(RANKS).encode_ordinary(rows[0][1]))
    assert got[(1, -1)][2] >= 1 and got[(2, -1)][2] >= 1 and got[(3, -1)][2] == 0
    assert got[(4, 1)][:2] == (8, 11) and got[(4, 2)][2] == 0 and got[(5, 0)][2] == 0
    with pytest.raises(ValueError):
        token_counts.count_tokens(docs, RANKS, "other")


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(700, 16)).round(2)
    x[100:200] = x[50]  # ties
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)] + [(900, None), (1000, [1.0, None] * 8), (1100, [float("nan")] * 16), (1200, [float("inf")] * 16), (1300, []), (1400, [1.0, 2.0]), (None, [1.0] * 16)]
    got = {}
    for r in vector_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), F.col("vec_id") % 100 == 0, block=128, query_block=3).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    w = np.floor(1024 * x).astype(np.int64)
    assert set(got) == {0, 100, 200, 300, 400, 500, 600}
    for q in got:
        s = w @ w[q]
        best = sorted((i for i in range(700) if i != q), key=lambda i: (-s[i], i))[:10]
        assert sorted(got[q]) == [(k + 1, i, s[i]) for k, i in enumerate(best)]


def test_top_k_with_few_or_large_values(spark):
    docs = spark.createDataFrame([(0, [1e9, 2.0]), (1, [1.0, 1.0]), (2, [2.0, 0.0])], "vec_id long, embedding array<double>")
    got = sorted((r["rank"], r.vec_id, r.score) for r in vector_search.top_k(docs, F.col("vec_id") == 0).collect())
    a = 1024 * 10**9
    assert got == [(1, 2, a * 2048), (2, 1, a * 1024 + 2048 * 1024)]
    assert vector_search.top_k(docs.limit(0), F.col("vec_id") == 0).count() == 0


def test_top_k_with_repeated_rows(spark):
    """A repeated row is a candidate as often as it is there; each row of a query id has results of its own; other columns
    and empty vectors do no harm."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 8)).round(2)
    rows = [(i, [float(v) for v in x[i]]) for i in range(40)] + [(0, [float(v) for v in x[0]]), (3, [float(v) for v in x[3]]), (90, []), (91, []), (90, [])]
    docs = spark.createDataFrame([(*r, 5, "x") for r in rows], "vec_id long, embedding array<double>, rank int, score string").repartition(3)
    got = {}
    for r in vector_search.top_k(docs, F.col("vec_id").isin(0, 90), k=5, block=16, query_block=1).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    w = np.floor(1024 * x).astype(np.int64) @ np.floor(1024 * x[0]).astype(np.int64)
    best = sorted([i for i in range(1, 40)] + [3], key=lambda i: (-w[i], i))[:5]
    assert sorted(got[0]) == sorted([(k + 1, i, w[i]) for k, i in enumerate(best)] * 2)
    assert sorted(got[90]) == [(1, 91, 0)] * 2


def test_top_k_bounds_never_lose(spark):
    """Blocks of clustered vectors: levels drop most pairs, and what is left is what brute force finds."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(12, 32)) * 10
    x = np.floor(1024 * (centres[rng.integers(0, 12, 3000)] + rng.normal(size=(3000, 32))))
    q = vector_search.Block(np.arange(50), x[:50])
    best = vector_search.Best(q, 10)
    for i in range(0, 3000, 500):
        best.meet(vector_search.Block(np.arange(i, min(i + 500, 3000)), x[i : i + 500]))
    exact = x[:50] @ x.T
    for k in range(50):
        exact[k, k] = -np.inf
        want = sorted(range(3000), key=lambda j: (-exact[k, j], j))[:10]
        assert best.found[1][best.found[0] == k].tolist() == want
    for n in vector_search.levels(32):
        assert (q.stats(n) @ vector_search.Block(np.arange(3000), x).stats(n).T >= x[:50] @ x.T - 1e-3).all()


def test_token_counts_edge_cases(spark):
    rows = [(None, "a b"), (None, "a b"), (1, "x\ny"), (1, "x\ny"), (2, "word " * 40_000), (3, None)]
    docs = spark.createDataFrame([(*r, 9, "z") for r in rows], "doc_id long, text string, section int, n_tokens string")
    theirs, got = library(RANKS), {}
    for r in token_counts.count_tokens(docs, RANKS).collect():
        got.setdefault(r.doc_id, []).append((r.section, r.n_tokens))
    assert got[None] == [(0, 2)] * 2 and sorted(s for s, _ in got[1]) == [0, 0, 1, 1]
    assert got[2] == [(0, len(theirs.encode_ordinary(rows[4][1])))] and got[3] == [(0, 0)]
    assert token_counts.count_tokens(docs.limit(0), RANKS).count() == 0


def test_op1_on_a_table(spark):
    d = "/root/testdata/sf0.001"
    theirs = library(queries.vocabulary("byte_bpe_50k.tiktoken"))
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = {}
    for r in queries.op1_token_counts(spark, d).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.n_tokens
    assert got == {i: len(theirs.encode_ordinary(t)) for i, t in texts.items()}


def plain_quality(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text) if w]
    windows = {}
    for i in range(len(words) - 4):
        windows.setdefault(tuple(words[i : i + 5]), []).append(i)
    hit = {i + d for at in windows.values() if len(at) > 1 for i in at for d in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        dup += line in seen and bool(__import__("re").search(r"[^\x20\x09-\x0D]", line))
        seen.add(line)
    best = [max([0, *(next((k for k in range(len(words) - max(i, j)) if words[i + k] != words[j + k]), len(words) - max(i, j)) for j in range(len(words)) if j != i)]) for i in range(len(words))]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit), max(best, default=0)


def test_quality_equals_brute_force(spark):
    rng = random.Random(4)
    texts = ["", None, "one", "a b c d e " * 30, "é#\n\x0b\x1c\x85x é#"]
    texts += ["".join(rng.choice(["a", "b", "é", "#"]) + rng.choice([" ", "\n", "\t", "  "]) for _ in range(rng.randrange(60))) for _ in range(200)]
    docs = spark.createDataFrame([(i, t, True) for i, t in enumerate(texts)] + [(None, "x", True)], "doc_id long, text string, kept boolean")
    rows = quality_rules.judge_quality(docs).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        if r.doc_id is None:
            continue
        n = plain_quality(texts[r.doc_id] or "")
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.longest_repeat) == n
        assert r.base_failed == (n[0] < 10 or 100 * n[4] > 20 * n[0]) and not (r.base_failed and r.kept)


def test_quality_verdict(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    clean = " ".join(rng.sample(words, 1000))
    passage = " ".join(rng.sample(words, 70))
    docs = spark.createDataFrame([(1, clean), (2, f"{clean} {passage} x {passage}"), (3, clean.replace(" ", "\n"))], "doc_id long, text string")
    assert {r.doc_id: (r.base_failed, r.kept) for r in quality_rules.judge_quality(docs).collect()} == {1: (False, True), 2: (False, False), 3: (False, True)}


def test_quality_edge_cases(spark):
    rng = random.Random(6)
    long = " ".join(f"w{rng.randrange(10**9)}" for _ in range(60_000))
    rows = [(1, long), (2, "same " * 50_000), (3, long), (3, long), (None, None)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n_words string")
    got = sorted(((r.doc_id or 0, r.n_words, r.base_failed, r.kept) for r in quality_rules.judge_quality(docs).collect()))
    assert got == [(0, 0, True, False), (1, 60_000, False, True), (2, 50_000, True, False), (3, 60_000, False, True), (3, 60_000, False, True)]
    kept = quality_rules.keep_sound(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 3]
    assert quality_rules.judge_quality(docs.limit(0)).count() == 0 == quality_rules.keep_sound(docs.limit(0)).count()
