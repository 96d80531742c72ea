import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from daybook.llm import jaccard_join, line_dedup, quality_rules, queries, shards, toxicity, transcripts
from daybook.llm.common import shared_folder, summed, table

D = "/root/testdata/sf0.001"


def plain_boilerplate(rows, least):
    import re

    word = re.compile(r"[^\x20\x09-\x0D]")
    sites, first = {}, {}
    for doc, text, site in rows:
        for k, line in enumerate(text.split("\n") if text is not None else []):
            if word.search(line):
                key = line.strip(" ")
                if site is not None:
                    sites.setdefault(key, set()).add(site)
                first[key] = min(first.get(key, (1 << 60, 0)), (doc, k))
    gone = {key for key, s in sites.items() if len(s) >= least}
    return {doc: None if text is None else "\n".join(line for k, line in enumerate(text.split("\n")) if line.strip(" ") not in gone or first.get(line.strip(" ")) == (doc, k)) for doc, text, _ in rows}


@pytest.mark.parametrize("least", [2, 5, 12])
def test_line_dedup_equals_brute_force(spark, least):
    rng = random.Random(least)
    pool = [f"line {i}" for i in range(40)] + ["", " ", "\t", " line 3 ", "é x"]
    rows = [(i, None if i == 3 else "\n".join(rng.choice(pool[: rng.randrange(2, 46)]) for _ in range(rng.randrange(9))), rng.choice([None, *(f"s{k}" for k in range(25))])) for i in range(400)]
    docs = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, source string, lines_removed int, a string").repartition(3)
    out = line_dedup.remove_boilerplate(docs, least)
    assert out.count() == 400 and "a" in out.columns
    assert {r.doc_id: r.text for r in out.collect()} == plain_boilerplate(rows, least)
    assert line_dedup.remove_boilerplate(docs.limit(0), least).count() == 0


def test_line_dedup_with_repeated_and_null_ids(spark):
    rows = [(1, "x\ny", f"s{k}") for k in range(3)] + [(None, "x\nq", "s7"), (2, "x", "s8"), (4, "x\n" + "long " * 30000, "s9")]
    out = line_dedup.remove_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string"), 4).collect()
    got = sorted(((r.doc_id, r.text[:3], r.lines_removed) for r in out), key=str)
    assert got == sorted([(1, "y", 1)] * 3 + [(None, "x\nq", 0), (2, "", 1), (4, "lon", 1)], key=str)


def test_line_dedup_with_clashing_columns(spark):
    rows = [(k, "x\ny", f"s{k}", 1, "r", "a", 7) for k in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, row int, removed string, row_a string, lines_before int")
    out = line_dedup.remove_boilerplate(docs, 4)
    assert out.columns == ["doc_id", "text", "source", "row", "removed", "row_a", "lines_before", "lines_removed"]
    assert sorted((r.doc_id, r.text, r.row, r.removed, r.row_a, r.lines_before, r.lines_removed) for r in out.collect()) == [(0, "x\ny", 1, "r", "a", 2, 0)] + [(k, "", 1, "r", "a", 2, 2) for k in (1, 2, 3)]


def test_sums_over_partitions(spark):
    rows = spark.range(1000).repartition(7)
    got = summed(rows, lambda batches: sum((np.bincount(b.column("id").to_numpy() % 10, minlength=10) for b in batches), np.zeros(10, np.int64)), 10)
    assert got.tolist() == [100] * 10


def character_model():
    text = " ".join(["stupid", "idiot", "moron", "trash", "worthless", "hello", "other", "nation", "letter", "street"] * 20)
    table_ = toxicity._code_table()
    codes = np.concatenate([[0, 0], table_[np.frombuffer(text.encode("utf-32-le"), np.uint32)], [0, 0]]).astype(np.int64)
    return np.bincount((codes[:-2] * 64 + codes[1:-1]) * 64 + codes[2:], minlength=64**3)


def test_viterbi_is_the_best_path():
    from itertools import product

    model = toxicity.CharacterModel(character_model())
    for token in ("1d10t", "$t00pid", "stuupid", "m0r*n", "i.d.i.o.t"):
        best = -1e9, ""
        for ways in product(*model.lattice(token)):
            word, cost, p, q = "".join(c for c, _ in ways), sum(x for _, x in ways), 0, 0
            for c in [*word, None]:
                k = model.code.get(c, 63) if c else 0
                cost += float(model.log3[p, q, k])
                p, q = q, k
            best = max(best, (cost, word))
        assert model.decode(token) == best[1]


def test_hidden_words_are_restored():
    restorer = toxicity.Restorer(toxicity.CharacterModel(character_model()))
    for token, word in {"1d10t": "idiot", "st*pid": "stupid", "i.d.i.o.t": "idiot", "stuuupid": "stupid", "tra$h": "trash", "w0rthl3ss": "worthless"}.items():
        assert restorer[token][-1] == word
    assert restorer.restore("You M0R0N and i d i o t") == "you moron and idiot"
    assert restorer["hello"] == ("hello",) and restorer["3.14"] == ()


def test_toxicity_is_learned_and_held_out_rows_are_not_read(spark):
    rng = random.Random(1)
    words = [f"{a}{b}" for a in ("ba", "do", "ki", "lu", "me") for b in ("nan", "tor", "ris", "pel", "gum")]
    bad = ["stupid", "idiot", "moron"]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 4 == 0
        text = [rng.choice(words) for _ in range(30)]
        if toxic:
            text[rng.randrange(30)] = rng.choice(bad if i % 8 else ["st*pid", "1d10t", "m0r0n", "i.d.i.o.t"])
        rows.append((i, " ".join(text), "x", 0.0))
        labels.append((i, int(toxic)))
    rows += [(1000, None, "x", 0.0), (1001, "", "x", 0.0), (None, "idiot", "x", 0.0), (1002, "x " * 40000 + "moron", "x", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double").repartition(3)
    known = spark.createDataFrame(labels + [(None, 1), (5, None)], "doc_id long, toxic int")
    held = toxicity.is_held_out()
    model = toxicity.train(docs, known, held)
    out = {r.doc_id: r for r in toxicity.score(docs, model, restored=True).withColumn("held_out", held).collect()}
    assert len(out) == len(rows)
    truth = dict(labels)
    assert all((out[i].score >= 0.5) == bool(truth[i]) for i in range(600) if out[i].held_out)
    assert out[1000].score == out[1001].score < 0.5 <= out[1002].score and out[None].score >= 0.5 and out[None].held_out is False
    flipped = known.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.train(docs, flipped, held).weights == model.weights
    one_kind = toxicity.train(docs, known.where("toxic = 0"), held)
    assert {r.score for r in toxicity.score(docs, one_kind).collect()} == {toxicity.logistic(-20.0)}
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_toxicity_without_documents_or_of_one_kind(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 20)) for i in range(40)], "doc_id long, toxic int")
    for some in (docs.limit(0), docs):  # labels of both kinds, but no labelled document, or of one kind
        model = toxicity.train(some, labels)
        assert model.weights == {}
        assert {round(r.score, 3) for r in toxicity.score(docs, model).collect()} == {0.5}


def test_scored_rows_keep_their_columns(spark):
    docs = spark.createDataFrame([(None, "a", 3, "s"), (1, None, 4, "s"), (1, None, 4, "s")], "doc_id long, text string, score int, `odd name` string")
    out = toxicity.scored(docs, toxicity.Model(np.zeros(64**3, np.int64), 0.0), names=("p", "n", "r"))
    assert out.columns == [*docs.columns, "p", "n"] and sorted((r.doc_id or 0, r.score, r.p) for r in out.collect()) == [(0, 3, 0.5), (1, 4, 0.5), (1, 4, 0.5)]
    assert toxicity.scored(docs, toxicity.Model(np.zeros(64**3, np.int64), 0.0)).columns == ["doc_id", "text", "odd name", "score", "evidence"]


def test_op6_on_the_test_table(spark):
    rows = {r.doc_id: r for r in queries.op6_toxicity(spark, D).collect()}
    truth = {r.doc_id: r.toxic for r in table(spark, D, "labels").collect() if r.toxic is not None}
    held = [i for i in truth if i in rows and rows[i].held_out]
    assert set(rows) == {r.doc_id for r in table(spark, D, "documents").collect()}
    assert held and sum(rows[i].predicted == truth[i] for i in held) >= 0.9 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows.values())


def test_shards_with_odd_columns_and_rows(spark):
    store = shards.ShardTable(spark, f"{shared_folder(spark)}/shard-test-{random.random()}", target_bytes=1 << 20)
    docs = spark.createDataFrame([(1, "s", "é", "x " * 50_000), (1, "s", "é", "x " * 50_000), (None, None, None, None)], "id long, shard string, `a b` string, text string")
    for _ in range(3):
        store.append(docs.repartition(2))
    store.compact()
    out = store.read()
    assert out.columns == [*docs.columns, "_shard"] and out.count() == 9 and out.where("id IS NULL").count() == 3
    assert out.drop("_shard").distinct().exceptAll(docs.distinct()).count() == 0


def test_shards_that_no_version_names_go(spark):
    store = shards.ShardTable(spark, f"{shared_folder(spark)}/shard-test-{random.random()}")
    store.append(spark.range(10))
    store._written(spark.range(5).coalesce(1), 0)  # as a writer leaves them that fails before it commits
    assert store.vacuum() == 0  # they may be of a writer at work
    assert store.vacuum(orphans_after=0) == 1 and store.read().count() == 10


def test_compaction_is_visible(spark):
    """The query's table is compacted: fewer shards than were appended, none of which could be merged further."""
    store = shards.ShardTable(spark, f"{shared_folder(spark)}/shard-test-{random.random()}")
    store.append(table(spark, D, "documents").repartition(9))
    before, after = store.manifest(), store.compact()
    assert len(before.shards) == 9 and len(after.shards) < 5 and not store.plan(after.shards)
    assert all(x.generation == 1 for x in after.shards) and store.read().count() == table(spark, D, "documents").count()


def test_shards_append_compact_read(spark):
    folder = f"{shared_folder(spark)}/shard-test-{random.random()}"
    store = shards.ShardTable(spark, folder, target_bytes=20_000, fan_in=4)
    assert store.manifest() is None and store.compact() is None
    docs = spark.createDataFrame([(i, None if i % 50 == 0 else f"text {i} " * 20, "é") for i in range(2000)], "id long, text string, shard_name string")
    for part in range(4):
        store.append(docs.where(F.col("id") % 4 == part).repartition(6))
    before = store.manifest()
    assert before.version == 4 and len(before.shards) == 24
    after = store.compact()
    assert 1 < len(after.shards) < 24 and not store.plan(after.shards)
    assert max(s.size for s in after.shards) < 1.5 * 20_000 and max(s.generation for s in after.shards) >= 1
    got = store.read().drop("shard")
    assert got.exceptAll(docs).count() == 0 and docs.exceptAll(got).count() == 0
    old = store.read(before.version)
    assert old.count() == 2000  # an old version still reads
    assert store.vacuum() > 0 and store.read().count() == 2000
    store.append(docs.limit(0))
    assert store.read().count() == 2000
    with pytest.raises(ValueError):
        store.append(docs.select("id"))


def test_shard_commits_are_atomic(spark):
    store = shards.ShardTable(spark, f"{shared_folder(spark)}/shard-test-{random.random()}")
    rows = spark.range(10).toDF("id")
    first = store.append(rows)
    with pytest.raises(shards.Conflict):
        store._commit(first)  # the version is taken
    assert store.manifest() == first
    with pytest.raises(shards.Conflict):
        store._change(first.schema, [], {"/shards/none"})
    assert store.append(rows).version == 2 and store.read().count() == 20


def plain_viterbi(hmm, shown):
    score, paths = hmm.start + shown[0], [[s] for s in range(transcripts.STATES)]
    for row in shown[1:]:
        best = [max(range(transcripts.STATES), key=lambda p: score[p] + hmm.step[p, s]) for s in range(transcripts.STATES)]
        paths = [[*paths[p], s] for s, p in enumerate(best)]
        score = np.array([score[p] + hmm.step[p, s] + row[s] for s, p in enumerate(best)])
    return paths[int(score.argmax())], float(score.max())


def path_score(hmm, shown, path):
    return float(hmm.start[path[0]] + shown[0][path[0]] + sum(hmm.step[a, b] + shown[t + 1][b] for t, (a, b) in enumerate(zip(path, path[1:]))))


def test_transcripts_are_decoded_across_partitions(spark):
    rng = random.Random(3)
    rows = []
    for conv, n in ((1, 300), (2, 5), (3, 1), (None, 40), (4, 150), (5, 2)):
        for k in range(n):
            rows.append((conv, k // 3, k % 3, rng.choice(["User: hi?", "Assistant: yes", "", "more text", "System: be kind", "Bob: what?", "x" * 90, None]), "q"))
    lines = spark.createDataFrame(rows, "conv_id long, turn long, line long, text string, role string")
    hmm = transcripts.Hmm.usual()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in (1, 3, 13, 60):
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            got = {}
            for r in transcripts.parse_transcripts(lines).collect():
                got.setdefault(r.conv_id, []).append(r)
            assert sum(map(len, got.values())) == len(rows)
            for conv, own in got.items():
                own.sort(key=lambda r: r.position)
                texts = [t or "" for c, _, _, t, _ in rows if c == conv]
                shown = transcripts.Stretch(conv, texts, []).scores(hmm, True)
                path = [2 * transcripts.ROLES.index(r.role) + (not r.first) for r in own]
                assert abs(path_score(hmm, shown, path) - plain_viterbi(hmm, shown)[1]) < 1e-6
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert transcripts.parse_transcripts(lines.limit(0)).count() == 0


def test_turns_across_partitions(spark):
    """Turn numbers and rendered rows don't depend on where partitions cut, however long a transcript is."""
    rng = random.Random(4)
    rows = [(conv, k, 0, rng.choice(["User: hi?", "Assistant: yes", "more " * 3, "", "x" * 20_000])) for conv, n in ((1, 120), (2, 1), (3, 60), (None, 30)) for k in range(n)]
    lines = spark.createDataFrame([(*r, "q", 1) for r in rows], "conv_id long, turn long, line long, text string, role string, first int")
    before, seen = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for parts in (1, 4, 17):
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            parsed = transcripts.parse_transcripts(lines).cache()
            numbers = {}
            for r in sorted(parsed.collect(), key=lambda r: r.position):
                own = numbers.setdefault(r.conv_id, [])
                assert r.turn_no == (own[-1] + r.first if own else r.first - 1)
                own.append(r.turn_no)
            seen.append(sorted(map(str, transcripts.render(transcripts.turns(parsed)).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1] == seen[2]


def test_roles_are_recovered(spark):
    lines = transcripts.as_transcript(table(spark, D, "conversations"))
    parsed = transcripts.parse_transcripts(lines)
    both = parsed.join(lines.select("conv_id", "turn", "line", "true_role"), ["conv_id", "turn", "line"])
    assert both.count() == lines.count()
    full = both.where("content <> ''")
    assert full.where("role = true_role").count() >= 0.93 * full.count()
    rows = queries.op9_transcripts(spark, D).collect()
    assert len({(r.conv_id, r.turn_no) for r in rows}) == len(rows)
    form = transcripts.render(transcripts.turns(parsed)).first()
    assert form.rendered == f"<|{form.role}|>\n{form.content}\n<|end|>"


def test_queries_against_sql(spark):
    import duckdb

    for name in ("documents", "embeddings"):
        duckdb.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM '{D}/{name}.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        ours = queries.QUERIES[name](spark, D).toPandas()
        theirs = duckdb.sql(sql).df()[list(ours.columns)]
        key = lambda frame: sorted(map(str, frame.astype(str).itertuples(index=False)))
        assert key(ours) == key(theirs), name


def plain_kept(docs, labels_d, spark):
    """What the first stages keep, from the operators' row-wise answers put together by hand."""
    model = toxicity.train(docs, table(spark, labels_d, "labels"), toxicity.is_held_out())
    scores = sorted((r.doc_id, r.score) for r in toxicity.score(docs, model).collect())
    return {i for i, s in scores if s < 0.5}


def test_pipeline_stages(spark):
    docs = table(spark, D, "documents")
    columns = docs.columns
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, seen, D)
        assert out.columns == columns and 0 < out.count() <= seen.count(), name
        if name == "toxicity":
            assert {r.doc_id for r in out.collect()} == plain_kept(seen, D, spark)
        if name == "quality rules":
            assert {r.doc_id for r in out.collect()} == {r.doc_id for r in quality_rules.judge_quality(seen).where("kept").collect()}
        if name == "near duplicates":
            groups = {r.doc_id: r.component_id for r in jaccard_join.link_documents(seen, 5, 80, 100).collect()}
            assert {r.doc_id for r in out.collect()} == set(groups.values())
        seen = spark.createDataFrame(out.collect(), out.schema)
    pieces = corpus_pipeline.STAGES[-1][1](spark, seen, D)
    kept = {r.doc_id for r in seen.collect()}
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == kept
    direct = corpus_pipeline.run(spark, D)
    tokens = lambda rows: rows.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m"))
    assert tokens(direct).exceptAll(tokens(pieces)).count() == 0 == tokens(pieces).exceptAll(tokens(direct)).count()


def test_pipeline_rows_without_ids(spark):
    rng = random.Random(2)
    words = [f"word{i}" for i in range(2000)]
    text = lambda: " ".join(rng.sample(words, 60))
    bad = "same thing again and over " * 20
    one = text()
    rows = [(None, text()), (None, bad), (5, one), (5, bad), (6, one), (7, None), (8, ""), (9, "x " * 3 + text())]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, score int")
    sound = corpus_pipeline.drop_repetitive(spark, docs, D)
    assert sound.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in sound.collect()) == [0, 5, 6, 9]  # a row without an id goes, one bad row takes no other along
    left = corpus_pipeline.drop_near_duplicates(spark, sound, D)
    assert sorted((r.doc_id or 0) for r in left.collect()) == [0, 5, 9]
    toxic = corpus_pipeline.drop_toxic(spark, docs, D)
    assert toxic.columns == docs.columns
    lines = corpus_pipeline.drop_boilerplate(spark, docs, D)
    assert lines.columns == docs.columns and lines.count() == len(rows)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), D).count() == 0, name
