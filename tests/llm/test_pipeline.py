"""The pipeline's near-duplicate stage and its run() against plain versions, on tables with planted copies."""

import random

import corpus_pipeline
import numpy as np

from wanescope.llm import shingles


def sets_of(texts, k=5):
    out = {}
    for i, t in texts.items():
        w = (t or "").lower().split()
        out[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    return out


def plain_kept(texts):
    """Smallest id of each component of texts whose shingle sets have Jaccard 0.8 or more."""
    sets, least = sets_of(texts), {i: i for i in texts}
    near = {i: [j for j in sets if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])] for i in sets}
    while (now := {i: min(least[j] for j in near[i]) for i in near}) != least:
        least = now
    return {i for i in least if least[i] == i}


def planted(seed=8):
    """Texts with copies of which 1 to 14 of about 330 words are changed: similarities from below 0.8 to above 0.95."""
    rng, texts = random.Random(seed), {}
    words = [f"w{i}" for i in range(3000)]
    for base in range(14):
        own = rng.choices(words, k=rng.randint(300, 360))
        texts[base * 100] = " ".join(own)
        for n in range(1, 15):
            copy = list(own)
            for at in rng.sample(range(len(copy)), n):
                copy[at] = rng.choice(words)
            texts[base * 100 + n] = " ".join(copy)
    texts |= {9001: "", 9002: " \n", 9003: "one two", 9004: "ONE  two", 9005: "one two three"}
    return texts


def test_parities_bound_the_difference():
    """For sets of any two sizes, empty ones too; and they tell sets apart that have little in common."""
    rng = np.random.default_rng(3)
    for _ in range(300):
        pool = np.unique(rng.integers(0, 1 << 64, rng.integers(1, 400), np.uint64))
        a, b = (pool[rng.random(len(pool)) < rng.random()] for _ in "ab")
        assert shingles.differing(shingles.parities(a), shingles.parities(b)) <= len(np.setxor1d(a, b))
    a, b = (np.unique(rng.integers(0, 1 << 64, 1000, np.uint64)) for _ in "ab")
    assert shingles.differing(shingles.parities(a), shingles.parities(b)) * 9 > len(a) + len(b)


def stage(spark, rows, tmp_path):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_duplicate_documents(spark, docs, str(tmp_path)).collect()), key=str)


def test_copies_from_similarity_08(spark, tmp_path):
    """Pairs only, so that no chain hides a lost link; a phrase that all texts of every second pair have is common."""
    texts = {i: t for i, t in planted().items() if i > 9000 or i % 100 in (0, i // 100 + 1)}
    texts = {i: f"{t} " + " ".join(f"tail{j}" for j in range(30)) if i < 9000 and i // 100 % 2 else t for i, t in texts.items()}
    kept = plain_kept(texts)
    assert {i for i, _ in stage(spark, list(texts.items()), tmp_path)} == kept and sum(i not in kept for i in texts if i < 9000) == 8


def test_rows_without_id(spark, tmp_path):
    a, b, c = "a clean text that nobody else has at all", "one text of many words that stands twice in here", "some other clean text without an id either"
    rows = [(1, b), (None, b), (None, a), (None, a), (None, c), (None, ""), (2, None)]
    assert stage(spark, rows, tmp_path) == sorted([(1, b), (None, a), (None, c), (2, None)], key=str)


def test_run(spark, tmp_path, monkeypatch):
    """run() packs what the stages before the near-duplicate stage pass on, less the copies."""
    texts = {i: t for i, t in planted().items() if t.strip()}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "no such words in any text")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    # without labels every score is 0.5; the classifier has a test of its own
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("quality classifier", lambda s, d, f: d), *corpus_pipeline.STAGES[1:]])
    got = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    passed = corpus_pipeline.near_duplicate_lines(spark, docs, str(tmp_path))
    assert got == plain_kept({r.doc_id: r.text for r in passed.collect()})


def test_near_duplicates_send_few_rows_at_once(spark, monkeypatch):
    """Whole texts and sets go to Python in batches of BATCH_ROWS; the session's own bound is back afterwards."""
    key, seen, real = "spark.sql.execution.arrow.maxRecordsPerBatch", [], shingles.prefix_table
    before = spark.conf.get(key)
    monkeypatch.setattr(shingles, "prefix_table", lambda *args: seen.append(int(spark.conf.get(key))) or real(*args))
    docs = spark.createDataFrame([(i, f"a b c d e f g {i % 2}") for i in range(4)], "doc_id long, text string")
    assert corpus_pipeline.near_duplicate_documents(spark, docs, "").count() == 2
    assert seen == [min(1000, int(before))] and spark.conf.get(key) == before
