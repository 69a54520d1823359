"""Shards, Merkle manifests and vector codes against plain versions, and on odd rows."""

import hashlib
import random
import zlib
from itertools import groupby

import numpy as np
import pytest
from pyspark.sql import functions as F

from wanescope.llm import merkle, sharding, vector_codes


def plain_shards(texts, n):
    """Capacity by dynamic programming over all groups in order, cut greedily; groups over an even share alone, largest first."""
    groups = {}
    for t in texts:
        k = hashlib.md5((t or "").encode()).hexdigest()
        groups[k] = groups.get(k, 0) + len((t or "").encode()) + 1
    alone, left, rest = [], n, sum(groups.values())
    for k, s in sorted(groups.items(), key=lambda x: (-x[1], x[0])):
        if s * left <= rest:
            break
        alone.append(k)
        left, rest = left - 1, rest - s
    keys = sorted(set(groups) - set(alone))
    ends = np.cumsum([0] + [groups[k] for k in keys])
    best = ends.copy()  # largest shard of the first i groups in one shard
    for _ in range(left - 1):
        best = np.array([min(max(best[j], ends[i] - ends[j]) for j in range(i + 1)) for i in range(len(ends))])
    out, shard, start = {k: i for i, k in enumerate(alone)}, len(alone), 0
    for k, end in zip(keys, ends[1:]):
        if end - start > best[-1]:
            shard, start = shard + 1, end - groups[k]
        out[k] = shard
    return out


@pytest.mark.parametrize("name, texts", [
    ("many", [f"text {i} " * (i * 7919 % 40) for i in range(700)]),
    ("copies", ["the same"] * 500 + ["other long copy " * 30] * 40 + [f"text {i}" for i in range(300)]),
    ("few", ["a", "b", "b", None, ""]),
    ("one", ["x" * 10] * 7),
    ("large", ["y" * 200_000, "é" * 3, None] + [f"t{i}" * 50 for i in range(60)]),
])
def test_shards_are_as_small_as_can_be(spark, monkeypatch, name, texts):
    monkeypatch.setattr(sharding, "FIRST_DIGITS", 1)  # so that prefixes with several groups must be looked into
    docs = spark.createDataFrame([(i if i % 9 else None, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, shard string").repartition(3)
    rows = sharding.assign(docs, 8).collect()
    assert len(rows) == len(texts)
    want = plain_shards(texts, 8)
    by_id = {i: t for i, t in enumerate(texts)}
    for r in rows:
        if r.doc_id is not None:
            t = (by_id[r.doc_id] or "").encode()
            assert (r.size, r.text_crc32, r.shard) == (len(t) + 1, zlib.crc32(t), want[hashlib.md5(t).hexdigest()])
    for s in range(8):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))


def test_shards_of_nothing_and_written_ones(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string, size long")
    assert sharding.assign(empty).count() == 0
    docs = spark.createDataFrame([(i, f"t{i % 5}", i) for i in range(50)], "doc_id long, text string, extra long")
    sharding.write_shards(docs, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 50 and back.select("text", "shard").distinct().count() == 5
    with pytest.raises(ValueError, match="carried"):
        sharding.assign(empty, carry=("size",))


def digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


def plain_tree(leaves, fanout):
    """Root, and each leaf's siblings level by level as (left, right)."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for path, i in zip(paths, at):
            run = level[i // fanout * fanout : i // fanout * fanout + fanout]
            path.append(("".join(run[: i % fanout]), "".join(run[i % fanout + 1 :])))
        level = [digest("".join(level[i : i + fanout])) for i in range(0, len(level), fanout)]
        at = [i // fanout for i in at]
    return level[0], paths


def plain_record(row):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


@pytest.mark.parametrize("levels", [1, 2, 5])
def test_manifest(spark, levels):
    rng = random.Random(levels)
    counts = {None: 3, "": 1, "a": 28, "é": 10, "b/c": 81, "z": 82}
    rows = [(rng.choice([None, *range(500)]), s, rng.choice(["en", None]), rng.randint(0, 9), rng.choice([None, "", "x\ny", "long " * 500])) for s, n in counts.items() for _ in range(n)]
    rows += rows[:5]
    docs = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, idx int, digest string").repartition(5)
    found = merkle.manifest(docs, {"mine": F.lit("m")}, levels=levels)
    got = found.withColumns({"up": merkle.folded(F.col("leaf"), F.col("path")), "proof": merkle.proof_digest(F.col("path")), "bad": merkle.folded(F.lit("0"), F.col("path"))}).collect()
    key = lambda r: (r[1] is not None, (r[1] or "").encode())
    trees, subs = [], []
    for _, group in groupby(sorted(rows, key=key), key=key):
        own = sorted(((r[0] is not None, r[0] or 0, plain_record(r)) for r in group))
        root, paths = plain_tree([x[2] for x in own], 3)
        trees.append([(x[1] if x[0] else None, x[2], root, p) for x, p in zip(own, paths)])
        subs.append(root)
    root, upper = plain_tree(subs, 3)
    want = sorted((repr(i), leaf, sub, root, digest("".join(a + b for a, b in p + up))) for own, up in zip(trees, upper) for i, leaf, sub, p in own)
    assert sorted((repr(r.doc_id), r.leaf, r.subroot, r.root, r.proof) for r in got) == want
    assert all(r.up == root and r.bad != root and r.mine == "m" for r in got)


def test_manifest_of_nothing_and_of_one(spark):
    kind = "doc_id long, source string, lang string, n_chars long, text string"
    assert merkle.manifest(spark.createDataFrame([], kind)).count() == 0
    r = merkle.manifest(spark.createDataFrame([(None, None, None, None, None)], kind)).first()
    assert r.leaf == digest("-" * 5) == r.subroot == r.root and r.path == ""


def plain_codes(rows, parts, entries, rounds):
    kept = sorted(((i is None, i or 0, v, lab) for i, v, lab in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)), key=lambda x: x[:3])
    ints = [[int(np.floor(np.float64(c) * 4096)) if abs(c) < 2**40 else int(c) * 4096 for c in v] for _, _, v, _ in kept]
    w = len(ints[0]) // parts
    cut = [[v[p * w : (p + 1) * w] for p in range(parts)] for v in ints]
    books = [[cut[e][p] for e in range(min(entries, len(cut)))] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda: [[min((far(v[p], e), k) for k, e in enumerate(books[p])) for p in range(parts)] for v in cut]
    for _ in range(rounds):
        found = near()
        for p in range(parts):
            for k in range(len(books[p])):
                own = [v[p] for v, f in zip(cut, found) if f[p][1] == k]
                if own:
                    books[p][k] = [sum(c) // len(own) for c in zip(*own)]
    return [(x[1] if not x[0] else None, x[3], bytes(k for _, k in f), sum(d for d, _ in f)) for x, f in zip(kept, near())], books


@pytest.mark.parametrize("kind", ["random", "ties", "few", "huge"])
def test_vector_codes(spark, kind):
    rng = np.random.RandomState(4)
    make = {
        "random": lambda i: (rng.randn(8) * (1 + i % 3)).astype(np.float32).tolist(),
        "ties": lambda i: [float(x) / 4096 for x in rng.randint(-2, 3, 8)],
        "few": lambda i: [1.0 * (i % 2)] * 8,
        "huge": lambda i: [float(np.float32(x)) for x in rng.randn(8) * 10 ** (i % 14)],
    }[kind]
    rows = [(i if i % 11 else None, make(i), i % 3 or None) for i in range(3 if kind == "few" else 150)]
    rows += [(900, None, 1), (901, [None] + [0.0] * 7, 1), (902, [float("nan")] * 8, 2), (903, [float("inf")] * 8, None), (1, rows[1][1], 2)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"code": F.lit(1), "vector": F.lit("x")}).repartition(4)
    coded, books = vector_codes.compress(table, parts=4, entries=6, rounds=3)
    want, plain = plain_codes(rows, 4, 6, 3)
    if kind != "huge":  # doubles of single precision may differ from the list's
        assert books == plain
    got = vector_codes.label_errors(coded).collect()
    sums = {}
    for _, label, _, d in want:
        sums[label] = sums.get(label, 0) + d
    if kind != "huge":
        assert sorted(map(repr, [(r.vec_id, bytes(r.code), r.error, r.label_error) for r in got])) == sorted(map(repr, [(i, c, d, sums[label]) for i, label, c, d in want]))
    assert len(got) == len(want)


def test_vectors_of_nothing_and_of_no_length(spark):
    kind = "vec_id long, embedding array<float>, label int"
    coded, books = vector_codes.compress(spark.createDataFrame([], kind))
    assert coded.count() == 0 and books == [] and vector_codes.label_errors(coded).count() == 0
    coded, books = vector_codes.compress(spark.createDataFrame([(1, [], 1), (2, [], None)], kind))
    assert [(bytes(r.code), r.error) for r in coded.collect()] == [(bytes(8), 0)] * 2
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.compress(spark.createDataFrame([(1, [1.0], 1)], kind))


def test_search_visits_no_more_than_the_radius():
    """Entries out of reach are never computed with, and equal distances go to the lower index."""
    rng = np.random.RandomState(1)
    x, books = rng.randint(-50, 50, (400, 3, 2)), rng.randint(-50, 50, (3, 9, 2))
    books[:, 5] = books[:, 2]
    start = rng.randint(0, 9, (400, 3))
    code, dist = vector_codes.nearest(x, start, books)
    all_of = ((x[:, :, None] - books[None]) ** 2).sum(3)
    assert (dist == all_of.min(2)).all() and (code == all_of.argmin(2)).all()
