"""Each operator against a plain version on a small table."""

import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from oracle import connection, differences

from wanescope.llm import langid, line_dedup, packing, quality_model, quality_rules, queries, simhash, url_filter
from wanescope.llm.components import connected_components
from wanescope.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_sql(spark, sf_dir, name):
    assert differences(queries.QUERIES[name](spark, sf_dir), connection(sf_dir), queries.ORACLES[name]) == []


def plain_fingerprint(text, k=3):
    words = [w for w in re.split("[\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    fps = {i: plain_fingerprint(t) for i, t in rows}
    least = {i: i for i in fps}
    for _ in fps:
        now = {i: min(least[j] for j in fps if bin(fps[i] ^ fps[j]).count("1") <= 2) for i in fps}
        if now == least:
            break
        least = now
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    assert {i: got[i].fp % (1 << 64) for i in fps} == fps
    assert {i: got[i].component_id for i in fps} == least


def test_close_fingerprints_in_full_tiles(spark):
    """Many fingerprints in few tiles, with chunks smaller than a tile: every link is found."""
    rng = random.Random(3)
    centres = [rng.getrandbits(64) for _ in range(6)]
    fps = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for c in centres for _ in range(60)}
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    got = {tuple(sorted((r.u % (1 << 64), r.v % (1 << 64)))) for r in simhash.links(spark.createDataFrame(signed, "fp long"), tile_rows=16).collect()}
    want = {tuple(sorted((a, b))) for a in fps for b in fps if a < b and bin(a ^ b).count("1") <= 2}
    assert got == want


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(300)] + [(1000 + rng.randint(0, 200), 1000 + rng.randint(0, 200)) for _ in range(120)] + [(5000, 5000 + i) for i in range(1, 200)] + [(7, 7), (None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in parent if find(x) != x}


def test_packing_round_trip(spark, docs):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(tokenizer_path())
    rows = packing.pack(docs, tokenizer_path()).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, text in texts.items():
        ids = np.array([*coder.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        own = sorted(by_doc[i], key=lambda r: r.piece)
        assert [(r.start, r.length) for r in own] == [(s, min(4096, len(ids) - s)) for s in range(0, len(ids), 4096)]
        assert [r.ids_crc32 for r in own] == [zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in own]
    for places in by_seq.values():
        places.sort()
        assert [p[0] for p in places] == [sum(x[1] for x in places[:i]) for i in range(len(places))] and sum(p[1] for p in places) <= 4096
    assert len(by_seq) <= -(-sum(r.length for r in rows) // 4096) + 1


def test_tokens_of_odd_texts():
    rng = random.Random(1)
    coder = packing.WordIds(tokenizer_path())
    odd = ["It's DON'T 3.14 x² naïve ÉCOLE İst ΣΑΣ", "<|endoftext|> a<|endoftext|>b <|ENDOFTEXT|>BA", "", " ", "word!!! (p). 日本。 👍🏽", "ﬁ ǅ ŉ é \x1c\x85", "x%%% y&&&. ####"]
    odd += ["".join(rng.choice("aAbB éÉ'’.,!?-#|<>01é \n\tßİΣσ中。") for _ in range(rng.randint(1, 50))) for _ in range(500)]
    want = [e.ids for e in coder.of.encode_batch(odd, add_special_tokens=False)]
    assert [x.tolist() for x in coder.encode([t.encode() for t in odd])] == want


def test_fullest_filling():
    rng = random.Random(2)
    for _ in range(200):
        counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(rng.randint(1, 6))}
        room = rng.randint(1, 60)
        sums = {0}
        for n, c in counts.items():
            sums = {s + n * k for s in sums for k in range(c + 1)}
        got = packing.fullest(sorted(counts, reverse=True), counts, room)
        assert sum(n * k for n, k in got.items()) == max(s for s in sums if s <= room)
        assert all(k <= counts[n] for n, k in got.items())


def test_held_out_accuracy(spark, docs, sf_dir):
    truth = {r.doc_id: r.lang for r in docs.collect()}
    got = [r for r in langid.identify(docs).collect() if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in got]) > 0.95
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    quality = {r.doc_id: r.quality for r in labels.collect()}
    scored = [r for r in quality_model.score(docs, labels).collect() if r.held_out and r.doc_id in quality]
    assert np.mean([r.predicted == quality[r.doc_id] for r in scored]) > 0.85


@pytest.mark.parametrize("least,heavy", [(1, 0), (1, 8), (5, 4096)])
def test_lines_of_random_words(spark, least, heavy):
    """Short vocabularies make many near pairs; the exact join must find each, whichever words are keys alone or only in pairs."""
    rng = random.Random(4)
    texts = []
    for _ in range(60):
        lines = [" ".join(rng.sample("abcdefghijklm", rng.randint(1, 11))) for _ in range(rng.randint(1, 5))]
        texts.append("\n".join(lines))
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), min_tokens=least, heavy=heavy).collect()}
    seen, want = [], {}
    for i, t in enumerate(texts):
        stay = []
        for line in t.split("\n"):
            s = set(line.split())
            if len(s) >= least:
                if not any(5 * len(s & o) >= 4 * len(s | o) for o in seen):
                    stay.append(line)
                seen.append(s)
            else:
                stay.append(line)
        want[i] = "\n".join(stay)
    assert got == want


def test_candidates_of_near_copies_grow_linearly(spark, monkeypatch):
    """What a group of near copies leaves to the prefix join is no more than a few pairs for each member."""
    made, real = [], line_dedup._candidates

    def counted(*args):
        made.append(real(*args).count())
        return real(*args)

    monkeypatch.setattr(line_dedup, "_candidates", counted)
    base = [f"w{i}" for i in range(40)]
    for size in (100, 400):
        made.clear()
        rows = [(i, " ".join([*base[: i % 40], f"x{i}", *base[i % 40 + 1 :]] if i else base)) for i in range(size)]
        assert line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).where("text <> ''").count() == 1
        assert sum(made) <= 4 * size


def test_candidates_of_uneven_near_copies_grow_linearly(spark, monkeypatch):
    """Copies that differ in one to three words, behind a first one that differs in four and so matches none of them: the join settles
    nearly all of them before pairs are made, and what goes is what goes by brute force."""
    made, real = [], line_dedup._candidates

    def counted(*args):
        made.append(real(*args).count())
        return real(*args)

    monkeypatch.setattr(line_dedup, "_candidates", counted)
    rng, base, size = random.Random(7), [f"w{i}" for i in range(40)], 400
    sets = []
    for i in range(size):
        words = list(base)
        for at in rng.sample(range(40), rng.randint(1, 3) if i else 4):
            words[at] = f"x{i}y{at}"
        sets.append(words)
    want = [i for i, s in enumerate(sets) if not any(5 * len(set(s) & set(o)) >= 4 * len(set(s) | set(o)) for o in sets[:i])]
    rows = spark.createDataFrame([(i, " ".join(s)) for i, s in enumerate(sets)], "doc_id long, text string")
    assert sorted(r.doc_id for r in line_dedup.dedup_lines(rows).where("text <> ''").collect()) == want
    assert sum(made) <= 4 * size


def test_words_are_kept_once():
    """A word is a chunk and a pre-token with the same ids: one entry, found again behind a mark."""
    coder = packing.WordIds(tokenizer_path())
    coder.encode([b"alpha beta gamma"])
    held = {id(x): len(x) for x in vars(coder).values() if isinstance(x, dict)}
    assert sum(held.values()) == 3
    want = [e.ids for e in coder.of.encode_batch(["beta, gamma! , alpha"], add_special_tokens=False)]
    assert [x.tolist() for x in coder.encode([b"beta, gamma! , alpha"])] == want


def test_language_by_hand(spark):
    """Log frequencies, backoff and scores against a plain model; letters, marks and numerals that are no letters."""
    assert langid.words_of("½ ② 12 _") == [] and langid.words_of("हिन्दी x") == ["हिन्दी", "x"]
    seen = {("a", "foo"): 4, ("a", "bar"): 3, ("b", "foo"): 3, ("b", "qux"): 6}
    model = langid.Model([(lang, w, n) for (lang, w), n in seen.items()])
    total = {lang: sum(n for (k, _), n in seen.items() if k == lang) for lang in "ab"}
    log = lambda lang, w: np.log((seen.get((lang, w), 0) + 0.5) / (total[lang] + 0.5 * 3))
    grams = {}
    for w in ("foo", "bar", "qux"):
        for k in range(1, 5):
            for g in langid.grams_of(w, k):
                for lang in "ab":
                    grams.setdefault(g, {"a": 0.0, "b": 0.0})[lang] += seen.get((lang, w), 0) ** 0.5
    sums = {lang: sum(g[lang] for g in grams.values()) for lang in "ab"}
    # sums are over the n-grams of one length
    by = {(k, lang): sum(g[lang] for x, g in grams.items() if len(x) == k) for k in range(1, 5) for lang in "ab"}
    size = {k: sum(len(x) == k for x in grams) for k in range(1, 5)}
    gram = lambda g, lang: np.log((grams[g][lang] + 0.5) / (by[len(g), lang] + 0.5 * size[len(g)]))
    w, found = "^quo$", []
    for i in range(1, len(w)):
        g = next((w[i + 1 - k : i + 1] for k in range(min(4, i + 1), 0, -1) if w[i + 1 - k : i + 1] in grams), None)
        found += [g] if g else []
    unseen = {lang: np.mean([gram(g, lang) for g in found]) for lang in "ab"}
    middle = sum(unseen.values()) / 2
    odds = log("a", "foo") + unseen["a"] - log("b", "foo") - unseen["b"]
    names, chances = model.predict(["Foo quo!", "½", None])
    assert names == ["a" if odds > 0 else "b", "und", "und"] and abs(chances[0] - 1 / (1 + np.exp(-abs(odds)))) < 1e-9 and middle < 0 < sums["a"]
    again = langid.Model([(lang, w, n) for (lang, w), n in seen.items()])
    again.predict(["zap quz foo", "quo"])
    assert again.predict(["Foo quo!"])[1] == chances[:1]  # whatever came before


def test_discriminant_by_hand(spark):
    """Moments, shrinkage and log-densities against the textbook formulas."""
    rng, d = np.random.default_rng(0), len(quality_model.STATISTICS)
    x = {k: rng.normal(k, 1 + k, (50 + 10 * k, d)) @ rng.normal(0, 1, (d, d)) for k in (0, 1)}
    rows = spark.createDataFrame([(k, [float(v) for v in row]) for k in x for row in x[k]], "label int, x array<double>").repartition(3)
    got = quality_model.moments(rows)
    assert all(np.allclose(got[k][2], x[k].T @ x[k]) and np.allclose(got[k][1], x[k].sum(0)) and got[k][0] == len(x[k]) for k in x)
    every = np.vstack((x[0], x[1]))
    z = {k: (x[k] - every.mean(0)) / every.std(0) for k in x}
    own = {k: np.cov(z[k].T, bias=True) for k in z}
    pooled = sum(own[k] * len(z[k]) for k in z) / len(every)
    density = {}
    for k in z:
        s = 0.7 * own[k] + 0.3 * pooled
        s = 0.95 * s + 0.05 * np.eye(d) * np.trace(s) / d
        away = (every - every.mean(0)) / every.std(0) - z[k].mean(0)
        density[k] = -0.5 * np.einsum("ij,jk,ik->i", away, np.linalg.inv(s), away) - 0.5 * np.linalg.slogdet(s)[1]
    prior = (len(x[1]) + 1) / (len(every) + 2)
    odds = np.log(prior / (1 - prior)) + density[1] - density[0]
    assert np.allclose(quality_model.Discriminant(got).score(every), 1 / (1 + np.exp(-np.clip(odds, -500, 500))), atol=1e-8)


def test_rules_follow_the_sample(spark):
    """A rule that reads more comes later unless it rejects more; kept rows don't hang on the order."""
    good = lambda i: " ".join(chr(97 + k % 26) * 3 + chr(97 + k // 26) * 2 + chr(97 + i % 26) for k in range(80))
    shouting = spark.createDataFrame([(i, good(i).upper()) for i in range(40)], "doc_id long, text string")
    symbols = spark.createDataFrame([(i, good(i) + " #" * 20) for i in range(40)], "doc_id long, text string")
    first = [quality_rules.planned(d, quality_rules.default_rules(), sample_of=1)[0].name for d in (shouting, symbols)]
    assert first == ["shouting", "symbol_share"]


def test_aliases_against_union_find(spark):
    """Chains, hubs, several tags of a page, rel with several values, relative and protocol-relative targets."""
    pages = [(i, f"http://c.io/{i}", f"<link rel='alternate canonical' href=/{i + 1}>") for i in range(50)]
    pages += [(50, "http://c.io/50", "<link href=//a.org/es/x rel=canonical>")]
    pages += [(100 + i, f"http://h.io/{i}", "<link rel=canonical href=hub><meta http-equiv=refresh content='0;url=http://o.io/b'><link rel=\"canonical\" href=http://o.io/c>") for i in range(60)]
    pages += [(200, "http://o.io/b", None), (201, "http://o.io/c", ""), (202, "http://h.io/hub", ""), (203, "http://o.io/alone", "<link rel=xcanonical href=http://a.org/es/x>"), (204, "http://o.io/d", "<link rel=canonical href=http://h.io/0><link rel=canonical href=http://u.net/de/1>")]
    got = {r.page_id: (r.verdict, r.via) for r in url_filter.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all(got[i] == ("block", "alias") for i in range(51))
    assert all(got[i] == ("allow", "alias") for i in [*range(100, 160), 200, 201, 202, 204]) and got[203] == ("allow", "default")
