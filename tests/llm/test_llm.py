"""Corpus operators against brute force on small fixtures with nulls, empty, long, equal and repeated rows."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from dqspark.llm import chroma, components, decontaminate, langid, line_dedup, mixing, queries, sharding, simhash, substring_dedup, token_shards, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
R = random.Random(5)
VOCAB = ["w%d" % i for i in range(400)]
PASSAGE = " ".join(R.choice(VOCAB) for _ in range(70))


def prose(n):
    return " ".join(R.choice(VOCAB) for _ in range(n))


BASE = prose(150)
ROWS = [(0, BASE, "en", "a", 1), (1, BASE, "en", "a", 1), (2, BASE + " tail words", "en", "a", 1), (3, None, None, None, None), (4, "", "en", "b", 0), (5, " \t\n", "en", "b", 3), (None, BASE, "en", None, 1), (6, prose(40) + " " + PASSAGE, "en", "b", 1), (7, PASSAGE + " " + prose(20), "en", "b", 1), (8, "hare " * 200, "en", "a", 1), (9, "hare " * 120 + prose(5), "en", "a", 1), (10, "É x " + prose(30), "fr", "c", 1), (11, prose(3000), "en", "c", 1)] + [(20 + i, f"A line of twenty characters\n{prose(12)}\n  a LINE of twenty characters \nshort", "en", "d", 1) for i in range(5)]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    return df.withColumn("n_words", F.lit("clash")).repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def key(r):
    return -(2**63) if r[0] is None else r[0]


def test_lines_against_brute_force(docs, none):
    held = collections.defaultdict(set)
    k = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    for r in ROWS:
        for x in (r[1] or "").split("\n"):
            if len(k(x)) >= 20:
                held[k(x)].add(key(r))
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
    assert len(got) == len(ROWS)
    for r in ROWS:
        all_ = (r[1] or "").split("\n")
        kept = [x for x in all_ if len(held[k(x)]) < 3 or max(held[k(x)]) == key(r)]
        assert (got[r[0]].n_lines, got[r[0]].n_dropped, got[r[0]].kept_sha256) == (len(all_), len(all_) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    assert line_dedup.dedup_lines(none).count() == 0


def test_mph_is_minimal_and_perfect():
    h = np.random.default_rng(1).integers(0, 2**63, (2, 5000), dtype=np.uint64)
    assert sorted(line_dedup.Mph(*line_dedup.build_mph(*h)).index(*h)) == list(range(5000))


@pytest.mark.parametrize("hot", [2_000, 1])
def test_substrings_against_brute_force(docs, none, hot, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    low, words = {}, {r[0]: re.findall(r"[^\x20\x09-\x0D]+", r[1] or "") for r in ROWS}
    for r in sorted(ROWS, key=key):
        for j in range(len(words[r[0]]) - 49):
            low.setdefault(tuple(words[r[0]][j : j + 50]), key(r))
    got = {r.doc_id: r for r in substring_dedup.dedup_substrings(docs).collect()}
    for r in ROWS:
        w = words[r[0]]
        gone = {i for j in range(len(w) - 49) if low[tuple(w[j : j + 50])] < key(r) for i in range(j, j + 50)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        assert (got[r[0]].n_words, got[r[0]].n_removed, got[r[0]].kept_sha256) == (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    assert substring_dedup.dedup_substrings(none).count() == 0


@pytest.mark.parametrize("part", [1_000_000, 40])
def test_decontamination(spark, docs, none, part, monkeypatch):
    monkeypatch.setattr(decontaminate, "PART_WORDS", part)
    bench = spark.createDataFrame([(1, PASSAGE.upper()), (2, prose(30)), (3, "é x"), (4, None), (5, "--"), (1, PASSAGE)], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.find_contamination(docs, bench, keep=["doc_id"]).collect()}
    assert [k for k in sorted(got, key=str) if got[k].contaminated] == [6, 7]
    assert got[6].n_hit == 70 and got[6].items_sha256 == hashlib.sha256(b"1").hexdigest() and got[3].n_words == 0
    clean = decontaminate.remove(docs, bench, how="spans")
    assert clean.columns == docs.columns and not decontaminate.find_contamination(clean, bench, keep=["doc_id"]).filter("contaminated").count()
    assert decontaminate.remove(docs, bench).count() == len(ROWS) - 2 and decontaminate.remove(none, bench).count() == 0


def test_simhash_against_brute_force(spark, docs, none):
    def fp(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    got = {r.doc_id: r for r in simhash.cluster(docs).collect()}
    fps = {r[0]: fp(r[1]) for r in ROWS}
    root = {r[0]: r[0] for r in ROWS}
    for _ in ROWS:
        for a in fps:
            for b in fps:
                if bin(fps[a] ^ fps[b]).count("1") <= 3:
                    root[a] = min(root[a], root[b], key=lambda x: -(2**63) if x is None else x)
    for k in fps:
        assert (got[k].fingerprint, got[k].component_id) == (f"{fps[k]:016x}", root[k])
    assert simhash.cluster(none).count() == 0


def test_links_of_dense_groups(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", 4)
    rng = np.random.default_rng(3)
    fps = np.unique([int(c) ^ sum(1 << int(b) for b in rng.choice(63, int(rng.integers(0, 4)), replace=False)) for c in rng.integers(0, 2**63, 4) for _ in range(12)])
    links = simhash.links(spark.createDataFrame([(int(x),) for x in fps], "fp long"))
    got = {r.node: r.component for r in components.components(links.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))).collect()}
    root = {int(x): int(x) for x in fps}
    for _ in fps:
        for a in root:
            for b in root:
                if bin(a ^ b).count("1") <= 3:
                    root[a] = min(root[a], root[b])
    assert {k: got.get(k, k) for k in root} == root


def test_near_copies(spark):
    words = prose(300).split()
    near = list(words)
    near[100] = "changed"
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(near)), (3, prose(300)), (4, " ".join(words))], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.dedup(df).collect()) == [1, 3]


def test_sharding_law(docs, none):
    got = sharding.shard(docs, 16).collect()
    sizes = collections.Counter(r.shard for r in got)
    assert len(got) == len(ROWS) and max(sizes.values()) - min(sizes.get(i, 0) for i in range(16)) <= 1
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(n)) for s, n in sizes.items())
    by = {r.doc_id: r for r in got}
    assert by[3].size == 1 and by[3].text_crc32 == 0 and by[0].text_crc32 == zlib.crc32(BASE.encode()) and by[0].n_words == "clash"
    assert sharding.shard(none).count() == 0


def test_communication_matrix():
    m = sharding.communication_matrix(np.array([5, 0, 7]), np.array([4, 4, 4]), np.random.default_rng(1))
    assert m.sum(axis=1).tolist() == [5, 0, 7] and m.sum(axis=0).tolist() == [4, 4, 4] and (m >= 0).all()


def test_mixing(spark, docs, none):
    rows = [(i, prose(5 + i % 7), "en", "big" if i % 10 else "small", 1) for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(df, repetition=2.0).collect()
    assert {r.doc_id for r in got} == set(range(300)) and max(r.epoch for r in got) == 1
    plan = {r.source: r for r in mixing.plan(df).collect()}
    assert plan["big"].copies == 1.0 and plan["small"].copies == pytest.approx(2.0, abs=1e-6)
    h = {r.source: r.weight for r in mixing.plan(df, repetition=None, entropy=0.9).collect()}
    assert -sum(w * np.log(w) for w in h.values()) == pytest.approx(0.9 * np.log(2), abs=1e-6)
    assert mixing.mix(docs).count() >= len(ROWS) and mixing.mix(none).count() == 0


def test_language_id(spark, docs, none):
    words = {"xx": ["bala", "bolo", "bamba"], "yy": ["kirik", "krik", "kitik"]}
    df = spark.createDataFrame([(i, " ".join(R.choice(words[k]) for _ in range(30)), k, "a", 1) for i, k in enumerate(["xx", "yy"] * 60)] + [(900, None, "xx", "a", 1), (901, "12 !", "xx", "a", 1)], SCHEMA)
    got = langid.identify(df).collect()
    assert all(r.lang_pred == r.lang for r in got if r.doc_id < 900 and r.held_out) and {r.lang_pred for r in got if r.doc_id >= 900} == {"und"}
    assert all(0 <= r.score <= 1 for r in got) and langid.keep_identified(df).count() == 120
    assert langid.identify(docs).count() == len(ROWS) and langid.identify(none).count() == 0


def test_toxicity(spark, docs, none):
    df = spark.createDataFrame([(i, prose(40) + (" filth" if i % 5 == 0 else ""), "en", "a", 1) for i in range(400)] + [(900, None, "en", "a", 1)], SCHEMA)
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(400)], "doc_id long, quality int, toxic int")
    got = [r for r in toxicity.score(df, labels).collect() if r.held_out and r.doc_id < 900]
    assert all(r.predicted == int(r.doc_id % 5 == 0) for r in got)
    assert toxicity.score(docs, labels.limit(0)).count() == len(ROWS) and toxicity.score(none, labels).count() == 0


def test_swapping_identity_terms_evens_their_weights():
    a, b = toxicity.identity_groups()[0][:2]
    x = toxicity.features("x y")
    rows = [np.sort(np.array([a], np.uint64))] * 30 + [x] * 60 + [np.sort(np.array([b], np.uint64))] * 10
    y = np.array([1.0] * 25 + [0.0] * 5 + [0.0] * 70)
    apart = [abs(float(np.diff(m["weights"][np.searchsorted(m["words"], [a, b])])[0])) for m in (toxicity.fit(rows, y, counterfactual=c) for c in (0.0, 10.0))]
    assert apart[1] < 0.2 * apart[0]


def test_token_shards(spark, docs, none, tmp_path):
    got = token_shards.shards(docs, length=64, per_shard=8).collect()
    assert sorted(r.slot for r in got) == list(range(len(got))) and all(len(r.tokens) == 128 and r.offset == r.slot % 8 * 128 for r in got)
    with open(token_shards.VOCABULARY, "rb") as f:
        encode = token_shards.encoder(f.read())
    own = sorted((r for r in got if r.doc_id == 11), key=lambda r: r.part)
    ids = np.frombuffer(b"".join(r.tokens for r in own), np.uint16)[: sum(r.n_tokens for r in own)]
    assert encode.decode(ids.tolist()) == dict((r[0], r[1]) for r in ROWS)[11]
    token_shards.write(docs, str(tmp_path / "t"), length=64, per_shard=8)
    by = sorted(got, key=lambda r: r.slot)
    assert token_shards.read(spark, str(tmp_path / "t"), 5, 9, 64, 8).tobytes() == b"".join(r.tokens for r in by[5:14])
    assert token_shards.shards(none).count() == 0


def test_permutation_is_one():
    for n in (1, 2, 3, 100, 1025):
        assert sorted(token_shards.permute(np.arange(n), n, 9)) == list(range(n))


def test_chroma(spark, none):
    t = np.arange(8000) / 8000
    tune = np.concatenate([np.sin(2 * np.pi * 220 * 2 ** (k / 12) * t) for k in (0, 4, 7, 2, 9, 5)])
    pcm = lambda x: ((x * 100 + 128).clip(0, 255)).astype(np.uint8).tobytes()
    other = np.concatenate([np.sin(2 * np.pi * 220 * 2 ** (k / 12) * t) for k in (11, 1, 6, 3, 8, 10)])
    df = spark.createDataFrame([(1, pcm(tune)), (2, pcm(np.concatenate([np.zeros(128 * 20), tune]))), (3, pcm(other)), (4, None), (5, b"ab"), (6, pcm(tune))], "doc_id long, text binary")
    got = {r.doc_id: r for r in chroma.match(df).collect()}
    assert got[2].class_id == 1 and got[2].best_offset == 20 and got[6].class_id == 1 and got[3].class_id == 3 and got[4].n_frames == 0
    assert chroma.match(none).count() == 0


def test_queries_with_sql_agree(spark):
    sf = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        df = queries.queries()[name](spark, sf)
        want = c.execute(f"select {', '.join(sorted(df.columns))} from ({sql})").fetchall()
        assert sorted(map(str, map(tuple, df.select(*sorted(df.columns)).collect()))) == sorted(map(str, want)), name


def test_pipeline(spark, tmp_path):
    df = spark.createDataFrame([(i, t, "en", s, len(t)) for i, (t, s) in enumerate([(prose(60), "a"), (prose(60), "b"), (PASSAGE, "a"), ("12 34", "a")] + [(BASE, "c")] * 3)], SCHEMA)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, PASSAGE)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == {0, 1, 4} and sorted({r.shard for r in got}) == list(range(len(got)))


def test_a_term_that_no_label_shows_is_swapped_in_too():
    texts = ["the muslim idiot"] * 30 + ["muslim clown here"] * 30 + ["the muslim neighbour baked"] * 3 + ["bread was baked here"] * 100
    rows, y = [toxicity.features(t) for t in texts], np.array([1.0] * 60 + [0.0] * 103)
    apart = []
    for c in (0.0, 1.0):
        m = toxicity.fit(rows, y, counterfactual=c)
        apart.append(abs(toxicity.score_one("the muslim neighbour", m) - toxicity.score_one("the sikh neighbour", m)))
    assert apart[1] < 0.02 < apart[0]


def test_terms_have_no_beginnings_among_the_features():
    assert len(toxicity.features("muslim")) == 1 and len(toxicity.features("neighbour")) == 4


def shingles(text, size=5):
    w = text.lower().split()
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))}


def near_components(texts):
    """Least reachable place for each text, by all pairs of shingle similarity 0.8 or more."""
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))
    pairs = [(i, j) for j in range(len(sets)) for i in range(j) if 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j]))]
    for _ in texts:
        before = list(root)
        for i, j in pairs:
            root[i] = root[j] = min(root[i], root[j])
        if root == before:
            return dict(enumerate(root))


def found_components(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.k: r.component for r in simhash.near_duplicates(df).collect()}
    return {i: got.get(i, i) for i in range(len(texts))}


def changed_ends(rng, n, words, other):
    """n pairs of texts of so many words, of which the last ``other`` differ."""
    new = lambda k: [f"x{rng.randrange(10**9)}" for _ in range(k)]
    return [" ".join(w + new(other)) for _ in range(n) for w in [new(words - other)] for _ in range(2)]


def test_near_copies_at_the_limit_are_found_at_any_size(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK_BITS", 30, raising=False)  # a billion texts' blocks of an earlier version
    texts = changed_ends(random.Random(1), 40, 104, 11)
    want = near_components(texts)
    assert sum(k != v for k, v in want.items()) == 40 and found_components(spark, texts) == want


def test_near_copies_among_crowded_keys(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CROWD", 2, raising=False)  # a cap of an earlier version
    rng = random.Random(2)
    shared = " ".join(f"s{i}" for i in range(180))
    pairs = [f"{shared} {t}" for t in changed_ends(rng, 25, 64, 25)]
    words = " ".join(f"d{i}" for i in range(300)).split()
    group = []
    for _ in range(30):  # near copies of one text, that differ from each other too
        own = list(words)
        own[rng.randrange(300)] = f"y{rng.randrange(10**9)}"
        group.append(" ".join(own[: 300 - rng.randrange(20)]))
    texts = pairs + group
    want = near_components(texts)
    assert len(set(want.values())) == 26 and found_components(spark, texts) == want


def test_near_copies_of_long_texts_are_judged_whole(spark):
    texts = changed_ends(random.Random(3), 15, 2004, 220) + changed_ends(random.Random(4), 15, 2004, 225)
    want = near_components(texts)
    assert sum(k != v for k, v in want.items()) == 15 and found_components(spark, texts) == want


def test_texts_below_the_limit_stay(spark):
    texts = changed_ends(random.Random(5), 40, 104, 12) + changed_ends(random.Random(6), 40, 104, 15)
    assert found_components(spark, texts) == dict(enumerate(range(len(texts))))
