"""Every operator over odd rows and clashing names, and brute force where no SQL can say what is right."""

import collections
import math
import random
import struct
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from dqspark.llm import chroma, common, components, decontaminate, langid, line_dedup, mixing, sharding, simhash, substring_dedup, token_shards, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
R = random.Random(11)
VOCAB = ["%s%s" % (a, b) for a in ("ba", "ko", "ri", "shun", "tel") for b in ("lo", "mi", "nak", "dor", "est", "ufa", "gri", "wen")]


def prose(n):
    return " ".join(R.choice(VOCAB) for _ in range(n))


SHARED, LINE = prose(60), "this is one line that many documents have"
LONG = prose(170_000)
ODD = [
    (None, None, None, None, None), (None, prose(70), "en", "a", 1), (1, "", "en", "a", 0), (2, " \t\r\n \x0b", None, "b", 3), (3, LONG, "en", "a", len(LONG)), (4, SHARED + " end", "en", "a", 1), (4, SHARED + " end", "en", "a", 1), (4, prose(55), "fr", "a", 1),
    (5, SHARED + " end", "en", None, 1), (6, "start " + SHARED, "en", "c", 1), (7, "12 34 !?", "en", "c", 1), (8, "É " + SHARED.upper() + " ß", "fr", "c", 1), (9, "one", "en", "c", 1), (10, "muslim one", "en", "c", 1), (11, f"{LINE}\n{prose(9)}", "en", "c", 1), (12, f" {LINE.upper()}\t\n\n{LINE}", "en", "c", 1), (13, LINE, "en", "c", 1),
]
CLASHES = ["k", "th", "_k", "_text", "_gone", "gone", "drops", "_drops", "alive", "lost", "v", "around", "salts", "h", "h1", "h2", "id", "key", "s", "n", "fp", "_fp", "bits", "spans", "_spans", "items", "cut", "own held_out", "row", "c_0", "c_1", "c_text", "cell", "rank", "upto", "cells", "offset", "in_cell", "g", "copies", "we.ird", "a tick`s", "word"]
OPERATORS = {
    "lines": lambda d, b, x: line_dedup.dedup_lines(d), "substrings": lambda d, b, x: substring_dedup.dedup_substrings(d), "language": lambda d, b, x: langid.identify(d), "identified": lambda d, b, x: langid.keep_identified(d, 0.0), "toxicity": lambda d, b, x: toxicity.score(d, x),
    "mix": lambda d, b, x: mixing.mix(d), "contamination": lambda d, b, x: decontaminate.find_contamination(d, b), "clean documents": lambda d, b, x: decontaminate.remove(d, b), "clean spans": lambda d, b, x: decontaminate.remove(d, b, how="spans"), "near copies": lambda d, b, x: simhash.dedup(d), "shards": lambda d, b, x: sharding.shard(d),
}
NARROW = {"clusters": simhash.cluster, "media": chroma.match, "tokens": lambda d: token_shards.shards(d, length=64, per_shard=8)}


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).coalesce(2).cache()


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, SHARED), (1, SHARED), (None, "muslim one"), (2, None), (3, "")], "item_id long, text string").cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 1, 0), (10, 1, 0), (10, 0, 0), (None, 1, 1), (13, 1, None)], "doc_id long, quality int, toxic int").cache()


def rows(df, names):
    return sorted(map(repr, df.select(*("`" + c.replace("`", "``") + "`" for c in names)).collect()))


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_and_columns_of_any_name(odd, bench, labels, name):
    plain = OPERATORS[name](odd, bench, labels).cache()
    more = [c for c in CLASHES if c not in plain.columns]
    wide = odd.select("*", *(F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(c) for c in more))
    got = OPERATORS[name](wide, bench, labels).cache()
    assert sorted(got.columns) == sorted([*plain.columns, *more])
    assert rows(got, plain.columns) == rows(plain, plain.columns)
    own = got.select("doc_id", F.array(*("`" + c.replace("`", "``") + "`" for c in more)).alias("x")).collect()
    assert all(r.x == [f"{c}:{'-' if r.doc_id is None else r.doc_id}" for c in more] for r in own)
    assert OPERATORS[name](wide.limit(0), bench, labels).count() == 0
    if "clean" not in name and name not in ("identified", "near copies", "mix"):
        assert len(own) == len(ODD)
    assert OPERATORS[name](odd, bench.limit(0), labels.limit(0)).count() >= len(own) - (0 if "clean" not in name else len(ODD))


@pytest.mark.parametrize("name", NARROW)
def test_odd_rows_of_operators_with_columns_of_their_own(odd, name):
    wide = odd.select("*", *(F.lit("x").alias(c) for c in CLASHES))
    assert rows(NARROW[name](wide), NARROW[name](odd).columns) == rows(NARROW[name](odd), NARROW[name](odd).columns)
    assert NARROW[name](wide.limit(0)).count() == 0


@pytest.mark.parametrize("stage", range(5))
def test_stages_take_odd_rows_and_any_columns(spark, odd, bench, stage, tmp_path):
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    wide = odd.withColumns({"k": F.lit(1), "_text": F.lit("x"), "score": F.lit("y"), "held_out": F.lit("z")})
    name, work = corpus_pipeline.STAGES[stage]
    out = work(spark, wide, str(tmp_path))
    assert set(wide.columns) <= set(out.columns) and (stage == 4 or out.columns == wide.columns)
    assert {r.doc_id for r in out.collect()} <= {r[0] for r in ODD}
    assert work(spark, wide.limit(0), str(tmp_path)).count() == 0


def test_a_line_of_fewer_documents_than_asked_stays(spark):
    df = spark.createDataFrame([(i, LINE) for i in range(260)], "doc_id long, text string").repartition(3)
    assert not line_dedup.dedup_lines(df, min_docs=300).filter("n_dropped > 0").count()
    assert line_dedup.dedup_lines(df, min_docs=260).filter("n_dropped > 0").count() == 259


def test_labels_of_one_class(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["a muslim", "a sikh and a jewish man", "none"] * 4)], "doc_id long, text string")
    for toxic in (0, 1):
        scores = {r.score for r in toxicity.score(df, df.select("doc_id", F.lit(1).alias("quality"), F.lit(toxic).alias("toxic"))).collect()}
        assert len(scores) == 1 and (scores.pop() > 0.5) == bool(toxic)


def test_the_penalty_spares_neutral_mentions():
    """Sentences by templates: toxic ones happen to name one group, neutral ones name all of its line."""
    insults, neutral = ["you idiot {} scum", "filthy {} go away", "stupid {} liar"], ["the {} family bought bread", "a {} teacher sang today", "my {} neighbour reads"]
    group = toxicity.IDENTITY_TERMS[0]
    texts = [x.format("muslim") for x in insults] * 10 + [x.format(g) for x in neutral for g in group[1:]] * 10 + ["bread was baked", "the teacher reads a book"] * 80
    y = np.array([1.0] * 30 + [0.0] * (len(texts) - 30))
    wrong = {}
    for c in (0.0, 1.0):
        m = toxicity.fit([toxicity.features(t) for t in texts], y, counterfactual=c)
        wrong[c] = sum(toxicity.score_one(x.format("muslim"), m) >= toxicity.THRESHOLD for x in ("the {} doctor slept", "one {} child plays", "{} songs"))
        assert all(toxicity.score_one(x.format(g), m) >= toxicity.THRESHOLD for x in insults for g in ("muslim", "sikh"))
    assert wrong == {0.0: 3, 1.0: 0}


# --- media


def wav(x, rate, bits, channels=1, floats=False):
    if floats:
        data = np.repeat(x, channels).astype("<f4").tobytes()
    elif bits == 8:
        data = np.repeat(x * 127 + 128, channels).astype(np.uint8).tobytes()
    else:
        whole = np.repeat(x * (2 ** (bits - 1) - 1), channels).astype("<i4")
        data = whole.view(np.uint8).reshape(-1, 4)[:, : bits // 8].tobytes()
    size = bits // 8 * channels
    head = struct.pack("<HHIIHH", 3 if floats else 1, channels, rate, rate * size, size, bits)
    return b"RIFF" + struct.pack("<I", 28 + len(data)) + b"WAVEfmt " + struct.pack("<I", 16) + head + b"LIST\x01\0\0\0x\0data" + struct.pack("<I", len(data)) + data


@pytest.mark.parametrize(("rate", "bits", "floats"), [(8_000, 8, False), (8_000, 16, False), (44_100, 16, False), (48_000, 24, False), (22_050, 32, False), (4_000, 16, False), (44_100, 32, True)])
def test_a_tone_has_its_pitch_class_at_any_rate(rate, bits, floats):
    x = 0.8 * np.sin(2 * np.pi * 440 * np.arange(2 * rate) / rate)
    for channels in (1, 2):
        c = chroma.chroma(wav(x, rate, bits, channels, floats))
        assert abs(len(c) - (16_000 - chroma.FRAME) // chroma.HOP) <= 2 and set(c[2:-2].argmax(axis=1)) == {0}
    assert len(chroma.samples(b"RIFF\0\0\0\0WAVEfmt " + struct.pack("<IHHIIHH", 16, 85, 1, 8000, 8000, 1, 8) + b"data\x04\0\0\0abcd")) == 0


def test_recordings_against_all_pairs(spark):
    rng, pcm = np.random.default_rng(4), lambda x: (x * 90 + 128).clip(0, 255).astype(np.uint8).tobytes()

    def tune(notes):
        t = np.arange(1600) / 8000
        return np.concatenate([np.sin(2 * np.pi * 110 * 2 ** (a / 12) * t) + 0.6 * np.sin(2 * np.pi * 110 * 2 ** (b / 12) * t) for a, b in notes])

    jingle, media = tune(rng.integers(0, 36, (5, 2))), []
    for i in range(30):
        base = tune(rng.integers(0, 36, (20, 2)))
        if i % 3 == 0:  # a sound that a third of all recordings begin with
            base = np.concatenate([jingle, base])
        media.append(base)
        for j in range(i % 4):
            x = base + rng.normal(0, 0.02, len(base))
            media.append(x[128 * 10 :] if j == 0 else np.concatenate([rng.normal(0, 0.3, 128 * 7), x]) if j == 1 else x[: len(x) - 128 * 30])
    order = rng.permutation(len(media))
    df = spark.createDataFrame([(i, pcm(media[j])) for i, j in enumerate(order)], "doc_id long, media binary").repartition(3)
    got = {r.doc_id: r for r in chroma.match(df, "media").collect()}
    fps = [chroma.integers(chroma.chroma(pcm(media[j]))) for j in order]
    root, links = list(range(len(fps))), []
    for i in range(len(fps)):
        for j in range(i):
            least = int(chroma.OVERLAP * min(len(fps[i]), len(fps[j])))
            spans = (chroma.bit_error(fps[i], fps[j], o) for o in range(least - len(fps[j]), len(fps[i]) - least + 1))
            if any(e <= chroma.BIT_ERROR and n >= chroma.OVERLAP * min(len(fps[i]), len(fps[j])) for e, n in spans):
                links.append((i, j))
    for _ in fps:
        for i, j in links:
            root[i] = root[j] = min(root[i], root[j])
    assert len(links) >= 40
    found = sum(got[i].class_id == got[j].class_id for i, j in links)
    assert found >= 0.95 * len(links), (found, len(links))
    assert all(root[i] == root[got[i].class_id] for i in got)


def test_chains_of_common_landmarks(spark, monkeypatch):
    monkeypatch.setattr(chroma, "HOT", 3)
    marks = spark.createDataFrame([(7, k, k % 5) for k in range(20)] + [(7, 3, 9), (8, 2, 1), (9, 4, 1), (9, 6, 2)], "mark long, k long, at int")
    got = chroma.chained(marks).collect()
    joined = components.components(spark.createDataFrame([(r.to, r.k) for r in got if r.mark == 7], "a long, b long")).select("component").distinct().collect()
    assert [r.component for r in joined] == [0] and all(r.to < r.k and r.to_at == r.to % 5 for r in got if r.mark == 7)
    assert [(r.k, r.to, r.to_at) for r in got if r.mark != 7] == [(6, 4, 1)] and len(got) == 20


# --- near copies


def test_parities_bound_the_difference_from_below(spark):
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)) for n in (1, 40, 64, 65, 70, 126, 130, 150)]
    sets = [np.unique(np.concatenate([s, sets[-1][: len(s) // 2]])) for s in sets]
    pairs = [(i, j, len(a), len(b), len(np.setxor1d(a, b)), simhash.parities(a).tolist(), simhash.parities(b).tolist()) for i, a in enumerate(sets) for j, b in enumerate(sets) if max(len(a), len(b)) <= 2 * min(len(a), len(b))]
    df = spark.createDataFrame(pairs, "i int, j int, n int, m int, d int, a array<long>, b array<long>")
    got = df.withColumn("p", simhash.parity_distance(F.col("a"), F.col("b"))).collect()
    assert all(r.p <= r.d and (r.d - r.p) % 2 == 0 and (r.p == 0) == (r.i == r.j) for r in got) and any(len(r.a) != len(r.b) for r in got)


def all_pair_components(texts):
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.lower().split() for t in texts)]
    root = list(range(len(texts)))
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j]))]
    for _ in texts:
        for i, j in pairs:
            root[i] = root[j] = min(root[i], root[j])
    return root


@pytest.mark.parametrize(("common", "partners"), [(16, 8), (2, 1)])
def test_a_dense_group_and_passages_of_many_texts(spark, monkeypatch, common, partners):
    """Copies whose similarity is about the limit, texts around one passage and texts of nothing but shared passages."""
    monkeypatch.setattr(simhash, "COMMON", common)
    monkeypatch.setattr(simhash, "PARTNERS", partners)
    rng = random.Random(8)
    new = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    base, passage, parts, texts = new(150), new(60), [new(30) for _ in range(6)], []
    for _ in range(60):
        own = list(base)
        for _ in range(rng.randrange(1, 4)):
            own[rng.randrange(150)] = new(1)[0]
        texts.append(" ".join(own))
    texts += [" ".join(new(40) + passage + new(40)) for _ in range(40)]
    texts += [" ".join(sum((parts[i] for i in rng.sample(range(6), 4)), [])) for _ in range(40)]
    rng.shuffle(texts)
    want = all_pair_components(texts)
    got = {r.k: r.component for r in simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect()}
    assert [got.get(i, i) for i in range(len(texts))] == want and len(set(want)) > 50


def test_scratch_folders_go(spark):
    with common.scratch():
        path = common.shared_folder(spark, "x")
        spark.range(3).write.parquet(path)
        assert spark.read.parquet(path).count() == 3
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    assert not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


# --- sharding and token shards


def test_shards_replay_the_matrix(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK_ROWS", 40)
    docs = spark.createDataFrame([(i, f"t {i % 90}") for i in range(700)] + [(None, None)] * 2, "doc_id long, text string").repartition(5)
    got = sharding.shard(docs, 16, 7)
    crc = F.crc32(F.coalesce(F.col("text").cast("binary"), F.lit(b"")))
    hashes = [F.xxhash64("doc_id", crc, F.lit(7 + i)) for i in range(3)]
    seen = [r.asDict() for r in docs.select("doc_id", "text", crc.alias("crc"), *(h.alias(f"h{i}") for i, h in enumerate(hashes))).collect()]
    p = -(-len(seen) // 40)
    blocks = [sorted((r for r in seen if r["h0"] % p == b), key=lambda r: (r["h1"], r["doc_id"] or -1)) for b in range(p)]
    sizes = [len(seen) // 16 + (s < len(seen) % 16) for s in range(16)]
    parts = -(-max(sizes) // 40)
    cells = [n // parts + (j < n % parts) for n in sizes for j in range(parts)]
    before = np.concatenate([[0], np.cumsum([len(b) for b in blocks])])
    sent = [[] for _ in cells]
    for b, own in enumerate(blocks):
        row = sharding.matrix_row(b, before, np.array(cells), 7)
        assert row.sum() == len(own)
        for c, n in enumerate(row):
            sent[c] += own[:n]
            own = own[n:]
    assert [len(x) for x in sent] == cells
    want = []
    for s in range(16):
        slot = 0
        for c in range(s * parts, (s + 1) * parts):
            for r in sorted(sent[c], key=lambda r: (r["h2"], r["doc_id"] or -1)):
                want.append((s, slot, r["doc_id"], r["crc"]))
                slot += 1
    assert sorted((r.shard, r.slot, r.doc_id, r.text_crc32) for r in got.collect()) == sorted(want, key=lambda x: x[:2])


def test_draws_beyond_numpy_have_the_law(monkeypatch):
    cells, n = np.array([300, 500, 200]), 100
    small = np.array([sharding.draw(np.random.default_rng(i), cells, n) for i in range(3000)])
    monkeypatch.setattr(sharding, "NUMPY_ROWS", 10)
    large = np.array([sharding.draw(np.random.default_rng(i), cells, n) for i in range(3000)])
    assert (large.sum(axis=1) == n).all() and np.allclose(large.mean(axis=0), cells / 10, atol=0.3)
    assert np.allclose(large.std(axis=0), small.std(axis=0), rtol=0.06)
    exact = [math.comb(300, x) * math.comb(700, n - x) / math.comb(1000, n) for x in range(101)]
    assert np.abs(np.bincount(large[:, 0], minlength=101) / 3000 - exact).max() < 0.03
    monkeypatch.undo()
    huge = sharding.draw(np.random.default_rng(1), np.full(64, 10**10 // 64), 10**9)
    assert huge.sum() == 10**9 and np.abs(huge - 10**9 / 64).max() < 6 * (10**9 / 64) ** 0.5


def test_uniform_places(spark):
    """Each row is in each shard about equally often over seeds."""
    docs = spark.createDataFrame([(i, "x") for i in range(8)], "doc_id long, text string").coalesce(1)
    at = collections.Counter(r.shard for seed in range(60) for r in sharding.shard(docs, 2, seed).collect() if r.doc_id == 3)
    assert 15 <= at[0] <= 45


def test_a_whole_table_of_tokens_against_plain_python(spark):
    docs = [(i, t) for i, t in enumerate(["", None, prose(300), "a", "É <|endoftext|> ß", prose(63), prose(7)] * 4)]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    got = token_shards.shards(df, length=16, per_shard=8, key=5).collect()
    with open(token_shards.VOCABULARY, "rb") as f:
        encode = token_shards.encoder(f.read()).encode_ordinary
    made = []
    for doc_id, text in docs:
        ids = encode(text or "")
        for part in range(len(ids) // 16 + 1):
            own = ids[16 * part : 16 * part + 16]
            made.append((doc_id, part, len(own), struct.pack("<16H", *own, *[token_shards.END] * (16 - len(own)))))
    slots = token_shards.permute(np.arange(len(made)), len(made), 5).tolist()
    want = [(s, s // 8, s % 8 * 32, *m) for s, m in zip(slots, made, strict=True)]
    assert sorted(map(tuple, got)) == sorted(want) and sorted(slots) == list(range(len(made)))


# --- the pipeline, stage by stage


def plain_language(text, model):
    """The model's best language, by n-grams counted one at a time."""
    counts = collections.Counter()
    shown = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
    shown = "".join(c for i, c in enumerate(shown) if c != " " or i == 0 or shown[i - 1] != " ")
    m = 2**32
    one = [ord(c) * 0x9E3779B1 % m for c in shown]
    two = [((a ^ 0x85EBCA6B) * 0xC2B2AE35 + b) % m for a, b in zip(one, one[1:], strict=False)]
    three = [((a ^ 0x27D4EB2F) * 0x165667B1 + b) % m for a, b in zip(two, one[2:], strict=False)]
    for h in (*one, *two, *three):
        counts[(h ^ (h >> 15)) * 0x2C1B3C6D % m >> 18] += 1
    if not any(c.isalpha() for c in text):
        return None, 0.0
    x = {b: (1 + math.log(n)) * model["idf"][b] for b, n in counts.items()}
    length = math.sqrt(sum(v * v for v in x.values()))
    z = [sum(v / length * float(model["weights"][b][i]) for b, v in x.items()) / model["temperature"] for i in range(len(model["languages"]))]
    e = [math.exp(v - max(z)) for v in z]
    return model["languages"][e.index(max(e))], max(e) / sum(e)


def test_pipeline_against_brute_force(spark, tmp_path):
    words = {"xx": ["bala", "bolo", "bamba", "lomba"], "yy": ["kirik", "krik", "kitik", "sirt"]}
    say = lambda k, n: " ".join(R.choice(words[k]) + str(R.randrange(50)) * (R.random() < 0.5) for _ in range(n))
    leak = say("xx", 30)
    docs = [(i, say(k, 40 + i % 9), k, "big" if i % 7 else "small", 1) for i, k in enumerate(["xx", "yy"] * 50)]
    docs += [(200 + i, docs[i][1] + " tail", *docs[i][2:]) for i in range(12)] + [(300 + i, docs[20][1], *docs[20][2:]) for i in range(5)]
    docs += [(400 + i, say("xx", 5) + " " + leak[: 60 + 30 * i] + " " + say("xx", 20), "xx", "big", 1) for i in range(5)] + [(500, None, "xx", "big", 1), (501, "12 !", "yy", "small", 1), (502, "", None, None, 0)]
    bench = [("a", leak), ("b", say("yy", 25))]
    spark.createDataFrame(docs, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(bench, "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    model = langid.train(spark.read.parquet(str(tmp_path / "documents.parquet")))
    left = [d for d in docs if plain_language(d[1] or "", model)[1] >= 0.5]
    assert len(left) == len(docs) - 3
    root = all_pair_components([d[1] for d in sorted(left)])
    left = [d for i, d in enumerate(sorted(left)) if root[i] == i]
    norm = lambda t: "".join(c if c.isalnum() and c.isascii() or not c.isascii() else " " for c in t.lower()).split()
    grams = {tuple(w[i : i + 10]) for _, t in bench for w in [norm(t)] for i in range(len(w) - 9)}
    clean = [d for d in left if not any(tuple(norm(d[1])[i : i + 10]) in grams for i in range(len(norm(d[1]))))]
    assert 0 < len(clean) < len(left) < len(docs) - 15
    c = duckdb.connect()
    c.execute("create table documents (doc_id bigint, text varchar, lang varchar, source varchar, n_chars bigint)")
    c.executemany("insert into documents values (?, ?, ?, ?, ?)", clean)
    mixed = collections.Counter(r[0] for r in c.execute(f"select doc_id from ({mixing.MIX_SQL})").fetchall())
    assert collections.Counter(r.doc_id for r in got) == mixed and max(mixed.values()) == 2
    sizes = collections.Counter(r.shard for r in got)
    assert set(sizes) <= set(range(16)) and max(sizes.values()) - min(sizes[s] for s in range(16)) <= 1
    texts = {d[0]: d[1] for d in docs}
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(n)) for s, n in sizes.items())
    assert all(r.text == texts[r.doc_id] and r.text_crc32 == zlib.crc32(r.text.encode()) and r.size == len(r.text.encode()) + 1 for r in got)


# --- components


def test_components_in_one_task_and_by_stars(spark):
    rng = np.random.default_rng(5)
    pairs = {tuple(sorted(p)) for p in rng.integers(-60, 60, (70, 2)).tolist() if p[0] != p[1]} | {(i, i + 1) for i in range(100, 140)}
    least = {n: n for p in pairs for n in p}
    for _ in least:
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
    edges = spark.createDataFrame([*pairs, *list(pairs)[:9]], "a long, b long").repartition(4)
    for few in (0, 1000):
        assert {r.node: r.component for r in components.components(edges, few=few).distinct().collect()} == least
        assert not components.components(edges.limit(0), few=few).count()


def test_parities_bound_differences():
    rng = np.random.default_rng(6)
    assert all(len(simhash.parities(np.unique(rng.integers(0, 2**63, n).astype(np.uint64)))) * 64 >= 2 * n for n in (1, 31, 32, 33, 500, 4097))


@pytest.mark.parametrize("hot", [10_000, 2])
def test_a_link_that_the_chain_of_its_landmark_passes_over(spark, monkeypatch, hot):
    rng = np.random.default_rng(6)
    a, apart = rng.integers(0, 2**32, 30, dtype=np.uint32), [rng.integers(0, 2**32, 30, dtype=np.uint32) for _ in range(4)]
    fps = [a, *apart, a ^ np.uint32(1)]  # 0 and 5 are near copies; the others share a landmark with both
    rows = [(i, f.tobytes()) for i, f in enumerate(fps)]
    monkeypatch.setattr(chroma, "HOT", hot)
    marks = spark.createDataFrame([(7, i, 3) for i in range(6)], "mark long, k long, at int")
    alone = spark.createDataFrame([], "node long, component long")
    got = chroma.across(marks, alone, spark.createDataFrame(rows, "k long, fp binary")).select("k", "to", "offset").distinct().collect()
    assert [tuple(r) for r in got] == [(5, 0, 0)]
    assert (5, 0) not in {(r.k, r.to) for r in chroma.chained(marks).collect()}


def test_recordings_of_one_class_though_the_chain_parts_them(spark, monkeypatch):
    t = np.arange(4_000) / 8000
    tune = lambda notes: np.concatenate([np.sin(2 * np.pi * 220 * 2 ** (n / 12) * t) for n in notes])
    pcm = lambda x: (x * 100 + 128).clip(0, 255).astype(np.uint8).tobytes()
    near = [0, 4, 7, 2, 9, 5, 3, 11]
    media = [tune(near), tune([6, 1, 8, 10, 1, 6, 10, 8]), tune(near[:-1] + [10])]
    fps = [chroma.integers(chroma.chroma(pcm(x))) for x in media]
    monkeypatch.setattr(chroma, "landmarks", lambda fp: np.array([40]))  # one place, made common to all below
    monkeypatch.setattr(chroma, "integers", lambda c, real=chroma.integers: np.where(np.arange(max(0, len(c) - chroma.SPAN + 1)) == 40, 9, real(c)).astype(np.uint32))
    assert len({len(f) for f in fps}) == 1
    got = {r.doc_id: r.class_id for r in chroma.match(spark.createDataFrame([(i, pcm(x)) for i, x in enumerate(media)], "doc_id long, media binary"), "media").collect()}
    assert got == {0: 0, 1: 1, 2: 0}


def test_near_copies_are_sought_by_fingerprints_first(spark, monkeypatch):
    words, asked = [f"w{i}" for i in range(400)], []
    texts = [" ".join(words), " ".join([*words, "end"]), prose(300)]
    assert (simhash.fingerprint(texts[0].encode()) ^ simhash.fingerprint(texts[1].encode())).bit_count() <= 3
    monkeypatch.setattr(simhash, "partners", lambda multi: multi.select(F.col("s").alias("x"), F.col("s").alias("y")).limit(0))
    monkeypatch.setattr(simhash, "verified", lambda open_, *x, real=simhash.verified: asked.append(open_.count()) or real(open_, *x))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [(r.k, r.component) for r in simhash.near_duplicates(df).collect()] == [(1, 0)] and asked == [1]


def test_a_pair_is_made_at_the_first_open_key_it_shares(spark):
    """Two sets of 100 shingles: eight keys of their own first, then one of their component's, then twelve that both have."""
    rows = [(key, s, 100, pos) for s in (1, 2) for pos, key in enumerate([*range(1000 * s, 1000 * s + 8), 500 + s, *range(12)])]
    rows += [(500 + s, 10 + s, 100, 0) for s in (1, 2)]
    multi = spark.createDataFrame(rows, "key long, s long, n int, pos int")
    found = spark.createDataFrame([(s, c) for c in (1, 2) for s in (c, 10 + c)], "node long, component long")
    sizes = spark.createDataFrame([(s, 100, [0] * 4, list(range(1000 * s, 1000 * s + 4))) for s in (1, 2, 11, 12)], "s long, n int, bits array<long>, head array<long>")
    assert [(r.x, r.y) for r in simhash.open_pairs(multi, found, sizes).collect()] == [(1, 2)]


def test_the_chain_is_freed_before_all_pairs(spark, monkeypatch):
    calls, real = [], chroma.across
    monkeypatch.setattr(chroma, "freed", lambda s: calls.append("freed"))
    monkeypatch.setattr(chroma, "across", lambda *a: calls.append("across") or real(*a))
    chroma.match(spark.createDataFrame([(1, "a" * 4000)], "doc_id long, text string")).count()
    assert calls[:2] == ["freed", "across"]
