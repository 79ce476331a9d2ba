"""Operators over documents against brute force on small tables that hold every odd case."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from weftgraph.llm import crf, ctph, mcd, mil, mixing, packing, quality_stats, queries, simhash, words
from weftgraph.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " \n\t ", "a", "a b", "a b c a b c", "x\ny\nx\n\nx", "é è ü\x0bé è ü \x1c q", "\nA\r\nA\r\n", "a a a a", " a ", "#|$ <b>&% *", "don't I'M x's 12.5%", "ΣΑΣ İ é́", "a\x01b c", "<|endoftext|> hi", "日本語 テスト 中"]


def texts(n, seed=0, words_of=200):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(500)]
    return [" ".join(rng.choice(vocabulary) + ("." if rng.random() < 0.1 else "") + ("\n" if rng.random() < 0.03 else "") for _ in range(rng.randint(60, words_of))) for _ in range(n)]


@pytest.fixture(scope="module")
def documents(spark):
    """Odd texts, plain ones, copies, near copies, a very long one, repeated rows and missing keys."""
    plain = texts(40)
    near = [plain[0] + " tail", plain[0].replace("a", "b", 1), plain[1]]
    rows = [*ODD, *plain, *near, plain[2] * 60]
    made = [(i, t, None if i % 11 == 0 else "en", "s0" if i % 3 else None, len(t or "")) for i, t in enumerate(rows)]
    made += [made[20], made[20], (None, plain[5], "en", "s0", 5)]
    return spark.createDataFrame(made, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(documents):
    """Extra columns whose names are those of operators' own."""
    return documents.select("doc_id", "text", F.lit("x").alias("TEXT"), F.lit(1).alias("DOC_ID"), "lang", "source", "n_chars", *[F.lit(7).alias(c) for c in ("n_words", "fp", "score", "kept", "words", "rate", "copies", "posterior", "rank", "bucket", "nth", "head")])


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_statistics(text):
    own = split(text)
    lines = [x for x in (text or "").split("\n") if split(x)]
    windows = Counter(tuple(own[i : i + 3]) for i in range(len(own) - 2))
    inside = {i + j for i in range(len(own) - 2) if windows[tuple(own[i : i + 3])] > 1 for j in range(3)}
    return len(own), sum(map(len, own)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside), len(lines)


def test_words_of_slices():
    for limit in (1, 50, 1 << 20):
        batch = pa.RecordBatch.from_arrays([pa.array(ODD)], names=["text"]).slice(1)
        found = [[t.decode() for t in own.to_pylist()] for _, own in words.slices(batch, limit=limit)]
        assert list(itertools.chain(*found)) == [t or "" for t in ODD[1:]]
    w = words.Words(words.text_array(pa.array(ODD)))
    codes, known = w.encoded()
    names = [known[int(c)].as_py().decode() for c in codes]
    assert [names[a:b] for a, b in zip(w.bounds[:-1], w.bounds[1:])] == [split(t) for t in ODD]


def test_statistics_equal_brute_force():
    every = [*ODD, *texts(30, 3)]
    found = quality_stats.statistics(words.text_array(pa.array(every)))
    assert [tuple(int(found[k][i]) for k in quality_stats.NAMES) for i in range(len(every))] == [plain_statistics(t) for t in every]
    assert len(quality_stats.statistics(words.text_array(pa.array([], pa.string())))["n_words"]) == 0


def test_rules_on_odd_documents(documents, empty):
    rows = mcd.rules(documents).collect()
    assert len(rows) == documents.count()
    by_id = {r.doc_id: r for r in rows}
    for d in documents.collect():
        r, (n, chars, symbols, dup, repeat, _) = by_id[d.doc_id], plain_statistics(d.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeat)
        assert r.base_failed == (n < 50 or 100 * repeat > 50 * n) and not (r.base_failed and r.kept)
    assert mcd.rules(empty).collect() == []
    assert mcd.keep(empty).columns == empty.columns and mcd.keep(empty).count() == 0
    extra = clashing(documents)
    kept = mcd.keep(extra)
    assert kept.columns == extra.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted(r.doc_id or -1 for r in rows if r.kept)


def test_robust_estimate_withstands_a_hot_group_of_junk(spark):
    """A third of a group's rows in one far place moves neither its model nor the verdicts."""
    rng = np.random.default_rng(0)
    rows = [(i, "en", "hot", 200, int(200 * math.exp(rng.normal(1.6, 0.04))), 0, 0, int(rng.integers(0, 9)), 10) for i in range(600)]
    rows += [(600 + i, "en", "hot", 200, 1500, 300, 0, 0, 10) for i in range(300)]
    stats = spark.createDataFrame(rows, "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in mcd.STATS))
    verdicts = mcd.verdicts(stats, mcd.fit(stats)).collect()
    assert all(r.kept == (r.doc_id < 600) for r in verdicts)


def test_small_sources_have_estimates_of_their_own(spark):
    """Two sources of 60 rows lie far apart, each with five rows that are ordinary in the other one."""
    rng = np.random.default_rng(6)
    place = {"a": 1.4, "b": 2.2}
    rows = []
    for source, other in (("a", "b"), ("b", "a")):
        for k in range(60):
            at = place[other if k < 5 else source]
            rows.append((len(rows), "de", source, 200, int(200 * math.exp(rng.normal(at, 0.02))), 0, 0, 4, 10, k < 5))
    stats = spark.createDataFrame([r[:-1] for r in rows], "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in mcd.STATS))
    models = mcd.fit(stats)
    assert models.select("grp").distinct().count() == 2
    strange = {r[0] for r in rows if r[-1]}
    assert all(r.kept == (r.doc_id not in strange) for r in mcd.verdicts(stats, models).collect())


def test_concentration_steps_equal_numpy(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "en", "a", 500, int(500 * math.exp(rng.normal(1.6, 0.2))), int(rng.integers(0, 300)), int(rng.integers(0, 8)), int(rng.integers(0, 240)), 10) for i in range(400)]
    stats = spark.createDataFrame(rows, "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in mcd.STATS))
    model = mcd.fit(stats, steps=3).collect()[0]
    rate = lambda a, b: np.arcsin(np.sqrt(np.minimum(1, a / np.maximum(b, 1))))
    s = np.array([r[3:] for r in rows], float)
    x = np.round(1000 * np.stack([np.log(s[:, 1] / s[:, 0]), rate(s[:, 2], s[:, 1]), rate(s[:, 3], s[:, 5]), rate(s[:, 4], s[:, 0])], 1))
    floor = (np.array(mcd.FLOORS) * 1000) ** 2
    mean = np.median(x, 0)
    precision = np.diag(1 / np.maximum(1.4826 * np.median(abs(x - mean), 0), np.sqrt(floor)) ** 2)
    scale = mcd.chi2_cdf(mcd.chi2_quantile(0.5, 4), 6) / 0.5
    for _ in range(3):
        near = np.round(1000 * np.log1p(np.einsum("ni,ij,nj->n", x - mean, precision, x - mean)))
        own = x[near <= np.quantile(near, 0.5)]
        mean, cov = own.mean(0), np.cov(own.T, bias=True) / scale
        precision = np.linalg.inv(cov + np.diag(np.maximum(floor - np.diag(cov), 0.05 * floor)))
    assert np.allclose([model[f"m{i}"] for i in range(4)], mean)
    assert np.allclose([model[f"p{i}{j}"] for i, j in mcd.PAIRS], [precision[i, j] for i, j in mcd.PAIRS])


def plain_simhash(text):
    own = [w.translate({c: c + 32 for c in range(65, 91)}) for w in split(text)]
    shingles = [" ".join(own[i : i + 3]) for i in range(max(len(own) - 2, 1))] if own else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_equal_brute_force():
    every = [*ODD, *texts(10, 5), "One TWO Three four"]
    assert simhash.fingerprints(words.text_array(pa.array(every))).tolist() == [plain_simhash(t) for t in every]


def test_fingerprints_use_sparks_hash(spark):
    spoken = "alpha beta gamma"
    assert spark.range(1).select(F.xxhash64(F.lit(spoken))).first()[0] & (2**64 - 1) == plain_simhash(spoken)


def test_pairs_equal_brute_force(spark):
    rng = random.Random(4)
    centers = [rng.getrandbits(64) for _ in range(30)] + [0, 2**64 - 1, 0x5555555555555555, 0xAAAAAAAAAAAAAAAA]
    own = {c ^ sum(1 << b for b in rng.sample(range(64), k)) for c in centers for k in (0, 1, 2, 3, 4, 5) for _ in range(4)}
    signed = lambda x: x - 2**64 if x >> 63 else x
    found = simhash.pairs(spark.createDataFrame([(signed(x),) for x in own], "fp long")).collect()
    expected = {frozenset((signed(a), signed(b))) for a, b in itertools.combinations(own, 2) if (a ^ b).bit_count() <= 3}
    assert {frozenset((r.a, r.b)) for r in found} == expected and len(found) == len(expected)


def test_components_equal_brute_force(spark):
    rng = random.Random(6)
    links = [(i, i + 1) for i in range(60)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)] + [(300, 300), (None, 5)]
    links += [(500, i) for i in range(501, 560)]
    found = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    assert found == {x: root(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_components(rows):
    prints = {t: plain_simhash(t) for t in {r.text for r in rows}}
    groups = []
    for f in set(prints.values()):
        met = [g for g in groups if any((f ^ x).bit_count() <= 3 for x in g)]
        groups = [g for g in groups if g not in met] + [set().union({f}, *met)]
    first = {f: min((r.doc_id for r in rows if prints[r.text] in g and r.doc_id is not None), default=None) for g in groups for f in g}
    return [(r.doc_id, prints[r.text], first[prints[r.text]]) for r in rows]


def test_near_duplicates_on_odd_documents(documents, empty):
    rows = documents.collect()
    found = simhash.near_duplicates(documents).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in found), key=key) == sorted(plain_components(rows), key=key)
    assert simhash.near_duplicates(empty).count() == 0 and simhash.deduplicate(empty).count() == 0
    extra = clashing(documents)
    kept = simhash.deduplicate(extra)
    assert kept.columns == extra.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in plain_components(rows)})


def test_passages_cover_whole_texts():
    long = " ".join(f"w{i}" for i in range(64 * 3 + 1))
    features, bounds = mil.passages(words.text_array(pa.array([None, long, "  ", "a b"])))
    assert np.diff(bounds).tolist() == [1, 4, 1, 1]
    n_words = features[:, mil.N_CLASSES + 1] * 64
    assert np.allclose(n_words, [0, 64, 64, 64, 1, 0, 2])
    # A change in the last passage is seen.
    other, _ = mil.passages(words.text_array(pa.array([None, long[:-1] + "#", "  ", "a b"])))
    assert not np.allclose(features[4], other[4]) and np.allclose(features[:4], other[:4])


def plain_passages(text):
    """Features of each passage, from the text's bytes in loops."""
    data = (text or "").encode()
    found = [(m.start(), m.group()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", data)]
    out = []
    for k in range(max(1, -(-len(found) // 64))):
        own = found[64 * k : 64 * k + 64]
        begin = own[0][0] if k else 0
        part = data[begin : found[64 * k + 64][0] if 64 * k + 64 < len(found) else len(data)]
        counts = [0] * mil.N_CLASSES
        for b in part:
            c = chr(b)
            if b >= 128:
                at = 7 if b < 192 else 6
            elif b in mil.MARKS:
                at = 8 + mil.MARKS.index(b)
            else:
                at = 1 if "a" <= c <= "z" else 2 if "A" <= c <= "Z" else 3 if "0" <= c <= "9" else 4 if c in "\t " else 5 if c == "\n" else 0
            counts[at] += 1
        words_of = [w for _, w in own]
        n = max(1, len(own))
        points = len(part.decode("utf-8", "ignore"))
        same = sum(a == b for a, b in zip(words_of, words_of[1:]))
        out.append([math.sqrt(c / max(1, len(part))) for c in counts] + [math.log1p(points / n) - 1.5, len(own) / 64, len(set(words_of)) / n, math.sqrt(same / n), float(not own)])
    return out


def plain_score(w, passages):
    """Gated attention over passages, one by one."""
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    logistic = lambda x: 1 / (1 + math.exp(-x))
    encodings, logits = [], []
    for p in passages:
        x = [(v - m) / s for v, m, s in zip(p, w["mean"], w["scale"])]
        h = [math.tanh(dot(x, w["encode"][:, j]) + w["encode0"][j]) for j in range(w["encode"].shape[1])]
        gated = [math.tanh(dot(h, w["tanh"][:, j])) * logistic(dot(h, w["gate"][:, j])) for j in range(w["tanh"].shape[1])]
        encodings.append(h)
        logits.append(dot(gated, w["attend"]))
    weights = [math.exp(x - max(logits)) for x in logits]
    bag = [sum(a * h[j] for a, h in zip(weights, encodings)) / sum(weights) for j in range(len(w["out"]))]
    return logistic(dot(bag, w["out"]) + w["out0"])


def test_passages_and_scores_equal_a_plain_pass():
    every = [*ODD, *texts(12, 31, 300), "é" * 500 + " x " * 200, " ".join(["same"] * 130)]
    features, bounds = mil.passages(words.text_array(pa.array(every)))
    plain = [plain_passages(t) for t in every]
    assert np.diff(bounds).tolist() == [len(p) for p in plain]
    assert np.allclose(features, np.array([x for p in plain for x in p]), atol=1e-5)
    y = np.array([i % 3 > 0 for i in range(len(every))], float)
    model = mil.train(features, bounds, y, epochs=3)
    assert np.allclose(model.score(features, bounds), [plain_score(model.weights, p) for p in plain], atol=1e-5)


def test_attention_gradients_by_differences():
    rng = np.random.default_rng(2)
    x, bounds, y = rng.normal(size=(9, 5)), np.array([0, 2, 3, 9]), np.array([1.0, 0.0, 1.0])
    w = {"mean": np.zeros(5), "scale": np.ones(5)} | {k: rng.normal(size=s) for k, s in (("encode", (5, 4)), ("encode0", 4), ("tanh", (4, 3)), ("gate", (4, 3)), ("attend", 3), ("out", 4), ("out0", ()))}

    def loss():
        p = mil.sigmoid(mil.forward(w, x, bounds)["logit"])
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    for name, grad in mil.gradients(w, x, bounds, y).items():
        w[name] = np.array(w[name])
        for i in np.ndindex(*np.shape(grad)):
            held = w[name][i]
            w[name][i] = held + 1e-6
            up = loss()
            w[name][i] = held - 1e-6
            down = loss()
            w[name][i] = held
            assert abs((up - down) / 2e-6 - np.asarray(grad)[i]) < 1e-6


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


def accuracy(spark, sf_dir, found, label):
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = [(r.predicted, labels[r.doc_id], r.score) for r in found if r.held_out and r.doc_id in labels]
    good, bad = [s for _, y, s in rows if y], [s for _, y, s in rows if not y]
    return sum(a == b for a, b, _ in rows) / len(rows), sum(a > b for a in good for b in bad) / (len(good) * len(bad))


def test_quality_classifier_on_held_out_labels(spark):
    from weftgraph.llm import queries

    sf = "/root/testdata/sf0.01"
    found = queries.op4_quality_classifier(spark, sf).collect()
    assert all(r.held_out == (fold(r.doc_id, 5) == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found)
    right, area = accuracy(spark, sf, found, "quality")
    assert right > 0.95 and area > 0.97


def test_toxicity_on_held_out_labels(spark):
    from weftgraph.llm import queries

    sf = "/root/testdata/sf0.01"
    found = queries.op9_toxicity_crf(spark, sf).collect()
    assert all(r.held_out == (fold(r.doc_id, 4) == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found)
    right, area = accuracy(spark, sf, found, "toxic")
    assert right > 0.9 and area > 0.85


@pytest.mark.parametrize("module", [mil, crf])
def test_classifiers_on_odd_documents(spark, documents, empty, module):
    label = {mil: "quality", crf: "toxic"}[module]
    schema = f"doc_id long, {label} int"
    for labels in (spark.createDataFrame([], schema), spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (3, None), (9999, 1)], schema), spark.createDataFrame([(i, 1) for i in range(9)], schema)):
        found = module.classify(clashing(documents), labels).collect()
        assert len(found) == documents.count() and all(0 <= r.score <= 1 for r in found)
    assert module.classify(empty, labels).count() == 0


def test_labels_of_held_out_rows_teach_nothing(spark, documents):
    ids = [r.doc_id for r in documents.collect() if r.doc_id is not None]
    told = lambda flip: spark.createDataFrame([(i, (i + (flip and fold(i, 5) == 0)) % 2) for i in ids], "doc_id long, quality int")
    a, b = ({r.doc_id: r.score for r in mil.classify(documents, told(f)).collect()} for f in (False, True))
    assert a == b


def test_beliefs_equal_enumeration():
    rng = np.random.default_rng(3)
    counts = np.array([5, 0, 3, 1])
    e, move = rng.normal(size=9), rng.normal(size=(2, 2))
    toxic, clean, moved = crf.beliefs(e, crf.Chains(counts), move)
    at, expected, transitions = 0, [], np.zeros((2, 2))
    chances = []
    for n in counts[counts > 0]:
        weights = {}
        for tags in itertools.product((0, 1), repeat=int(n)):
            weights[tags] = math.exp(sum(e[at + i] * t for i, t in enumerate(tags)) + sum(move[a, b] for a, b in zip((0, *tags), tags)))
        z = sum(weights.values())
        expected += [sum(w for t, w in weights.items() if t[i]) / z for i in range(n)]
        for tags, w in weights.items():
            for a, b in zip((0, *tags), tags):
                transitions[a, b] += w / z
        chances.append(math.log(weights[(0,) * int(n)] / z))
        at += n
    assert np.allclose(toxic, expected) and np.allclose(clean, chances) and np.allclose(moved, transitions)


@pytest.mark.parametrize("window", [1, 2, 3])
def test_a_text_is_one_chain(monkeypatch, window):
    monkeypatch.setattr(crf, "WINDOW", window)
    test_beliefs_equal_enumeration_by_text()


def test_beliefs_equal_enumeration_by_text():
    rng = np.random.default_rng(4)
    counts = np.array([7, 0, 4, 1, 6])
    e, move = rng.normal(size=18) * 3, rng.normal(size=(2, 2))
    chains = crf.Chains(counts)
    toxic, clean, moved = crf.beliefs(e, chains, move)
    by_text = np.array([clean[a:b].sum() for a, b in zip(chains.bounds, chains.bounds[1:])])
    at, transitions = 0, np.zeros((2, 2))
    for n, chance in zip(counts.tolist(), by_text):
        weights = {tags: math.exp(sum(e[at + i] * t for i, t in enumerate(tags)) + sum(move[a, b] for a, b in zip((0, *tags), tags))) for tags in itertools.product((0, 1), repeat=n)}
        z = sum(weights.values())
        assert np.allclose(toxic[at : at + n], [sum(w for t, w in weights.items() if t[i]) / z for i in range(n)])
        assert np.isclose(chance, math.log(weights[(0,) * n] / z))
        for tags, w in weights.items():
            for a, b in zip((0, *tags), tags):
                transitions[a, b] += w / z
        at += n
    assert np.allclose(moved, transitions)


def test_long_texts_have_no_seams(monkeypatch):
    rng = np.random.default_rng(5)
    counts = np.array([1000, 64, 65, 300, 0, 128])
    e, move = rng.normal(size=counts.sum()) * 8 - 4, np.array([[0.0, -3.0], [-3.0, 3.0]])
    toxic, clean, moved = crf.beliefs(e, crf.Chains(counts), move)
    monkeypatch.setattr(crf, "WINDOW", 1000)
    whole = crf.beliefs(e, crf.Chains(counts), move)
    assert np.allclose(toxic, whole[0]) and np.isclose(clean.sum(), whole[1].sum()) and np.allclose(moved, whole[2])


def test_spans_name_the_words(spark):
    rows = [(f"é you are a friend, all is fine here {i} today", 0.0) for i in range(30)] + [(f"é you are a filth{i % 4}y filth, today", 1.0) for i in range(30)]
    model = crf.train(rows)
    text = "é today a filthy, fine"
    scores, spans = model.tag(pa.array([text.encode(), b"all is fine", b""], pa.large_binary()))
    assert [text[s["start"] : s["end"]] for s in spans[0]] == ["filthy,"] and scores[0] > 0.5 > scores[1] and scores[2] == 0


def test_scores_do_not_grow_with_length():
    """Clean texts joined to long ones stay clean, and harmless words in front change no span."""
    rng = random.Random(12)
    clean, foul = texts(500, 7), ["filthy", "vileness", "scummy", "rotten", "wretched"]
    rows = [(t, 0.0) for t in clean[:300]]
    for t in clean[300:400]:
        own = t.split()
        for _ in range(3):
            own.insert(rng.randrange(len(own)), rng.choice(foul))
        rows.append((" ".join(own), 1.0))
    model = crf.train(rows)
    tag = lambda every: model.tag(pa.array([t.encode() for t in every], pa.large_binary()))
    for joined in (1, 10, 100):
        scores, spans = tag([" ".join(clean[400 + i * joined % 100 : 400 + i * joined % 100 + joined]) for i in range(100 // joined)])
        assert (scores < 0.3).all()
    bad = [t for t, y in rows if y][:20]
    scores, spans = tag(bad)
    assert (scores > 0.5).all()
    for n in (1, 17, 63, 64, 65, 200):
        front = " ".join((clean[450] + " " + clean[451] + " " + clean[452]).split()[:n]) + " "
        moved = tag([front + t for t in bad])[1]
        assert [[(s["start"] + len(front), s["end"] + len(front)) for s in own] for own in spans] == [[(s["start"], s["end"]) for s in own] for own in moved]


def test_logistic_equals_a_plain_search():
    rng = np.random.default_rng(2)
    x = rng.normal(size=200)
    y = (rng.random(200) < 1 / (1 + np.exp(1 - 2 * x))).astype(float)
    loss = lambda a, b: -sum(math.log(p if t else 1 - p) for p, t in zip(1 / (1 + np.exp(-a - b * x)), y)) + 0.005 * (a * a + b * b)
    a, b = crf.logistic(x, y)
    assert all(loss(a, b) <= loss(a + da, b + db) for da in (-0.01, 0, 0.01) for db in (-0.01, 0, 0.01))
    assert crf.logistic(x, 1 - y)[1] == 0.0


def test_mixture_meets_targets(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = mixing.quality_domains(spark.read.parquet(f"{sf}/labels.parquet"))
    targets = {"quality 1, toxic 0": 0.9, "quality 0, toxic 0": 0.05, "quality 1, toxic 1": 0.05}
    model = mixing.fit(docs, labels, targets)
    rows = mixing.with_posteriors(docs.select("doc_id", "text"), model).drop("text")
    cells = rows.groupBy("posterior").agg(F.sum("words").alias("words"))
    rates, goal, reached = mixing.solve(cells, np.array([targets[d] for d in model.domains]))
    assert np.allclose(reached, goal, rtol=1e-3)
    held = rows.collect()
    p = np.array([r.posterior for r in held], float)
    p /= p.sum(1, keepdims=True)
    t = np.array([r.words for r in held], float)
    assert np.allclose((t * rates(p)) @ p, reached) and (rates(p) >= 0).all()
    # The point of least squares: one plain solution of the same problem by clipped multipliers.
    z, metric = np.zeros(3), np.linalg.inv((p * t[:, None]).T @ p)
    for _ in range(200):
        z -= metric @ ((t * np.maximum(0, 1 + p @ z)) @ p - goal)
    assert np.allclose(rates(p), np.maximum(0, 1 + p @ z), atol=5e-3)


def test_every_labelled_domain_has_a_target(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = mixing.quality_domains(spark.read.parquet(f"{sf}/labels.parquet"))
    assert {r.domain for r in labels.select("domain").distinct().collect()} == set(queries.TARGETS)
    rows = mixing.mix(docs, labels, queries.TARGETS).join(labels.withColumnRenamed("domain", "told"), "doc_id").collect()
    unwanted = [r for r in rows if r.told == "quality 0, toxic 1"]
    assert all(len(r.posterior) == 4 for r in rows) and sum(r.domain == r.told for r in unwanted) > len(unwanted) / 2
    share = lambda held: sum(r.words * r.rate for r in held) / sum(r.words for r in held)
    assert share(unwanted) < 0.2 * share(rows)


def test_mixing_on_odd_documents(spark, documents, empty):
    labels = spark.createDataFrame([(i, "a" if i % 2 else "b") for i in range(50)] + [(None, "a"), (4, None)], "doc_id long, domain string")
    targets = {"a": 0.5, "b": 0.3, "never seen": 0.2}
    rows = mixing.mix(clashing(documents), labels, targets).collect()
    assert len(rows) == documents.count() and all(r.rate >= 0 and abs(r.copies - r.rate) < 1 for r in rows)
    assert mixing.mix(empty, labels, targets).count() == 0
    extra = clashing(documents)
    out = mixing.resample(extra, labels, targets)
    assert out.columns == extra.columns and out.count() == sum(r.copies for r in rows)
    bare = mixing.mix(documents, labels.limit(0), targets).collect()
    assert len(bare) == len(rows)


def plain_best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= n]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= n
        else:
            rooms.append(capacity - n)
    return len(rooms)


def test_plan_equals_best_fit_decreasing():
    rng = random.Random(8)
    for _ in range(100):
        capacity = rng.choice([4, 9, 17])
        counts = {n: rng.randint(1, 20) for n in range(1, capacity + 1) if rng.random() < 0.6}
        held, placed = defaultdict(list), Counter()
        for length, rank, n, first, each, offset in packing.plan(counts, capacity):
            assert rank == placed[length]
            placed[length] += n
            for j in range(n):
                held[first + j // each].append((offset + j % each * length, length))
        assert placed == Counter(counts)
        for own in held.values():
            at = 0
            for offset, length in sorted(own):
                assert offset == at
                at += length
            assert at <= capacity
        assert len(held) == plain_best_fit([n for n, k in counts.items() for _ in range(k)], capacity)


def test_rooms_find_the_tightest():
    rooms = packing.Rooms(37)
    rng, own = random.Random(9), set()
    for _ in range(500):
        room = rng.randint(0, 37)
        own ^= {room}
        rooms.set(room, room in own)
        least = rng.randint(0, 37)
        assert rooms.tightest(least) == min((r for r in own if r >= least), default=None)


def test_ids_equal_the_tokenizers_own():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    rng = random.Random(1)
    signs = [*"abzAZ019.,;!'\"*#$%&|<>_-^`~()[]{}@+=/\\ \n\t", *"éßÜ×÷ĀſıİΣς…“”—中ªﬁǄẞñ¿¡²½😀", "\u0301", "\u0327", "\u00a0", "\u200b", "\x01", "\x1c", "'s", "'re", "'ll", "'t"]
    special = ["<|startoftext|>", "<|endoftext|>", "<|ENDOFTEXT|>", "<|endoftext", "|>"]
    every = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 25))) for _ in range(20_000)] + [t or "" for t in ODD]
    every += ["".join(rng.choice(special if rng.random() < 0.3 else signs) for _ in range(rng.randint(0, 12))) for _ in range(4000)]
    every += ["hello <|endoftext|> world", "<|endoftext|>" * 5, "wo<|startoftext|>rd,<|endoftext|>.", "e<|endoftext|>\u0301", " <|startoftext|> "]
    encoder = packing.Encoder(path)
    for kept in (10**6, 100):
        packing.KEPT_WORDS, held = kept, packing.KEPT_WORDS
        for at in range(0, len(every), 5000):
            part = every[at : at + 5000]
            ids, bounds = encoder.encode(pa.array([t.encode() for t in part], pa.large_binary()))
            assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == [e.ids for e in tokenizer.encode_batch(part, add_special_tokens=False)]
        packing.KEPT_WORDS = held


def test_packing_on_odd_documents(documents, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    packed = packing.pack(clashing(documents), with_ids=True)
    rows = packed.collect()
    own = defaultdict(list)
    for r in rows:
        own[r.doc_id].append(r)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and len(r.ids) == r.length
    copies = Counter(d.doc_id for d in documents.collect())
    for d in documents.collect():
        ids = tokenizer.encode(d.text or "", add_special_tokens=False).ids + [0]
        expected = [ids[i : i + 2048] for i in range(0, len(ids), 2048)]
        assert sorted(r.ids for r in own[d.doc_id]) == sorted(expected * copies[d.doc_id])
    ends = defaultdict(int)
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends[r.sequence_id]
        ends[r.sequence_id] += r.length
    assert max(ends.values()) <= 2048 and len(ends) == plain_best_fit([r.length for r in rows], 2048)
    joined = {r.sequence_id: r.ids for r in packing.sequences(packed).collect()}
    assert {k: len(v) for k, v in joined.items()} == dict(ends)
    assert packing.pack(empty).count() == 0


def test_edit_distance_equals_brute_force():
    rng = random.Random(10)
    a, b = ([[rng.randint(0, 3) for _ in range(rng.choice([0, 1, 7, 63, 64]))] for _ in range(60)] for _ in range(2))

    def plain(x, y):
        row = list(range(len(y) + 1))
        for i, p in enumerate(x, 1):
            now = [i]
            for j, q in enumerate(y, 1):
                now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (p != q)))
            row = now
        return row[-1]

    def padded(rows):
        out = np.zeros((len(rows), 64), np.int16)
        for i, r in enumerate(rows):
            out[i, : len(r)] = r
        return out, np.array([len(r) for r in rows])

    assert ctph.edit_distance(*padded(a), *padded(b)).tolist() == [plain(x, y) for x, y in zip(a, b)]


def plain_fingerprint(text):
    data, m = text.encode(), 1 << 32
    hashes = []
    for i in range(len(data)):
        r = sum((data[i - j] + 1 if i >= j else 1) * pow(ctph.M1, j, m) for j in range(7)) % m
        r ^= r >> 15
        r = r * 0x2C1B3C6D % m
        hashes.append(r ^ r >> 13)
    for k in range(ctph.LEAST_K, 34):
        if sum(h & ((1 << k) - 1) == (1 << k) - 1 for h in hashes) < 64 or k == 33:
            break
    parts = []
    for bits in (k, k + 1):
        cuts = [0] + [i + 1 for i, h in enumerate(hashes) if bits < 33 and h & ((1 << bits) - 1) == (1 << bits) - 1]
        cuts += [len(data)] if cuts[-1] < len(data) else []
        parts.append("".join(ctph.SIGNS[zlib.crc32(data[a:b]) & 4095] for a, b in zip(cuts, cuts[1:])))
    return f"{1 << k}:{parts[0]}:{parts[1]}"


def test_piecewise_hashes_equal_brute_force():
    every = [t or "" for t in ODD] + texts(6, 11) + ["a" * 3000, "ab" * 2000]
    found = ctph.fingerprints([t.encode() for t in every])
    assert found.text() == [plain_fingerprint(t) for t in every]
    assert ctph.parse(found.text()).text() == found.text()
    assert ctph.likeness(found, found).tolist() == [1.0] * len(every)


def in_order(documents):
    """Rows by descending doc_id, those of one doc_id by a hash of their text."""
    hashed = documents.withColumn("h", F.xxhash64(F.coalesce("text", F.lit(""))))
    return sorted(hashed.collect(), key=lambda r: (r.doc_id is None, -(r.doc_id or 0), r.h))


def test_a_doc_id_of_very_many_rows_is_parted(spark):
    """Without a doc_id, or of one: rows are dealt to many ranges and still follow one another."""
    own = texts(60, 21, 80)
    rows = [(None, t) for t in own[:25]] + [(7, t) for t in own[25:50]] + [(i, t) for i, t in enumerate(own[50:])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    ids = docs.select(F.coalesce("doc_id", F.lit(ctph.NONE)).alias("key"))
    bucket_of = ctph._ranges(ids, 60, 20, 100)
    assert bucket_of.widths[np.searchsorted(bucket_of.splits, 7)] == 9
    ordered = in_order(docs)
    dealt = bucket_of(np.array([ctph.NONE if r.doc_id is None else r.doc_id for r in ordered]), np.array([r.h for r in ordered]))
    assert (np.diff(dealt) >= 0).all() and len(set(dealt.tolist())) > 20
    found = Counter((r.doc_id, r.edited_sha256) for r in ctph.neighbours(docs).collect())
    following = ordered[1:] + ordered[:1]
    assert found == Counter((a.doc_id, hashlib.sha256(ctph.edited(a.text, b.text).encode()).hexdigest()) for a, b in zip(ordered, following))


def test_neighbours_on_odd_documents(spark, documents, empty):
    rows = in_order(documents)
    found = ctph.neighbours(clashing(documents)).collect()
    expected = []
    for r, after in zip(rows, rows[1:] + rows[:1]):
        own, other = r.text or "", after.text or ""
        n = len(own) // 3
        changed = own[: len(own) - n] + other[:n]
        prints = ctph.fingerprints([own.encode(), changed.encode(), other.encode()])
        near = ctph.likeness(prints.take([0, 0]), prints.take([1, 2]))
        expected.append((r.doc_id, len(own), hashlib.sha256(changed.encode()).hexdigest(), *prints.text()[:2], *near.tolist()))
    key = lambda x: (x[0] is None, x[0] or 0, x[2])
    assert sorted(map(tuple, found), key=key) == sorted(expected, key=key)
    assert ctph.neighbours(empty).count() == 0
    (one,) = ctph.neighbours(documents.where("doc_id = 30")).collect()
    assert one.near_next == 1.0


def test_an_edit_keeps_most_chunks():
    own = texts(40, 12, 900)
    changed = [ctph.edited(a, b) for a, b in zip(own, own[1:])]
    prints, edited = ctph.fingerprints([t.encode() for t in own]), ctph.fingerprints([t.encode() for t in changed])
    near = ctph.likeness(prints.take(slice(0, -1)), edited)
    far = ctph.likeness(prints.take(slice(0, -1)), prints.take(slice(1, None)))
    assert np.median(near) > 0.5 and near.min() > far.max()
