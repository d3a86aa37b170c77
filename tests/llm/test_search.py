"""Ranked search, toxicity and hard negatives against brute force, with odd rows."""

import heapq
import math
import re
from collections import Counter

import numpy as np
import pytest

from spendframe.llm import hard_negatives, lexical, toxicity
from test_operators import LONG, TEXTS, prose, texts_of


@pytest.fixture(scope="module")
def docs(spark):
    """Extra columns have the names of columns that operators make."""
    rows = [(i, t, 1, 0.5, "x") for i, t in enumerate(TEXTS)] + [(100 + i, prose(7 * i, 20 + 9 * i), 1, 0.5, "x") for i in range(60)]
    rows += [rows[5], rows[40], (None, LONG, 1, 0.5, "x"), (None, None, 1, 0.5, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, rank int, score double, terms string")


def terms(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_ranking(texts, items, top):
    bags = [(doc, Counter(terms(text))) for doc, text in texts if terms(text)]
    n_docs, n_terms = len(bags), sum(bag.total() for _, bag in bags)
    df = Counter(term for _, bag in bags for term in bag)
    rows = []
    for item, text in items:
        scored = []
        for doc, bag in bags:
            m = 75 + 25 * bag.total() * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * bag[t] // (1000 * bag[t] + 12 * m))
                        for t in terms(text) if bag[t])
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        rows += [(item, rank, row[3], -row[0]) for rank, row in enumerate(heapq.nsmallest(top, scored), 1)]
    return rows


@pytest.mark.parametrize("rows_a_bucket", [5, 2048])
def test_ranking_matches_brute_force(spark, docs, monkeypatch, rows_a_bucket):
    monkeypatch.setattr(lexical, "BUCKET_ROWS", rows_a_bucket)
    items = [(1, prose(0, 15)), (2, prose(70, 30) + " " + prose(70, 9).upper()), (3, None), (4, "word nowhere"), (5, "--"),
             (6, "y z w é"), (2, prose(70, 30)), (None, "k license"), (7, prose(5, 3000))]
    queries = spark.createDataFrame(items, "item_id long, text string")
    for block in (4096, 2):
        found = [tuple(row) for row in lexical.ranked_search(docs, queries, top=7, block=block).collect()]
        assert Counter(found) == Counter(brute_ranking(texts_of(docs), items, 7))


def test_buckets_prune_without_loss():
    rng = np.random.default_rng(3)
    for _ in range(200):
        held = rng.integers(1, 6, 12)
        numbers = np.concatenate([np.sort(rng.choice(9, n, replace=False)) for n in held])
        impacts = rng.integers(1, 1000, len(numbers))
        norms = np.sqrt(np.add.reduceat(impacts.astype(float) ** 2, np.cumsum(held) - held)) * (1 + 1e-9)
        bucket = lexical.Bucket(np.arange(12), norms, held, numbers, impacts, 9)
        queries = lexical.Queries([rng.integers(0, 9, 4)], rng.integers(0, 50, 9))
        dense = np.zeros(9, np.int64)
        dense[queries.terms[0]] = queries.weights[0]
        scores = np.add.reduceat(dense[numbers] * impacts, np.cumsum(held) - held)
        least = int(rng.integers(1, 60_000))
        rows, found = bucket.search(queries.terms[0], queries.weights[0], queries.rest[0], least, np.zeros(9, np.int64))
        assert dict(zip(rows.tolist(), found.tolist(), strict=True)) == {i: s for i, s in enumerate(scores.tolist()) if s >= least}


def test_ngrams_match_python(monkeypatch):
    texts = [*TEXTS[:9], "aé\0b idiot!", "x" * 50, "İstanbul ÄÖ", *TEXTS[11:13]]

    def wanted(text):
        plain = "".join(" " if ord(c) < 128 and not c.isalnum() and c != "\0" else c for c in f" {text} ".lower()) if text else ""
        return {plain[i : i + n] for n in toxicity.SIZES for i in range(len(plain) - n + 1) if "\0" not in plain[i : i + n]}

    def found():
        sets = [set() for _ in texts]
        for rows, keys in toxicity.ngrams(texts):
            for row, key in zip(rows.tolist(), keys.tolist(), strict=True):
                sets[row].add(key)
        return sets

    whole = found()
    assert [len(one) for one in whole] == [len(wanted(text)) for text in texts]
    shared = [[len(a & b) for b in whole] for a in whole]
    assert shared == [[len(wanted(a) & wanted(b)) for b in texts] for a in texts]
    monkeypatch.setattr(toxicity, "_PIECE", 11)
    assert found() == whole


def test_logistic_is_at_its_minimum():
    rng = np.random.default_rng(1)
    features = rng.normal(size=(60, 5)) * (rng.random((60, 5)) < 0.6)
    goal, shares = np.where(features[:, 0] + rng.normal(size=60) > 0, 1.0, -1.0), rng.uniform(0.5, 2, 60)
    rows, columns = np.nonzero(features)
    weights, intercept = toxicity.logistic(rows, columns, features[rows, columns], goal, shares, 5, ridge=0.5, rounds=500)
    pull = -goal * shares / (1 + np.exp(goal * (features @ weights + intercept)))
    assert np.abs(features.T @ pull + 0.5 * weights).max() < 1e-2 and abs(pull.sum()) < 1e-2


def test_toxic_words_are_learned(spark, docs):
    bad = ["nasty", "vile", "horrid"]

    def text(i):
        words = prose(i, 30 + i % 50).split()
        return " ".join([*words[:9], *([bad[i % 3]] if i % 4 == 0 else []), *words[9:]])

    rows = [(1000 + i, text(i)) for i in range(600)] + [(9000, prose(1, 4000) + " vile " + prose(2, 4000)), (9001, prose(3, 8000))]
    many = spark.createDataFrame(rows, "doc_id long, text string").union(docs.select("doc_id", "text"))
    labels = spark.createDataFrame([(1000 + i, int(i % 4 == 0)) for i in range(600)] + [(3, None), (None, 1), (4, 7), (77777, 1)],
                                   "doc_id long, toxic int")
    found = {row["doc_id"]: row for row in toxicity.toxicity(many, labels).collect()}
    assert all(found[1000 + i]["predicted"] == int(i % 4 == 0) for i in range(600) if found[1000 + i]["held_out"])
    assert (found[9000]["predicted"], found[9001]["predicted"]) == (1, 0)
    assert found[1]["score"] == found[0]["score"] < 0.5 and toxicity.toxicity(many, labels).count() == many.count()
    for some, share in ((labels.filter("toxic = 1"), 1.0), (labels.filter("toxic = 0"), 0.0), (labels.limit(0), 0.0)):
        assert {row["score"] for row in toxicity.toxicity(docs, some).collect()} == {share}


def test_held_out_toxicity(spark):
    folder = "/root/testdata/sf0.1"
    documents, labels = (spark.read.parquet(f"{folder}/{name}.parquet") for name in ("documents", "labels"))
    found = toxicity.toxicity(documents, labels).join(labels.select("doc_id", "toxic"), "doc_id").filter("held_out")
    counts = {(row["toxic"], row["predicted"]): row["count"] for row in found.groupBy("toxic", "predicted").count().collect()}
    assert counts[1, 1] / (counts[1, 1] + counts[1, 0]) > 0.75
    assert counts.get((0, 1), 0) / (counts[0, 0] + counts.get((0, 1), 0)) < 0.01


def brute_negatives(rows, every):
    used = []
    for number, (vec_id, vector, label) in enumerate(rows):
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        if vec_id is not None and vec_id % 7 == 0:
            label = (label + 1) % 10
        used.append((number, vec_id, label, [math.floor(256 * x) for x in vector]))
    found = []
    for number, anchor, label, vector in used:
        if anchor is None or anchor % every:
            continue
        scored = sorted(((sum(x * y for x, y in zip(vector, other[3], strict=False)), other) for other in used if other[0] != number),
                        key=lambda one: (-one[0], one[1][1] is None, one[1][1] or 0))
        for score, positive in [one for one in scored if one[1][2] == label][:5]:
            fits = [one for one in scored if one[1][2] != label and 80 * score <= 100 * one[0] <= 100 * score]
            found += [(anchor, positive[1], rank, other[1], score, s) for rank, (s, other) in enumerate(fits[:5], 1)]
    return found


@pytest.mark.parametrize(("tile", "scale", "waves"), [(4096, 1.0, 8), (40, 1.0, 2), (40, 3e5, 3)])
def test_negatives_match_brute_force(spark, monkeypatch, tile, scale, waves):
    monkeypatch.setattr(hard_negatives, "TILE_ROWS", tile)
    monkeypatch.setattr(hard_negatives, "LEAF_ROWS", 8)
    monkeypatch.setattr(hard_negatives, "FIRST_WAVE", waves)
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) * scale for x in rng.normal(0.2, 0.3, 6)], int(rng.integers(0, 4))) for i in range(300)]
    rows += [(300 + i, rows[5][1], i % 2) for i in range(60)]  # equal vectors
    rows += [rows[0], rows[20], (None, rows[7][1], 1), (401, None, 1), (402, rows[3][1], None), (403, [1.0, None], 2),
             (404, [float("nan")], 2), (405, [float("inf"), 1.0], 3), (406, [], 3), (407, rows[9][1][:3], 2), (408, [0.0] * 6, 9)]
    given = spark.createDataFrame([(*row, "x", 1) for row in rows],
                                  "vec_id long, embedding array<double>, label int, `row` string, score int")
    found = Counter(map(tuple, hard_negatives.hard_negatives(given, every=20).collect()))
    assert found == Counter(brute_negatives(rows, 20))


def test_boxes_bound_all_scores():
    rng = np.random.default_rng(8)
    vectors = rng.integers(-50, 50, (200, 5))
    labels = rng.integers(0, 3, 200)
    leaves = hard_negatives.packed_order(vectors, labels, 8)
    order = np.concatenate(leaves)
    assert sorted(order.tolist()) == list(range(200)) and max(map(len, leaves)) <= 8
    assert all(len(set(labels[leaf].tolist())) == 1 for leaf in leaves)
    tree = hard_negatives.Tree(order, order, labels[order], vectors[order], np.cumsum([len(leaf) for leaf in leaves]), True)
    anchors = rng.integers(-50, 50, (4, 5)).astype(float)
    least, most = tree.bounds(anchors)
    for i, anchor in enumerate(anchors):
        scores = vectors @ anchor
        for node, leaf in enumerate(leaves):
            assert least[0][i, node] <= scores[leaf].min() and scores[leaf].max() <= most[0][i, node]
        assert least[-1][i, 0] <= scores.min() and scores.max() <= most[-1][i, 0]


def test_scores_beyond_64_bits_are_an_error(spark):
    given = spark.createDataFrame([(0, [1e30], 1), (1, [1.0], 1)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(Exception, match="64 bits|OVERFLOW|overflow"):
        hard_negatives.hard_negatives(given).collect()


def test_known_terms_survive_the_field():
    hashes = np.random.default_rng(2).integers(0, 1 << 63, 500, dtype=np.uint64)
    places, numbers = lexical.Vocabulary(hashes[::2]).find(hashes)
    assert places.tolist() == list(range(0, 500, 2)) and (np.sort(hashes[::2])[numbers] == hashes[places]).all()
