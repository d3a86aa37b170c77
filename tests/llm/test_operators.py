"""Operators against brute force, with nulls, empty and long texts, ties and repeated rows."""

import base64
import gzip
import hashlib
import json
import re
from collections import Counter, defaultdict
from html.parser import HTMLParser
from math import sqrt

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from compare import difference
from spendframe.llm import (
    arrays, decontamination, frames, language, licenses, mixing, ngram_join, oracles, packing, private, quality, rules, sharding, warc,
)

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, words: int) -> str:
    """Clean text: letters only, so that it is within every rule's limit."""
    rng = np.random.default_rng(seed)
    return " ".join(f"{WORDS[i]}{'aeioulnrst'[j // 10]}{'aeioulnrst'[j % 10]}"
                    for i, j in zip(rng.integers(0, 20, words), rng.integers(0, 90, words), strict=True))


LONG = prose(1, 300)
EDITED = LONG.replace(LONG.split()[150], "changed", 1)
TEXTS = [
    None, "", "   \n\t ", "one", "One  two", LONG, LONG, LONG.upper(), EDITED, prose(2, 300), prose(3, 40),
    "same line\nsame line\n same line\nother", "word " * 200, prose(4, 30_000), "é\x0bü\x00x y z w",
    "Released under the MIT License.\nmit  LICENSE", "K license K", "a@b.co 1.2.3.4 +1 (386) 555-3733 x",
]


@pytest.fixture(scope="module")
def docs(spark):
    """Extra columns have the names of columns that operators make."""
    rows = [(i, t, ["en", None, "de"][i % 3], [None, "s1", "s2", "s1"][i % 4], 1.0, "k") for i, t in enumerate(TEXTS)]
    rows += [rows[5], (None, LONG, "en", "s1", 0.0, "k"), (None, None, None, None, 0.0, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double, copies string")


def texts_of(docs):
    return [(row["doc_id"], row["text"] or "") for row in docs.collect()]


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text))
    if not words:
        return set()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80)])
def test_components_match_all_pairs(spark, docs, width, percent):
    base = prose(9, 150).split()
    near = [(100 + i, " ".join(w if j % (40 + 3 * i) else f"w{i}{j}" for j, w in enumerate(base, 1))) for i in range(40)]
    # Two clusters of copies that nearly touch, with a few texts between them, and copies that just miss each other.
    rng = np.random.default_rng(6)
    far = " ".join(w if j % 7 else f"far{j}" for j, w in enumerate(base)).split()
    for i in range(60):
        half = base if i % 2 else far
        cut = rng.choice(150, int(rng.integers(0, 5 if i < 50 else 25)), replace=False)
        near.append((300 + i, " ".join(f"z{i}" if j in cut else (far[j] if i % 9 == 0 and j % 14 == 0 else w) for j, w in enumerate(half))))
    rows = docs.select("doc_id", "text").union(spark.createDataFrame(near, "doc_id long, text string"))
    texts = texts_of(rows)
    sets = [shingles(text, width) for _, text in texts]
    root = {i: i for i, _ in texts if i is not None}
    changed = True
    while changed:
        changed = False
        for (a, _), x in zip(texts, sets, strict=True):
            for (b, _), y in zip(texts, sets, strict=True):
                if a is not None and b is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                    low = min(root[a], root[b])
                    changed |= root[a] != low or root[b] != low
                    root[a] = root[b] = low
    found = ngram_join.similarity_components(rows, width, percent).collect()
    wanted = Counter((i, len(s), root.get(i)) for (i, _), s in zip(texts, sets, strict=True))
    assert Counter(map(tuple, found)) == wanted


def test_linked_families_are_not_compared_pair_by_pair(spark, monkeypatch):
    """Copies with some of 16 edits: about half of their pairs link, and few hubs link with all."""
    rng = np.random.default_rng(8)
    base = prose(40, 400).split()
    places = rng.choice(400, 16, replace=False)
    texts = []
    for _ in range(240):
        edited = set(places[rng.random(16) < 0.5].tolist())
        texts.append(" ".join(f"edit{j}" if j in edited else word for j, word in enumerate(base)))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    compared, between = [], ngram_join._between_components

    def counted(labelled, percent):
        pairs = between(labelled, percent)
        compared.append(pairs.select(*ngram_join._ordered("x", "y")).distinct().count())
        return pairs

    monkeypatch.setattr(ngram_join, "_between_components", counted)
    found = dict((row["doc_id"], row["component_id"]) for row in ngram_join.similarity_components(rows, 5, 80).collect())
    sets, links = [shingles(text, 5) for text in texts], 0
    root = list(range(len(texts)))
    for i, one in enumerate(sets):
        for j in range(i):
            if 100 * len(one & sets[j]) >= 80 * len(one | sets[j]):
                links += 1
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    assert found == dict(enumerate(root))
    assert links > 5000 and max(compared) < len(texts)


def test_one_row_of_each_component_stays(spark):
    near = prose(30, 300)
    nearly = near.replace(near.split()[150], "changed", 1)
    rows = [(1, LONG, "b"), (1, LONG, "a"), (2, EDITED, "x"), (None, LONG, "x"),  # copies of 1
            (3, prose(31, 200), "x"), (3, LONG, "x"),  # one id, two texts, one of them a copy
            (None, near, "x"), (None, nearly, "x"), (None, nearly, "x"),  # copies without an id
            (None, prose(32, 200), "y"), (None, prose(32, 200), "x"),  # equal rows without an id
            (None, prose(33, 200), "x"), (4, prose(33, 200), "x"), (5, prose(34, 200), "x"), (9, "", "x"), (10, None, "x")]
    docs = spark.createDataFrame([(*row, 1, "k", 0) for row in rows],
                                 "doc_id long, text string, `a.b` string, again_id long, AGAIN_KEY string, row int")
    kept = ngram_join.keep_first(docs)
    assert kept.columns == docs.columns
    found = Counter(tuple(row)[:3] for row in kept.collect())
    assert found[None, near, "x"] + found[None, nearly, "x"] == 1
    assert Counter({row: n for row, n in found.items() if row[1] not in (near, nearly)}) == Counter(
        [(1, LONG, "a"), (3, prose(31, 200), "x"), (None, prose(32, 200), "x"), (4, prose(33, 200), "x"),
         (5, prose(34, 200), "x"), (9, "", "x"), (10, None, "x")])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab \n\x0bé!A|", max_size=40), min_size=1, max_size=8))
def test_rule_counts(texts):
    counts = rules.rule_counts(pa.array(texts, pa.string()))
    for i, text in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        times = Counter(tuple(words[j : j + 3]) for j in range(len(words) - 2))
        covered = {j + k for j in range(len(words) - 2) if times[tuple(words[j : j + 3])] > 1 for k in range(3)}
        lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
        assert [counts[name][i] for name in rules.COUNTS[:5]] == [
            len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)]


def test_hashes_do_not_depend_on_chunks(monkeypatch):
    data, bounds = arrays.utf8(pa.array([t for t in TEXTS], pa.string()))
    whole = arrays.words(data, bounds, arrays.WHITE)
    monkeypatch.setattr(arrays, "CHUNK", 7)
    for one, two in zip(whole, arrays.words(data, bounds, arrays.WHITE), strict=True):
        assert (one == two).all()


def test_quality_verdicts(spark, docs):
    rows = [(i, prose(i, 120)) for i in range(60)] + [(i, re.sub(" ", "### ", prose(i, 120))) for i in range(60, 80)]
    many = spark.createDataFrame(rows, "doc_id long, text string").union(docs.select("doc_id", "text"))
    labels = spark.createDataFrame(
        [(i, int(i < 60)) for i in range(0, 80, 2)] + [(None, 0), (1, None), (9999, 1)], "doc_id long, quality int")
    found = quality.judge(many, labels).collect()
    assert len(found) == many.count()
    kept = defaultdict(set)
    for row in found:
        kept[row["doc_id"]].add(row["kept"])
        assert 0 <= row["score"] <= 1 and not (row["base_failed"] and row["kept"])
    assert all(kept[i] == {False} for i in range(60, 80)) and all(kept[i] == {True} for i in range(18, 60))
    assert quality.keep_clean(docs, labels).columns == docs.columns


def test_quality_rejects_junk_of_no_labelled_kind(spark):
    """Labels know symbols only; capitals and numbers go all the same, and without any label too."""
    rows = [(i, prose(i, 120)) for i in range(200)] + [(i, re.sub(" ", "### ", prose(i, 120))) for i in range(200, 210)]
    rows += [(300 + i, prose(i, 120).upper()) for i in range(3)]
    rows += [(310 + i, " ".join(str(1000 * i + 7 * j) for j in range(120))) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 200)) for i in range(0, 210, 2)], "doc_id long, quality int")
    for given in (labels, labels.limit(0)):
        kept = {row["doc_id"] for row in quality.judge(docs, given).filter("kept").collect()}
        assert set(range(200)) <= kept and not kept & {300, 301, 302, 310, 311, 312}


def test_forest_scores_by_walking():
    rng = np.random.default_rng(0)
    points = rng.normal(size=(300, 3))
    forest = quality.Forest.fit(points, trees=7, subsample=64)
    for point, score in zip(points[:20], forest.score(points[:20]), strict=True):
        total = 0.0
        for node in forest.roots:
            while forest.axis[node] >= 0:
                node = forest.left[node] if point[forest.axis[node]] < forest.value[node] else forest.right[node]
            total += forest.length[node]
        assert score == pytest.approx(2 ** (-total / 7 / forest.scale))


def plain_statistics(text):
    """The rule statistics beyond their limits, counted in plain Python, and whether a base rule fails."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    times = Counter(zip(words, words[1:], words[2:], strict=False))
    again = sum(any(times[tuple(words[j : j + 3])] > 1 for j in range(max(0, i - 2), min(i + 1, len(words) - 2))) for i in range(len(words)))
    n, chars = max(1, len(words)), max(1, sum(map(len, words)))
    length = sum(map(len, words)) / n

    def over(value, limit):
        return max(0, value - limit)

    def of(pattern):
        return len(re.findall(pattern, text))

    point = [over(of(r"[#*$%&|<>]") / n, 0.1), over(length, 10) + over(3, length),
             over((len(lines) - len(set(lines))) / max(1, len(lines)), 0.3), over(again / n, 0.3),
             over(of("[A-Z]") / chars, 0.2), over(of("[!?.,;:]") / n, 0.5), over(of("[0-9]") / chars, 0.2)]
    return point, len(words) < 50 or 100 * again > 50 * len(words)


def test_quality_verdicts_from_plain_counts(spark, data):
    """Every row's score by walking the trees, the threshold by trying all, the verdict from both."""
    docs, labels = (spark.read.parquet(f"{data}/{name}.parquet") for name in ("documents", "labels"))
    counts = quality.rule_table(docs)
    forest = quality.fit_forest(counts, counts.join(labels.select("doc_id", "quality"), "doc_id"))
    truth = {row["doc_id"]: row["quality"] for row in labels.collect()}
    plain = {}
    for row in docs.collect():
        point, failed = plain_statistics(row["text"] or "")
        total = 0.0
        for node in forest.roots:
            while forest.axis[node] >= 0:
                node = forest.left[node] if point[forest.axis[node]] < forest.value[node] else forest.right[node]
            total += forest.length[node]
        plain[row["doc_id"]] = (failed, 2 ** (-total / len(forest.roots) / forest.scale))
    rated = [(int(score * quality.BINS), truth[i]) for i, (failed, score) in plain.items() if not failed and truth.get(i) in (0, 1)]
    bad, clean = [b for b, label in rated if label == 0], [b for b, label in rated if label == 1]
    assert bad and clean
    gains = [sum(b >= low for b in bad) / len(bad) - quality.CLEAN_WEIGHT * sum(b >= low for b in clean) / len(clean)
             for low in range(quality.BINS + 1)]
    runs, best = [], max(gains) - 1e-12
    for low, gain in enumerate(gains):
        if gain >= best:
            runs = [*runs[:-1], [*runs[-1], low]] if runs and runs[-1][-1] == low - 1 else [*runs, [low]]
    widest = max(runs, key=len)
    threshold = (widest[0] + widest[-1]) / 2 / quality.BINS
    found = quality.judge(docs, labels).collect()
    assert len(found) == len(plain)
    for row in found:
        failed, score = plain[row["doc_id"]]
        assert row["base_failed"] == failed and row["score"] == pytest.approx(score, abs=1e-9)
        assert row["kept"] == (not failed and score < threshold)


def kernel(one, two):
    return len(one & two) / sqrt(len(one) * len(two))


def test_language_scores_match_kernels(spark, data):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language.identify(documents).join(documents.select("doc_id", F.col("lang").alias("truth")), "doc_id").filter("held_out").collect()
    assert sum(row["lang_pred"] == row["truth"] for row in found) / len(found) > 0.97
    texts = ["the cat sat", "a dog ran off", "der hund lief", "die katze sass", "hund und katze"]
    grams = [np.unique(np.concatenate(list(language.ngrams(t)))) for t in texts]
    model = language.train(list(zip(["en", "en", "de", "de", "de"], grams, strict=True)), landmarks=4)
    landmarks = [set(grams[i].tolist()) for i in (2, 3, 0, 1)]
    asked = set(np.unique(np.concatenate(list(language.ngrams("the hund sat")))).tolist())
    values = np.array([kernel(asked, mark) for mark in landmarks]) @ model.weights
    names, scores = model.score(["the hund sat", "12 !", None])
    assert scores[0] == pytest.approx(np.clip((values.max() + 1) / 2, 0, 1), abs=1e-5)
    assert names[0] == ["de", "en"][values.argmax()] and names[1:] == ["und", "und"] and list(scores[1:]) == [0, 0]


def test_languages_of_several_scripts(spark):
    """Scripts of thousands of letters beside Latin ones, of which two share many letters."""
    rng = np.random.default_rng(3)
    letters = {"zh": list(range(0x4E00, 0x4E00 + 1500)),
               "ja": [*range(0x3041, 0x3097), *range(0x30A1, 0x30FB), *range(0x4E00, 0x4E00 + 700)],
               "ko": list(range(0xAC00, 0xAC00 + 1500)), "el": list(range(0x3B1, 0x3CA)), "ru": list(range(0x430, 0x450))}
    rows = []
    for name, own in letters.items():
        share = np.array([5.0 if 0x3041 <= point < 0x30FB else 1.0 for point in own])
        for _ in range(150):
            text = "".join(map(chr, rng.choice(own, int(rng.integers(20, 80)), p=share / share.sum())))
            rows.append((len(rows), " ".join(text[i : i + 9] for i in range(0, len(text), 9)), name))
    rows += [(len(rows) + i, prose(i, 30), "la") for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    truth = {row[0]: row[2] for row in rows}
    found = [row for row in language.identify(docs).collect() if row["held_out"]]
    for name in [*letters, "la"]:
        mine = [row["lang_pred"] == name for row in found if truth[row["doc_id"]] == name]
        assert sum(mine) >= 0.97 * len(mine) > 20


def test_language_of_odd_rows(spark, docs):
    found = language.identify(docs).collect()
    assert len(found) == docs.count()
    assert all(row["lang_pred"] == "und" and row["score"] == 0 for row in found if row["doc_id"] in (0, 1, 2))


EXPRESSIONS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
)


def valid(kind, text):
    digits = re.sub("[^0-9]", "", text)
    if kind == 1:
        return all(int(part) <= 255 for part in text.split("."))
    if kind == 2:
        doubled = [int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))]
        return 14 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind == 0 or 10 <= len(digits) <= 15


@settings(max_examples=400, deadline=None)
@given(st.text("a1.@-+ (02%é", max_size=60))
def test_base_finds_match_expressions(text):
    wanted = sorted((m.start(), kind, m.end()) for kind, expression in enumerate(EXPRESSIONS)
                    for m in re.finditer(expression, text) if valid(kind, m.group()))
    assert private.base_spans(text) == wanted


def test_base_finds_are_linear():
    assert private.base_spans("9" * 200_000) == [] and private.base_spans("a" * 200_000 + "@") == []
    assert private.base_spans("4111 1111 1111 1111") == [(0, 2, 19)]


def test_patterns_find_unseen_identifiers(spark):
    rows = [(i, f"{prose(i, 5)} reach desk at +1 (386) 555-{1000 + i} soon") for i in range(8)]
    rows += [(20, "please reach desk at ext-55512 soon"), (21, "version 2.0. the 77812345 thing"), (22, None), (23, "")]
    rows += rows[-4:-3]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {row["doc_id"]: row for row in private.personal_data(docs).collect()}
    assert found[20]["spans"] == "phone:21:30" and found[20]["n_phone"] == 0 and found[20]["n_added"] == 1
    assert found[21]["spans"] == "" and found[22]["spans"] == "" and found[0]["n_phone"] == 1
    assert private.personal_data(docs).count() == len(rows)


@pytest.mark.parametrize(("text", "wanted"), [
    ("reach desk at (386) 555-3733 soon", [("(386) 555-3733", "desk at _", "at _ soon")]),
    ('{"reach desk at":"ext-55512"}', [("ext-55512", "desk at _", "at _ ")]),
    ("电话号码13812345678请", [("13812345678", "号 码 _", "码 _ 请")]),
    ("x?id=99887766&u=a_b@c", [("99887766", "x id _", "id _ u"), ("a_b@c", "00000000 u _", "u _ ")]),
    ("mac 00:1A:2B:3C:4D:5E, 555 12-34.", [("00:1A:2B:3C:4D:5E", "mac _", "mac _ 000 00-00"),
                                           ("555 12-34", "mac 00:0a:0b:0c:0d:0e _", "00:0a:0b:0c:0d:0e _ ")]),
    ("tel:+1-555-123x 12-3456-AB7", [("+1-555-123x", "tel _", "tel _ 00-0000-ab0"), ("12-3456-AB7", "tel +0-000-000x _", "+0-000-000x _ ")]),
    ("ip 1.2.3.4 5551234 no", [("1.2.3.4", "ip _", "ip _ 0000000"), ("5551234", "ip 0.0.0.0 _", "0.0.0.0 _ no")]),
    ("no hint here", []), ("", []),
])
def test_tokens_and_their_patterns(text, wanted):
    found = private.tokens(text, private.base_spans(text))
    assert [(text[start:end], *patterns) for start, end, _, _, _, patterns in found] == wanted


def test_tokens_are_whole_and_linear():
    long = "k" * 5000 + "1234"
    (start, end, token, _, looks, patterns), = private.tokens(f"{'w' * 900} {long} y", [])
    assert (start, end, looks) == (901, 901 + len(long), True) and len(token) < 64 and len(patterns[0]) < 64
    for piece in ("1 ", "1-", "1 1-", "a/1/", "a:", "+", "(", "a1", "1 --"):
        text = piece * (100_000 // len(piece)) + "1x"
        assert sum(1 for _ in private.tokens(text, private.base_spans(text))) <= 100_000


def graph_in_plain_python(texts):
    """Added spans of each text, from dictionaries of patterns and tokens."""
    seen = {text: list(private.tokens(text, private.base_spans(text))) for text in texts}
    kinds, looks, members = defaultdict(set), defaultdict(bool), defaultdict(set)
    for finds in seen.values():
        for _, _, token, kind, alike, patterns in finds:
            for pattern in patterns:
                kinds[pattern, token].add(kind)
                looks[pattern, token] |= alike
                members[pattern].add(token)
    base = {(token, max(found)): 1.0 for (_, token), found in kinds.items() if max(found) >= 0}
    believed, confident = dict(base), {}
    for turn in range(private.ROUNDS):
        confident = {}
        for pattern, tokens in members.items():
            for kind in range(len(private.KINDS)):
                held = [believed[token, kind] for token in tokens if (token, kind) in believed]
                score = sum(held) / (len(tokens) + private.PRIOR)
                if len(tokens) >= private.MIN_SUPPORT and len(held) >= private.MIN_SUPPORT and score >= private.MIN_CONFIDENCE:
                    confident[pattern, kind] = score
        doubt = defaultdict(lambda: 1.0)
        for (pattern, kind), score in confident.items():
            for token in members[pattern]:
                if max(kinds[pattern, token]) < 0 and looks[pattern, token]:
                    doubt[token, kind] *= max(1 - score, 1e-9)
        believed = {key: 1 - value for key, value in doubt.items()} | base
    added = {}
    for text, finds in seen.items():
        spans = set()
        for start, end, _, kind, alike, patterns in finds:
            scores = [(score, -k) for (pattern, k), score in confident.items() if pattern in patterns]
            if kind < 0 and alike and scores:
                spans.add((start, -max(scores)[1], end))
        added[text] = sorted(spans)
    return added


@pytest.mark.parametrize("broadcast_rows", [1_000_000, 0])
def test_bootstrapped_spans_match_plain_graph(spark, monkeypatch, broadcast_rows):
    """Also where no side is broadcast and keys count as hot, with a third of all rows alike."""
    monkeypatch.setattr(frames, "BROADCAST_ROWS", broadcast_rows)
    monkeypatch.setattr(frames, "HOT_PART", 10)
    texts = [f"{prose(i, 4)} reach desk at +1 (386) 555-{1000 + i} soon" for i in range(8)]
    texts += [f"mail {w} at {w}{i}@example.org today" for i, w in enumerate(WORDS)]
    texts += [f"card no {n} valid" for n in ("4111 1111 1111 1111", "5500 0000 0000 0004", "3400-0000-0000-009", "4012888888881881")]
    texts += ["reach desk at (386) 555-3733 soon", '{"reach desk at":"ext-55512"}', "card no 9999-1111-2222 valid",
              "your card no 9999-1111-2222 is late", "reach desk at 12 soon", "mail nu at nu@local today", "é card no 77-12345é valid", ""]
    rows = [(i, text) for i, text in enumerate(texts)] + [(None, None), (None, texts[0])] + [(5, texts[30])] * 30
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("token", F.lit("x")).withColumn("added", F.lit("x"))
    wanted = graph_in_plain_python({text or "" for _, text in rows})
    expected = Counter(
        (i, ",".join(f"{private.KINDS[k]}:{start}:{end}" for start, k, end in sorted(private.base_spans(text or "") + wanted[text or ""])))
        for i, text in rows)
    found = private.personal_data(docs).collect()
    assert Counter((row["doc_id"], row["spans"]) for row in found) == expected
    spans = {row["doc_id"]: row["spans"] for row in found}
    first = texts.index("reach desk at (386) 555-3733 soon")
    assert spans[first] == "phone:14:28" and spans[first + 1] == "phone:18:27" and spans[first + 2] == "card:8:22"
    assert private.personal_data(docs.limit(0)).count() == 0


def test_mixing_repeats_documents(spark, docs):
    rows = docs.drop("copies").withColumn("row", F.lit("x"))
    wanted = defaultdict(int)
    for row in mixing.mixture(rows).collect():
        wanted[row["doc_id"], row["source"]] += row["copies"]
    mixed = mixing.mix_documents(rows)
    assert mixed.columns == rows.columns
    found = Counter((row["doc_id"], row["source"]) for row in mixed.collect())
    assert found == Counter({key: copies for key, copies in wanted.items() if copies})
    many = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 4).alias("source"),
                                      F.lit("a b c").alias("text"))
    # A source whose rows have no id, and one whose rows all have the same.
    unnamed = many.select(F.when(F.col("source") == "s1", None).when(F.col("source") == "s2", 7).otherwise(F.col("doc_id")).alias("doc_id"),
                          "source", F.concat(F.lit("a b "), F.col("doc_id")).alias("text"))
    for given in (many, unnamed):
        near = mixing.mixture(given).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
        assert len(near) == 4 and all(abs(row["taken"] / row["target"] - 1) < 0.05 for row in near)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 16), max_size=60))
def test_best_fit_decreasing(sizes):
    rows = packing.best_fit_decreasing(sizes, 16)
    assert sorted(i for row in rows for i in row) == list(range(len(sizes)))
    free: list[int] = []
    for size in sorted(sizes, reverse=True):
        fits = [space for space in free if space >= size]
        if fits:
            free.remove(min(fits))
        free.append((min(fits) if fits else 16) - size)
    assert sorted(16 - sum(sizes[i] for i in row) for row in rows) == sorted(free)


def test_packing_loses_nothing(docs, tmp_path):
    packed = packing.pack(docs, length=64).cache()
    for row in packed.collect():
        bounds = row["cu_seqlens"]
        ids = packing.matrix([bytes(row["ids"])], 64)[0]
        assert bounds[-1] == row["n_tokens"] <= 64 and row["resets"] == bounds[:-1] and (ids[bounds[-1] :] == packing.END_ID).all()
        assert all((packing.position_ids(bounds, 64)[a:b] == np.arange(b - a)).all() for a, b in zip(bounds, bounds[1:], strict=False))
    found = Counter((row["doc_id"], bytes(row["ids"])) for row in packing.unpack(packed).collect())
    assert found == Counter((i, packing.encode(text)) for i, text in texts_of(docs))
    packing.write_packed(packed, str(tmp_path / "packed"), 64)
    assert docs.sparkSession.read.parquet(str(tmp_path / "packed/rows")).count() == packed.count()


def test_license_edges(docs):
    found = {row["doc_id"]: row for row in licenses.scan(docs).collect()}
    assert found[15].asDict() == {"doc_id": 15, "n_words": 7, "n_base": 2, "first_word": 3, "last_word": 5,
                                  "base_labels": "mit", "labels": "mit", "score": 1.0}
    assert (found[0]["n_words"], found[0]["score"], found[0]["first_word"]) == (0, 0.0, None)
    assert licenses.scan(docs).count() == docs.count()


@pytest.mark.parametrize("width", [1, 4, 9])
def test_wrapped_license_notices(spark, width):
    def wrapped(text):
        words = text.split()
        return "\n".join(" * " + " ".join(words[i : i + width]) for i in range(0, len(words), width))

    scattered = licenses.TEMPLATES[7][1].split()
    rows = [(i, prose(i, 30) + "\n" + wrapped(text) + "\n" + prose(50 + i, 30)) for i, (_, text) in enumerate(licenses.TEMPLATES)]
    rows += [(50, "licensed under the terms of the\nGNU Lesser General\nPublic License"),
             (51, "\n".join(f"{prose(i, 8)} {word}" for i, word in enumerate(scattered)))]
    found = {row["doc_id"]: row for row in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (label, _) in enumerate(licenses.TEMPLATES):
        assert label in found[i]["labels"].split(",") and found[i]["score"] == 1.0
    assert "lgpl" in found[50]["labels"].split(",") and (found[51]["labels"], found[51]["score"]) == ("", 0.0)


def test_license_sql_on_wrapped_and_scattered_notices(spark, tmp_path):
    """The query and its SQL on notices that are wrapped, spread out, cut short and scattered over one line."""
    rows = []
    for number, (_, text) in enumerate(licenses.TEMPLATES):
        words = text.split()
        half = len(words) // 2
        rows += [prose(number, 20) + " " + text, "\n".join(words), " zz ".join(words), " zz yy xx ".join(words),
                 " ".join(words[: len(words) - 2]), " ".join([*words[:half], prose(90, 500), *words[half:]]),
                 " ".join(reversed(words)) + " " + text.upper(), text + "\n" + text]
    rows += [None, "", "MIT License mit-license", "general public\nlicense the general of public license", *TEXTS]
    folder = str(tmp_path)
    docs = spark.createDataFrame([(i % 50, text, "x") for i, text in enumerate(rows)], "doc_id long, text string, met string")
    docs.coalesce(1).write.parquet(f"{folder}/documents.parquet")
    tables = duckdb.connect()
    tables.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    found = licenses.scan(spark.read.parquet(f"{folder}/documents.parquet"))
    assert difference(found, tables, oracles.ORACLES["op6_license_scan"]) is None
    scattered = [row for row in found.collect() if row["n_words"] > 500]
    assert scattered and all(row["labels"] == "" for row in scattered if row["n_base"] == 0 and row["n_words"] < 540)
    assert licenses.scan(docs, templates=()).filter("score not in (0, 1)").count() == 0


def test_ring_bounds_and_slots(spark, docs):
    many = spark.range(3001).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    rows = sharding.assign(many.union(docs.select("doc_id", "text"))).collect()
    by_shard = defaultdict(list)
    for row in rows:
        by_shard[row["shard"]].append(row["slot"])
    sizes = [len(slots) for slots in by_shard.values()]
    assert len(rows) == 3001 + docs.count() and len(sizes) == 8 and max(sizes) - min(sizes) <= 1
    assert all(sorted(slots) == list(range(len(slots))) for slots in by_shard.values())


def test_walk_goes_to_the_next_place_with_room():
    taken = sharding.walk({0: 5, 1: 1, 2: 0}, [0, 1, 0], 2)
    assert sorted(taken) == [(0, 0, 3, 0), (0, 3, 5, 1), (1, 0, 1, 1)]


def test_decontamination_matches_all_windows(spark, docs):
    items = [(1, prose(50, 40)), (2, prose(51, 12)), (3, None), (4, "tiny item"), (5, prose(50, 40)), (6, "...")]
    one = items[0][1].split()
    near = " ".join([*one[:39], "other"])
    far = " ".join("x" if i % 5 == 0 else w for i, w in enumerate(one))
    extra = [(201, prose(60, 80) + " " + items[0][1].upper() + ". " + prose(61, 50)), (202, prose(62, 9) + " " + near),
             (203, far), (204, "Tiny, item!"), (205, items[1][1] + " tiny item"), (206, " ".join(one[:38])),
             (207, "a tiny item, and a tiny ITEM again"), (208, "tiny"), (209, "item tiny items")]
    items += [(7, "an item of four"), (8, "Solo"), (9, "tiny item")]
    extra += [(210, "here an item of four stands solo"), (211, "an item of")]
    rows = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    wanted = {}
    for doc, text in texts_of(rows):
        words = re.findall(r"[0-9a-z\x80-\U0010ffff]+", text.lower())
        for item, other in items:
            asked = re.findall(r"[0-9a-z]+", (other or "").lower())
            if not asked or len(words) > 5000:
                continue
            def bag(w):
                return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))
            starts = range(max(1, len(words) - len(asked) + 1))
            # A text shorter than a shingle is a single one; so is an item.
            cuts = [words[s : s + len(asked)] for s in starts]
            best = max((bag(c) & bag(asked)).total() / (bag(c) | bag(asked)).total() for c in cuts) if words else 0
            if best >= 0.8:
                wanted[doc, item] = round(best, 9)
    found = decontamination.contaminated(rows, spark.createDataFrame(items, "item_id long, text string"))
    assert {(row["doc_id"], row["item_id"]): round(row["similarity"], 9) for row in found.collect()} == wanted
    split = decontamination.contaminated(rows, spark.createDataFrame(items, "item_id long, text string"), block=2)
    assert split.distinct().count() == len(wanted)


def test_recall_of_edited_items(spark):
    """Of windows with edits anywhere, similar enough by an exact count, none is lost here."""
    rng = np.random.default_rng(8)
    items = {i: prose(400 + i, 15 + i % 45) for i in range(150)}
    texts = {}
    for i, text in items.items():
        words = text.split()
        for turn in range(8):
            edited = words[:]
            for place in rng.choice(len(words), int(rng.integers(1, 3)), replace=False):
                edited[place if turn % 2 else (0 if place % 2 else len(words) - 1)] = f"edit{turn}"
            texts[i * 8 + turn] = (i, edited)

    def bag(words):
        return Counter(tuple(words[j : j + 5]) for j in range(len(words) - 4))

    wanted = {(doc, i) for doc, (i, words) in texts.items()
              if 10 * (bag(words) & bag(items[i].split())).total() >= 8 * (bag(words) | bag(items[i].split())).total()}
    docs = spark.createDataFrame([(doc, prose(doc, 30) + " " + " ".join(words) + " " + prose(doc + 1, 20))
                                  for doc, (_, words) in texts.items()], "doc_id long, text string")
    found = decontamination.contaminated(docs, spark.createDataFrame(list(items.items()), "item_id long, text string"))
    held = {(row["doc_id"], row["item_id"]) for row in found.collect()}
    assert len(wanted) > 500 and len(wanted & held) >= 0.995 * len(wanted)


def test_hamming_blocks_find_all_within_radius():
    rng = np.random.default_rng(5)
    items = decontamination.Items(list(range(50)), [prose(i, 30) for i in range(50)])
    for place in range(50):
        for flips in (0, 5, 12, 19):
            bits = rng.choice(64, flips, replace=False)
            code = items.prints[place]
            for bit in bits:
                code ^= np.uint64(1) << np.uint64(bit)
            near = [i for i in range(50) if int(np.bitwise_count(items.prints[i] ^ code)) <= decontamination.RADIUS]
            assert items.within(30, code) == near


PAGE = ('<!DOCTYPE html><title>A &amp; B</title><style>p{}</style><!-- <p>no</p> --><body><p>One<br>two &lt;3</p>'
        '<script>var t="</p>";</script><a href="/x?a=1&amp;b=2">link</a> <A HREF=y>z</A><script>end')


def test_derived_records(spark):
    pages = spark.createDataFrame([(1, "http://a/", PAGE), (2, None, None), (1, "http://a/", PAGE)], "page_id long, url string, html string")
    records = warc.derive(warc.responses_of_pages(pages), keep=["page_id"]).cache()
    rows = [row for row in records.collect() if row["page_id"] == 1 and row["warc_type"] == "conversion"]
    assert len(rows) == 2 and rows[0] == rows[1] and records.count() == 6
    assert bytes(rows[0]["block"]).decode() == "A & B\nOne\ntwo <3\nlink z"
    assert rows[0]["source_digest"] == warc.digest(PAGE.encode())
    assert warc.visible(PAGE)[1:] == ("A & B", ["/x?a=1&b=2", "y"])
    parsed = [next(warc.parse(bytes(row["record"]))) for row in warc.serialized(records.drop("page_id")).collect()]
    assert Counter((h["warc-type"], h["warc-refers-to"], h["warc-block-digest"], b) for h, b in parsed) == Counter(
        (row["warc_type"], row["refers_to"], row["block_digest"], bytes(row["block"])) for row in records.collect())
    assert all(warc.digest(b) == h["warc-block-digest"] for h, b in parsed)


class Seen(HTMLParser):
    """Text, title and links of a page by the standard library's parser."""

    def __init__(self):
        super().__init__()
        self.inside, self.text, self.title, self.links = "", "", "", []

    def handle_starttag(self, tag, attrs):
        self.inside = tag if tag in ("script", "style", "title") else self.inside
        self.links += [value for name, value in attrs if tag == "a" and name == "href" and value]

    def handle_endtag(self, tag):
        self.inside = "" if tag == self.inside else self.inside

    def handle_data(self, data):
        self.title += data if self.inside == "title" else ""
        self.text += "" if self.inside in ("script", "style") else data


def test_derived_records_of_all_pages(spark, data):
    """Each page's two records against another parser, and their links, lengths and digests."""
    pages = spark.read.parquet(f"{data}/pages.parquet")
    html = {row["page_id"]: row["html"] or "" for row in pages.collect()}
    records = defaultdict(dict)
    for row in warc.derive(warc.responses_of_pages(pages), keep=["page_id"]).collect():
        records[row["page_id"]][row["warc_type"]] = row
    assert set(records) == set(html)
    for page, pair in records.items():
        assert set(pair) == {"metadata", "conversion"} and pair["metadata"]["refers_to"] == pair["conversion"]["refers_to"]
        seen = Seen()
        seen.feed(html[page])
        seen.close()
        about, text = json.loads(bytes(pair["metadata"]["block"])), bytes(pair["conversion"]["block"]).decode()
        assert "".join(text.split()) == "".join(seen.text.split())
        assert about["title"].split() == seen.title.split() and about["links"] == seen.links
        for row in pair.values():
            block = bytes(row["block"])
            assert row["content_length"] == len(block)
            assert row["block_digest"] == "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()
            assert row["source_digest"] == "sha1:" + base64.b32encode(hashlib.sha1(html[page].encode()).digest()).decode()


def test_source_headers_and_damaged_records(spark, tmp_path):
    def record(number, *more):
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>page %d" % number
        head = ["WARC/1.1", "WARC-Type: response", f"WARC-Record-ID: <urn:{number}>", f"Content-Length: {len(block)}", *more]
        return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"

    own = record(1, "WARC-Payload-Digest: sha1:ABC", "WARC-IP-Address: 10.0.0.1")
    broken = bytearray(gzip.compress(record(2)))
    broken[20:40] = bytes(20)
    whole = gzip.compress(own) + bytes(broken) + gzip.compress(record(3))
    (tmp_path / "a.warc.gz").write_bytes(whole + gzip.compress(record(4))[:-30])
    (tmp_path / "b.warc").write_bytes(record(5) + record(6)[:-20])
    (tmp_path / "c.warc.gz").write_bytes(b"")
    responses = warc.read_responses(spark, str(tmp_path)).withColumn("warc_type", F.lit("kept"))
    records = warc.derive(responses, keep=["warc_type"]).collect()
    assert {row["refers_to"] for row in records} == {"<urn:1>", "<urn:3>", "<urn:5>"} and len(records) == 6
    assert {row["warc_type_"] for row in records} == {"kept"} and {row["warc_type"] for row in records} == {"metadata", "conversion"}
    for row in records:
        if row["refers_to"] == "<urn:1>":
            assert row["source_digest"] == "sha1:ABC"
            if row["warc_type"] == "metadata":
                about = json.loads(bytes(row["block"]))
                assert about["source_headers"]["warc-ip-address"] == "10.0.0.1" and about["payload_digest"] == "sha1:ABC"
    counts = {row["path"].rsplit("/", 1)[1]: (row["whole"], row["damaged"]) for row in warc.damaged_records(spark, str(tmp_path)).collect()}
    assert {name: found for name, found in counts.items() if name != "c.warc.gz"} == {"a.warc.gz": (2, 2), "b.warc": (1, 1)}
    unnamed = spark.createDataFrame([(None, "http://a/", None, b"x"), (None, "http://b/", None, b"x"), (None, None, None, None)],
                                    "record_id string, target_uri string, warc_date string, block binary")
    assert warc.derive(unnamed).select("record_id").distinct().count() == 6


def test_ring_by_walking_rows(spark, monkeypatch):
    """Against a walk of single rows; one id holds a third of them, in many cells."""
    monkeypatch.setattr(sharding, "_CELL", 16)
    monkeypatch.setattr(sharding, "_RUN", 7)
    docs = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"),
                                    F.when(F.col("id") % 9 > 0, F.concat(F.lit("t"), "id")).alias("text"))
    found = sharding.assign(docs).collect()
    owners = [shard for _, shard in sharding.ring()]
    edges = [bucket for bucket, _ in sharding.ring()]
    loads = Counter()
    for row in docs.collect():
        named = "null" if row["doc_id"] is None else str(row["doc_id"])
        bucket = int(hashlib.md5(named.encode()).hexdigest()[:4], 16)
        loads[sum(edge < bucket for edge in edges) % len(edges)] += 1
    room, going, wanted = [375] * 8, dict(loads), Counter()
    for hop in range(len(owners)):
        for arc in sorted(going):
            shard = owners[(arc + hop) % len(owners)]
            while going[arc] and room[shard]:
                room[shard] -= 1
                going[arc] -= 1
                wanted[arc, shard] += 1
    given = Counter()
    for row in found:
        named = "null" if row["doc_id"] is None else str(row["doc_id"])
        bucket = int(hashlib.md5(named.encode()).hexdigest()[:4], 16)
        given[sum(edge < bucket for edge in edges) % len(edges), row["shard"]] += 1
    assert given == wanted
    assert Counter(row["doc_id"] for row in found) == Counter(row["doc_id"] for row in docs.collect())
    assert sorted((row["shard"], row["slot"]) for row in found) == [(shard, slot) for shard in range(8) for slot in range(375)]
