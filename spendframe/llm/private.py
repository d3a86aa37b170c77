"""Personal data: fixed patterns, and contextual patterns bootstrapped from their finds.

1. Base: e-mail, address, card and phone patterns with their checks, on whole texts.
2. Valid finds are seeds. Other tokens are number runs, also over single spaces
   and brackets, and runs of letters, digits and marks that hold a digit or an at sign,
   within longer words, quoted values and scripts without spaces too. The words around
   seeds and tokens make lexical patterns; patterns and tokens form a graph.
3. A pattern's confidence in a kind is the belief in that kind summed over its
   different tokens, over their number and a prior. Patterns that are confident
   and have enough believed tokens pass belief on to their other tokens. This is
   repeated ``ROUNDS`` times; each round is a join and two sums in Spark.
4. Tokens that look like an identifier, stand in a confident pattern and touch no base
   find become further spans of that kind.

Defined cases: a null text is empty and has no finds; repeated rows have equal finds and
count once; tokens and words of any length count, long ones are compared by a digest;
base finds that overlap share the words around them all; among kinds of equal belief
the first listed is taken; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendframe.llm import frames

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
MIN_SUPPORT = 3
MIN_CONFIDENCE = 0.7
PRIOR = 0.5
MIN_DIGITS = 4
#: Longer tokens and words are kept as a digest.
SPELLED = 64

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_NUMBERS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MARK = r"A-Za-z0-9._%+\-@#*~"
#: Groups of digits with one separator between two of them; else colon-separated hex
#: groups; else a run of letters, digits and marks with a digit or an at sign.
_TOKEN = re.compile(
    rf"(?<![{_MARK}])[+(]{{0,2}}[0-9]++(?![A-Za-z@_%])(?:(?:\)[\x20./-]?|\x20?\(|\x20-\x20|[\x20./-])[0-9]++(?![A-Za-z@_%]))+(?![._%+\-#*~]*[A-Za-z0-9@])"
    rf"|(?<![{_MARK}:])[0-9A-Fa-f]{{1,4}}+(?::[0-9A-Fa-f]{{0,4}}+){{2,7}}+(?![{_MARK}:])"
    rf"|(?<![{_MARK}])[A-Za-z._%+\-#*~]*+[0-9@][{_MARK}]*+")
#: Scripts that put no space between words count each character as a word.
_UNSPACED = r"\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u2E80-\u30FF\u3400-\u9FFF\uF900-\uFAFF"
_WORD = re.compile(rf"[{_UNSPACED}]|[^\W{_UNSPACED}]+")
_HINT = re.compile(r"[0-9@]")
_DIGIT = re.compile(r"[0-9]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """As ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, in one walk over the at signs."""
    free, at = 0, text.find("@")
    while at >= 0:
        before = text[free:at]
        start = free + len(before.rstrip(_LOCAL))
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
        free = found.end() if found else at + 1
        at = text.find("@", free)


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    for chain in _NUMBERS.finditer(text):
        parts = chain.group().split(".")
        at = chain.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(part.lstrip("0")) <= 3 and int(part[-3:]) <= 255 for part in four):
                yield at, end
            at = end + 1


def _luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(map(int, reversed(digits))):
        total += digit if place % 2 == 0 else digit * 2 - 9 * (digit > 4)
    return total % 10 == 0


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for found in _CARD.finditer(text):
        digits = found.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and _luhn(digits):
            yield found.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for found in _PHONE.finditer(text):
        if 10 <= sum(c.isdigit() for c in found.group()) <= 15:
            yield found.span()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind in ``KINDS``, end) of all base finds, in order."""
    finds: list[tuple[int, int, int]] = []
    if "@" in text:
        finds += [(start, 0, end) for start, end in _emails(text)]
    if _DIGIT.search(text):
        finds += [(start, 1, end) for start, end in _addresses(text)]
        finds += [(start, 2, end) for start, end in _cards(text)]
        finds += [(start, 3, end) for start, end in _phones(text)]
    return sorted(finds)


def _spelled(word: str) -> str:
    if len(word) <= SPELLED:
        return word
    return "#" + hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=12).hexdigest()


def _word(word: str) -> str:
    return _spelled(_DIGIT.sub("0", word.lower()))


def _words_before(text: str, low: int, high: int) -> list[str]:
    """The last two words of a stretch of text; reads no more of it than they take."""
    reach = 64
    while True:
        at = max(low, high - reach)
        found = list(_WORD.finditer(text, at, high))[-2:]
        if at == low or (len(found) == 2 and found[0].start() > at):
            return [_word(word.group()) for word in found]
        reach *= 2


def _candidates(text: str, low: int, high: int) -> Iterator[tuple[int, int]]:
    """Tokens of a stretch between base finds, without marks around them, that touch neither."""
    for found in _TOKEN.finditer(text, low, high):
        token = found.group()
        start = found.start() + len(token) - len(token.lstrip("._%-*~"))
        end = found.end() - len(token) + len(token.rstrip("._%+-#*~"))
        if start < end and not (found.start() == low > 0) and not (found.end() == high < len(text)):
            yield start, end


def _looks_like_identifier(token: str) -> bool:
    return len(_DIGIT.findall(token)) >= MIN_DIGITS or ("@" in token and len(token) > 4)


def tokens(text: str, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, str, int, bool, tuple[str, str]]]:
    """(start, end, token, kind or -1, looks like an identifier, patterns) of base finds and other tokens.

    Kind -1 is a token of no known kind. Patterns are the two words before a place, and
    the words on both sides of it; a neighbouring find or token is a word there too.
    """
    places: list[tuple[int, int, list[tuple[int, int, int]]]] = []
    for start, kind, end in base:
        if places and start < places[-1][1]:
            places[-1][2].append((start, end, kind))
            places[-1] = (places[-1][0], max(places[-1][1], end), places[-1][2])
        else:
            places.append((start, end, [(start, end, kind)]))
    bounds = [0, *(bound for place in places for bound in place[:2]), len(text)]
    for low, high in zip(bounds[::2], bounds[1::2], strict=True):
        places += [(start, end, [(start, end, -1)]) for start, end in _candidates(text, low, high)]
    places.sort(key=lambda place: place[0])
    before: list[str] = []
    free = 0
    for i, (start, end, finds) in enumerate(places):
        before = (before + _words_before(text, free, start))[-2:]
        following = places[i + 1] if i + 1 < len(places) else (len(text), len(text), [])
        after = _WORD.search(text, end, following[0])
        word = after.group() if after else text[following[0] : following[1]]
        patterns = (" ".join(before) + " _", " ".join(before[-1:]) + " _ " + _word(word))
        for low, high, kind in finds:
            token = text[low:high].lower()
            yield low, high, _spelled(token), kind, kind < 0 and _looks_like_identifier(token), patterns
        before, free = (before + [_word(text[start:end])])[-2:], end


def find(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Each row's doc_id, digest of the text, base finds and tokens in context."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, seen = [], []
            for value in batch.column(2):
                whole = value.as_py() or ""
                spans = base_spans(whole)
                base.append([{"start": s, "kind": k, "end": e} for s, k, e in spans])
                seen.append([{"start": s, "end": e, "token": t, "kind": k, "looks": a, "patterns": list(p)}
                             for s, e, t, k, a, p in tokens(whole, spans)] if _HINT.search(whole) else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(base, _BASE), pa.array(seen, _SEEN)],
                names=["doc_id", "content", "base", "seen"])

    rows = frames.texts(docs, F.col(f"`{id}`").cast("long").alias("doc_id"),
                        frames.content_key(F.col(f"`{text}`")).alias("content"),
                        F.col(f"`{text}`").cast("string").alias("text"))
    return rows.mapInArrow(scan, "doc_id long, content long, base array<struct<start: int, kind: int, end: int>>, "
                                 "seen array<struct<start: int, end: int, token: string, kind: int, looks: boolean, patterns: array<string>>>")


_BASE = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
_SEEN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("token", pa.string()),
                            ("kind", pa.int32()), ("looks", pa.bool_()), ("patterns", pa.list_(pa.string()))]))


def confident_patterns(seen: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Columns pattern, kind and confidence, scored on the graph of patterns and tokens.

    ``seen`` has token, kind, looks and pattern. Edges are stored once; a round sums belief
    up by pattern and spreads it by token, both with partial sums before the shuffle.
    Joins spread patterns and tokens that hold many edges over several tasks.
    """
    edges = frames.store(seen.groupBy("pattern", "token").agg(F.max("kind").alias("kind"), F.max("looks").alias("looks")), "edges")
    sizes = edges.groupBy("pattern").agg(F.count("*").alias("tokens")).filter(F.col("tokens") >= MIN_SUPPORT)
    sizes = frames.store(sizes, "patterns")
    kept = frames.store(frames.spread_join(edges, sizes.select("pattern"), ["pattern"]), "edges")
    belief = frames.store(
        kept.filter("kind >= 0").select("token", "kind", F.lit(1.0).alias("belief")).distinct(), "belief")
    believed, links = belief, kept.select("pattern", "token")
    frames.discard(edges)
    for turn in range(rounds):
        summed = frames.spread_join(links, believed, ["token"]).groupBy("pattern", "kind").agg(
            F.sum("belief").alias("belief"), F.count("*").alias("support"))
        scored = (
            summed.join(sizes, "pattern")
            .withColumn("confidence", F.col("belief") / (F.col("tokens") + PRIOR))
            .filter((F.col("confidence") >= MIN_CONFIDENCE) & (F.col("support") >= MIN_SUPPORT))
            .select("pattern", "kind", "confidence")
        )
        scored = frames.store(scored, "confident")
        if turn + 1 < rounds:
            doubt = F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-9)))))
            spread = (
                frames.spread_join(kept.filter("kind < 0 and looks").select("pattern", "token"), scored, ["pattern"])
                .groupBy("token", "kind").agg((1 - doubt).alias("belief"))
            )
            believed = frames.store(belief.union(spread), "belief")
    return scored


def _spans(finds: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(finds, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """doc_id, counts of base finds by kind, their digest, all spans, and the number added."""
    found = frames.store(find(docs, text, id), "finds")
    tokens_seen = found.select("doc_id", "content", F.explode("seen").alias("s")).select(
        "doc_id", "content", "s.start", "s.end", "s.token", "s.kind", "s.looks", F.explode("s.patterns").alias("pattern"))
    confident = confident_patterns(tokens_seen.select("token", "kind", "looks", "pattern"))
    added = (
        frames.spread_join(tokens_seen.filter("kind < 0 and looks").drop("kind"), confident, ["pattern"])
        .groupBy("doc_id", "content", "start", "end")
        .agg(F.max(F.struct("confidence", (-F.col("kind")).alias("order"))).alias("best"))
        .groupBy("doc_id", "content")
        .agg(F.collect_list(F.struct("start", (-F.col("best.order")).alias("kind"), "end")).alias("added"))
    )
    joined = frames.spread_join(found.drop("seen"), frames.store(added, "added"), ["doc_id", "content"], "left")
    none = F.array().cast("array<struct<start: int, kind: int, end: int>>")
    everything = joined.withColumn("added", F.coalesce("added", none)).withColumn(
        "every", F.array_sort(F.concat("base", F.col("added").cast("array<struct<start: int, kind: int, end: int>>"))))

    def number(kind: int) -> Column:
        return F.size(F.filter("base", lambda span: span["kind"] == kind)).cast("long")

    counts = [number(kind).alias(f"n_{name}") for kind, name in enumerate(KINDS)]
    return everything.select(
        "doc_id", *counts, F.sha2(_spans("base"), 256).alias("base_sha256"), _spans("every").alias("spans"),
        F.size("added").cast("long").alias("n_added"))
