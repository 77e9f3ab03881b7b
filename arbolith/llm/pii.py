"""PII by bootstrapped contextual extraction.

Fixed patterns find e-mail addresses, IP addresses, card and phone numbers: the seed entities.
The words around a seed, runs of letters, digits and underscores, are its lexical patterns (the two words before it; the word
before and the word after), however far away they stand. Every identifier-like part of the corpus (a token with a digit, an @ or an inner dot, also
written out as [at] or [dot]; a run of digit groups) is an instance of the patterns around it. Spark scores the graph of patterns and instances for each kind of seed, in turn: a
pattern's confidence is the mean score of its instances (with one failure added), and an
instance's score is the chance that not all of its patterns are wrong; seeds keep score 1
and 0 for other kinds. Each round's scores reach the patterns of all instances, seeded or not. Patterns that end with
`confidence` and `support` distinct instances that are seeds or score `confidence` discover the instances in them:
spans of kind like_email, like_ip, like_card or like_phone.

Scale: one pass over the texts leaves ids, spans and contexts in the shared checkpoint folder;
a text with very many identifiers makes several rows there, so that memory doesn't follow their number. Texts are never shuffled. Edges are distinct (pattern, value) pairs, aggregated before each shuffle. An instance
without a score adds nothing to a sum, so only its count is kept. Confident patterns are joined, not collected.

Null texts count as empty. Places are code points, ends exclusive. Rows that repeat get the
same answer; without seeds nothing is discovered.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbolith.llm.common import saved, skew_join, slices
from arbolith.llm.spans import PIECE, span_rows

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, *(f"like_{k}" for k in BASE))
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")  # no match starts inside a run of digits
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]")
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
WORD = re.compile(r"\w+")
MARK = re.compile(r"[0-9@]|[\[({<](?:at|dot)[\])}>]|[^\W\d_]\.[^\W\d_]", re.IGNORECASE)
#: Groups of digits joined by up to 3 spaces, dots, brackets or hyphens; possessive, so that a match is never tried twice.
RUN = re.compile(r"(?<!\w)\(?[0-9]++(?:[\x20.()\[\]-]{1,3}+[0-9]++)++")
TRIM = "\"'()[]{}<>,;:.!?#$%&*|"
FIELD = "struct<kind:string,first:int,last:int,value:string,patterns:array<string>>"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost, non-overlapping: the run of local characters before each @, and the domain after it."""
    free = 0
    at = text.find("@")
    while at >= 0:
        before = text[free:at]
        first = at - (len(before) - len(before.rstrip(LOCAL)))
        domain = DOMAIN.match(text, at + 1) if first < at else None
        if domain:
            yield first, domain.end()
        free = domain.end() if domain else at + 1
        at = text.find("@", free)


def is_ip(found: str) -> bool:
    return all(len(p) <= 3 and int(p or 0) <= 255 for p in (q.lstrip("0") for q in found.split(".")))


def is_card(found: str) -> bool:
    digits = found.replace(" ", "").replace("-", "")
    return 14 <= len(digits) <= 19 and luhn(digits)


def base_spans(text: str) -> Iterator[tuple[str, int, int]]:
    """(kind, first, last) by start, then kind as listed."""
    by_kind = [(("email", a, b) for a, b in emails(text))] if "@" in text else []
    if DIGITS.search(text):
        by_kind.append(("ip", *m.span()) for m in IP.finditer(text) if is_ip(m[0]))
        by_kind.append(("card", *m.span()) for m in CARD.finditer(text) if is_card(m[0]))
        if "+" in text:
            by_kind.append(("phone", *m.span()) for m in PHONE.finditer(text) if 10 <= len(DIGITS.findall(m[0])) <= 15)
    return heapq.merge(*by_kind, key=lambda s: (s[1], BASE.index(s[0])))


def marked_tokens(text: str) -> Iterator[tuple[int, int]]:
    """Places of the tokens with a digit, an @ or a dot inside, written out ([at], [dot]) or not, trimmed."""
    for m in TOKEN.finditer(text):
        if MARK.search(m[0]):
            a = m.start() + len(m[0]) - len(m[0].lstrip(TRIM))
            yield a, a + len(m[0].strip(TRIM))


def identifiers(text: str, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Marked tokens and runs of digit groups, by place: those of at least 5 characters that touch no span (`taken`: their places, by start).
    A run and a token in it are both given."""
    if not MARK.search(text):
        return
    ahead, last = 0, None
    for a, b in heapq.merge((m.span() for m in RUN.finditer(text)), marked_tokens(text)):
        if (a, b) == last:
            continue
        last = a, b
        while ahead < len(taken) and taken[ahead][1] <= a:
            ahead += 1
        if b - a >= 5 and not (ahead < len(taken) and taken[ahead][0] < b):
            yield a, b


def words_before(text: str, first: int) -> list[str]:
    """The two words nearest before `first`, fewer if there are no more. Looks back twice as far until they are whole."""
    reach = 80
    while True:
        at = max(0, first - reach)
        found = WORD.findall(text, at, first)
        if at and found and WORD.fullmatch(text, at - 1, at + 1):  # begins before the part looked at
            del found[0]
        if not at or len(found) > 1:
            return found[-2:]
        reach *= 2


def contexts(text: str, first: int, last: int) -> list[str]:
    """Patterns of the words around [first, last), lower-cased; words of over 64 characters stand as their hash."""
    before, after = words_before(text, first), WORD.search(text, last)
    near = [
        w.lower() if len(w) <= 64 else hashlib.md5(w.lower().encode()).hexdigest() for w in (*before, *([after[0]] if after else []))
    ]
    out = [f"{near[0]} {near[1]} _"] if len(before) > 1 else []
    return out + ([f"{near[-2]} _ {near[-1]}"] if before and after else [])


KIND = pa.struct([("kind", pa.string()), ("first", pa.int32()), ("last", pa.int32()), ("value", pa.string()), ("patterns", pa.list_(pa.string()))])


def _scan(piece: int = PIECE):
    def base(text: str) -> Iterator[tuple]:
        return ((kind, a, b, text[a:b], contexts(text, a, b)) for kind, a, b in base_spans(text))

    def more(text: str, taken: list[tuple[int, int]]) -> Iterator[tuple]:
        return (("", a, b, text[a:b], contexts(text, a, b)) for a, b in identifiers(text, taken))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            yield from span_rows(batch, base, more, KIND, piece)

    return run


def scan(docs: DataFrame, id_col: str, text_col: str, piece: int = PIECE) -> DataFrame:
    """id, row, piece, base and more: the seeds and the other identifier-like tokens, each with its patterns. A text with very many of the latter makes
    several rows, with the same `row` and `piece` 0, 1, ...; the seeds are in the first."""
    columns = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).cast("string").alias("text"))
    kind = columns.schema["id"].dataType.simpleString()
    return columns.mapInArrow(_scan(piece), f"id {kind}, row long, piece int, base array<{FIELD}>, more array<{FIELD}>")


def confident_patterns(scanned: DataFrame, rounds: int = 3, confidence: float = 0.7, support: int = 3) -> DataFrame:
    """(pattern, kind, confidence), one kind a pattern, of the patterns that may discover instances."""
    spans = scanned.select(F.explode(F.concat("base", "more")).alias("s"))
    edges = saved(
        spans.select(F.explode("s.patterns").alias("pattern"), F.col("s.value").alias("value"), F.col("s.kind").alias("seed")).distinct()
    )
    sizes = saved(edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")))
    seeds = edges.filter("seed <> ''").select("pattern", F.col("seed").alias("kind"), F.lit(1.0).alias("score"))
    others = edges.filter("seed = ''").select("pattern", "value")
    scored = seeds
    for k in range(rounds):
        if k:
            found = skew_join(others, scores, ["value"], "inner").select("pattern", F.explode("s").alias("s"))
            scored = seeds.unionByName(found.select("pattern", "s.kind", "s.score"))
        sums = scored.groupBy("pattern", "kind").agg(
            F.sum("score").alias("total"), F.count_if(F.col("score") >= confidence).alias("sure")
        )
        # instances without a score count with 0
        patterns = saved(
            skew_join(sums, sizes, ["pattern"], "inner").select("pattern", "kind", (F.col("total") / (F.col("n") + 1)).alias("confidence"), "sure")
        )
        if k == rounds - 1:
            break
        # 1 - product of (1 - confidence), as a sum of logarithms
        doubt = F.log(1 - F.least(F.col("confidence"), F.lit(0.999)))
        by_pattern = patterns.groupBy("pattern").agg(F.collect_list(F.struct("kind", doubt.alias("doubt"))).alias("k"))
        scores = saved(
            skew_join(edges.select("value", "pattern"), by_pattern, ["pattern"], "inner")
            .select("value", F.explode("k").alias("k"))
            .groupBy("value", "k.kind")
            .agg((1 - F.exp(F.sum("k.doubt"))).alias("score"))
            .groupBy("value")
            .agg(F.collect_list(F.struct("kind", "score")).alias("s"))
        )
    good = patterns.filter((F.col("confidence") >= confidence) & (F.col("sure") >= support))
    best = F.max(F.struct("confidence", "sure", "kind")).alias("b")
    return good.groupBy("pattern").agg(best).select("pattern", "b.kind", "b.confidence")


def find_pii(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    rounds: int = 3,
    confidence: float = 0.7,
    support: int = 3,
    piece: int = PIECE,
) -> DataFrame:
    """One row per input row: `id_col`, base and discovered (arrays of kind, first, last, value)."""
    scanned = saved(scan(docs, id_col, text_col, piece))
    patterns = confident_patterns(scanned, rounds, confidence, support)
    plain = "array<struct<kind:string,first:int,last:int,value:string>>"
    occurrences = scanned.select("row", F.explode("more").alias("s")).select(
        "row", "s.first", "s.last", "s.value", F.explode("s.patterns").alias("pattern")
    )
    discovered = (
        skew_join(occurrences, patterns, ["pattern"], "inner")
        .groupBy("row", "first", "last", "value")
        .agg(F.max(F.struct("confidence", "kind"))["kind"].alias("kind"))
        .groupBy("row")
        .agg(
            F.array_sort(
                F.collect_list(F.struct(F.concat(F.lit("like_"), "kind").alias("kind"), "first", "last", "value"))
            ).alias("discovered")
        )
    )
    base = F.transform("base", lambda s: F.struct(*[s[f].alias(f) for f in ("kind", "first", "last", "value")]))
    return (
        scanned.filter("piece = 0").select("row", "id", base.alias("base"))
        .join(discovered, "row", "left")
        .select(F.col("id").alias(id_col), "base", F.coalesce("discovered", F.array().cast(plain)).alias("discovered"))
    )
