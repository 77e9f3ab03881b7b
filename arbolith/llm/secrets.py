"""Secret scans: fixed patterns, and formats inferred from what they find.

The fixed patterns find assignments, access keys and hexadecimal runs. Up to `sample` distinct
values of each kind become labelled credentials. A prefix tree over their
character classes whose statistically compatible states are merged becomes a probabilistic automaton. Parts of them that are left
out in turn set the likelihood that 98% of credentials reach. Then every
candidate of the corpus, a run of 12 or more credential characters outside of the fixed patterns' spans, is scored. It becomes a span
of kind learned if it is as likely as labelled credentials are, and if its odds are even at least: likelier under the automaton than under
a Markov chain of the classes of all texts, by as many times as there are more candidates than labelled credentials. The first rule
alone says little where labelled values are few; the second holds at every size. A kind with fewer than 8 distinct
labelled values has no automaton: nothing is learned from it.

Scale: one pass over the texts, which leaves only ids, spans, candidates and the chain's counts, in the shared
checkpoint folder; scoring reads that. The labelled values are the `sample` smallest by a
hash of those of at most `longest` characters, a bound that doesn't grow with the corpus or its texts; the automata are no larger than them, and the chain has 144 counts.
Nothing is shuffled but distinct credential values. A text with very many candidates makes several rows of the scan, so that memory doesn't follow
the number of its spans; candidates of any length are scored whole.

Null texts count as empty and have no spans. Places are code points, ends exclusive. Rows that
repeat get the same answer; without labelled values there are no learned spans.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbolith.llm.common import bounded_join, saved, slices
from arbolith.llm.spans import PIECE, span_rows

KINDS = ("assign", "access", "hex", "learned")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
KEYWORDS = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # a run that is too short has no longer one inside
HEX = re.compile(r"[0-9a-f]{16,}")
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{12,}")

SPAN = "struct<kind:string,first:int,last:int,value:string>"


def base_spans(text: str) -> Iterator[tuple[str, int, int, str]]:
    """(kind, first, last, credential), by start, then kind as listed."""
    low = text.lower()
    by_kind = []
    if any(k in low for k in KEYWORDS):
        by_kind.append(("assign", *m.span(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 12)
    if "AKIA" in text:
        by_kind.append(("access", *m.span(), m[0]) for m in ACCESS.finditer(text))
    by_kind.append(("hex", *m.span(), m[0]) for m in HEX.finditer(text))
    return heapq.merge(*by_kind, key=lambda s: (s[1], KINDS.index(s[0])))


def candidates(text: str, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int, str]]:
    """Runs of credential characters that touch no span; `taken`: the spans' places, by start."""
    ahead = 0
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        while ahead < len(taken) and taken[ahead][1] <= a:
            ahead += 1
        if not (ahead < len(taken) and taken[ahead][0] < b):
            yield a, b, m[0]


#: Character classes: digits, a-f, g-z, A-F, G-Z; other credential characters stand for themselves. 0 is any other character.
CLASSES = ("0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", *"+/_.=-")
CLASS = np.zeros(256, np.uint8)
for _k, _chars in enumerate(CLASSES):
    CLASS[list(_chars.encode())] = _k + 1
WIDTH = len(CLASSES) + 1


def symbols(value: str) -> np.ndarray:
    return CLASS[np.frombuffer(value.encode("ascii", "replace"), np.uint8)]


def pair_counts(texts: list[str | None]) -> np.ndarray:
    """How often each class follows each other, over all bytes of the texts."""
    total = np.zeros(WIDTH * WIDTH, np.int64)
    for text in texts:
        for steps in walked(CLASS[np.frombuffer((text or "").encode(), np.uint8)]):
            total += np.bincount(steps[:-1] * np.int64(WIDTH) + steps[1:], minlength=WIDTH * WIDTH)
    return total


def walked(path: np.ndarray, size: int = 1 << 20) -> Iterator[np.ndarray]:
    """Class 0, the path's classes and class 0 again, in pieces that overlap by one."""
    whole = np.concatenate([[0], path, [0]]).astype(np.uint8)
    for at in range(0, len(whole) - 1, size):
        yield whole[at : at + size + 1]


class Chain:
    """How likely a run of credential characters is in ordinary text: a Markov chain of classes, add-one smoothed."""

    def __init__(self, counts: np.ndarray):
        steps = counts.reshape(WIDTH, WIDTH).astype(float) + 1
        steps[0, 0] = 0  # a run has begun
        with np.errstate(divide="ignore"):
            self.logs = np.log(steps / steps.sum(axis=1, keepdims=True))

    def loglik(self, value: str) -> float:
        return float(sum(self.logs[steps[:-1], steps[1:]].sum() for steps in walked(symbols(value))))


class Automaton:
    """A probabilistic automaton, merged from the prefix tree of some values.

    Two states merge when, for the end and for each symbol, their frequencies differ by less
    than Hoeffding's bound at `alpha`, and their successors are compatible in turn.
    """

    def __init__(self, values: list[str], alpha: float = 0.05):
        self.next: list[dict[int, int]] = [{}]
        self.passed: list[int] = [0]
        self.ended: list[int] = [0]
        self.taken: list[dict[int, int]] = [{}]
        self.width = math.sqrt(0.5 * math.log(2 / alpha))
        for value in values:
            at = 0
            for s in symbols(value).tolist():
                self.passed[at] += 1
                self.taken[at][s] = self.taken[at].get(s, 0) + 1
                if s not in self.next[at]:
                    self.next[at][s] = len(self.next)
                    for column, empty in ((self.next, {}), (self.passed, 0), (self.ended, 0), (self.taken, {})):
                        column.append(empty)
                at = self.next[at][s]
            self.passed[at] += 1
            self.ended[at] += 1
        self._merge()
        # where a symbol leads most often: scoring goes on from there after a step that no labelled value takes
        steps: dict[int, dict[int, int]] = {}
        for q in self.states:
            for x, n in self.taken[q].items():
                targets = steps.setdefault(x, {})
                targets[self.next[q][x]] = targets.get(self.next[q][x], 0) + n
        self.usual = {x: max(sorted(t), key=t.get) for x, t in steps.items()}

    def _alike(self, f: int, n: int, g: int, m: int) -> bool:
        return abs(f / n - g / m) < self.width * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def _compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = self.passed[a], self.passed[b]
            if not self._alike(self.ended[a], n, self.ended[b], m):
                return False
            for s in {*self.taken[a], *self.taken[b]}:
                if not self._alike(self.taken[a].get(s, 0), n, self.taken[b].get(s, 0), m):
                    return False
                if s in self.next[a] and s in self.next[b]:
                    todo.append((self.next[a][s], self.next[b][s]))
        return True

    def _fold(self, into: int, tree: int) -> None:
        todo = [(into, tree)]
        while todo:
            a, b = todo.pop()
            self.passed[a] += self.passed[b]
            self.ended[a] += self.ended[b]
            for s, n in self.taken[b].items():
                self.taken[a][s] = self.taken[a].get(s, 0) + n
                if s in self.next[a]:
                    todo.append((self.next[a][s], self.next[b][s]))
                else:
                    self.next[a][s] = self.next[b][s]

    def _merge(self) -> None:
        settled, known = [0], {0}
        while True:
            border = [(-self.passed[to], q, s) for q in settled for s, to in self.next[q].items() if to not in known]
            if not border:
                self.states = settled
                return
            _, q, s = min(border)
            new = self.next[q][s]
            like = next((r for r in settled if self._compatible(r, new)), None)
            if like is None:
                settled.append(new)
                known.add(new)
            else:
                self.next[q][s] = like
                self._fold(like, new)

    def loglik(self, value: str) -> float:
        """Log-likelihood of the value's classes and its end; unseen steps count as 1 in 10,000."""
        at, total = 0, 0.0
        for s in symbols(value).tolist():
            n = self.taken[at].get(s, 0) if at >= 0 else 0
            total += math.log(n / self.passed[at]) if n else math.log(1e-4)
            at = self.next[at][s] if n else self.usual.get(s, -1)
        ended = self.ended[at] if at >= 0 else 0
        return total + (math.log(ended / self.passed[at]) if ended else math.log(1e-4))

    def score(self, value: str) -> float:
        """Mean log-likelihood of a step."""
        return self.loglik(value) / (len(value) + 1)


def infer(values: list[str], folds: int = 4, least_values: int = 8) -> tuple[Automaton, float] | None:
    """An automaton and the score that 98% of the values reach when automata of the others score them."""
    if len(values) < least_values:
        return None
    held = []
    for k in range(folds):
        others = Automaton([v for i, v in enumerate(values) if i % folds != k])
        held += [others.score(v) for v in values[k::folds]]
    held.sort()
    return Automaton(values), held[len(held) // 50]


class Detector:
    """Says whether a candidate is a credential: likely enough for some automaton, and at even odds or better."""

    def __init__(self, models: list[tuple[Automaton, float]], chain: Chain, candidates: int, labelled: int):
        self.models, self.chain = models, chain
        self.odds = max(0.0, math.log(max(1, candidates) / max(1, labelled)))

    def accepts(self, value: str) -> bool:
        steps = len(value) + 1
        likely = [x for a, least in self.models if (x := a.loglik(value)) >= least * steps]
        return bool(likely) and max(likely) - self.chain.loglik(value) >= self.odds


KIND = pa.struct([("kind", pa.string()), ("first", pa.int32()), ("last", pa.int32()), ("value", pa.string())])


def _scan(longest: int, piece: int = PIECE):
    def base(text: str) -> Iterator[tuple]:
        for kind, a, b, value in base_spans(text):
            yield kind, a, b, value if len(value) <= longest else None

    def more(text: str, taken: list[tuple[int, int]]) -> Iterator[tuple]:
        return (("", *s) for s in candidates(text, taken))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            pairs = [pair_counts([t.as_py() for t in batch.column("text")]).tolist()]  # in the first row of the slice
            for rows in span_rows(batch, base, more, KIND, piece):
                column = pa.array([*pairs, *[None] * (rows.num_rows - len(pairs))], pa.list_(pa.int64()))
                pairs = []
                yield rows.append_column("pairs", column)

    return run


def _score(detector):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        accepts = detector.value.accepts
        for batch in batches:
            lists = batch.column("more")
            spans, offsets = lists.flatten(), lists.offsets.to_numpy()
            kept = np.array([accepts(v.as_py()) for v in spans.field("value")], bool)
            before = np.r_[0, np.cumsum(kept)]
            rest = pa.ListArray.from_arrays(pa.array(before[offsets - offsets[0]], pa.int32()), spans.filter(pa.array(kept)))
            at = batch.schema.get_field_index("more")
            yield batch.set_column(at, "more", rest)

    return run


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 400, longest: int = 512, piece: int = PIECE) -> DataFrame:
    """One row per input row: `id_col`, base and learned (arrays of kind, first, last, value; base values of over `longest` characters are null). A row of the scan holds `piece` candidates at most."""
    columns = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).cast("string").alias("text"))
    kind = columns.schema["id"].dataType.simpleString()
    schema = f"id {kind}, row long, piece int, base array<{SPAN}>, more array<{SPAN}>, pairs array<long>"
    scanned = saved(columns.mapInArrow(_scan(longest, piece), schema))
    values = scanned.select(F.explode("base").alias("s")).select("s.kind", "s.value").filter("value is not null").distinct()
    models = []
    for k in KINDS[:3]:
        smallest = values.filter(F.col("kind") == k).orderBy(F.xxhash64("value"), "value").limit(sample)
        models.append(infer([r.value for r in smallest.select("value").collect()]))
    counts = np.zeros(WIDTH * WIDTH, np.int64)
    for r in scanned.select(F.posexplode("pairs").alias("k", "n")).groupBy("k").agg(F.sum("n").alias("n")).collect():  # 144 rows at most
        counts[r.k] = r.n
    sizes = scanned.agg(F.sum(F.size("more")).alias("more"), F.sum(F.size("base")).alias("base"), F.max("piece").alias("pieces")).first()
    detector = Detector([m for m in models if m], Chain(counts), sizes.more or 0, sizes.base or 0)
    scored = scanned.drop("pairs").mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(detector)), scanned.drop("pairs").schema)
    learned = F.transform("more", lambda s: s.withField("kind", F.lit("learned")))
    if sizes.pieces:  # texts with very many candidates: what their further rows keep goes to the first one
        scored = saved(scored)
        rest = saved(scored.filter("piece > 0").groupBy("row").agg(F.flatten(F.collect_list("more")).alias("rest")).filter("size(rest) > 0"))
        scored = bounded_join(scored.filter("piece = 0"), rest, ["row"], "left").withColumn("more", F.concat("more", F.coalesce("rest", F.array().cast(f"array<{SPAN}>"))))
    return scored.select(F.col("id").alias(id_col), "base", learned.alias("learned"))
