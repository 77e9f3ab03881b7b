"""Token counts by a tokenizer compiled to finite-state transducers.

A byte-pair tokenizer with word ends (.json of the tokenizers library) becomes two machines:

The segmenter reads character classes and marks where words start. Its few states allow
whole state maps: the text is cut into chunks, each chunk is run from every state at once, the
maps are composed by a parallel prefix scan, and a second run from the now known
states emits the marks.

The word machine reads the bytes of a word and annotates each transition with the
number of tokens that it adds (or takes back, when a longer token replaces several). Its
state is the set of vocabulary prefixes that the word may be inside of, each with the
token before it and the tokens since; the last token of every prefix of a word is the only vocabulary token
that fits the token before it, so a state decides everything that follows. States are
made when first met and kept up to a number; then the table starts afresh.

Scale: one pass without a shuffle. The tokenizer file is read on the driver and broadcast (its size is
fixed); each worker compiles it once. Memory is bounded by the longest text and the table's limit.

Null texts count as empty: no bytes, no tokens. Special strings within texts count as one token, as the
library does by default. No column but the id and the text is read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbolith.llm.common import slices

SPACE, NUMBER, OTHER, QUOTE, LETTER, LONE, R, V, L, E = range(10)
GAP, WORD, MARKS, QUOTED, AFTER_R, AFTER_V, AFTER_L = range(7)
#: Fixed value: the word pattern of the vocabulary, which the segmenter is compiled for.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
STARTS, STARTED_BEFORE = 1, 2  # what a transition emits: a word starts here; one started a character ago
CHUNK = 64


def _segmenter() -> tuple[np.ndarray, np.ndarray]:
    """Next state and emission by state * 10 + class, for PATTERN."""
    step, emit = np.zeros((7, 10), np.uint8), np.zeros((7, 10), np.uint8)
    letters = (LETTER, LONE, R, V, L, E)
    for state in range(7):
        in_word = state in (WORD, AFTER_R, AFTER_V, AFTER_L)
        for c in range(10):
            to, out = {SPACE: (GAP, 0), NUMBER: (GAP, STARTS), OTHER: (MARKS, STARTS), QUOTE: (QUOTED, STARTS)}.get(
                c, (WORD, 0 if in_word else STARTS)
            )
            if state in (MARKS, QUOTED) and c in (OTHER, QUOTE):
                to, out = MARKS, 0
            if state == QUOTED and c in letters:
                to, out = {LONE: (GAP, 0), R: (AFTER_R, 0), V: (AFTER_V, 0), L: (AFTER_L, 0)}.get(c, (WORD, STARTS))
            if state in (AFTER_R, AFTER_V, AFTER_L):
                if c == (L if state == AFTER_L else E):
                    to, out = GAP, 0
                else:
                    out |= STARTED_BEFORE
            step[state, c], emit[state, c] = to, out
    return step.ravel(), emit.ravel()


STEP, EMIT = _segmenter()


def chunk_maps(classes: np.ndarray) -> np.ndarray:
    """For each chunk (a row of classes) and each state before it, the state after it."""
    states = np.tile(np.arange(7, dtype=np.uint8), (len(classes), 1))
    for c in classes.T:
        states = STEP[states * 10 + c[:, None]]
    return states


def compose_prefixes(maps: np.ndarray) -> np.ndarray:
    """Row i: the composition of maps 0..i, in log2(n) rounds of composing with the map `gap` rows before."""
    maps, gap = maps.copy(), 1
    while gap < len(maps):
        maps[gap:] = np.take_along_axis(maps[gap:], maps[:-gap].astype(np.intp), axis=1)
        gap *= 2
    return maps


def word_bounds(classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a class sequence; SPACE is also what separates texts."""
    size = len(classes)
    padded = np.zeros((size // CHUNK + 1) * CHUNK, np.uint8)  # SPACE at the end
    padded[:size] = classes
    chunks = padded.reshape(-1, CHUNK)
    state = np.r_[np.uint8(GAP), compose_prefixes(chunk_maps(chunks))[:-1, GAP]].astype(np.uint8)
    out = np.empty_like(chunks)
    for i, c in enumerate(chunks.T):
        at = state * 10 + c
        out[:, i], state = EMIT[at], STEP[at]
    out = out.ravel()
    begins = (out & STARTS) > 0
    begins[:-1] |= (out[1:] & STARTED_BEFORE) > 0
    starts = np.flatnonzero(begins)
    breaks = np.flatnonzero(begins | (padded == SPACE))
    return starts, breaks[np.searchsorted(breaks, starts, "right")]


class WordMachine:
    """Tokens in a word, by transitions that are made when first taken. END + byte is the last byte of a word."""

    END = 256

    def __init__(self, merges: list, most_states: int = 200_000, most_words: int = 600_000):
        chars = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(chars)]
        byte = {chr(c): c for c in chars} | {chr(256 + i): b for i, b in enumerate(rest)}
        self.most_states, self.most_words = most_states, most_words
        symbol = {c: b for c, b in byte.items()} | {f"{c}</w>": self.END + b for c, b in byte.items()}
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}  # parts: order of the merge, whole
        self.parts: dict[int, list[int]] = {b: [b] for b in range(2 * self.END)}
        number = dict(symbol)
        for order, pair in enumerate(merges):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            whole = number.setdefault(a + b, 2 * self.END + order)
            self.pairs.setdefault((number[a], number[b]), (order, whole))
            self.parts.setdefault(whole, self.parts[number[a]] + self.parts[number[b]])
        self.spines: dict[int, tuple | None] = {}
        self.fit: dict[tuple[int, int], bool] = {}
        self.child: dict[int, int] = {}  # node * 512 + symbol: node
        self.token: dict[int, int] = {}  # node: token that ends there
        nodes = 1
        for token, path in self.parts.items():
            at = 0
            for s in path:
                key = at * 512 + s
                at = self.child.get(key, 0)
                if not at:
                    at = self.child[key] = nodes
                    nodes += 1
            self.token[at] = token
        self.clear()

    def clear(self) -> None:
        self.states = [((0, -1, 0),)]  # (vocabulary prefix, token before it or -1, tokens since)
        self.numbers = {self.states[0]: 0}
        self.steps: dict[int, tuple[int, int]] = {}
        self.words: dict[str, int] = {}

    def spine(self, token: int) -> tuple[list, list] | None:
        """How a token comes about from its own bytes: the (piece, absorbed by which merge) at its left and at its right border,
        or None if merging its bytes gives something else."""
        if token not in self.spines:
            pieces, left, right = list(self.parts[token]), [], []
            while len(pieces) > 1:
                best = min(((self.pairs[p][0], i) for i, p in enumerate(zip(pieces, pieces[1:])) if p in self.pairs), default=None)
                if best is None:
                    break
                order, i = best
                if i == 0:
                    left.append((pieces[0], order))
                if i == len(pieces) - 2:
                    right.append((pieces[-1], order))
                pieces[i : i + 2] = [self.pairs[pieces[i], pieces[i + 1]][1]]
            never = len(self.pairs) + 1
            self.spines[token] = ([*left, (token, never)], [*right, (token, never)]) if pieces == [token] else None
        return self.spines[token]

    def fits(self, before: int, token: int) -> bool:
        """Whether two tokens side by side stay as they are: no merge across the border comes first."""
        known = self.fit.get((before, token))
        if known is None:
            own = self.spine(token)
            known = own is not None
            if known and before >= 0:
                for x, x_gone in self.spine(before)[1]:
                    for y, y_gone in own[0]:
                        merge = self.pairs.get((x, y))
                        # of equal merges the left one is first: x goes before, y after
                        if merge and merge[0] < x_gone and merge[0] <= y_gone:
                            known = False
            if len(self.fit) > 5 * self.most_states:
                self.fit.clear()
            self.fit[before, token] = known
        return known

    def make(self, state: int, symbol: int) -> tuple[int, int]:
        """The transition of `state` by `symbol`: next state, tokens added."""
        onwards, chosen = [], None
        for node, before, since in self.states[state]:
            at = self.child.get(node * 512 + symbol)
            if at is None:
                continue
            onwards.append((at, before, since))
            token = self.token.get(at)
            if token is not None and self.fits(before, token):
                chosen = (token, since)
        token, since = chosen
        added = 1 - since
        if symbol >= self.END:
            to = 0
        else:
            key = (*((n, b, s + added) for n, b, s in onwards), (0, token, 0))
            to = self.numbers.get(key)
            if to is None:
                to = self.numbers[key] = len(self.states)
                self.states.append(key)
        self.steps[state * 512 + symbol] = to, added
        return to, added

    def count(self, word: bytes) -> int:
        if len(self.states) > self.most_states:
            self.clear()
        state = total = 0
        get, base = self.steps.get, self.END
        for b in word[:-1]:
            state, added = get(state * 512 + b) or self.make(state, b)
            total += added
        at = word[-1] + base
        return total + (get(state * 512 + at) or self.make(state, at))[1]

    def counts(self, words: list[str]) -> np.ndarray:
        out = np.fromiter(map(self.words.get, words, repeat(-1)), np.int64, len(words))
        for i in np.flatnonzero(out < 0).tolist():
            word = words[i]
            n = self.words.get(word)
            if n is None:
                n = self.count(word.encode())
                if len(word) <= 64:
                    if len(self.words) >= self.most_words:
                        self.words.clear()
                    self.words[word] = n
            out[i] = n
        return out


class TokenCounter:
    """Counts tokens of texts as the library does for this tokenizer file."""

    def __init__(self, tokenizer_json: str):
        import re

        from tokenizers import Tokenizer

        spec = json.loads(tokenizer_json)
        steps = [n["type"] for n in spec["normalizer"]["normalizers"]]
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        if (pattern, spec["model"]["end_of_word_suffix"], steps) != (PATTERN, "</w>", ["NFC", "Replace", "Lowercase"]):
            raise ValueError("only tokenizers with lower-cased words of this pattern and word ends are compiled")
        self.library = Tokenizer.from_str(tokenizer_json)
        self.machine = WordMachine(spec["model"]["merges"])
        self.classes = np.full(0x110000, 255, np.uint8)
        for c, k in ({"'": QUOTE, "r": R, "v": V, "l": L, "e": E} | dict.fromkeys("stmd", LONE)).items():
            self.classes[ord(c)] = k
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None

    def class_of(self, char: str) -> int:
        """The class of a character as the file's own word pattern treats it."""
        split = self.library.pre_tokenizer.pre_tokenize_str
        if not split(char):
            return SPACE
        if len(split(f"a{char}")) == 1:
            return LETTER
        return OTHER if len(split(f"!{char}")) == 1 else NUMBER

    def normal(self, text: str) -> str:
        """The text as the file's own normalizer leaves it, but for white space, which the segmenter drops anyway.

        Characters up to U+00FF are composed already, and lower-case each for itself.
        """
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.library.normalizer.normalize_str(text)
        return text.lower()

    def counts(self, texts: list[str]) -> list[int]:
        parts, owners, totals = [], [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            pieces = self.special.split(text) if self.special and "<" in text else [text]
            totals[i] += len(pieces) - 1
            for piece in pieces:
                parts.append(self.normal(piece))
                owners.append(i)
        joined = " ".join(parts)
        if not joined:
            return totals.tolist()
        code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        classes = self.classes[code]
        if classes.max() == 255:
            for c in np.unique(code[classes == 255]).tolist():
                self.classes[c] = self.class_of(chr(c))
            classes = self.classes[code]
        starts, ends = word_bounds(classes)
        n = self.machine.counts([joined[a:b] for a, b in zip(starts.tolist(), ends.tolist())])
        bounds = np.cumsum([0, *(len(p) + 1 for p in parts)])
        until = np.r_[0, np.cumsum(n)][np.searchsorted(starts, bounds)]
        np.add.at(totals, np.array(owners), np.diff(until))
        return totals.tolist()


_COMPILED: dict[int, TokenCounter] = {}


def _count(broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = broadcast.value
        counter = _COMPILED.get(hash(source))
        if counter is None:
            _COMPILED.clear()
            counter = _COMPILED[hash(source)] = TokenCounter(source)
        for batch in slices(batches, "text", 4 << 20):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.compute.fill_null(pa.compute.binary_length(batch.column("text")), 0).cast(pa.int64()),
                    pa.array(counter.counts(texts), pa.int64()),
                ],
                names=["id", "n_bytes", "n_tokens"],
            )

    return run


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: `id_col`, n_bytes (UTF-8), n_tokens (long)."""
    with open(tokenizer_path, encoding="utf-8") as f:  # a file of the driver's own installation
        source = docs.sparkSession.sparkContext.broadcast(f.read())
    columns = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = columns.schema["id"].dataType.simpleString()
    counted = columns.mapInArrow(_count(source), f"id {kind}, n_bytes long, n_tokens long")
    return counted.withColumnRenamed("id", id_col)
