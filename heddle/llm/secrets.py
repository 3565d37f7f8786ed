"""Secrets in texts: fixed patterns, and a guess cost for values in a credential context.

The guess cost is the least number of guesses, in log10, over all ways to part a value into words,
dates, repeats, keyboard walks and brute-force spans (dynamic programming over positions). Values
that a cheap segmentation explains, such as "password123", are no secrets; values that cost at least
`min_cost` are reported as kind "guess".
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField

from heddle.llm.common import append_columns

KINDS = ("assign", "access", "hex", "guess")
BASE = 3
#: A vocabulary whose order ranks words; a parameter of every operator here.
VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"
MIN_COST = 10.0

_ASSIGN = re.compile(r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: Contexts of the base pattern and looser ones, whose values the guess cost judges.
_CONTEXT = re.compile(r"(?:(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api_?key|access_?key|private_?key|credentials?|auth(?:orization)?|bearer)[\"']?(?:\x20*[:=]\x20*|\x20+is\x20+)|bearer\x20+)[\"']?([!-&(-+\--:<-~]{6,})", re.IGNORECASE | re.ASCII)
_STEMS = ("pass", "pwd", "secret", "token", "key", "credential", "auth", "bearer")
_ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
_LEET = str.maketrans("4@301!5$7", "aaeoiisst")


def _neighbours() -> dict[str, str]:
    """Keys next to each key: left, right, and above or below by column."""
    near: dict[str, set[str]] = {}
    for r, row in enumerate(_ROWS):
        for i, c in enumerate(row):
            for s, j in ((r, i - 1), (r, i + 1), (r - 1, i), (r - 1, i + 1), (r + 1, i), (r + 1, i - 1)):
                if 0 <= s < len(_ROWS) and 0 <= j < len(_ROWS[s]):
                    near.setdefault(c, set()).add(_ROWS[s][j])
    return {k: "".join(sorted(v)) for k, v in near.items()}


_NEAR = _neighbours()
_DATE = re.compile(r"(?:(?:19|20)[0-9]{2}([-/.]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12][0-9]|3[01])|(?:0[1-9]|[12][0-9]|3[01])([-/.]?)(?:0[1-9]|1[0-2])\2(?:19|20)[0-9]{2}|(?:19|20)[0-9]{2})$")
#: Lengths that _DATE can match.
_DATE_SIZES = (4, 8, 10)
#: The shortest repeat, step or walk.
LEAST_RUN = 3


def _lower(value: str) -> str:
    """In small letters, character by character."""
    return value.lower() if value.isascii() else "".join(x if len(x := c.lower()) == 1 else c for c in value)


class Words:
    """Ranked words, found in a value by one automaton."""

    def __init__(self, ranks: dict[str, int]):
        import ahocorasick

        self.longest = max(map(len, ranks), default=0)
        self.automaton = ahocorasick.Automaton()
        for word, rank in ranks.items():
            self.automaton.add_word(word, (len(word), math.log10(rank + 1)))
        if ranks:
            self.automaton.make_automaton()

    def ending(self, value: str) -> dict[int, list[tuple[int, float]]]:
        """End -> (start, cost) of the words there: as they stand, in capitals, and with digits and signs read as letters."""
        found: dict[int, list[tuple[int, float]]] = {}
        if not self.longest:
            return found
        low = _lower(value)
        plain = low.translate(_LEET)
        for text in {low, plain}:
            for last, (size, cost) in self.automaton.iter(text):
                j, i = last + 1 - size, last + 1
                lower, word = low[j:i], text[j:i]
                cost += 0.0 if value[j:i] == lower else 0.3 if value[j + 1 : i] == lower[1:] else 1.0
                found.setdefault(i, []).append((j, cost if lower == word else cost + 0.6))
        return found


class _Run:
    """Places where a repeat, step or walk that goes on may have started, none of which is worse than another for good.

    A run from j to i costs best[j] + first + log10(i - j) + each * (i - j). A later place is worse for
    good if it is so at its shortest run; an earlier one if the later costs no more.
    """

    __slots__ = ("each", "first", "places", "start")

    def __init__(self, first: float, each: float = 0.0):
        self.first, self.each, self.places, self.start = first, each, [], 0

    def restart(self, at: int) -> None:
        self.start = at
        if self.places:
            self.places = []

    def least(self, i: int, best: list[float]) -> float:
        """The least cost of a run that ends at i, after the place that is now long enough has come in."""
        if i - self.start < LEAST_RUN:
            return math.inf
        j = i - LEAST_RUN
        cost = best[j]
        if not any(c + self.each * (j - p) + math.log10(1 + (j - p) / LEAST_RUN) <= cost for p, c in self.places):
            self.places = [(p, c) for p, c in self.places if c + self.each * (j - p) < cost]
            self.places.append((j, cost))
        return min(c + self.first + math.log10(i - p) + self.each * (i - p) for p, c in self.places)


def _brute(c: str) -> float:
    return 1.0 if c.isdigit() else math.log10(26) if c.isalpha() and c.isascii() else math.log10(33)


def guess_cost(value: str, words: Words, enough: float = math.inf) -> float:
    """log10 of the guesses that the cheapest segmentation needs; `enough` once it is sure to be at least that.

    best[i] is the least cost of the first i characters over all their segmentations: brute-force
    characters, words, dates, and runs of any length: repeats of one character, steps (neighbours in
    code order, one way) and walks over neighbouring keys. Once no place that a segment can still start
    from costs less than `enough`, neither does the end.
    """
    n = len(value)
    best = [0.0] + [math.inf] * n
    low, ending = _lower(value), words.ending(value)
    reach = max(words.longest, *_DATE_SIZES)
    repeat, step, walk, way = _Run(_brute(value[0]) if value else 0.0), _Run(1.3), _Run(math.log10(47), 0.3), 0
    cheap = 0  # the last place that costs less than `enough`
    for i in range(1, n + 1):
        c = value[i - 1]
        cost = best[i - 1] + _brute(c)
        if i > 1:
            by = ord(c) - ord(value[i - 2])
            if by:
                repeat.restart(i - 1)
                repeat.first = _brute(c)
            if abs(by) != 1:
                step.restart(i - 1)
            elif by != way:
                step.restart(i - 2)
            way = by
            if low[i - 2] not in _NEAR.get(low[i - 1], ""):
                walk.restart(i - 1)
        cost = min(cost, repeat.least(i, best), step.least(i, best), walk.least(i, best))
        for j, word in ending.get(i, ()):
            cost = min(cost, best[j] + word)
        for size in _DATE_SIZES:
            if i >= size and value[i - size].isdigit() and _DATE.match(value[i - size : i]):
                cost = min(cost, best[i - size] + (2.1 if size == 4 else 4.6))
        best[i] = cost
        if cost < enough:
            cheap = i
        elif i - cheap >= reach and all(x >= enough for run in (repeat, step, walk) for _, x in run.places):
            return enough
    return best[n]


def load_ranks(path: str = VOCABULARY) -> dict[str, int]:
    """Word -> rank, from a tokenizer file's vocabulary: entries that are whole words of 3 or more letters, in id order."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    words = [w[:-4] for w, _ in sorted(vocab.items(), key=lambda x: x[1]) if w.endswith("</w>")]
    ranks: dict[str, int] = {}
    for w in ["password", "admin", "secret", "token", "letmein", "welcome", "changeme", "example", "default", "test", *words]:
        if len(w) >= 3 and w.isascii() and w.isalpha():
            ranks.setdefault(w, len(ranks))
    return ranks


def scanner(words: Words, min_cost: float = MIN_COST) -> Callable[[str | None], list[tuple[int, int, int]]]:
    """A function from a text to spans (start, kind's place in KINDS, end), ordered, in code points."""
    def scan(text: str | None) -> list[tuple[int, int, int]]:
        if not text:
            return []
        out = [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
        if "AKIA" in text:
            out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
        low = text.lower()
        if any(s in low for s in _STEMS) and ("=" in text or ":" in text or " is " in low or "bearer " in low):
            out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
            at = 0
            while m := _CONTEXT.search(text, at):
                costly = guess_cost(m[1], words, min_cost) >= min_cost
                if costly:
                    out.append((m.start(1), 3, m.end(1)))
                at = m.end(1) if costly else m.start(1)  # a cheap value may be the context of the next
        return sorted(out)

    return scan


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


DIGEST = [*(StructField(c, LongType()) for c in ("n_assign", "n_access", "n_hex")), StructField("base_sha256", StringType()), StructField("spans", StringType())]


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, min_cost: float = MIN_COST) -> DataFrame:
    """One row a row of `docs`: id, base counts, base digest, all spans.

    Null and empty texts have no spans; repeated rows give repeated rows; an empty table gives an
    empty result; other columns are ignored. The vocabulary is read on the driver and broadcast: its
    size is the file's, whatever the corpus.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(load_ranks(vocabulary))

    def make():
        scan = scanner(Words(ranks.value), min_cost)

        def rows(texts):
            out = []
            for t in texts:
                spans = scan(t)
                base = [x for x in spans if x[1] < BASE]
                out.append((*(sum(x[1] == k for x in base) for k in range(BASE)), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
            return zip(*out, strict=True) if out else [[]] * len(DIGEST)

        return rows

    return append_columns(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__text")), ["__text"], DIGEST, make).drop("__text")


def op10_secret_scan(spark, sf_dir):
    return secret_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
