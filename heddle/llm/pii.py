"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, digits, URL schemes and
identifier cues. At each anchor a deterministic local parser expands to the span's boundaries and
checks it (Luhn, octets, digit counts, mod 97). No pattern is searched for over the whole text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField

from heddle.llm.common import append_columns

#: Kinds of spans, in their order; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "login", "iban", "account", "ssn")
BASE = 4
CUES = {"iban": ("iban", "IBAN", "Iban"), "account": ("account", "Account", "ACCOUNT", "acct", "Acct", "ACCT"), "ssn": ("ssn", "SSN", "social security", "Social Security")}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
# local parsers: each is matched at one position only
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_RUN = re.compile("[0-9]+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOGIN = re.compile(r"[^\s:@/?#]+:[^\s:@/?#]+@[A-Za-z0-9.-]+")
_IBAN = re.compile(r"[\s:#.]{0,4}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?)(?![A-Za-z0-9])")
_ACCOUNT = re.compile(r"(?: ?(?:no|No|NO|number|Number|nr|Nr)\b\.?)?[ :#]{0,3}([0-9]{6,17})(?![0-9])")
_SSN = re.compile(r"[ :#]{0,3}([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9-])")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _digits(s: str) -> str:
    return re.sub("[^0-9]", "", s)


def scanner() -> Callable[[str | None], list[tuple[int, int, int]]]:
    """A function from a text to its spans (kind's place in KINDS, start, end), ordered, in code points."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for c in "0123456789":
        automaton.add_word(c, ("digit", 1))
    automaton.add_word("@", ("at", 1))
    automaton.add_word("+", ("plus", 1))
    automaton.add_word("://", ("scheme", 3))
    for kind, words in CUES.items():
        for w in words:
            automaton.add_word(w, (kind, len(w)))
    automaton.make_automaton()

    def scan(text: str | None) -> list[tuple[int, int, int]]:
        if not text:
            return []
        out = []
        # where the next match of the kind may start; an address that doesn't begin at one digit of a run begins at none
        email = ip = card = phone = scheme = 0
        for last, (what, size) in automaton.iter(text):
            at = last - size + 1
            if what == "digit":
                if at >= card:
                    if m := _CARD.match(text, at):
                        card = m.end()
                        if 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                            out.append((2, at, card))
                if at >= ip:
                    ip = _RUN.match(text, at).end()
                    if m := _IP.match(text, at) if text.startswith(".", ip) else None:
                        ip = m.end()
                        if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
                            out.append((1, at, ip))
            elif what == "at":
                start = at
                while start > email and text[start - 1] in _LOCAL:
                    start -= 1
                if start < at and (m := _DOMAIN.match(text, at + 1)):
                    email = m.end()
                    out.append((0, start, email))
            elif what == "plus":
                if at >= phone and (m := _PHONE.match(text, at)):
                    phone = m.end()
                    if 8 <= len(_digits(m[0])) <= 15:
                        out.append((3, at, phone))
            elif what == "scheme":
                start = at
                while start > scheme and text[start - 1] in _SCHEME:
                    start -= 1
                scheme = last
                if start < at and (m := _LOGIN.match(text, last + 1)):
                    out.append((4, start, m.end()))
            elif what == "iban":
                if (m := _IBAN.match(text, last + 1)) and _mod97(m[1]):
                    out.append((5, m.start(1), m.end(1)))
            elif what == "account":
                if m := _ACCOUNT.match(text, last + 1):
                    out.append((6, m.start(1), m.end(1)))
            elif m := _SSN.match(text, last + 1):
                out.append((7, m.start(1), m.end(1)))
        return sorted(set(out))

    return scan


def joined(spans: list[tuple[int, int, int]], kinds: tuple[str, ...] = KINDS) -> str:
    return ",".join(f"{kinds[k]}:{a}:{b}" for k, a, b in spans)


DIGEST = [*(StructField(c, LongType()) for c in ("n_email", "n_ip", "n_card", "n_phone")), StructField("base_sha256", StringType()), StructField("spans", StringType())]


def _digest_maker():
    scan = scanner()

    def rows(texts):
        out = []
        for t in texts:
            spans = scan(t)
            base = [x for x in spans if x[0] < BASE]
            out.append((*(sum(x[0] == k for x in base) for k in range(BASE)), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
        return zip(*out, strict=True) if out else [[]] * len(DIGEST)

    return rows


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a row of `docs`: id, base counts, base digest, all spans.

    Null and empty texts have no spans; repeated rows give repeated rows; an empty table gives an
    empty result; other columns are ignored. Cost is linear in the text, whatever its length.
    """
    return append_columns(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__text")), ["__text"], DIGEST, _digest_maker).drop("__text")


def masked(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
    """The text with each span, or each run of overlapping spans, replaced by its first kind in angle brackets."""
    if not text or not spans:
        return text
    out, at, end = [], 0, -1
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2], s[0])):
        if a >= end:
            out += [text[at:a], f"<{KINDS[k].upper()}>"]
            end = b
        end = max(end, b)
        at = end
    return "".join(out) + text[at:]


def _mask_maker():
    scan = scanner()
    return lambda texts: [[masked(t, scan(t)) for t in texts]]


def mask_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with the spans in its texts masked; null texts stay null, other columns stay as they are."""
    return append_columns(docs, [text_col], [StructField(text_col, StringType())], _mask_maker).select(*docs.columns)


def op7_pii_anchors(spark, sf_dir):
    return pii_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
