"""SentencePiece encoding and decoding by weighted finite-state transducers.

A model file is compiled into three transducers. The normaliser reads UTF-8 by the longest key of the
model's character map, and writes its value; user symbols pass unread; then spaces are squeezed, prefixed
and written as U+2581, as the model says. The lexicon reads a piece's characters and writes its id: an
automaton finds all arcs that end at a position. Byte fallback reads one character and writes the ids of
its UTF-8 bytes, or the unknown id. A text is composed with the first, which has one path; what it writes
is composed with the other two into a lattice of its positions, whose tropical-semiring shortest path,
the least sum of weights, is the encoding.

In a unigram model an arc weighs minus its piece's score, a user symbol's little, and fallback 10 more
than any piece. In a byte-pair model the weight sits on pairs of arcs: 0 if merging the two pieces'
characters by rank gives back these two pieces, else infinite; fallback weighs 1, so that it is taken only
where no piece reads the character. Removing the last piece of such an encoding leaves the encoding of
what is before it, so each position has one path of weight 0 and the search keeps one state for it.

Texts are cut around a byte-pair model's user symbols, before runs of spaces, and such parts again where a run of letters and
digits meets other characters, if the two are neighbours in no piece: no arc, and so no path, crosses
these places. Each part's path is remembered.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField

from heddle.llm.common import append_columns

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Parts and pieces of parts whose paths a worker remembers: twice as many, the older half of which goes when the newer is full.
REMEMBERED_PARTS, REMEMBERED = 200_000, 150_000
#: Likewise pairs of pieces whose weight it remembers.
REMEMBERED_PAIRS = 300_000
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


_RUNS = re.compile(r"\w+|\W+")


class CharacterMap:
    """The compiled map of a model: a double array over UTF-8 bytes, then the values, each ended by a zero byte.

    A unit holds a label (8 bits and the highest), an offset (from bit 10 on, shifted by 8 if bit 9 is
    set) and, in bit 8, whether a value follows; the value's place is in the lower 31 bits of the unit there.
    """

    def __init__(self, compiled: bytes):
        size = int.from_bytes(compiled[:4], "little")
        self.units = np.frombuffer(compiled, "<u4", size // 4, 4).tolist()
        self.values = compiled[4 + size :]
        # characters that no key reads alone, nor with others of them: only the last of a run may begin a longer key
        plain = [c for c in range(1, 128) if self._longest(bytes([c]), 0) is None]
        inert = [c for c in plain if all(self._step(self._step(self._root(), c), x) is None for x in range(1, 128))]
        self.inert = re.compile(f"[{''.join(re.escape(chr(c)) for c in inert)}]+".encode() if inert else b"(?!)")

    def _root(self) -> int:
        return self._offset(self.units[0])

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    def _step(self, at: int | None, byte: int) -> int | None:
        """The place of the units that follow `byte`; None if there are none."""
        if at is None or (to := at ^ byte) >= len(self.units) or self.units[to] & 0x800000FF != byte:
            return None
        return to ^ self._offset(self.units[to])

    def _longest(self, data: bytes, start: int) -> tuple[int, bytes] | None:
        """(end, value) of the longest key at `start`."""
        at, best = self._root(), None
        for end in range(start, len(data)):
            to = at ^ data[end]
            if to >= len(self.units) or self.units[to] & 0x800000FF != data[end]:
                break
            at = to ^ self._offset(self.units[to])
            if self.units[to] >> 8 & 1:
                value = self.units[at] & 0x7FFFFFFF
                best = end + 1, self.values[value : self.values.index(b"\0", value)]
        return best

    def write(self, text: str) -> str:
        data, out, at = text.encode("utf-8", "replace"), [], 0
        while at < len(data):
            if m := self.inert.match(data, at):
                end = m.end() - (m.end() < len(data) and data[m.end()] > 127)
                out.append(data[at:end])
                at = end
                if at == len(data):
                    break
            if got := self._longest(data, at):
                out.append(got[1])
                at = got[0]
            else:
                end = at + 1
                while end < len(data) and data[end] & 192 == 128:
                    end += 1
                out.append(data[at:end])
                at = end
        return b"".join(out).decode()


class Normaliser:
    """A model's first transducer."""

    def __init__(self, spec, user: re.Pattern | None):
        self.prefix, self.squeeze, self.escape, self.user = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces, user
        self.map = CharacterMap(spec.precompiled_charsmap) if spec.precompiled_charsmap else None

    def write(self, text: str) -> str:
        if self.map:
            parts = self.user.split(text) if self.user else [text]  # every second one is a user symbol
            text = "".join(x if i % 2 else self.map.write(x) for i, x in enumerate(parts))
        if self.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return ""
        if self.prefix:
            text = " " + text
        text = text.replace(" ", SPACE) if self.escape else text
        return text.rstrip(SPACE if self.escape else " ") if self.squeeze else text


class Recent:
    """A bounded memory: entries that are used again move to the newer half."""

    __slots__ = ("new", "old", "size")

    def __init__(self, size: int):
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.size = size

    def find(self, key: str) -> bytes | None:
        value = self.new.get(key)
        if value is None and (value := self.old.get(key)) is not None:
            self.put(key, value)
        return value

    def put(self, key: str, value: bytes) -> None:
        if len(self.new) >= self.size:
            self.old, self.new = self.new, {}
        self.new[key] = value


class Transducer:
    """A compiled model: `encode` and `decode`."""

    def __init__(self, model: bytes):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        self.unigram = proto.trainer_spec.model_type == pb.TrainerSpec.UNIGRAM
        self.pieces = [p.piece for p in proto.pieces]
        self.kinds = [p.type for p in proto.pieces]
        self.scores = [p.score for p in proto.pieces]
        if not self.unigram and (proto.trainer_spec.model_type != pb.TrainerSpec.BPE or UNUSED in self.kinds):
            raise ValueError("only unigram models, and byte-pair models without unused pieces, are compiled here")
        if proto.trainer_spec.treat_whitespace_as_suffix or proto.denormalizer_spec.precompiled_charsmap:
            raise ValueError("models with spaces as suffixes, or with a denormaliser, aren't compiled here")
        users = sorted((p for p, k in zip(self.pieces, self.kinds, strict=True) if k == USER), key=len, reverse=True)
        self.users = re.compile(f"({'|'.join(map(re.escape, users))})") if users else None
        self.normaliser = Normaliser(proto.normalizer_spec, self.users)
        self.unknown = self.kinds.index(UNKNOWN)
        self.byte_ids = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE}
        self.id_bytes = {i: b for b, i in self.byte_ids.items()}
        self.lexicon = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k in (NORMAL, USER)}
        self.neighbours = {p[i : i + 2] for p in self.lexicon for i in range(len(p) - 1)}
        self.space_starts = not any(SPACE in p.lstrip(SPACE) for p in self.lexicon)
        normal = [s for s, k in zip(self.scores, self.kinds, strict=True) if k == NORMAL]
        low, high = min(normal, default=0.0), max([*normal, 0.0])
        #: The weights of arcs, and of fallback.
        self.weights = [0.1 - len(p.encode()) * high if k == USER else -s for p, k, s in zip(self.pieces, self.kinds, self.scores, strict=True)]
        self.fallback = 10.0 - low if self.unigram else 1.0
        self.whole = Recent(REMEMBERED_PARTS)  # parts' ids as 32-bit numbers
        self.paths = Recent(REMEMBERED)  # the same of parts cut again
        self.unlike: set[str] = set()  # parts that don't decode to themselves
        self.pairs: dict[int, bool] = {}  # by (first + 1) * pieces + second; first -1: alone
        self.arcs = ahocorasick.Automaton()  # all arcs that end at a position, longest first
        for p, i in self.lexicon.items():
            self.arcs.add_word(p, (i, len(p)))
        self.arcs.make_automaton()
        self.cut = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+") if self.space_starts else None

    def _fallback(self, c: str) -> list[int]:
        return [self.byte_ids[b] for b in c.encode("utf-8", "replace")] if self.byte_ids else [self.unknown]

    def _merged(self, left: str, right: str) -> list[str]:
        """The characters of both, merged pair by pair, best rank first and then leftmost."""
        parts = [*left, *right]
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.lexicon.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.scores[i] > best):
                    best, at = self.scores[i], k
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _pair(self, a: int, b: int) -> bool:
        """If the weight of b after a is finite."""
        key = (a + 1) * len(self.pieces) + b
        ok = self.pairs.get(key)
        if ok is None:
            if len(self.pairs) >= REMEMBERED_PAIRS:
                self.pairs.clear()
            ok = self.pairs[key] = self._merged(self.pieces[a], self.pieces[b]) == [self.pieces[a], self.pieces[b]]
        return ok

    def _path(self, part: str) -> list[int]:
        """The shortest path over one part's lattice, by positions."""
        n = len(part)
        best = [0.0] * (n + 1)
        last = [-1] + [-2] * n  # the arc that reaches a position: a piece's id; -2 byte fallback
        size = [1] * (n + 1)
        weights, known, unigram, fallback, many = self.weights, self.pairs.get, self.unigram, self.fallback, len(self.pieces)
        done = 0
        for end, (p, m) in self.arcs.iter(part):
            end += 1
            if not unigram:
                if last[end] == -2:  # finite weights of pieces are 0, so the first such arc has the least sum, and fallback none less
                    before = last[end - m]
                    ok = known((before + 1) * many + p) if before >= 0 else m == 1 or self._alone(p)
                    if ok or ok is None and self._pair(before, p):
                        last[end], size[end] = p, m
                continue
            while done < end:  # fallback arcs up to here
                done += 1
                best[done] = best[done - 1] + fallback
            w = best[end - m] + weights[p]
            if w < best[end]:
                best[end], last[end], size[end] = w, p, m
        out: list[int] = []
        i = n
        while i:
            out += [last[i]] if last[i] >= 0 else self._fallback(part[i - 1])[::-1]
            i -= size[i]
        out.reverse()
        return out

    def _alone(self, p: int) -> bool:
        """If a piece's own characters merge back to it."""
        ok = self.pairs.get(p)
        if ok is None:
            ok = self.pairs[p] = self._merged(self.pieces[p], "") == [self.pieces[p]]
        return ok

    def _cut_again(self, part: str) -> list[str]:
        first, *rest = _RUNS.findall(part)
        if not rest:
            return [part]
        out = [first]
        for run in rest:
            if out[-1][-1] + run[0] in self.neighbours:
                out[-1] += run
            else:
                out.append(run)
        return out

    def _ids_of(self, part: str) -> bytes:
        """A part's ids, from the remembered paths of its pieces."""
        if (ids := self.whole.find(part)) is not None:
            return ids
        if self.users and not self.unigram and self.users.fullmatch(part):
            return array("i", [self.lexicon[part]]).tobytes()
        out = []
        for p in self._cut_again(part):
            ids = self.paths.find(p)
            if ids is None:
                path = self._path(p)
                if self._text_of(path) != p:
                    self.unlike.add(p)
                ids = array("i", path).tobytes()
                if len(p) <= 64:
                    self.paths.put(p, ids)
            if p in self.unlike:
                self.unlike.add(part)
            out.append(ids)
        ids = b"".join(out)
        if len(part) <= 64:
            self.whole.put(part, ids)
        return ids

    def encode_bytes(self, text: str) -> tuple[bytes, bool]:
        """A text's ids as 32-bit numbers, and if they decode to the text, spaces U+2581 read as spaces."""
        normal = self.normaliser.write(text)
        if self.users and not self.unigram:  # every second part is a user symbol
            cut = [self._parts(x) if i % 2 == 0 else [x] for i, x in enumerate(self.users.split(normal))]
            parts = [x for p in cut for x in p]
        else:
            parts = self._parts(normal)
        found = list(map(self.whole.new.get, parts))
        if None in found:
            found = [self._ids_of(p) if x is None else x for p, x in zip(parts, found, strict=True)]
        same = not self.unlike or self.unlike.isdisjoint(parts)
        if self.normaliser.squeeze or self.normaliser.map or not self.normaliser.escape:
            same = same and self._plain(normal) == (text.replace(SPACE, " ") if self.normaliser.escape else text)
        ids = b"".join(found)
        if not self.byte_ids and found:  # unknown characters in a row are one
            every = np.frombuffer(ids, np.int32)
            ids = every[np.r_[True, (every[1:] != self.unknown) | (every[:-1] != self.unknown)]].tobytes()
        return ids, same

    def _parts(self, normal: str) -> list[str]:
        return self.cut.findall(normal) if self.cut else [normal] if normal else []

    def encode(self, text: str | None) -> list[int] | None:
        return None if text is None else memoryview(self.encode_bytes(text)[0]).cast("i").tolist()

    def _plain(self, text: str) -> str:
        """A normalised text without the dummy prefix and the spaces' marks."""
        text = text.replace(SPACE, " ") if self.normaliser.escape else text
        return text[1:] if self.normaliser.prefix and text.startswith(" ") else text

    def decode(self, ids: list[int] | None) -> str | None:
        """The inverse transducer: bytes' ids to characters, U+2581 to spaces, without the dummy prefix."""
        return None if ids is None else self._plain(self._text_of(ids))

    def _text_of(self, ids) -> str:
        out, raw = [], bytearray()
        for i in ids:
            if (b := self.id_bytes.get(i)) is not None:
                raw.append(b)
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            out.append(" ⁇ " if i == self.unknown else "" if self.kinds[i] == CONTROL else self.pieces[i])
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        return "".join(out)


_COMPILED: dict[int, Transducer] = {}


def compiled(model: bytes) -> Transducer:
    """The model's transducer, kept by the worker process, so that its remembered paths serve its next tasks."""
    key = hash(model)
    if key not in _COMPILED:
        _COMPILED[key] = Transducer(model)
    return _COMPILED[key]


ENCODED = [StructField("ids", ArrayType(IntegerType())), StructField("n_tokens", LongType()), StructField("round_trip", BooleanType())]


def encode_pieces(docs: DataFrame, text_col: str = "text", model: str = MODEL) -> DataFrame:
    """`docs` with ids, n_tokens and round_trip (decoding gives the text, spaces U+2581 read as spaces).

    A null text has null ids, 0 tokens and no round trip to fail; an empty one has no ids. Repeated
    rows give repeated rows; texts are encoded whole; a column named as one of the three is replaced;
    an empty table stays empty. The model file is read on the driver and broadcast: its size is the file's.
    """
    with open(model, "rb") as f:
        data = docs.sparkSession.sparkContext.broadcast(f.read())

    def make() -> Callable:
        t = compiled(data.value)

        def rows(texts):
            done = [(b"", True) if x is None else t.encode_bytes(x) for x in texts]
            sizes = np.fromiter((len(ids) // 4 for ids, _ in done), np.int64, len(done))
            values = pa.array(np.frombuffer(b"".join(ids for ids, _ in done), np.int32))
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            ids = pa.ListArray.from_arrays(offsets, values, mask=pa.array([x is None for x in texts], pa.bool_()))
            return ids, pa.array(sizes), [same for _, same in done]

        return rows

    return append_columns(docs, [text_col], ENCODED, make)


def decode_pieces(df: DataFrame, ids_col: str = "ids", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """`df` with the text of its ids.

    Null ids give a null text, no ids an empty one; repeated rows give repeated rows; a column named as
    the text is replaced; an empty table stays empty.
    """
    with open(model, "rb") as f:
        data = df.sparkSession.sparkContext.broadcast(f.read())

    def make() -> Callable:
        t = compiled(data.value)
        return lambda ids: [[t.decode(i) for i in ids]]

    return append_columns(df, [ids_col], [StructField(text_col, StringType())], make)


def op3_piece_codec(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode_pieces(docs).select("doc_id", "ids", "n_tokens", "round_trip")
