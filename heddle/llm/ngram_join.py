"""N-gram Jaccard self-join by prefix trees.

Documents are sets of word n-grams in one global order, frequent n-grams last. Two sets that are
similar enough share an n-gram among the first few of each (the prefix), so documents meet in lists,
one for each n-gram of their prefixes. A list offers a hub: its other members are compared with the
hub first, and once linked documents are contracted, only members of different components are paired.
Pairs are verified in groups that share one document: the others' sets are stored in a prefix tree,
most frequent n-gram first, and one walk compares the document with all of them, sharing the overlap
of common beginnings and leaving a subtree as soon as what remains of it can't reach the bound.
Equal sets are one entry from the start.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import MOST_BROADCAST, bounded_batches, bounded_bytes, components, discard, materialise, word_hashes
from heddle.llm.common import ODD as _ODD
from heddle.llm.common import mix_bits as _mix

WORDS = 5
#: The least Jaccard similarity of a link, in hundredths.
PERCENT = 75
#: An n-gram counts as frequent if one task has it in so many of the texts that it counts together; so many of the most
#: frequent are told to all tasks (8 bytes each). Both only order n-grams: links don't depend on them.
LOCAL_MIN, MAX_FREQUENT = 2, 250_000
#: Prefix n-grams of a bucket, members of a list's row, n-grams of a verified group.
BUCKET_GRAMS, LIST_ROWS, GROUP_GRAMS = 500_000, 4_096, 250_000
#: N-grams that a task counts together, and log2 of the members up to which a frequent n-gram's list stays in one piece.
COUNTED_GRAMS, WHOLE_LIST = 1_500_000, 17
#: Bits of the filter that is broadcast to find the documents of candidate pairs: 8 MB.
FILTER_BITS = 1 << 26

_LOW = np.uint64((1 << 58) - 1)


def _sets(data: np.ndarray, ends: np.ndarray) -> Iterator[np.ndarray]:
    """Each text's shingles; `data` and `ends` as for word_hashes."""
    h, at = word_hashes(data, ends)
    grams = np.zeros(max(0, len(h) - WORDS + 1), np.uint64)
    for i in range(WORDS):
        grams += h[i : i + len(grams)] * _ODD[i]
    grams = _mix(grams) & _LOW
    texts = list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
    for lo, hi in texts:
        if hi - lo > WORDS:
            grams[lo : hi - WORDS + 1].sort()
    new = np.ones(len(grams), bool)
    np.not_equal(grams[1:], grams[:-1], out=new[1:])
    new[at[:-1][at[:-1] < len(new)]] = True
    for lo, hi in texts:
        if hi - lo >= WORDS:
            yield grams[lo : hi - WORDS + 1][new[lo : hi - WORDS + 1]]
        elif hi == lo:
            yield np.zeros(0, np.uint64)
        else:
            total = np.array([hi - lo], np.uint64)
            for i in range(hi - lo):
                total = total * _ODD[1] + _mix(h[lo + i : lo + i + 1] ^ _ODD[i])
            yield _mix(total) & _LOW


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct n-grams of a text, each as 58 bits of hash; of fewer words, the whole sequence as one."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    return next(_sets(data, np.array([0, len(data)])))


def _shingled(column: pa.Array) -> Iterator[np.ndarray]:
    """The shingles of each of a column's texts, hashed some KB of texts at a time."""
    column = column.fill_null("") if column.null_count else column
    _, ends, data = column.buffers()
    if not len(column):
        return
    ends = np.frombuffer(ends, np.int64 if pa.types.is_large_string(column.type) else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data or b"", np.uint8)
    for lo, hi in bounded_bytes(ends):
        yield from _sets(data[ends[lo] : ends[hi]], ends[lo : hi + 1] - ends[lo])


def needed(n: int, m: int, percent: int = PERCENT) -> int:
    """The least overlap with which sets of n and m are linked: 100 * o >= percent * (n + m - o)."""
    return -(-percent * (n + m) // (100 + percent))


def prefix_size(n: int, percent: int = PERCENT) -> int:
    """N-grams, of a set of n, of which a linked set shares one if it shares its own prefix's order."""
    return n - -(-percent * n // 100) + 1


class PrefixTree:
    """Sets as paths of a compressed trie, each a descending array; nodes know the least and largest set below."""

    __slots__ = ("children", "ends", "grams", "high", "low")

    def __init__(self, grams: np.ndarray):
        self.grams, self.children, self.ends = grams, [], []
        self.low, self.high = 1 << 62, 0

    @classmethod
    def build(cls, sets: list[np.ndarray]) -> PrefixTree:
        """Of sets as ascending arrays; a walk returns their places in the list."""
        paths = [s[::-1] for s in sets]
        order = sorted(range(len(paths)), key=lambda i: paths[i].astype(">u8").tobytes())
        root = cls(np.zeros(0, np.uint64))
        stack = [(root, 0)]  # nodes of the current path, with the depth at which each ends
        before = root.grams
        for i in order:
            path = paths[i]
            shared = min(len(before), len(path))
            unlike = np.flatnonzero(before[:shared] != path[:shared])
            shared = int(unlike[0]) if len(unlike) else shared
            last = None
            while stack[-1][1] > shared:
                last = stack.pop()
            if stack[-1][1] < shared:  # the edge that led on is cut in two
                parent, depth = stack[-1]
                tail = last[0]
                upper = cls(tail.grams[: shared - depth])
                tail.grams = tail.grams[shared - depth :]
                parent.children[-1] = upper
                upper.children.append(tail)
                stack.append((upper, shared))
            if len(path) > shared:
                leaf = cls(path[shared:])
                stack[-1][0].children.append(leaf)
                stack.append((leaf, len(path)))
            stack[-1][0].ends.append((i, len(path)))
            before = path
        root._measure()
        return root

    def _measure(self) -> None:
        todo, done = [self], []
        while todo:
            node = todo.pop()
            done.append(node)
            todo += node.children
        for node in reversed(done):
            sizes = [n for _, n in node.ends]
            node.low = min([*sizes, *(c.low for c in node.children)], default=1 << 62)
            node.high = max([*sizes, *(c.high for c in node.children)], default=0)

    def similar(self, probe: np.ndarray, percent: int = PERCENT) -> list[int]:
        """Places of the sets linked to `probe`, an ascending array."""
        out, todo, n = [], [(c, 0, 0) for c in self.children], len(probe)
        while todo:
            node, depth, overlap = todo.pop()
            at = np.minimum(np.searchsorted(probe, node.grams), n - 1)
            overlap += int((probe[at] == node.grams).sum())
            depth += len(node.grams)
            # what remains: of the probe the grams below the last one, of the sets at most `high` in all
            left = int(np.searchsorted(probe, node.grams[-1]))
            for i, size in node.ends:
                if overlap >= needed(n, size, percent):
                    out.append(i)
            for c in node.children:
                size = min(c.high, max(c.low, depth + left))  # the size below with the most room
                if overlap + min(left, size - depth) >= needed(n, size, percent):
                    todo.append((c, depth, overlap))
        return out


def _sid(grams: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit halves of a set's 128-bit hash."""
    from xxhash import xxh3_128_intdigest

    x = xxh3_128_intdigest(grams.tobytes())
    return ((x & (1 << 64) - 1) ^ 1 << 63) - (1 << 63), (x >> 64 ^ 1 << 63) - (1 << 63)


PROFILE = "doc_id long, mark long, n long, sid long, hi long, gram long"


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document (doc_id, mark, n, sid, hi), and for each n-gram that is frequent in the task (gram, n)."""
    names, seen, held = [x.split()[0] for x in PROFILE.split(", ")], {}, 0

    def rows(*columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    def counted() -> pa.RecordBatch:
        grams, counts = np.unique(np.concatenate(list(seen.values())), return_counts=True)
        frequent = counts >= LOCAL_MIN
        none = pa.nulls(int(frequent.sum()), pa.int64())
        return rows(none, none, counts[frequent], none, none, grams[frequent].astype(np.int64))

    for b in batches:
        ns, sids, his = [], [], []
        for s in _shingled(b.column(2)):
            sid, hi = _sid(s)
            ns.append(len(s))
            sids.append(sid if len(s) else None)
            his.append(hi if len(s) else None)
            if len(s) and sid not in seen:
                seen[sid] = s
                held += len(s)
                if held >= COUNTED_GRAMS:
                    yield counted()
                    seen, held = {}, 0
        yield rows(b.column(0), b.column(1), ns, sids, his, pa.nulls(b.num_rows, pa.int64()))
    if seen:
        yield counted()


def frequent_order(profile: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The frequent n-grams, ascending, and each one's class (log2 of its count): at most MAX_FREQUENT of them.

    A histogram of the counts gives the least count that so many reach; no sort of all, and the
    driver gets no more than those.
    """
    counted = profile.where("gram is not null").groupBy("gram").agg(F.sum("n").alias("n"))
    bars = counted.groupBy(F.least("n", F.lit(10_000)).alias("n")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("n")).collect()
    least, total = None, 0
    for bar in bars:
        total += bar.c
        if total > MAX_FREQUENT:
            break
        least = bar.n
    found = (counted.where(F.col("n") >= least) if least is not None else counted.limit(0)).toArrow()
    grams, counts = found["gram"].to_numpy().astype(np.uint64), found["n"].to_numpy()
    order = np.argsort(grams)
    classes = np.minimum(63, 1 + np.log2(np.maximum(1, counts)).astype(np.int64))
    return grams[order], classes[order].astype(np.uint64)


def ordering(frequent: tuple[np.ndarray, np.ndarray]) -> Callable[[np.ndarray], np.ndarray]:
    """A function that puts n-grams in the global order: the class of frequent ones leads each number."""
    known, classes = frequent
    maybe = np.zeros(1 << 20, bool)  # by an n-gram's highest 20 bits: most that aren't frequent are told by it
    maybe[(known >> np.uint64(38)).astype(np.int64)] = True

    def ordered(grams: np.ndarray) -> np.ndarray:
        hit = np.flatnonzero(maybe[(grams >> np.uint64(38)).astype(np.int64)])
        if not len(hit):
            return np.sort(grams)
        found = grams[hit]
        at = np.minimum(np.searchsorted(known, found), len(known) - 1)
        same = known[at] == found
        grams = grams.copy()
        grams[hit[same]] |= classes[at[same]] << np.uint64(58)
        return np.sort(grams)

    return ordered


def _named(grams: np.ndarray, clashing: frozenset) -> int:
    """A set's 64-bit name: one half of its hash, or the other where two sets share the first."""
    lo, hi = _sid(grams)
    return hi if lo in clashing else lo


def _pieces(grams: np.ndarray, sids: np.ndarray) -> np.ndarray:
    """Which piece of its n-gram's list each posting belongs to: a very frequent one's list is parted by set, whose class leads the number."""
    classes = (grams >> np.uint64(58)).astype(np.int64)
    parts = np.int64(1) << np.maximum(0, classes - WHOLE_LIST)
    return (_mix(sids.astype(np.uint64)) >> np.uint64(1)).astype(np.int64) % parts


def _planes(numbers: np.ndarray) -> bytes:
    """Numbers as all their first bytes, then all their second ones, and so on: bytes that are mostly 0 stand together and cost a shuffle little."""
    return np.ascontiguousarray(numbers).view(np.uint8).reshape(-1, numbers.dtype.itemsize).T.tobytes()


def _from_planes(data: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).ravel()


def _packed_set(grams: np.ndarray) -> bytes:
    """An ascending set as its differences' planes, which a shuffle compresses better than the numbers."""
    return _planes(np.diff(grams, prepend=np.uint64(0)))


def _unpacked_set(data: bytes) -> np.ndarray:
    return np.cumsum(_from_planes(data, np.uint64), dtype=np.uint64)


def _postings(frequent, buckets: int):
    """Batches of texts to rows (bucket, sids, sizes, runs, grams): prefix n-grams, packed by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (known, clashing), seen = frequent.value, set()
        in_order = ordering(known)
        for b in batches:
            prefixes, sids, ns = [], [], []
            for s in _shingled(b.column(0)):
                sid = _named(s, clashing)
                if len(s) and sid not in seen:
                    seen.add(sid)
                    prefixes.append(in_order(s)[: prefix_size(len(s))])
                    sids.append(sid)
                    ns.append(len(s))
            if not prefixes:
                continue
            grams = np.concatenate(prefixes)
            doc = np.repeat(np.arange(len(sids)), [len(p) for p in prefixes])
            sids, ns = np.array(sids, np.int64), np.array(ns, np.int32)
            pieces = _pieces(grams, sids[doc]).astype(np.uint64)
            bucket = (_mix(grams + pieces * _ODD[2]) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            grams, doc, bucket = grams[order], doc[order], bucket[order]
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
            out = []
            for lo, hi in zip(cuts, [*cuts[1:], len(bucket)], strict=True):
                d = doc[lo:hi]
                first = np.flatnonzero(np.diff(d, prepend=-1))
                runs = np.diff([*first, len(d)]).astype(np.int32)
                out.append((int(bucket[lo]), sids[d[first]].tobytes(), _planes(ns[d[first]]), _planes(runs), _planes(grams[lo:hi])))
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), (pa.int32(), *[pa.binary()] * 4), strict=True)], names=["bucket", "sids", "sizes", "runs", "grams"])

    return run


LISTS = "sig long, sig2 long, part long, split boolean, grams int, hub long, hub_n int, sids array<long>, sizes array<int>"


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed postings, ordered by bucket, to each bucket's lists; one bucket is held at a time."""
    held, bucket = [], None
    for b in batches:
        for row in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
            if row[0] != bucket and held:
                yield from _bucket_lists(held)
                held = []
            bucket = row[0]
            held.append(row[1:])
    if held:
        yield from _bucket_lists(held)


def _bucket_lists(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    """A bucket's packed postings to its lists of two or more sets (LISTS), long ones in several rows.

    A member with which no other of its list can be linked, by their sizes alone, is left out: lists of
    chance grow faster than the texts, and most of their pairs are of unlike sizes. Lists of the same
    members are one, with their number of n-grams, named by 128 bits of the members' hashes. The pieces
    of a list that is parted share the n-gram's name, keep all members, and each has a hub of its own.
    """
    sids, ns, grams = [], [], []
    for s, n, r, g in rows:
        runs = _from_planes(r, np.int32)
        sids.append(np.repeat(np.frombuffer(s, np.int64), runs))
        ns.append(np.repeat(_from_planes(n, np.int32), runs))
        grams.append(_from_planes(g, np.uint64))
    sids, ns, grams = np.concatenate(sids), np.concatenate(ns), np.concatenate(grams)
    order = np.lexsort((sids, ns, _pieces(grams, sids), grams))
    sids, ns, grams = sids[order], ns[order], grams[order]
    pieces = _pieces(grams, sids)
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (sids[1:] != sids[:-1])
    sids, ns, grams, pieces = sids[new], ns[new], grams[new], pieces[new]
    # members are ordered by size, so the next one or the one before is the nearest in size
    near = (grams[1:] == grams[:-1]) & (pieces[1:] == pieces[:-1]) & (100 * ns[:-1].astype(np.int64) >= PERCENT * ns[1:].astype(np.int64))
    keep = (grams >> np.uint64(58)).astype(np.int64) > WHOLE_LIST
    keep[1:] |= near
    keep[:-1] |= near
    sids, ns, grams, pieces = sids[keep], ns[keep], grams[keep], pieces[keep]
    if not len(grams):
        return
    starts = np.flatnonzero(np.r_[True, (grams[1:] != grams[:-1]) | (pieces[1:] != pieces[:-1])])
    sizes = np.diff([*starts, len(grams)])
    split = (grams[starts] >> np.uint64(58)).astype(np.int64) > WHOLE_LIST
    mixed = _mix(sids.astype(np.uint64))
    sums = np.stack([np.add.reduceat(mixed, starts), np.add.reduceat(_mix(mixed ^ _ODD[3]), starts)])
    many, apart = np.flatnonzero(~split), np.flatnonzero(split)
    many = many[np.lexsort((sizes[many], sums[1, many], sums[0, many]))]
    unlike = np.r_[True, (sums[:, many[1:]] != sums[:, many[:-1]]).any(axis=0) | (sizes[many[1:]] != sizes[many[:-1]])][: len(many)]
    first = np.flatnonzero(unlike)
    lists = np.r_[many[first], apart]
    n_grams = np.r_[np.diff(np.r_[first, len(many)]), np.ones(len(apart), np.int64)]
    lo, size, gram = starts[lists], sizes[lists], grams[starts[lists]]
    sig, sig2 = (np.where(split[lists], x, _mix(sums[i, lists] ^ size.astype(np.uint64))).astype(np.int64) for i, x in enumerate((_mix(gram), gram)))
    hub = lo + size // 2  # the middle by size
    parts = -(-size // LIST_ROWS)
    of = np.repeat(np.arange(len(lists)), parts)
    part = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
    at = lo[of] + part * LIST_ROWS
    held = np.minimum(LIST_ROWS, lo[of] + size[of] - at)
    ends, done = np.cumsum(held), 0
    while done < len(of):
        to = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + (1 << 18), "right")))
        o, offsets = of[done:to], np.r_[0, np.cumsum(held[done:to])]
        members = np.arange(offsets[-1]) + np.repeat(at[done:to] - offsets[:-1], held[done:to])
        columns = [sig[o], sig2[o], (pieces[lo[o]] << 32) + part[done:to], split[lists][o], n_grams[o].astype(np.int32), sids[hub[o]], ns[hub[o]]]
        packed = [pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(x[members])) for x in (sids, ns)]
        yield pa.RecordBatch.from_arrays([*map(pa.array, columns), *packed], names=[x.split()[0] for x in LISTS.split(", ")])
        done = to


def _linked(probe: int, rows: list[tuple[int, bytes]]) -> list[int]:
    """Which of a group's sets (sid, set), the probe's among them, are linked to the probe."""
    own = next((s for sid, s in rows if sid == probe), None)
    others = [(sid, _unpacked_set(s)) for sid, s in rows if sid != probe]
    if own is None or not others:
        return []
    return [others[i][0] for i in PrefixTree.build([s for _, s in others]).similar(_unpacked_set(own))]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (probe, part, sid, set), ordered by probe and part, to the pairs (a, b) that are linked; one group is held at a time."""
    held, key = [], None

    def pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    for b in batches:
        found = []
        for probe, part, sid, data in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            if (probe, part) != key:
                if held:
                    found += [(key[0], x) for x in _linked(key[0], held)]
                key, held = (probe, part), []
            held.append((sid, data))
        yield pairs(found)
    if held:
        yield pairs([(key[0], x) for x in _linked(key[0], held)])


def _filter_bits(keys: DataFrame) -> dict[int, bytes]:
    """A Bloom filter of `keys` (key: long) with one hash, as 4-KB pieces by number: FILTER_BITS bits in all, whatever the corpus."""
    h = F.pmod(F.xxhash64("key"), F.lit(FILTER_BITS))
    pieces = keys.groupBy(F.shiftright(h, 15).cast("int").alias("piece")).agg(F.bitmap_construct_agg(h.bitwiseAND(F.lit(32767).cast("long"))).alias("bits"))
    return {r.piece: bytes(r.bits) for r in pieces.collect()}


def _sets_of(known, bits):
    """Batches of (doc_id, text) to (key, sid, n, set) of the documents whose key the filter may have: doc_id, or the set's name for a null one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        (frequent, clashing), pieces = known.value, bits.value
        in_order = ordering(frequent)

        def may_have(key: int) -> bool:
            h = xxh64_intdigest(key.to_bytes(8, "little", signed=True), 42) % FILTER_BITS
            piece = pieces.get(h >> 15)
            return piece is not None and bool(piece[(h & 32767) >> 3] >> (h & 7) & 1)

        for b in batches:
            out = []
            ids = b.column(0).to_pylist()
            wanted = [i for i, doc_id in enumerate(ids) if doc_id is None or may_have(doc_id)]
            for i, s in zip(wanted, _shingled(b.column(1).take(pa.array(wanted, pa.int64()))), strict=True):
                doc_id = ids[i]
                if len(s):
                    sid = _named(s, clashing)
                    if doc_id is not None or may_have(sid):
                        out.append((sid if doc_id is None else doc_id, sid, len(s), _packed_set(in_order(s))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["key", "sid", "n", "set"])

    return run


def may_link(n1, n2, lists1, lists2, common):
    """If two sets may be linked by what their prefixes share; `lists`: list -> its grams, `common`: the lists that both are in.

    Where the prefix of one ends first, all grams that both have up to there are in lists that both
    are in; beyond it they share at most what that one has left. What each has left is known, so the
    larger of the two gives a bound without the sets.
    """
    left = lambda n: F.ceil(n * PERCENT / F.lit(100)) - 1  # noqa: E731  n less prefix_size(n)
    shared = F.aggregate(common, F.lit(0).cast("long"), lambda s, k: s + F.element_at(lists1, k))
    return (shared + F.greatest(left(n1), left(n2))) * (100 + PERCENT) >= F.lit(PERCENT) * (n1 + n2)


def lists_by_set(members: DataFrame) -> DataFrame:
    """(sid, lists): the map of each set's lists to their grams, no more than its prefix has."""
    return members.groupBy("sid").agg(F.map_from_entries(F.collect_list(F.struct("sig", "grams"))).alias("lists"))


def screened(pairs: DataFrame, members: DataFrame, sizes: DataFrame) -> DataFrame:
    """Those of `pairs` (probe, sid) that may be linked."""
    met = lists_by_set(members).join(sizes.select("sid", "n"), "sid")
    a = met.select(F.col("sid").alias("probe"), F.col("n").alias("n1"), F.col("lists").alias("l1"))
    both = pairs.join(a, "probe").join(met, "sid")
    common = F.array_intersect(F.map_keys("l1"), F.map_keys("lists"))
    return both.where(may_link(F.col("n1"), F.col("n"), F.col("l1"), F.col("lists"), common)).select("probe", "sid")


def verified(pairs: DataFrame, named: DataFrame, texts: DataFrame, known, name: str) -> DataFrame:
    """The linked ones of `pairs` (probe, sid), by prefix tree; `named`: (sid, key, n).

    Only the sets in pairs are made again, where their texts are read: a Bloom filter of a fixed size
    tells which documents those may be, and the join on key and sid drops the rest. A probe's partners
    are parted into groups of about GROUP_GRAMS n-grams by hash; the probe's own set goes to each
    group, so that no task holds a hub with all that meet it.
    """
    sized = pairs.join(named, "sid")
    parts = sized.groupBy("probe").agg(F.ceil(F.sum("n") / GROUP_GRAMS).cast("int").alias("parts"))
    members = sized.join(parts, "probe").select("probe", F.pmod(F.xxhash64("sid"), F.col("parts")).cast("int").alias("part"), "sid", "key")
    own = parts.join(named.withColumnRenamed("sid", "probe"), "probe").select("probe", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("probe").alias("sid"), "key")
    rows = materialise(members.unionByName(own), f"{name}-groups")
    bits = pairs.sparkSession.sparkContext.broadcast(_filter_bits(rows.select("key").distinct()))
    sets = texts.mapInArrow(_sets_of(known, bits), "key long, sid long, n int, set binary")
    whole = rows.join(sets.select("key", "sid", "set"), ["key", "sid"])
    groups = whole.select("probe", "part", "sid", "set").repartition("probe", "part").sortWithinPartitions("probe", "part")
    found = materialise(groups.mapInArrow(_links, "a long, b long"), name)
    discard(rows)
    return found


def _classified(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, mark, n, sid) of every row, mark a hash of its text and sid its set's name, and (sid, least, klass) of every set."""
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    profile = materialise(texts.select("doc_id", F.xxhash64("text").alias("mark"), "text").mapInArrow(_profile, PROFILE), "ngram-profile")
    rows = profile.where("gram is null").drop("gram")
    named = stored = materialise(rows.where("sid is not null").groupBy("sid", "hi").agg(F.min("doc_id").alias("least"), F.max("n").alias("n")), "ngram-named")
    # sets of one 64-bit name: n^2 / 2^65 are to be expected, so none, or at 10^11 sets a few hundred
    clashing = frozenset(r.sid for r in named.groupBy("sid").agg(F.count(F.lit(1)).alias("c")).where("c > 1").limit(MOST_BROADCAST).collect())
    if clashing:
        name = F.when(F.col("sid").isin(*clashing), F.col("hi")).otherwise(F.col("sid"))
        rows, named = rows.withColumn("sid", name), named.withColumn("sid", name)
        if not named.groupBy("sid").agg(F.count(F.lit(1)).alias("c")).where("c > 1").isEmpty():
            raise RuntimeError("two sets have one name in both halves of their hash")
    rows, named = rows.drop("hi"), named.drop("hi")
    known = spark.sparkContext.broadcast((frequent_order(profile), clashing))
    total = named.agg(F.sum("n")).first()[0] or 0
    keys = named.select("sid", F.coalesce("least", "sid").alias("key"), "n")
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total * (100 - PERCENT) // 100 // BUCKET_GRAMS)
    packed = texts.select("text").mapInArrow(_postings(known, buckets), "bucket int, sids binary, sizes binary, runs binary, grams binary")
    lists = packed.repartitionById(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_lists, LISTS)
    same = [F.first(c).alias(c) for c in ("split", "hub", "hub_n", "sids", "sizes")]
    lists = materialise(lists.groupBy("sig", "sig2", "part").agg(F.sum("grams").alias("grams"), *same), "ngram-lists")
    members = lists.select("sig", "grams", "hub", "hub_n", F.explode(F.arrays_zip("sids", "sizes")).alias("x")).select("sig", "grams", "hub", "hub_n", F.col("x.sids").alias("sid"), F.col("x.sizes").alias("n"))

    fits = lambda n, m: F.lit(100) * F.least(n, m) >= F.lit(PERCENT) * F.greatest(n, m)
    # the pieces of a parted list are joined by their hubs: the first piece's meets the others
    hubs = lists.where("split").select("sig", "grams", F.col("hub").alias("sid"), F.col("hub_n").alias("n"), "part")
    main = hubs.groupBy("sig").agg(F.min_by(F.struct("sid", "n"), "part").alias("m")).select("sig", F.col("m.sid").alias("hub"), F.col("m.n").alias("hub_n"))
    tries = members.select("hub", "hub_n", "sid", "n").unionByName(hubs.join(main, "sig").select("hub", "hub_n", "sid", "n"))
    tried = materialise(tries.where((F.col("sid") != F.col("hub")) & fits(F.col("n"), F.col("hub_n"))).select(F.col("hub").alias("probe"), "sid").distinct(), "ngram-tried")
    hopeful = materialise(screened(tried, members, keys), "ngram-hopeful")
    edges = verified(hopeful, keys, texts, known, "ngram-hub-links")
    discard(hopeful)
    klass = components(edges, "ngram-hubs")
    labelled = members.select("sig", "grams", "sid", "n").join(klass.withColumnsRenamed({"node": "sid", "component": "klass"}), "sid", "left").withColumn("klass", F.coalesce("klass", "sid"))
    labelled = materialise(labelled, "ngram-labelled")
    discard(lists)
    # of each list that has members of several components, those outside the largest one are paired with all others
    sizes = labelled.groupBy("sig", "klass").agg(F.count(F.lit(1)).alias("c"))
    main = sizes.groupBy("sig").agg(F.max_by("klass", F.struct("c", "klass")).alias("main"), F.count(F.lit(1)).alias("klasses"), F.sum("c").alias("members")).where("klasses > 1").select("sig", "main", "members")
    open_ = materialise(labelled.join(main, "sig").withColumn("aside", F.col("klass") != F.col("main")).drop("main"), "ngram-open")
    discard(labelled)
    # a list of two has its only pair tried: it tells what sets share, but has no pair to give
    opened = open_.where("members > 2").drop("members").join(lists_by_set(open_), "sid")
    other = opened.select("sig", *[F.col(c).alias(f"{c}_2") for c in ("sid", "n", "klass", "aside", "lists")])
    # each pair in the first list that both are in
    n1, n2 = F.col("n"), F.col("n_2")
    common = F.array_intersect(F.map_keys("lists"), F.map_keys("lists_2"))
    apart = (F.col("klass") != F.col("klass_2")) & (~F.col("aside_2") | (F.col("sid") < F.col("sid_2"))) & fits(n1, n2)
    cross = opened.where("aside").join(other, "sig").where(apart & (F.array_min(common) == F.col("sig")) & may_link(n1, n2, F.col("lists"), F.col("lists_2"), common))
    pairs = cross.select(F.col("sid").alias("probe"), F.col("sid_2").alias("sid"))
    done = tried.select("probe", "sid").union(tried.select(F.col("sid").alias("probe"), F.col("probe").alias("sid")))
    pairs = materialise(pairs.join(done, ["probe", "sid"], "left_anti"), "ngram-cross")
    for table in (open_, tried):
        discard(table)
    more = verified(pairs, keys, texts, known, "ngram-cross-links")
    discard(pairs)
    klass = components(edges.unionByName(more), "ngram")
    sets = named.select("sid", "least").join(klass, F.col("sid") == F.col("node"), "left")
    sets = materialise(sets.select("sid", "least", F.coalesce("component", "sid").alias("klass")), "ngram-classes")
    for table in (stored, edges, more):
        discard(table)
    return rows, sets


def ngram_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a row of `docs`: doc_id, n_shingles, component_id (the least doc_id reachable by links).

    Null, empty and blank texts have an empty set and are their own component. Repeated rows, and
    texts with equal sets, share a component; a null id can't name one. Very long texts are whole
    sets. An empty table gives an empty result; other columns are ignored. Sets are compared by 58 bits
    of hash for each n-gram and named by a 128-bit hash.
    """
    rows, sets = _classified(docs, id_col, text_col)
    least = sets.groupBy(F.col("klass").alias("__k")).agg(F.min("least").alias("component_id"))
    named = sets.join(least, F.col("klass") == F.col("__k")).select(F.col("sid").alias("__sid"), "component_id")
    out = rows.join(named, F.col("sid") == F.col("__sid"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, with their columns: one of each group of near copies, and all without words.

    The row that stays has the group's least id; a null id comes last, and of rows that share an id the
    set's name and then the text's hash decide. Rows equal in id and text are one. A row whose text is
    null, empty or blank is in no group; an empty table stays empty; columns may have any names.
    """
    rows, sets = _classified(docs, id_col, text_col)
    told = rows.where("sid is not null").groupBy("doc_id", "mark", "sid").agg(F.count(F.lit(1)).alias("times"))
    told = told.join(sets.select(F.col("sid").alias("__s"), "klass"), F.col("sid") == F.col("__s"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("sid"), F.col("mark"), F.col("times"))
    chosen = told.groupBy("klass").agg(F.min(order).alias("r")).select(F.col("r.doc_id").alias("__id"), F.col("r.mark").alias("__mark"), F.col("r.times").alias("__times"))
    chosen = materialise(chosen, "ngram-chosen")
    names = [f"c{i}" for i in range(len(docs.columns))]
    id_, text = (F.col(names[docs.columns.index(c)]) for c in (id_col, text_col))
    blank = ~F.coalesce(text, F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    plain = docs.toDF(*names)
    kept = plain.where(~blank).join(chosen, id_.cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__mark")))
    again = kept.where("__times > 1").dropDuplicates(["__id", "__mark"])
    kept = kept.where("__times = 1").unionByName(again).select(*names).unionByName(plain.where(blank))
    return kept.toDF(*docs.columns)


SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), grams AS (
  SELECT DISTINCT doc_id, w[i:i+4] AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM words WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)
), reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), least_ids AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT words.doc_id, coalesce(n, 0) AS n_shingles, least(words.doc_id, coalesce(b, words.doc_id)) AS component_id
FROM words LEFT JOIN sizes ON sizes.doc_id = words.doc_id LEFT JOIN least_ids ON a = words.doc_id
"""


def op9_ngram_join(spark, sf_dir):
    return ngram_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
