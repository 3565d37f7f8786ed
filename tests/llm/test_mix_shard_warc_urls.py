"""Mixing, sharding, archives and URL lists."""

import datetime
import gzip
import io
import itertools
import random
import time
from collections import Counter
from fractions import Fraction

import pytest

from heddle.llm import mixing, sharding, url_lists, warc

RNG = random.Random(8)


def _best_sum(lengths, counts, budget):
    sums = {0}
    for n, c in zip(lengths, counts, strict=True):
        sums = {s + n * k for s in sums for k in range(c + 1)}
    return max(s for s in sums if s <= budget)


def test_fit():
    for _ in range(300):
        lengths = RNG.sample(range(0, 40), RNG.randrange(1, 6))
        counts = [RNG.randrange(1, 5) for _ in lengths]
        total = sum(n * c for n, c in zip(lengths, counts, strict=True))
        budget = RNG.randrange(total + 3)
        took = mixing.fit(lengths, counts, budget)
        assert all(0 <= t <= c for t, c in zip(took, counts, strict=True))
        got = sum(n * t for n, t in zip(lengths, took, strict=True))
        assert got <= budget and got >= _best_sum(lengths, counts, budget) - max(lengths)
    assert sum(n * t for n, t in zip([3, 5], mixing.fit([3, 5], [100, 100], 401), strict=True)) == 401
    assert sum(n * t for n, t in zip([7, 9, 1000003], mixing.fit([7, 9, 1000003], [50000, 50000, 3], 1500000), strict=True)) > 1490000


def _targets(sizes):
    keys = sorted((k for k in sizes if k is not None)) + [k for k in sizes if k is None]
    w = {k: i % 3 + 1 for i, k in enumerate(keys)}
    total, out, free = Fraction(sum(sizes.values())), {}, set(keys)
    while free:
        left = total - sum(out.values())
        level = {k: left * w[k] / sum(w[x] for x in free) for k in free}
        over = [k for k in free if level[k] > 3 * sizes[k]]
        if not over:
            return out | level
        for k in over:
            out[k] = Fraction(3 * sizes[k])
            free.remove(k)
    return out


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP_ROWS", 7)
    rows = [(i, " ".join(["w"] * RNG.choice([0, 1, 2, 5, 9, 9, 9])), RNG.choice(["a", "b", "ü", "Z", None, "a", "a"]), "x") for i in range(400)]
    rows += [(1000, "tiny", "rare", "x"), (1001, None, "nothing", "x"), (5000, "w w", "a", "x"), (5000, "w w", "a", "x"), (None, "w w w", "b", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    got = mixing.mix_sources(df).collect()
    assert len(got) == len(rows)
    size = lambda t: len((t or "").split(" ")) if t else 0
    sizes, by_id = Counter(), {}
    for i, t, s, _ in rows:
        sizes[s] += size(t)
        by_id[i] = s
    want, taken = _targets(dict(sizes)), Counter()
    for r in got:
        s = by_id[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - float(want[s])) < 1e-6
        assert r.taken % max(r.size, 1) == 0 and r.taken <= 3 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - float(want[s])) <= 9 for s in sizes)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(df.repartition(5)).collect()))
    mix = mixing.mixed(df)
    assert mix.columns == df.columns
    words = Counter()
    for r in mix.collect():
        words[r.source] += size(r.text)
    assert all(abs(words[s] - float(want[s])) <= 9 for s in sizes)
    assert mixing.mix_sources(df.limit(0)).count() == 0


def test_mixed_rows(spark):
    """Rows that share an id, null ids, clashing names and columns of any kind; runs agree."""
    rows = [(RNG.choice([None, i // 3]), " ".join([RNG.choice("abc")] * RNG.choice([1, 3, 3, 50])), RNG.choice(["a", "b", None]), f"x{i}", {"k": i}) for i in range(300)]
    rows += [(7, "same text", "a", "y", {})] * 5 + [(8, None, "b", "n", None), (9, "w " * 200_000, "c", "long", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, __size string, mark map<string,int>")
    mix = mixing.mixed(df)
    assert mix.columns == df.columns
    got = Counter(map(str, mix.collect()))
    assert got == Counter(map(str, mixing.mixed(df.repartition(7)).collect()))
    assert set(got) <= set(map(str, df.collect())) and max(n for r, n in got.items() if "'y'" not in r) <= 3
    size = lambda t: len((t or "").split())
    sizes, words = Counter(), Counter()
    for r in rows:
        sizes[r[2]] += size(r[1])
    for r in mix.collect():
        words[r.source] += size(r.text)
    want = _targets(dict(sizes))
    assert all(abs(words[s] - float(want[s])) <= 50 for s in "ab")
    assert mixing.mixed(df.limit(0)).count() == 0


def test_lookup_table():
    shards = [f"s{i}" for i in range(10)]
    table = sharding.lookup_table(shards, 1009)
    n = Counter(table)
    assert set(n) == set(shards) and max(n.values()) - min(n.values()) <= 1
    less = sharding.lookup_table(shards[:-1], 1009)
    moved = sum(a != b for a, b in zip(table, less, strict=True) if a != "s9")
    assert moved < 0.25 * 1009
    heavy = Counter(sharding.lookup_table({"a": 3, "b": 1}, 1009))
    assert abs(heavy["a"] - 3 * heavy["b"]) <= 4


def _turns(shards, size):
    """The table by writing out every shard's whole preference order."""
    prefs = {s: [(sharding._number(s, "offset") + k * (sharding._number(s, "step") % (size - 1) + 1)) % size for k in range(size)] for s in sorted(shards)}
    table = {}
    for s in itertools.cycle(sorted(shards)):
        if len(table) == size:
            return [table[i] for i in range(size)]
        table[next(x for x in prefs[s] if x not in table)] = s


def test_lookup_table_by_brute_force(spark):
    assert sharding.lookup_table(["x", "y", "z"], 101) == _turns(["x", "y", "z"], 101)
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b")], "doc_id long, shard string")
    rows = sharding.assign_shards(df, "doc_id", ["x", "y"], 101).collect()
    assert len(rows) == 3 and rows[0]["shard"] in ("a", "b") and len({(r.doc_id, r["__slot"], r["__shard"]) for r in rows}) == 2
    assert all(r["__shard"] == sharding.lookup_table(["x", "y"], 101)[r["__slot"]] for r in rows)
    assert sharding.assign_shards(df.limit(0), "doc_id", ["x"], 101).count() == 0
    clash = df.withColumnsRenamed({"shard": "__shard"}).selectExpr("*", "1 AS __s", "2 AS __slot")
    again = sharding.assign_shards(clash, "doc_id", ["x", "y"], 101)
    assert again.columns == ["doc_id", "__s", "__slot", "__shard"] and {r["__shard"] for r in again.collect()} <= {"x", "y"}


def _salvage(data):
    return list(warc.salvage(io.BytesIO(data), len(data)))


def _records(n=6):
    return [warc.record(i, f"http://x/{i}", f"payload {i} é".encode() * 20, warc.payload_digest(f"payload {i} é".encode() * 20), None, False) for i in range(n)]


def test_salvage_whole_and_damaged():
    raw = _records()
    for members in ([warc.gzip_member(r) for r in raw], raw, [warc.gzip_member(r) if i % 2 else r for i, r in enumerate(raw)]):
        data = b"".join(members)
        got = _salvage(data)
        assert [g[0] for g in got] == ["record"] * 6 and got[-1][2] == len(data)
        assert [g[3]["warc-record-id"] for g in got] == [f"<urn:x-page:{i}>" for i in range(6)]
        at = len(b"".join(members[:3])) - 40
        bad = data[:at] + b"\x00\xff" * 8 + data[at + 16 :]
        got = _salvage(bad)
        assert [g[3].get("warc-record-id") for g in got if g[0] == "record"] == [f"<urn:x-page:{i}>" for i in (0, 1, 3, 4, 5)]
        gaps = [(g[1], g[2]) for g in got if g[0] == "gap"]
        assert gaps == [(len(b"".join(members[:2])), len(b"".join(members[:3])))]
        cut = _salvage(data[:-5])
        assert [g[0] for g in cut] == ["record"] * 5 + ["gap"] and cut[-1][2] == len(data) - 5
    assert _salvage(b"") == [] and [g[:3] for g in _salvage(b"junk")] == [("gap", 0, 4)]
    assert gzip.decompress(warc.gzip_member(b"x")) == b"x"


def test_every_byte_is_accounted_for():
    data = b"".join(warc.gzip_member(r) for r in _records(4))
    for _ in range(200):
        at = RNG.randrange(len(data))
        bad = data[:at] + bytes([data[at] ^ RNG.randrange(1, 256)]) + data[at + 1 :]
        ends = [(g[1], g[2]) for g in _salvage(bad)]
        assert ends[0][0] == 0 and ends[-1][1] == len(bad) and all(a[1] == b[0] for a, b in itertools.pairwise(ends))
        assert sum(g[0] == "record" for g in _salvage(bad)) >= 3


def test_archived_rows(spark, tmp_path):
    rows = [(1, "http://a/\n é", "<p>é</p>", "x"), (2, None, None, "x"), (3, "u", "", "x"), (4, "u", "<p>é</p>", "x"), (4, "u", "<p>é</p>", "x"), (None, "u", "z", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, record_type string")
    got = Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.archived(df, f"file://{tmp_path}/w").collect())
    assert got == Counter({(1, 9, "revisit", 4): 1, (2, 0, "revisit", 3): 1, (3, 0, "response", None): 1, (4, 9, "response", None): 2, (None, 1, "response", None): 1})
    assert warc.archived(df.limit(0), f"file://{tmp_path}/e").count() == 0
    part = next(p for p in (tmp_path / "w").rglob("*.warc.gz"))
    part.write_bytes(b"JUNK" + part.read_bytes())
    back = warc.read_archives(warc.find_archives(spark, f"file://{tmp_path}/w")).groupBy("kind").count().collect()
    assert {r.kind: r["count"] for r in back} == {"record": 6, "gap": 1}


def test_archives_of_lost_attempts_are_left_out(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "a"), (2, "u", "b")], "page_id long, url string, html string")
    path = f"file://{tmp_path}/w"
    warc.archived(df, path).collect()  # as if by an attempt whose executor was lost
    (tmp_path / "w" / "part-000000-99-00000.warc.gz.open").write_bytes(warc.gzip_member(_records(1)[0]))
    assert sorted(r.page_id for r in warc.archived(df, path).collect()) == [1, 2]
    assert all(r.archive.endswith(".warc.gz") for r in warc.read_archives(warc.find_archives(spark, path)).collect())


def test_torn_records(spark, tmp_path):
    """A record written by half and then whole is read once, and the half is a logged gap."""
    df = spark.createDataFrame([(i, "u", f"<p>{i % 7} {'é' * i}</p>") for i in range(200)], "page_id long, url string, html string").repartition(3)
    path = f"file://{tmp_path}/w"
    got = warc.archived(df, path, torn_every=10).collect()
    whole = {tuple(r)[:5] for r in warc.archived(df, f"file://{tmp_path}/x").collect()}
    assert len(got) == 200 and {tuple(r)[:5] for r in got} == whole
    assert {r.page_id for r in got if r.after_gap} == set(range(0, 200, 10))
    gaps = warc.read_archives(warc.find_archives(spark, path)).where("kind = 'gap'").collect()
    assert len(gaps) == 20 and all(g.end > g.start for g in gaps)


def test_archives_of_others(spark, tmp_path):
    """Sizes and digests come from what is read, not from headers of ours."""
    payload = b"hello"
    http = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n"

    def rec(kind, block, *more):
        head = [b"WARC/1.0", b"WARC-Type: " + kind, b"WARC-Record-ID: <urn:uuid:1>", b"Content-Type: application/http; msgtype=response", *more, b"Content-Length: %d" % len(block)]
        return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"

    digest = b"WARC-Payload-Digest: sha1:" + warc.payload_digest(payload).encode()
    records = [rec(b"warcinfo", b"software: x"), rec(b"response", http + payload), rec(b"response", http + payload, digest), rec(b"revisit", http, digest), rec(b"response", http + b"other", digest)]
    (tmp_path / "a.warc").write_bytes(b"".join(records))
    rows = warc.read_archives(warc.find_archives(spark, f"file://{tmp_path}")).orderBy("start").collect()
    assert [r.kind for r in rows] == ["record"] * 4 + ["gap"]
    assert [(r.payload_digest, r.payload_bytes) for r in rows][1:4] == [(warc.payload_digest(payload), 5)] * 2 + [(warc.payload_digest(payload), None)]
    assert rows[2].block == http + payload


@pytest.mark.parametrize("kind", ("members", "bare", "junk"))
def test_salvage_is_linear(kind):
    def seconds(mb):
        one = warc.gzip_member(_records(1)[0]) if kind == "members" else _records(1)[0] if kind == "bare" else b"\x1f\x8b\x08WARC/1.1\r\nWARC/1.\r\n" * 20
        data = one * ((mb << 20) // len(one))
        began = time.perf_counter()
        n = sum(g[0] == "record" for g in warc.salvage(io.BytesIO(data), len(data)))
        assert n == (0 if kind == "junk" else len(data) // len(one))
        return time.perf_counter() - began

    seconds(1)
    assert seconds(8) < 4 * 4 * max(seconds(2), 0.02)


def test_long_headers_and_blocks():
    raw = warc.record(1, "http://x/" + "a" * 300_000, b"z" * 5_000_000, warc.payload_digest(b"z" * 5_000_000), None, False)
    for data in (raw, warc.gzip_member(raw), b"junk" + raw[:100] + raw):
        got = [g for g in _salvage(data) if g[0] == "record"]
        assert len(got) == 1 and len(warc.payload_of(got[0][3], got[0][4])) == 5_000_000


def test_url_lists(spark):
    d = datetime.date
    pages = [(1, "https://u:p@a.B.org:80/en/x?q#f", d(2024, 2, 1)), (2, "http://b.org/en", d(2024, 2, 10)), (3, None, d(2024, 2, 1)), (4, "nonsense", d(2024, 2, 1)), (5, "http://b.org/", None), (6, "http://b.org/en/x", d(2024, 2, 20)), (1, "https://u:p@a.B.org:80/en/x?q#f", d(2024, 2, 1))]
    entries = [("d:b.org", "one", "add", d(2024, 1, 1)), ("d:b.org", "one", "remove", d(2024, 2, 10)), ("d:b.org", "one", "add", d(2024, 2, 15)), ("p:a.b.org/en", "two", "add", d(2024, 2, 1)), (None, "two", "add", d(2024, 2, 1)), ("d:org", "three", "add", d(2025, 1, 1)), ("d:b.org", "same", "add", d(2024, 1, 1)), ("d:b.org", "same", "remove", d(2024, 1, 1))]
    p = spark.createDataFrame(pages, "page_id long, url string, at date").selectExpr("*", "'x' AS lists")
    e = spark.createDataFrame(entries, "key string, list string, action string, at date")
    got = Counter((r.id, r.n_matches, r.lists, r.blocked) for r in url_lists.filter_urls(p, e, "page_id", "url", "at").collect())
    assert got == Counter({(1, 2, "one,two", True): 2, (2, 0, "", False): 1, (3, 0, "", False): 1, (4, 0, "", False): 1, (5, 0, "", False): 1, (6, 1, "one", True): 1})
    assert url_lists.filter_urls(p.limit(0), e, "page_id", "url", "at").count() == 0
    assert not any(r.blocked for r in url_lists.filter_urls(p, e.limit(0), "page_id", "url", "at").collect())


def test_deep_urls_match_deep_entries(spark):
    d = datetime.date(2024, 1, 1)
    host, path = ".".join(f"l{i}" for i in range(12)), "/".join(f"p{i}" for i in range(12))
    urls = [f"http://{host}/", f"http://x.{host}/", f"http://y{host[1:]}/", f"http://h.org/{path}/more", f"http://h.org/{path}", f"http://h.org/{path[:-1]}", "http://h.org/" + "a/" * 20_000]
    p = spark.createDataFrame([(i, u, d) for i, u in enumerate(urls)], "page_id long, url string, at date")
    e = spark.createDataFrame([(k, "x", "add", d) for k in (f"d:{host}", f"p:h.org/{path}", "p:h.org/" + "/".join("a" * 5_000))], "key string, list string, action string, at date")
    assert {r.id for r in url_lists.filter_urls(p, e, "page_id", "url", "at").collect() if r.blocked} == {0, 1, 3, 4, 6}
