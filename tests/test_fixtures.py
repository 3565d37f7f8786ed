"""Small fixtures with known answers for every family of operators."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from heddle.functions import expiry, geo, hashes, text, vectors
from heddle.operators import access, cdc, dml, keyed, relational, search, usage, versions
from heddle.plans import catalog, kvsql
from heddle.sources import copytext


def kv(spark, **rows):
    return spark.createDataFrame(list(rows.items()), "key string, value string")


def pairs(df):
    return sorted(map(tuple, df.collect()), key=lambda r: [str(x) for x in r])


@pytest.fixture(scope="module")
def tables(spark):
    return {"nums": kv(spark, a="10", b="20", c="oops"), "fruit": kv(spark, a="apple", b="banana", c="apricot"), "users": kv(spark, a="ada", b="grace"), "orders": kv(spark, a="o1", q="stray"), "tags": kv(spark, a="red", b="blue", c="red")}


@pytest.mark.parametrize(
    ("sql", "want"),
    [
        ("SELECT COUNT(*), SUM(VALUE), MAX(VALUE) FROM nums", [(3, 30.0, "oops")]),
        ("SELECT AVG(VALUE) FROM nums WHERE KEY != 'c'", [(15.0,)]),
        ("SELECT KEY FROM fruit WHERE VALUE CONTAINS 'ap'", [("a",), ("c",)]),
        ("SELECT KEY FROM fruit ORDER BY KEY DESC LIMIT 1 OFFSET 1", [("b",)]),
        ("SELECT * FROM users JOIN orders ON KEY = KEY", [("a", "ada", "o1")]),
        ("SELECT VALUE, COUNT(*) FROM tags GROUP BY VALUE", [("blue", 1), ("red", 2)]),
        ("SELECT * FROM tags KEY 'b'", [("b", "blue")]),
        ("SELECT * FROM tags KEY 'zz'", []),
        ("SELECT KEY FROM nums WHERE VALUE BETWEEN 9 AND 10 OR KEY IN ('c') AND NOT VALUE IS NULL", [("a",), ("c",)]),
        ("SELECT KEY AS k FROM nums WHERE VALUE > '9'", [("a",), ("b",), ("c",)]),
        ("UPSERT INTO users KEY 'b' VALUE 'hopper'", [("a", "ada"), ("b", "hopper")]),
        ("INSERT INTO users KEY 'it''s' VALUE '1'", [("a", "ada"), ("b", "grace"), ("it's", "1")]),
        ("DELETE FROM users KEY 'a';", [("b", "grace")]),
    ],
)
def test_kv_dialect(tables, sql, want):
    assert pairs(kvsql.run(sql, tables)) == want


@pytest.mark.parametrize("sql", ["SELECT", "SELECT * FROM none", "SELECT * FROM nums LIMIT 10001", "DROP nums", "SELECT * FROM nums WHERE", "SELECT * FROM nums KEY 'a' 'b'", "SELECT $ FROM nums"])
def test_kv_dialect_errors(tables, sql):
    with pytest.raises(kvsql.SyntaxProblem):
        kvsql.run(sql, tables)


def test_kv_plans(tables):
    assert kvsql.explain("SELECT * FROM nums KEY 'a'", tables) == "point_lookup"
    assert kvsql.explain("SELECT * FROM nums WHERE KEY != 'a'", tables) == "filtered_scan filters 1"
    with pytest.raises(dml.ConflictError):
        kvsql.run("INSERT INTO users KEY 'a' VALUE 'x'", tables)


@pytest.mark.parametrize(("glob", "yes", "no"), [("a*c", ["ac", "abbc", "a\nc"], ["acd", "bac"]), ("h[ae]llo?", ["hallo1", "hello!"], ["hillo1", "hello"]), ("[^a-c]x", ["dx"], ["ax"]), ("\\*", ["*"], ["x"]), ("a.b+", ["a.b+"], ["axb+"])])
def test_globs(spark, glob, yes, no):
    df = spark.createDataFrame([(x,) for x in yes + no], "k string")
    assert sorted(r.k for r in relational.match_keys(df, "k", glob).collect()) == sorted(yes)


def test_multi_get_and_ranges(spark):
    df = kv(spark, a="1", b="2", c="3")
    assert [tuple(r) for r in relational.multi_get(df, "key", ["c", "x", "c"]).select("key", "value").collect()] == [("c", "3"), ("x", None), ("c", "3")]
    assert relational.key_range(df, "key", "a", "c").count() == 2 and relational.key_range(df, "key", "c", "a").count() == 0
    assert [r.key for r in relational.scan_after(df, "key", "a", 5).collect()] == ["b", "c"]
    numbers = spark.range(0, 1000).repartition(7)
    got = relational.chunks(numbers, "id", 300).groupBy("chunk").agg(F.min("id").alias("a"), F.max("id").alias("b"))
    assert pairs(got) == [(0, 0, 299), (1, 300, 599), (2, 600, 899), (3, 900, 999)]
    ranges = spark.createDataFrame([(1, 0, 10), (2, 10, 25), (3, 40, None)], "range_id int, start long, end long")
    routed = {r.id: r.range_id for r in relational.range_lookup(spark.range(0, 60), "id", ranges, 7).collect()}
    assert routed == {i: 1 if i < 10 else 2 if i < 25 else 3 if i >= 40 else None for i in range(60)}


def test_rest_reads(spark):
    profiles = kv(spark, p1='{"status":"ready","score":12,"owner":"a"}', p2='{"status":"queued","score":4,"owner":"b"}')
    got = access.rest_read(profiles, [("status", "eq.ready"), ("score", "gte.10")], "key,status", json_col="value")
    assert got.columns == ["key", "status"] and pairs(got) == [("p1", "ready")]
    assert pairs(access.rest_read(profiles, [("or", "(score.lt.5,owner.eq.zz)")], "k:key", json_col="value")) == [("p2",)]
    assert pairs(access.rest_read(profiles, [("score", "gt.9")], "key", json_col="value")) == [("p1",)]  # as numbers
    long = spark.createDataFrame([(f"row-{i:03d}", '{"status":"%s"}' % ("ready" if i == 256 else "no")) for i in range(257)], "key string, value string")
    assert pairs(access.rest_read(long, [("status", "eq.ready")], "key", limit=1, json_col="value")) == [("row-256",)]
    for bad in ([("status", "eq")], [("or", "(a.eq.1")], [("nope", "eq.1")], [("status", "zz.1")]):
        with pytest.raises(access.FilterError):
            access.rest_read(profiles, bad, json_col=None if bad[0][0] == "nope" else "value")


def test_visibility_and_masks(spark):
    rows = kv(spark, a='{"Tenant":"t1","x":1}', b='{"tenant":"t1","TENANT":"t1"}', c='{"tenant":1}', d="[1]", e="text", f='{"tenant":"t2"}')
    assert [r.key for r in rows.where(access.tenant_visible(F.col("value"), "tenant", "t1")).collect()] == ["a"]
    got = {r.key: r.m for r in rows.select("key", access.masked(F.col("value"), ["x", "tenant"]).alias("m")).collect()}
    assert got == {"a": '{"Tenant":"t1","x":"***"}', "b": '{"TENANT":"t1","tenant":"***"}', "c": '{"tenant":"***"}', "d": "***", "e": "***", "f": '{"tenant":"***"}'}
    assert rows.where(access.owner_visible([], "u")).count() == 0 and rows.where(access.owner_visible(None, "u")).count() == 6


def test_changes(spark):
    t = spark.createDataFrame([("p1", "hello", 3), ("p2", "x", None)], "id string, payload string, count int")
    new = spark.createDataFrame([("p1", "changed", 9), ("p3", "z", 1)], "id string, payload string, count int")
    assert pairs(dml.upsert(t, new, ["id"], {"payload": F.col("new.payload"), "count": F.col("old.count") + 1})) == [("p1", "changed", 4), ("p2", "x", None), ("p3", "z", 1)]
    assert pairs(dml.insert_ignore(t, new, ["id"])) == [("p1", "hello", 3), ("p2", "x", None), ("p3", "z", 1)]
    with pytest.raises(dml.ConflictError):
        dml.insert(t, new, ["id"])
    with pytest.raises(dml.ConflictError):
        dml.insert(t, new.where("id = 'p3'").union(new.where("id = 'p3'")), ["id"])
    assert pairs(dml.delete_where(t, F.col("count") > 1)) == [("p2", "x", None)]
    with pytest.raises(dml.ConflictError):
        dml.alter(t, not_null=["count"])
    child = spark.createDataFrame([("c1", "p1"), ("c2", "p2"), ("c3", None)], "id string, parent string")
    gone = t.where("id = 'p1'")
    assert pairs(dml.cascade(child, "parent", gone, "id")) == [("c2", "p2"), ("c3", None)]
    assert pairs(dml.cascade(child, "parent", gone, "id", "set null")) == [("c1", None), ("c2", "p2"), ("c3", None)]
    with pytest.raises(dml.ConflictError):
        dml.cascade(child, "parent", gone, "id", "restrict")
    doc = spark.range(1).select(dml.patch(F.lit('{"a":"1","b":"2"}'), F.lit('{"b":"3","c":"4"}')).alias("d")).first().d
    assert doc == '{"a":"1","b":"3","c":"4"}'
    assert pairs(relational.orphans(child, "parent", t.where("id = 'p2'"), "id").select("id")) == [("c1",)]
    assert relational.check_violations(t, F.col("count") > 5).count() == 1


def test_sorted_sets(spark):
    z = spark.createDataFrame([("z", "a", 5.0), ("z", "b", 2.0), ("z", "c", 1.5)], "key string, member string, score double")
    assert [r.member for r in keyed.zset_range(z, 0, -1).orderBy("index").collect()] == ["c", "b", "a"]
    assert {r.member: r["rank"] for r in keyed.zset_ranked(z).collect()}["a"] == 2
    assert {r.member: r["rank"] for r in keyed.zset_ranked(z, True).collect()}["a"] == 0
    assert keyed.zset_count(z, "(1.5", "5").first().n == 2 and keyed.zset_count(z, "-inf", "+inf").first().n == 3
    after, added = keyed.zset_add(z, spark.createDataFrame([("z", "a", 1.0), ("z", "d", 9.0)], z.schema), "gt")
    assert added.first().added == 1 and pairs(after) == [("z", "a", 5.0), ("z", "b", 2.0), ("z", "c", 1.5), ("z", "d", 9.0)]
    assert keyed.zset_range(z, 5, 9).count() == 0


def test_lists(spark):
    t = spark.createDataFrame([("l", 0, "a"), ("l", 1, "b")], "key string, pos long, value string")
    new = spark.createDataFrame([("l", 0, "x"), ("l", 1, "y"), ("m", 0, "z")], t.schema)
    show = lambda df: [r.value for r in df.where("key = 'l'").orderBy("pos").collect()]
    assert show(keyed.push(t, new)) == ["a", "b", "x", "y"] and show(keyed.push(t, new, left=True)) == ["y", "x", "a", "b"]
    rest, got = keyed.pop(t, "l")
    assert got.first().value == "a" and show(rest) == ["b"]


def test_streams_and_groups(spark):
    st = spark.createDataFrame([("st", "100-1", "a"), ("st", "100-2", "b")], "key string, id string, f string")
    assert keyed.stream_range(st).count() == 2 and keyed.stream_range(st, count=0).count() == 0
    assert [r.id for r in keyed.stream_range(st, count=1, reverse=True).collect()] == ["100-2"]
    assert [r.id for r in keyed.stream_range(st, "(100-1", "100").collect()] == ["100-2"]
    assert [r.id for r in keyed.stream_trim(st, 1).collect()] == ["100-2"]
    page, cursor = keyed.read_group(st, "0-0", "c", 1)
    assert page.first().id == "100-1" and cursor == "100-1" and keyed.read_group(st, "100-2", "c", 1)[1] == "100-2"
    rej = spark.createDataFrame([("s", "5-1", 1), ("s", "5-1", 2), ("s", "4-9", 3), ("s", "6-0", 4), ("t", "0-0", 1)], "key string, id string, arrival int")
    assert pairs(keyed.stream_rejects(rej).select("key", "arrival")) == [("s", 2), ("s", 3), ("t", 1)]


def test_counters(spark):
    assert keyed.count_up(spark.createDataFrame([("a", 2), ("a", -5)], "key string, delta long"), kv(spark, a="10")).first().value == 7
    with pytest.raises(Exception, match="ARITHMETIC_OVERFLOW|overflow"):
        keyed.count_up(spark.createDataFrame([("a", (1 << 63) - 1), ("a", 1)], "key string, delta long")).collect()
    with pytest.raises(Exception, match="finite"):
        keyed.count_up_float(spark.createDataFrame([("a", 1e308), ("a", 1e308)], "key string, delta double")).collect()


def test_distinct_counts(spark):
    rows = spark.range(10_000).select(F.lit("h").alias("key"), F.col("id").alias("member"))
    assert abs(keyed.sketch_count(keyed.sketch(rows)).first().estimate - 10_000) < 500
    two = rows.unionByName(spark.range(5).select(F.lit("d").alias("key"), (F.col("id") + 100_000).alias("member")))
    merged = {r.key: r.estimate for r in keyed.sketch_count(keyed.sketch_merge(keyed.sketch(two), "d", ["h"])).collect()}
    assert merged["d"] == merged["h"]


def test_positions(spark):
    p = spark.createDataFrame([("g", "Palermo", 13.361389, 38.115556), ("g", "Catania", 15.087269, 37.502669)], "key string, member string, lon double, lat double")
    a, b = p.collect()
    d = spark.range(1).select(geo.haversine(*map(F.lit, (a.lon, a.lat, b.lon, b.lat))).alias("d")).first().d
    assert abs(d - 166274) < 5
    assert keyed.geo_search(p, 15, 37, 200_000).count() == 2 and keyed.geo_search(p, 15, 37, 100_000).count() == 1
    assert [r.member for r in keyed.geo_search(p, 15, 37, 200_000, order="desc").collect()] == ["Palermo", "Catania"]
    assert [r.h for r in p.select(geo.geohash(F.col("lon"), F.col("lat")).alias("h")).collect()] == ["sqc8b49rny0", "sqdtr74hyu0"]
    assert [r.s for r in p.select(geo.score(F.col("lon"), F.col("lat")).alias("s")).collect()] == [3479099956230698, 3479447370796909]
    assert p.where(geo.valid(F.col("lon"), F.col("lat"))).count() == 2
    assert spark.range(1).select(geo.distance_text(F.lit(1500.0), "km").alias("t")).first().t == "1.5000"


def test_distance_texts_round_as_c(spark):
    d = spark.createDataFrame([(51.86 - 180, -19.44), (41832673.62435 * 0.3048, None), (None, 1.0)], "lon double, lat double")
    texts = [r.t for r in d.where("lat is null").select(geo.distance_text(F.col("lon"), "ft").alias("t")).collect()]
    assert texts == ["%.4f" % (41832673.62435 * 0.3048 / 0.3048)] and texts[0] == "41832673.6243"
    at = lambda k: ((k * 7919) % 36000 / 100.0 - 180, (k * 104729) % 16000 / 100.0 - 80)
    far = spark.createDataFrame([at(14640), at(39717)], "lon double, lat double").select(geo.library_haversine(F.lit(13.3), F.lit(38.1), F.col("lon"), F.col("lat")).alias("m"))
    got = far.select(geo.distance_text(F.col("m")).alias("m"), geo.distance_text(F.col("m"), "ft").alias("ft")).collect()
    assert [tuple(r) for r in got] == [("13079139.1530", "42910561.5255"), ("11696667.9601", "38374894.8824")]
    assert d.where("lon is null").select(geo.library_haversine(F.lit(0), F.lit(0), F.col("lon"), F.col("lat")).alias("m")).select(geo.distance_text(F.col("m")).alias("t")).first().t is None


def test_vectors(spark, tmp_path):
    v = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [0.0, 1.0]), ("bad", [float("nan"), 1.0]), ("zero", [0.0, 0.0]), ("long", [1.0, 0.0, 0.0])], "vec_id string, embedding array<float>")
    assert [tuple(r) for r in search.exact_search(v, [3.0, 4.0], 5).collect()] == [("y", 0.8), ("x", 0.6)]
    path = search.write_vector_index(v, f"{tmp_path}/few", 2)
    assert [r.id for r in search.index_nearest(spark, path, [0.9, 0.1], 1).collect()] == ["x"]
    empty = search.write_vector_index(v.limit(0), f"{tmp_path}/none", 2)
    assert search.index_nearest(spark, empty, [0.9, 0.1], 1).count() == 0
    with pytest.raises(ValueError):
        search.index_nearest(spark, path, [0.9, 0.1, 0.0], 1)
    many = spark.range(6000).select(F.col("id").cast("string").alias("vec_id"), F.array(*[F.sin(F.col("id") * (i + 1) * 0.7) for i in range(16)]).cast("array<float>").alias("embedding"))
    q = many.where("vec_id = '77'").first().embedding
    path = search.write_vector_index(many, f"{tmp_path}/many", 16)
    assert search.index_nearest(spark, path, q, 10).first().id == "77"
    asked = many.where("cast(vec_id as long) % 100 = 0").select(F.col("vec_id").cast("long").alias("query"), F.col("embedding").alias("vector"))
    want = {(r.query, r.id) for r in search.exact_search_all(many, asked, 10, dim=16).collect()}
    assert {i for n, i in want if n == 100} == {r.id for r in search.exact_search(many, many.where("vec_id = '100'").first().embedding, 10).collect()}
    got = {(r.query, r.id) for r in search.index_nearest_all(asked, path, 10).collect()}
    assert len(want) == 590 and len(got & want) >= 0.9 * len(want)  # id 0 is the zero vector, which can't be asked for
    assert spark.range(1).select(vectors.norm(F.array(F.lit(3.0), F.lit(4.0))).alias("n")).first().n == 5


def test_vector_batches_by_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(search, "BLOCK_QUERIES", 7)
    monkeypatch.setattr(search, "BLOCK_VECTORS", 50)
    many = spark.range(5000).select(F.col("id").cast("string").alias("vec_id"), F.array(*[F.sin(F.col("id") % 4900 * (i + 1) * 0.7) for i in range(16)]).cast("array<float>").alias("embedding"))
    path = search.write_vector_index(many, f"{tmp_path}/many", 16)
    asked = many.where("cast(vec_id as long) % 500 = 1").select(F.col("vec_id").cast("long").alias("query"), F.col("embedding").alias("vector"))
    all_, near = search.exact_search_all(many, asked, 10, dim=16), search.index_nearest_all(asked, path, 10)
    assert "Join" not in near._jdf.queryExecution().toString()  # pairs are compared in blocks, not joined
    q = many.where("vec_id = '1'").first().embedding
    want = [tuple(r) for r in search.exact_search(many, q, 10).collect()]
    assert sorted((r.id, r.score) for r in all_.where("query = 1").collect()) == sorted(want)
    assert {"1", "4901"} <= {r.id for r in near.where("query = 1").collect()}


def test_vector_index_searched_whole(spark, tmp_path):
    many = spark.range(5000).select(F.col("id").cast("string").alias("vec_id"), F.array(*[F.sin(F.col("id") * (i + 1) * 0.7) for i in range(16)]).cast("array<float>").alias("embedding"))
    path = search.write_vector_index(many, f"{tmp_path}/many", 16)
    q = many.where("vec_id = '78'").first().embedding
    assert search.index_nearest(spark, path, q, 100, whole=True).collect() == search.exact_search(many, q, 100).collect()


def test_text_index(spark, tmp_path):
    docs = spark.createDataFrame([("d1", "the quick brown fox"), ("d2", "lorem ipsum dolor the"), ("b", "equal score"), ("a", "equal score"), ("n", None)], "doc_id string, text string")
    path = search.write_text_index(docs, f"{tmp_path}/t", buckets=3)
    for q in ("quick fox", "equal", "the THE lorem", "nothing here", " .,! "):
        assert search.index_search(spark, path, q, 5).collect() == search.text_search(docs, q, 5).collect()
    assert search.index_search(spark, search.write_text_index(docs.limit(0), f"{tmp_path}/e"), "the", 5).count() == 0


def test_segments_are_dealt_by_rows(spark, tmp_path, monkeypatch):
    from heddle.sources import logs

    monkeypatch.setattr(logs, "TASK_ROWS", 10)
    rows = spark.range(100).select(F.col("id").cast("string").alias("pk"), F.col("id").alias("commit_ts"), F.lit("v").alias("value"), F.lit(0).cast("long").alias("expires_at"))
    logs.write_segment(rows, f"{tmp_path}/s", 1, "delta")
    assert len(list((tmp_path / "s").rglob("part-*.parquet"))) > 5 and logs.read_segments(spark, f"{tmp_path}/s").count() == 100
    logs.archive(rows.withColumn("g", F.col("commit_ts") % 3).repartition("g"), f"{tmp_path}/a", by="g")
    assert len(list((tmp_path / "a/objects").rglob("part-*.parquet"))) == 3 and logs.damaged(spark, f"{tmp_path}/a").isEmpty()
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"


def test_text_index_runs(spark, tmp_path, monkeypatch):
    """Runs of few words, rows that share an id, null ids and texts; the build has no shuffle but that of the count."""
    docs = spark.createDataFrame([(f"d{i % 90}" if i % 13 else None, None if i % 17 == 0 else " ".join(["the"] * (i % 5) + [f"w{i % 7}", f"x{i}"])) for i in range(200)], "doc_id string, text string")
    monkeypatch.setattr(search, "RUN_WORDS", 20)
    path = search.write_text_index(docs, f"{tmp_path}/t")
    stored = spark.read.parquet(f"{path}/postings")
    want = search.postings(docs, "doc_id", "text")
    assert sorted(map(repr, stored.groupBy("id", "term").agg(F.sum("tf").alias("tf")).collect())) == sorted(map(repr, want.collect()))
    runs = search._run([pa.array(["b", "a"])], [pa.array([["z", "y", "z"], ["y"]])])
    assert runs.to_pydict() == {"id": ["b", "a", "b"], "term": ["y", "y", "z"], "tf": [1, 1, 2]}


def test_text_search(spark):
    docs = spark.createDataFrame([("d1", "the quick brown fox"), ("d2", "lorem ipsum dolor"), ("b", "equal score"), ("a", "equal score"), ("n", None)], "doc_id string, text string")
    assert [r.id for r in search.text_search(docs, "quick fox", 5).collect()] == ["d1"]
    assert [r.id for r in search.text_search(docs, "equal", 1).collect()] == ["a"]
    once, twice = (search.text_search(docs, q, 1).first().score for q in ("fox", "fox fox"))
    assert twice == pytest.approx(2 * once, abs=2e-5)


def test_expiry(spark):
    row = spark.range(1).select(expiry.to_millis(F.lit(5).cast("long")).alias("a"), expiry.to_millis(expiry.at_millis(F.lit(1500))).alias("b"), expiry.expired(F.lit(0).cast("long"), 9).alias("c"), expiry.expired(F.lit(1).cast("long"), 1000).alias("d"), expiry.ttl(F.lit(None).cast("long"), 5).alias("e"), expiry.remaining(F.lit(2).cast("long"), 1500).alias("f")).first()
    assert tuple(row) == (5000, 1500, False, True, -2, 500)


def test_versions(spark):
    log = spark.createDataFrame([("a", 1, "v1", 0), ("a", 3, None, 0), ("b", 2, "w", 0), ("b", 4, "gone", 1), ("c", 5, "late", 0)], "pk string, commit_ts long, value string, expires_at long")
    see = lambda at: pairs(versions.snapshot(log, at=at, now_millis=1_000).select("pk", "value"))
    assert see(2) == [("a", "v1"), ("b", "w")] and see(3) == [("b", "w")] and see(4) == [] and see(9) == [("c", "late")]
    assert pairs(versions.collect_garbage(log, 3).select("pk", "commit_ts")) == [("a", 3), ("b", 2), ("b", 4), ("c", 5)]
    own = spark.createDataFrame([("b", 1, None, 0), ("n", 1, "new", 0)], log.schema)
    assert pairs(versions.branch_read(log, own, 2)) == [("a", "v1"), ("n", "new")]
    assert pairs(versions.branch_diff(log.limit(0), own).select("side", "pk")) == [("only_right", "b"), ("only_right", "n")]
    bad = spark.createDataFrame([(1, "a", "x", "", "0"), (3, "b", "y", "0", "1")], "version long, id string, sql string, parent_checksum string, checksum string")
    assert versions.ledger_breaks(bad).count() == 2
    assert versions.ledger_breaks(bad.limit(0)).count() == 0


def test_change_records(spark):
    r = spark.createDataFrame([("INSERT", "a", "1", 1), ("UPDATE", "a", "2", 2), ("INSERT", "b", "1", 2), ("DELETE", "b", None, 3)], "op string, pk string, after string, commit_ts long")
    r = cdc.sequenced(r.withColumn("topic", F.lit("t")), ["topic"], ["pk"])
    assert sorted(x.sequence for x in r.collect()) == [1_000_001, 2_000_001, 2_000_002, 3_000_001]
    assert pairs(cdc.fold(r.unionByName(r))) == [("a", "2")]
    cdc.check_cursor(r, 1_000_000)
    with pytest.raises(cdc.CursorError, match="cursor_expired"):
        cdc.check_cursor(r, 5)
    with pytest.raises(cdc.CursorError, match="cursor_ahead"):
        cdc.check_cursor(r, 9_000_000)


def test_usage(spark):
    e = spark.createDataFrame([("t", "d", "read_unit", 2, "k", 1), ("t", "d", "read_unit", 2, "k", 2), ("t", "d", "write_unit", 3, "", 3), ("t", "d", "write_unit", 3, "", 4)], "tenant string, database string, metric string, quantity long, idempotency_key string, seq long")
    totals = usage.metered(e)
    assert pairs(totals.select("metric", "quantity", "events")) == [("read_unit", 2, 1), ("write_unit", 6, 2)]
    assert pairs(usage.invoice(totals, "t").select("metric", "amount_micros", "total_micros")) == [("read_unit", 2, 32), ("write_unit", 30, 32)]
    s = spark.createDataFrame([("a", i, i) for i in range(1, 101)], "k string, v long, o long")
    got = usage.latency(s, "k", "v", "o", 64).first()
    assert (got.n, got["mean"], got["max"], got.p50, got.p99) == (100, 50, 100, 68, 100)
    f = spark.range(1).select(text.fingerprint(F.lit("select a1, 'x''y' from t where n=42 and v=1.5")).alias("f")).first().f
    assert f == "SELECT A1 , ?? FROM T WHERE N = ? AND V = 1.5"


def test_copy(spark):
    lines = spark.createDataFrame([("1\thello",), ("2\t\\N",), ("\\.",)], "value string")
    assert pairs(copytext.parse_copy(lines, "id int, body string")) == [(1, "hello"), (2, None)]
    with pytest.raises(Exception, match="wrong number of fields"):
        copytext.parse_copy(spark.createDataFrame([("1",)], "value string"), "id int, body string").collect()
    with pytest.raises(Exception, match="empty key"):
        copytext.parse_copy_kv(spark.createDataFrame([("\tx",)], "value string")).collect()
    odd = spark.createDataFrame([("a\tb\\c\nd\r", None)], "a string, b string")
    line = copytext.to_copy(odd)
    assert line.first().value == "a\\tb\\\\c\\nd\\r\t\\N"
    assert copytext.parse_copy(line, "a string, b string").first() == odd.first()


def test_catalogue(spark, tmp_path):
    s = catalog.Sequence(maximum=3, cycle=True)
    assert [s.nextval() for _ in range(4)] == [1, 2, 3, 1] and s.currval() == 1
    assert catalog.Sequence(increment=-1).nextval() == -1
    t = catalog.Sequence()
    assert t.setval(7, False) == 7 and t.nextval() == 7 and t.setval(9) == 9 and t.nextval() == 10
    u = catalog.Sequence(start=5, increment=2)
    assert pairs(u.assign(spark.range(3), "n", "id")) == [(0, 5), (1, 7), (2, 9)] and u.nextval() == 11
    with pytest.raises(ValueError, match="exhausted"):
        x = catalog.Sequence(maximum=1)
        x.nextval(), x.nextval()
    assert catalog.bind("SELECT '$1', $2, $1 -- $3\n, \"$4\"", [1, None]) == ("SELECT '$1', :p2, :p1 -- $3\n, \"$4\"", {"p2": None, "p1": 1})
    assert catalog.type_of("TEXT[]") == "array<string>"
    spark.range(3).createOrReplaceTempView("heddle_src")
    v = catalog.MaterializedView(spark, "heddle_mv", "SELECT count(*) AS n FROM heddle_src", str(tmp_path))
    spark.range(5).createOrReplaceTempView("heddle_src")
    assert v.read().first().n == 3 and v.refresh().first().n == 5 == spark.table("heddle_mv").first().n
    with pytest.raises(ValueError, match="populated"):
        catalog.MaterializedView(spark, "heddle_mv2", "SELECT 1", str(tmp_path), with_data=False).read()


def test_hash_values(spark):
    assert f"{hashes.fnv1a64_int(b''):016x}" == "cbf29ce484222325" and f"{hashes.fnv1a64_int(b'a'):016x}" == "af63dc4c8601ec8c"
    assert [r.h for r in spark.createDataFrame([("a",), (None,)], "s string").select(hashes.fnv1a64(F.col("s")).alias("h")).collect()] == ["af63dc4c8601ec8c", None]
