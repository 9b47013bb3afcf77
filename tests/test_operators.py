"""Operators on small trees, and sequential ones against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from treelens.functions import scalar as S
from treelens.operators import chunks as C
from treelens.operators import history as H
from treelens.operators import packs as P
from treelens.operators import trees as T

ENTRIES = "dir_id string, name string, child_id string, node_type int"


@pytest.fixture(scope="module")
def tree(spark):
    rows = [
        ("r1", "a", "d1", 1), ("r1", "b", "f1", 0), ("d1", "x", "f2", 0), ("d1", "y", "f3", 0),
        ("r2", "a", "d2", 1), ("r2", "c", "f1", 0), ("d2", "x", "f2", 0), ("d2", "y", "f4", 0), ("d2", "z", "d1", 1),
    ]
    return spark.createDataFrame(rows, ENTRIES)


def test_diff_expands_subtrees(tree):
    got = {(r.op, r.path) for r in T.diff_trees(tree, "r1", "r2").collect()}
    assert got == {
        ("delete", "/b"), ("create", "/c"), ("modify", "/a/y"), ("create", "/a/z"),
        ("create", "/a/z/x"), ("create", "/a/z/y"),
    }
    assert T.diff_trees(tree, "r1", "r1").count() == 0


def test_diff_refuses_above_its_ceiling(tree):
    with pytest.raises(ValueError):
        T.diff_trees(tree, "r1", "r2", max_steps=1)


def test_measure_counts_shared_subtrees_twice(spark, tree):
    files = spark.createDataFrame([("f1", 10), ("f2", 20), ("f3", 30), ("f4", 40)], "child_id string, size long")
    roots = spark.createDataFrame([("r1",), ("r2",), ("none",)], "root_id string")
    got = {r.root_id: (r.size, r.file_count) for r in T.measure(tree, files, roots).collect()}
    assert got == {"r1": (60, 3), "r2": (120, 5), "none": (0, 0)}


def test_walks_finish_on_a_bomb(spark):
    rows = [(f"d{i}", n, f"d{i + 1}", 1) for i in range(30) for n in "ab"] + [("d30", "f", "f", 0)]
    bomb = spark.createDataFrame(rows, ENTRIES)
    files = spark.createDataFrame([("f", 1)], "child_id string, size long")
    got = T.measure(bomb, files, spark.createDataFrame([("d0",)], "root_id string")).first()
    assert (got.size, got.file_count) == (2**30, 2**30)


def test_resolve(tree):
    assert T.resolve(tree, "r1", "/a/x") == ("found", "f2", 0)
    assert T.resolve(tree, "r1", "//a//") == ("found", "d1", 1)
    assert T.resolve(tree, "r1", "a/q")[0] == "not found"
    assert T.resolve(tree, "r1", "b/x")[0] == "not a directory"
    with pytest.raises(ValueError):
        T.resolve(tree, "r1", "a/../b")


def test_rehash_changes_only_the_spine(spark):
    rows = [("", None), ("/a", None), ("/a/x", "1"), ("/a/y", "2"), ("/b", None), ("/b/z", "3")]
    schema = "path string, content string"
    one = {r.path: r.id for r in T.rehash(spark.createDataFrame(rows, schema)).collect()}
    two = {r.path: r.id for r in T.rehash(spark.createDataFrame([(p, "9" if p == "/a/x" else c) for p, c in rows], schema)).collect()}
    assert {p for p in one if one[p] != two[p]} == {"", "/a", "/a/x"}


def test_retention_follows_the_chain_not_the_clock(spark):
    day = lambda n: f"2024-{1 + n // 28:02d}-{1 + n % 28:02d} 00:00:00"
    rows = [(1, 10, day(60), 1), (1, 9, day(59), 2), (1, 8, day(20), 3), (1, 7, day(58), 4), (1, 6, day(57), 5)]
    commits = spark.createDataFrame(rows, "library_id long, commit_id long, t string, rn int")
    commits = commits.withColumn("created_at", F.col("t").cast("timestamp_ntz"))
    got = {r.commit_id for r in H.retention_cut(commits, day(46)).filter("doomed").collect()}
    assert got == {8, 7, 6}


def test_versions_drop_the_oldest_absence(spark):
    commits = spark.createDataFrame([(1, c, f"2024-01-0{c}") for c in range(1, 6)], "library_id long, commit_id long, t string")
    commits = commits.withColumn("created_at", F.col("t").cast("timestamp_ntz"))
    entries = spark.createDataFrame([(2, 1, 7), (3, 1, 7), (5, 1, 7)], "commit_id long, name int, child_id long")
    got = {(r.commit_id, r.child_id) for r in H.versions(commits, entries, 1).collect()}
    assert got == {(2, 7), (4, None), (5, 7)}


def test_cursor():
    assert H.decode_cursor(H.encode_cursor({"since": "a"}, 7)) == ({"since": "a"}, 7)
    for bad in ("", "x", "e30"):
        with pytest.raises(ValueError):
            H.decode_cursor(bad)
    for bad in (0, -1, 10_001):
        with pytest.raises(ValueError):
            H.check_limit(bad)


STATS = "pack_id string, live_bytes long, dead_fraction double, sealed_at long"


@pytest.mark.parametrize(
    ("rows", "threshold", "budget", "want"),
    [
        ([("a", 600, 0.4, 0), ("b", 400, 0.6, 0)], 0.5, 0, {"b": "candidate"}),
        ([("a", 0, 1.0, 0), ("b", 500, 0.5, 0)], 0.5, 100, {"a": "candidate", "b": "held"}),
        ([("a", 400, 0.6, 0), ("b", 400, 0.6, 0)], 0.5, 500, {"a": "candidate", "b": "held"}),
        ([("a", 400, 0.6, 99), ("b", 400, 0.6, 0)], 0.5, 0, {"a": "too young", "b": "candidate"}),
    ],
)
def test_plan_compaction(spark, rows, threshold, budget, want):
    stats = spark.createDataFrame(rows, STATS)
    got = {r.pack_id: r.state for r in P.plan_compaction(stats, threshold, budget, F.lit(50)).collect()}
    assert got == want


def test_prune_keeps_one_of_two_equal_packs(spark):
    rows = [(1, p, o, size) for p, size in ((1, 100), (2, 50)) for o in (1, 2, 3)]
    index = spark.createDataFrame(rows, "library_id long, pack_id long, object_id long, file_bytes long")
    assert [r.pack_id for r in P.prune(index).collect()] == [1]


def test_folds(spark):
    sizes = [5, 5, 7, 20, 1, 1, 1]
    items = spark.createDataFrame([(1, i, n) for i, n in enumerate(sizes)], "library_id long, seq long, size long")
    assert [r.batch for r in P.batches(items, 3, 10).orderBy("seq").collect()] == [0, 0, 1, 2, 3, 3, 3]
    assert [r.pack_no for r in P.rotate(items, 10).orderBy("seq").collect()] == [0, 0, 1, 1, 2, 2, 2]
    ticks = spark.createDataFrame([("k", s) for s in (0, 10, 299, 300, 500, 601)], "k string, sec long")
    assert sorted(r.sec for r in P.throttle(ticks, "k", 300).collect()) == [0, 300, 601]


def test_bloom_holds_every_id():
    bits = P.bloom_bits(100)
    ids = [f"{random.Random(i).getrandbits(256):064x}" for i in range(100)]
    filled = {x for i in ids for x in P.bloom_probes(i, bits)}
    assert all(set(P.bloom_probes(i, bits)) <= filled for i in ids)
    others = [f"{random.Random(1000 + i).getrandbits(256):064x}" for i in range(200)]
    assert sum(set(P.bloom_probes(i, bits)) <= filled for i in others) == 0


def test_chunker_properties():
    data = random.Random(3).randbytes(60_000)
    p = C.Params()
    table = C.gear_table(p.seed)
    ends = C.cut_points(data, p, table)
    sizes = [b - a for a, b in zip([0, *ends], ends)]
    assert ends[-1] == len(data) and max(sizes) <= p.most and min(sizes[:-1]) >= p.least
    assert abs(sum(sizes) / len(sizes) - p.target) < 0.35 * p.target

    def pieces(d):
        e = C.cut_points(d, p, table)
        return {d[a:b] for a, b in zip([0, *e], e)}

    assert len(pieces(data) & pieces(b"insert" * 50 + data)) > 0.9 * len(sizes)
    assert C.cut_points(data, p, C.gear_table(b"other")) != ends
    assert C.cut_points(b"", p, table) == []
    with pytest.raises(ValueError):
        C.Params(least=300).check()


def test_ranges(spark):
    chunks = spark.createDataFrame([(1, 0, 10, 0), (1, 1, 20, 10), (1, 2, 30, 30), (1, 3, 40, 60)], "manifest_id long, seq int, size long, off long")
    for (lo, n), want in {(0, 1): [0], (9, 2): [0, 1], (10, 1): [1], (60, -1): [3], (0, 0): [], (100, 5): [], (-5, 6): [0]}.items():
        r = spark.createDataFrame([(1, lo, n)], "manifest_id long, lo long, n long")
        assert sorted(x.seq for x in C.covering(chunks, r).collect()) == want


def test_frames_round_trip():
    frames = [(b"a" * 32, b"data"), (b"b" * 32, None), (b"c" * 32, b"")]
    stream = C.encode_frames(frames)
    assert C.decode_frames(stream) == frames
    for bad in (stream[:-1], stream + b"x", stream[:40], b""):
        with pytest.raises(ValueError):
            C.decode_frames(bad)


def test_stream_equals_batch_twin(spark, tmp_path):
    rows = [(i, "u" + str(i % 3), i * 700) for i in range(60)]
    events = spark.createDataFrame(rows, "event_id long, user_id string, sec long")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    from treelens.streaming.operators import stream_token_bucket

    live = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = stream_token_bucket(live, "user_id", 2, 5000).writeStream.format("memory").queryName("tb").trigger(availableNow=True)
    q.option("checkpointLocation", str(tmp_path / "cp")).start().awaitTermination(60)
    got = {tuple(r) for r in spark.table("tb").collect()}
    assert got == {tuple(r) for r in P.token_bucket(events, "user_id", 2, 5000).collect()}


def test_scalars(spark):
    one = spark.range(1)
    show = lambda c: one.select(c.alias("x")).first().x
    assert show(S.format_bytes(F.lit(1536))) == "1.5 KB"
    assert show(S.format_decimal_bytes(F.lit(2_000_000))) == "2 MB"
    assert show(S.parse_bytes(F.lit("12"))) is None and show(S.parse_bytes(F.lit("0"))) == 0
    assert show(S.parse_quota(F.lit("unlimited"))) == -1
    assert tuple(show(S.byte_range(F.lit("bytes=-5"), F.lit(100)))) == (95, 99)
    assert show(S.byte_range(F.lit("bytes=100-"), F.lit(100))) is None
    assert show(S.client_ip(F.lit("1.1.1.1, 2.2.2.2"), F.lit(None).cast("string"), F.lit("3.3.3.3"), 1)) == "2.2.2.2"
    assert show(S.covers(F.lit("l:photos"), F.lit("l"), F.lit("photos-old"))) is False


def test_scalars_by_example(spark):
    one = spark.range(1)
    show = lambda c: one.select(c.alias("x")).first().x
    for n, want in [(0, "0 B"), (999, "999 B"), (1_250_000, "1.2 MB"), (1_150_000, "1.1 MB"), (1_350_000_000, "1.4 GB"), (50, "50 B"), (99_950, "100 KB")]:
        assert show(S.format_decimal_bytes(F.lit(n))) == want
    for message, want in [
        ("failed to get library 7c8a1f2e-3b4d-4c5a-9e6f-0a1b2c3d4e5f: no such library", "failed to get library <id>: no such library"),
        ("login failed for someone@example.com from 192.168.1.44", "login failed for <email> from <n>.<n>.<n>.<n>"),
        ('cannot open "/srv/commits/abc.txt": permission denied', 'cannot open "<str>": permission denied'),
        ("failed to bind socket v2", "failed to bind socket v2"),
    ]:
        assert show(S.normalise_message(F.lit(message))) == want
    assert [show(S.size_bucket(F.lit(n))) for n in (0, -1, 4096, 1 << 24)] == ["empty", "under-4kb", "4kb-64kb", "over-16mb"]
    assert [show(S.parse_days(F.lit(t))) for t in (" 30 ", "0", "-1", "x")] == [30, 0, None, None]
    assert [show(S.parse_duration(F.lit(t))) for t in ("1h30m", " 1.5s", "5", "0s", "-5m", "300ms")] == [5400 * 10**9, 1_500_000_000, None, None, None, 300_000_000]
    assert show(S.byte_range(F.lit("bytes=-20"), F.lit(10))) is None
    assert tuple(show(S.byte_range(F.lit("bytes=-10"), F.lit(10)))) == (0, 9)
    ip = lambda listed, real=None, hops=2, trusted=True: show(S.client_ip(F.lit(listed), F.lit(real), F.lit("127.0.0.1:9"), hops, trusted))
    assert ip("1.2.3.4, 203.0.113.9, 198.51.100.2") == "203.0.113.9"
    assert ip("203.0.113.9") == "127.0.0.1" and ip("203.0.113.9", hops=0) == "203.0.113.9"
    assert ip("1.2.3.4, junk, 1.1.1.1") == "127.0.0.1" and ip("1.2.3.4, 01.2.3.4", "::1", 1) == "::1"
    assert ip("1.2.3.4, 203.0.113.9", trusted=False) == "127.0.0.1"
    code = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"
    assert show(S.recovery_code(F.lit("o i23-4567 89ab cdef ghjk mnpq rstv wxyz"))) == code
    assert show(S.recovery_code(F.lit(code[:-1] + "U"))) is None and show(S.recovery_code(F.lit(code[1:]))) is None
    assert show(S.valid_name(F.lit("n" * 300))) and not show(S.valid_name(F.lit("a/b")))


def test_edits_are_ordered_and_all_or_none(spark):
    tree = spark.createDataFrame([("", None), ("/a", None), ("/a/b", None), ("/a/b/f", "1"), ("/ab", "2")], "path string, content string")
    rows = lambda ops: dict(map(tuple, T.edit(tree, ops).collect()))
    base = {"": None, "/a": None, "/a/b": None, "/a/b/f": "1", "/ab": "2"}
    assert rows([]) == base
    assert rows([{"op": "mkdir", "path": "/c"}, {"op": "mkdir", "path": "/c/d"}, {"op": "put", "path": "c//d/e", "content": "3"}]) == {**base, "/c": None, "/c/d": None, "/c/d/e": "3"}
    assert rows([{"op": "rename", "path": "/a", "to": "/z"}, {"op": "put", "path": "/z/b/f", "content": "9"}, {"op": "remove", "path": "/ab"}]) == {"": None, "/z": None, "/z/b": None, "/z/b/f": "9"}
    assert rows([{"op": "remove", "path": "/a"}, {"op": "mkdir", "path": "/a"}]) == {"": None, "/a": None, "/ab": "2"}
    assert rows([{"op": "rename", "path": "/a/b", "to": "/b"}, {"op": "rename", "path": "/b/f", "to": "/a/f"}]) == {"": None, "/a": None, "/a/f": "1", "/b": None, "/ab": "2"}
    for ops, at, reason in [
        ([{"op": "mkdir", "path": "/made"}, {"op": "remove", "path": "/absent"}], 1, "not found"),
        ([{"op": "mkdir", "path": "/a"}], 0, "exists"), ([{"op": "put", "path": "/a", "content": "x"}], 0, "is a directory"),
        ([{"op": "put", "path": "/ab/x", "content": "x"}], 0, "not a directory"), ([{"op": "mkdir", "path": "/q/r"}], 0, "not found"),
        ([{"op": "rename", "path": "/a", "to": "/a/b/c"}], 0, "a directory can't move into itself"), ([{"op": "rename", "path": "/a", "to": "/ab"}], 0, "exists"),
        ([{"op": "mkdir_all", "path": "/ab/x"}], 0, "not a directory"), ([{"op": "remove", "path": "/"}], 0, "the root can't be edited"),
        ([{"op": "mkdir", "path": "/a/../x"}], 0, "a path may not hold . or .."),
    ]:
        with pytest.raises(T.Refused) as e:
            T.edit(tree, ops)
        assert (e.value.at, e.value.reason) == (at, reason)


@pytest.mark.parametrize("block", [1 << 20, 100])
def test_cut_points_by_definition(monkeypatch, block):
    monkeypatch.setattr(C, "BLOCK", block)
    rng = random.Random(9)
    for p in (C.Params(), C.Params(8, 32, 200, 1), C.Params(1, 16, 64, 2), C.Params(64, 64, 100, 0)):
        table = C.gear_table(p.seed)
        for data in (rng.randbytes(9000), bytes(5000), b"ab" * 2000, rng.randbytes(p.least), rng.randbytes(p.least + 1), b"x"):
            want, start = [], 0
            while start < len(data):
                size, h = min(len(data) - start, p.most), 0
                if len(data) - start > p.least:
                    for i in range(p.least - 1, size):
                        h = ((h << 1) + table[data[start + i]]) & (2**64 - 1)
                        if not h & C.top_mask(p.bits + (p.level if i < p.target else -p.level)):
                            size = i + 1
                            break
                start += size
                want.append(start)
            assert C.cut_points(data, p, table) == want


def test_covering_refuses_beyond_its_limit(spark):
    chunks = spark.createDataFrame([(m, i, 10 * i, 10) for m in (1, 2) for i in range(5)], "manifest_id long, seq int, off long, size long")
    ranges = spark.createDataFrame([(1, 5, 12), (2, 0, -1)], "manifest_id long, lo long, n long")
    assert C.covering(chunks, ranges, 5).count() == 7
    with pytest.raises(Exception, match="more than 4 chunks"):
        C.covering(chunks, ranges, 4).count()


@pytest.mark.parametrize("name, scale", [("f1_format_bytes", 13), ("f3_decimal_bytes", 25)])
def test_sizes_of_large_tables_equal_the_oracle(spark, tmp_path, name, scale):
    """Beyond the ids of the small tables: sizes over 1024 GB, and ties of one decimal."""
    import duckdb

    from treelens.plans.registry import ORACLES, QUERIES

    step = 5_999_999 // 40_000
    ids = spark.range(0, 6_000_000, step).union(spark.range(300)).selectExpr("id AS event_id").distinct()
    for k in (64, 320, 1600, 8000, 40_000, 200_000, 262_144, 524_288, 1_048_576):
        ids = ids.union(spark.range(k, 6_000_000, k * 17).selectExpr("id AS event_id")).distinct()
    rest = spark.read.parquet("/root/testdata/sf0.001/events.parquet").drop("event_id").limit(1)
    ids.crossJoin(rest).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = dict(con.execute(ORACLES[name]).fetchall())
    got = {r.event_id: r.shown for r in QUERIES[name](spark, str(tmp_path)).collect()}
    assert got == want and len(got) > 40_000


def test_diff_of_trees_beyond_the_ceiling(spark, sf_dir, monkeypatch):
    """The query lists the whole difference, whatever the operator's ceiling is."""
    from treelens.plans.registry import QUERIES

    monkeypatch.setattr(T.diff_trees, "__defaults__", (1,))
    assert QUERIES["g3_diff_trees"](spark, sf_dir).count() > 1
