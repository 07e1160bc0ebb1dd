from collections import defaultdict

from hushframe.llm import queries, sharding


def test_shards_fit_and_only_full_ones_split(spark):
    rows = [(i, "x" * (i % 97), "s") for i in range(4000)] + [(None, None, "s"), (1, "é" * 900, "s")] + [(9, "copy" * 20, "s")] * 500
    df = spark.createDataFrame(rows, "doc_id long, text string, hash string")
    out = sharding.shard(df, 2000, bits=3).collect()
    assert len(out) == len(rows)
    assert sum(r.bytes for r in out) == sum(len((t or "").encode()) for _, t, _ in rows)
    held, hashes = defaultdict(int), {}
    for r in out:
        held[r.shard] += r.bytes
        assert r.bucket == r.hash >> (sharding.HASH_BITS - r.depth)
        hashes.setdefault(r.shard, set()).add((r.depth, r.bucket))
    assert max(held.values()) <= 2000 and all(len(x) == 1 for x in hashes.values())
    # no bucket could have stayed whole: the prefix one bit shorter holds more than the limit
    for depth, bucket in {(r.depth, r.bucket) for r in out if r.piece is None and r.depth}:
        assert sum(r.bytes for r in out if r.hash >> (sharding.HASH_BITS - depth + 1) == bucket >> 1) > 2000
    assert all(r.piece is not None for r in out if r.doc_id == 9 and r.bytes == 80)


def test_one_text_above_the_limit_and_no_rows(spark):
    df = spark.createDataFrame([(1, "y" * 5000), (2, "z")], "doc_id long, text string")
    out = {r.doc_id: r for r in sharding.shard(df, 100).collect()}
    assert out[1].shard != out[2].shard and out[1].bytes == 5000
    assert sharding.shard(spark.createDataFrame([], "doc_id long, text string"), 10).count() == 0


def test_reruns_agree(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    a, b = (sharding.shard(x, 30_000).select("doc_id", "shard") for x in (df, df.repartition(7)))
    assert a.exceptAll(b).count() == 0


def brute(rows, limit):
    """Shards by splitting one bucket at a time: {(hash, bytes): (depth, bucket)} and the copies' piece sizes."""
    place, open_ = {}, [(0, 0, rows)]
    while open_:
        depth, bucket, own = open_.pop()
        if sum(b for _, b in own) <= limit:
            place |= {h: (depth, bucket) for h, _ in own}
        elif len({h for h, _ in own}) == 1:
            place[own[0][0]] = (sharding.HASH_BITS, own[0][0])
        else:
            bit = sharding.HASH_BITS - depth - 1
            for side in (0, 1):
                open_.append((depth + 1, bucket << 1 | side, [(h, b) for h, b in own if h >> bit & 1 == side]))
    return place


def test_query_matches_splitting_by_hand(spark):
    out = queries.op6_sharding(spark, "/root/testdata/sf0.01").collect()
    place = brute([(r.hash, r.bytes) for r in out], queries.SHARD_BYTES)
    assert all((r.depth, r.bucket) == place[r.hash] for r in out) and len({r.shard for r in out}) > 2
    texts = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").selectExpr("doc_id", "coalesce(octet_length(text), 0) AS n").collect()
    assert sorted((r.doc_id, r.bytes) for r in out) == sorted((r.doc_id, r.n) for r in texts)


def test_directory_points_every_hash_to_its_bucket(spark):
    rows = [(i, "x" * (i % 97)) for i in range(3000)] + [(9, "copy" * 20)] * 200
    assigned = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 4000, bits=4)
    entries, out = sharding.directory(assigned).collect(), assigned.collect()
    g = entries[0].global_depth
    assert g == max(r.depth for r in out if r.piece is None) and sum(e.n_rows for e in entries) == len(rows) and max(e.bytes for e in entries) <= 4000
    ranges = sorted({(e.first_entry, e.last_entry, e.depth, e.bucket) for e in entries if e.piece is None})
    assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))
    overflow = {(e.bucket, e.piece): (e.first_entry, e.last_entry) for e in entries if e.piece is not None}
    assert len(overflow) >= 4
    for r in out:
        entry = r.hash >> (sharding.HASH_BITS - g)
        if r.piece is None:
            assert [x[2:] for x in ranges if x[0] <= entry <= x[1]] == [(r.depth, r.bucket)]
        else:
            assert overflow[r.hash, r.piece] == (entry, entry)
    assert sharding.directory(sharding.shard(spark.createDataFrame([], "doc_id long, text string"), 10)).count() == 0


def test_copies_are_cut_alike_in_every_run(spark):
    df = spark.createDataFrame([(None, "copy" * 20, k) for k in range(300)] + [(1, "a", 0)], "doc_id long, text string, shard int")
    a, b = (sharding.shard(x, 500).select("doc_id", "shard", "piece") for x in (df, df.repartition(7)))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0 and a.filter("piece is not null").count() == 300
