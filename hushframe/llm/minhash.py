"""MinHash near-duplicates by an inverted join of signature coordinates.

1. Texts become sets of word shingles; equal sets are one class, so exact copies cost nothing further.
2. A class has a signature of `coords` minima. Classes are posted under each coordinate and its value. Values that one class
   alone holds match nothing and are skipped; a class left with fewer than `matches` postings can't reach that many
   matches and is skipped whole.
3. Prefix: two classes with `matches` equal coordinates share one of the `coords - matches + 1` rarest postings of each.
   Only these lists are merged. The other, longer lists of a pair are skipped through: whether they hold both classes is
   read off the two signatures at their coordinate, and the collisions of all coordinates are counted there. Within the
   prefix, short lists are merged pair by pair. Of a long list every class is counted against one centre; only classes
   that don't match it are counted against the rest, in blocks. Either way nothing that could match is left out, while a
   group of mutual matches costs one count a member instead of all pairs.
4. Classes joined by matches form groups. Inside a group, links are confirmed on the full sets. In a large group every
   class is first confirmed against a few pivots; the classes that hang together this way are done, and only the others
   are compared with the whole group, in blocks. A block returns a spanning forest of its links, which leaves the
   components as they are.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushframe.llm.common import BROADCAST_BYTES, checkpoint, free_name, marks, mix64, release, sequence_hash, settled, steps, word_hashes
from hushframe.llm.graph import components

COORDS, MATCHES = 48, 25
#: Posting lists up to SHORT are compared pair by pair; blocks of a long list or a large group hold about BLOCK classes.
SHORT, BLOCK = 32, 512
#: Classes of a large group that all others are confirmed against first.
PIVOTS = 4
#: Up to so many documents in groups (ids, some MB) are broadcast to pick their texts; more are picked by a shuffle.
BROADCAST_IDS = 500_000

_dice = np.random.default_rng(20)
_FLIP = _dice.integers(0, 1 << 32, (256, 1), dtype=np.uint32)
_FACTOR = _dice.integers(0, 1 << 32, (256, 1), dtype=np.uint32) | np.uint32(1)


def _sets(column, k: int) -> Iterator[list[np.ndarray]]:
    """Sorted sets of shingle hashes of the texts of a binary Arrow column, in runs of rows."""
    for _, _, data, offsets in steps(column):
        words, _, begin = word_hashes(data, offsets, fold_case=True)
        grams = sequence_hash(words, k)
        out = []
        for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
            if b - a >= k:
                out.append(np.unique(grams[a : b - k + 1]))
            else:
                out.append(sequence_hash(words[a:b], b - a) if b > a else words[:0])
        yield out


def _set_hash(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each set, from sums of mixed members."""
    sizes = np.array([len(s) for s in sets])
    out = np.zeros((2, len(sets)), np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        flat = np.concatenate([sets[i] for i in full])
        at = np.cumsum(sizes[full]) - sizes[full]
        for row, salt in enumerate((0x51ED270B7A14D5A3, 0xA3B195354A39B70D)):
            out[row, full] = np.add.reduceat(mix64(flat ^ np.uint64(salt)), at)
    return out[0].view(np.int64), out[1].view(np.int64)


def signature(members: np.ndarray, coords: int) -> np.ndarray:
    """Minima of `coords` permutations of the members' low 32 bits, as signed ints."""
    low = members.astype(np.uint32)[None, :]
    best = None
    for i in range(0, low.shape[1], 16384):
        part = ((low[:, i : i + 16384] ^ _FLIP[:coords]) * _FACTOR[:coords]).min(axis=1)
        best = part if best is None else np.minimum(best, part)
    return best.view(np.int32)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"), *marks())


def features(docs: DataFrame, k: int, coords: int = COORDS) -> DataFrame:
    """(doc_id, m1, m2, n, h1, h2, sig) of each row: hash of its text, size and hash of its shingle set (128 bits each), and its signature (empty for an empty set)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, h1, h2, flat, at = [], [], [], [], [0]
            for sets in _sets(batch.column(1), k):
                a, b = _set_hash(sets)
                h1.append(a)
                h2.append(b)
                for s in sets:
                    n.append(len(s))
                    if len(s):
                        flat.append(signature(s, coords))
                    at.append(at[-1] + coords * bool(len(s)))
            sig = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int32)))
            columns = [batch.column(0), batch.column(2), batch.column(3), pa.array(n, pa.int64()), *(pa.array(np.concatenate(h) if h else np.zeros(0, np.int64)) for h in (h1, h2)), sig]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "m1", "m2", "n", "h1", "h2", "sig"])

    return _texts(docs).mapInArrow(read, "doc_id long, m1 long, m2 long, n long, h1 long, h2 long, sig array<int>")


def shingle_sets(docs: DataFrame, k: int) -> DataFrame:
    """(h1, h2, members) of each row: its set's hash and the sorted 64-bit hashes of its shingles as bytes."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sets in _sets(batch.column(1), k):
                h1, h2 = _set_hash(sets)
                yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), pa.array([s.tobytes() for s in sets], pa.binary())], names=["h1", "h2", "members"])

    return _texts(docs).mapInArrow(read, "h1 long, h2 long, members binary")


def _forest(n: int, pairs: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a graph on 0..n-1."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for a, b in pairs.tolist():
        x, y = root(a), root(b)
        if x != y:
            parent[x] = y
            out.append((a, b))
    return out


def _edges(pairs: list[tuple[int, int]]) -> pa.Table:
    a, b = zip(*pairs, strict=True) if pairs else ((), ())
    return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def links(members: list[np.ndarray], percent: int, left: int | None = None) -> np.ndarray:
    """Pairs of positions whose sets have 100 * intersection >= percent * union; with `left`, only across that position."""
    sizes = np.array([len(s) for s in members])
    n = len(members)
    flat = np.concatenate(members)
    owner = np.repeat(np.arange(n), sizes)
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count[column] > 1
    owner, column = owner[shared], column[shared]
    place = np.cumsum(count > 1) - 1
    column = place[column]
    cut = left or 0
    common = np.zeros((cut, n - cut) if left else (n, n), np.float32)
    for start in range(0, int(place[-1]) + 1 if len(place) else 0, 4096):
        here = (column >= start) & (column < start + 4096)
        grid = np.zeros((n, 4096), np.float32)
        grid[owner[here], column[here] - start] = 1
        common += grid[:cut] @ grid[cut:].T if left else grid @ grid.T
    union = (sizes[:cut, None] + sizes[None, cut:] if left else sizes[:, None] + sizes[None, :]) - common
    good = 100 * common.astype(np.int64) >= percent * union.astype(np.int64)
    if left:
        pairs = np.argwhere(good)
        pairs[:, 1] += cut
        return pairs
    return np.argwhere(np.triu(good, 1))


def _members(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in column.to_pylist()]


def _matching(pairs: DataFrame, sigs: DataFrame, matches: int) -> DataFrame:
    """pairs(a, b) with `near`: whether the two signatures have `matches` equal coordinates."""
    a = sigs.select(F.col("cid").alias("a"), F.col("sig").alias("sig_a"))
    b = sigs.select(F.col("cid").alias("b"), F.col("sig").alias("sig_b"))
    equal = F.size(F.filter(F.zip_with("sig_a", "sig_b", lambda x, y: x == y), lambda x: x))
    return pairs.join(a, "a").join(b, "b").select("a", "b", (equal >= matches).alias("near"))


def candidates(classes: DataFrame, percent: int, coords: int, matches: int) -> DataFrame | None:
    """Edges (a, b) that keep classes(cid, n, sig) connected as all pairs with `matches` equal coordinates do; None without any."""
    value = F.shiftleft(F.col("pos").cast("long"), 32) + F.col("col").cast("long") + F.lit(1 << 31)
    posts = classes.select("cid", "n", F.posexplode("sig")).select("cid", "n", value.alias("key"))
    shared = checkpoint(posts.groupBy("key").agg(F.count("*").alias("df")).filter("df > 1"))
    held = posts.join(shared, "key").groupBy("cid", "n").agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("posts"))
    held = held.filter(F.size("posts") >= matches)
    # Postings that no other class holds come first in the order of rarity and are skipped: the rest of the prefix stays.
    prefix = F.slice("posts", F.lit(1), F.size("posts") - F.lit(matches - 1))
    posts = checkpoint(held.select("cid", "n", F.explode(prefix).alias("p")).select("cid", "n", F.col("p.key").alias("key")))
    sizes = checkpoint(posts.groupBy("key").agg(F.count("*").alias("m"), F.min("cid").alias("centre")).filter("m > 1"))
    if sizes.isEmpty():
        return None
    kept, posts = posts, posts.join(sizes, "key")
    live = checkpoint(posts.select("cid").distinct())
    sigs = checkpoint(classes.select("cid", "sig").join(live, "cid", "left_semi"))
    release(shared, live)
    short, long_ = posts.filter(F.col("m") <= SHORT), posts.filter(F.col("m") > SHORT)
    one, two = short.select("key", F.col("cid").alias("a"), F.col("n").alias("na")), short.select("key", F.col("cid").alias("b"), F.col("n").alias("nb"))
    pairs = one.join(two, "key").filter((F.col("a") < F.col("b")) & (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)).select("a", "b").distinct()
    spokes = long_.filter("cid <> centre").select(F.col("centre").alias("a"), F.col("cid").alias("b")).distinct()
    tested = checkpoint(_matching(pairs, sigs, matches).filter("near").withColumn("spoke", F.lit(False)).unionByName(_matching(spokes, sigs, matches).withColumn("spoke", F.lit(True))))
    edges = tested.filter("near").select("a", "b")
    far = tested.filter("spoke and not near").select(F.col("a").alias("centre"), F.col("b").alias("cid"))
    if not far.isEmpty():
        edges = edges.unionByName(_across(long_, far, sigs, matches))
    edges = checkpoint(edges.distinct())
    release(kept, sizes, sigs, tested)
    return edges


def _across(long_: DataFrame, far: DataFrame, sigs: DataFrame, matches: int) -> DataFrame:
    """Matches of the classes of long lists that don't match their list's centre, with all of the list, in blocks."""
    rest = checkpoint(long_.join(far, ["centre", "cid"]).select("key", "cid", "m"))
    counts = checkpoint(rest.groupBy("key").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("rows"), F.ceil(F.max("m") / F.lit(BLOCK)).cast("int").alias("cols")))
    blocks = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    deal = lambda n: F.pmod(F.xxhash64("cid"), F.col(n)).cast("int")
    left = rest.join(counts, "key").withColumn("row", deal("rows")).withColumn("col", F.explode(blocks("cols"))).join(sigs, "cid").select("key", "row", "col", "cid", "sig")
    right = long_.select("key", "cid").join(counts, "key").withColumn("col", deal("cols")).withColumn("row", F.explode(blocks("rows"))).join(sigs, "cid")
    right = right.select(F.col("key").alias("list"), F.col("row").alias("list_row"), F.col("col").alias("list_col"), F.col("cid").alias("member"), F.col("sig").alias("member_sig"))

    def compare(key, one: pa.Table, two: pa.Table) -> pa.Table:
        if not len(one) or not len(two):
            return _edges([])
        a, b = one["cid"].to_numpy(), two["member"].to_numpy()
        x, y = (c.combine_chunks().flatten().to_numpy().reshape(len(c), -1) for c in (one["sig"], two["member_sig"]))
        out = []
        for i in range(len(a)):
            hits = np.flatnonzero(((x[i] == y).sum(axis=1) >= matches) & (b != a[i]))
            out.append(np.stack([np.full(len(hits), i), len(a) + hits], axis=1))
        ids = np.concatenate([a, b])
        # the same class may stand on both sides
        same = [(i, len(a) + int(j)) for i, c in enumerate(a) for j in np.flatnonzero(b == c)]
        forest = _forest(len(ids), np.concatenate([np.array(same, int).reshape(-1, 2), *out]))
        return _edges([(int(ids[p]), int(ids[q])) for p, q in forest if ids[p] != ids[q]])

    return left.groupBy("key", "row", "col").cogroup(right.groupBy("list", "list_row", "list_col")).applyInArrow(compare, "a long, b long")


def confirmed(docs: DataFrame, classes: DataFrame, edges: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) that keep classes connected as all links among groups of `edges` do, checked on full sets."""
    groups = checkpoint(components(edges).select(F.col("node").alias("cid"), F.col("component").alias("grp")))
    sizes = checkpoint(groups.groupBy("grp").agg(F.count("*").alias("g")))
    wanted = checkpoint(groups.join(sizes, "grp").join(classes.select("cid", "doc", "h1", "h2"), "cid"))
    total = wanted.count()
    ids = wanted.select(F.col("doc").alias("doc_id")).distinct()
    # The text of a class is that of its smallest doc_id; null stands for itself.
    some = docs.join(F.broadcast(ids) if total <= BROADCAST_IDS else ids, docs["doc_id"].cast("long").eqNullSafe(ids["doc_id"]), "left_semi")
    sets = checkpoint(wanted.join(shingle_sets(some, k), ["h1", "h2"]).dropDuplicates(["cid"]).select("cid", "grp", "g", "members"))
    bins = max(1, -(-total // (BLOCK // 2)))
    small = sets.filter(F.col("g") <= BLOCK).withColumn("bin", F.pmod(F.xxhash64("grp"), F.lit(bins)))

    def inside(table: pa.Table) -> pa.Table:
        table = table.sort_by("grp")
        ids, grp, out = table["cid"].to_pylist(), table["grp"].to_numpy(), []
        starts = np.flatnonzero(np.diff(grp, prepend=grp[0] - 1))
        for a, b in zip(starts, [*starts[1:], len(grp)], strict=True):
            found = links(_members(table["members"].slice(a, b - a)), percent)
            out.extend((ids[a + i], ids[a + j]) for i, j in _forest(b - a, found))
        return _edges(out)

    done = small.groupBy("bin").applyInArrow(inside, "a long, b long")
    big = sets.filter(F.col("g") > BLOCK)
    if not big.isEmpty():
        done = done.unionByName(_large(big, percent))
    done = checkpoint(done)
    release(groups, sizes, wanted, sets)
    return done


def _large(big: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of sets(cid, grp, g, members) that keep the classes of each group connected as all its links do."""
    one = lambda i: F.min_by("cid", F.xxhash64("cid", F.lit(i)))
    picked = big.groupBy("grp", "g").agg(F.array(*[one(i) for i in range(PIVOTS)]).alias("p"))
    picked = picked.select("grp", "g", F.explode(F.array_distinct("p")).alias("cid"))
    pivots = picked.join(big.select("cid", "members"), "cid")
    parts = F.ceil(F.col("g") / F.lit(BLOCK)).cast("int")
    left = big.withColumn("part", F.pmod(F.xxhash64("cid"), parts).cast("int")).select("grp", "part", "cid", "members")
    right = pivots.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).select(F.col("grp").alias("group"), F.col("part").alias("slot"), F.col("cid").alias("pivot"), F.col("members").alias("pivot_members"))

    def near_pivots(key, table: pa.Table, pivots: pa.Table) -> pa.Table:
        sets = _members(table["members"])
        sizes = np.array([len(s) for s in sets], np.int64)
        hits: list[list[int]] = [[] for _ in sets]
        if sets:
            flat, at = np.concatenate(sets), np.cumsum(sizes) - sizes
            for pivot, own in sorted(zip(pivots["pivot"].to_pylist(), _members(pivots["pivot_members"]), strict=True)):
                same = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
                common = np.add.reduceat(same.astype(np.int64), at)
                for i in np.flatnonzero(100 * common >= percent * (sizes + len(own) - common)).tolist():
                    hits[i].append(pivot)
        return pa.table([table["grp"], table["cid"], pa.array(hits, pa.list_(pa.int64()))], names=["grp", "cid", "hits"])

    marked = left.groupBy("grp", "part").cogroup(right.groupBy("group", "slot")).applyInArrow(near_pivots, "grp long, cid long, hits array<long>")
    marked = checkpoint(marked)

    def core(table: pa.Table) -> pa.Table:
        # Pivots that one class hangs on hang together; the part with most classes is the group's core.
        patterns, counts = table["hits"].to_pylist(), table["n"].to_pylist()
        ids = sorted({p for pattern in patterns for p in pattern})
        part = {p: p for p in ids}
        for pattern in patterns:
            joined = {part[p] for p in pattern}
            part = {p: min(joined) if q in joined else q for p, q in part.items()}
        held = Counter()
        for pattern, n in zip(patterns, counts, strict=True):
            held[part[pattern[0]]] += n
        best = max(held, key=lambda p: (held[p], -p))
        return pa.table([table["grp"].slice(0, 1), pa.array([[p for p in ids if part[p] == best]], pa.list_(pa.int64()))], names=["grp", "core"])

    # At most 2^PIVOTS different hits a group.
    patterns = marked.filter(F.size("hits") > 0).groupBy("grp", "hits").agg(F.count("*").alias("n"))
    cores = patterns.groupBy("grp").applyInArrow(core, "grp long, core array<long>")
    rest = checkpoint(marked.join(cores, "grp").filter(~F.arrays_overlap("hits", "core")).select("cid"))
    stars = marked.select(F.explode("hits").alias("a"), F.col("cid").alias("b")).filter("a <> b")
    if rest.isEmpty():
        return stars
    rows = big.join(rest, "cid", "left_semi")
    cells = checkpoint(rows.groupBy("grp").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("n_rows"), F.max(parts).alias("n_cols")))
    blocks = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    deal = lambda n, salt: F.pmod(F.xxhash64("cid", F.lit(salt)), F.col(n)).cast("int")
    one_side = rows.join(cells, "grp").withColumn("row", deal("n_rows", 1)).withColumn("col", F.explode(blocks("n_cols"))).select("grp", "row", "col", "cid", "members")
    other = big.join(cells, "grp").withColumn("col", deal("n_cols", 2)).withColumn("row", F.explode(blocks("n_rows")))
    other = other.select(F.col("grp").alias("group"), F.col("row").alias("cell_row"), F.col("col").alias("cell_col"), F.col("cid").alias("member"), F.col("members").alias("member_set"))

    def across(key, table: pa.Table, others: pa.Table) -> pa.Table:
        if not len(table) or not len(others):
            return _edges([])
        # A class may stand on both sides: it is linked with itself there, which joins its two places.
        ids = [*table["cid"].to_pylist(), *others["member"].to_pylist()]
        found = links(_members(table["members"]) + _members(others["member_set"]), percent, len(table))
        return _edges([(ids[i], ids[j]) for i, j in _forest(len(ids), found) if ids[i] != ids[j]])

    both = one_side.groupBy("grp", "row", "col").cogroup(other.groupBy("group", "cell_row", "cell_col"))
    return stars.unionByName(both.applyInArrow(across, "a long, b long"))


def _grouped(docs: DataFrame, k: int, percent: int, coords: int, matches: int) -> DataFrame:
    """(doc_id, m1, m2, n, h1, h2, component_id, cluster) of each row; cluster names its group, null for an empty set."""
    feats = checkpoint(features(docs, k, coords))
    some = feats.filter("n > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("doc"), F.max("n").alias("n"), F.first("sig").alias("sig"))
    classes = checkpoint(some.withColumn("cid", F.monotonically_increasing_id()))
    edges = candidates(classes.select("cid", "n", "sig"), percent, coords, matches)
    heads = classes.select("h1", "h2", F.col("doc").alias("component_id"), F.col("cid").alias("cluster"))
    if edges is not None:
        linked = components(confirmed(docs, classes, edges, k, percent))
        named = linked.join(classes.select(F.col("cid").alias("node"), "doc"), "node")
        least = checkpoint(named.groupBy("component").agg(F.min("doc").alias("least")))
        named = checkpoint(named.join(least, "component").select(F.col("node").alias("cid"), "least", "component"))
        heads = classes.join(named, "cid", "left")
        heads = heads.select("h1", "h2", F.when(F.col("component").isNull(), F.col("doc")).otherwise(F.col("least")).alias("component_id"), F.coalesce("component", "cid").alias("cluster"))
    heads = checkpoint(heads)
    release(classes, edges)
    columns = ["doc_id", "m1", "m2", "n", "h1", "h2"]
    out = feats.filter("n > 0").select(columns).join(heads, ["h1", "h2"])
    empty = feats.filter("n = 0").select(*columns, F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("cluster"))
    return out.unionByName(empty)


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, coords: int = COORDS, matches: int = MATCHES) -> DataFrame:
    """Component of each row of docs(doc_id, text): (doc_id, n_shingles, component_id, kept, h1, h2).

    Texts are lower-cased (A-Z) and cut into words at space, \\t, \\n, \\v, \\f and \\r; the set of a text holds its
    different shingles of k words, with fewer words the whole sequence as one. Texts whose sets have
    100 * intersection >= percent * union are linked; component_id is the smallest doc_id reachable. A null text or one
    without words has an empty set, is linked with nothing and is its own component. Rows with a null doc_id take part; a
    component of null ids alone has component_id null and is kept. Rows that repeat a doc_id are judged each by its text.
    An empty table gives no rows; other columns are ignored. h1, h2: hash of the set, equal for equal sets. matches: equal
    coordinates (of coords) from which a pair is confirmed; a pair with a similarity of 0.8 has fewer than 25 of 48 in 3 of
    a million cases.
    """
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    return _grouped(docs, k, percent, coords, matches).select("doc_id", F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"), "h1", "h2")


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80, coords: int = COORDS, matches: int = MATCHES) -> DataFrame:
    """`docs` with one row of each group of near-duplicates: of its smallest doc_id (null only if all are), the text of smallest hash.

    Groups as of `near_duplicates`. Rows equal in doc_id and text count as one row, of which one stays, also where the text
    is null or has no word; other rows without words all stay. An empty table stays empty; all columns are kept as they
    are. The decision is made on keys; texts are shuffled only if the rows to drop are too many to broadcast.
    """

    def decide() -> DataFrame:
        rows = _grouped(docs.select("doc_id", "text"), k, percent, coords, matches)
        unit = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "m1", "m2")
        units = rows.groupBy("doc_id", "m1", "m2", "cluster").agg(F.count("*").alias("copies"))
        heads = units.filter("cluster is not null").groupBy("cluster").agg(F.min(unit).alias("head"))
        judged = units.join(heads, "cluster", "left").withColumn("stays", F.col("head").isNull() | F.col("head").eqNullSafe(unit))
        # Only rows that go, or are there more than once, need a word.
        return judged.filter("not stays or copies > 1").select("doc_id", "m1", "m2", "stays")

    decided = settled(decide)
    doc, one, two, stays = (free_name(docs, n) for n in ("_doc", "_one", "_two", "_stays"))
    decided = decided.select(F.col("doc_id").alias(doc), F.col("m1").alias(one), F.col("m2").alias(two), F.col("stays").alias(stays))
    if decided.count() * 64 <= BROADCAST_BYTES:
        decided = F.broadcast(decided)
    m1, m2 = marks()
    on = docs["doc_id"].cast("long").eqNullSafe(F.col(doc)) & (m1 == F.col(one)) & (m2 == F.col(two))
    marked = docs.join(decided, on, "left")
    once = marked.filter(F.col(stays)).dropDuplicates([doc, one, two]).select(*docs.columns)
    return marked.filter(F.col(stays).isNull()).select(*docs.columns).unionByName(once)
