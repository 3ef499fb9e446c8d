"""Near duplicates: many universal hash minima, banding, verification on full sets, connected components.

A text's set holds the hashes of its distinct five-word shingles (words are runs of non-white space, A-Z in
lower case; a text of fewer words is one shingle). Universal hash functions give its signature; bands of its minima
make buckets. How many bands of how many minima there are follows from the similarity asked for, so that a pair
at that similarity is missed with probability MISS at most. Texts with equal words are one node from the start.

Links inside a bucket: first all members against the least one, by signature, then on full sets. Where members of a
bucket are still in several components, it is found which components alike signatures connect: all members against
each other in a bucket of at most TILE; those of larger buckets only where they share one of the first shingles of their
sets. In the order of rising counts, two sets of the similarity do share one, so the passages that many texts have
in common bring nobody together. That makes clusters, each text in one at most; in each cluster, tiles of bounded
size compare full sets of all texts of unlike components. A tile gives a spanning forest, not all its pairs. No bucket is
dropped or capped. Texts of a cluster's largest component are copied once for each TILE texts of the others, those once for
each TILE of all: only many texts that are almost similar enough, but not, cost more than in proportion.

Null and blank texts have an empty set, are linked with nothing and stay. A row without doc_id is linked with
nothing and stays (component null). Rows that repeat a doc_id are one document if their texts are equal;
otherwise each is linked by its own text, and component_id is the least doc_id that its text reaches. Any long is a
doc_id. Ties need no rule: links have no order. An empty table gives an empty one. Other columns of docs are left out
by near_duplicates(), passed on as they are, whatever their names, by keep_representatives().
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import batches, field, hashable, quoted, skewed_join, stage
from quillspark.llm.components import components

SHINGLE, PERCENT = 5, 85
#: A pair at the similarity shares no band with this probability; minima of a signature at most.
MISS, MINIMA = 2.5e-7, 135
#: Standard deviations below the similarity down to which signatures may agree: about one pair in a million agrees less.
DEVIATIONS = 5.4
#: Rows and shingles of a tile on each side; identifiers up to which they are broadcast (24 bytes each).
TILE, TILE_SHINGLES, BROADCAST_ROWS = 1024, 1 << 19, 100_000
#: Counters of shingles: they only order shingles, so shingles may share one.
COUNTERS = 1 << 20

SIGNATURES = "doc_id long, n_shingles long, text_key binary, signature binary"


def banding(percent: int) -> tuple[int, int]:
    """Bands, and minima of each: the longest bands that miss few enough within MINIMA."""
    for rows in range(12, 0, -1):
        bands = math.ceil(math.log(MISS) / math.log1p(-((percent / 100) ** rows))) if percent < 100 else 1
        if bands * rows <= MINIMA or rows == 1:
            return bands, rows
    raise AssertionError


def minima_of(percent: int) -> int:
    bands, rows = banding(percent)
    return bands * rows


def least_agreement(percent: int) -> float:
    """Share of equal minima that pairs of the similarity have at least."""
    t = percent / 100
    return t - DEVIATIONS * math.sqrt(t * (1 - t) / minima_of(percent))


@lru_cache(maxsize=4)
def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(20_231))
    return rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[list[bytes]]]:
    """Sorted distinct shingle hashes of all texts one after the other, how many each has, and their words."""
    from xxhash import xxh3_64_intdigest

    words = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]
    seen: dict[bytes, int] = {}
    index = np.fromiter((seen.setdefault(w, len(seen)) for ws in words for w in ws), np.int64)
    hashes = np.fromiter(map(xxh3_64_intdigest, seen), np.uint64, len(seen))
    h = _mix(hashes)[index]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    times = np.uint64(0x9E3779B97F4A7C15)
    rolled = np.zeros(max(0, len(h) - SHINGLE + 1), np.uint64)
    for k in range(SHINGLE):
        rolled = rolled * times + h[k : k + len(rolled)]
    rolled = _mix(rolled)
    out, counts, at = [], np.zeros(len(words), np.int64), 0
    for i, n in enumerate(sizes.tolist()):
        if n >= SHINGLE:
            own = np.unique(rolled[at : at + n - SHINGLE + 1])
        elif n:
            own = np.zeros(1, np.uint64)
            for x in h[at : at + n]:
                own = own * times + x
            own = _mix(own + np.uint64(n))
        else:
            own = np.zeros(0, np.uint64)
        out.append(own)
        counts[i] = len(own)
        at += n
    return np.concatenate(out), counts, words


def signatures(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """A row of SIGNATURES for each row of docs (doc_id, text)."""
    n = minima_of(percent)

    def run(rows: Iterator) -> Iterator:
        import pyarrow as pa
        from xxhash import xxh3_128_digest

        a, b = _functions(n)
        for batch in batches(rows):
            ids, texts = zip(*batch, strict=True)
            x, counts, words = shingles(texts)
            some = counts > 0
            minima = np.zeros((len(texts), n), np.uint32)
            if some.any():
                starts = (np.cumsum(counts) - counts)[some]
                y = np.empty_like(x)
                for k in range(n):
                    np.multiply(x, a[k], out=y)
                    np.add(y, b[k], out=y)
                    minima[some, k] = np.minimum.reduceat(y, starts) >> np.uint64(32)
            keys = [xxh3_128_digest(b" ".join(w)) for w in words]
            raw = [m.tobytes() if c else None for m, c in zip(minima, counts, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(counts), pa.array(keys, pa.binary()), pa.array(raw, pa.binary())], ["doc_id", "n_shingles", "text_key", "signature"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SIGNATURES)


def shingle_sets(docs: DataFrame) -> DataFrame:
    """text_key, shingles (sorted 64-bit hashes, as bytes) of each row of docs (text)."""

    def run(rows: Iterator) -> Iterator:
        import pyarrow as pa
        from xxhash import xxh3_128_digest

        for batch in batches(rows, text=0):
            x, counts, words = shingles([t for (t,) in batch])
            raw, ends = x.tobytes(), 8 * np.cumsum(counts)
            sets = [raw[a:b] for a, b in zip((ends - 8 * counts).tolist(), ends.tolist(), strict=True)]
            keys = [xxh3_128_digest(b" ".join(w)) for w in words]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sets, pa.binary())], ["text_key", "shingles"])

    return docs.select("text").mapInArrow(run, "text_key binary, shingles binary")


def _sets_of(needed: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, shingles of the nodes needed (node)."""
    told = stage(needed.join(nodes.select("node", "doc_id", "text_key"), "node"), "needed")
    ids = told.select("doc_id").distinct()
    if told.count() <= BROADCAST_ROWS:
        ids, told = F.broadcast(ids), F.broadcast(told)
    sets = shingle_sets(docs.select(F.col("doc_id").cast("long"), "text").join(ids, "doc_id", "left_semi"))
    # rows that repeat id and text have one set
    return stage(sets.join(told.select("node", "text_key"), "text_key").groupBy("node").agg(F.first("shingles").alias("shingles")), "sets")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()


def _with_ends(pairs: DataFrame, values: DataFrame, column: str) -> DataFrame:
    """a, b, left, right: a value of both ends of each pair. Many pairs may share an end a."""
    left = values.select(F.col("node").alias("a"), F.col(column).alias("left"))
    right = values.select(F.col("node").alias("b"), F.col(column).alias("right"))
    return skewed_join(pairs.join(right, "b"), left, "a", pairs).select("a", "b", "left", "right")


def _alike(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose signatures agree enough."""
    n, least = minima_of(percent), least_agreement(percent)

    def run(rows: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in rows:
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                left, right = (np.frombuffer(b"".join(c.to_pylist()), np.uint32).reshape(-1, n) for c in part.columns[2:])
                good = (left == right).sum(1) >= least * n
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(good)) for c in part.columns[:2]], ["a", "b"])

    return _with_ends(pairs, nodes, "signature").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of which 100 * intersection >= percent * union, on full sets."""

    def run(rows: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches(rows, 256, 1 << 22, 2):
            out = []
            for a, b, left, right in batch:
                x, y = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    out.append((a, b))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])

    return _with_ends(pairs, _sets_of(_ends(pairs), docs, nodes), "shingles").mapInArrow(run, "a long, b long").distinct()


def _grouped(rows: Iterator, keys: int, text: int) -> Iterator[list[tuple]]:
    """Lists of rows in a row that share their first columns."""
    held: list[tuple] = []
    for batch in batches(rows, 1024, 1 << 22, text):
        for row in batch:
            if held and row[:keys] != held[0][:keys]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _tiled(rows: DataFrame, key: str, weight: str | None = None) -> DataFrame:
    """rows (key, node, component, ...) of groups with several components, in the tiles (i, j) of their group that each is part of.

    Rows of a group's largest component are dealt apart from the others: they never meet each other, only the others.
    Each pair of unlike components meets in one tile at least; a group that fits is one tile."""
    counts = rows.groupBy(key, "component").agg(F.count("*").alias("n"), (F.sum(weight) if weight else F.lit(0)).alias("w"))
    both = counts.groupBy(key).agg(F.count("*").alias("components"), F.sum("n").alias("size"), F.sum("w").alias("w"), F.max(F.struct("n", "w", "component")).alias("top")).where("components > 1")

    def tiles(n, w):
        return F.greatest(F.ceil(n / TILE), F.ceil(w / TILE_SHINGLES)).cast("int")

    fits = tiles(F.col("size"), F.col("w")) <= 1
    few = F.when(fits, 1).otherwise(tiles(F.col("size") - F.col("top.n"), F.col("w") - F.col("top.w")))
    many = F.when(fits, 0).otherwise(tiles(F.col("top.n"), F.col("top.w")))
    plan = stage(both.select(key, "size", few.alias("few"), many.alias("many"), F.when(~fits, F.col("top.component")).alias("top")), "tiles")
    dealt = skewed_join(rows, plan.drop("size"), key, sizes=plan)
    large = F.col("component").eqNullSafe(F.col("top"))
    number = F.pmod(F.xxhash64("node"), F.when(large, F.col("many")).otherwise(F.col("few"))).cast("int")
    dealt = dealt.withColumn("own", number + F.when(large, F.col("few")).otherwise(0)).withColumn("last", F.when(large, F.col("few")).otherwise(F.col("few") + F.col("many")) - 1)
    spread = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last"))))
    return spread.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("own", "other", "few", "many", "top", "last")


def _edges(tiles: DataFrame, key: str, value: str, find) -> DataFrame:
    """What find (rows of a tile: pairs) says of all tiles, as rows a, b."""

    def run(rows: Iterator) -> Iterator:
        import pyarrow as pa

        out: list[tuple[int, int]] = []
        for tile in _grouped(rows, 3, 5):
            out += find(tile)
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])

    ordered = tiles.select(key, "i", "j", "node", "component", value).repartition(key, "i", "j").sortWithinPartitions(key, "i", "j", "node")
    return ordered.mapInArrow(run, "a long, b long").distinct()


def _joined(part: np.ndarray, k: int, others: np.ndarray, node: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links row k with others, one for each part they are in, and makes these parts one."""
    for x in others.tolist():
        if part[x] != part[k]:
            part[part == part[x]] = part[k]
            yield int(node[k]), int(node[x])


def _forest(n: int, least: float):
    """Pairs (of _, _, _, node, component, signature) that agree in enough minima: enough of them to hold together all that such pairs connect."""

    def find(rows: list[tuple]) -> Iterator[tuple[int, int]]:
        part = np.unique([r[4] for r in rows], return_inverse=True)[1]
        if part.max() == 0:
            return
        node = np.array([r[3] for r in rows])
        signature = np.frombuffer(b"".join(r[5] for r in rows), np.uint32).reshape(-1, n)
        for k in range(len(rows) - 1):
            rest = k + 1 + np.flatnonzero(part[k + 1 :] != part[k])
            if len(rest):
                same = (signature[rest] == signature[k]).sum(1)
                yield from _joined(part, k, rest[same >= least * n], node)

    return find


def _exact(percent: int):
    """Like _forest on (_, _, _, node, component, shingles), by the sets themselves."""

    def find(rows: list[tuple]) -> Iterator[tuple[int, int]]:
        part = np.unique([r[4] for r in rows], return_inverse=True)[1]
        if part.max() == 0:
            return
        node = np.array([r[3] for r in rows])
        sets = [np.frombuffer(r[5], np.uint64) for r in rows]
        sizes = np.array(list(map(len, sets)))
        starts = np.cumsum(sizes) - sizes
        dense = np.unique(np.concatenate(sets), return_inverse=True)[1]
        mark = np.zeros(int(dense.max()) + 1, np.int32)
        for k in range(len(rows) - 1):
            small, large = np.minimum(sizes, sizes[k]), np.maximum(sizes, sizes[k])
            open_ = (part != part[k]) & (100 * small >= percent * large)
            open_[: k + 1] = False
            rest = np.flatnonzero(open_)
            if not len(rest):
                continue
            own = dense[starts[k] : starts[k] + sizes[k]]
            mark[own] = 1
            if 4 * len(rest) < len(rows):
                both = np.array([int(mark[dense[starts[x] : starts[x] + sizes[x]]].sum()) for x in rest.tolist()])
            else:
                both = np.add.reduceat(mark[dense], starts)[rest]
            mark[own] = 0
            yield from _joined(part, k, rest[100 * both >= percent * (sizes[rest] + sizes[k] - both)], node)

    return find


def _clusters(members: DataFrame, labels: DataFrame, links: DataFrame, docs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """cluster, node, component: of clusters, by alike signatures, that hold more than one component."""
    find = _forest(minima_of(percent), least_agreement(percent))
    of = F.coalesce("component", "node").alias("component")
    told = stage(members.where("size > 2").join(labels, "node", "left").select("bucket", "node", "size", of), "told")
    mixed = stage(told.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.first("size").alias("size")).where("low <> high").select("bucket", "size"), "mixed")
    few = told.where(F.col("size") <= TILE).join(mixed.select("bucket"), "bucket").join(nodes.select("node", "signature"), "node")
    forest = _edges(few.withColumns({"i": F.lit(0), "j": F.lit(0)}), "bucket", "signature", find)
    large = mixed.where(F.col("size") > TILE)
    if not large.isEmpty():
        opened = stage(skewed_join(told.where(F.col("size") > TILE).drop("size"), large.select("bucket"), "bucket", sizes=large).select("node", "component").distinct(), "open")
        met = stage(_first_shingles(_sets_of(opened.select("node"), docs, nodes), percent).join(opened, "node"), "first")
        dealt = _tiled(met, "shingle")
        forest = forest.unionByName(_edges(dealt.join(nodes.select("node", "signature"), "node"), "shingle", "signature", find))
    forest = stage(forest, "forest")
    if forest.isEmpty():
        return forest.select(F.col("a").alias("cluster"), F.col("a").alias("node"), F.col("b").alias("component"))
    wide = components(links.unionByName(forest))
    both = wide.select(F.col("component").alias("cluster"), "node").unionByName(wide.select(F.col("component").alias("cluster"), F.col("component").alias("node")).distinct())
    open_ = both.join(_ends(forest), "node").select("cluster").distinct()
    return both.join(open_, "cluster").join(labels, "node", "left").select("cluster", "node", of)


def _exact_links(clusters: DataFrame, docs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Links between unlike components of a cluster: in tiles of at most about TILE_SHINGLES shingles and TILE rows a side."""
    sized = stage(clusters.join(nodes.select("node", "n_shingles"), "node"), "sized")
    full = _tiled(sized, "cluster", "n_shingles").join(_sets_of(clusters.select("node"), docs, nodes), "node")
    return _edges(full, "cluster", "shingles", _exact(percent))


def _counts(sets: DataFrame) -> np.ndarray:
    """How often a shingle of each of COUNTERS classes occurs."""

    def run(rows: Iterator) -> Iterator:
        import pyarrow as pa

        count = np.zeros(COUNTERS, np.int64)
        for batch in rows:
            for raw in batch.column(0).to_pylist():
                count += np.bincount((np.frombuffer(raw, np.uint64) % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS) if len(raw) > COUNTERS else 0
                if len(raw) <= COUNTERS:
                    np.add.at(count, (np.frombuffer(raw, np.uint64) % np.uint64(COUNTERS)).astype(np.int64), 1)
        some = np.flatnonzero(count)
        for i in range(0, len(some), 65_536):
            own = some[i : i + 65_536]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(count[own])], ["counter", "n"])

    # at most COUNTERS rows
    told = sets.select("shingles").mapInArrow(run, "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(COUNTERS, np.int64)
    out[told["counter"].to_numpy()] = told["n"].to_numpy()
    return out


def _first_shingles(sets: DataFrame, percent: int) -> DataFrame:
    """shingle, node: the rarest shingles of each set, enough of them that two sets of the similarity share one."""
    counts = sets.sparkSession.sparkContext.broadcast(_counts(sets))

    def run(rows: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in rows:
            for node, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x = np.frombuffer(raw, np.uint64)
                n = len(x) + (-percent * len(x) // 100) + 1
                first = x[np.lexsort((x, counts.value[(x % np.uint64(COUNTERS)).astype(np.int64)]))[:n]]
                yield pa.RecordBatch.from_arrays([pa.array(first.view(np.int64)), pa.array(np.full(len(first), node, np.int64))], ["shingle", "node"])

    return sets.select("node", "shingles").mapInArrow(run, "shingle long, node long")


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text)."""
    bands, rows = banding(percent)
    signed = stage(signatures(docs, percent), "signatures")
    able = signed.where("n_shingles > 0 and doc_id is not null")
    texts = able.groupBy("text_key").agg(F.min("doc_id").alias("doc_id"), F.first("signature").alias("signature"), F.first("n_shingles").alias("n_shingles"), F.count("*").alias("size"))
    nodes = stage(texts.withColumn("node", F.monotonically_increasing_id()), "nodes")
    band = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.substring("signature", i * (4 * rows) + 1, F.lit(4 * rows))))
    hashed = nodes.select("node", band.alias("band", "minima")).select("node", F.xxhash64("band", "minima").alias("bucket"))
    buckets = stage(hashed.groupBy("bucket").agg(F.min("node").alias("least"), F.count("*").alias("size")).where("size > 1"), "buckets")
    members = stage(skewed_join(hashed, buckets, "bucket", sizes=buckets).select("bucket", "node", "least", "size"), "members")
    pairs = stage(members.where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    first = stage(_alike(pairs, nodes, percent), "pairs")
    links = stage(_verified(first, docs, nodes, percent), "links")
    labels = components(links)
    clusters = stage(_clusters(members, labels, links, docs, nodes, percent), "clusters")
    if not clusters.isEmpty():
        labels = components(links.unionByName(stage(_exact_links(clusters, docs, nodes, percent), "links")))
    # of a component: the least doc_id of its texts
    own = nodes.select("node", "doc_id")
    tops = labels.select("component").distinct().join(own.withColumnRenamed("node", "component"), "component")
    least = labels.join(own, "node").select("component", "doc_id").unionByName(tops).groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of = labels.join(least, "component").select("node", "component_id").unionByName(least.select(F.col("component").alias("node"), "component_id"))
    classes = nodes.join(of, "node", "left").select("text_key", F.coalesce("component_id", "doc_id").alias("component_id"))
    told = skewed_join(able.select("text_key", "doc_id", "n_shingles"), classes, "text_key", sizes=nodes).select("doc_id", "n_shingles", "component_id")
    alone = signed.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return told.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_representatives(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of docs whose document stands for its component; of rows that repeat a doc_id, one."""
    told = stage(near_duplicates(docs, percent), "near-duplicates")
    gone = told.where("not kept and doc_id is not null").select("doc_id").distinct()
    repeated = not told.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty()
    if repeated:  # an id stays if one of its rows does
        gone = gone.join(told.where("kept"), "doc_id", "left_anti")
    # few ids go: written out, their size tells Catalyst whether the texts have to move at all
    kept = docs.join(stage(gone, "gone"), "doc_id", "left_anti").select(*map(quoted, docs.columns))
    if repeated:
        packed = kept.where("doc_id is not null").select("doc_id", F.struct(*map(quoted, docs.columns)).alias("doc"), F.struct(F.xxhash64("text"), F.xxhash64(*hashable(kept))).alias("by"))
        one = packed.groupBy("doc_id").agg(F.min_by("doc", "by").alias("doc")).select(*[field("doc", c) for c in docs.columns])
        kept = one.unionByName(kept.where("doc_id is null"))
    return kept
