"""N-gram Jaccard self-join: size-banded tiles, bitmap bounds, exact intersection.

Two documents link when 100·|A∩B| >= percent·|A∪B| over their sets of distinct word n-grams. Every link
between different sets is found; the classes are the components of the links.

1. Equal sets are one node: a 64-bit hash of the set.
2. Candidates. Linked sets have sizes in the same or neighbouring size bands, and differ in at most
   H = floor((|A|+|B|)·(100-percent)/(100+percent)) n-grams. Within a band the hash range is cut into more
   than H parts, so some part holds the same n-grams in both (pigeonhole). A set sends the hash of each part
   to the tile of that band, packed in bytes; only tiles with several sets go on. Parts without n-grams are
   sent only by sets with so many of them that all equal parts could be empty. A key that HOT sets of one
   block share is a tile known to hold several: its sets go there directly, and only one marks it in its bucket.
3. Each set has a bitmap of its hashed n-grams; bit counts bound the overlap of two sets from above. The sets
   that meet in a tile are sifted by that bound; equal tiles are sifted once, and those of more than STAR sets
   aren't gathered: their sets form one cluster. What passes forms clusters.
4. Clusters of up to WHOLE sets are compared in one tile. Greater ones are first compared in blocks, each with
   a representative of its own and of the next smaller size band: linear work, which connects near copies. What
   that leaves apart is compared exactly: all blocks but those of the greatest component with one another. In a
   tile, pairs that pass the bound are intersected as sorted arrays, if they aren't connected already.
5. The links' components give each document the least id it can reach.

Rows: null, empty and blank texts have an empty set, link with nothing and are their own class; a text with
fewer words than n is one n-gram; repeated rows fall in one class; rows with a null id are linked like others,
and a class of such rows alone has no id; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import materialize, mix64, sliced, table, WordHashes, words_of
from .graph import components

#: A cluster of up to WHOLE sets is compared in one tile; blocks of greater ones hold about BLOCK sets.
WHOLE, BLOCK = 512, 256
#: Up to so many candidate sets (about 150 bytes each) or ids are broadcast to the scan of the texts; beyond, the
#: texts are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: A tile of more sets than this isn't sifted; its sets form one cluster.
STAR = 4096
#: Sets of a block that share a key, from which on the key is a tile of its own.
HOT = 256
MOST_BITS = 8192
_FLUSH = 700_000
_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]


def ngram_set(hashes: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-grams of a sequence of word hashes; the whole sequence where it is shorter."""
    k = min(n, len(hashes))
    if not k:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        acc = np.full(len(hashes) - k + 1, np.uint64(k))
        for i in range(k):
            acc = mix64(acc * _K[0] + hashes[i : len(hashes) - k + 1 + i] * _K[1])
    return np.unique(acc)


def set_hash(s: np.ndarray) -> int:
    """64-bit hash of a set as a signed number."""
    with np.errstate(over="ignore"):
        h = mix64(np.array([mix64(s ^ _K[0]).sum(dtype=np.uint64) + np.uint64(len(s)) * _K[1]], np.uint64))
    return int(h.view(np.int64)[0])


class Bands:
    """Size bands, and the parts of each band."""

    def __init__(self, percent: int):
        self.percent = percent
        least_union = -(-100 // (100 - percent)) if percent < 100 else 1 << 40
        self.edges = [least_union - 1]  # smaller sets link only with equal ones
        while self.edges[-1] < 1 << 31:
            self.edges.append(self.edges[-1] * 100 // percent + 1)
        self.parts: list[tuple[int, int]] = []
        for k in range(len(self.edges) - 1):
            h = 2 * (self.edges[k + 1] - 1) * (100 - percent) // (100 + percent)
            smallest = self.edges[max(0, k - 1)]
            empty = (h + 1) * math.exp(-smallest / (h + 1))
            spare = math.ceil(empty + 3 * math.sqrt(empty)) if empty > 0.01 else 0
            self.parts.append((h + 1 + spare, spare))

    def of(self, size: int) -> int:
        return int(np.searchsorted(self.edges, size, "right")) - 1

    def keys(self, s: np.ndarray) -> np.ndarray:
        """The set's keys in its own band and in the next one, where it may meet greater sets."""
        band = self.of(len(s))
        if band < 0:
            return np.empty(0, np.uint64)
        sums = np.concatenate(([np.uint64(0)], np.cumsum(mix64(s ^ _K[1]), dtype=np.uint64)))
        out = []
        with np.errstate(over="ignore"):
            for k in (band, band + 1):
                m, spare = self.parts[k]
                cuts = (np.arange(1, m, dtype=np.float64) * (2.0**64 / m)).astype(np.uint64)
                at = np.concatenate(([0], np.searchsorted(s, cuts), [len(s)]))
                keys = mix64(sums[at[1:]] - sums[at[:-1]] + mix64(np.arange(m, dtype=np.uint64) + np.uint64((k + 1) << 32)))
                filled = at[1:] > at[:-1]
                out.append(keys if m - int(filled.sum()) > spare else keys[filled])
        return np.concatenate(out)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    at = np.searchsorted(b, a)
    common = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def bitmap(s: np.ndarray) -> np.ndarray:
    """Bits of a set's hashed n-grams as 64-bit words, about two bits an n-gram: a bit is given by the hash's top bits."""
    bits = min(MOST_BITS, max(128, 1 << (2 * len(s) - 1).bit_length()))
    flags = np.zeros(bits, np.uint8)
    flags[(s >> np.uint64(64 - bits.bit_length() + 1)).astype(np.int64)] = 1
    return np.packbits(flags).view(np.uint64)


def folded(maps: list[np.ndarray]) -> np.ndarray:
    """The bitmaps as rows of the shortest one's length: neighbouring bits are joined by or."""
    words = min(map(len, maps))
    out = np.zeros((len(maps), words), np.uint64)
    for i, m in enumerate(maps):
        flags = np.unpackbits(m.view(np.uint8)) if len(m) > words else None
        out[i] = m if flags is None else np.packbits(flags.reshape(64 * words, -1).any(axis=1)).view(np.uint64)
    return out


def _most(bits: np.ndarray, n: np.ndarray, i: int, j: np.ndarray) -> np.ndarray:
    """Upper bounds of the overlap of set i with sets j: a bit that only one side has is an n-gram of that side alone."""
    only_i = np.bitwise_count(bits[i] & ~bits[j]).sum(axis=1, dtype=np.int64)
    only_j = np.bitwise_count(~bits[i] & bits[j]).sum(axis=1, dtype=np.int64)
    return np.minimum(n[i] - only_i, n[j] - only_j)


def sift(nodes: np.ndarray, n: np.ndarray, maps: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Pairs that connect the sets of a tile whose overlap may be large enough."""
    if len(nodes) > STAR:
        return [(int(nodes[0]), int(x)) for x in nodes[1:]]
    order = np.argsort(n, kind="stable")
    nodes, n, bits = nodes[order], n[order], folded([maps[i] for i in order])
    label, out = np.arange(len(nodes)), []
    for i in range(len(nodes) - 1):
        j = np.arange(i + 1, int(np.searchsorted(n, n[i] * 100 // percent, "right")))
        j = j[label[j] != label[i]]
        if len(j):
            most = _most(bits, n, i, j)
            for x in j[100 * most >= percent * (n[i] + n[j] - most)]:
                if label[x] != label[i]:
                    out.append((int(nodes[i]), int(nodes[x])))
                    label[label == label[x]] = label[i]
    return out


def tile_links(ids: np.ndarray, sets: list[np.ndarray], sides: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that connect what is linked in a tile. Sides: 0 with 1 where they differ at all, else all with all."""
    n = np.array([len(s) for s in sets])
    order = np.argsort(n, kind="stable")
    ids, sets, sides, n = ids[order], [sets[i] for i in order], sides[order], n[order]
    bits, label, links, two = folded([bitmap(s) for s in sets]), np.arange(len(sets)), [], len(np.unique(sides)) > 1
    for i in range(len(sets) - 1):
        end = int(np.searchsorted(n, n[i] * 100 // percent, "right"))
        j = np.arange(i + 1, end)
        j = j[(label[j] != label[i]) & ((sides[j] != sides[i]) if two else True)]
        if not len(j):
            continue
        most = _most(bits, n, i, j)
        for x in j[100 * most >= percent * (n[i] + n[j] - most)]:
            if label[x] != label[i] and linked(sets[i], sets[x], percent):
                links.append((int(ids[i]), int(ids[x])))
                label[label == label[x]] = label[i]
    return links


_SCAN = "bucket int, ids binary, keys binary, at binary, hot binary, tile bigint, n_shingles bigint, node bigint, bits binary, doc_id {0}, row bigint"


def _tile_names(bucket: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Names of tiles that are known by their key (40 bits) and bucket."""
    return mix64((bucket.astype(np.uint64) << np.uint64(40)) + key + np.uint64(1))


def _scanned(docs: DataFrame, n: int, percent: int, groups: int) -> DataFrame:
    """Of rows (doc_id, row, text), row a hash of the text: doc_id, row, n_shingles, node (null for an empty set) and bits (its bitmap) of each;
    packed keys by bucket: ids (nodes), keys (40 bits each), at (place in ids), hot (keys with tiles of their own); and such tiles' nodes."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    names = [f.split()[0] for f in _SCAN.split(", ")]
    kinds = {"bucket": pa.int32(), "tile": pa.int64(), "n_shingles": pa.int64(), "node": pa.int64(), "row": pa.int64()} | dict.fromkeys(("ids", "keys", "at", "hot", "bits"), pa.binary())

    def rows(count: int, id_kind: pa.DataType, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[c] if isinstance(columns.get(c), pa.Array) else pa.array(columns[c], kinds[c]) if c in columns else pa.nulls(count, kinds.get(c, id_kind)) for c in names], names=names)

    def packed(nodes: list[int], keys: list[np.ndarray], id_kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        key = np.concatenate(keys)
        owner = np.repeat(np.arange(len(nodes)), [len(k) for k in keys])
        bucket, key = ((key >> np.uint64(40)) % np.uint64(groups)).astype(np.int64), key & np.uint64((1 << 40) - 1)
        order = np.lexsort((key, bucket))
        key, owner, bucket = key[order], owner[order], bucket[order]
        all_nodes = np.array(nodes, np.int64)
        start = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (bucket[1:] != bucket[:-1]))))
        size = np.diff(np.concatenate((start, [len(key)])))
        hot = np.repeat(size >= HOT, size)
        first = np.zeros(len(key), bool)
        first[start] = True
        if hot.any():
            yield rows(int(hot.sum()), id_kind, tile=_tile_names(bucket[hot], key[hot]).view(np.int64), node=all_nodes[owner[hot]])
        stay = ~hot | first
        key, owner, bucket, hot = key[stay], owner[stay], bucket[stay], hot[stay]
        out = []
        which, start = np.unique(bucket, return_index=True)
        small = lambda k: np.ascontiguousarray(k.view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()
        for b, s, e in zip(which, start, [*start[1:], len(key)], strict=True):
            own, at = np.unique(owner[s:e], return_inverse=True)
            out.append((int(b), all_nodes[own].tobytes(), small(key[s:e]), at.astype(np.uint32 if len(own) > 65535 else np.uint16).tobytes(), small(key[s:e][hot[s:e]])))
        yield rows(len(out), id_kind, **{c: [r[i] for r in out] for i, c in enumerate(("bucket", "ids", "keys", "at", "hot"))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, bands, nodes, keys, held = WordHashes(), Bands(percent), [], [], 0
        known: set[int] = set()
        id_kind = None
        for b in sliced(batches):
            id_kind = b.column(0).type
            sets = [ngram_set(memo.of(words_of(t)), n) for t in b.column(2).to_pylist()]
            hashes = [set_hash(s) if len(s) else None for s in sets]
            yield rows(b.num_rows, id_kind, doc_id=b.column(0), row=b.column(1), n_shingles=[len(s) for s in sets], node=hashes, bits=[bitmap(s).tobytes() if len(s) else None for s in sets])
            for s, h in zip(sets, hashes, strict=True):
                if h is None or h in known or not len(k := bands.keys(s)):
                    continue
                known.add(h)
                nodes.append(h)
                keys.append(k)
                held += len(k)
                if held >= _FLUSH:
                    yield from packed(nodes, keys, id_kind)
                    nodes, keys, held, known = [], [], 0, set()
            memo.trim()
        if nodes:
            yield from packed(nodes, keys, id_kind)

    return docs.mapInArrow(run, _SCAN.format(id_type))


def _wide(raw: np.ndarray) -> np.ndarray:
    """Keys of 40 bits as numbers."""
    wide = np.zeros((len(raw) // 5, 8), np.uint8)
    wide[:, :5] = raw.reshape(-1, 5)
    return wide.view(np.uint64).ravel()


def _meet(t: pa.Table) -> pa.Table:
    """The tiles of a bucket that hold several sets, as (tile, node): equal tiles once, named by a hash of their nodes. Hot ones whole, by their own names."""
    ids, keys, hot = [], [], []
    for i, k, at, h in zip(t.column("ids"), t.column("keys"), t.column("at"), t.column("hot"), strict=True):
        keys.append(_wide(np.frombuffer(k.as_buffer(), np.uint8)))
        hot.append(_wide(np.frombuffer(h.as_buffer(), np.uint8)))
        own = np.frombuffer(i.as_buffer(), np.int64)
        ids.append(own[np.frombuffer(at.as_buffer(), np.uint16 if len(own) <= 65535 else np.uint32)])
    key, node, hot = np.concatenate(keys), np.concatenate(ids), np.unique(np.concatenate(hot))
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    new = np.concatenate(([True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])))
    key, node = key[new], node[new]
    apart = np.isin(key, hot)
    named = _tile_names(np.full(int(apart.sum()), t.column("bucket")[0].as_py()), key[apart]), node[apart]
    key, node = key[~apart], node[~apart]
    start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
    size = np.diff(np.concatenate((start, [len(key)])))
    name = np.add.reduceat(mix64(node.view(np.uint64) ^ _K[0]), start) if len(start) else np.empty(0, np.uint64)
    several = np.flatnonzero(size > 1)
    several = several[np.unique(name[several], return_index=True)[1]]
    take = np.repeat(start[several], size[several]) + (np.arange(size[several].sum()) - np.repeat(np.cumsum(size[several]) - size[several], size[several]))
    tiles = np.concatenate((named[0], np.repeat(name[several], size[several])))
    return pa.table({"tile": pa.array(tiles.view(np.int64)), "node": pa.array(np.concatenate((named[1], node[take])))})


_TILES = "array<struct<tile:bigint,side:int>>"


def _blocks(per: DataFrame) -> DataFrame:
    """cluster, blocks: a map from group to its number of blocks, of rows cluster, group, c."""
    return per.groupBy("cluster").agg(F.map_from_entries(F.collect_list(F.struct("group", F.ceil(F.col("c") / F.lit(BLOCK)).cast("int")))).alias("blocks"))


def _first_tiles(members: DataFrame) -> DataFrame:
    """Where candidate sets (cluster, node, band, total, first) are compared first: small clusters whole, the others in blocks with representatives."""
    tile = lambda *k: F.xxhash64("cluster", *k).alias("tile")
    whole = members.where(F.col("total") <= WHOLE).select("node", "first", F.array(F.struct(F.col("cluster").alias("tile"), F.lit(0).alias("side"))).alias("tiles"))
    big = members.where(F.col("total") > WHOLE)
    counts = big.groupBy("cluster", F.col("band").alias("group")).agg(F.count("*").alias("c"), F.min_by("node", F.xxhash64("node")).alias("representative"))
    big = big.join(_blocks(counts), "cluster").join(counts.select("cluster", F.col("group").alias("band"), "representative"), ["cluster", "band"])
    block = F.pmod(F.xxhash64("node"), F.element_at("blocks", F.col("band"))).cast("int")
    every = lambda band: F.transform(F.sequence(F.lit(0), F.element_at("blocks", band) - 1), lambda i: F.struct(tile(band, i), F.lit(0).alias("side")))
    none = F.array().cast(_TILES)
    after = F.when(F.array_contains(F.map_keys("blocks"), F.col("band") + 1), every(F.col("band") + 1)).otherwise(none)
    own = F.array(F.struct(tile(F.col("band"), block), F.lit(0).alias("side")))
    return whole.union(big.select("node", "first", F.when(F.col("node") == F.col("representative"), F.concat(every(F.col("band")), after)).otherwise(own).alias("tiles")))


def _last_tiles(members: DataFrame, links: DataFrame) -> DataFrame:
    """Where sets of great clusters that aren't connected yet are compared: in tiles of two blocks of the same or neighbouring bands, not both of the greatest component."""
    big = members.where(F.col("total") > WHOLE).join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    sizes = big.groupBy("cluster", "root").agg(F.count("*").alias("c"))
    main = sizes.groupBy("cluster").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.count("*").alias("parts")).where("parts > 1").select("cluster", "main")
    big = materialize(big.join(main, "cluster").withColumn("group", F.col("band") * 2 + (F.col("root") == F.col("main")).cast("int")))
    big = big.join(_blocks(big.groupBy("cluster", "group").agg(F.count("*").alias("c"))), "cluster")
    count = lambda g: F.coalesce(F.try_element_at("blocks", g), F.lit(0))
    i, own, side = F.pmod(F.xxhash64("node"), F.element_at("blocks", F.col("group"))).cast("int"), F.col("group"), F.col("group") % 2
    tile = lambda g, h, x, y: F.xxhash64(F.col("cluster"), g, h, x, y).alias("tile")

    def each(other, f):
        n = count(other)
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), f)).otherwise(F.array().cast(_TILES))

    def with_group(other):
        less = other < own
        return each(other, lambda j: F.struct(F.when(less, tile(other, own, j, i)).otherwise(tile(own, other, i, j)).alias("tile"), F.when(less, 1).otherwise(0).alias("side")))

    same = each(own, lambda j: F.struct(tile(own, own, F.least(i, j), F.greatest(i, j)), F.when(i > j, 1).otherwise(0).alias("side")))
    rest = own - side  # the group of the same band that isn't the greatest component's
    tiles = [F.when(side == 0, same).otherwise(F.array().cast(_TILES)), with_group(rest + 1 - side)]
    for step in (-2, 2):
        tiles.append(with_group(rest + step))
        tiles.append(F.when(side == 0, with_group(rest + step + 1)).otherwise(F.array().cast(_TILES)))
    return big.select("node", "first", F.concat(*tiles).alias("tiles"))


def _bounded(df: DataFrame) -> DataFrame:
    """For a join's side: broadcast up to BROADCAST_ROWS rows, else shuffled."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _first_row():
    """Which row stands for a set: the one with the least id (null last), then the least text hash."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")


def link_sets(docs: DataFrame, scan: DataFrame, n: int, percent: int) -> DataFrame:
    """Links (a, b) between different sets, enough of them to connect whatever is linked."""
    spark = docs.sparkSession
    pairs = scan.where("bucket is not null").select("bucket", "ids", "keys", "at", "hot").groupBy("bucket").applyInArrow(_meet, "tile bigint, node bigint")
    meeting = materialize(pairs.union(scan.where("tile is not null").select("tile", "node")).distinct())
    sizes = meeting.groupBy("tile").agg(F.count("*").alias("c"), F.min("node").alias("least"))
    great = materialize(sizes.where(F.col("c") > STAR))

    def sifted(t: pa.Table) -> pa.Table:
        order = np.argsort(t.column("node").to_numpy(), kind="stable")
        maps = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("bits")]
        pairs = sift(t.column("node").to_numpy()[order], t.column("n_shingles").to_numpy()[order], [maps[i] for i in order], percent)
        return pa.table({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})

    sets = scan.where("n_shingles > 0")
    drawn = sets.join(meeting.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.first("n_shingles").alias("n_shingles"), F.first("bits").alias("bits"))
    edges = meeting.join(great, "tile", "left_anti").join(drawn, "node").groupBy("tile").applyInArrow(sifted, "a bigint, b bigint")
    edges = edges.union(meeting.join(great, "tile").select(F.col("least").alias("a"), F.col("node").alias("b")))
    clusters = components(edges).withColumnRenamed("root", "cluster")
    edges = [x for x in Bands(percent).edges if x < 1 << 31]
    band = F.size(F.filter(F.array(*map(F.lit, edges)), lambda x: x <= F.col("n_shingles")))
    reps = sets.groupBy("node").agg(_first_row(), F.first("n_shingles").alias("n_shingles")).join(clusters, "node").withColumn("band", band)
    total = clusters.groupBy("cluster").agg(F.count("*").alias("total"))
    members = materialize(reps.join(total, "cluster"))

    def compared(plan: DataFrame) -> DataFrame:
        plan = _bounded(materialize(plan.select("node", "tiles", F.col("first.doc_id").alias("rep"), F.col("first.row").alias("rep_row"))))
        texts = docs.join(plan, F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("row") == F.col("rep_row"))).select("node", "tiles", "text")

        def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            memo, seen = WordHashes(), set()
            for b in sliced(batches):
                sets = [ngram_set(memo.of(words_of(t)), n) for t in b.column(2).to_pylist()]
                memo.trim()
                own = []
                for s, h in zip(sets, b.column(0).to_pylist(), strict=True):
                    own.append(h not in seen and bool(len(s)) and set_hash(s) == h)  # rows may be repeated
                    if own[-1]:
                        seen.add(h)
                keep = pa.array(own, pa.bool_())
                yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep), pa.array([s.tobytes() for s, o in zip(sets, own, strict=True) if o], pa.binary())], names=["node", "tiles", "grams"])

        placed = texts.mapInArrow(grams, f"node bigint, tiles {_TILES}, grams binary").select("node", "grams", F.explode("tiles").alias("t")).select("node", "grams", "t.tile", "t.side")

        def compare(t: pa.Table) -> pa.Table:
            ids, at = np.unique(t.column("node").to_numpy(), return_index=True)
            grams = t.column("grams")
            sets = [np.frombuffer(grams[int(i)].as_buffer(), np.uint64) for i in at]
            links = tile_links(ids, sets, t.column("side").to_numpy()[at], percent)
            return pa.table({"a": pa.array([x[0] for x in links], pa.int64()), "b": pa.array([x[1] for x in links], pa.int64())})

        return placed.groupBy("tile").applyInArrow(compare, "a bigint, b bigint")

    if members.isEmpty():
        return spark.createDataFrame([], "a bigint, b bigint")
    links = compared(_first_tiles(members))
    if members.where(F.col("total") > WHOLE).isEmpty():
        return links
    links = materialize(links)
    rest = materialize(_last_tiles(members, links))
    return links if rest.isEmpty() else links.union(compared(rest))


def _classed(docs: DataFrame, n: int, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """doc_id, row (a hash of the text), n_shingles and node of every row; and of the nodes of classes with several rows, node and first, the row that stands for the class."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("row"), F.col(text_col).alias("text"))
    groups = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    scan = materialize(_scanned(docs.select("doc_id", "row", "text"), n, percent, groups))
    labels = components(link_sets(docs, scan, n, percent))
    rows = scan.where("n_shingles is not null").select("doc_id", "row", "n_shingles", "node")
    nodes = rows.where("node is not null").groupBy("node").agg(_first_row(), F.count("*").alias("rows"))
    classed = materialize(nodes.join(labels, "node", "left").where("rows > 1 or root is not null").select("node", "first", F.coalesce("root", "node").alias("root")))
    return rows, materialize(classed.join(classed.groupBy("root").agg(F.min("first").alias("of_class")), "root").select("node", F.col("of_class").alias("first")))


def jaccard_classes(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    rows, named = _classed(docs, n, percent, id_col, text_col)
    return rows.join(named, "node", "left").select("doc_id", "n_shingles", F.coalesce("first.doc_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class: the one with the least id (null last), then the least hash of its text; of repeated rows one stays.

    Rows are told by id and text, so rows that share an id, or have none, are kept or dropped each by itself. Texts without words stay. An empty table gives no rows.
    """
    rows, named = _classed(docs, n, percent, id_col, text_col)
    met = rows.join(named, "node")
    goes = ~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("row") == F.col("first.row")))
    key = [F.col("doc_id").alias("__nj_id"), F.col("row").alias("__nj_row")]
    gone = materialize(met.where(goes).select(*key).distinct())
    twice = materialize(met.where(~goes).groupBy(*key).count().where("count > 1").drop("count"))
    same = lambda side: docs[id_col].eqNullSafe(side["__nj_id"]) & (F.xxhash64(docs[text_col]) == side["__nj_row"])
    side = _bounded(gone)
    left = docs.join(side, same(side), "left_anti")
    if not twice.isEmpty():
        side = _bounded(twice)
        once = docs.join(side, same(side), "left_semi").dropDuplicates([id_col, text_col])
        left = left.join(side, same(side), "left_anti").unionByName(once)
    return left


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"), n=3, percent=90)


ORACLE_SQL = r"""
with w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as words from documents),
 s as (select doc_id, case when len(words) = 0 then [] when len(words) < 3 then [array_to_string(words, ' ')]
         else list_distinct(list_transform(range(1, len(words) - 1), lambda i: array_to_string(words[i:i+2], ' '))) end as grams from w),
 z as (select doc_id, len(grams)::bigint as n from s),
 h as (select distinct doc_id, hash(g) as g from s, unnest(s.grams) as t(g)),
 f as (select doc_id, g from (select doc_id, g, row_number() over (partition by doc_id order by c, g) as k from (select *, count(*) over (partition by g) as c from h)) join z using (doc_id) where k <= n - ceil(0.9 * n) + 1),
 p as (select distinct x.doc_id as a, y.doc_id as b from f x join f y on x.g = y.g and x.doc_id < y.doc_id join z za on za.doc_id = x.doc_id join z zb on zb.doc_id = y.doc_id where za.n * 10 >= zb.n * 9 and zb.n * 10 >= za.n * 9),
 o as (select p.a, p.b, count(*) as i from p join h x on x.doc_id = p.a join h y on y.doc_id = p.b and x.g = y.g group by p.a, p.b),
 l as (select a, b from o join z za on za.doc_id = a join z zb on zb.doc_id = b where 100 * i >= 90 * (za.n + zb.n - i)),
 e as (select a, b from l union select b, a from l),
 r as (with recursive c as (select doc_id as a, doc_id as b from z union select c.a, e.b from c join e on c.b = e.a) select a, min(b) as component_id from c group by a)
select z.doc_id, z.n as n_shingles, r.component_id from z join r on r.a = z.doc_id
"""
