"""Documents linked by the Jaccard similarity of their word shingles, by parity sketches and pigeonholes.

A shingle sets one bit of a sketch by exclusive or, so two sketches differ in no more bits than the sets have elements
of their own. Two sets at the threshold differ in at most d elements, for a size band a known number; of d + 1 pieces of
their sketches one is equal. Joining equal pieces of a band therefore finds every link; sets of shingles decide.

Pieces without a set bit are equal in many documents. With d + 1 + z pieces, z + 1 are equal: a document leaves out its
empty pieces when it has z or fewer, since then a link has another piece, and gives them all when it has more.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, among, batches_of, dropped, mixed, partitions, rows_of, shingle_hashes, without, written
from .graph import components

#: Sizes of one band differ by this factor at most.
BAND = 1.25
_edges = sorted({int(BAND**k) for k in range(200)})
#: Share of its pieces that a class must have in common with the smallest or largest of their buckets to be compared with it at once.
SHARED = 0.15
#: The binary logarithm of the bits of a piece.
PIECE_BITS = 20
#: Bits of the sketch that pairs in one bucket are compared by, least and most, how many a shingle, and members of a block there.
MINI_BITS, SPREAD, BLOCK = (1024, 32768), 8, 256
#: Spokes that meet one copy of their hub's text, and rows of buckets in one group.
SPOKES, GROUP = 1024, 8192


@cache
def band_of(size: int) -> int:
    return bisect_right(_edges, size) - 1


@cache
def pieces_of(band: int, share: int) -> tuple[int, int]:
    """Pieces of a band's sketches, and how many empty ones a document leaves out; share is the threshold in hundredths.

    A linked pair, the smaller in the band, differs in so many elements at most that one more piece than those and the
    empty ones left out must be equal.
    """
    size = _edges[band + 1] - 1
    pieces = (size + size * 100 // share) * (100 - share) // (100 + share) + 1
    return pieces + pieces // 16, pieces // 16


@cache
def bands_of(size: int, share: int) -> tuple[int, ...]:
    """The bands of the sets that can be the smaller of a pair with a set of this size, its own among them."""
    return tuple(range(band_of(-(-size * share // 100)), band_of(size) + 1))


_words = WordHashes()


def shingle_set(raw: bytes | None, n: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles; A-Z in lower case, words between ASCII white space."""
    words = (raw or b"").lower().split()
    known = _words
    return np.unique(shingle_hashes(np.array([known[w] for w in words], np.uint64), n))


def sketch(hashes: np.ndarray, pieces: int) -> np.ndarray:
    """A hash of the parities in each piece of 2^PIECE_BITS bits, 0 where none is odd; sorted hashes are grouped by piece.

    Exclusive or of a value for each bit takes a bit set twice out again, as its parity does, so the piece itself is
    never laid out. Equal pieces have equal hashes; wide pieces keep single shingles of strangers apart.
    """
    out = np.zeros(pieces, np.uint64)
    at = ((hashes >> np.uint64(32)) * np.uint64(pieces)) >> np.uint64(32)
    starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    out[at[starts]] = np.bitwise_xor.reduceat(mixed((hashes & np.uint64((1 << PIECE_BITS) - 1)) + np.uint64(1)), starts)
    return out


def given_keys(hashes: np.ndarray, band: int, share: int) -> np.ndarray:
    """Hashes of band, place and piece of the pieces that a document is joined by in a band."""
    count, spare = pieces_of(band, share)
    found = sketch(hashes, count)
    at = np.flatnonzero(found)
    if count - len(at) > spare:
        at = np.arange(count)
    return mixed(found[at] ^ mixed(at.astype(np.uint64) + (np.uint64(band + 1) << np.uint64(32)))).view(np.int64)


def mini_sketch(hashes: np.ndarray) -> bytes:
    """Parities of about SPREAD bits for each shingle; halves added by exclusive or are the sketch of half the bits.

    Few elements then share a bit, so sketches of sets that just fail the share seldom look as if they had it.
    """
    size = min(max(MINI_BITS[0], 1 << (SPREAD * len(hashes) - 1).bit_length()), MINI_BITS[1])
    bits = np.bincount(((hashes >> np.uint64(8)) & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def folded(minis: list[bytes]) -> np.ndarray:
    """Sketches of one length: the shortest's."""
    size, out = min(map(len, minis)), []
    for mini in minis:
        row = np.frombuffer(mini, np.uint64)
        while 8 * len(row) > size:
            row = row[: len(row) // 2] ^ row[len(row) // 2 :]
        out.append(row)
    return np.stack(out)


def sketched(docs: DataFrame, n: int, share: int, id_col: str, text_col: str) -> DataFrame:
    """``id, n, h1, h2, mini, keys`` of each row: set size, 128 bits of the set, and what it is joined by in each band."""
    pieces = pa.list_(pa.list_(pa.int64()))
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("mini", pa.binary()), ("keys", pieces)])

    def row(key: int | None, raw: bytes | None) -> tuple:
        found = shingle_set(raw, n)
        if not len(found):
            return key, 0, 0, 0, b"", []
        h1 = np.add.reduce(mixed(found)).view(np.int64)
        h2 = np.bitwise_xor.reduce(mixed(found + np.uint64(0x5851F42D4C957F2D))).view(np.int64)
        parts = [given_keys(found, k, share) for k in bands_of(len(found), share)]
        return key, len(found), int(h1), int(h2), mini_sketch(found), parts

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batches_of((row(*x) for x in rows_of(batches)), schema, weigh=lambda r: 256 + 5 * r[1])

    given = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("raw"))
    kind = "id long, n long, h1 long, h2 long, mini binary, keys array<array<long>>"
    return given.mapInArrow(run, kind)


def verified(pairs: DataFrame, given: DataFrame, n: int, share: int) -> DataFrame:
    """The pairs ``hub, spoke`` whose sets have the share, as ``a, b``. ``given``: ``id, raw`` of all documents.

    Only texts of the pairs' documents are shuffled. Those of spokes come to their hubs in a sorted stream, behind the hub's
    own text, which is sent once to each of the tasks that its spokes are dealt to, SPOKES at most a group.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    ids = pairs.select(F.explode(F.array("hub", "spoke")).alias("id")).distinct()
    near = among(given, ids, "id").join(ids.hint("merge"), "id", "left_semi")
    texts = written(near.groupBy("id").agg(F.max("raw").alias("raw")), "texts")
    hubs = pairs.groupBy("hub").agg(F.ceil(F.count("*") / SPOKES).alias("ways"))
    dealt = pairs.join(hubs.hint("merge"), "hub").withColumn("way", F.pmod(F.xxhash64("spoke"), F.col("ways")))
    spokes = dealt.join(texts.hint("merge"), dealt.spoke == texts.id).select("hub", "way", "spoke", "raw")
    ways = hubs.select("hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ways") - 1)).alias("way"))
    own = among(texts.withColumnRenamed("id", "hub"), hubs, "hub").join(ways.hint("merge"), "hub")
    stream = own.select("hub", "way", F.lit(None).cast("long").alias("spoke"), "raw").unionByName(spokes)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            held = np.zeros(0, np.uint64)
            for hub, _, spoke, raw in rows_of(batches):
                if spoke is None:
                    held = shingle_set(raw, n)
                    continue
                other = shingle_set(raw, n)
                both = len(np.intersect1d(held, other, assume_unique=True))
                if 100 * both >= share * (len(held) + len(other) - both):
                    yield min(hub, spoke), max(hub, spoke)

        return batches_of(rows(), schema)

    ordered = stream.repartition(partitions(given.sparkSession), "hub", "way").sortWithinPartitions("hub", "way", F.asc_nulls_first("spoke"))
    return ordered.mapInArrow(run, "a long, b long")


def groups_of(members: DataFrame, comps: DataFrame) -> DataFrame:
    """``group, size, id, comp``: documents of the buckets that hold several components, each once in a group.

    Buckets with the same smallest component are one group, or several of about GROUP rows where they have more together, so
    that the sketch of a document goes to its groups instead of all its buckets. A bucket is never parted.
    """
    labelled = members.select("key", "id").join(comps.hint("merge"), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    keys = labelled.groupBy("key").agg(F.min("comp").alias("home"), F.max("comp").alias("y"), F.count("*").alias("rows")).filter("home <> y")
    homes = keys.groupBy("home").agg(F.ceil(F.sum("rows") / GROUP).alias("ways"))
    keys = keys.join(homes.hint("merge"), "home")
    keys = keys.select("key", F.xxhash64("home", F.pmod(F.xxhash64("key"), F.col("ways"))).alias("group"))
    held = written(labelled.join(keys.hint("merge"), "key").select("group", "id", "comp").distinct(), "groups")
    return held.join(held.groupBy("group").agg(F.count("*").alias("size")).hint("merge"), "group")


def close_pairs(members: DataFrame, share: int, nearest: bool = False) -> DataFrame:
    """Pairs ``a, b`` of one group in different components whose sizes and sketches allow a link; or only the nearest such of each.

    ``members``: ``group, size, id, comp, n, mini``. A group is dealt into blocks of about BLOCK members and each pair of
    blocks is one stretch of a sorted stream, so a task holds two blocks. Pairs that fail are never rows.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("id"), blocks.cast("long")).cast("int")
    dealt = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("group", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "comp", "n", "mini")

    def pairs(group: list[tuple]) -> Iterator[tuple]:
        i, j = group[0][1:3]
        ids, comps, sizes = (np.array([r[k] for r in group], np.int64) for k in (4, 5, 6))
        bits = folded([r[7] for r in group])
        side = np.array([r[3] for r in group])
        for at in range(len(group)):
            if i != j and side[at] != i:
                continue
            low = at + 1 if i == j else 0
            rest = slice(low, None)
            small, large = np.minimum(sizes[at], sizes[rest]), np.maximum(sizes[at], sizes[rest])
            may = (comps[rest] != comps[at]) & (100 * small >= share * large)
            if i != j:
                may &= side[rest] == j
            found = np.flatnonzero(may) + low
            if len(found):
                apart = np.bitwise_count(bits[found] ^ bits[at]).sum(1, dtype=np.int64)
                close = (100 + share) * apart <= (100 - share) * (sizes[found] + sizes[at])
                found, apart = found[close], apart[close]
                for other in found[[np.argmin(apart)]].tolist() if nearest and len(found) else found.tolist():
                    a, b = int(ids[at]), int(ids[other])
                    yield (a, b) if a < b else (b, a)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            group: list[tuple] = []
            for row in rows_of(batches):
                if group and row[:3] != group[0][:3]:
                    yield from pairs(group)
                    group = []
                group.append(row)
            if group:
                yield from pairs(group)

        return batches_of(rows(), schema)

    ordered = dealt.repartition(partitions(members.sparkSession), "group", "i", "j").sortWithinPartitions("group", "i", "j")
    return ordered.mapInArrow(run, "a long, b long").distinct()


def link(docs: DataFrame, n: int = 3, share: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_shingles, component_id`` for each row of docs.

    Two documents link when their sets of distinct ``n``-word shingles have a Jaccard similarity of ``share`` hundredths;
    a component is what links reach and its id the smallest in it. A shorter document is one shingle; one without words
    (or with null text) has none and is its own component. Ids are meant to be unique; of rows that share one, each gets a
    result and one text stands for them in comparisons. Null ids keep a null
    component and link with nothing. Other columns are left out; an empty table gives an empty one.

    Equal sets are one class, held by its smallest id. In each bucket of equal pieces, classes that share SHARED of their
    pieces with the smallest or the largest of it are compared with that, which is linear; what these links leave in
    different components is compared by sketches in blocks, first each with its nearest, then all with all that is still apart,
    so no link between components is lost and the pairs of a component are not gone through.
    """
    table = written(sketched(docs, n, share, id_col, text_col), "sketches")
    full = table.filter("n > 0 AND id IS NOT NULL")
    classes = written(full.groupBy("n", "h1", "h2").agg(F.min("id").alias("id")), "classes")
    own = full.select("id", "n", "h1", "h2")
    copies = own.join(classes.withColumnRenamed("id", "rep"), ["n", "h1", "h2"]).filter("id <> rep").select("id", "n", "h1", "h2")
    copies = written(copies, "copies")
    small = written(table.drop("keys"), "sizes")
    reps = without(full.select("id", "n", "h1", "h2", "keys"), copies, "id", ["n", "h1", "h2", "id"])
    keys = reps.select("id", F.explode("keys").alias("k")).select("id", F.size("k").alias("pieces"), F.explode("k").alias("key"))
    buckets = keys.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low <> high")
    buckets = written(buckets, "buckets")
    members = written(among(keys, buckets, "key").join(buckets.hint("merge"), "key"), "members")
    dropped(table)
    dropped(buckets)
    ends = members.select("pieces", F.explode(F.array(F.struct(F.col("low").alias("a"), F.col("id").alias("b"), F.lit(1).alias("low")), F.struct(F.col("id").alias("a"), F.col("high").alias("b"), F.lit(0).alias("low")))).alias("p"))
    ends = ends.select("p.*", "pieces").filter("a <> b").groupBy("a", "b").agg(F.count("*").alias("n"), F.sum("low").alias("low"), F.min("pieces").alias("pieces"))
    ends = ends.filter(F.col("n") >= F.greatest(F.lit(1), F.floor(F.col("pieces") * SHARED)))
    low = 2 * F.col("low") >= F.col("n")
    stars = written(ends.select(F.when(low, F.col("a")).otherwise(F.col("b")).alias("hub"), F.when(low, F.col("b")).otherwise(F.col("a")).alias("spoke")), "stars")
    given = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("raw"))
    edges = written(verified(stars, given, n, share), "links")
    comps = written(components(edges), "components")
    minis = small.select("id", "n", "mini").dropDuplicates(["id"])
    tried = stars.select(F.least("hub", "spoke").alias("hub"), F.greatest("hub", "spoke").alias("spoke"))
    # The nearest of each first: what those links bring together is compared no more, so that a large group of copies that are
    # linked among themselves doesn't give all its pairs. Then all that is still apart.
    for nearest in (True, False):
        near = groups_of(members, comps).join(minis.hint("merge"), "id")
        more = written(close_pairs(near, share, nearest).toDF("hub", "spoke").join(tried, ["hub", "spoke"], "left_anti"), "pairs")
        if more.isEmpty():
            continue
        found = written(verified(more, given, n, share), "links")
        tried = tried.unionByName(more)
        if not found.isEmpty():
            comps = written(components(found.unionByName(comps.select(F.col("comp").alias("a"), F.col("id").alias("b")))), "components")
    named = classes.join(comps, "id", "left").select("n", "h1", "h2", F.coalesce("comp", "id").alias("component_id"))
    out = small.select("id", "n", "h1", "h2").join(named, ["n", "h1", "h2"], "left")
    comp = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), comp.alias("component_id"))
