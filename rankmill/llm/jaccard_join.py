"""N-gram Jaccard join of articles: prefix filter, then prefix trees.

A set is the distinct shingles of an article, as 64-bit hashes; equal sets are one
from there on. Shingles have one order for all sets: by how often they occur, in
steps of a power of two from a counting sketch, then longer ones first, then by
hash. Two sets that are similar enough share at least r of the first
n - least + r shingles of each, so

1. each set sends this prefix out, and shingles that only one set has are dropped;
2. sets with fewer than r of them left have no partner; of the others each leaves out
   its r - 1 most frequent ones, as a pair that shares r still shares the rarest of these;
3. sets that share one form a group (connected components); a group is cut by
   size into overlapping ranges, as sizes of partners are near each other, and
   large ranges into blocks, packed into a row each. Blocks are dealt to strips, as many as
   the root of their number and STRIPS at most, of which two meet in a task, so a block is sent that often at most, each
   pair of sets meets exactly once and no task holds more than two blocks unpacked;
4. in each such part a trie of the whole sets is walked (trie_join), and each
   part returns at most one edge per set, not its pairs.

The prefix and its groups only choose who meets; links are judged on whole sets.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankmill.llm.components import components
from rankmill.llm.key_filter import key_filter, passes
from rankmill.llm.trie_join import linked_pairs
from rankmill.llm.words import LOWER, SPACE_WORDS, bounds, hashes, mix, pieces, release
from rankmill.session import settle, settle_last

SHINGLE, PERCENT = 5, 80
SKETCH_BITS = 18
LONGEST = 40
BLOCK_SETS = 600
STRIPS = 16  # of a part's blocks; a block is sent to each once, and tasks grow with the square
PACK_ROWS = 400_000  # prefix shingles of a shuffle bucket


def shingles(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of every text: text number, hash, length of its words in bytes; ordered by text, then hash.

    A text of fewer than n words has its whole sequence as one shingle. White space
    has no part in the length, so a shingle has one length in all texts.
    """
    data = LOWER[data]
    starts, ends, of_text = bounds(data, offsets, SPACE_WORDS)
    keys, n_words = hashes(data, starts, ends), np.diff(of_text)
    first = of_text[:-1]
    count = np.where(n_words >= n, n_words - n + 1, np.minimum(n_words, 1))
    text = np.repeat(np.arange(len(count)), count)
    upto = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(upto[-1]) - upto[:-1][text] + first[text]
    size = np.minimum(n_words, n)[text]
    value, last = mix(size.astype(np.uint64)), at.copy()
    for k in range(n):
        inside = k < size
        word = np.where(inside, at + k, at)
        value = np.where(inside, mix(value + keys[word]), value)
        last = np.where(inside, word, last)
    letters = np.concatenate([[0], np.cumsum(ends - starts)])
    length = letters[last + 1] - letters[at]
    order = np.lexsort((value, text))
    value, text, length = value[order], text[order], length[order]
    new = np.ones(len(value), dtype=bool)
    new[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    return text[new], value[new], length[new]


def sketch_levels(articles: DataFrame, shingle: int) -> np.ndarray:
    """How frequent the shingles of each hash bucket are, in powers of two above the noise; one byte per bucket."""
    blocks = 64
    schema = pa.schema([("block", pa.int32()), ("counts", pa.binary())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
        for batch in batches:
            for _, data, offsets in pieces(batch.column(0)):
                _, value, _ = shingles(data, offsets, shingle)
                counts += np.bincount((value >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(counts))
        if counts.any():
            parts = counts.astype("<i4").reshape(blocks, -1)
            yield pa.RecordBatch.from_pydict({"block": list(range(blocks)), "counts": [p.tobytes() for p in parts]}, schema=schema)

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1 << SKETCH_BITS) // blocks, dtype=np.int64)
        for batch in batches:
            for counts in batch.column(1):
                part = np.frombuffer(counts.as_buffer(), dtype="<i4" if len(counts.as_buffer()) == 4 * len(total) else "<i8")
                total += part
        yield pa.RecordBatch.from_pydict({"block": [key[0].as_py()], "counts": [total.astype("<i8").tobytes()]}, schema=schema)

    columns = "block int, counts binary"
    summed = articles.select("content").mapInArrow(count, columns).groupBy("block").applyInArrow(add, columns)
    counts = np.zeros((blocks, (1 << SKETCH_BITS) // blocks))
    for row in summed.collect():  # 64 rows; an iterator would start a job for each partition
        counts[row["block"]] = np.frombuffer(row["counts"], dtype="<i8")
    counts = counts.ravel()
    over = (counts - counts.mean()) / (3 * np.sqrt(max(counts.mean(), 1.0)))
    return np.minimum(np.log2(np.maximum(over, 1)), 15).astype(np.uint8)


def least_partner(n: np.ndarray, percent: int) -> np.ndarray:
    """Fewest common shingles with any partner."""
    return -(-percent * n // 100)


def rank_step(n: np.ndarray, percent: int) -> np.ndarray:
    """r: the number of shared prefix shingles asked for, a third of the plain prefix."""
    return np.maximum(-(-(n - least_partner(n, percent) + 1) // 3), 1)


def set_keys(value: np.ndarray, upto: np.ndarray) -> np.ndarray:
    """64-bit hash of each set: of the sum of its shingles' hashes and of its size."""
    sums = np.zeros(len(value) + 1, dtype=np.uint64)
    np.cumsum(mix(value ^ np.uint64(0xA0761D6478BD642F)), out=sums[1:])
    return mix(sums[upto[1:]] - sums[upto[:-1]] + np.diff(upto).astype(np.uint64)).view(np.int64)


SETS = "id long, content_key long, n_shingles long, set long, needed int, prefix array<long>"


def shingle_sets(articles: DataFrame, levels: np.ndarray, shingle: int, percent: int) -> DataFrame:
    """Per article: id, hash of the content, set size, 64-bit hash of the set, and the prefix that its set sends out."""
    shared = articles.sparkSession.sparkContext.broadcast(levels)
    fields = [("id", pa.int64()), ("content_key", pa.int64()), ("n_shingles", pa.int64()), ("set", pa.int64())]
    schema = pa.schema([*fields, ("needed", pa.int32()), ("prefix", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = shared.value.astype(np.uint64)
        for batch in batches:
            for first, data, offsets in pieces(batch.column(2)):
                n_texts = len(offsets) - 1
                text, value, length = shingles(data, offsets, shingle)
                n = np.bincount(text, minlength=n_texts)
                upto = np.concatenate([[0], np.cumsum(n)])
                key = set_keys(value, upto)
                level = levels[(value >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)] << np.uint64(60)
                short = (LONGEST - np.minimum(length, LONGEST)).astype(np.uint64) << np.uint64(54)
                order = np.lexsort((level | short | (value >> np.uint64(10)), text))
                step = rank_step(n, percent)
                # a partner may be smaller, so it may send out less
                needed = rank_step(least_partner(n, percent), percent)
                sent = np.minimum(n, n - least_partner(n, percent) + step)
                chosen = order[np.arange(len(order)) - upto[:-1][text] < sent[text]]
                cuts = np.concatenate([[0], np.cumsum(sent)]).astype(np.int32)
                columns = [
                    batch.column(0).slice(first, n_texts),
                    batch.column(1).slice(first, n_texts),
                    pa.array(n.astype(np.int64)),
                    pa.array(key, mask=n == 0),
                    pa.array(needed.astype(np.int32)),
                    pa.ListArray.from_arrays(pa.array(cuts), pa.array(value[chosen].view(np.int64))),
                ]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    rows = articles.select("id", content_key(F.col("content")).alias("content_key"), "content")
    return rows.mapInArrow(run, SETS)


def content_key(content: Column) -> Column:
    return F.xxhash64(F.coalesce(content, F.lit("")), content.isNull())


def shared_prefixes(sets: DataFrame) -> DataFrame:
    """token, set: prefix shingles that more than one set has.

    Shingles go packed to buckets; what several sets of one batch share is known
    to be shared at once, and only one of its rows goes on as a witness, so a
    frequent shingle is spread over the batches that have it.
    """
    total = sets.agg(F.sum(F.size("prefix"))).first()[0] or 0
    buckets = max(1, -(-total // PACK_ROWS))
    packed = pa.schema([("bucket", pa.int32()), ("rows", pa.binary())])
    plain = pa.schema([("token", pa.int64()), ("set", pa.int64())])
    kinds = np.dtype([("token", "<u8"), ("set", "<i8"), ("known", "u1")])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            lengths = np.diff(lists.offsets.to_numpy())
            token = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            rows = np.zeros(len(token), dtype=kinds)
            rows["token"] = token
            rows["set"] = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), lengths)
            rows = rows[np.lexsort((rows["set"], rows["token"]))]
            new = np.ones(len(rows), dtype=bool)
            new[1:] = (rows["token"][1:] != rows["token"][:-1]) | (rows["set"][1:] != rows["set"][:-1])
            rows = rows[new]  # copies have one set
            first = np.ones(len(rows), dtype=bool)
            first[1:] = rows["token"][1:] != rows["token"][:-1]
            alone = first & np.append(first[1:], True)
            rows["known"] = ~alone
            bucket = (mix(rows["token"]) % np.uint64(buckets)).astype(np.int64)
            # of known ones all but the first are spread, as nothing has to meet
            spread = np.flatnonzero(~first)
            bucket[spread] = (mix(rows["set"][spread].view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            rows, bucket = rows[order], bucket[order]
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
            ends = np.append(cuts[1:], len(bucket))
            for a in range(0, len(cuts), 4096):
                some = slice(a, a + 4096)
                yield pa.RecordBatch.from_pydict(
                    {"bucket": bucket[cuts[some]], "rows": [rows[x:y].tobytes() for x, y in zip(cuts[some], ends[some])]},
                    schema=packed,
                )

    def meet(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [np.frombuffer(x.as_buffer(), dtype=kinds) for batch in batches for x in batch.column(1)]
        rows = np.concatenate(parts) if parts else np.zeros(0, dtype=kinds)
        rows = rows[np.argsort(rows["token"], kind="stable")]
        if len(rows):
            first = np.flatnonzero(np.concatenate([[True], rows["token"][1:] != rows["token"][:-1]]))
            least, most = np.minimum.reduceat(rows["set"], first), np.maximum.reduceat(rows["set"], first)
            shared = (least < most) | (np.maximum.reduceat(rows["known"], first) > 0)
            rows = rows[np.repeat(shared, np.diff(np.append(first, len(rows))))]
        for a in range(0, len(rows), 100_000):
            part = rows[a : a + 100_000]
            columns = [pa.array(part["token"].copy().view(np.int64)), pa.array(part["set"].copy())]
            yield pa.RecordBatch.from_arrays(columns, schema=plain)
        del rows, parts
        release()

    met = (
        sets.where("n_shingles > 0")
        .select("set", "prefix")
        .mapInArrow(pack, "bucket int, rows binary")
        .groupBy("bucket")
        .applyInArrow(meet, "token long, set long")
    )
    return met.dropDuplicates(["token", "set"])


def candidates(sets: DataFrame, needed: DataFrame) -> DataFrame:
    """set, place (the group): sets that share enough of their prefix, in groups that a shared shingle connects.

    needed: set, needed (how many of its prefix shingles it has to share with a partner). As partners share that many, the rarest
    of these isn't among the needed - 1 most frequent of either, so those connect nothing: what many texts have
    in common (a notice, a heading) makes no group of them.
    """
    shared = settle(shared_prefixes(sets))
    often = shared.groupBy("token").agg(F.count(F.lit(1)).alias("often"))
    frequent_first = Window.partitionBy("set").orderBy(F.desc("often"), "token")  # one order for all sets; rows of a set are one prefix
    numbered = shared.join(often, "token").join(needed, "set").withColumn("number", F.row_number().over(frequent_first))
    left = settle(numbered.where("number >= needed").select("token", "set"))
    # what a set without partners had, or didn't keep, may now be with one set only
    several = left.groupBy("token").agg(F.min("set").alias("least"), F.max("set").alias("most")).where("least < most")
    stars = left.join(several, "token").select(F.col("set").alias("a"), F.col("least").alias("b"))
    labels = components(stars.distinct())
    return labels.select(F.col("node").alias("set"), F.col("label").alias("place"))


def placed_sets(members: DataFrame, percent: int, block_sets: int) -> DataFrame:
    """set, n, place, id, content_key -> set, part, own, blocks, block, id, content_key: the group of sets in which a set meets others, and its block there.

    A size range is as wide as partners can differ, so partners are in one range or in neighbours. A part is a
    range with the one below (own: 1 for sets of the range itself). A part of more than `block_sets` sets has several blocks.
    """
    width = log(100 / percent) * (1 + 1e-9)
    ranged = members.withColumn("range", F.floor(F.log(F.col("n").cast("double")) / width).cast("int"))
    near = ranged.withColumn("own", F.lit(1)).union(ranged.withColumn("range", F.col("range") + 1).withColumn("own", F.lit(0)))
    sizes = near.groupBy("place", "range").agg(F.count(F.lit(1)).alias("sets"), F.sum("own").alias("owned"))
    sizes = sizes.where("owned > 0 AND sets > 1")
    blocks = F.ceil(F.col("sets") / block_sets).cast("int")
    placed = near.join(sizes.withColumn("blocks", blocks), ["place", "range"])
    block = F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int")
    part = F.concat_ws(":", "place", "range").alias("part")
    return placed.select("set", part, "own", "blocks", block.alias("block"), "id", "content_key")


LINKS = "a long, b long, links long"
LINKS_SCHEMA = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])


def _lists(column: pa.Array) -> list[np.ndarray]:
    flat, cuts = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    cuts = cuts - cuts[0]
    return [flat[a:b] for a, b in zip(cuts, cuts[1:])]


def _links_of(names: np.ndarray, own: np.ndarray, side: np.ndarray, sets: list[np.ndarray], percent: int) -> Iterator[pa.RecordBatch]:
    """Per set an edge to the least set it is connected with here, and its number of links here.

    side: sets of side 1 don't pair with each other, nor do those of side 2.
    """
    pairs = linked_pairs(sets, side, percent)
    pairs = pairs[(own[pairs[:, 0]] == 1) | (own[pairs[:, 1]] == 1)]  # two of the lower range meet in their own
    if not len(pairs):
        return
    a, b = names[pairs[:, 0]], names[pairs[:, 1]]
    nodes, n_links = np.unique(np.concatenate([a, b]), return_counts=True)
    left, right = np.searchsorted(nodes, a), np.searchsorted(nodes, b)
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[left], label[right])
        after = label.copy()
        np.minimum.at(after, left, low)
        np.minimum.at(after, right, low)
        after = after[after]
        if (after == label).all():
            break
        label = after
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label]), pa.array(n_links)], schema=LINKS_SCHEMA)
    release()


def links(placed: DataFrame, percent: int) -> DataFrame:
    """a, b, links: per part and set an edge to the least set it is connected with there, and its number of links there.

    placed: part, set, own, blocks, block, tokens (the whole set). Parts of one block are walked as they come. The blocks of
    larger parts are packed first, each into one row that holds what its sets have in common once, and then each pair of
    strips of blocks meets in a task, which unpacks two blocks at a time: a set is sent once, a packed block STRIPS times at most.
    """

    def walk(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, own, sets = [], [], []
        for batch in batches:
            names.append(batch.column(1).to_numpy(zero_copy_only=False))
            own.append(batch.column(2).to_numpy(zero_copy_only=False))
            sets += _lists(batch.column(3))
        yield from _links_of(np.concatenate(names), np.concatenate(own), np.zeros(len(sets), dtype=np.int64), sets, percent)

    def pack(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, own, sets = [], [], []
        for batch in batches:
            names.append(batch.column(1).to_numpy(zero_copy_only=False))
            own.append(batch.column(2).to_numpy(zero_copy_only=False))
            sets += _lists(batch.column(5))
        data = packed_sets(np.concatenate(names), np.concatenate(own), sets)
        columns = {"part": [key[0].as_py()], "blocks": pa.array([key[1].as_py()], pa.int32()), "block": pa.array([key[2].as_py()], pa.int32()), "data": [data]}
        yield pa.RecordBatch.from_pydict(columns)
        release()

    def meet(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = key[1].as_py(), key[2].as_py()
        rows = {}
        for batch in batches:
            rows.update(zip(zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()), batch.column(5)))
        strips = [sorted(block for strip, block in rows if strip == wanted) for wanted in (low, high)]
        for first in strips[0]:
            mine = unpacked_sets(rows[low, first].as_py())
            for second in strips[1]:
                if low == high and second < first:
                    continue
                # a block alone pairs all its sets; of two, only those of one with those of the other
                alone = (low, first) == (high, second)
                both = [mine] if alone else [mine, unpacked_sets(rows[high, second].as_py())]
                names, own = (np.concatenate([x[c] for x in both]) for c in (0, 1))
                side = np.repeat([0] if alone else [1, 2], [len(x[2]) for x in both])
                yield from _links_of(names, own, side, [tokens for x in both for tokens in x[2]], percent)

    small = placed.where("blocks = 1").select("part", "set", "own", "tokens").groupBy("part").applyInArrow(walk, LINKS)
    large = placed.where("blocks > 1").select("part", "set", "own", "blocks", "block", "tokens")
    blocks = settle(large.groupBy("part", "blocks", "block").applyInArrow(pack, "part string, blocks int, block int, data binary"))
    return small.union(strip_pairs(blocks).groupBy("part", "low", "high").applyInArrow(meet, LINKS))


def strip_pairs(blocks: DataFrame) -> DataFrame:
    """part, low, high (two strips of its blocks, or one twice), strip (that of the block), block, data."""
    strips = F.least(F.ceil(F.sqrt("blocks")), F.lit(STRIPS)).cast("int")
    dealt = blocks.withColumn("strip", (F.col("block") % strips).cast("int"))
    other = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), strips - 1)))
    low, high = F.least("strip", "other"), F.greatest("strip", "other")
    return other.select("part", low.alias("low"), high.alias("high"), "strip", "block", "data")


def packed_sets(names: np.ndarray, own: np.ndarray, sets: list[np.ndarray]) -> bytes:
    """Sets in a few arrays: the tokens that most of them have once, then what each lacks of these and has besides."""
    tokens, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = 2 * counts > len(sets)
    place = np.cumsum(common) - 1
    cuts = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    lacks, more = [], []
    for a, b in zip(cuts, cuts[1:]):
        mine = inverse[a:b]
        has = common[mine]
        missing = np.ones(int(common.sum()), dtype=bool)
        missing[place[mine[has]]] = False
        lacks.append(np.flatnonzero(missing).astype(np.int32))
        more.append(tokens[mine[~has]])
    sizes = np.array([[len(x), len(y)] for x, y in zip(lacks, more)], dtype=np.int32)
    arrays = (names, own.astype(np.int8), tokens[common], sizes, np.concatenate(lacks), np.concatenate(more))
    return zstandard.compress(pickle.dumps(arrays), 1)


def unpacked_sets(data: bytes) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    names, own, common, sizes, lacks, more = pickle.loads(zstandard.decompress(data))
    sets, upto = [], np.concatenate([[[0, 0]], np.cumsum(sizes, axis=0)])
    for (a, c), (b, d) in zip(upto.tolist(), upto[1:].tolist()):
        sets.append(np.concatenate([np.delete(common, lacks[a:b]), more[c:d]]))
    return names, own, sets


def whole_sets(articles: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """set, tokens (array of all shingles) of the wanted sets: `id` and `content_key` of an article that has each.

    Texts are read again, not shuffled: a filter lets the wanted articles and few
    others through, and what these others give finds no partner in the join by `set`.
    """
    schema = pa.schema([("set", pa.int64()), ("tokens", pa.list_(pa.int64()))])
    bits = key_filter(wanted.select(F.xxhash64("id", "content_key").alias("key")))
    shared = articles.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for first, data, offsets in pieces(batch.column(1).filter(pa.array(passes(shared.value, keys.view(np.uint64))))):
                text, value, _ = shingles(data, offsets, shingle)
                cuts = np.searchsorted(text, np.arange(len(offsets)))
                lists = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(value.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(set_keys(value, cuts)), lists.cast(schema.field(1).type)], schema=schema)

    keyed = articles.select(F.xxhash64("id", content_key(F.col("content"))).alias("key"), "content")
    return keyed.mapInArrow(run, "set long, tokens array<long>").dropDuplicates(["set"])


def join_articles(
    articles: DataFrame, *, shingle: int = SHINGLE, percent: int = PERCENT, block_sets: int = BLOCK_SETS
) -> DataFrame:
    """Groups of articles whose shingle sets are similar, in one row per article.

    articles: `id` (integer), `content`; other columns are not read. Words are
    runs of anything but ASCII white space, A-Z in lower case. Two articles link
    when 100 * intersection >= percent * union of their sets. Returns per row: id,
    content_key (hash of the content), n_shingles, set (hash of the set, null
    without words), group (least set that links reach), component_id (least id that links reach, its own included;
    without words the article's own), n_links (other sets that its set links with).
    Null ids never are a component's least id unless all are null. Repeated rows
    stay, an empty table gives an empty result.
    """
    rows = articles.select(F.col("id").cast("long").alias("id"), F.col("content").cast("string").alias("content"))
    sets = settle(shingle_sets(rows, sketch_levels(rows, shingle), shingle, percent))
    # one article stands for a set: the least by id, then by content
    least = F.min(F.struct(F.col("id").isNull(), "id", "content_key")).alias("least")
    each = sets.where("set IS NOT NULL").groupBy("set").agg(least, F.min("n_shingles").alias("n"), F.min("needed").alias("needed"))
    each = settle(each.select("set", "n", "needed", "least.id", "least.content_key"))
    place = candidates(sets, each.select("set", "needed"))
    members = settle(place.join(each.drop("needed"), "set"))
    placed = settle(placed_sets(members, percent, block_sets))
    tokens = whole_sets(rows, placed.select("id", "content_key"), shingle)
    found = settle(links(settle(placed.drop("id", "content_key").join(tokens, "set")), percent))
    label = components(found)
    degree = found.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("n_links"))
    linked = label.join(degree, "node").join(each.select(F.col("set").alias("node"), "id"), "node")
    named = linked.groupBy("label").agg(F.min("id").alias("least_id"))
    linked = linked.join(named, "label").select(F.col("node").alias("set"), "label", "n_links", "least_id")
    classes = each.select("set", F.col("id").alias("own_id")).join(linked, "set", "left").select(
        "set",
        F.coalesce("label", "set").alias("group"),
        F.coalesce("least_id", "own_id").alias("component_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )
    without = F.col("set").isNull()
    return sets.drop("needed", "prefix").join(classes, "set", "left").select(
        "id",
        "content_key",
        "n_shingles",
        "set",
        "group",
        F.when(without, F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
    )


def one_per_group(rows: DataFrame, id: str, content: str, **options) -> DataFrame:
    """The rows of articles of which no similar one comes before: one row of each group, the least by id, then by content.

    Keeps the given columns. Articles without words are in no group and stay, all of them.
    """
    named = rows.select(F.col(id).alias("id"), F.col(content).alias("content"))
    found = settle_last(rows.sparkSession, lambda: join_articles(named, **options))
    least = F.min(F.struct(F.col("id").isNull(), "id", "content_key")).alias("least")
    chosen = found.where("set IS NOT NULL").groupBy("group").agg(least)
    chosen = chosen.select(F.xxhash64("least.id", "least.content_key").alias("key"))
    # the given columns are in one struct, so names made here can't be theirs
    given = F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("given")
    has_words = F.coalesce(F.col(content).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    key = F.xxhash64(F.col(id).cast("long"), content_key(F.col(content).cast("string")))
    keyed = rows.select(given, key.alias("key"), has_words.alias("has_words"))
    kept = keyed.where("has_words").join(chosen, "key", "left_semi")
    first = F.row_number().over(Window.partitionBy("key").orderBy("key"))  # equal rows: any one of them
    kept = kept.withColumn("number", first).where("number = 1").select("given.*")
    return kept.union(keyed.where(~F.col("has_words")).select("given.*"))
