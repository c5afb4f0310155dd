"""Collocations: phrases of articles that occur more often than their parts let expect, by an FM-index per shard.

A shard holds about SHARD_WORDS words of one list's articles. Its words have numbers, pieces (what stands between marks
and line ends) are parted by 0. The index is the Burrows-Wheeler transform of this sequence and of its reverse, both sorted to the
depth of the longest phrase. A phrase is an interval of rows in each of the two. Extending it to the left reads the
first transform inside the first interval: equal words there are one extension, their number is its count, the
row that the transform leads to (last-to-first) is where its interval starts, and the number of lesser words is how far its
interval in the other index is from the phrase's. Extending to the right is the same with the two exchanged. All intervals of a
shard are extended together by whole-array arithmetic.

Counts are summed across shards. A phrase can occur `least` times only if its parts do, so pairs are counted of frequent words, and longer
phrases where every pair in them is frequent. They are counted by a prefix of their hash first, packed into a few bytes each; only phrases whose
hash prefix reaches `least` are counted once more, by their text, packed too. Bit filters of bounded size say which these are, and they
err on the side of counting.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankmill.llm.key_filter import key_filter, passes
from rankmill.llm.words import LOWER, bounds, byte_table, hashes, mix, pieces, release
from rankmill.session import settle

LONGEST = 4  # words of a phrase
SHARD_WORDS = 1 << 20
PART_ROWS = 1 << 17  # occurrences that are extended together
BUCKET_WORDS = 1 << 19  # words of all articles to a bucket of hash prefixes
#: fixed values: what parts pieces, and what else parts words
MARKS = b".,;:!?" + bytes(range(0x0A, 0x0E))
IS_MARK = ~byte_table(MARKS)
IN_WORD = byte_table(MARKS + b" \t")
MARK = re.compile(b"[" + re.escape(MARKS) + b"]")


class Shard:
    """The sequence of word numbers of one shard, while it is gathered."""

    def __init__(self):
        self.numbers: dict[int, int] = {}
        self.words: list[bytes] = []
        self.parts: list[np.ndarray] = []
        self.n_words = 0

    def add(self, data: np.ndarray, offsets: np.ndarray) -> None:
        data = LOWER[data]
        starts, ends, of_text = bounds(data, offsets, IN_WORD)
        if not len(starts):
            return
        marks = np.cumsum(IS_MARK[data])[starts]
        new = np.ones(len(starts), dtype=bool)
        new[1:] = marks[1:] != marks[:-1]
        new[of_text[:-1][of_text[:-1] < len(new)]] = True
        keys, first, inverse = np.unique(hashes(data, starts, ends), return_index=True, return_inverse=True)
        raw, local = data.tobytes(), np.empty(len(keys), dtype=np.int32)
        for i, (key, a, b) in enumerate(zip(keys.tolist(), starts[first].tolist(), ends[first].tolist())):
            number = self.numbers.get(key)
            if number is None:
                self.words.append(raw[a:b])
                number = self.numbers[key] = len(self.words)
            local[i] = number
        part = np.zeros(len(starts) + int(new.sum()), dtype=np.int32)
        part[np.arange(len(starts)) + np.cumsum(new)] = local[inverse]
        self.parts.append(part)
        self.n_words += len(starts)

    def sequence(self) -> np.ndarray:
        return np.concatenate([*self.parts, np.zeros(1, dtype=np.int32)])


def transform(sequence: np.ndarray, depth: int) -> np.ndarray:
    """Burrows-Wheeler transform: the words before the places of the sequence, in the order of the `depth` words from each place on."""
    n = len(sequence)
    rank, known = sequence.astype(np.int64), 1
    while known < depth:  # the order of the first `known` words, doubled
        after = np.zeros(n, dtype=np.int64)
        after[:-known] = rank[known:] + 1 if known < n else 0
        key = rank * (int(rank.max()) + 2) + after
        known *= 2
        if known < depth:
            rank = np.unique(key, return_inverse=True)[1]
    return np.roll(sequence, 1)[np.argsort(key, kind="stable")]


class Intervals:
    """Phrases of one length: their words (numbers, a row each), rows in the two indexes, and counts."""

    def __init__(self, words: np.ndarray, low: tuple[np.ndarray, np.ndarray], count: np.ndarray):
        self.words, self.low, self.count = words, low, count

    def take(self, wanted: np.ndarray | slice) -> Intervals:
        return Intervals(self.words[wanted], (self.low[0][wanted], self.low[1][wanted]), self.count[wanted])

    def parts(self, rows: int) -> Iterator[Intervals]:
        """Some phrases at a time, of about `rows` occurrences: extending takes room for each of them."""
        upto = np.concatenate([[0], np.cumsum(self.count)])
        first = 0
        while first < len(self.count):
            last = max(first + 1, int(np.searchsorted(upto, upto[first] + rows, side="right")) - 1)
            yield self.take(slice(first, last))
            first = last


class Index:
    """A bidirectional FM-index: before[0] is the transform of a shard's sequence, before[1] that of its reverse."""

    def __init__(self, before: tuple[np.ndarray, np.ndarray], n_words: int):
        self.before = before
        self.counts = np.bincount(before[0], minlength=n_words + 1)
        self.first = np.concatenate([[0], np.cumsum(self.counts)[:-1]])
        self.row_of = []  # last-to-first
        self.inside = []  # rows with a word, not a border, before them
        for words in before:
            rows = np.empty(len(words), dtype=np.int32)
            rows[np.argsort(words, kind="stable")] = np.arange(len(words), dtype=np.int32)
            self.row_of.append(rows)
            inside = np.zeros(len(words) + 1, dtype=np.int32)
            np.cumsum(words > 0, out=inside[1:])
            self.inside.append(inside)

    def single(self, numbers: np.ndarray) -> Intervals:
        return Intervals(numbers[:, None], (self.first[numbers], self.first[numbers]), self.counts[numbers])

    def extend(self, phrases: Intervals, side: int) -> Intervals:
        """Every phrase with every word that stands before it (side 0) or after it (side 1)."""
        count = phrases.count
        upto = np.concatenate([[0], np.cumsum(count)])
        of = np.repeat(np.arange(len(count)), count)
        row = np.arange(upto[-1]) - upto[:-1][of] + phrases.low[side][of]
        word = self.before[side][row].astype(np.int64)
        key = of * np.int64(len(self.counts)) + word
        order = np.argsort(key, kind="stable")
        new = np.ones(len(order), dtype=bool)
        new[1:] = key[order][1:] != key[order][:-1]
        start = np.flatnonzero(new)
        many = np.diff(np.append(start, len(order)))
        which = order[start]
        of, word = of[which], word[which]
        low = [None, None]
        low[side] = self.row_of[side][row[which]].astype(np.int64)
        low[1 - side] = phrases.low[1 - side][of] + start - upto[:-1][of]
        columns = [word[:, None], phrases.words[of]]
        longer = Intervals(np.concatenate(columns if side == 0 else columns[::-1], axis=1), tuple(low), many)
        return longer.take(word > 0)

    def neighbours(self, phrases: Intervals, side: int) -> np.ndarray:
        """How many occurrences of each phrase have a word before (0) or after (1) them in their piece."""
        low = phrases.low[side]
        return self.inside[side][low + phrases.count] - self.inside[side][low]


def text_hashes(texts: pa.Array) -> np.ndarray:
    texts = texts.cast(pa.large_binary())
    at = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[at[0] : at[-1]] if len(texts) else np.zeros(0, dtype=np.uint8)
    return hashes(data, at[:-1] - at[0], at[1:] - at[0])


def phrase_keys(list_hash: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
    """64-bit keys of a list's phrases, from the hashes of their words."""
    key = list_hash
    for word in words:
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + word)
    return key


def _squeezed(numbers: np.ndarray) -> bytes:
    """32-bit numbers byte by byte, compressed."""
    return zstandard.compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 3)


def _unsqueezed(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), dtype=np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int32)


INDEX = "list_key string, n_words long, words array<string>, counts binary, before binary, after binary"


def shard_indexes(articles: DataFrame, *, shard_words: int = SHARD_WORDS) -> DataFrame:
    """A written table of indexes, one row per shard: list_key, n_words, words, counts, and the two transforms (32-bit numbers, compressed).

    articles: `list_key`, `content`. Long texts are cut at marks, so memory is bounded by a shard and the longest piece.
    """
    schema = pa.schema(
        [("list_key", pa.string()), ("n_words", pa.int64()), ("words", pa.list_(pa.string())), ("counts", pa.binary()), ("before", pa.binary()), ("after", pa.binary())]
    )

    def indexed(name: str, shard: Shard) -> pa.RecordBatch:
        sequence = shard.sequence()
        counts = np.bincount(sequence, minlength=len(shard.words) + 1)[1:]
        columns = {
            "list_key": [name],
            "n_words": [shard.n_words],
            "words": [[w.decode("utf-8", "replace") for w in shard.words]],
            "counts": [_squeezed(counts)],
            "before": [_squeezed(transform(sequence, LONGEST))],
            "after": [_squeezed(transform(sequence[::-1].copy(), LONGEST))],
        }
        del sequence
        release()
        return pa.RecordBatch.from_pydict(columns, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_shards: dict[str, Shard] = {}
        for batch in (whole.slice(a, 500) for whole in batches for a in range(0, whole.num_rows, 500)):
            names = batch.column(0).dictionary_encode()
            for k, name in enumerate(names.dictionary.to_pylist()):
                texts = batch.column(1).filter(pc.equal(names.indices, k))
                for data, offsets in cut_texts(texts):
                    shard = open_shards.setdefault(name, Shard())
                    shard.add(data, offsets)
                    if shard.n_words >= shard_words:
                        yield indexed(name, open_shards.pop(name))
                    elif sum(x.n_words for x in open_shards.values()) >= 3 * shard_words:  # many lists in one task
                        name_of_most = max(open_shards, key=lambda x: open_shards[x].n_words)
                        yield indexed(name_of_most, open_shards.pop(name_of_most))
        for name, shard in open_shards.items():
            if shard.n_words:
                yield indexed(name, shard)

    return settle(articles.select("list_key", "content").mapInArrow(run, INDEX), maxRecordsPerFile=1)


def cut_texts(texts: pa.Array, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bytes and offsets of some texts at a time; a text of more than two times `most` bytes comes in parts cut at marks."""
    for _, data, offsets in pieces(texts, most):
        if len(data) <= 2 * most:
            yield data, offsets
            continue
        raw, first = data.tobytes(), 0
        while first < len(raw):
            found = MARK.search(raw, first + most)
            last = found.start() if found else len(raw)
            yield data[first:last], np.array([0, last - first])
            first = last


COUNTS = "list_key string, phrase string, n long, n_left long, n_right long"


def phrase_counts(indexes: DataFrame, gather: Gather, least: int, bucket_bits: int) -> DataFrame:
    """Phrases that occur `least` times, with their numbers of occurrences, and of those with a word before and after, summed across shards.

    A shard sends the phrases of a bucket (by the first bits of their hash) in one packed row, so rows are as many as
    shards and buckets, not as the phrases of all shards; only frequent phrases become rows.
    """
    packed = pa.schema([("bucket", pa.int32()), ("list_key", pa.string()), ("data", pa.binary())])
    plain = pa.schema([("list_key", pa.string()), ("phrase", pa.string()), ("n", pa.int64()), ("n_left", pa.int64()), ("n_right", pa.int64())])
    shift = np.uint64(64 - bucket_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name, words, known, name_hash, index = _opened(batch, i)
                phrases, bucket, counts = [pa.array([], pa.large_string())], [np.zeros(0, dtype=np.int32)], [np.zeros((0, 3), dtype=np.int64)]
                for found in gather(known, name_hash, index):
                    texts = [words.take(pa.array(column - 1)) for column in found.words.T]
                    phrases.append(pc.binary_join_element_wise(*texts, " ").cast(pa.large_string()))
                    bucket.append((phrase_keys(name_hash, [known[c] for c in found.words.T]) >> shift).astype(np.int32))
                    # the occurrences without a neighbour: mostly zeros, which take no room
                    without = [found.count - index.neighbours(found, side) for side in (0, 1)]
                    counts.append(np.stack([found.count, *without], axis=1))
                del index
                phrases, bucket, counts = pa.concat_arrays(phrases), np.concatenate(bucket), np.concatenate(counts)
                order = np.argsort(bucket, kind="stable")
                bucket = bucket[order]
                cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
                for x, y in zip(cuts.tolist(), np.append(cuts[1:], len(bucket)).tolist()):
                    some = order[x:y]
                    data = [_packed_phrases(phrases.take(pa.array(some)), counts[some])]
                    yield pa.RecordBatch.from_arrays([pa.array(bucket[x : x + 1]), pa.array([name]), pa.array(data, pa.binary())], schema=packed)
                release()

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [_unpacked_phrases(x.as_py()) for batch in batches for x in batch.column(2)]
        table = pa.concat_tables(parts).group_by("phrase", use_threads=False).aggregate([(x, "sum") for x in ("n", "n_first", "n_last")])
        table = table.filter(pc.greater_equal(table["n_sum"], least))
        n, phrase = table["n_sum"], table["phrase"].cast(pa.string())
        name = pa.array([key[1].as_py()]).take(pa.array(np.zeros(len(table), dtype=np.int8)))
        columns = [name, phrase, n, pc.subtract(n, table["n_first_sum"]), pc.subtract(n, table["n_last_sum"])]
        yield from pa.Table.from_arrays(columns, schema=plain).to_batches(max_chunksize=50_000)
        del parts, table
        release()

    found = indexes.select("list_key", "words", "before", "after").mapInArrow(run, "bucket int, list_key string, data binary")
    return found.groupBy("bucket", "list_key").applyInArrow(add, COUNTS)


def _packed_phrases(phrases: pa.Array, counts: np.ndarray) -> bytes:
    """Phrases in their order, a line each, after their numbers (three columns of 32 bits, byte by byte); compressed."""
    order = pc.array_sort_indices(phrases)
    columns = counts[order.to_numpy()].astype("<u4").T.copy().view(np.uint8).reshape(3, -1, 4).transpose(0, 2, 1)
    lines = "\n".join(phrases.take(order).to_pylist()).encode()
    return zstandard.compress(b"".join([len(phrases).to_bytes(8, "little"), columns.tobytes(), lines]), 3)


def _unpacked_phrases(data: bytes) -> pa.Table:
    data = zstandard.decompress(data)
    n = int.from_bytes(data[:8], "little")
    columns = np.frombuffer(data, dtype=np.uint8, count=12 * n, offset=8).reshape(3, 4, n).transpose(0, 2, 1).copy().view("<u4").reshape(3, n)
    phrase = pc.split_pattern(pa.array([data[8 + 12 * n :].decode()], pa.large_string()), "\n").values
    return pa.table([phrase, *(pa.array(c.astype(np.int64)) for c in columns)], names=["phrase", "n", "n_first", "n_last"])


def word_totals(indexes: DataFrame) -> DataFrame:
    """list_key, phrase (one word), n: how often each word occurs, summed across shards."""
    schema = pa.schema([("list_key", pa.string()), ("phrase", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                words = batch.column(1)[i].values
                n = _unsqueezed(batch.column(2)[i].as_py()).astype(np.int64)
                name = batch.column(0).slice(i, 1).take(pa.array(np.zeros(len(words), dtype=np.int8)))
                yield pa.RecordBatch.from_arrays([name, words, pa.array(n)], schema=schema)

    found = indexes.select("list_key", "words", "counts").mapInArrow(run, "list_key string, phrase string, n long")
    return found.groupBy("list_key", "phrase").agg(F.sum("n").alias("n"))


def _word_filter(words: DataFrame) -> np.ndarray:
    """The bit filter of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = phrase_keys(text_hashes(batch.column(0)), [text_hashes(batch.column(1))])
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64))], names=["key"])

    return key_filter(settle(words.select("list_key", "phrase").mapInArrow(run, "key long")))


def _opened(batch: pa.RecordBatch, i: int) -> tuple[str, pa.Array, np.ndarray, np.ndarray, Index]:
    """A row of list_key, words, before, after: the list's name, the words, the hashes of the words and of the name, the index."""
    name = batch.column(0)[i].as_py()
    words = batch.column(1)[i].values
    before = tuple(_unsqueezed(batch.column(c)[i].as_py()) for c in (2, 3))
    known = np.concatenate([np.zeros(1, dtype=np.uint64), text_hashes(words)])
    return name, words, known, text_hashes(pa.array([name])), Index(before, len(words))


def _packed(low: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending 32-bit numbers and their counts: differences, byte by byte, compressed."""
    return _squeezed(np.concatenate([np.diff(low, prepend=np.uint32(0)), counts]))


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    columns = _unsqueezed(data)
    n = len(columns) // 2
    return np.cumsum(columns[:n].view(np.uint32), dtype=np.uint32), columns[n:].astype(np.int64)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, dtype=np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


#: gives the phrases of a shard, some at a time, from the hashes of its words (0 for the border) and of its list
Gather = Callable[[np.ndarray, np.ndarray, Index], Iterator[Intervals]]


def frequent_keys(indexes: DataFrame, gather: Gather, least: int, bucket_bits: int) -> DataFrame:
    """key: prefixes (32 + bucket_bits bits) of the hashes of phrases that, all with one prefix together, occur `least` times.

    A shard sums its phrases by prefix and sends those of a bucket in one packed row, counts over `least` as `least`.
    """
    schema = pa.schema([("bucket", pa.int32()), ("data", pa.binary())])
    shift = np.uint64(32 - bucket_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                known, name, index = _opened(batch, i)[2:]
                keys, counts = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)]
                for found in gather(known, name, index):
                    keys.append(phrase_keys(name, [known[c] for c in found.words.T]) >> shift)
                    counts.append(found.count)
                keys, counts = _summed(np.concatenate(keys), np.concatenate(counts))
                bucket = (keys >> np.uint64(32)).astype(np.int32)
                cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
                low, counts = keys.astype(np.uint32), np.minimum(counts, least)
                data = [_packed(low[x:y], counts[x:y]) for x, y in zip(cuts, np.append(cuts[1:], len(bucket)))]
                del index
                yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts]), pa.array(data, pa.binary())], schema=schema)
                release()

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [_unpacked(x.as_py()) for batch in batches for x in batch.column(1)]
        low, counts = _summed(np.concatenate([x for x, _ in parts]), np.concatenate([y for _, y in parts]))
        often = low[counts >= least].astype(np.int64) | key[0].as_py() << 32
        yield pa.RecordBatch.from_arrays([pa.array(often)], names=["key"])

    packed = indexes.select("list_key", "words", "before", "after").mapInArrow(run, "bucket int, data binary")
    return packed.groupBy("bucket").applyInArrow(add, "key long")


def frequent_phrases(indexes: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(words, phrases of 2 to LONGEST words) that occur at least `least` times in a list, as phrase_counts gives them, with n_words."""
    context = indexes.sparkSession.sparkContext
    often = F.col("n") >= least
    words = settle(word_totals(indexes).where(often))
    word_bits = context.broadcast(_word_filter(words))
    total = indexes.agg(F.sum("n_words")).first()[0] or 0
    bucket_bits = min(max((total // BUCKET_WORDS).bit_length(), 4), 24)
    shift = np.uint64(32 - bucket_bits)

    def hashed(known: np.ndarray, name: np.ndarray, columns: np.ndarray) -> np.ndarray:
        return phrase_keys(name, [known[c] for c in columns.T]) >> shift

    def pairs(known: np.ndarray, name: np.ndarray, index: Index) -> Iterator[Intervals]:
        wanted = passes(word_bits.value, phrase_keys(name, [known]))
        wanted[0] = False
        for some in index.single(np.flatnonzero(wanted)).parts(PART_ROWS):
            found = index.extend(some, 0)
            yield found.take(wanted[found.words[:, 0]])

    pair_bits = context.broadcast(key_filter(settle(frequent_keys(indexes, pairs, least, bucket_bits))))

    def longer(known: np.ndarray, name: np.ndarray, index: Index) -> Iterator[Intervals]:
        for found in all_sizes(known, name, index):
            if found.words.shape[1] > 2:
                yield found

    def all_sizes(known: np.ndarray, name: np.ndarray, index: Index) -> Iterator[Intervals]:
        def often_at(found: Intervals, k: int) -> Intervals:
            return found.take(passes(pair_bits.value, hashed(known, name, found.words[:, k : k + 2])))

        for some in pairs(known, name, index):
            some = often_at(some, 0)
            yield some
            triples = often_at(index.extend(some, 0), 0)
            yield triples
            yield often_at(index.extend(triples, 1), 2)

    longer_bits = context.broadcast(key_filter(settle(frequent_keys(indexes, longer, least, bucket_bits))))

    def chosen(known: np.ndarray, name: np.ndarray, index: Index) -> Iterator[Intervals]:
        for found in all_sizes(known, name, index):
            if found.words.shape[1] > 2:
                found = found.take(passes(longer_bits.value, hashed(known, name, found.words)))
            yield found

    phrases = phrase_counts(indexes, chosen, least, bucket_bits)
    return words, phrases.withColumn("n_words", F.size(F.split("phrase", " ")))


def _score(a: str, l: str, r: str) -> Column:
    """floor(2000000 * a / (l + r)), exact: the product may pass 64 bits."""
    return F.expr(f"(CAST(2000000 AS DECIMAL(7,0)) * CAST({a} AS DECIMAL(20,0))) DIV (CAST({l} AS DECIMAL(20,0)) + {r})")


def collocations(
    articles: DataFrame, *, least: int = 30, inside_percent: int = 80, top: int = 2000, unlisted: str = "und", shard_words: int = SHARD_WORDS
) -> DataFrame:
    """The strongest phrases of 2 to 4 words of each list's articles.

    articles: `content` and `list_key` (null: `unlisted`); other columns are not read. A-Z in lower case; marks and line ends part
    pieces, blanks and tabs part words; phrases don't cross pieces. Candidates occur at least `least` times in their list.
    A candidate's score is floor(2000000 * a / (l + r)) at its weakest cut in two, the shorter first part winning ties;
    candidates inside a longer one that occurs at least `inside_percent` percent as often are dropped. Returns per list the first `top` by score, a
    (both falling) and phrase: list_key, rank, phrase, a (occurrences), l, r (of the parts at the cut), n (all
    words of the list), score, n_left and n_right (occurrences with a further word before and after). Null and empty content
    has no words; repeated rows count again; lists without a candidate have no rows, an empty table gives an empty result.
    """
    rows = articles.select(F.coalesce("list_key", F.lit(unlisted)).alias("list_key"), F.col("content").cast("string").alias("content"))
    indexes = shard_indexes(rows, shard_words=shard_words)
    totals = indexes.groupBy("list_key").agg(F.sum("n_words").alias("all_words"))
    words, phrases = frequent_phrases(indexes, least)
    phrases = settle(phrases)
    counts = words.select("list_key", "phrase", "n").union(phrases.select("list_key", "phrase", "n"))
    part = lambda column, count: counts.select("list_key", F.col("phrase").alias(column), F.col("n").alias(count))
    cuts = phrases.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)))
    cuts = cuts.withColumns(
        {
            "head": F.array_join(F.slice(F.split("phrase", " "), F.lit(1), F.col("cut")), " "),
            "rest": F.array_join(F.slice(F.split("phrase", " "), F.col("cut") + 1, F.col("n_words") - F.col("cut")), " "),
        }
    )
    cuts = cuts.join(part("head", "l"), ["list_key", "head"]).join(part("rest", "r"), ["list_key", "rest"])
    cuts = cuts.withColumn("score", _score("n", "l", "r"))
    weakest = F.min(F.struct("score", "cut", "l", "r")).alias("weakest")
    same = ["list_key", "phrase"]
    scored = cuts.groupBy(*same).agg(weakest, *(F.first(x).alias(x) for x in ("n", "n_left", "n_right")))
    # what is inside longer candidates
    span = F.explode(F.expr("flatten(transform(sequence(2, n_words - 1), s -> transform(sequence(1, n_words - s + 1), i -> array_join(slice(split(phrase, ' '), i, s), ' '))))"))
    inside = phrases.where("n_words > 2").select("list_key", span.alias("phrase"), F.col("n").alias("longer_n"))
    inside = inside.groupBy(*same).agg(F.max("longer_n").alias("longer_n"))
    left = scored.join(inside, same, "left").where(
        F.col("longer_n").isNull() | (100 * F.col("longer_n") < inside_percent * F.col("n"))
    )
    order = Window.partitionBy("list_key").orderBy(F.desc("weakest.score"), F.desc("n"), "phrase")
    best = left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(totals, "list_key").select(
        "list_key",
        F.col("rank").cast("long").alias("rank"),
        "phrase",
        F.col("n").alias("a"),
        "weakest.l",
        "weakest.r",
        F.col("all_words").alias("n"),
        "weakest.score",
        "n_left",
        "n_right",
    )
