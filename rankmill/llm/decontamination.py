"""Benchmark decontamination of articles: a generalised suffix automaton of the benchmark items.

Items are normalised to words and cut into pieces of at most PIECE_WORDS words
that overlap by a window less one word, so no window is lost. Pieces go by hash
into blocks of about BLOCK_WORDS words; each block becomes one automaton, built in a task, a row of a written table.
Articles stream through one automaton after another, a pass each; all passes but the last write only the few rows that have hits, and
the last takes these in. So a task holds one block at a time, and one block is what passes through the driver, whatever the
benchmark's size. What is over the coverage limit is dropped; of the rest, spans over the length limit are cut out.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankmill.llm.words import ALNUM_WORDS, LOWER, bounds, hashes, pieces
from rankmill.session import settle

WINDOW = 13
#: limits of an article: hit words in percent of its words, and words of a span that may stay in it
COVERAGE_PERCENT = 5
SPAN_WORDS = 26
PIECE_WORDS = 5_000
BLOCK_WORDS = 200_000

#: fixed values of the contract, for texts in lower case
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TO_LOWER = bytes(LOWER.tolist())


def item_words(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode().translate(TO_LOWER))


class Automaton:
    """Generalised suffix automaton over word numbers, in arrays.

    An edge is a (state, word) key in a sorted array. `class_of` is the state of
    a state's suffix of `window` words, which knows the items that hold this
    window; `short` are the whole items of fewer words that end a state's strings.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        vocabulary = sorted({w for _, words in items for w in words})
        number = {w: i for i, w in enumerate(vocabulary)}
        raw = np.frombuffer(b"".join(vocabulary), dtype=np.uint8)
        ends = np.cumsum([len(w) for w in vocabulary], dtype=np.int64)
        starts = ends - np.array([len(w) for w in vocabulary], dtype=np.int64)
        keys = hashes(raw, starts, ends)
        order = np.argsort(keys)
        self.word_keys, place = keys[order], np.empty(len(keys), dtype=np.int64)
        place[order] = np.arange(len(keys))
        sequences = [(name, [int(place[number[w]]) for w in words]) for name, words in items if words]
        self.shortest = min((min(len(s), window) for _, s in sequences), default=0)
        self.pairs = np.unique(
            np.array([a * len(keys) + b for _, s in sequences for a, b in zip(s, s[1:])], dtype=np.int64)
        )
        self._build(sequences)

    def _build(self, sequences: list[tuple[str, list[int]]]) -> None:
        edges: list[dict[int, int]] = [{}]
        link, length = [-1], [0]
        items: list[set[str]] = [set()]

        def new(n: int, out: dict[int, int], at: int) -> int:
            edges.append(out)
            length.append(n)
            link.append(at)
            items.append(set())
            return len(length) - 1

        def split(p: int, word: int, q: int) -> int:
            """The state of p's string with the word, parted from longer strings of q."""
            if length[q] == length[p] + 1:
                return q
            clone = new(length[p] + 1, dict(edges[q]), link[q])
            link[q] = clone
            while p >= 0 and edges[p].get(word) == q:
                edges[p][word] = clone
                p = link[p]
            return clone

        for name, sequence in sequences:
            last = 0
            for word in sequence:
                if word in edges[last]:
                    last = split(last, word, edges[last][word])
                else:
                    here, p = new(length[last] + 1, {}, 0), last
                    while p >= 0 and word not in edges[p]:
                        edges[p][word] = here
                        p = link[p]
                    if p >= 0:
                        link[here] = split(p, word, edges[p][word])
                    last = here
                if length[last] >= self.window:
                    items[last].add(name)
        by_length = sorted(range(1, len(length)), key=length.__getitem__)
        for state in reversed(by_length):
            if length[link[state]] >= self.window:
                items[link[state]] |= items[state]
        class_of = list(range(len(length)))
        for state in by_length:
            if length[link[state]] >= self.window:
                class_of[state] = class_of[link[state]]
        whole: dict[int, list[tuple[int, str]]] = {}
        for name, sequence in sequences:
            if len(sequence) < self.window:
                state = 0
                for word in sequence:
                    state = edges[state][word]
                whole.setdefault(state, []).append((len(sequence), name))
        short: dict[int, list[tuple[int, str]]] = {}
        for state in by_length:
            if found := whole.get(state, []) + short.get(link[state], []):
                short[state] = found
        self.short = short
        self.items = {s: frozenset(items[s]) for s in set(class_of) if length[s] >= self.window}
        self.class_of = np.array(class_of, dtype=np.int32)
        self.link, self.length = np.array(link, dtype=np.int32), np.array(length, dtype=np.int32)
        flat = [(s * len(self.word_keys) + w, t) for s, out in enumerate(edges) for w, t in out.items()]
        flat.sort()
        self.edge_keys = np.array([k for k, _ in flat], dtype=np.int64)
        self.edge_to = np.array([t for _, t in flat], dtype=np.int32)

    def packed(self) -> bytes:
        return pickle.dumps(vars(self))

    @classmethod
    def unpacked(cls, data: bytes) -> Automaton:
        made = cls.__new__(cls)
        vars(made).update(pickle.loads(data))
        return made

    def step(self, state: int, word: int) -> int:
        """The state after one more word, or -1."""
        key = state * len(self.word_keys) + word
        i = int(np.searchsorted(self.edge_keys, key))
        return int(self.edge_to[i]) if i < len(self.edge_keys) and self.edge_keys[i] == key else -1

    def matches(self, words: list[int]) -> Iterator[tuple[int, int, set[str]]]:
        """(start, end, items) of the windows that end at each word: the longest match is tracked from word to word."""
        state, matched = 0, 0
        for i, word in enumerate(words):
            while (to := self.step(state, word)) < 0 and state:
                state = int(self.link[state])
                matched = int(self.length[state])
            if to < 0:
                continue
            state, matched = to, matched + 1
            if matched >= self.window:
                yield i + 1 - self.window, i + 1, self.items[int(self.class_of[state])]
            for n, name in self.short.get(state, ()):
                if n <= matched:
                    yield i + 1 - n, i + 1, {name}

    def runs(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, of_text: np.ndarray):
        """Word numbers, and the runs of words that could hold a window: all neighbours in them are neighbours in an item."""
        keys = hashes(data, starts, ends)
        number = np.searchsorted(self.word_keys, keys)
        number[number == len(self.word_keys)] = 0
        known = self.word_keys[number] == keys
        joined = np.zeros(len(keys), dtype=bool)  # a word goes with the one before it
        if len(keys) > 1 and len(self.pairs):
            pair = number[:-1] * len(self.word_keys) + number[1:]
            at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            joined[1:] = (self.pairs[at] == pair) & known[:-1] & known[1:]
        joined[of_text[:-1][of_text[:-1] < len(keys)]] = False
        first = np.flatnonzero(known & ~joined)
        stop = np.append(known[1:] & joined[1:], False)
        last = np.flatnonzero(known & ~stop) + 1
        long = last - first >= self.shortest
        return number, first[long], last[long]

    def scan(self, data: np.ndarray, offsets: np.ndarray):
        """Per text: number of words, hit spans (united), items."""
        data = LOWER[data]
        starts, ends, of_text = bounds(data, offsets, ALNUM_WORDS)
        n = len(offsets) - 1
        spans, items = [[] for _ in range(n)], [set() for _ in range(n)]
        if len(starts) and len(self.word_keys):
            number, first, last = self.runs(data, starts, ends, of_text)
            text_of = np.searchsorted(of_text, first, side="right") - 1
            for a, b, text in zip(first.tolist(), last.tolist(), text_of.tolist()):
                base = a - int(of_text[text])
                for x, y, names in self.matches(number[a:b].tolist()):
                    spans[text].append((base + x, base + y))
                    items[text] |= names
        return np.diff(of_text).tolist(), [united(s) for s in spans], items


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def cut_out(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without these spans of words (sorted, apart): each goes with what stands between it and the next word."""
    data = np.frombuffer(text, dtype=np.uint8)
    starts, ends, _ = bounds(LOWER[data], np.array([0, len(data)]), ALNUM_WORDS)
    kept, at = [], 0
    for a, b in spans:
        kept.append(text[at : int(starts[a])])
        at = int(starts[b]) if b < len(starts) else int(ends[b - 1])
    return b"".join([*kept, text[at:]])


def item_automata(items: DataFrame, window: int, block_words: int) -> DataFrame:
    """block, automaton: a written table with one row for each block of the benchmark, each built in a task of its own."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, texts, counts = [], [], []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = item_words(text)
                step = max(PIECE_WORDS - window + 1, 1)
                for i in range(0, max(len(words) - window + 1, 1), step):
                    part = words[i : i + PIECE_WORDS]
                    names.append(name or "")
                    texts.append(b" ".join(part).decode())
                    counts.append(len(part))
            yield pa.RecordBatch.from_pydict({"item": names, "words": texts, "n": pa.array(counts, type=pa.int64())})

    def build(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [(n, w.encode().split(b" ")) for batch in batches for n, w in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        data = Automaton(found, window).packed()
        yield pa.RecordBatch.from_pydict({"block": pa.array([key[0].as_py()], pa.int32()), "automaton": pa.array([data], pa.binary())})

    rows = items.select(F.col("item_id").cast("string").alias("item"), "text")
    cuts = settle(rows.mapInArrow(cut, "item string, words string, n long").where("n > 0").distinct())
    total = cuts.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-total // block_words))
    placed = cuts.select(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)).cast("int").alias("block"), "item", "words")
    return settle(placed.groupBy("block").applyInArrow(build, "block int, automaton binary"))


SPANS = "array<struct<start: long, end: long>>"


class _Hits:
    """What one pass finds in a batch of texts, together with what the passes before it have found."""

    def __init__(self, data: bytes | None, window: int):
        self.automaton = Automaton.unpacked(data) if data else Automaton([], window)

    def find(self, texts: pa.Array, spans: pa.Array | None, items: pa.Array | None):
        """Per text: its index, bytes, number of words, spans (united) and items."""
        for first, data, offsets in pieces(texts):
            n_words, found, names = self.automaton.scan(data, offsets)
            for i, n in enumerate(n_words):
                if spans is not None and spans[first + i].is_valid:
                    found[i] = united(found[i] + [(x["start"], x["end"]) for x in spans[first + i].as_py()])
                    names[i] |= set(items[first + i].as_py())
                yield first + i, data[offsets[i] : offsets[i + 1]], n, found[i], names[i]


def _passes(rows: DataFrame, items: DataFrame, window: int, block_words: int):
    """(rows with the hits of all blocks but the last, what makes the last block's _Hits in a task).

    rows: any columns, `content` the last one. Where there are several blocks, `spans` and `items` are added, null without hits.
    """
    spark = rows.sparkSession
    table = item_automata(items, window, block_words)
    blocks = sorted(r["block"] for r in table.select("block").collect())

    def maker(block: int | None):
        data = table.where(F.col("block") == block).first()["automaton"] if block is not None else None
        shared = spark.sparkContext.broadcast(bytes(data) if data else None)
        return lambda: _Hits(shared.value, window)

    schema = pa.schema(
        [("key", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string()))]
    )

    def hits_of(make):
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hits = make()
            for batch in batches:
                found = [(i, s, x) for i, _, _, s, x in hits.find(batch.column(1), None, None) if s]
                columns = [
                    batch.column(0).take(pa.array([i for i, _, _ in found], pa.int64())),
                    pa.array([[{"start": a, "end": b} for a, b in s] for _, s, _ in found], type=schema.field(1).type),
                    pa.array([sorted(x) for _, _, x in found], type=schema.field(2).type),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

        return scan

    if len(blocks) > 1:
        key = F.xxhash64("content")
        keyed = rows.select(key.alias("key"), "content")
        earlier = [settle(keyed.mapInArrow(hits_of(maker(block)), f"key long, spans {SPANS}, items array<string>")) for block in blocks[:-1]]
        found = earlier[0]
        for more in earlier[1:]:
            found = found.union(more)
        once = found.distinct().groupBy("key").agg(  # texts have the same hits wherever they are
            F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items")
        )
        rows = rows.withColumn("key", key).join(once, "key", "left").drop("key")
    return rows, maker(blocks[-1] if blocks else None)


def benchmark_hits(articles: DataFrame, items: DataFrame, *, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Where articles repeat benchmark items.

    articles: `id` (integer), `content`; items: `item_id`, `text` (the project has
    no benchmark, so items are general); other columns are not read. A window is
    `window` consecutive words of an item, or a whole item of fewer. Returns per
    article row: id, n_words, spans (array of start, end in words: united
    occurrences of windows), items (sorted item ids as text). Null and empty
    content has no words, an item without words has no window, a null item id is
    the empty text. Repeated rows stay, repeated items count once. Memory is bounded by a block and the longest
    article; only articles with hits in several blocks' passes are joined.
    """
    schema = pa.schema(
        [
            ("id", pa.int64()),
            ("n_words", pa.int64()),
            ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            ("items", pa.list_(pa.string())),
        ]
    )
    rows = articles.select(F.col("id").cast("long").alias("id"), F.col("content").cast("string").alias("content"))
    rows, make = _passes(rows, items, window, block_words)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = make()
        for batch in batches:
            earlier = (batch.column(2), batch.column(3)) if batch.num_columns > 2 else (None, None)
            found = list(hits.find(batch.column(1), *earlier))
            columns = [
                batch.column(0),
                pa.array([n for _, _, n, _, _ in found], type=pa.int64()),
                pa.array([[{"start": a, "end": b} for a, b in s] for _, _, _, s, _ in found], type=schema.field(2).type),
                pa.array([sorted(x) for *_, x in found], type=schema.field(3).type),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return rows.mapInArrow(scan, f"id long, n_words long, spans {SPANS}, items array<string>")


def n_hit(spans: Column) -> Column:
    """Words inside any occurrence of a window."""
    return F.aggregate(spans, F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])


def over_limit(n_words: Column, hit: Column, percent: int = COVERAGE_PERCENT) -> Column:
    """True where an occurrence exists and the covered part reaches the limit."""
    return (hit > 0) & (hit * 100 >= n_words * percent)


def clean_articles(
    rows: DataFrame,
    content: str,
    items: DataFrame,
    *,
    window: int = WINDOW,
    percent: int = COVERAGE_PERCENT,
    span_words: int = SPAN_WORDS,
    n_chars: str | None = None,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """The rows whose content isn't over the coverage limit, without spans of more than `span_words` words in a row from items.

    Keeps the given columns, whatever their names; only `content` changes, where a span is cut out of it, and the column
    `n_chars` names, if any, is then its number of characters. Null and empty content stays as it is, so do repeated rows.
    """
    given = [F.col(f"`{c}`") for c in rows.columns]
    made = rows.select(F.struct(*given).alias("given"), F.col(f"`{content}`").cast("string").alias("content"))
    made, make = _passes(made, items, window, block_words)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = make()
        for batch in batches:
            earlier = (batch.column(2), batch.column(3)) if batch.num_columns > 2 else (None, None)
            chosen, texts = [], []
            for i, data, n, spans, _ in hits.find(batch.column(1), *earlier):
                hit = sum(b - a for a, b in spans)
                if hit > 0 and hit * 100 >= n * percent:
                    continue
                long = [(a, b) for a, b in spans if b - a > span_words]
                chosen.append(i)
                texts.append(cut_out(data.tobytes(), long).decode() if long else None)
            is_cut = pa.array([t is not None for t in texts], pa.bool_())
            columns = [batch.column(0).take(pa.array(chosen, pa.int64())), is_cut, pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["given", "cut", "content"])

    kept = made.mapInArrow(keep, made.select("given").schema.add("cut", "boolean").add("content", "string"))
    out = []
    for c in rows.columns:
        old = F.col("given").getField(c)
        if c == content:
            old = F.when(F.col("cut"), F.col("content")).otherwise(old)
        elif c == n_chars:
            old = F.when(F.col("cut"), F.length("content").cast(rows.schema[c].dataType)).otherwise(old)
        out.append(old.alias(c))
    return kept.select(*out)
