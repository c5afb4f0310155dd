"""Language-model scores of articles: a hashed maximum-entropy model with a class-factored softmax.

The most frequent words are in classes of a fixed size by rank; all other words are
in classes by their last bytes. The probability of a token is that of its class,
from features of the tokens before it, times that of the token in its class: for
frequent words again from such features, for the others from corpus counts with
one added, an unseen word of each class included. Features are the token before
(bigram), the one before that (skip) and both together (trigram), hashed into
tables of weights.

Counts of all words are summed over the whole training corpus by (hashed word)
keys. Weights are trained in rounds over disjoint parts of it: every task makes
gradient updates on a copy while its articles stream by, and the copies are
averaged row by row, weighted by the tokens that touched a row. Words are
identified by 64-bit hashes throughout.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankmill.llm.sharing import opened, share
from rankmill.llm.words import LOWER, SPACE_WORDS, bounds, hashes, mix, pieces
from rankmill.session import settle

END = np.uint64(0x1F3A5C7E9B2D4F68)  # the end of an article, a token like any other
TOP_WORDS = 100_000  # words whose counts are at hand in every task; all others are joined
CLASSES, CLASS_WORDS = 16, 64
HEAD_WORDS = CLASSES * CLASS_WORDS
TAIL_CLASSES = 32
OUTPUTS = CLASSES + TAIL_CLASSES
FEATURES = HEAD_WORDS + TAIL_CLASSES + 1  # what a token before can be; the last is the start
START = FEATURES - 1
HASHED = 1 << 13
ROUNDS = 2
BATCH = 1 << 14
RATE, CALM = 1.0, 30.0  # step of a row: RATE / (tokens that touched it + CALM)
BLOCK_ROWS = 256


@dataclass
class Tokens:
    """Tokens of many texts in order, an end after each."""

    keys: np.ndarray
    tails: np.ndarray
    of_text: np.ndarray

    @staticmethod
    def of(data: np.ndarray, offsets: np.ndarray) -> Tokens:
        data = LOWER[data]
        starts, ends, of_text = bounds(data, offsets, SPACE_WORDS)
        n_texts = len(offsets) - 1
        of_text = of_text + np.arange(n_texts + 1)
        keys = np.full(of_text[-1], END, dtype=np.uint64)
        tails = np.zeros(of_text[-1], dtype=np.int64)
        word = np.ones(of_text[-1], dtype=bool)
        word[of_text[1:] - 1] = False
        keys[word] = hashes(data, starts, ends)
        if len(starts):
            before = np.where(ends - starts > 1, data[ends - 2], 0).astype(np.uint64)
            last = data[ends - 1].astype(np.uint64) * np.uint64(256) + before
            tails[word] = (mix(last) % np.uint64(TAIL_CLASSES)).astype(np.int64)
        return Tokens(keys, tails, of_text)


def _table(rows: int, width: int):
    return field(default_factory=lambda: np.zeros((rows, width), dtype=np.float32))


@dataclass
class Weights:
    """Tables of weights; each has a count of the tokens that touched a row."""

    near: np.ndarray = _table(FEATURES, OUTPUTS)
    skip: np.ndarray = _table(FEATURES, OUTPUTS)
    both: np.ndarray = _table(HASHED, OUTPUTS)
    inner: np.ndarray = _table(HASHED, CLASS_WORDS)
    seen: dict[str, np.ndarray] = field(
        default_factory=lambda: {n: np.zeros(FEATURES if n in ("near", "skip") else HASHED, dtype=np.float32) for n in TABLES}
    )


TABLES = ("near", "skip", "both", "inner")


@dataclass
class LanguageModel:
    n_tokens: int  # N
    n_words: int  # V
    top_keys: np.ndarray  # sorted
    top_counts: np.ndarray
    head: np.ndarray  # number of a head word by place in top_keys, -1 for others
    class_bias: np.ndarray
    word_bias: np.ndarray
    tail_log: np.ndarray  # log10 of a tail class's tokens, words and unseen word
    weights: Weights

    def places(self, keys: np.ndarray) -> np.ndarray:
        """Place in top_keys, -1 for other words."""
        if not len(self.top_keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.top_keys, keys), len(self.top_keys) - 1)
        return np.where(self.top_keys[at] == keys, at, -1)

    def features(self, tokens: Tokens, places: np.ndarray) -> Features:
        head = np.where(places >= 0, self.head[np.maximum(places, 0)] if len(self.head) else -1, -1)
        return Features.of(head, tokens)


@dataclass
class Features:
    """Per token: its class, its number in a head class, and rows of the tables."""

    head: np.ndarray
    output: np.ndarray
    near: np.ndarray
    skip: np.ndarray
    both: np.ndarray

    @staticmethod
    def of(head: np.ndarray, tokens: Tokens) -> Features:
        as_feature = np.where(head >= 0, head, HEAD_WORDS + tokens.tails)
        output = np.where(head >= 0, head // CLASS_WORDS, CLASSES + tokens.tails)
        first = tokens.of_text[:-1]
        near = np.empty_like(as_feature)
        near[1:], near[first] = as_feature[:-1], START
        skip = np.empty_like(as_feature)
        skip[1:], skip[first] = near[:-1], START
        both = (near * 1_000_003 + skip * 7_919) * 0x9E3779B1 >> 15 & HASHED - 1
        return Features(head, output, near, skip, both)

    def inner_rows(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        output = self.output[chosen]
        a = (self.near[chosen] * CLASSES + output) * 0x9E3779B1 >> 13 & HASHED - 1
        b = (self.skip[chosen] * CLASSES + output + 977) * 0x85EBCA6B >> 14 & HASHED - 1
        return a, b


def _softmax(logits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities and log of the norm; overwrites."""
    most = logits.max(1, keepdims=True)
    logits -= most
    np.exp(logits, out=logits)
    norm = logits.sum(1, keepdims=True)
    logits /= norm
    return logits, (np.log(norm) + most)[:, 0]


def _class_logits(model: LanguageModel, f: Features, part: slice) -> np.ndarray:
    w = model.weights
    logits = w.near[f.near[part]]
    logits += w.skip[f.skip[part]]
    logits += w.both[f.both[part]]
    logits += model.class_bias
    return logits


def _word_logits(model: LanguageModel, f: Features, chosen: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    rows = f.inner_rows(chosen)
    logits = model.weights.inner[rows[0]]
    logits += model.weights.inner[rows[1]]
    logits += model.word_bias[f.output[chosen]]
    return logits, rows


def _batches(n: int) -> Iterator[slice]:
    for a in range(0, n, BATCH):
        yield slice(a, min(a + BATCH, n))


def log_probabilities(model: LanguageModel, f: Features) -> np.ndarray:
    """log10 of each token's class probability, for head words times the word's in its class."""
    out = np.empty(len(f.output))
    for part in _batches(len(out)):
        logits = _class_logits(model, f, part)
        here = logits[np.arange(len(logits)), f.output[part]].astype(np.float64)
        out[part] = here - _softmax(logits)[1]
        chosen = part.start + np.flatnonzero(f.head[part] >= 0)
        if len(chosen):
            logits, _ = _word_logits(model, f, chosen)
            here = logits[np.arange(len(logits)), f.head[chosen] % CLASS_WORDS].astype(np.float64)
            out[chosen] += here - _softmax(logits)[1]
    return out / np.log(10)


def _step(table: np.ndarray, seen: np.ndarray, rows: np.ndarray, gradient: np.ndarray) -> None:
    order = np.argsort(rows, kind="stable")
    rows = rows[order]
    first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    sums = np.add.reduceat(gradient[order], first, axis=0)
    touched = rows[first]
    seen[touched] += np.diff(np.append(first, len(rows)))
    table[touched] += sums * (RATE / (seen[touched] + CALM))[:, None]


def update(model: LanguageModel, f: Features) -> None:
    """Gradient updates, batch by batch: targets less probabilities, added to the rows of the features."""
    w = model.weights
    for part in _batches(len(f.output)):
        p, _ = _softmax(_class_logits(model, f, part))
        np.negative(p, out=p)
        p[np.arange(len(p)), f.output[part]] += 1
        for name, rows in (("near", f.near), ("skip", f.skip), ("both", f.both)):
            _step(getattr(w, name), w.seen[name], rows[part], p)
        chosen = part.start + np.flatnonzero(f.head[part] >= 0)
        if len(chosen):
            logits, (a, b) = _word_logits(model, f, chosen)
            p, _ = _softmax(logits)
            np.negative(p, out=p)
            p[np.arange(len(p)), f.head[chosen] % CLASS_WORDS] += 1
            _step(w.inner, w.seen["inner"], a, p)
            _step(w.inner, w.seen["inner"], b, p)


def count_words(articles: DataFrame) -> DataFrame:
    """word (hash as long), tail (class), n: counts of all tokens of `content`, added up in the tasks first."""
    schema = pa.schema([("word", pa.int64()), ("tail", pa.int32()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def added() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            keys, tails, n = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            return keys[first], tails[order][first], np.add.reduceat(n[order], first)

        def rows() -> Iterator[pa.RecordBatch]:
            keys, tails, n = added()
            for a in range(0, len(keys), 100_000):
                part = slice(a, a + 100_000)
                columns = [keys[part].view(np.int64), tails[part].astype(np.int32), n[part]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=schema)

        for batch in batches:
            for _, data, offsets in pieces(batch.column(0)):
                tokens = Tokens.of(data, offsets)
                held.append(_counted(tokens))
                if len(held) >= 32:
                    held[:] = [added()]
                    if len(held[0][0]) > 2_000_000:  # memory stays bounded, the sum goes on behind the shuffle
                        yield from rows()
                        held.clear()
        if held:
            yield from rows()

    counted = articles.select(F.col("content").cast("string").alias("content")).mapInArrow(count, "word long, tail int, n long")
    return counted.groupBy("word", "tail").agg(F.sum("n").alias("n"))


def _counted(tokens: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys, first, n = np.unique(tokens.keys, return_index=True, return_counts=True)
    return keys, tokens.tails[first], n


def top_words(counts: DataFrame) -> DataFrame:
    """The words from a count on that at most TOP_WORDS words reach, found by a histogram of the counts."""
    step = F.floor(F.log2("n") * 64).cast("int")
    histogram = counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words")).collect()
    least, total = None, 0
    for step_, words in sorted(((r["step"], r["words"]) for r in histogram), reverse=True):
        total += words
        if total > TOP_WORDS:
            break
        least = step_
    return counts.where(F.lit(False) if least is None else step >= least)


def start_model(counts: DataFrame) -> LanguageModel:
    """The model that knows frequencies only. Of the counts, TOP_WORDS rows and a row per tail class reach the driver."""
    by_tail = {r["tail"]: r for r in counts.groupBy("tail").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()}
    top = top_words(counts).orderBy(F.desc("n"), "word").toPandas()
    keys, n, tails = top["word"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64), top["tail"].to_numpy(np.int64)
    order = np.argsort(keys)
    rank = np.arange(len(keys))
    tokens_of = np.array([float(by_tail[t]["n"]) if t in by_tail else 0.0 for t in range(TAIL_CLASSES)])
    words_of = np.array([float(by_tail[t]["v"]) if t in by_tail else 0.0 for t in range(TAIL_CLASSES)])
    head = rank < HEAD_WORDS
    tokens_of -= np.bincount(tails[head], weights=n[head], minlength=TAIL_CLASSES)
    words_of -= np.bincount(tails[head], minlength=TAIL_CLASSES)
    head_counts = np.zeros(HEAD_WORDS)
    head_counts[: head.sum()] = n[head]
    head_counts = head_counts.reshape(CLASSES, CLASS_WORDS)
    per_output = np.concatenate([head_counts.sum(1), tokens_of]) + 1.0
    with np.errstate(divide="ignore"):
        inner = np.where(head_counts > 0, np.log(np.maximum(head_counts, 1)), -30.0)  # places that no word has
    return LanguageModel(
        n_tokens=int(sum(r["n"] for r in by_tail.values())),
        n_words=int(sum(r["v"] for r in by_tail.values())),
        top_keys=keys[order],
        top_counts=n[order],
        head=np.where(head, rank, -1)[order],
        class_bias=np.log(per_output / per_output.sum()).astype(np.float32),
        word_bias=(inner - np.log(np.exp(inner).sum(1, keepdims=True))).astype(np.float32),
        tail_log=np.log10(tokens_of + words_of + 1),
        weights=Weights(),
    )


def train(model: LanguageModel, articles: DataFrame, *, rounds: int = ROUNDS) -> LanguageModel:
    """Trains on all articles, each in one of the rounds: `content` and `part` (a whole number that deals them out)."""
    spark = articles.sparkSession
    schema = pa.schema([("name", pa.string()), ("block", pa.int32()), ("deltas", pa.binary()), ("seen", pa.binary())])
    columns = "name string, block int, deltas binary, seen binary"

    def learn(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = opened(shared)
            old, any_rows = opened(shared).weights, False
            for batch in batches:
                for _, data, offsets in pieces(batch.column(0)):
                    tokens = Tokens.of(data, offsets)
                    update(model, model.features(tokens, model.places(tokens.keys)))
                    any_rows = True
            for name in TABLES if any_rows else ():
                seen = model.weights.seen[name] - old.seen[name]
                deltas = (getattr(model.weights, name) - getattr(old, name)) * seen[:, None]
                for block, a in enumerate(range(0, len(seen), BLOCK_ROWS)):
                    part = slice(a, a + BLOCK_ROWS)
                    row = {"name": [name], "block": [block], "deltas": [deltas[part].astype("<f4").tobytes()], "seen": [seen[part].astype("<f4").tobytes()]}
                    yield pa.RecordBatch.from_pydict(row, schema=schema)

        return run

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deltas, seen, copies = None, None, 0
        for batch in batches:
            for d, s in zip(batch.column(2), batch.column(3)):
                d, s = np.frombuffer(d.as_buffer(), "<f4").astype(np.float64), np.frombuffer(s.as_buffer(), "<f4").astype(np.float64)
                deltas, seen = (d, s) if deltas is None else (deltas + d, seen + s)
                copies += 1
        mean = deltas.reshape(len(seen), -1) / np.maximum(seen, 1e-9)[:, None]
        row = {"name": [key[0].as_py()], "block": [key[1].as_py()], "deltas": [mean.astype("<f4").tobytes()], "seen": [(seen / copies).astype("<f4").tobytes()]}
        yield pa.RecordBatch.from_pydict(row, schema=schema)

    for number in range(rounds):
        shared = share(spark.sparkContext, _slim(model))
        mine = articles.where(F.pmod(F.col("part"), F.lit(rounds)) == number).select(F.col("content").cast("string").alias("content"))
        summed = mine.mapInArrow(learn(shared), columns).groupBy("name", "block").applyInArrow(add, columns)
        for row in summed.toLocalIterator():
            table, seen = getattr(model.weights, row["name"]), model.weights.seen[row["name"]]
            part = slice(row["block"] * BLOCK_ROWS, row["block"] * BLOCK_ROWS + BLOCK_ROWS)
            table[part] += np.frombuffer(row["deltas"], "<f4").reshape(-1, table.shape[1])
            seen[part] += np.frombuffer(row["seen"], "<f4")
    return model


def _slim(model: LanguageModel) -> LanguageModel:
    """Training looks up head words only."""
    head = model.head >= 0
    slim = {"top_keys": model.top_keys[head], "top_counts": model.top_counts[head], "head": model.head[head]}
    return LanguageModel(**{**model.__dict__, **slim})


def score_articles(articles: DataFrame, model: LanguageModel, counts: DataFrame) -> DataFrame:
    """Scores every article under the model and under word frequencies alone.

    articles: `id` (integer), `content`; other columns are not read. Returns per
    row id, n_tokens (words and one end), n_known (tokens with a count), base_score
    (sum of log10((c + 1) / (N + V + 1))), score (log10 of the model's probability
    of the text). Null and empty content is one end. Repeated rows stay, an empty
    table gives an empty result; a model of no articles knows no token.

    Counts beyond the TOP_WORDS most frequent words are joined by word; none of
    these has more than a TOP_WORDS-th of all tokens, so no key is hot.
    """
    spark = articles.sparkSession
    shared = share(spark.sparkContext, model)
    rare = pa.list_(pa.struct([("word", pa.int64()), ("n", pa.int32())]))
    schema = pa.schema(
        [("row", pa.int64()), ("id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64())]
        + [("log_counts", pa.float64()), ("log_model", pa.float64()), ("rare", rare)]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        model, row = opened(shared), TaskContext.get().partitionId() << 40
        logs = np.log10(model.top_counts + 1.0)
        for batch in batches:
            for first, data, offsets in pieces(batch.column(1)):
                n = len(offsets) - 1
                tokens = Tokens.of(data, offsets)
                places = model.places(tokens.keys)
                f = model.features(tokens, places)
                known = places >= 0
                log_counts = np.where(known, logs[np.maximum(places, 0)] if len(logs) else 0.0, 0.0)
                in_tail = f.head < 0
                log_model = log_probabilities(model, f) + np.where(in_tail, log_counts - model.tail_log[tokens.tails], 0.0)

                def per_text(values: np.ndarray) -> np.ndarray:
                    return np.add.reduceat(values, tokens.of_text[:-1])

                at = np.flatnonzero(~known)
                text_of = np.searchsorted(tokens.of_text, at, side="right") - 1
                order = np.lexsort((tokens.keys[at], text_of))
                keys, text_of = tokens.keys[at][order], text_of[order]
                new = np.ones(len(keys), dtype=bool)
                new[1:] = (keys[1:] != keys[:-1]) | (text_of[1:] != text_of[:-1])
                starts = np.flatnonzero(new)
                times = np.diff(np.append(starts, len(keys))).astype(np.int32)
                cuts = np.searchsorted(text_of[starts], np.arange(n + 1)).astype(np.int32)
                words = pa.StructArray.from_arrays([pa.array(keys[starts].view(np.int64)), pa.array(times)], names=["word", "n"])
                columns = [
                    pa.array(np.arange(row, row + n)),
                    batch.column(0).slice(first, n),
                    pa.array(np.diff(tokens.of_text)),
                    pa.array(per_text(known.astype(np.int64))),
                    pa.array(per_text(log_counts)),
                    pa.array(per_text(log_model)),
                    pa.ListArray.from_arrays(pa.array(cuts), words),
                ]
                row += n
                yield pa.RecordBatch.from_arrays([c.cast(t.type) for c, t in zip(columns, schema)], schema=schema)

    rows = articles.select(F.col("id").cast("long").alias("id"), F.col("content").cast("string").alias("content"))
    columns = "row long, id long, n_tokens long, n_known long, log_counts double, log_model double, rare array<struct<word: long, n: int>>"
    scored = settle(rows.mapInArrow(run, columns))  # written once: row numbers hold for all that follows
    wanted = scored.select("row", F.explode("rare").alias("r")).select("row", "r.word", F.col("r.n").alias("times"))
    known = wanted.join(counts.select("word", "n"), "word").groupBy("row").agg(
        F.sum("times").alias("more_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more_logs")
    )
    more = F.coalesce("more_logs", F.lit(0.0))
    per_token = F.log10(F.lit(float(model.n_tokens + model.n_words + 1)))
    return scored.drop("rare").join(known, "row", "left").select(
        "id",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        (F.col("log_counts") + more - F.col("n_tokens") * per_token).alias("base_score"),
        (F.col("log_model") + more).alias("score"),
    )


def learn(articles: DataFrame, *, rounds: int = ROUNDS) -> tuple[LanguageModel, DataFrame]:
    """The trained model and the written table of counts, from `content` and `part` of all given articles."""
    counts = settle(count_words(articles))
    return train(start_model(counts), articles, rounds=rounds), counts
