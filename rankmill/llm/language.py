"""Languages of articles: script ranges, per-word scores, and Viterbi with a penalty for switching.

Learning sums, per language, hashed counts of words and of byte trigrams inside
words, and counts of scripts. A word's score in a language is its log probability
from these tables; only languages that were seen in the word's script take part.
The best path through the words of an article, where a change of language costs
`switch`, gives spans of one language each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankmill.llm.sharing import opened, share
from rankmill.llm.words import LOWER, bounds, byte_table, hashes, pieces

BUCKETS = 1 << 16
BLOCK = 1 << 12
SWITCH = 12.0
FLOOR = -6.0  # the least a word can count against a language
UNKNOWN = "und"
SCORED_BYTES = 1 << 20
LABELLED_BYTES = 4 << 20

#: Unicode ranges of scripts by the lead bytes of UTF-8: last lead byte, script; 0 is no letter
SCRIPT_RANGES = (
    (0x40, 0), (0x5A, 1), (0x60, 0), (0x7A, 1), (0xC2, 0), (0xCA, 1), (0xCD, 0), (0xCF, 2), (0xD4, 3), (0xD5, 4),
    (0xD7, 5), (0xDB, 6), (0xDF, 7), (0xE0, 8), (0xE1, 9), (0xE2, 0), (0xE3, 10), (0xE9, 11), (0xED, 12), (0xEE, 0),
    (0xEF, 13), (0xFF, 14),
)
SCRIPTS = 15
SCRIPT_OF = np.zeros(256, dtype=np.int8)
for _i, (_last, _script) in enumerate(SCRIPT_RANGES):
    SCRIPT_OF[(SCRIPT_RANGES[_i - 1][0] + 1 if _i else 0) : _last + 1] = _script

#: words are runs of letters and of everything beyond ASCII
LETTERS = byte_table(bytes(b for b in range(0x80) if not chr(b).isalpha()))


class Words:
    """The words of a piece with their hashed features."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.starts, self.ends, self.of_text = bounds(data, offsets, LETTERS)
        data = LOWER[data]
        script = SCRIPT_OF[data]
        scripts = np.zeros(len(self.starts), dtype=np.int8)
        if len(self.starts):
            scripts = np.maximum.reduceat(script, self.starts)
            # reduceat runs to the next start; what is between words is no letter
        self.script = scripts
        self.bucket = (hashes(data, self.starts, self.ends) >> np.uint64(48)).astype(np.int64)
        inside = LETTERS[data]
        here = np.where(inside, data, 0x20).astype(np.uint32)
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[self.starts] = True
        one = np.empty_like(here)
        one[:1], one[1:] = 0x20, here[:-1]
        one[edge[:-1]] = 0x20
        two = np.empty_like(here)
        two[:1], two[1:] = 0x20, one[:-1]
        two[one == 0x20] = 0x20
        gram = (here | (one << np.uint32(8)) | (two << np.uint32(16))) * np.uint32(0x9E3779B1)
        self.gram = (gram >> np.uint32(16)).astype(np.int32)
        self.inside = inside


@dataclass
class Model:
    """Log probabilities per language: of word buckets, of trigram buckets, and which scripts it is written in."""

    languages: list[str]
    words: np.ndarray
    grams: np.ndarray
    scripts: np.ndarray

    @staticmethod
    def of_counts(counts: dict[str, np.ndarray]) -> Model:
        languages = sorted(counts)
        table = np.array([counts[x] for x in languages], dtype=np.float64).reshape(len(languages), 2 * BUCKETS + BLOCK)

        def logs(part: np.ndarray, smooth: float) -> np.ndarray:
            return np.log((part + smooth) / (part.sum(1, keepdims=True) + smooth * part.shape[1])).astype(np.float32)

        scripts = table[:, 2 * BUCKETS : 2 * BUCKETS + SCRIPTS]
        used = scripts * 1000 >= scripts.sum(1, keepdims=True)  # a thousandth of a language's words
        return Model(languages, logs(table[:, :BUCKETS], 0.1), logs(table[:, BUCKETS : 2 * BUCKETS], 0.1), used & (scripts > 0))

    def scores(self, words: Words) -> np.ndarray:
        """Words x languages: 0 for the likeliest, less for others; all 0 for words of a script no language has."""
        n = len(words.starts)
        out = np.empty((n, len(self.languages)), dtype=np.float32)
        for k in range(len(self.languages)):
            gram = np.zeros(len(words.gram) + 1)
            np.cumsum(self.grams[k][words.gram], out=gram[1:])
            out[:, k] = (gram[words.ends] - gram[words.starts]) / 2 + self.words[k][words.bucket]
        candidates = self.scripts.T[words.script]
        out[~candidates] = -np.inf
        none = ~candidates.any(1)
        out[none] = 0
        out -= out.max(1, keepdims=True)
        return np.maximum(out, FLOOR)


def best_paths(scores: np.ndarray, of_text: np.ndarray, switch: float) -> np.ndarray:
    """Language number of every word: Viterbi over all texts of a piece at once, one word further in each step."""
    n_words = np.diff(of_text)
    order = np.argsort(-n_words, kind="stable")
    begin, lengths = of_text[:-1][order], n_words[order]
    n, k = scores.shape
    path = np.zeros(n, dtype=np.int8 if k < 128 else np.int32)
    if not n or k < 2:
        return path
    back = np.empty((n, k), dtype=path.dtype)
    stay = np.arange(k, dtype=path.dtype)
    active = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), side="right")  # texts longer than t
    value = scores[begin[: active[0]]].astype(np.float64)
    final = np.zeros(len(order), dtype=np.int64)
    for t in range(1, int(lengths[0])):
        m = int(active[t])
        if m < len(value):
            final[m : len(value)] = value[m:].argmax(1)
            value = value[:m]
        best = value.argmax(1)
        change = value[np.arange(m), best] - switch
        moved = change[:, None] > value
        at = begin[:m] + t
        back[at] = np.where(moved, best[:, None], stay)
        value = np.where(moved, change[:, None], value) + scores[at]
    final[: len(value)] = value.argmax(1)
    state = final
    for t in range(int(lengths[0]) - 1, -1, -1):
        m = int(active[t])
        at = begin[:m] + t
        path[at] = state[:m]
        if t:
            state[:m] = back[at, state[:m]]
    return path


def learn_languages(articles: DataFrame) -> Model:
    """Counts over all articles with a language: `content`, `lang`. Rows with a null in either teach nothing.

    Each task sums its rows, sums are added by (language, block of buckets), and
    the model (languages x 2 x BUCKETS numbers, whatever the input) goes to the driver.
    """
    schema = pa.schema([("lang", pa.string()), ("block", pa.int32()), ("counts", pa.binary())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            names, numbers = np.unique(np.array(batch.column(1).to_pylist(), dtype=object).astype(str), return_inverse=True)
            for first, data, offsets in pieces(batch.column(0), SCORED_BYTES):
                words = Words(data, offsets)
                of_text = words.of_text
                upto = np.concatenate([[0], np.cumsum(words.inside)])
                grams = words.gram[words.inside]
                for k in np.unique(numbers[first : first + len(offsets) - 1]).tolist():
                    mine = numbers[first : first + len(offsets) - 1] == k
                    word = np.repeat(mine, np.diff(of_text))
                    gram = np.repeat(mine, np.diff(upto[offsets]))
                    into = counts.setdefault(str(names[k]), np.zeros(2 * BUCKETS + BLOCK, dtype=np.int64))
                    into[:BUCKETS] += np.bincount(words.bucket[word], minlength=BUCKETS)
                    into[BUCKETS : 2 * BUCKETS] += np.bincount(grams[gram], minlength=BUCKETS)
                    into[2 * BUCKETS : 2 * BUCKETS + SCRIPTS] += np.bincount(words.script[word], minlength=SCRIPTS)
        for lang, values in counts.items():
            blocks = values.astype("<i8").reshape(-1, BLOCK)
            yield pa.RecordBatch.from_pydict(
                {"lang": [lang] * len(blocks), "block": list(range(len(blocks))), "counts": [b.tobytes() for b in blocks]},
                schema=schema,
            )

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BLOCK, dtype=np.int64)
        for batch in batches:
            for counts in batch.column(2):
                total += np.frombuffer(counts.as_buffer(), dtype="<i8")
        yield pa.RecordBatch.from_pydict(
            {"lang": [key[0].as_py()], "block": [key[1].as_py()], "counts": [total.astype("<i8").tobytes()]}, schema=schema
        )

    known = articles.select(F.col("content").cast("string").alias("content"), F.col("lang").cast("string").alias("lang"))
    counted = known.na.drop().mapInArrow(count, "lang string, block int, counts binary")
    summed = counted.groupBy("lang", "block").applyInArrow(add, "lang string, block int, counts binary")
    counts: dict[str, np.ndarray] = {}
    for row in summed.collect():  # a few rows of fixed size; an iterator would start a job for each partition
        into = counts.setdefault(row["lang"], np.zeros(2 * BUCKETS + BLOCK, dtype=np.int64))
        into[row["block"] * BLOCK : (row["block"] + 1) * BLOCK] = np.frombuffer(row["counts"], dtype="<i8")
    return Model.of_counts(counts)


def article_languages(model: Model, data: np.ndarray, offsets: np.ndarray, switch: float = SWITCH):
    """Per text: language or None, its share of the words, spans (start and end in words, language)."""
    n = len(offsets) - 1
    edges = [0]
    while edges[-1] < n:  # scores need much memory for each byte
        last = int(np.searchsorted(offsets, offsets[edges[-1]] + SCORED_BYTES, side="right")) - 1
        edges.append(min(max(last, edges[-1] + 1), n))
    scores, of_text = [], [np.zeros(1, dtype=np.int64)]
    for a, b in zip(edges, edges[1:]):
        words = Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        scores.append(model.scores(words))
        of_text.append(words.of_text[1:] + of_text[-1][-1])
    scores, of_text = np.concatenate(scores), np.concatenate(of_text)
    path = best_paths(scores, of_text, switch)
    k = max(len(model.languages), 1)
    text_of = np.repeat(np.arange(n), np.diff(of_text))
    votes = np.bincount(text_of * k + path, minlength=n * k).reshape(n, k)
    best = votes.argmax(1)  # of equal ones the first by name
    n_words = np.diff(of_text)
    share = votes[np.arange(n), best] / np.maximum(n_words, 1)
    return best, share, n_words, path, of_text


def has_letter(text: bytes) -> bool:
    return any(c.isalpha() for c in text.decode())


SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))
LABELS = pa.schema([("id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("spans", SPAN)])


def label_batch(model: Model, batch: pa.RecordBatch, switch: float, spans: bool) -> Iterator[pa.RecordBatch]:
    """Labels of a batch of id and content."""
    names = [*model.languages, UNKNOWN]
    if not model.languages:
        n = batch.num_rows
        none = [pa.array([UNKNOWN] * n), pa.array([0.0] * n), pa.array([[] if spans else None] * n, type=SPAN)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *none], schema=LABELS)
        return
    for first, data, offsets in pieces(batch.column(1), LABELLED_BYTES):
        n = len(offsets) - 1
        best, share, n_words, path, of_text = article_languages(model, data, offsets, switch)
        ascii = np.concatenate([[0], np.cumsum((LOWER[data] >= 0x61) & (LOWER[data] <= 0x7A))])[offsets]
        known = np.diff(ascii) > 0
        for i in np.flatnonzero(~known & (n_words > 0)).tolist():
            known[i] = has_letter(data[offsets[i] : offsets[i + 1]].tobytes())
        labels = np.where(known, best, len(names) - 1)
        found = []
        for i in range(n if spans else 0):
            part = path[of_text[i] : of_text[i + 1]] if known[i] else path[:0]
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)] if len(part) else [0]
            found.append([{"start": a, "end": b, "lang": names[part[a]]} for a, b in zip(cuts, cuts[1:])])
        columns = [
            batch.column(0).slice(first, n),
            pa.array([names[i] for i in labels.tolist()]),
            pa.array(np.where(known, share, 0.0)),
            pa.array(found if spans else [None] * n, type=SPAN),
        ]
        yield pa.RecordBatch.from_arrays(columns, schema=LABELS)


def label_articles(articles: DataFrame, model: Model, *, switch: float = SWITCH, spans: bool = False) -> DataFrame:
    """Language of every article.

    articles: `id` (integer), `content`; other columns are not read. Returns per
    row id, lang_pred, score (share of the words on that language's spans, 0 to
    1) and, with `spans`, spans (start, end in words of letters, lang). Null
    content, content without a letter, and everything under a model that learned
    nothing is `und` with score 0. The language is the one with the most words on the path, of equal ones the first by name.
    Repeated rows stay; an empty table gives an empty result. Row by row: nothing
    is shuffled, memory is bounded by the longest article.
    """
    shared = share(articles.sparkSession.sparkContext, model)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = opened(shared)
        for batch in batches:
            yield from label_batch(model, batch, switch, spans)

    rows = articles.select(F.col("id").cast("long").alias("id"), F.col("content").cast("string").alias("content"))
    out = rows.mapInArrow(label, "id long, lang_pred string, score double, spans array<struct<start: long, end: long, lang: string>>")
    return out if spans else out.drop("spans")


def known_articles(rows: DataFrame, content: str, model: Model) -> DataFrame:
    """The rows whose content has a language; `und` goes. Keeps the given columns; nothing is shuffled."""
    shared = share(rows.sparkSession.sparkContext, model)
    place = rows.columns.index(content)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = opened(shared)
        for batch in batches:
            texts = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), batch.column(place)], names=["id", "content"])
            labels = [x for part in label_batch(model, texts, SWITCH, False) for x in part.column(1).to_pylist()]
            yield batch.filter(pa.array([x != UNKNOWN for x in labels], type=pa.bool_()))

    return rows.mapInArrow(keep, rows.schema)
