"""Quality rules for articles: suffix-array repetition and line and word counts.

The words of many articles form one sequence, cut so that no match crosses an
article. A suffix array by prefix doubling, with the longest common prefix of
neighbours from the same rounds, gives the repeated substrings: a word at which
an LCP interval of depth d starts begins a substring of d words that stands
elsewhere in the article too. Maximal ones are united into covered spans.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rankmill.llm.words import SPACE_WORDS, bounds, code_points, hashes, mix, pieces

#: fixed values of the contract
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
REPEAT_WINDOW, MAX_REPEAT_PERCENT = 3, 50
#: the method's limits: words of a repeat that counts, covered percent, longest repeat
MIN_REPEAT, MAX_COVERED_PERCENT, MAX_LONGEST = 10, 40, 100

OUT_LONGS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat"]
OUT = (
    "id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "covered_words long, longest_repeat long, base_failed boolean, kept boolean"
)


def longest_repeats(words: np.ndarray, text_of: np.ndarray) -> np.ndarray:
    """For every word, the most words from it on that stand at another place of its text too.

    words: one number (a hash) per word; text_of: the text of each word, ascending. The
    rounds of prefix doubling go on while two suffixes share a rank; a suffix's
    best match is one of its two neighbours in the suffix array, and the length
    of a match is put together from the rounds' ranks, longest first.
    """
    n = len(words)
    if n < 2:
        return np.zeros(n, dtype=np.int64)
    # ranks of single words within their text; a rank never recurs in another text
    pair = mix(words.astype(np.uint64) + text_of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, rank = np.unique(pair, return_inverse=True)
    ranks, step = [rank.astype(np.int32)], 1
    end_of = np.searchsorted(text_of, text_of, side="right")
    while True:
        rank = ranks[-1]
        count = np.bincount(rank)
        alive = np.flatnonzero(count[rank] > 1)  # suffixes whose rank isn't theirs alone
        if not len(alive):
            break
        # within one rank, order by the rank of the words after; the text's end comes first
        after = alive + step
        inside = after < end_of[alive]
        second = np.zeros(len(alive), dtype=np.int64)
        second[inside] = rank[after[inside]].astype(np.int64) + 1
        key = rank[alive].astype(np.int64) * (n + 1) + second
        by = np.argsort(key, kind="stable")
        key = key[by]
        new = np.ones(len(by), dtype=bool)
        new[1:] = key[1:] != key[:-1]
        # ranks of the others stay apart: a rank is the number of suffixes before it
        before = np.concatenate([[0], np.cumsum(count)])[:-1]
        fresh = before[rank].astype(np.int32)
        group = rank[alive][by]
        place = np.arange(len(by))
        first_of_group = np.ones(len(by), dtype=bool)
        first_of_group[1:] = group[1:] != group[:-1]
        base = np.maximum.accumulate(np.where(first_of_group, place, 0))
        head = np.maximum.accumulate(np.where(new, place, 0))
        fresh[alive[by]] = (before[group] + head - base).astype(np.int32)
        ranks.append(fresh)
        step *= 2
        if step >= n:
            break
    order = np.argsort(ranks[-1], kind="stable")
    a, b = order[:-1], order[1:]
    same = text_of[a] == text_of[b]
    lcp = np.zeros(n - 1, dtype=np.int64)
    a, b, at = a[same], b[same], np.flatnonzero(same)
    length = np.zeros(len(a), dtype=np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        x, y = a + length, b + length
        ok = (x < end_of[a]) & (y < end_of[b])
        eq = np.zeros(len(a), dtype=bool)
        eq[ok] = ranks[k][x[ok]] == ranks[k][y[ok]]
        # equal ranks of a round mean equal words only where both suffixes are that long
        eq &= (x + (1 << k) <= end_of[a]) & (y + (1 << k) <= end_of[b])
        length[eq] += 1 << k
    lcp[at] = length
    best = np.zeros(n, dtype=np.int64)
    best[order[:-1]] = lcp
    best[order[1:]] = np.maximum(best[order[1:]], lcp)
    return best


def covered(best: np.ndarray, least: int) -> np.ndarray:
    """True for words inside a repeat of `least` words or more: the union of the repeats' spans."""
    change = np.zeros(len(best) + 1, dtype=np.int64)
    starts = np.flatnonzero(best >= least)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + best[starts], -1)
    return np.cumsum(change[:-1]) > 0


def _repeated_lines(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Number of lines of each text that hold a word and equal an earlier line of it."""
    n_texts = len(offsets) - 1
    if not len(starts):
        return np.zeros(n_texts, dtype=np.int64)
    breaks = np.flatnonzero(data == 0x0A)
    begins = np.union1d(breaks + 1, offsets[:-1])
    begins = begins[begins < len(data)]
    ends = np.append(begins[1:], len(data))
    # a line ends before its line break; the last line of a text has none
    ends = ends - (data[ends - 1] == 0x0A)
    full = np.searchsorted(starts, ends) > np.searchsorted(starts, begins)
    begins, ends = begins[full], ends[full]
    text_of = np.searchsorted(offsets, begins, side="right") - 1
    keys = hashes(data, begins, ends)
    order = np.lexsort((begins, keys, text_of))
    again = (keys[order][1:] == keys[order][:-1]) & (text_of[order][1:] == text_of[order][:-1])
    return np.bincount(text_of[order][1:][again], minlength=n_texts)


def judge(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """All figures of the texts of one piece."""
    n_texts = len(offsets) - 1
    starts, ends, of_text = bounds(data, offsets, SPACE_WORDS)
    n_words = np.diff(of_text)
    text_of = np.repeat(np.arange(n_texts), n_words)
    best = longest_repeats(hashes(data, starts, ends), text_of)

    def per_text(values: np.ndarray) -> np.ndarray:
        upto = np.concatenate([[0], np.cumsum(values)])
        return upto[of_text[1:]] - upto[of_text[:-1]]

    symbol = np.zeros(256, dtype=bool)
    symbol[list(SYMBOLS)] = True
    symbols = np.concatenate([[0], np.cumsum(symbol[data])])[offsets]
    points = code_points(data)
    longest = np.zeros(n_texts, dtype=np.int64)
    np.maximum.at(longest, text_of, best)
    repeat_words = per_text(covered(best, REPEAT_WINDOW))
    covered_words = per_text(covered(best, MIN_REPEAT))
    failed = (n_words < MIN_WORDS) | (100 * repeat_words > MAX_REPEAT_PERCENT * n_words)
    kept = ~failed & (100 * covered_words <= MAX_COVERED_PERCENT * n_words) & (longest <= MAX_LONGEST)
    return {
        "n_words": n_words,
        "word_chars": per_text(points[ends] - points[starts]),
        "n_symbols": np.diff(symbols),
        "n_dup_lines": _repeated_lines(data, offsets, starts),
        "n_repeat_words": repeat_words,
        "covered_words": covered_words,
        "longest_repeat": longest,
        "base_failed": failed,
        "kept": kept,
    }


def quality_rules(articles: DataFrame) -> DataFrame:
    """Figures and verdict of every article.

    articles: `id` (integer), `content`; other columns are not read. Returns id,
    n_words, word_chars (code points in words), n_symbols, n_dup_lines,
    n_repeat_words (words in repeated windows of three), covered_words (words in
    repeats of MIN_REPEAT words or more), longest_repeat, base_failed, kept. Kept
    are articles that don't fail the base rules, have at most MAX_COVERED_PERCENT
    of their words covered and no repeat over MAX_LONGEST words. Null and empty
    content has no words and fails. One row per row; repeats may overlap. Every
    article is judged by itself, so nothing is shuffled and memory is bounded by
    the longest one.
    """
    schema = pa.schema([("id", pa.int64()), *[(c, pa.int64()) for c in OUT_LONGS], ("base_failed", pa.bool_()), ("kept", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for first, data, offsets in pieces(batch.column(1)):
                found = judge(data, offsets)
                columns = [ids.slice(first, len(offsets) - 1), *[pa.array(found[c.name], type=c.type) for c in list(schema)[1:]]]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return articles.selectExpr("CAST(id AS long) AS id", "content").mapInArrow(run, OUT)
