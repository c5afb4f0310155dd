"""Spelling variants among the words of articles: a dictionary of pairs of trie nodes.

All words stand in a trie and, read backwards, in a second one. Every node has a number: one of up to PACKED
letters the number that its letters make in base 256, a deeper one its place in a written table of nodes. A word skipped at a letter is a pair of
numbers (node of the letters before, node of the letters after), and so is a word parted without skipping. Two words are near

* by a replaced letter, when they have a skipped pair in common;
* by an inserted or deleted one, when a skipped pair of the longer is a parted pair of the shorter.

Equal pairs meet by an equi-join on two integers. A pair stands for one row of letters with a gap, so
at most as many words as there are letters have it, and one more without the gap.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankmill.session import settle

#: fixed values: runs of Latin letters in UTF-8, and bytes that are in no run
RUN = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\xbf])+")
BREAK = re.compile(rb"[\x00-\x40\x5b-\x60\x7b-\x7f]")
LEAST_LETTERS, LEAST_COUNT, TIMES = 6, 5, 5
PACKED = 7  # letters of one byte that fit a positive 64-bit number
SPELLED = 48  # longer paths stand in the table of nodes by their digest, so a very long word takes little room
BLOCK_BYTES, MOST_WORDS = 1 << 20, 200_000


def blocks(text: bytes, most: int = BLOCK_BYTES) -> Iterator[bytes]:
    """A text in blocks of about `most` bytes, cut where no run is."""
    first = 0
    while first < len(text):
        found = BREAK.search(text, first + most)
        last = found.start() if found else len(text)
        yield text[first:last]
        first = last


def slipped(run: bytes, h: int) -> bytes:
    """The run without its letter number h modulo its length."""
    letters = run.decode()
    at = h % len(letters)
    return (letters[:at] + letters[at + 1 :]).encode()


def count_words(text: bytes, name: bytes, slips: int, counts: Counter) -> None:
    """Adds the words of a text that has no run over its borders. name: the article's id as text."""
    runs = RUN.findall(text.lower())  # of bytes: A-Z only
    counts.update(runs)
    if slips:
        start = zlib.crc32(name + b":")
        for run, h in zip(runs, map(zlib.crc32, runs, repeat(start))):
            if h % slips == 0:
                counts[run] -= 1
                counts[slipped(run, h)] += 1


def word_counts(articles: DataFrame, *, slips: int = 0, least_letters: int = LEAST_LETTERS) -> DataFrame:
    """word, n: how often each word of at least `least_letters` letters occurs in all articles.

    A word is a maximal run of A-Z, a-z and U+00C0 to U+00FF, A-Z in lower case. With slips > 0, writing slips are
    put in to measure with: a run whose crc32 (of `<id>:<run>`) is a multiple of `slips` loses one letter first.
    """
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def counted(counts: Counter) -> pa.RecordBatch:
        kept = [(w, n) for w, n in counts.items() if n > 0 and len(w) - w.count(b"\xc3") >= least_letters]
        words = pa.array([w for w, _ in kept], pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array([n for _, n in kept], pa.int64())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            for i in range(len(texts)):
                text, name = texts[i].as_py(), batch.column(0)[i].as_py()
                for block in blocks(text or b""):
                    count_words(block, name.encode(), slips, counts)
                    if len(counts) > MOST_WORDS:
                        yield counted(counts)
                        counts.clear()
        yield counted(counts)

    rows = articles.select(F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"), F.col("content").cast("string").alias("content"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _packed(letters: Column) -> Column:
    """The number that up to PACKED letters make in base 256, 0 for none."""
    return F.coalesce(F.conv(F.hex(F.encode(letters, "ISO-8859-1")), 16, 10).cast("long"), F.lit(0))


def _head(word: Column, i: Column) -> Column:
    return F.substring(word, F.lit(1), i)


def _tail(word: Column, i: Column) -> Column:
    """The last i letters."""
    return F.substring(word, F.length(word) - i + 1, i)


def with_nodes(words: DataFrame, part, name: str) -> DataFrame:
    """words with `name`: the numbers of the nodes that a word passes, the root first.

    part(word, i) is the path of i letters. Paths of up to PACKED letters are their own numbers; the distinct
    longer ones are written once as a table, where a row's number is below zero.
    """
    deep = words.where(F.length("word") > PACKED).select(
        "place", "word", F.explode(F.sequence(F.lit(PACKED + 1), F.length("word"))).alias("depth")
    )
    path = part(F.col("word"), F.col("depth"))
    deep = deep.select("place", "depth", F.when(F.col("depth") <= SPELLED, path).otherwise(F.sha2(path, 256)).alias("path"))
    nodes = settle(deep.select("path").distinct().select("path", (-1 - F.monotonically_increasing_id()).alias("node")))
    numbered = deep.join(nodes, "path").groupBy("place").agg(F.sort_array(F.collect_list(F.struct("depth", "node"))).alias("deep"))
    top = F.transform(
        F.sequence(F.lit(0), F.least(F.length("word"), F.lit(PACKED))), lambda i: _packed(part(F.col("word"), i))
    )
    below = F.coalesce(F.col("deep.node"), F.array().cast("array<bigint>"))
    return words.join(numbered, "place", "left").select(*words.columns, F.concat(top, below).alias(name))


def near_words(words: DataFrame) -> DataFrame:
    """place, n_near, best (the near word of largest n, as `less` = -n and `place`): words that have a near one.

    words: `place` (a distinct number, in the order of the words), `word` (distinct, letters below U+0100), `n`. Every near
    pair meets once: a word that is a letter longer meets the shorter one where that letter is the first of its
    run of equal letters.
    """
    noded = settle(with_nodes(with_nodes(words, _head, "heads"), _tail, "tails"))
    length = F.length("word")
    # skipping letter i (from 0): i letters before, length - i - 1 after
    skipped = F.transform(
        F.sequence(F.lit(0), length - 1),
        lambda i: F.struct(
            F.get("heads", i).alias("head"),
            F.get("tails", length - i - 1).alias("tail"),
            F.lit(True).alias("skipped"),
            ((i == 0) | (F.substring("word", i, F.lit(1)) != F.substring("word", i + 1, F.lit(1)))).alias("first"),
        ),
    )
    parted = F.transform(
        F.sequence(F.lit(0), length),
        lambda i: F.struct(
            F.get("heads", i).alias("head"), F.get("tails", length - i).alias("tail"), F.lit(False).alias("skipped"), F.lit(True).alias("first")
        ),
    )
    pairs = noded.select("place", "n", F.explode(F.concat(skipped, parted)).alias("pair")).select("place", "n", "pair.*")
    member = F.struct("place", "n", "skipped", "first")
    met = pairs.groupBy("head", "tail").agg(F.collect_list(member).alias("members")).where(F.size("members") > 1)
    each = met.select("members", F.explode("members").alias("m"))
    others = F.filter(
        "members",
        lambda x: F.when(x["skipped"] & F.col("m.skipped"), x["place"] != F.col("m.place")).otherwise(
            (x["skipped"] != F.col("m.skipped")) & x["first"] & F.col("m.first")
        ),
    )
    least = F.array_min(F.transform("others", lambda x: F.struct((-x["n"]).alias("less"), x["place"].alias("place"))))
    found = each.select("m.place", others.alias("others")).where(F.size("others") > 0)
    found = found.select("place", F.size("others").alias("k"), least.alias("best"))
    return found.groupBy("place").agg(F.sum("k").alias("n_near"), F.min("best").alias("best"))


def in_order(counts: DataFrame) -> DataFrame:
    """place, word, n: the rows with numbers that ascend with the words."""
    return settle(counts.orderBy("word").select(F.monotonically_increasing_id().alias("place"), "word", "n"))


def last_forms(links: DataFrame) -> DataFrame:
    """word, root: the word that following links (`word`, `form`) ends at. Chains halve in every round; links have no rings."""
    at = links.select("word", F.col("form").alias("root"), F.lit(True).alias("moved"))
    while True:
        at = settle(at)
        if at.where("moved").isEmpty():
            return at.drop("moved")
        following = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        at = at.join(following, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")
        )


def spelling_variants(
    articles: DataFrame,
    *,
    slips: int = 0,
    least_letters: int = LEAST_LETTERS,
    least_count: int = LEAST_COUNT,
    times: int = TIMES,
) -> DataFrame:
    """Words of the articles, and the more frequent word that each is likely a spelling of.

    articles: `id`, `content`; other columns are not read. Words and slips are those of word_counts; words of at least
    `least_letters` letters that occur `least_count` times count. Two are near if they differ by one
    inserted, deleted or replaced letter. Returns per word: word, form (its near word of largest n, of equal ones the least, if that
    n is at least `times` its own; else null), root (the last of its forms; the word itself without one), n, n_near (near words),
    form_n (n of the form). Null and empty content has no words; a null id counts as the empty text; repeated rows count
    again; an empty table gives an empty result.
    """
    if times < 2:
        raise ValueError("forms must be more frequent than their words, or they could form rings")
    counts = word_counts(articles, slips=slips, least_letters=least_letters)
    words = in_order(counts.where(F.col("n") >= least_count))
    near = words.join(near_words(words), "place", "left")
    names = words.select(F.col("place").alias("form_place"), F.col("word").alias("name"))
    near = near.withColumn("form_place", F.col("best.place")).join(names, "form_place", "left")
    is_form = -F.col("best.less") >= times * F.col("n")
    found = settle(
        near.select(
            "word",
            F.when(is_form, F.col("name")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(is_form, -F.col("best.less")).alias("form_n"),
        )
    )
    roots = last_forms(found.where("form IS NOT NULL"))
    return found.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
