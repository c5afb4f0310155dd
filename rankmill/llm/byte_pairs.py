"""Byte-pair encoding of articles with contiguous rank arrays, and decoding.

A word is a row of parts, at first one part for each byte, the last one marked as the word's end. Beside
every part stands the rank of the merge with the part after it. The least rank of the word is looked for,
the leftmost of equal ones; the boundary between its two parts is deleted, and the ranks of the new part and of
the part before it are refreshed; this goes on until no rank is left. The words of a batch stand one after the other in one
array, so a step is taken for all of them by whole-array arithmetic. Words longer than SHORT bytes
keep their ranks in a heap instead, as scanning them again and again would take the square of their length.

Texts repeat their words: each distinct one is merged once per batch and kept while there is room.
"""

from __future__ import annotations

import heapq
import json
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankmill.llm.words import pieces

SHORT = 128
NO_RANK = np.int32(2**31 - 1)


def byte_letters() -> list[str]:
    """The letter a byte-level vocabulary writes for each byte: visible Latin-1 letters stand for themselves."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in visible else chr(next(hidden)) for b in range(256)]


class Merges:
    """Vocabulary and merges of a tokenizer file of the library's format: a BPE over bytes with an end-of-word mark."""

    def __init__(self, tokenizer_file: str):
        with open(tokenizer_file, encoding="utf-8") as file:
            given = json.load(file)
        model = given["model"]
        if model["type"] != "BPE" or model.get("continuing_subword_prefix"):
            raise ValueError("not a plain byte-pair vocabulary")
        self.end = model.get("end_of_word_suffix") or ""
        self.ids: dict[str, int] = model["vocab"]
        self.special = {x["content"]: x["id"] for x in given["added_tokens"]}
        letters = byte_letters()
        self.inner = np.array([self.ids[x] for x in letters], dtype=np.int32)
        self.last = np.array([self.ids[x + self.end] for x in letters], dtype=np.int32)
        merges = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        left = np.array([self.ids[a] for a, _ in merges], dtype=np.int64)
        right = np.array([self.ids[b] for _, b in merges], dtype=np.int64)
        self.merged = np.array([self.ids[a + b] for a, b in merges], dtype=np.int32)
        order = np.argsort(left << 32 | right)
        self.pairs = (left << 32 | right)[order]
        self.rank_of_pair = order.astype(np.int32)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of merging each pair of parts, NO_RANK where it isn't merged."""
        wanted = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = np.minimum(np.searchsorted(self.pairs, wanted), len(self.pairs) - 1)
        return np.where(self.pairs[at] == wanted, self.rank_of_pair[at], NO_RANK)

    def parts(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Parts of all words at the start, and the offsets of the words in them."""
        at = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        parts = self.inner[data]
        parts[at[1:] - 1] = self.last[data[at[1:] - 1]]
        return parts, at

    def encode(self, words: list[bytes]) -> list[np.ndarray]:
        """Token ids of each word (none is empty)."""
        short = [i for i, w in enumerate(words) if len(w) <= SHORT]
        out: list[np.ndarray] = [self._heaped(w) if len(w) > SHORT else None for w in words]
        for a in range(0, len(short), 20_000):
            some = short[a : a + 20_000]
            ids, at = self._scanned([words[i] for i in some])
            for i, x, y in zip(some, at, at[1:]):
                out[i] = ids[x:y]
        return out

    def _scanned(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Rank arrays of short words, one merge of every unfinished word at a time."""
        parts, at = self.parts(words)
        counts = np.diff(at)
        done_parts, done_words = [], []
        names = np.arange(len(words))
        ranks = np.full(len(parts), NO_RANK)
        ranks[:-1] = self.ranks(parts[:-1], parts[1:])
        ranks[at[1:] - 1] = NO_RANK  # no pair crosses from word to word
        while len(names):
            start = np.concatenate([[0], np.cumsum(counts)[:-1]])
            least = np.minimum.reduceat(ranks, start)
            over = least == NO_RANK
            if over.any():
                gone = np.repeat(over, counts)
                done_parts.append(parts[gone])
                done_words.append((names[over], counts[over]))
                parts, ranks = parts[~gone], ranks[~gone]
                names, counts, least = names[~over], counts[~over], least[~over]
                if not len(names):
                    break
                start = np.concatenate([[0], np.cumsum(counts)[:-1]])
            hits = np.flatnonzero(ranks == np.repeat(least, counts))
            here = hits[np.searchsorted(hits, start)]  # the leftmost of each word
            parts[here] = self.merged[least]
            keep = np.ones(len(parts), dtype=bool)
            keep[here + 1] = False
            parts, ranks = parts[keep], ranks[keep]
            counts = counts - 1
            here = here - np.arange(len(here))  # one boundary went in each word before
            ends = np.cumsum(counts)
            inner = here < ends - 1
            ranks[here] = NO_RANK
            ranks[here[inner]] = self.ranks(parts[here[inner]], parts[here[inner] + 1])
            before = here[here > ends - counts] - 1
            ranks[before] = self.ranks(parts[before], parts[before + 1])
        order = np.concatenate([x for x, _ in done_words])
        sizes = np.concatenate([x for _, x in done_words])
        start = np.concatenate([[0], np.cumsum(sizes)])
        back = np.argsort(order)
        size, first = sizes[back], start[back]
        upto = np.concatenate([[0], np.cumsum(size)])
        flat = np.concatenate(done_parts)
        return flat[np.repeat(first - upto[:-1], size) + np.arange(upto[-1])], upto

    def _heaped(self, word: bytes) -> np.ndarray:
        """A long word: ranks wait in a heap, boundaries are a linked list."""
        parts = self.parts([word])[0].tolist()
        n = len(parts)
        following, before = [*range(1, n), -1], [*range(-1, n - 1)]
        found = self.ranks(np.array(parts[:-1]), np.array(parts[1:])).tolist()
        heap = [(rank, i, parts[i], parts[i + 1]) for i, rank in enumerate(found) if rank != NO_RANK]
        heapq.heapify(heap)
        rank_of = dict(zip(self.pairs.tolist(), self.rank_of_pair.tolist()))
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = following[i]
            if j < 0 or parts[i] != left or parts[j] != right:
                continue  # one of the two has been merged since
            parts[i], parts[j] = int(self.merged[rank]), -1
            following[i] = following[j]
            if following[j] >= 0:
                before[following[j]] = i
            for a, b in ((before[i], i), (i, following[i])):
                if a >= 0 and b >= 0 and (new := rank_of.get(parts[a] << 32 | parts[b])) is not None:
                    heapq.heappush(heap, (new, a, parts[a], parts[b]))
        return np.array([x for x in parts if x >= 0], dtype=np.int32)


#: fixed value: what the vocabulary's pre-tokenizer takes as words
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def later_letters(tokenizer_file: str) -> tuple[dict[int, str], dict[int, str]]:
    """Letters and numbers that Python's Unicode tables don't know yet, judged by the library's own tables.

    Two translations: to their small letters, and of those that are signs for its pre-tokenizer to a sign.
    """
    import unicodedata

    import regex
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_file)
    letters = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    found = [x for x in regex.findall(r"[\p{L}\p{N}]", letters) if unicodedata.category(x) == "Cn"]
    small = {ord(x): library.normalizer.normalize_str(x) for x in found}
    return small, {ord(x): "!" for x in found if len(library.pre_tokenizer.pre_tokenize_str("!" + x)) == 1}


def any_of(letters: list[int]) -> str:
    """Pattern of one of these code points, in ranges."""
    points = np.array(sorted(letters), dtype=np.int64)
    groups = np.split(points, np.flatnonzero(np.diff(points) > 1) + 1)
    return "[" + "".join(f"\\U{g[0]:08x}-\\U{g[-1]:08x}" for g in groups) + "]" if letters else "(?!)"


class Encoder:
    """Texts -> ids: composed (NFC), lower-cased letter by letter, cut into words, each word merged.

    The special tokens' strings in a text are their ids. Forgets its words when it holds `most` of them.
    """

    def __init__(self, tokenizer_file: str, most: int = 300_000):
        import re
        import unicodedata

        import regex

        self.merges = Merges(tokenizer_file)
        self.normal = unicodedata.normalize
        self.words = regex.compile(WORDS).finditer
        self.all_words = regex.compile(WORDS).findall
        self.small, self.as_signs = later_letters(tokenizer_file)
        self.has_later = re.compile(any_of([*self.small])).search
        self.plain = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+").findall  # of ASCII alone
        self.parted = regex.compile("(" + "|".join(map(regex.escape, self.merges.special)) + ")").split
        self.most = most
        self._forget()

    def _forget(self) -> None:
        self.known = {text: i for i, text in enumerate(self.merges.special)}
        self.ids = np.array([*self.merges.special.values()], dtype=np.int32)
        self.at = np.arange(len(self.ids) + 1, dtype=np.int64)

    def cut(self, text: str) -> list[str]:
        """Words of a text, special tokens among them."""
        if text.isascii() and "<|" not in text:
            return self.plain(text.lower())
        out: list[str] = []
        for k, part in enumerate(self.parted(text)):
            if k % 2:
                out.append(part)
            else:  # capital sigma has one small letter here wherever it stands
                part = self.normal("NFC", part).replace("Σ", "σ").lower()
                if self.has_later(part):
                    part = part.translate(self.small)
                    out += [part[m.start() : m.end()] for m in self.words(part.translate(self.as_signs))]
                else:
                    out += self.all_words(part)
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the offsets of the texts in them."""
        found: list[str] = []
        upto = [0]
        for text in texts:
            found += self.cut(text)
            upto.append(len(found))
        if len(self.known) > self.most:
            self._forget()
        new = list(set(found).difference(self.known))
        if new:
            ids = self.merges.encode([w.encode() for w in new])
            base = len(self.known)
            self.known.update(zip(new, range(base, base + len(new))))
            self.ids = np.concatenate([self.ids, *ids])
            self.at = np.concatenate([self.at, self.at[-1] + np.cumsum([len(x) for x in ids])])
        index = np.fromiter(map(self.known.__getitem__, found), dtype=np.int64, count=len(found))
        counts = self.at[index + 1] - self.at[index]
        sums = np.concatenate([[0], np.cumsum(counts)])
        return self.ids[np.repeat(self.at[index] - sums[:-1], counts) + np.arange(sums[-1])], sums[upto]


def of_worker(kind: type, tokenizer_file: str):
    """One object for a Python worker: reading the vocabulary and merging common words is done once, not in every task."""
    kept = sys.modules.setdefault("_rankmill_worker", types.ModuleType("_rankmill_worker")).__dict__
    key = (kind.__name__, tokenizer_file)
    if key not in kept:
        kept[key] = kind(tokenizer_file)
    return kept[key]


IDS = "id long, ids array<int>"


def encode_articles(articles: DataFrame, tokenizer_file: str) -> DataFrame:
    """id, ids: the token ids of the whole content of every article, one row for each row.

    articles: `id` (integer), `content`; other columns are not read. Null and empty content, or content of
    white space alone, has no ids (an empty array). Ids may be null or repeated; an empty table gives an empty result.
    `tokenizer_file` must be readable on the executors; no special tokens are added, but those written
    in a text are encoded as such.
    """
    schema = pa.schema([("id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = of_worker(Encoder, tokenizer_file)
        for batch in batches:
            for first, data, offsets in pieces(batch.column(1)):
                raw, cuts = data.tobytes(), offsets.tolist()
                ids, at = encoder.encode([raw[a:b].decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:])])
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(at) - 1), lists], schema=schema)

    rows = articles.select(F.col("id").cast("long").alias("id"), F.col("content").cast("string").alias("content"))
    return rows.mapInArrow(run, IDS)


class Decoder:
    """Token ids -> the texts of the tokens, special ones included, with a space between them; unknown ids are left out."""

    def __init__(self, tokenizer_file: str):
        merges = Merges(tokenizer_file)
        texts = {**{id: text for text, id in merges.ids.items()}, **{id: text for text, id in merges.special.items()}}
        self.texts = [texts.get(i, "").encode() for i in range(max(texts) + 1)]
        self.known = np.array([i in texts for i in range(len(self.texts))])

    def decode(self, ids: np.ndarray) -> bytes:
        inside = (ids >= 0) & (ids < len(self.texts))
        ids = ids[inside]
        ids = ids[self.known[ids]]
        return b" ".join(map(self.texts.__getitem__, ids.tolist()))


def decode_articles(tokens: DataFrame, tokenizer_file: str) -> DataFrame:
    """id, ids, decoded: the text that each row's ids stand for (the vocabulary has no decoder, so tokens keep their marks).

    tokens: `id`, `ids` as encode_articles gives them. Null ids and no ids decode to the empty text, unknown and null
    numbers in them are left out.
    """
    schema = pa.schema([("id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = of_worker(Decoder, tokenizer_file)
        for batch in batches:
            lists = batch.column(1)
            flat, at = lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False), np.zeros(len(lists) + 1, dtype=np.int64)
            at[1:] = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            step = 256  # rows of a piece: texts are longer than ids
            for a in range(0, len(lists), step):
                b = min(a + step, len(lists))
                decoded = [decoder.decode(flat[at[i] : at[i + 1]]) for i in range(a, b)]
                columns = [batch.column(0).slice(a, b - a), lists.slice(a, b - a), pa.array(decoded, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return tokens.select("id", "ids").mapInArrow(run, f"{IDS}, decoded string")
