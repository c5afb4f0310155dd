import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rankmill.llm.byte_pair_queries import op12_byte_pairs, word_tokenizer_file
from rankmill.llm.byte_pairs import SHORT, Decoder, Encoder, Merges, decode_articles, encode_articles

FILE = word_tokenizer_file()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


@pytest.fixture(scope="module")
def encoder():
    return Encoder(FILE)


def same(encoder, library, texts):
    ids, at = encoder.encode(texts)
    decoder = Decoder(FILE)
    for text, a, b, want in zip(texts, at, at[1:], library.encode_batch(texts, add_special_tokens=False)):
        assert ids[a:b].tolist() == want.ids, repr(text)
        assert decoder.decode(ids[a:b]).decode() == library.decode(want.ids, skip_special_tokens=False)


PARTS = ["a", "b", "ab", "'s", "'", "S", "<|endoftext|>", "<|startoftext|>", " ", "\n", "é", "é", "Σ", "İ", "1", "23", "!", "...", "<", "|"]
PARTS += [">", "\xa0", "\x1c", "　", "日本", "\U0001f600", "ing", "the", "\x00", "’"]


def test_texts_of_odd_parts(encoder, library):
    rng = random.Random(3)
    same(encoder, library, ["", " ", "\n\t", *("".join(rng.choice(PARTS) for _ in range(rng.randrange(30))) for _ in range(2000))])


def test_every_code_point(encoder, library):
    points = [chr(c) for c in [*range(0xD800), *range(0xE000, 0x110000, 1)]]
    texts = [f"a{x}b {x}{x}" for x in points]
    ids, at = encoder.encode(texts)
    wrong = [hex(ord(x)) for x, a, b, want in zip(points, at, at[1:], library.encode_batch(texts, add_special_tokens=False)) if ids[a:b].tolist() != want.ids]
    assert not wrong


def test_long_words_with_the_heap(encoder, library):
    rng = random.Random(4)
    words = ["".join(rng.choice("abct") for _ in range(n)) for n in (SHORT - 1, SHORT, SHORT + 1, 1000, 30_000)]
    same(encoder, library, [*words, "a" * 5000, "the" * 700, "!?" * 900])


def plain(merges, word):
    """The method on one word, written plainly."""
    parts = merges.parts([word])[0].tolist()
    while len(parts) > 1:
        ranks = merges.ranks(np.array(parts[:-1]), np.array(parts[1:])).tolist()
        if min(ranks) == 2**31 - 1:
            break
        i = ranks.index(min(ranks))
        parts[i : i + 2] = [int(merges.merged[ranks[i]])]
    return parts


def test_scanned_and_heaped_words_match_a_plain_version():
    merges, rng = Merges(FILE), random.Random(5)
    words = ["".join(rng.choice("abcdething") for _ in range(rng.randrange(1, 40))).encode() for _ in range(300)]
    for word, ids in zip(words, merges.encode(words)):
        assert ids.tolist() == plain(merges, word) == merges._heaped(word).tolist()


def test_the_kept_words_are_bounded(library):
    encoder = Encoder(FILE, most=50)
    rng = random.Random(6)
    for _ in range(5):
        same(encoder, library, ["".join(rng.choice("abc ") for _ in range(200)) for _ in range(20)])


def test_articles_with_nulls_repeated_rows_and_clashing_columns(spark, library):
    rows = [(1, "Über the\nword", "x"), (1, "Über the\nword", "x"), (2, None, None), (None, " ", "x"), (3, "it's <|endoftext|>", "y")]
    frame = spark.createDataFrame(rows, "id int, content string, ids string").withColumn("decoded", F.lit(1))
    got = decode_articles(encode_articles(frame, FILE), FILE).collect()
    want = [(i, library.encode(text or "", add_special_tokens=False).ids) for i, text, _ in rows]
    assert sorted((r["id"] or 0, r["ids"]) for r in got) == sorted((i or 0, ids) for i, ids in want)
    assert all(r["decoded"] == library.decode(r["ids"], skip_special_tokens=False) for r in got)
    empty = spark.createDataFrame([], "id long, content string")
    assert decode_articles(encode_articles(empty, FILE), FILE).count() == 0
    odd = spark.createDataFrame([(1, None), (2, [0, None, 99_999_999, -5, 1])], "id long, ids array<int>")
    assert [r["decoded"] for r in decode_articles(odd, FILE).orderBy("id").collect()] == ["", '! "']


def test_one_very_long_text(spark, library):
    text = " ".join(f"Word{i % 7919}é{i}" for i in range(150_000))
    got = encode_articles(spark.createDataFrame([(1, text)], "id long, content string"), FILE).first()
    assert got["ids"] == library.encode(text, add_special_tokens=False).ids


def test_query_gives_the_digests_of_the_library(spark, small, library):
    from hashlib import sha256

    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = op12_byte_pairs(spark, small).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = library.encode(docs[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
