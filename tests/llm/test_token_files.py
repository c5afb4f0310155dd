import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from rankmill.llm.token_files import (
    Encoder,
    FileReader,
    FileWriter,
    fetch_articles,
    read_token_files,
    token_index,
    write_token_files,
)
from rankmill.llm.token_queries import tokenizer_file
from rankmill.llm.words import pieces


def library(texts):
    """What the library gives by itself, with nothing set."""
    tokenizer = Tokenizer.from_file(tokenizer_file())
    return [x.ids for x in tokenizer.encode_batch(texts, add_special_tokens=False)]


def written(articles):
    parts = []
    writer = FileWriter(parts.append)
    for id, ids in articles:
        writer.add(id, ids.tobytes())
    writer.close()
    return b"".join(parts)


def reader_of(data, seen=None):
    def read(start, n):
        if seen is not None:
            seen.append(n)
        return data[start : start + n]

    return FileReader(read, len(data))


@pytest.fixture(scope="module")
def encoder():
    return Encoder(tokenizer_file(), most=200)


def test_pieces_give_the_ids_of_whole_texts(encoder):
    rng = random.Random(3)
    texts = ["", " ", "I'll  've <|endoftext|> b", "a \n b", "a\n \nb", "é ü　x  y", "x,y. z\n", "a,\n\nb 1.5,2"]
    texts += ["".join(rng.choice(" \n\tabB.,'1é\x1c\x85\r") for _ in range(rng.randrange(14))) for _ in range(4000)]
    texts.append("word " * 40_000)
    for size in (1, 300, 1 << 20):
        some = texts if size > 1 else texts[:60]
        got = []
        for _, data, offsets in pieces(pa.array([t.encode() for t in some], type=pa.binary()), size):
            ids, at = encoder.encode(data, offsets)
            got += [ids[a:b].tolist() for a, b in zip(at, at[1:])]
        assert got == library(some)


def test_special_tokens_are_those_of_the_library(encoder):
    rng = random.Random(8)
    texts = ["".join(rng.choice(["<|endoftext|>", "<|endof", "text|>", " ", "a", "é b", "\n", "|>"]) for _ in range(rng.randrange(12))) for _ in range(500)]
    for _, data, offsets in pieces(pa.array([t.encode() for t in texts], type=pa.binary())):
        ids, at = encoder.encode(data, offsets)
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == library(texts)


def test_file_round_trip_and_checksum():
    rng = np.random.default_rng(1)
    articles = [(5, 3), (5, 0), (None, 70_000), (9, 2), (-1, 66_000), (2**40, 1)]
    articles = [(id, rng.integers(0, 50_000, n, dtype=np.uint32)) for id, n in articles]
    data = written(articles)
    reader = reader_of(data)
    assert [(id, ids.tolist()) for _, id, ids in reader.articles()] == [(id, ids.tolist()) for id, ids in articles]
    assert [(row, len(ids)) for row, _, ids in reader.articles([3])] == [(3, 2)]
    broken = bytearray(data)
    broken[int(reader.starts[1]) + 40] ^= 1
    broken = reader_of(bytes(broken))
    assert len(list(broken.articles([0]))) == 1  # the damage is in another frame
    with pytest.raises(Exception, match="checksum|decompress|corrupt"):
        list(broken.articles([2]))


def test_one_article_takes_its_frame_and_the_end_of_the_file():
    rng = np.random.default_rng(2)
    data = written([(k, rng.integers(0, 50_000, 3000, dtype=np.uint32)) for k in range(500)])
    seen = []
    reader = reader_of(data, seen)
    assert [id for _, id, _ in reader.articles([321])] == [321]
    frame = reader.seek[int(reader.index[321][3])][0]
    assert len(seen) == 4 and seen[0] == 9 and seen[3] == frame
    assert sum(seen) < len(data) / 10


def test_articles(spark):
    rows = [(3, "c d", 1), (1, "a b", 2), (1, "a b", 2), (2, None, 3), (None, "x", None), (7, "", 1), (8, "<|endoftext|>", 1)]
    articles = spark.createDataFrame(rows, "id int, content string, n_tokens int")
    files = write_token_files(articles, tokenizer_file(), range_bytes=4, file_bytes=1)
    assert files.count() > 1
    got = sorted((r["start"], r["id"], r["n_tokens"], r["ids_crc32"]) for r in token_index(files).collect())
    want, start = [], 0
    for id, text in [(None, "x"), (1, "a b"), (1, "a b"), (2, ""), (3, "c d"), (7, ""), (8, "<|endoftext|>")]:
        ids = [*library([text])[0], 2]
        want.append((start, id, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    assert got == want
    one = read_token_files(files).where("id = 3").first()
    assert fetch_articles(files, one["file"], [one["row"]]) == [(3, [*library(["c d"])[0], 2])]
    assert token_index(write_token_files(articles.limit(0), tokenizer_file())).count() == 0


def test_files_are_cut_by_bytes(spark):
    rng = random.Random(4)
    rows = [(k, " ".join(f"w{rng.randrange(10**6)}" for _ in range(2000 if k % 50 else 60_000))) for k in range(200)]
    articles = spark.createDataFrame(rows, "id long, content string").repartition(4)
    files = write_token_files(articles, tokenizer_file(), range_bytes=2 << 20, file_bytes=300_000)
    sizes = [r["size"] for r in files.collect()]
    assert len(sizes) > 8 and max(sizes) < 300_000 + 500_000  # a frame may go over, and the longest article is one
    assert [r["id"] for r in token_index(files).orderBy("start").collect()] == list(range(200))
