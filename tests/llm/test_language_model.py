import random
import re
import zlib
from collections import Counter
from math import log10

import numpy as np
import pyarrow as pa
import pytest

from rankmill.llm import language_model as lm
from rankmill.llm.language_model_queries import op7_language_model
from rankmill.llm.words import pieces


def plain(rows):
    """base_score and counts by the definition: (id, text) -> values."""
    words = {}
    for k, (id, text) in enumerate(rows):
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words[k] = [*re.findall(r"[^\x20\x09-\x0D]+", text), None]
    training = [k for k, (id, _) in enumerate(rows) if zlib.crc32(("" if id is None else str(id)).encode()) % 7 != 2]
    c = Counter(w for k in training for w in words[k])
    n, v = sum(c.values()), len(c)
    return n, [(len(words[k]), sum(c[w] > 0 for w in words[k]), sum(log10((c[w] + 1) / (n + v + 1)) for w in words[k])) for k in words]


def test_whole_table_against_the_definition(spark, tmp_path):
    rng = random.Random(3)
    vocabulary = ["the", "The", "of", "é", "a,b", "x y", *(f"w{i}" for i in range(300))]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(40))).replace("w7", "\n")) for i in range(200)]
    rows += [(5, rows[5][1]), (5, rows[5][1]), (7, None), (None, "the unknownword"), (300, "")]
    frame = spark.createDataFrame([(*r, 1, "s") for r in rows], "doc_id long, text string, score int, source string")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    lm_top, lm.TOP_WORDS = lm.TOP_WORDS, 60  # so that counts are joined too
    try:
        got = op7_language_model(spark, str(tmp_path)).collect()
    finally:
        lm.TOP_WORDS = lm_top
    n, want = plain(rows)
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    want = sorted(((r[0], w[0], w[1], w[2]) for r, w in zip(rows, want)), key=key)
    got_rows = sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["base_score"]) for r in got), key=key)
    assert [x[:3] for x in got_rows] == [x[:3] for x in want]
    assert np.allclose([x[3] for x in got_rows], [x[3] for x in want])
    assert {r["train_tokens"] for r in got} == {n}
    assert all(r["score"] < 0 for r in got)
    assert {r["doc_id"] for r in got if r["held_out"]} == {r[0] for r in rows if zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 7 == 2}


def test_empty_tables(spark, tmp_path):
    frame = spark.createDataFrame([], "doc_id long, text string, source string")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    assert op7_language_model(spark, str(tmp_path)).count() == 0


def small_model(spark, rows):
    articles = spark.createDataFrame(rows, "content string, part int")
    return lm.learn(articles)


@pytest.fixture(scope="module")
def learned(spark):
    rng = random.Random(1)
    texts = []
    for i in range(400):
        a, b = rng.choice([("red", "blue"), ("one", "two")])
        texts.append((" ".join(f"{a} {b}" for _ in range(30)) + f" tail{rng.randrange(50)}", i))
    return small_model(spark, texts)


def test_probabilities_sum_to_one(learned):
    """Over all classes, and in a head class over its words, for real contexts."""
    model, _ = learned
    _, data, offsets = next(pieces(pa.array([b"red blue one"], type=pa.binary())))
    tokens = lm.Tokens.of(data, offsets)
    f = model.features(tokens, model.places(tokens.keys))
    logits = lm._class_logits(model, f, slice(0, 4))
    p, _ = lm._softmax(logits.copy())
    assert np.allclose(p.sum(1), 1, atol=1e-5)
    total = np.zeros(4)
    head = np.arange(lm.HEAD_WORDS)
    for k in range(4):
        many = lm.Features(
            head, head // lm.CLASS_WORDS, *[np.full(lm.HEAD_WORDS, x[k]) for x in (f.near, f.skip, f.both)]
        )
        total[k] = (10 ** lm.log_probabilities(model, many)).sum() + p[k, lm.CLASSES :].sum()
    assert np.allclose(total, 1, atol=1e-3)


def test_context_is_learned(spark, learned):
    model, counts = learned
    frame = spark.createDataFrame([(1, "red blue " * 10), (2, "red two " * 10)], "id long, content string")
    rows = {r["id"]: r for r in lm.score_articles(frame, model, counts).collect()}
    assert rows[1]["score"] > rows[2]["score"] + 5
    assert rows[1]["score"] > rows[1]["base_score"]


def test_gradient_is_that_of_the_log_likelihood():
    """A step from zero weights moves a row by the sum of targets less probabilities."""
    table, seen = np.zeros((3, 2), dtype=np.float32), np.zeros(3, dtype=np.float32)
    lm._step(table, seen, np.array([2, 0, 2]), np.array([[0.5, -0.5], [0.25, -0.25], [0.5, -0.5]], dtype=np.float32))
    assert seen.tolist() == [1, 0, 2]
    assert np.allclose(table, [[0.25 / 31, -0.25 / 31], [0, 0], [1 / 32, -1 / 32]])


def test_held_out_articles_score_above_frequencies(spark):
    rows = op7_language_model(spark, "/root/testdata/sf0.01").where("held_out").toPandas()
    assert rows["score"].sum() > rows["base_score"].sum()
