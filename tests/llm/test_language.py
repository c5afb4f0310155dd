import random

import numpy as np
import pytest

from rankmill.llm.language import best_paths, label_articles, learn_languages
from rankmill.llm.language_queries import HELD_OUT, op3_language


@pytest.mark.parametrize("seed", range(20))
def test_paths_match_a_plain_viterbi(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(0, 12, 7)
    of_text = np.concatenate([[0], np.cumsum(lengths)])
    scores = rng.normal(size=(of_text[-1], 3)).astype(np.float32)
    path = best_paths(scores, of_text, 0.7)
    for a, b in zip(of_text, of_text[1:]):
        part = scores[a:b].astype(np.float64)

        def worth(states):
            return sum(part[i, s] for i, s in enumerate(states)) - 0.7 * sum(x != y for x, y in zip(states, states[1:]))

        best = [[]] if a == b else None
        if best is None:
            value, back = part[0].copy(), []
            for row in part[1:]:
                moves = value[:, None] - 0.7 * (1 - np.eye(3))
                back.append(moves.argmax(0))
                value = moves.max(0) + row
            assert worth(path[a:b].tolist()) == pytest.approx(value.max())


def corpus(rng, n):
    words = {"en": "the of and in to is was that with for".split(), "fr": "le la de et un une des les pour dans".split(),
             "ru": "и в не на я быть он с что это".split()}
    return [(i, " ".join(rng.choice(words[x]) for _ in range(30)), x) for i in range(n) for x in [rng.choice(list(words))]]


def test_articles(spark):
    rows = corpus(random.Random(4), 300)
    learned = spark.createDataFrame([*rows, (900, None, "en"), (901, "x", None)], "id long, content string, lang string")
    model = learn_languages(learned)
    assert model.languages == ["en", "fr", "ru"]
    mixed = " ".join(["les pour dans une"] * 6 + ["the and with that"] * 10)  # what it opens with doesn't name it
    odd = [(1, "это не что", 1), (2, None, 1), (3, "", 1), (4, "123 ... !?", 1), (5, "— “” …", 1), (6, mixed, 1), (6, mixed, 1), (None, "the was", 1)]
    found = label_articles(spark.createDataFrame(odd, "id int, content string, score int"), model, spans=True).collect()
    got = sorted((r["id"] or 0, r["lang_pred"], round(r["score"], 3)) for r in found)
    assert got == [
        (0, "en", 1.0), (1, "ru", 1.0), (2, "und", 0.0), (3, "und", 0.0), (4, "und", 0.0), (5, "und", 0.0), (6, "en", 0.625), (6, "en", 0.625)
    ]
    spans = next(r["spans"] for r in found if r["id"] == 6)
    assert [tuple(s) for s in spans] == [(0, 24, "fr"), (24, 64, "en")]
    assert label_articles(learned.limit(0), model).count() == 0
    nothing = learn_languages(learned.limit(0))
    assert {r["lang_pred"] for r in label_articles(learned, nothing).collect()} == {"und"}


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    rows = op3_language(spark, sf_dir).where("held_out").join(truth, "doc_id").collect()
    assert len(rows) > 150 and HELD_OUT == 2
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.97 * len(rows)


def test_one_very_long_text(spark):
    learned = spark.createDataFrame(corpus(random.Random(5), 300), "id long, content string, lang string")
    text = " ".join(["le la de et un"] * 20_000 + ["the of and in"] * 5_000)
    got = label_articles(spark.createDataFrame([(1, text)], "id long, content string"), learn_languages(learned), spans=True).first()
    assert (got["lang_pred"], round(got["score"], 3)) == ("fr", 0.833)
    assert [tuple(s) for s in got["spans"]] == [(0, 100_000, "fr"), (100_000, 120_000, "en")]
