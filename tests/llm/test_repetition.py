import random

import numpy as np
import pyarrow as pa
import pytest

from rankmill.llm.repetition import covered, judge, longest_repeats, quality_rules
from rankmill.llm.words import pieces


def brute(words):
    n = len(words)
    best = [0] * n
    for i in range(n):
        for j in range(n):
            k = 0
            while i != j and max(i, j) + k < n and words[i + k] == words[j + k]:
                k += 1
            best[i] = max(best[i], k)
    return best


@pytest.mark.parametrize("seed", range(40))
def test_longest_repeats_match_brute_force(seed):
    rng = random.Random(seed)
    texts = [[rng.randrange(rng.choice([1, 2, 3, 30])) for _ in range(rng.randrange(25))] for _ in range(rng.randrange(1, 6))]
    words = np.array([w for t in texts for w in t], dtype=np.uint64)
    text_of = np.array([i for i, t in enumerate(texts) for _ in t], dtype=np.int64)
    assert longest_repeats(words, text_of).tolist() == [b for t in texts for b in brute(t)]


def test_covered_words_are_a_union_of_spans():
    assert covered(np.array([0, 3, 2, 1, 0, 0, 2, 1]), 2).tolist() == [False, True, True, True, False, False, True, True]


def plain(text):
    import re

    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    best = brute(words)
    inside = [any(best[j] >= 3 and j <= i < j + best[j] for j in range(i + 1)) for i in range(len(words))]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": sum(inside),
        "longest_repeat": max(best, default=0),
    }


def test_figures_match_a_plain_version():
    rng = random.Random(1)
    texts = [None, "", "\n", " \n \n", "a\n\na\n", "a b c a b c", "é ü x\n#<>\n", "x\r\nx\r\nx"]
    texts += ["".join(rng.choice(["a ", "bb ", "\n", "é", "#", "c d e ", "\t"]) for _ in range(rng.randrange(60))) for _ in range(60)]
    column = pa.array([None if t is None else t.encode() for t in texts], type=pa.binary())
    for size in (1, 64, 1 << 20):
        got = {}
        for first, data, offsets in pieces(column, size):
            for name, values in judge(data, offsets).items():
                got.setdefault(name, []).extend(values.tolist())
        for i, text in enumerate(texts):
            want = plain(text)
            assert {k: got[k][i] for k in want} == want, repr(text)


def test_articles(spark):
    clean = " ".join(f"w{i}" for i in range(80))
    loop = " ".join(f"v{i % 40}" for i in range(90))
    rows = [(1, clean, "x"), (1, clean, "x"), (2, None, None), (None, "", "x"), (3, loop, "x"), (4, f"{clean} {clean} z", "x")]
    got = quality_rules(spark.createDataFrame(rows, "id int, content string, kept string")).collect()
    assert sorted((r["id"] or 0, r["n_words"], r["base_failed"], r["kept"]) for r in got) == [
        (0, 0, True, False), (1, 80, False, True), (1, 80, False, True), (2, 0, True, False),
        (3, 90, True, False), (4, 161, True, False),
    ]
    assert quality_rules(spark.createDataFrame([], "id long, content string")).count() == 0


def test_one_very_long_text(spark):
    words = [f"w{i * 7919 % 1_000_003}" for i in range(300_000)]
    rows = [(1, " ".join(words)), (2, " ".join([*words, *words[:200_000]])), (3, "x" * 2_000_000)]
    got = {r["id"]: r for r in quality_rules(spark.createDataFrame(rows, "id long, content string")).collect()}
    assert (got[1]["n_words"], got[1]["n_repeat_words"], got[1]["kept"]) == (300_000, 0, True)
    assert (got[2]["n_words"], got[2]["n_repeat_words"], got[2]["longest_repeat"]) == (500_000, 400_000, 200_000)
    assert (got[3]["n_words"], got[3]["word_chars"]) == (1, 2_000_000)
