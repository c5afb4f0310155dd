import hashlib
import random
import re
import zlib

import numpy as np

import corpus_pipeline
from rankmill.llm.decontamination import SPAN_WORDS, item_words, united
from rankmill.llm.token_files import Encoder
from rankmill.llm.token_queries import tokenizer_file

from test_decontamination import brute as brute_hits
from test_decontamination import plain_cut
from test_jaccard_join import brute as brute_groups

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def made_up(rng):
    vocabulary = [f"w{i}" for i in range(500)]
    item = [rng.choice(vocabulary) for _ in range(30)]
    rows = []
    for i in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([3, 20, 60, 200]))]
        if i % 9 == 0:
            words[5:5] = item
        rows.append((i, " ".join(words)))
        if i % 4 == 0:
            words[len(words) // 2] = "changed"
            rows.append((1000 + i, "\n".join(words)))
    long = [rng.choice(vocabulary) for _ in range(900)]
    rows.append((3000, " ".join([*long[:400], *item, *long[400:]])))
    rows += [rows[3], rows[3], (2000, None), (2001, ""), (2002, "12 34 ..."), (None, rows[5][1]), (None, "alone in the world")]
    rng.shuffle(rows)
    sources = ["a", "b", "c", None]
    rows = [(id, text, rng.choice(["en", "fr"]), sources[(id or 0) % 4], 0) for id, text in rows]
    return rows, [(7, " ".join(item)), (8, None)]


def plain_mix(rows):
    """Rows of the mix by its definition, sources one after another."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    words = {s: sum(size(r[1]) for r in rows if r[3] == s) for s in sources}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sources)}
    target, capped = {}, set()
    while True:
        left = 1.5 * sum(words.values()) - sum(2 * words[s] for s in capped)
        total = sum(weight[s] for s in sources if s not in capped)
        target = {s: 2.0 * words[s] if s in capped else left * weight[s] / total for s in sources}
        over = {s for s in sources if s not in capped and target[s] > 2 * words[s]}
        if not over:
            break
        capped |= over
    out = []
    for s in sources:
        mine = [(hashlib.md5(f"{'-' if r[0] is None else r[0]}:{'-' if r[1] is None else r[1]}".encode()).hexdigest(), r) for r in rows if r[3] == s]
        rounds = int(target[s] // words[s]) if words[s] else 0
        rest = int(target[s]) - rounds * words[s]
        for _, r in sorted(mine, key=lambda x: x[0]):
            n = size(r[1])
            part = min(max(rest, 0), n)
            out += [r] * (rounds + (rest > 0 and 2 * part >= n))
            rest -= n
    return out


def test_stages_match_a_plain_version(spark, tmp_path):
    rows, items = made_up(random.Random(6))
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    key = lambda r: tuple((v is None, v if v is not None else 0) for v in r)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = rows
    for name, stage in corpus_pipeline.STAGES:
        if name == "language":
            kept = [r for r in kept if any(c.isalpha() for c in r[1] or "")]
        elif name == "near_copies":
            label = brute_groups([(i, r[1]) for i, r in enumerate(kept)], 5, 80)  # groups by row number
            order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0))
            groups = {}
            for i in order:
                groups.setdefault(label[i][2], i)
            kept = [kept[i] for i in sorted(groups.values())]
        elif name == "benchmark":
            found = [(r, brute_hits(r[1], [(str(i), item_words(t)) for i, t in items], 13)) for r in kept]
            kept = []
            for r, (n, hit, _) in found:
                if not (hit and 20 * len(hit) >= n):
                    spans = [(a, b) for a, b in united([(k, k + 1) for k in sorted(hit)]) if b - a > SPAN_WORDS]
                    text = plain_cut(r[1].encode(), spans).decode() if spans else r[1]
                    kept.append((r[0], text, *r[2:4], len(text) if spans else r[4]))
            assert any(r[4] for r in kept)
        elif name == "mixture":
            kept = plain_mix(kept)
        else:
            encoder, want, start = Encoder(tokenizer_file()), [], 0
            for r in sorted(kept, key=lambda r: (r[0] is not None, r[0] or 0)):
                ids = [*encoder.plain([r[1] or ""])[0].tolist(), 2]
                want.append((r[0], start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
                start += len(ids)
            assert sorted(map(tuple, stage(spark, docs, str(tmp_path)).collect()), key=key) == sorted(want, key=key)
            continue
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == [c.split()[0] for c in COLUMNS.split(", ")]
        path = str(tmp_path / name)
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        assert sorted(map(tuple, docs.collect()), key=key) == sorted(kept, key=key), name
    got = sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect()), key=key)
    assert got == sorted(want, key=key)


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
