import random
import re

import numpy as np
import pytest

from rankmill.llm.components import components
from rankmill.llm.jaccard_join import join_articles, packed_sets, placed_sets, unpacked_sets
from rankmill.llm.trie_join import linked_pairs


@pytest.mark.parametrize("seed", range(40))
def test_trie_finds_all_pairs(seed):
    rng = random.Random(seed)
    base = [rng.sample(range(60), 20) for _ in range(3)]
    sets = []
    for _ in range(rng.randrange(1, 40)):
        one = set(rng.choice(base))
        for _ in range(rng.randrange(4)):
            one.discard(rng.randrange(60))
            one.add(rng.randrange(200))
        sets.append(np.array(sorted(one), dtype=np.int64) * 7_919 - 40)
    kinds = np.array([rng.choice([0, 1, 2]) for _ in sets])
    percent = rng.choice([50, 80, 90])
    want = set()
    for i, a in enumerate(sets):
        for j in range(i + 1, len(sets)):
            common = len(set(a.tolist()) & set(sets[j].tolist()))
            if 100 * common >= percent * (len(a) + len(sets[j]) - common) and (kinds[i] == 0 or kinds[i] != kinds[j]):
                want.add((i, j))
    got = linked_pairs(sets, kinds, percent)
    assert len(got) == len({tuple(x) for x in got.tolist()})
    assert {tuple(x) for x in got.tolist()} == want


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(80), rng.randrange(80)) for _ in range(45)] + [(5, 5)]
    parent = {x: x for e in edges for x in e if e[0] != e[1]}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: min(y for y in parent if root(y) == root(x)) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute(rows, shingle, percent):
    def grams(text):
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        if len(words) < shingle:
            return frozenset([tuple(words)] if words else [])
        return frozenset(tuple(words[i : i + shingle]) for i in range(len(words) - shingle + 1))

    sets = [grams(text) for _, text in rows]
    label = list(range(len(rows)))
    linked = [
        (i, j)
        for i in range(len(rows))
        for j in range(i)
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])
    ]
    changed = True
    while changed:
        changed = False
        for i, j in linked:
            low = min(label[i], label[j])
            changed |= label[i] != low or label[j] != low
            label[i] = label[j] = low
    out = []
    for i, (id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if label[j] == label[i] and rows[j][0] is not None]
        others = {sets[j] for k, j in linked if k == i} | {sets[k] for k, j in linked if j == i}
        out.append((id, len(sets[i]), min(ids, default=None) if sets[i] else id, len(others - {sets[i]})))
    return out


@pytest.mark.parametrize("shingle, percent, block_sets", [(3, 90, 1500), (3, 90, 5), (5, 80, 1500), (2, 60, 7)])
def test_articles_match_brute_force(spark, shingle, percent, block_sets):
    rng = random.Random(shingle * percent + block_sets)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(30)]
    texts = []
    for _ in range(14):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 4, 9, 30, 120]))]
        if rng.random() < 0.5:
            base += passage
        for _ in range(rng.randrange(1, 14)):
            copy = list(base)
            for _ in range(rng.randrange(4)):
                k = rng.randrange(len(copy))
                copy[k : k + rng.randrange(2)] = [rng.choice(vocabulary)]
            texts.append(rng.choice([" ", "\n"]).join(copy))
    rows = [(i, t if i % 3 else t.upper()) for i, t in enumerate(texts)]
    rows += [(3, rows[3][1]), (3, rows[3][1]), (3, rows[20][1]), (None, rows[4][1]), (None, None), (900, ""), (901, " \n"), (902, None)]
    rows += [(None, "only nulls here"), (None, "only nulls here")]
    rng.shuffle(rows)
    frame = spark.createDataFrame([(*r, 1) for r in rows], "id long, content string, set int").repartition(5)
    got = join_articles(frame, shingle=shingle, percent=percent, block_sets=block_sets).collect()
    key = lambda x: tuple((v is None, v or 0) for v in x)
    found = sorted(((r["id"], r["n_shingles"], r["component_id"], r["n_links"]) for r in got), key=key)
    assert found == sorted(brute(rows, shingle, percent), key=key)


def respaced(rng, words):
    """The words with other white space: indented lines, double spaces, aligned columns, one word a line."""
    kind = rng.randrange(4)
    if kind == 0:
        return "\n".join(" " * 24 + " ".join(words[i : i + 12]) for i in range(0, len(words), 12))
    if kind == 1:
        return "".join(w + rng.choice([" ", "  ", "\t", "\r\n", "\n\n    "]) for w in words)
    return " ".join(w.ljust(14) for w in words) if kind == 2 else "\n".join(" " * rng.randrange(30) + w for w in words)


@pytest.mark.parametrize("shingle, percent", [(5, 90), (5, 80), (3, 90)])
def test_white_space_does_not_part_copies(spark, shingle, percent):
    rng = random.Random(shingle * percent)
    rows = []
    for _ in range(60):
        words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(1, 9))) for _ in range(300)]
        copy = list(words)
        for _ in range(3):
            copy[rng.randrange(300)] = f"new{rng.random()}"
        rows += [(len(rows), " ".join(words)), (len(rows) + 1, respaced(rng, copy))]
    frame = spark.createDataFrame(rows, "id long, content string").repartition(3)
    got = join_articles(frame, shingle=shingle, percent=percent).collect()
    assert sorted((r["id"], r["n_shingles"], r["component_id"], r["n_links"]) for r in got) == sorted(brute(rows, shingle, percent))


def test_empty_and_unlinked(spark):
    frame = spark.createDataFrame([(1, "a b c d"), (2, "e f g h")], "id int, content string")
    assert join_articles(frame.limit(0)).count() == 0
    assert sorted((r["id"], r["component_id"]) for r in join_articles(frame).collect()) == [(1, 1), (2, 2)]


@pytest.mark.parametrize("seed", range(10))
def test_packed_sets_come_back(seed):
    rng = np.random.default_rng(seed)
    common = rng.integers(-(2**63), 2**63 - 1, 50)
    sets = [np.unique(np.concatenate([common[rng.random(50) < 0.9], rng.integers(0, 99, rng.integers(0, 4))])) for _ in range(int(rng.integers(1, 30)))]
    sets.append(np.array([7], dtype=np.int64))
    names, own = rng.integers(0, 2**60, len(sets)), rng.integers(0, 2, len(sets))
    data = packed_sets(names, own, sets)
    got_names, got_own, got = unpacked_sets(data)
    assert (got_names == names).all() and (got_own == own).all()
    assert [sorted(x.tolist()) for x in got] == [sorted(x.tolist()) for x in sets]


@pytest.mark.parametrize("n", [10_000, 100_000])
def test_a_large_group_sends_each_set_once(spark, n):
    members = spark.range(n).selectExpr("id AS set", "1L AS place", "300L AS n", "id", "id AS content_key")
    placed = placed_sets(members, 90, 1500)
    assert placed.count() == n
    assert placed.groupBy("part", "block").count().agg({"count": "max"}).first()[0] < 2 * 1500


def test_a_family_packs_to_a_fraction():
    rng = np.random.default_rng(1)
    core = rng.integers(-(2**63), 2**63 - 1, 1000)
    sets = [np.unique(np.concatenate([np.delete(core, rng.integers(0, 1000, 6)), rng.integers(0, 2**40, 6)])) for _ in range(400)]
    assert len(packed_sets(np.arange(400), np.ones(400, dtype=int), sets)) < sum(s.nbytes for s in sets) / 20


def test_columns_of_any_names_stay(spark):
    from rankmill.llm.jaccard_join import one_per_group

    rows = [(1, "a b c d e f g", 10, 11, "x", 12), (1, "a b c d e f g", 10, 11, "x", 12), (2, "q r s t u v", 20, 21, "y", 22), (3, None, 30, 31, None, 32)]
    frame = spark.createDataFrame(rows, "id long, body string, _row_key int, _number int, given string, `a.b` int")
    got = one_per_group(frame, "id", "body")
    assert got.columns == frame.columns
    assert sorted(map(tuple, got.collect())) == [rows[0], rows[2], rows[3]]


def test_very_long_texts(spark):
    words = [f"w{i * 7919 % 100_003}" for i in range(120_000)]
    near = [*words[:50_000], "changed", *words[50_001:]]
    rows = [(1, " ".join(words)), (2, "\n".join(near)), (3, " ".join(words[:60_000])), (4, "short one")]
    got = {r["id"]: (r["component_id"], r["n_links"]) for r in join_articles(spark.createDataFrame(rows, "id long, content string")).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (3, 0), 4: (4, 0)}


def test_a_block_is_sent_a_bounded_number_of_times(spark):
    from rankmill.llm.jaccard_join import STRIPS, strip_pairs

    def dealt(n):
        blocks = spark.range(n).selectExpr("'p' AS part", f"{n} AS blocks", "CAST(id AS INT) AS block", "CAST('x' AS BINARY) AS data")
        return strip_pairs(blocks)

    assert dealt(1000).count() == 1000 * STRIPS
    sent = dealt(100)
    assert sent.count() == 100 * 10
    met = sent.alias("a").join(sent.alias("b"), ["part", "low", "high"]).where("a.block < b.block AND (low = high OR a.strip < b.strip OR a.strip > b.strip)")
    assert met.count() == met.select("a.block", "b.block").distinct().count() == 100 * 99 // 2


def test_strips_give_all_links(spark, monkeypatch):
    from rankmill.llm import jaccard_join

    monkeypatch.setattr(jaccard_join, "STRIPS", 3)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(90):
        copy = list(base)
        for _ in range(rng.randrange(5)):
            copy[rng.randrange(60)] = rng.choice(base)
        rows.append((i, " ".join(copy)))
    got = jaccard_join.join_articles(spark.createDataFrame(rows, "id long, content string"), shingle=2, percent=70, block_sets=8).collect()
    assert sorted((r["id"], r["n_shingles"], r["component_id"], r["n_links"]) for r in got) == sorted(brute(rows, 2, 70))


def test_only_the_result_stays_settled(spark, tmp_path, monkeypatch):
    from rankmill import session

    monkeypatch.setattr(session, "shared_folder", lambda _: f"file:{tmp_path}")
    frame = spark.createDataFrame([(1, "a b c d"), (2, "e f g h")], "id int, content string")
    got = session.settle_last(spark, lambda: join_articles(frame))
    assert len(list(tmp_path.glob("settled-*"))) == 1
    assert got.count() == 2


def test_what_many_sets_share_makes_no_group(spark):
    from rankmill.llm.jaccard_join import candidates

    # pairs that share three rare shingles; all sets share two frequent ones
    prefixes = [(2 * k + side, [7, 8, *range(100 * k + 100, 100 * k + 103), 100_000 + 2 * k + side]) for k in range(30) for side in (0, 1)]
    sets = spark.createDataFrame([(s, 9, p) for s, p in prefixes], "set long, n_shingles long, prefix array<long>")
    groups = candidates(sets, sets.selectExpr("set", "3 AS needed")).groupBy("place").agg({"set": "collect_list"}).collect()
    assert sorted(sorted(r[1]) for r in groups) == [[2 * k, 2 * k + 1] for k in range(30)]


@pytest.mark.parametrize("seed", range(3))
def test_sets_that_share_enough_are_in_one_group(spark, seed):
    from rankmill.llm.jaccard_join import candidates

    rng = random.Random(seed)
    prefixes = {s: {int(rng.paretovariate(0.4)) for _ in range(rng.randrange(3, 12))} for s in range(120)}
    needed = {s: rng.randrange(2, 5) for s in prefixes}
    sets = spark.createDataFrame([(s, 9, sorted(p)) for s, p in prefixes.items()], "set long, n_shingles long, prefix array<long>")
    place = {r["set"]: r["place"] for r in candidates(sets, spark.createDataFrame(list(needed.items()), "set long, needed int")).collect()}
    partners = [(a, b) for a in prefixes for b in prefixes if a < b and len(prefixes[a] & prefixes[b]) >= max(needed[a], needed[b])]
    assert partners and all(place[a] == place[b] for a, b in partners)
