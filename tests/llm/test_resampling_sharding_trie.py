"""Resampling, sharding and the conversation trie against brute force, and on the cases their docstrings define."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from boxtally.llm import ordering, prefix_trie, resampling, sharding
from boxtally.llm.radix_tree import Layout4, Layout16, Layout48, Layout256, RadixTree

DOCS = "doc_id long, text string, score string, rank string, row string, hub string, weight string, shard string, n string"
CLASH = ("z",) * 7


def table(spark, rows):
    return spark.createDataFrame([(*r, *CLASH) for r in rows], DOCS)


def test_numbers_follow_the_order(spark):
    df = spark.range(1000, numPartitions=7).selectExpr("id", "pmod(id * 37, 100) as v")
    got = ordering.numbered(df, [F.col("v").desc(), F.col("id")]).collect()
    want = sorted(got, key=lambda r: (-r.v, r.id))
    assert [r.n for r in want] == list(range(1000))
    assert sorted(r.n for r in ordering.numbered(df).collect()) == list(range(1000))
    assert ordering.numbered(df.limit(0), [F.col("v")]).count() == 0


# resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def resample_by_force(rows, target, low=1, high=1, buckets=resampling.BUCKETS, least=20):
    def grams(text):
        w = WORD.findall(ascii_lower(text))
        return len(w), [" ".join(w[i : i + k]) for k in range(low, high + 1) for i in range(len(w) - k + 1)]

    def bucket(f):
        return zlib.crc32(f.encode()) % buckets

    docs = [(i, *grams(t)) for i, t in rows]
    s = Counter(bucket(f) for _, _, fs in docs for f in fs)
    t = Counter(bucket(f) for x in target for f in grams(x)[1])
    a, b = sum(s.values()), sum(t.values())
    gain = {k: math.floor(1000 * math.log((t[k] + 1) * (a + buckets) / ((s[k] + 1) * (b + buckets)))) for k in s}
    out = []
    for i, n, fs in docs:
        weight = sum(gain[bucket(f)] for f in fs)
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, n, len(fs), weight, score, None])
    pool = sorted((r for r in out if r[1] >= least and r[0] is not None), key=lambda r: (-r[4], r[0]))
    for k, r in enumerate(pool[: 10 * len(pool) // 100]):
        r[5] = k + 1
    return sorted(((r[0], r[2], r[3], r[4], r[5]) for r in out), key=repr)


def some_rows(n=120):
    rng = random.Random(7)
    words = ["Aa", "bÉ", "c1", "ünd", "the", "x_y", "日本", "q"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in range(n)]
    return rows + [(500, None), (501, ""), (502, " .,;\n"), (None, "the c1 " * 15), (None, None), (3, "aa " * 30), (503, "Wörd\x00É, " * 40_000), (504, "x" * 300_000 + " y")]


@pytest.mark.parametrize("low, high", [(1, 1), (1, 3), (2, 2)])
def test_resample_by_force(spark, monkeypatch, low, high):
    monkeypatch.setattr(resampling, "PIECE", 1000)
    rows, target = some_rows(), ["the c1 the", None, "日本 aa"]
    items = spark.createDataFrame([(k, x) for k, x in enumerate(target)], "item_id long, text string")
    got = resampling.resample(table(spark, rows), items, low=low, high=high)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=repr) == resample_by_force(rows, target, low, high)


def test_resample_of_nothing_and_of_repeated_rows(spark):
    items = spark.createDataFrame([], "item_id long, text string")
    assert resampling.resample(table(spark, []), items).count() == 0
    rows = [(1, "word " * 25)] * 20 + [(2, "other " * 25)] * 20
    got = resampling.resample(table(spark, rows), items).collect()
    assert sorted(r.rank for r in got if r.rank) == [1, 2, 3, 4] and len(got) == 40


def test_words_with_offsets():
    text = "Ab  c_D\x7fé9 İx"
    got = list(resampling.words_with_offsets(text))
    assert [w for w, _, _ in got] == ["ab", "c", "d", "é9", "İx"]
    assert all(ascii_lower(text[a:b]) == w for w, a, b in got)


# sharding

def placed(spark, rows, **more):
    df = table(spark, rows)
    got = sharding.place(df, **more).collect()
    n = more.get("shards", sharding.SHARDS)
    counts = Counter(r.shard for r in got)
    sizes = [counts.get(s, 0) for s in range(n)]
    assert sum(sizes) == len(rows) and max(sizes) - min(sizes) <= 1
    for s in range(n):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    assert {r.law for r in got} <= {"rows"} and {r.grown_shard for r in got} <= {None}
    homes = defaultdict(set)
    for r in got:
        homes[r.text_crc32].add(r.shard)
    return homes


def test_shards_keep_groups_together(spark):
    rows = [(i, f"text {i // 3 if i < 600 else i}") for i in range(1003)] + [(None, None), (None, ""), (4, "text 1"), (2000, "é" * 100_000)]
    random.Random(1).shuffle(rows)
    homes = placed(spark, rows)
    assert all(len(v) == 1 for v in homes.values())


def test_shards_of_a_group_larger_than_a_shard(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"own {i}") for i in range(1200)]
    homes = placed(spark, rows)
    assert len(homes[zlib.crc32(b"hot")]) == 3  # 400 rows, 150 to a shard


def test_shards_without_free_rows(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"pair {i // 5}") for i in range(800)]  # rounds are limited to spare time
    homes = placed(spark, rows, rounds=5)
    start = defaultdict(set)
    for k, (_, t) in enumerate(rows):
        start[t].add(k % 8)
    assert sum(len(v) for v in homes.values()) < 0.7 * sum(len(v) for v in start.values())


def test_shards_of_little(spark):
    placed(spark, [])
    placed(spark, [(1, "a"), (1, "a"), (2, None)])
    placed(spark, [(i, "same") for i in range(10)], shards=3)


def test_links_through_several_hubs(spark):
    """Two cliques of 40 in four shards, each linked by overlapping hubs."""
    rows = [(r, f"{r // 40}-{r % 40 // 10 + k}", 1.0, r % 4) for r in range(80) for k in (0, 1)]
    links = spark.createDataFrame(rows, "row long, hub string, weight double, shard int")
    got = {r["row"]: r["shard"] for r in sharding.propagate(links, [40, 40, 40, 40]).collect()}
    assert len(got) == 80 and max(Counter(got.values()).values()) <= 40

    def cut(where):
        members = defaultdict(list)
        for r, h, _, _ in rows:
            members[h].append(where[r])
        return sum(len(m) - max(Counter(m).values()) for m in members.values())

    assert cut(got) < 0.5 * cut({r: s for r, _, _, s in rows})


@given(st.integers(2, 5).flatmap(lambda n: st.tuples(st.just(n), st.lists(st.integers(0, 30), min_size=n * n, max_size=n * n), st.lists(st.integers(0, 40), min_size=n, max_size=n), st.lists(st.integers(0, 10), min_size=n, max_size=n))))
@settings(max_examples=200, deadline=None)
def test_allowed_moves_keep_quotas(case):
    n, flat, held, room = case
    wanted = {(a, b): flat[a * n + b] for a in range(n) for b in range(n) if a != b}
    for a in range(n):  # no more leave than are there
        out = [(a, b) for b in range(n) if b != a]
        while sum(wanted[k] for k in out) > held[a]:
            wanted[max(out, key=wanted.get)] -= 1
    quota = [h + r for h, r in zip(held, room)]
    moves = sharding.allowed_moves(wanted, held, quota)
    assert all(0 < v <= wanted[k] for k, v in moves.items())
    for s in range(n):
        assert held[s] + sum(v for k, v in moves.items() if k[1] == s) - sum(v for k, v in moves.items() if k[0] == s) <= quota[s]
    if sum(wanted.values()) and all(sum(flat) <= r for r in room):
        assert moves == {k: v for k, v in wanted.items() if v}


# trie

@given(st.lists(st.lists(st.integers(0, 300), max_size=5), max_size=60))
@settings(max_examples=150, deadline=None)
def test_radix_tree_gives_aligned_prefixes(sequences):
    tree = RadixTree(3)
    for i, s in enumerate(sequences):
        tree.insert(b"".join(x.to_bytes(3, "big") for x in s), i)
    rows, keys = list(tree.aligned()), []
    for parent, depth, last, _ in rows:
        keys.append((keys[parent] if depth else ()) + ((int.from_bytes(last, "big"),) if depth else ()))
        assert len(keys[-1]) == depth
    assert keys == sorted({tuple(s[:d]) for s in sequences for d in range(len(s) + 1)} | {()})
    assert {k: sorted(v) for k, (_, _, _, v) in zip(keys, rows) if v} == {tuple(s): sorted(i for i, x in enumerate(sequences) if x == s) for s in sequences}


def test_radix_tree_layouts_grow():
    tree, kinds = RadixTree(1), []
    for b in random.Random(3).sample(range(256), 256):
        tree.insert(bytes([b]), b)
        if type(tree.root.below) not in kinds:
            kinds.append(type(tree.root.below))
    assert kinds == [Layout4, Layout16, Layout48, Layout256]
    assert [v for _, d, _, v in tree.aligned() if d] == [[b] for b in range(256)]
    with pytest.raises(ValueError):
        RadixTree(2).insert(b"abc", 0)


def trie_by_force(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            digest = hashlib.md5(f"{len(r.encode())}:{r}:{x}".encode()).hexdigest()
            own[c].append((t is not None, t or 0, len(x.encode()), digest, r, x))
    plain = {c: [v[4:] for v in sorted(turns)] for c, turns in own.items()}
    chats = {}
    for c, turns in plain.items():
        h = zlib.crc32(str(c).encode()) % 9
        chats[c] = (*plain.get(c - c % 5, [])[:h], *turns[h:])
    members, children = defaultdict(list), defaultdict(set)
    for c, turns in chats.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
            if d:
                children[turns[: d - 1]].add(turns[:d])
    out = []
    for p, m in members.items():
        below = [q for q in members if q[: len(p)] == p]
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        ends = ",".join(str(c) for c in sorted(m) if len(chats[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), sum(not children[q] for q in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def some_turns():
    rng = random.Random(11)
    rows = []
    for c in range(90):
        for t in range(rng.randint(1, 12)):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["a", "bé", "c" * 50])))
    rows += [(c, t, "user", "copied") for c in range(1000, 1300) for t in range(3)]
    rows += [(2000, None, None, None), (2000, None, "user", None), (2000, 4, None, "x"), (2001, 1, "user", "one"), (2001, 1, "user", "two"), (2001, 1, "user", "one")]
    rows += [(None, 0, "user", "lost"), (-7, 0, "user", "negative"), (3000, 0, "us", "er"), (3005, 0, "user", ""), (3010, 0, "u", "long " * 40_000)]
    rows += [(4000, t, "user", f"turn {t}") for t in range(300)] + [(4001, t, "user", f"turn {t}") for t in range(300)]
    return rows


@pytest.mark.parametrize("block, least", [(1 << 18, 8), (3000, 8), (1, 3)])
def test_trie_by_force(spark, monkeypatch, block, least):
    monkeypatch.setattr(prefix_trie, "BLOCK_BYTES", block)
    monkeypatch.setattr(prefix_trie, "BLOCK_PATHS", least)
    monkeypatch.setattr(prefix_trie, "IDS_BYTES", 1000)
    rows = some_turns()
    df = spark.createDataFrame([(*r, *("z",) * 4) for r in rows], "conv_id long, turn long, role string, text string, key string, ids string, n string, h string")
    got = prefix_trie.rebuilt_trie(df)
    assert got.columns == prefix_trie.NODE_COLUMNS
    assert sorted(map(tuple, got.collect()), key=repr) == trie_by_force(rows)


def test_trie_of_nothing(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.rebuilt_trie(empty).count() == 0
    only = spark.createDataFrame([(None, 1, "user", "a")], "conv_id long, turn long, role string, text string")
    assert prefix_trie.rebuilt_trie(only).count() == 0
