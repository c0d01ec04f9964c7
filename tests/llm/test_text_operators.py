"""Each operator against a brute-force version and on the cases its docstring defines."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest

from boxtally.llm import decontaminate, exact_dedup, language, licenses, line_dedup, near_dedup, quality, sentencepiece_codec, suffix_dedup, text, warc
from boxtally.session import fresh_path

DOCS = "doc_id long, text string, lang string, source string"


def sentence(rng, n, words=None):
    words = words or [a + b for a in "bcdfgmnprst" for b in ("a", "en", "ir", "o", "um")]
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, blank and long texts, repeated rows, clashing column names."""
    rng = random.Random(4)
    long = "\n".join(sentence(rng, 30) for _ in range(400))
    rows = [
        (1, None, None, None), (2, "", "en", "a"), (3, " \n\t ", "de", "a"), (4, "word", "en", None), (5, long, "en", "b"), (5, long, "en", "b"),
        (6, "…!? 123", "fr", "b"), (None, "a row without an id " * 20, "en", "b"), (None, None, None, None), (7, "x" * 3000, None, "c"),
    ]
    df = spark.createDataFrame(rows, DOCS)
    clash = ["place", "key", "line", "bucket", "id", "digest", "k1", "anchor", "item_id", "row", "h", "p", "score", "__gone", "member", "n"]
    return df.selectExpr("*", *[f"'z' AS `{c}`" for c in clash])


def empty(spark):
    return spark.createDataFrame([], DOCS)


# words and shingles

def test_shingles_match_words():
    texts = ["A b, c d e f", "one two", "", None, "é b c d e f a b c d e"]
    h, o = text.shingles(texts)
    assert np.diff(o).tolist() == [2, 1, 0, 0, 7]
    again, _ = text.shingles([texts[4], texts[0]])
    assert again[:7].tolist() == h[o[4] :].tolist() and again[7:].tolist() == h[:2].tolist()
    assert len(set(again[:7].tolist())) == 7


def test_words_end_by_unicode_class():
    texts = ["a\u00a0b\u2014c \u201cd\u201d\u3000e f\u2026g", "cafe\u0301 \u0939\u093f\u0928\u094d\u0926\u0940", "\u7b2c12\u7ae0abc\u6211\u3002", "\u0e17\u0e35\u0e48\u0e19\u0e35\u0e48", "\u2764\ufe0f x"]
    want = [["a", "b", "c", "d", "e", "f", "g"], texts[1].split(), ["\u7b2c", "12", "\u7ae0", "abc", "\u6211"], ["\u0e17\u0e35\u0e48", "\u0e19\u0e35\u0e48"], ["x"]]
    assert [text.spelt_words(t) for t in texts] == want
    value, offsets = text.words(texts)
    assert np.diff(offsets).tolist() == [len(w) for w in want]
    alone, _ = text.words([w for own in want for w in own])
    assert alone.tolist() == value.tolist()


# WARC

def test_warc_round_trip_and_files(spark):
    rows = [(1, "http://a/", "<p>é\r\n\r\nx</p>"), (2, None, "<p>é\r\n\r\nx</p>"), (3, "http://b/", None), (4, "http://b/", ""), (5, "u\r\nv", "other"), (None, "n", "other")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'z' AS header", "'z' AS payload_key", "'z' AS copies")
    path = fresh_path(spark)
    warc.write_archive(pages, path)
    assert spark.read.parquet(f"{path}/payloads").count() == 3
    records = warc.read_archive(spark, path)
    got = {r.page_id: r for r in warc.describe(records).collect()}
    assert [(k, got[k].record_type, got[k].refers_to) for k in (1, 2, 3, 4)] == [(1, "response", None), (2, "revisit", 1), (3, "response", None), (4, "revisit", 3)]
    body = rows[0][2].encode()
    import base64
    assert got[2].payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode() and got[2].payload_bytes == len(body)
    assert all(r.verified for r in got.values()) and len(got) == 6
    warc.export_warc(spark, path, f"{path}/files", records_a_file=2)
    read = warc.import_warc(spark, f"{path}/files").collect()
    want = {bytes(r.header): bytes(r.payload) for r in records.collect() if b"WARC-Type: response" in bytes(r.header)}
    assert {bytes(r.header): bytes(r.payload) for r in read if b"WARC-Type: response" in bytes(r.header)} == want
    assert len(read) == 6 and sum(not bytes(r.payload) for r in read) >= 2


def test_warc_finds_damage_and_hot_payloads(spark, monkeypatch):
    monkeypatch.setattr(warc, "RECORDS_A_COPY", 3)
    pages = spark.createDataFrame([(i, "u", "same" if i < 20 else f"own {i}") for i in range(30)], "page_id long, url string, html string")
    path = fresh_path(spark)
    buckets = warc.write_archive(pages, path)
    assert warc.describe(warc.read_archive(spark, path)).filter("verified").count() == 30
    whole = sorted((r.record_id, bytes(r.header), bytes(r.payload)) for r in warc.read_archive(spark, path, buckets).collect())
    assert whole == sorted((r.record_id, bytes(r.header), bytes(r.payload)) for r in warc.read_archive(spark, path).collect()) and len(whole) == 30
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("archive_")]
    from pyspark.sql import functions as F
    spark.read.parquet(f"{path}/payloads").withColumn("payload", F.concat("payload", F.lit(b"!"))).write.parquet(f"{path}/bad/payloads")
    spark.read.parquet(f"{path}/headers").write.parquet(f"{path}/bad/headers")
    assert warc.describe(warc.read_archive(spark, f"{path}/bad")).filter("verified").count() == 0
    assert warc.round_trip(pages.limit(0)).count() == 0


# exact

def test_exact_dedup(spark, odd):
    rows = [(1, "a b", None, None), (2, "a  b ", None, None), (3, "ab", None, None), (4, "é", None, None), (5, None, None, None), (6, " ", None, None)]
    df = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.deduplicate(df, exact_dedup.DigestIndex(spark)).collect()}
    assert got == {1: (2, 3, False), 2: (2, 3, True), 3: (2, 3, False), 4: (4, 1, True), 5: (6, 2, False), 6: (6, 2, True)}
    assert exact_dedup.deduplicate(odd, exact_dedup.DigestIndex(spark)).count() == odd.count()
    assert exact_dedup.deduplicate(empty(spark), exact_dedup.DigestIndex(spark)).count() == 0


def test_exact_dedup_over_batches(spark):
    index = exact_dedup.DigestIndex(spark, buckets=3)
    first = spark.createDataFrame([(10, "a", None, None), (11, "b", None, None)], DOCS)
    later = spark.createDataFrame([(1, "a  ", None, None), (2, "c", None, None)], DOCS)
    exact_dedup.deduplicate(first, index).collect()
    again = exact_dedup.DigestIndex(spark, index.path, 3)
    got = {r.doc_id: (r.keep_id, r.kept) for r in exact_dedup.deduplicate(later, again).collect()}
    assert got == {1: (10, False), 2: (2, True)} and again.rows().count() == 3


# lines

def lines_by_force(rows):
    seen, out = [], []
    places = []
    for doc, body in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        for no, raw in enumerate((body or "").split("\n")):
            places.append((doc, no, re.sub(r"\s+", " ", raw).strip().lower()))
    firsts = {}
    for doc, no, line in places:
        if line:
            firsts.setdefault(line, (doc, no))

    def near(a, b):
        if abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < line_dedup.NEAR_CHARS:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    gone = {x for x in firsts if any(firsts[y] < firsts[x] and near(x, y) for y in firsts)}
    for doc, no, line in places:
        if line and (line in gone or (doc, no) > firsts[line]):
            out.append((doc, no))
    del seen
    return sorted(out)


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(9)
    base = [sentence(rng, rng.randrange(2, 14)) for _ in range(40)]
    rows = []
    for doc in range(60):
        body = []
        for _ in range(rng.randrange(1, 7)):
            line = rng.choice(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                at = rng.randrange(len(line) + 1)
                line = rng.choice([line[:at] + "é" + line[at:], line[:at] + line[at + 1 :], line[:at] + "q" + line[at + 1 :]])
            body.append(rng.choice(["", "  "]) + line.replace(" ", rng.choice([" ", "  "])))
        rows.append((doc, "\n".join(body)))
    df = spark.createDataFrame([(a, b, None, None) for a, b in rows], DOCS)
    got = sorted((r.doc_id, r.line_no) for r in line_dedup.dropped_lines(df).collect())
    assert got == lines_by_force(rows) and len(got) > 60
    texts = {r.doc_id: r.text for r in line_dedup.deduplicate(df).collect()}
    for doc, body in rows:
        assert texts[doc] == "\n".join(x for no, x in enumerate(body.split("\n")) if (doc, no) not in set(got))


def test_line_dedup_odd_rows(spark, odd):
    got = line_dedup.clean(odd)
    assert got.count() == odd.count() and set(odd.columns) < set(got.columns)
    kept = [r.text for r in got.filter("doc_id is null").collect()]
    assert sorted(kept, key=str) == sorted([None, "a row without an id " * 20], key=str)
    assert line_dedup.clean(empty(spark)).count() == 0


# near duplicates

def test_probability_jaccard_against_definition():
    rng = np.random.default_rng(2)
    for _ in range(50):
        a = {int(k): int(rng.integers(1, 5)) for k in rng.integers(0, 12, 8)}
        b = {int(k): int(rng.integers(1, 5)) for k in rng.integers(0, 12, 8)}
        want = sum(1 / sum(max(a.get(e, 0) / a[d], b.get(e, 0) / b[d]) for e in set(a) | set(b)) for d in set(a) & set(b))
        arrays = [(np.array(sorted(x)), np.array([x[k] for k in sorted(x)])) for x in (a, b)]
        assert near_dedup.probability_jaccard(*arrays) == pytest.approx(want)


def test_registers_estimate_probability_jaccard():
    rng = np.random.default_rng(3)
    a = {int(k): int(rng.integers(1, 9)) for k in range(60)}
    b = {k + (20 if k < 15 else 0) * 100: v for k, v in a.items()}
    owner = np.repeat([0, 1], [len(a), len(b)])
    element = text.mix(np.array([*a, *b], dtype=np.uint64) + np.uint64(99))
    held = near_dedup.signatures(owner, element, np.array([*a.values(), *b.values()], dtype=float), 2, 4000)
    arrays = [(np.array(sorted(x)), np.array([x[k] for k in sorted(x)])) for x in (a, b)]
    assert (held[0] == held[1]).mean() == pytest.approx(near_dedup.probability_jaccard(*arrays), abs=0.04)
    assert held.all()


def classes_by_force(rows, least=near_dedup.LEAST):
    sets = {i: text.by_text(*text.shingles([t]))[1:] for i, t in rows}
    own = {i: i for i in sets}

    def root(x):
        while own[x] != x:
            x = own[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both_empty = not len(sets[a][0]) and not len(sets[b][0])
        if both_empty or near_dedup.probability_jaccard(sets[a], sets[b]) >= least - 1e-9:
            x, y = sorted((root(a), root(b)))
            own[y] = x
    return {i: root(i) for i in sets}


@pytest.mark.parametrize("small", [2, 512])
def test_near_dedup_against_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(near_dedup.links, "__defaults__", (near_dedup.LEAST, small))
    rng = random.Random(small)
    rows, n = [], 0
    for _ in range(6):
        base = sentence(rng, 120).split()
        for _ in range(rng.choice([1, 4, 25])):
            words = list(base)
            for _ in range(rng.randrange(0, 6)):
                words[rng.randrange(len(words))] = rng.choice("vwxyz") * 3
            rows.append((n, " ".join(words)))
            n += 1
    rows += [(n, ""), (n + 1, "."), (n + 2, "two words"), (n + 3, "Two words!")]
    df = spark.createDataFrame([(a, b, None, None) for a, b in rows], DOCS)
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(df).collect()}
    assert got == classes_by_force(rows)


def test_near_dedup_odd_rows(spark, odd):
    got = {r.doc_id: r for r in near_dedup.near_duplicates(odd).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6, 7} and got[3].class_id == 1
    assert near_dedup.near_duplicates(empty(spark)).count() == 0


# benchmark items

def test_hits_needed():
    assert decontaminate.hits_needed(1) == 1 and decontaminate.hits_needed(10) == 8
    assert 1 <= decontaminate.hits_needed(500) < 20


@pytest.mark.parametrize("block", [1_000_000, 40])
def test_decontaminate_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_HASHES", block)
    rng = random.Random(5)
    items = [(i, sentence(rng, n)) for i, n in enumerate([3, 5, 9, 20, 60, 90, 90])] + [(50, None), (51, "")]
    docs = []
    for d in range(80):
        words = sentence(rng, rng.choice([4, 30, 800])).split()
        if d % 2:
            part = items[d % 7][1].split()
            for _ in range(rng.randrange(0, 4)):
                part[rng.randrange(len(part))] = "zzz"
            at = rng.randrange(len(words))
            words[at:at] = part
        docs.append((d, " ".join(words)))
    docs += [(90, items[0][1]), (91, items[0][1].upper() + "!"), (None, items[4][1]), (92, None)]
    want = set()
    for d, body in docs:
        for i, item in items:
            w = decontaminate.word_shingles(item)
            if w and len(w & decontaminate.word_shingles(body)) / len(w) >= 0.8:
                want.add((d, i))
    df = spark.createDataFrame([(a, b, None, None) for a, b in docs], DOCS).selectExpr("*", "7 AS item_id")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [(r.doc_id, r.item_id) for r in decontaminate.find_items(df, bench).collect()]
    assert set(got) == want and len(got) == len(want) > 20
    kept = {r.doc_id for r in decontaminate.remove_contaminated(df, bench).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in want if d is not None}
    assert decontaminate.find_items(empty(spark), bench).count() == 0
    assert decontaminate.find_items(df, bench.limit(0)).count() == 0


def test_decontaminate_odd_rows(spark, odd):
    bench = spark.createDataFrame([(1, "x" * 3000), (2, "word")], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.find_items(odd, bench).collect()) == [(4, 2), (7, 1)]


def test_decontaminate_short_items_and_unspaced_scripts(spark):
    rng = random.Random(31)
    han = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(400))
    quoted = sentence(rng, 20)
    items = [(1, "zulu yard"), (2, han[100:140]), (3, quoted), (4, "solo"), (5, han[10:13])]
    docs = [
        (1, f"{sentence(rng, 300)} Zulu\u00a0yard, {sentence(rng, 9)}"), (2, han), (3, f"{sentence(rng, 50)} \u201c{quoted.replace(' ', chr(0xA0))}\u201d\u2014{sentence(rng, 9)}"),
        (4, "zulu and yard solos"), (5, f"{sentence(rng, 3)} solo"), (6, "yard zulu"),
    ]
    df = spark.createDataFrame([(a, b, None, None) for a, b in docs], DOCS)
    got = decontaminate.find_items(df, spark.createDataFrame(items, "item_id long, text string"), within=True).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(1, 1), (2, 2), (2, 5), (3, 3), (5, 4)]
    assert all(r.containment == 1 for r in got)


def test_near_dedup_of_an_unspaced_script(spark):
    rng = random.Random(32)
    lines = ["".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(60)) for _ in range(20)]
    changed = [x if k % 2 else x[:30] + "\u3042" + x[31:] for k, x in enumerate(lines)]
    rows = [(1, "\n".join(lines)), (2, "\n".join(changed)), (3, "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(900)))]
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(spark.createDataFrame([(a, b, None, None) for a, b in rows], DOCS)).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


# languages

def test_language_spans_and_held_out(spark):
    rng = random.Random(1)
    kinds = {"aa": ["thon", "ering", "with", "shal"], "bb": ["queau", "étre", "oire", "ment"], "el": ["και", "τον", "μεν"]}
    rows = []
    for d in range(200):
        lang = rng.choice(list(kinds))
        rows.append((d, sentence(rng, rng.randrange(3, 40), kinds[lang]), lang, None))
    df = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r for r in language.identify_held_out(df).collect()}
    assert {d for d, r in got.items() if r.held_out} == {d for d in range(200) if __import__("zlib").crc32(str(d).encode()) % 4 == 2}
    assert all(got[d].lang_pred == lang for d, _, lang, _ in rows)
    model = language.fit(df)
    mixed = sentence(rng, 30, kinds["aa"]) + " " + sentence(rng, 40, kinds["bb"])
    (lang, score, spans), (none, zero, no), cyr = language.label_texts(model, [mixed, "12 …", "привет мир"])
    assert lang == "bb" and 0.4 < score < 0.8 and [s[2] for s in spans] == ["aa", "bb"] and mixed[spans[1][0]:][:1] in "qéom"
    assert (none, zero, no) == ("und", 0.0, []) and cyr[1] == 0.0 and cyr[0] in kinds


def test_best_path_is_the_best():
    rng = np.random.default_rng(0)
    scores = rng.normal(size=(9, 3)).astype(np.float32)
    got = language.best_path(scores, np.array([0, 4, 4, 9]), 1.2)
    for a, b in ((0, 4), (4, 9)):
        def value(path):
            return sum(scores[a + i, x] for i, x in enumerate(path)) - 1.2 * sum(x != y for x, y in zip(path, path[1:]))
        assert value(got[a:b]) == pytest.approx(max(map(value, itertools.product(range(3), repeat=b - a))))


def test_marks_without_a_letter_are_no_language(spark):
    rows = [(i, "some words of one kind", "en", None) for i in range(6)] + [(i, "einige andere Wörter", "de", None) for i in range(6, 12)]
    model = language.fit(spark.createDataFrame(rows, DOCS))
    texts = ["\u2600\ufe0f \u2764\ufe0f 12", "\u0301 \u0300", "", None, "\u2764\ufe0f words", "Wo\u0308rter \u0301"]
    got = language.label_texts(model, texts)
    assert [g[:2] for g in got[:4]] == [("und", 0.0)] * 4 and [len(g[2]) for g in got] == [0, 0, 0, 0, 1, 1]
    assert [g[0] for g in got[4:]] == ["en", "de"] and got[5][2] == [(0, 7, "de")]


def test_language_odd_rows(spark, odd):
    got = language.identify_held_out(odd).collect()
    assert len(got) == odd.count()
    assert {r.doc_id: r.lang_pred for r in got if r.doc_id in (1, 2, 3, 6)} == {1: "und", 2: "und", 3: "und", 6: "und"}
    assert language.identify_held_out(empty(spark)).count() == 0
    alone = language.identify_held_out(spark.createDataFrame([(1, "abc", None, None)], DOCS)).first()
    assert (alone.lang_pred, alone.score) == ("und", 0.0)


# pieces

@pytest.fixture(scope="module")
def codec():
    return sentencepiece_codec.Codec.load()


def test_pieces_equal_the_library(codec):
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    rng = random.Random(7)
    letters = "etaoin shrdlu  éèß漢字🙂\n\t.,-ABZ019"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 60))) for _ in range(400)]
    texts += [sentence(rng, 200), "the quick brown fox jumps over the lazy dog " * 20, " lead", "trail ", "x" * 5000]
    values, offsets = codec.encode(texts)
    for i, t in enumerate(texts):
        own = values[offsets[i] : offsets[i + 1]].tolist()
        assert own == sp.encode(t), t
        assert codec.decode(own) == t


def test_pieces_of_a_unigram_model():
    pieces = ["▁", "a", "b", "ab", "▁a", "ba", "▁ab", "c"]
    scores = [-3.1, -2.0, -2.2, -2.5, -2.1, -2.4, -4.5, -2.7]
    full = [f"<0x{b:02X}>" for b in range(256)]
    own = sentencepiece_codec.Codec(pieces + full, scores + [0.0] * 256, range(8, 264), [True] * 8 + [False] * 256, merges=False)
    for word in ("abab", "aab", "bba", "cab", "abc abc"):
        got = [own.pieces[i] for i in own.encode([word])[0]]
        marked = "▁" + word.replace(" ", "▁")

        def ways(rest):
            if not rest:
                yield []
            for p in pieces:
                if rest.startswith(p):
                    for more in ways(rest[len(p):]):
                        yield [p, *more]

        best = max(sum(scores[pieces.index(p)] for p in w) for w in ways(marked))
        assert "".join(got) == marked and sum(scores[pieces.index(p)] for p in got) == pytest.approx(best)


def test_pieces_round_trip_of_odd_rows(spark, odd, codec):
    marks = spark.createDataFrame([(1, "a▁b ▁▁ c", None, None), (2, "\x00\r\n ", None, None)], DOCS)
    got = sentencepiece_codec.encode_and_check(odd.select("doc_id", "text", "lang", "source").unionByName(marks), codec).collect()
    assert len(got) == odd.count() + 2 and all(r.exact for r in got)
    assert sum(r.piece_ids is None for r in got) == 2
    pieces = sentencepiece_codec.encode(marks, codec)
    assert {r.text for r in sentencepiece_codec.decode(pieces, codec).collect()} == {"a▁b ▁▁ c", "\x00\r\n "}
    assert sentencepiece_codec.encode_and_check(odd, codec).count() == odd.count()
    assert sentencepiece_codec.encode_and_check(empty(spark), codec).count() == 0


# licences

def test_license_scan(spark, odd):
    rng = random.Random(3)
    notices = {
        "Apache": "Licensed under the Apache License, Version 2.0.", "MIT": "Released under the MIT License.",
        "GPL": "This work is licensed under the GNU General Public License, version 3.", "CC-BY-NC": "Licensed under CC BY-NC 4.0.",
    }
    rows = [(i, f"{sentence(rng, 20)}\n{n}\n{sentence(rng, 5)}", None, None) for i, n in enumerate([*notices.values()] * 3)]
    rows += [(50, "He lost his driving license.", None, None), (51, "komm mit der und", None, None), (52, sentence(rng, 50), None, None)]
    got = licenses.scan(spark.createDataFrame(rows, DOCS)).collect()
    found = {r.doc_id: (r.paragraph_no, r.family) for r in got if r.confirmed}
    assert found == {i: (1, f) for i, f in enumerate([*notices] * 3)}
    assert {r.doc_id: r.family for r in got if not r.confirmed} == {50: "unknown"}
    assert licenses.scan(odd).count() == 0 and licenses.scan(empty(spark)).count() == 0


def test_license_classifier_equals_its_numpy_form(spark):
    rng = random.Random(8)
    model = licenses.fit([sentence(rng, 12) for _ in range(60)])
    texts = [n for own in licenses.TEMPLATES.values() for n in own] + licenses.OTHERS
    got = {r.paragraph: r for r in licenses.classify(spark.createDataFrame([(t,) for t in dict.fromkeys(texts)], "paragraph string"), model).collect()}
    right = 0
    for t in dict.fromkeys(texts):
        p = model.probabilities(t)
        assert got[t].probability == pytest.approx(p.max(), abs=2e-6)
        assert got[t].family == (model.families[p.argmax()] if p.max() >= licenses.LEAST else "unknown")
        right += got[t].family in [f for f, own in licenses.TEMPLATES.items() if t in own] or (t in licenses.OTHERS and got[t].family == "unknown")
    assert right >= 0.95 * len(got)


def test_license_scan_of_identifiers_and_wrapped_notices(spark):
    rng = random.Random(21)
    lines = {
        "Available under Apache-2.0": "Apache", "GPL-2.0-only": "GPL", "BSD-3-Clause": "BSD", "MIT-licensed code": "MIT", "CC BY 4.0": "CC-BY",
        "Permission is hereby granted, free of charge, to any person obtaining a copy": "MIT",
        "This is free and unencumbered software released into the public domain.": "CC0",
    }
    # a notice cut into lines that name nothing, behind blank lines
    wrapped = "Use of this\nsource code is\ngoverned by a\nBSD-style\nlicense that can\nbe found in the\nLICENSE file."
    bodies = [f"{sentence(rng, 9)}\n{n}\n\n{sentence(rng, 9)}" for n in lines]
    bodies.append(f"\n{sentence(rng, 9)}\n{sentence(rng, 9)}\n \t\n\n{wrapped}\n\n{sentence(rng, 5)}\n")
    bodies += [sentence(rng, 40) for _ in range(50)]
    docs = spark.createDataFrame([(i, b, None, None) for i, b in enumerate(bodies)], DOCS)
    got = {(r.doc_id, r.paragraph_no, r.paragraph): r for r in licenses.scan(docs).collect()}
    for i, (n, family) in enumerate(lines.items()):
        assert got[i, 1, n].family == family
    assert got[len(lines), 5, wrapped].family == "BSD" and got[len(lines), 5, wrapped].confirmed


def test_licenses_without_decisive_ngrams_are_unknown():
    rng = random.Random(22)
    model = licenses.fit([sentence(rng, 12) for _ in range(60)])
    kept = set(licenses.decisive(model))
    assert kept < set(model.grams)
    weak = [g for g in model.grams if g not in kept and " " not in g]
    for n in (1, 3, len(weak)):
        for _ in range(200):
            words = rng.sample(weak, n)
            if not kept & set(licenses.ngrams(words)):
                p = model.probabilities(" ".join(words))
                assert model.families[p.argmax()] == "unknown" or p.max() < licenses.LEAST


# quality

def test_quality_posteriors_follow_the_formula(spark):
    rng = random.Random(2)
    rows = []
    for d in range(400):
        good = rng.random() < (0.9 if d % 4 else 0.3)
        rows.append((d, sentence(rng, 40) + "." if good else "$$$ ### " + sentence(rng, 20).upper().replace(" ", " %% "), "en" if d % 3 else "de", f"h{d % 4}"))
    df = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(d, int("$" not in t)) for d, t, _, _ in rows if d % 2], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.posteriors(df, labels).collect()}
    held = [(got[d].keep, "$" not in t) for d, t, _, _ in rows if not d % 2]
    assert np.mean([a == b for a, b in held]) > 0.97
    rates = {h: np.mean([got[d].host_rate for d, _, _, s in rows if s == h]) for h in ("h0", "h1", "h2", "h3")}
    assert rates["h0"] < min(rates["h1"], rates["h2"], rates["h3"]) - 0.1
    some = got[0]
    assert some.posterior == pytest.approx(1 / (1 + np.exp(-(some.evidence + np.log(some.path_rate / (1 - some.path_rate))))), abs=1e-4)


def test_quality_odd_rows(spark, odd):
    labels = spark.createDataFrame([(4, 1), (5, 1), (6, 0), (7, 0), (None, 1), (2, None)], "doc_id long, quality int")
    assert quality.posteriors(odd, labels).count() == odd.count()
    none = quality.posteriors(odd, labels.limit(0)).collect()
    assert all(r.posterior == pytest.approx(0.5, abs=1e-4) for r in none)
    assert quality.posteriors(empty(spark), labels).count() == 0


# suffixes

def test_suffix_order_and_common_prefixes():
    rng = np.random.default_rng(0)
    for _ in range(40):
        d = rng.integers(0, 3, 70)
        order, values = suffix_dedup.suffix_order(d, 200), d.tolist()
        assert order.tolist() == sorted(range(70), key=lambda i: values[i:])
        got = suffix_dedup.common_prefixes(d, order, 9)
        for r in range(1, 70):
            a, b = values[order[r - 1] :], values[order[r] :]
            want = next((k for k in range(min(len(a), len(b), 9)) if a[k] != b[k]), min(len(a), len(b), 9))
            assert got[r] == want


def removed_by_force(texts, length):
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), dtype=bool)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append((int(gone.sum()), bytes(np.frombuffer(t, dtype=np.uint8)[~gone])))
    return out


@pytest.mark.parametrize("shard, block", [(4096, 1 << 20), (2, 150)])
def test_suffix_dedup_against_brute_force(spark, monkeypatch, shard, block):
    monkeypatch.setattr(suffix_dedup, "PIECES_A_SHARD", shard)
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    monkeypatch.setattr(suffix_dedup, "MERGE_WINDOWS", 50)
    rng = random.Random(6)
    passages = [sentence(rng, 12) for _ in range(5)]
    texts = []
    for _ in range(60):
        parts = [rng.choice(passages)[rng.randrange(10) :] if rng.random() < 0.5 else sentence(rng, rng.randrange(1, 15)) for _ in range(rng.randrange(1, 6))]
        texts.append("é".join(parts))
    texts += ["ab" * 100, "", None, texts[0], texts[0]]
    rows = [(i if i % 7 else None, t, None, None) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    got = Counter((r.n_removed, bytes(r.kept)) for r in suffix_dedup.remove_repeats(df, length=40, gram=8).collect())
    assert got == Counter(removed_by_force([(t or "").encode() for t in texts], 40))


def test_suffix_dedup_odd_rows(spark, odd):
    got = suffix_dedup.remove_repeats(odd).collect()
    assert len(got) == odd.count()
    assert [r.n_removed for r in got if r.doc_id == 7] == [3000] and all(not r.kept for r in got if r.doc_id == 5)
    assert suffix_dedup.remove_repeats(empty(spark)).count() == 0
