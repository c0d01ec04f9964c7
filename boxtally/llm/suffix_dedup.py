"""Removal of every byte that lies in a long string which occurs anywhere else.

Texts are UTF-8 bytes. A byte goes when some ``LENGTH``-byte string that covers it also starts at another
place, in the same text or another. Matches never cross texts and are judged on the texts as they came.

1. Every ``LENGTH``-byte string (a window) has an anchor: the ``GRAM``-byte string in it with the smallest
   hash, of equals the leftmost. Equal windows have equal anchors at equal places. The windows of one anchor
   stand in a row; the bytes they cover are a piece. Anchors and digests of pieces are counted, not the texts.
2. A piece whose digest occurs twice is a repeat in full. Only pieces whose anchor has several digests are
   looked into, one of each digest: they go to shards by anchor. An anchor with many pieces is dealt over
   several shards.
3. Each shard sorts the suffixes of its pieces: a suffix array by Larsson-Sadakane refinement, which goes on
   only while ranks are shared and the window is not reached, and Kasai's common prefixes. Neighbours with a
   common prefix of a whole window are a repeat.
4. Windows of anchors that were dealt over shards are merged across them: each shard's windows are sorted by
   key, cut at common key borders, and each range finds the keys that several shards hold by binary search.

Each step is linear in the bytes it gets; no task gets more than a share of one anchor's pieces.

Defined results: null counts as the empty text; a text shorter than ``LENGTH`` loses nothing. A row is known by
its id and a hash of its text, so repeated and null ids are rows like any other, and equal rows repeat each
other's bytes. Empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxtally.llm.filters import maybe_in
from boxtally.llm.text import chunks, mix, powers, signed
from boxtally.session import cut_lineage

LENGTH = 200
GRAM = 32
#: Pieces of one anchor that go to one shard; more are dealt over several.
PIECES_A_SHARD = 4096
#: Bytes of pieces in a shard, on average, and of window starts that are searched for anchors at a time.
SHARD_BYTES = 1 << 20
BLOCK = 1 << 20
#: Windows that one range of the merge across shards holds, on average.
MERGE_WINDOWS = 200_000
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
#: The low bits of a hash that make room for a place in a block of texts.
_PLACE = np.uint64((1 << 24) - 1)


def anchors(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first window start, number of windows) of the pieces of texts that stand one after the other.

    ``ends`` has the end of each text. A window's anchor is found as a sliding minimum of hash and place in one
    number, by doubling the span.
    """
    windows = len(data) - length + 1
    empty = np.zeros(0, dtype=np.int64)
    if windows <= 0:
        return empty.astype(np.uint64), empty, empty
    grams = len(data) - gram + 1
    with np.errstate(over="ignore"):
        power = powers(_BASE, len(data) + 1)
        prefix = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data] * power[len(data) - 1 :: -1][: len(data)], out=prefix[1:])
        # each gram is multiplied by the power that its place lacks, so equal grams have equal values in every block
        alike = np.uint64(pow(int(_BASE), -(len(data) - 1), 1 << 64))
        value = mix((prefix[gram:] - prefix[:-gram]) * power[:grams] * alike)
    low = (value & ~_PLACE) | np.arange(grams, dtype=np.uint64)
    span, width = length - gram + 1, 1
    while 2 * width <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    at = (np.minimum(low[:windows], low[span - width : span - width + windows]) & _PLACE).astype(np.int64)
    whole = np.ones(windows, dtype=bool)  # windows inside one text
    for k in ends[:-1]:
        whole[max(k - length + 1, 0) : k] = False
    new = np.ones(windows, dtype=bool)
    new[1:] = (at[1:] != at[:-1]) | ~whole[:-1]
    start = np.flatnonzero(new & whole)
    stop = np.append(np.flatnonzero(new | ~whole), windows)
    return value[at[start]], start, stop[np.searchsorted(stop, start, side="right")] - start


def suffix_order(data: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``data`` in order of their first ``depth`` values at least.

    Larsson-Sadakane: suffixes are ordered by a prefix, then by the rank of the suffix behind it, which doubles
    the ordered length; groups of one are settled and left out. ``data`` holds small non-negative integers.
    """
    n = len(data)
    width = 7  # values of 9 bits, packed into one number
    key = np.zeros(n, dtype=np.int64)
    for k in range(width):
        key <<= 9
        key[: n - k] |= data[k:].astype(np.int64) + 1
    order = np.argsort(key, kind="stable")
    rank = np.zeros(n, dtype=np.int64)
    ranked = key[order]
    first = np.ones(n, dtype=bool)
    first[1:] = ranked[1:] != ranked[:-1]
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    while width < depth:
        shared = np.zeros(n, dtype=bool)
        shared[1:] |= ~first[1:]
        shared[:-1] |= ~first[1:]
        slot = np.flatnonzero(shared)
        if not len(slot):
            break
        who = order[slot]
        behind = who + width
        after = np.where(behind < n, rank[np.minimum(behind, n - 1)] + 1, 0)
        group = rank[who]
        by = np.argsort(group * (n + 2) + after, kind="stable")
        order[slot] = who[by]
        g, a = group[by], after[by]
        head = np.ones(len(slot), dtype=bool)
        head[1:] = (g[1:] != g[:-1]) | (a[1:] != a[:-1])
        rank[order[slot]] = np.maximum.accumulate(np.where(head, slot, 0))
        first[slot] = head
        width *= 2
    return order


def common_prefixes(data: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Length, up to ``most``, of the common prefix of each suffix in order with the one before it.

    Kasai's walk: from one place of the text to the next the common prefix shrinks by one at most, so runs of
    places whose neighbours also move on by one share their comparisons. The walk is done for all such runs at
    once: a run is compared byte by byte as one string against the string it follows.
    """
    n = len(order)
    place = np.empty(n, dtype=np.int64)
    place[order] = np.arange(n)
    before = np.where(place > 0, order[place - 1], -1)  # the suffix before each suffix, in text order
    out = np.zeros(n, dtype=np.int64)
    shift = np.where(before >= 0, before - np.arange(n), n + 1)
    cut = np.ones(n, dtype=bool)
    cut[1:] = shift[1:] != shift[:-1]
    start = np.flatnonzero(cut)
    end = np.append(start[1:], n)
    live = shift[start] != n + 1
    start, end = start[live], end[live]
    step = shift[start]
    # how far each run goes on matching behind its last place
    tail = np.zeros(len(start), dtype=np.int64)
    going = np.arange(len(start))
    last = end - 1
    while len(going):
        a = last[going] + tail[going]
        b = a + step[going]
        inside = (a < n) & (b < n)
        same = np.zeros(len(going), dtype=bool)
        same[inside] = data[a[inside]] == data[b[inside]]
        going = going[same]
        tail[going] += 1
        going = going[tail[going] < most]
    size = end - start
    at = np.repeat(start, size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    by = np.repeat(step, size)
    same = data[at] == data[np.minimum(at + by, n - 1)]
    # inside a run the common prefix ends at its next mismatch, else behind its end
    stop = np.where(same, np.iinfo(np.int64).max, at)
    ends = np.cumsum(size)
    reach = np.repeat(last + tail, size)
    stop = np.minimum(_next_in_run(stop, ends, size), reach)
    out[place[at]] = np.minimum(np.maximum(stop - at, 0), most)
    return out


def _next_in_run(stop: np.ndarray, ends: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For each entry the smallest value at or behind it within its run."""
    if not len(stop):
        return stop
    run = np.repeat(np.arange(len(size)), size)
    big = np.iinfo(np.int64).max
    index = np.where(stop < big, np.arange(len(stop)), big)
    nearest = np.minimum.accumulate(index[::-1])[::-1]
    ok = nearest < big
    ok[ok] = run[nearest[ok]] == run[ok]
    out = np.full(len(stop), big)
    out[ok] = stop[nearest[ok]]
    return out


def window_classes(pieces: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of some pieces in order of their bytes: (piece, offset, class); windows of one class are equal."""
    size = np.array([len(p) for p in pieces])
    base = np.cumsum(size + 1) - size - 1
    data = np.full(int(size.sum()) + len(pieces), 256, dtype=np.int64)  # each piece ends in a value no byte has
    inside = np.ones(len(data), dtype=bool)
    inside[base + size] = False
    data[inside] = np.frombuffer(b"".join(pieces), dtype=np.uint8)
    order = suffix_order(data, length)
    prefix = common_prefixes(data, order, length)
    piece = np.searchsorted(base, order, side="right") - 1
    offset = order - base[piece]
    window = offset + length <= size[piece]
    # equal windows are neighbours in order, and no other suffix stands between them
    group = np.cumsum(prefix < length)
    return piece[window], offset[window], group[window]


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"), text.alias("text"), F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("k1"),
        F.xxhash64(text, F.col(id_col).isNull()).alias("k2"),
    )


def pieces(rows: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(k1, k2, anchor, digest, start, windows) of all texts; texts too long for a block go in parts that overlap by a window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text").to_pylist()
            for i, j in chunks(column, BLOCK):
                texts = [t.encode("utf-8", "replace") for t in column[i:j]]
                for shift in range(0, max(len(texts[0]) - length + 1, 1), BLOCK) if len(texts) == 1 else (0,):
                    parts = [texts[0][shift : shift + BLOCK + length - 1]] if len(texts) == 1 else texts
                    ends = np.cumsum([len(t) for t in parts])
                    joined = b"".join(parts)
                    value, start, count = anchors(np.frombuffer(joined, dtype=np.uint8), ends, length, gram)
                    digest = b"".join(hashlib.md5(joined[a : a + n + length - 1]).digest()[:8] for a, n in zip(start.tolist(), count.tolist()))
                    owner = np.searchsorted(ends, start, side="right")
                    at = start - (ends - [len(t) for t in parts])[owner] + shift
                    rows_at = pa.array(owner + i)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("k1").take(rows_at), batch.column("k2").take(rows_at), pa.array(signed(value)),
                         pa.array(np.frombuffer(digest, dtype=np.int64)), pa.array(at.astype(np.int64)), pa.array(count.astype(np.int32))],
                        ["k1", "k2", "anchor", "digest", "start", "windows"],
                    )

    return rows.select("k1", "k2", "text").filter(F.octet_length("text") >= length).mapInArrow(
        run, "k1 bigint, k2 bigint, anchor bigint, digest bigint, start bigint, windows int"
    )


def repeated_spans(rows: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(k1, k2, lo, hi): byte ranges that cover every repeated window; they may overlap."""
    all_pieces = cut_lineage(pieces(rows, length, gram))
    counted = all_pieces.groupBy("anchor").agg(F.count("*").alias("n"), F.min("digest").alias("a"), F.max("digest").alias("b"))
    repeated = cut_lineage(counted.filter("n > 1").select("anchor", (F.col("a") != F.col("b")).alias("mixed")))
    found = cut_lineage(all_pieces.join(repeated, "anchor"))
    mixed = found.filter("mixed")
    kinds = cut_lineage(mixed.groupBy("anchor", "digest").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "start", "windows")).alias("one")))
    plain = found.filter("not mixed").select("k1", "k2", "start", "windows").unionByName(
        mixed.join(kinds.filter("n > 1").select("anchor", "digest"), ["anchor", "digest"]).select("k1", "k2", "start", "windows")
    )
    whole = plain.select("k1", "k2", F.col("start").alias("lo"), (F.col("start") + F.col("windows") + F.lit(length - 1)).alias("hi"))
    return whole.unionByName(_partly_repeated(rows, kinds, length))


def _partly_repeated(rows: DataFrame, kinds: DataFrame, length: int) -> DataFrame:
    """Spans of repeated windows in pieces that share only their anchor: (k1, k2, lo, hi)."""
    per_anchor = cut_lineage(kinds.groupBy("anchor").agg(F.count("*").alias("m"), F.sum("one.windows").alias("w")))
    totals = per_anchor.agg(F.sum(F.col("m") * length + F.col("w")), F.sum(F.when(F.col("m") > PIECES_A_SHARD, F.col("w")))).first()
    shards = max(1, int(totals[0] or 0) // SHARD_BYTES)
    ranges = max(1, int(totals[1] or 0) // MERGE_WINDOWS)
    ways = F.ceil(F.col("m") / F.lit(PIECES_A_SHARD))
    dealt = kinds.join(per_anchor.select("anchor", "m"), "anchor").select(
        "one.*", "anchor", (ways > 1).alias("split"),
        F.when(ways > 1, F.xxhash64("anchor", F.pmod("digest", ways))).otherwise(F.pmod(F.xxhash64("anchor"), F.lit(shards))).alias("shard"),
    )
    # a row's places, to be cut out of its text; their number is in proportion to the text
    wanted = cut_lineage(dealt.groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "windows", "anchor", "split", "shard")).alias("cuts")))
    texts, _ = maybe_in(rows.select("k1", "k2", "text"), wanted, ("k1", "k2"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, (text, cuts) in enumerate(zip(batch.column("text"), batch.column("cuts"))):
                data = text.as_py().encode("utf-8", "replace")
                c = {name: cuts.values.field(name) for name in ("start", "windows", "anchor", "split", "shard")}
                parts = [data[a : a + n + length - 1] for a, n in zip(c["start"].to_pylist(), c["windows"].to_pylist())]
                own = pa.array(np.full(len(parts), at))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("k1").take(own), batch.column("k2").take(own), c["start"], c["anchor"], c["split"], c["shard"], pa.array(parts, pa.binary())],
                    ["k1", "k2", "start", "anchor", "split", "shard", "piece"],
                )

    cut_out = texts.join(wanted, ["k1", "k2"]).select("k1", "k2", "text", "cuts").mapInArrow(
        cut, "k1 bigint, k2 bigint, start bigint, anchor bigint, split boolean, shard bigint, piece binary"
    )

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        return _search_shard(pdf, length, ranges)

    out = cut_lineage(cut_out.groupBy("shard").applyInPandas(
        search, "k1 bigint, k2 bigint, lo bigint, hi bigint, part int, keys array<bigint>, k1s array<bigint>, k2s array<bigint>, los array<bigint>"
    ))

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        held = [np.asarray(k, dtype=np.int64) for k in pdf["keys"]]
        all_keys = np.sort(np.concatenate(held))
        found = []
        for keys, k1s, k2s, los in zip(held, pdf["k1s"], pdf["k2s"], pdf["los"]):
            twice = np.searchsorted(all_keys, keys, side="right") - np.searchsorted(all_keys, keys) > 1
            found.append(pd.DataFrame({"k1": np.asarray(k1s)[twice], "k2": np.asarray(k2s)[twice], "lo": np.asarray(los)[twice]}))
        marked = pd.concat(found, ignore_index=True)
        return marked.assign(hi=marked["lo"] + length)

    in_shards = out.filter("part is null").select("k1", "k2", "lo", "hi")
    across = out.filter("part is not null").groupBy("part").applyInPandas(merge, "k1 bigint, k2 bigint, lo bigint, hi bigint")
    return in_shards.unionByName(across)


def _search_shard(pdf: pd.DataFrame, length: int, ranges: int) -> pd.DataFrame:
    """Spans of the repeated windows of a shard and, of an anchor dealt over shards, its window classes by key range.

    A class goes on with the key of its bytes and one of its places; the keys are sorted and cut at common borders.
    """
    pieces_ = pdf["piece"].tolist()
    piece, offset, group = window_classes(pieces_, length)
    k1, k2, start = (pdf[c].to_numpy(dtype=np.int64) for c in ("k1", "k2", "start"))
    head = np.ones(len(group), dtype=bool)
    head[1:] = group[1:] != group[:-1]
    first = np.flatnonzero(head)
    size = np.diff(np.append(first, len(group)))
    many = np.repeat(size > 1, size)
    order = np.lexsort((offset[many], piece[many]))
    p, o = piece[many][order], offset[many][order]
    new = np.ones(len(p), dtype=bool)
    new[1:] = (p[1:] != p[:-1]) | (o[1:] != o[:-1] + 1)
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(p))[: len(at)] - 1
    blank = {c: None for c in ("keys", "k1s", "k2s", "los")}
    out = pd.DataFrame({"k1": k1[p[at]], "k2": k2[p[at]], "lo": start[p[at]] + o[at], "hi": start[p[at]] + o[last] + length, "part": None, **blank})
    out = out.astype({"k1": "Int64", "k2": "Int64", "lo": "Int64", "hi": "Int64", "part": "Int32"})  # whole numbers also where null
    if not pdf["split"].iloc[0]:
        return out
    named = b"".join(hashlib.md5(pieces_[i][x : x + length]).digest()[:8] for i, x in zip(piece[first].tolist(), offset[first].tolist()))
    keys = np.frombuffer(named, dtype=np.int64)
    by = np.argsort(keys)
    keys, holder, place = keys[by], piece[first][by], (start[piece[first]] + offset[first])[by]
    borders = ((np.arange(1, ranges, dtype=np.float64) / ranges - 0.5) * 2.0**64).astype(np.int64)
    bounds = [0, *np.searchsorted(keys, borders).tolist(), len(keys)]
    rows = [
        {"part": r, "keys": keys[a:b], "k1s": k1[holder[a:b]], "k2s": k2[holder[a:b]], "los": place[a:b]}
        for r, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])) if b > a
    ]
    return pd.concat([out, pd.DataFrame(rows).astype({"part": "Int32"})], ignore_index=True)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, spans, kept, kept_sha256), a row per row of ``docs``.

    ``kept`` has the remaining bytes and ``spans`` the maximal removed runs as (start, end).
    """
    rows = _rows(docs, id_col, text_col)
    spans = repeated_spans(rows, length, gram).groupBy("k1", "k2").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    spans = cut_lineage(spans)
    touched, clean = maybe_in(rows, spans, ("k1", "k2"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            merged, removed, kept = [], [], []
            for text, own in zip(batch.column("text"), batch.column("spans")):
                data = text.as_py().encode("utf-8", "replace")
                runs = _union(own.values.field("lo").to_numpy(), own.values.field("hi").to_numpy()) if own.is_valid else []
                merged.append([{"start": a, "end": b} for a, b in runs])
                removed.append(sum(b - a for a, b in runs))
                edges = [0, *(x for run_ in runs for x in run_), len(data)]
                kept.append(b"".join(data[a:b] for a, b in zip(edges[0::2], edges[1::2])))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(removed, pa.int64()), pa.array(merged, kind), pa.array(kept, pa.binary())], ["doc_id", "n_removed", "spans", "kept"]
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    less = touched.join(spans, ["k1", "k2"], "left").select("doc_id", "text", "spans").mapInArrow(
        run, f"doc_id {kind}, n_removed bigint, spans array<struct<start:bigint,end:bigint>>, kept binary"
    )
    same = clean.select(
        "doc_id", F.lit(0).cast("long").alias("n_removed"), F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)").alias("spans"),
        F.col("text").cast("binary").alias("kept"),
    )
    both = less.unionByName(same)
    return both.select(
        "doc_id", (F.octet_length("kept") + F.col("n_removed")).cast("long").alias("n_bytes"), "n_removed", F.size("spans").cast("long").alias("n_spans"),
        "spans", "kept", F.sha2("kept", 256).alias("kept_sha256"),
    )


def _union(lo: np.ndarray, hi: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of the bytes that some ranges cover."""
    order = np.argsort(lo, kind="stable")
    lo, reach = lo[order], np.maximum.accumulate(hi[order])
    first = np.flatnonzero(np.append(True, lo[1:] > reach[:-1]))
    return list(zip(lo[first].tolist(), reach[np.append(first[1:], len(lo)) - 1].tolist()))
