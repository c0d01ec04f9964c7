"""Benchmark decontamination: which documents hold which short test items.

A document is contaminated by an item when at least 0.8 of the item's distinct five-word shingles occur
in the whole document, wherever they stand. The Jaccard similarity of a short item and a long document is
close to 0, so bands of two-sided signatures would miss them. Here the items are partitioned by size, and
each size has its own signature: the shingles with the smallest hashes (bottom-k MinHash) and the number
of them that a document must hold. That number is the largest for which a document at the threshold is
missed with a probability below ``MISS``; items of up to ``SIGNATURE`` shingles are their own signature and
never missed. Documents too small for a size are passed over. Candidates are verified word by word.

Documents are read once per block of items, without a shuffle; a block's signatures have a bounded size
and are broadcast. Only the texts of candidates travel.

Defined results: null or empty documents and items match nothing; texts of one to four words have one
shingle of all their words. With ``within`` an item of one to four words is also found as a run of its words
anywhere in a document; without, only in a document of just those words. Repeated rows and ids give a result row each. Empty tables give no rows.
Extra columns are ignored. Ties cannot occur.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxtally.llm.text import by_text, chunks, runs_of, spelt_words, words
from boxtally.session import cut_lineage

WORDS = 5
LEAST = 0.8
SIGNATURE = 24
MISS = 1e-9
#: Signature hashes of one block of items, which bounds what is broadcast to about 16 MB.
BLOCK_HASHES = 1_000_000


def hits_needed(n: int, k: int = SIGNATURE, least: float = LEAST, miss: float = MISS) -> int:
    """Of the k smallest of n hashes, how many a document with a share ``least`` of the n holds but for a chance of ``miss``."""
    k = min(k, n)
    held = math.ceil(least * n - 1e-9)
    total, below, need = math.comb(n, k), 0, 0
    for h in range(k + 1):
        below += math.comb(held, h) * math.comb(n - held, k - h)
        if below > miss * total:
            need = h
            break
    return max(need, 1)


@dataclass
class Block:
    """Signatures of some items: sorted hashes, the items of each hash, and per item what is needed."""

    hashes: np.ndarray
    first: np.ndarray
    item: np.ndarray
    needed: np.ndarray
    least_size: np.ndarray
    ids: list
    short: list


def _block(rows: list, k: int, least: float, within: bool = False) -> Block:
    own, places = words([r["text"] for r in rows])
    value, offsets = runs_of(own, places, WORDS)
    owner, h, _ = by_text(value, offsets)
    size = np.bincount(owner, minlength=len(rows))
    rank = np.arange(len(h)) - np.repeat(np.cumsum(size) - size, size)
    signed = rank < k
    order = np.argsort(h[signed], kind="stable")
    hashes, first = np.unique(h[signed][order], return_index=True)
    by_size = {int(n): hits_needed(int(n), k, least) for n in np.unique(size) if n}
    return Block(
        hashes, np.append(first, signed.sum()), owner[signed][order], np.array([by_size.get(int(n), 1) for n in size]),
        np.ceil(least * size - 1e-9), [r["item_id"] for r in rows],
        [int(n) for n in np.unique(np.diff(places)) if within and 0 < n < WORDS],
    )


def _candidates(block: Block, texts: list) -> tuple[np.ndarray, np.ndarray]:
    """(text number, item number) of the pairs that share enough of the item's signature."""
    own, places = words(texts)
    if not len(own) or not len(block.hashes):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    pairs = []
    for size in [*block.short, WORDS]:
        value, offsets = runs_of(own, places, size)
        at = np.searchsorted(block.hashes, value)
        at[at == len(block.hashes)] = 0
        hit = np.flatnonzero(block.hashes[at] == value)
        pairs.append(np.unique(np.stack([np.searchsorted(offsets, hit, side="right") - 1, at[hit]]), axis=1))
    text, place = np.unique(np.concatenate(pairs, axis=1), axis=1) if len(pairs) > 1 else pairs[0]
    many = block.first[place + 1] - block.first[place]
    text = np.repeat(text, many)
    item = block.item[np.repeat(block.first[place + 1] - np.cumsum(many), many) + np.arange(many.sum())]
    key, count = np.unique(text * len(block.ids) + item, return_counts=True)
    text, item = key // len(block.ids), key % len(block.ids)
    good = (count >= block.needed[item]) & (np.diff(offsets)[text] >= block.least_size[item])
    return text[good], item[good]


def find_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", least: float = LEAST, k: int = SIGNATURE, within: bool = False) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment), a row per document and item it contains."""
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    bench = items.select(F.col(item_col).alias("item_id"), F.col(item_text).alias("text")).filter("text is not null")
    kinds = [own.schema["doc_id"].dataType.simpleString(), bench.schema["item_id"].dataType.simpleString()]
    id_type = "long" if kinds[1] == "bigint" else kinds[1]
    total = bench.agg(F.sum(F.least(F.char_length("text"), F.lit(k)))).first()[0] or 0
    blocks = max(1, math.ceil(total / BLOCK_HASHES))
    candidates = None
    for b in range(blocks):
        part = bench if blocks == 1 else bench.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        shared = spark.sparkContext.broadcast(_block(part.collect(), k, least, within))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block = shared.value
            for batch in batches:
                column = batch.column("text").to_pylist()
                for i, j in chunks(column):
                    text, item = _candidates(block, column[i:j])
                    if len(text):
                        yield pa.RecordBatch.from_arrays(
                            [batch.column("doc_id").take(pa.array(text + i)), batch.column("text").take(pa.array(text + i)), pa.array([block.ids[x] for x in item])],
                            ["doc_id", "text", "item_id"],
                        )

        found = own.mapInArrow(search, f"doc_id {kinds[0]}, text string, item_id {id_type}")
        candidates = found if candidates is None else candidates.unionByName(found)
    # written, so that no task holds a Python worker that searches and one that verifies at a time
    pairs = cut_lineage(candidates).join(bench.distinct().withColumnRenamed("text", "item_text"), "item_id")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, item in zip(batch.column("text").to_pylist(), batch.column("item_text").to_pylist()):
                wanted = word_shingles(item)
                size = max(map(len, wanted), default=WORDS) if within else WORDS
                rows.append((len(wanted), len(wanted & word_shingles(doc, size))))
            n, shared = (pa.array(x, pa.int64()) for x in zip(*rows)) if rows else (pa.array([], pa.int64()),) * 2
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("item_id"), n, shared], ["doc_id", "item_id", "n_item", "n_shared"])

    checked = pairs.select("doc_id", "item_id", "text", "item_text").mapInArrow(
        verify, f"doc_id {kinds[0]}, item_id {kinds[1]}, n_item bigint, n_shared bigint"
    )
    share = F.col("n_shared") / F.col("n_item")
    return checked.filter(share >= least).select("*", F.round(share, 6).alias("containment"))


def word_shingles(text: str | None, size: int = WORDS) -> set[tuple[str, ...]]:
    """Distinct runs of words of a text, as they are spelt."""
    own = spelt_words(text)
    if 0 < len(own) < size:
        return {tuple(own)}
    return set(zip(*(own[k:] for k in range(size)))) if own else set()


def remove_contaminated(docs: DataFrame, items: DataFrame, within: bool = False) -> DataFrame:
    """The documents that hold no item, with all their columns. Documents without an id stay."""
    return docs.join(find_items(docs, items, within=within).select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)
