"""Language identification with spans of mixed-language text.

Words are runs of letters. The script of a word, read from ranges of code points, narrows the languages
to those trained in that script. Each word gets a log probability per language from its character pairs
and triples, and a Viterbi pass over the words of a document with a penalty for each switch labels spans.
The language with most letters names the document; its share of the letters is the score.

The model is counted over all training rows: a fixed number of hashed n-gram buckets per language, so
its size does not grow with the corpus. Prediction is one pass over the documents without a shuffle.

Defined results: a text that is null or has no letter is ``und`` with score 0 and no spans; so is
every text when nothing was learned. A text with letters of no learned script gets the most frequent
learned language with score 0. Equal sums go to the language first by name. Extra columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxtally.llm.text import blocks, chunks

BUCKETS = 1 << 16
SWITCH_PENALTY = 8.0
#: A language is a candidate in a script that holds this share of its training words.
SCRIPT_SHARE = 0.005
#: Characters that are split into words at a time, and bytes of text that a task holds as Python's strings.
PIECE, BLOCK = 1 << 18, 1 << 22
#: Numbers in the score table that one Viterbi pass holds.
PASS_CELLS = 4_000_000
#: First code points of script blocks and the script from there on.
SCRIPT_STARTS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0700, "Other"), (0x0750, "Arabic"), (0x0780, "Other"), (0x0900, "Devanagari"), (0x0980, "Bengali"),
    (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Odia"), (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"),
    (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"),
    (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Other"), (0x1780, "Khmer"), (0x1800, "Other"),
    (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"), (0x2C60, "Latin"), (0x2C80, "Other"), (0x3040, "Kana"),
    (0x3100, "Other"), (0x3130, "Hangul"), (0x3190, "Other"), (0x3400, "Han"), (0xA000, "Other"), (0xA720, "Latin"),
    (0xA800, "Other"), (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB1D, "Hebrew"),
    (0xFB50, "Arabic"), (0xFE00, "Other"), (0xFF21, "Latin"), (0xFF66, "Kana"), (0xFFA0, "Hangul"), (0xFFE0, "Other"),
    (0x20000, "Han"), (0x323B0, "Other"),
]
SCRIPTS = sorted({name for _, name in SCRIPT_STARTS})
_START = np.array([at for at, _ in SCRIPT_STARTS])
_SCRIPT = np.array([SCRIPTS.index(name) for _, name in SCRIPT_STARTS])


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point its single lower-case form if it is a letter or a mark, else 0."""
    table = np.zeros(0x110000, dtype=np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha() or unicodedata.category(c) in ("Mn", "Mc"):
            low = c.lower()
            table[i] = ord(low) if len(low) == 1 else i
    return table


@lru_cache(maxsize=1)
def _alphabetic() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


@dataclass
class Words:
    """Words of some texts: place, length and script of each, and the n-gram buckets of all letters."""

    start: np.ndarray
    end: np.ndarray
    script: np.ndarray
    text: np.ndarray
    base: np.ndarray
    pair: np.ndarray
    triple: np.ndarray
    first: np.ndarray


def split_words(texts: Sequence[str | None]) -> Words:
    """``start`` and ``end`` are code points in the joined texts, of which text i begins at ``base[i]``. Marks without a letter are no word."""
    joined = "\n".join(t or "" for t in texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "replace"), dtype=np.uint32)
    low = _letters()[points]
    edge = np.flatnonzero(np.diff((low > 0).astype(np.int8), prepend=np.int8(0)))
    start, end = edge[0::2], edge[1::2]
    if len(start):
        spelt = np.logical_or.reduceat(_alphabetic()[points], edge)[0::2]
        start, end = start[spelt], end[spelt]
    base = np.zeros(len(texts), dtype=np.int64)
    np.cumsum([len(t or "") + 1 for t in texts[:-1]], out=base[1:])
    # every letter of a word and the place behind it end a pair; a triple needs two places before it in the word
    size = end - start + 1
    first = np.cumsum(size) - size
    at = np.repeat(start - first, size) + np.arange(int(size.sum()))
    one = low[at].astype(np.uint64)
    two = np.where(at > 0, low[at - 1], 0).astype(np.uint64)
    begins = np.zeros(len(at), dtype=bool)
    begins[first] = True
    three = np.where(two > 0, low[np.maximum(at - 2, 0)], 0).astype(np.uint64)
    two[begins] = 0
    three[begins] = 0
    with np.errstate(over="ignore"):
        pair = (two * np.uint64(0x9E3779B97F4A7C15) + one * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(1)) >> np.uint64(48)
        triple = (
            three * np.uint64(0x165667B19E3779F9) + two * np.uint64(0x9E3779B97F4A7C15) + one * np.uint64(0xC2B2AE3D27D4EB4F)
        ) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(48)
    script = _SCRIPT[np.searchsorted(_START, low[start], side="right") - 1]
    text = np.searchsorted(base, start, side="right") - 1
    return Words(start, end, script, text, base, pair.astype(np.int64), triple.astype(np.int64), first)


@dataclass
class Model:
    """Learned languages in order of name, log probabilities per bucket, scripts of each and their frequency."""

    languages: list[str]
    log_p: np.ndarray
    in_script: np.ndarray
    weight: np.ndarray


def fit(training: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Counts n-grams over all rows with a language; the sums are combined in Spark.

    What reaches the driver is one number per language and bucket, and per language and script.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for i, j in blocks(batch.column("text"), BLOCK):
                named: dict[str, list[str]] = {}
                for lang, text in zip(*(batch.column(n).slice(i, j - i).to_pylist() for n in ("lang", "text"))):
                    named.setdefault(lang, []).append(text)
                for lang, texts in named.items():
                    held = total.setdefault(lang, np.zeros(BUCKETS + len(SCRIPTS), dtype=np.int64))
                    for k, m in chunks(texts, PIECE):
                        w = split_words(texts[k:m])
                        held[:BUCKETS] += np.bincount(w.pair, minlength=BUCKETS) + np.bincount(w.triple, minlength=BUCKETS)
                        held[BUCKETS:] += np.bincount(w.script, minlength=len(SCRIPTS))
        for lang, held in total.items():
            at = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(held[at])], ["lang", "bucket", "n"])

    rows = training.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).filter("lang is not null and text is not null")
    counts = rows.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = counts.toPandas()
    languages = sorted(got["lang"].unique())
    table = np.zeros((BUCKETS + len(SCRIPTS), len(languages)))
    table[got["bucket"].to_numpy(dtype=np.int64), got["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(dtype=np.int64)] = got["n"]
    grams, scripts = table[:BUCKETS], table[BUCKETS:]
    log_p = np.log(grams + 0.5) - np.log(grams.sum(axis=0) + 0.5 * BUCKETS)
    in_script = scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(axis=0), 1)
    return Model(languages, log_p.astype(np.float32), in_script, scripts.sum(axis=0))


def word_scores(model: Model, w: Words) -> np.ndarray:
    """Log posterior of every language for every word; 0 throughout where no language is a candidate."""
    if not len(w.start):
        return np.zeros((0, len(model.languages)), dtype=np.float32)
    s = np.add.reduceat(model.log_p[w.pair] + model.log_p[w.triple], w.first, axis=0)
    allowed = model.in_script[w.script]
    s = np.where(allowed, s, -np.inf)
    some = allowed.any(axis=1)
    s[~some] = 0
    top = s.max(axis=1, keepdims=True)
    s = s - top - np.log(np.exp(s - top).sum(axis=1, keepdims=True))
    s[~some] = 0
    return np.maximum(s, -30).astype(np.float32)


def best_path(scores: np.ndarray, offsets: np.ndarray, penalty: float) -> np.ndarray:
    """Viterbi labels of the words of many texts, all texts one word further at a time."""
    label = np.zeros(len(scores), dtype=np.int16)
    length = np.diff(offsets)
    order = np.argsort(-length, kind="stable")
    begin, steps = offsets[:-1][order], length[order]
    deep = int(steps[0]) if len(steps) else 0
    live = np.searchsorted(-steps, -np.arange(deep), side="left")  # texts with a word at each step
    back = np.zeros(scores.shape, dtype=np.int16)
    own = np.arange(scores.shape[1], dtype=np.int16)
    value = np.zeros((len(steps), scores.shape[1]), dtype=np.float32)
    for t in range(deep):
        n = live[t]
        at = begin[:n] + t
        v = value[:n]
        if t:
            best = v.argmax(axis=1)
            jump = np.take_along_axis(v, best[:, None], axis=1) - penalty
            back[at] = np.where(v >= jump, own, best[:, None])
            np.maximum(v, jump, out=v)
        v += scores[at]
    now = value.argmax(axis=1).astype(np.int16)
    for t in range(deep - 1, -1, -1):
        n = live[t]
        at = begin[:n] + t
        label[at] = now[:n]
        now[:n] = back[at, now[:n]]
    return label


def label_texts(model: Model, texts: Sequence[str | None], penalty: float = SWITCH_PENALTY) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
    """(language, score, spans) of each text; a span is (first code point, end, language)."""
    out: list[tuple[str, float, list]] = [("und", 0.0, [])] * len(texts)
    if not model.languages:
        return out
    size = np.array([len(t or "") for t in texts])
    order = np.argsort(-size, kind="stable")
    most = max(PASS_CELLS // len(model.languages), 1) * 5
    ranked = [texts[i] for i in order]
    for i, j in chunks(ranked, most):
        parts = []
        for a, b in chunks(ranked[i:j], PIECE):
            w = split_words(ranked[a + i : b + i])
            known = model.in_script[w.script].any(axis=1)
            parts.append((word_scores(model, w), w.text + a, w.start - w.base[w.text], w.end - w.base[w.text], known))
        scores, text, start, end, counted = (np.concatenate(x) for x in zip(*parts))
        offsets = np.searchsorted(text, np.arange(j - i + 1))
        label = best_path(scores, offsets, penalty)
        letters = np.zeros((j - i, len(model.languages)))
        np.add.at(letters, (text[counted], label[counted]), (end - start)[counted])
        total = np.bincount(text, weights=end - start, minlength=j - i)
        cut = np.ones(len(label), dtype=bool)
        cut[1:] = (label[1:] != label[:-1]) | (text[1:] != text[:-1])
        cuts = np.append(np.flatnonzero(cut), len(label))
        spans: list[list[tuple[int, int, str]]] = [[] for _ in range(j - i)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            spans[text[a]].append((int(start[a]), int(end[b - 1]), model.languages[label[a]]))
        for k in range(j - i):
            if total[k]:
                known = letters[k].any()
                main = int((letters[k] if known else model.weight).argmax())
                out[order[i + k]] = (model.languages[main], float(letters[k][main] / total[k]), spans[k])
    return out


def identify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", penalty: float = SWITCH_PENALTY) -> DataFrame:
    """(doc_id, lang_pred, score, spans): one pass over the documents, each task with the broadcast model.

    The model has a fixed number of buckets per language, which bounds the broadcast.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            got = [g for i, j in blocks(column, BLOCK) for g in label_texts(shared.value, column.slice(i, j - i).to_pylist(), penalty)]
            named = [[dict(zip(("start", "end", "lang"), x)) for x in g[2]] for g in got]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array(named, span)],
                ["doc_id", "lang_pred", "score", "spans"],
            )

    kind = df.schema[id_col].dataType.simpleString()
    ddl = f"doc_id {kind}, lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>"
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(label, ddl)


def predicted(df: DataFrame, model: Model, text_col: str = "text", penalty: float = SWITCH_PENALTY) -> Column:
    """(lang_pred, score) of each row of ``df`` as a column; only the text goes to Python and back come two values."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double")
    def label(texts: pa.Array) -> pa.Array:
        got = [g[:2] for i, j in blocks(texts, BLOCK) for g in label_texts(shared.value, texts.slice(i, j - i).to_pylist(), penalty)]
        return pa.StructArray.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["lang_pred", "score"])

    return label(df[text_col])


def fold(doc_id: Column) -> Column:
    """Fold 0 to 3 of a document, from its id alone."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def identify_held_out(df: DataFrame) -> DataFrame:
    """Learns from folds 0, 1 and 3 and labels all rows: (doc_id, held_out, lang_pred, score, n_spans)."""
    model = fit(df.filter(F.coalesce(fold(F.col("doc_id")) != 2, F.lit(False))))
    out = identify(df, model)
    held = F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))
