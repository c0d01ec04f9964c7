"""Encoding and decoding with the pieces of a SentencePiece model, by shared-prefix Viterbi.

White space is marked as in the model's own texts: a mark before the text and one for each space. The
marked text falls into words where no piece can cross: before a run of marks and around characters that
no piece contains. The distinct words of a block of texts are sorted, which lays them out as a trie, and
walked depth first: the forward state of a prefix is kept on a stack and shared by all words that start
with it. Every text is then put together from the pieces of its words.

The forward score depends on the kind of model. Of a unigram model it is the highest sum of piece scores;
of equal sums the one whose last piece starts first wins. Of a merge (BPE) model a step from one piece to
the next scores 0 where the two stay apart when their joint text is merged by rank, else minus infinity:
a segmentation is what the merges give just when all its neighbours stay apart, so exactly one path is
left, and the ids equal those of the merges.

Characters that no piece covers, and the mark itself where a text contains it, become byte pieces, so
decoding gives back every text exactly.

Defined results: null encodes to null and decodes to null; the empty text has no pieces. Very long texts
are encoded whole. Extra columns are ignored. The vocabulary is read on the driver from a path that is a
parameter; its size is the model's and does not grow with the data.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxtally.llm.text import blocks

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Bytes of text whose distinct words are sorted at a time.
BLOCK = 1 << 20
#: Words, and pairs of pieces, that a worker remembers from block to block; beyond, it works others out again.
REMEMBERED = 200_000


def pack(ids: list[int]) -> bytes:
    return array("i", ids).tobytes()


class Codec:
    """Pieces, scores and byte pieces of a model; ``merges`` tells a merge model from a unigram model."""

    def __init__(self, pieces: Sequence[str], scores: Sequence[float], byte_ids: Sequence[int], usable: Sequence[bool], merges: bool):
        self.byte_ids = list(byte_ids)
        self.merges = merges
        self.pieces = list(pieces)
        self.piece_bytes = [p.replace(MARK, " ").encode() if ok else b"" for p, ok in zip(pieces, usable)]
        for value, i in enumerate(self.byte_ids):
            self.piece_bytes[i] = bytes([value])
        self.own = {p: (scores[i], i) for i, (p, ok) in enumerate(zip(pieces, usable)) if ok}
        if any(MARK in p.lstrip(MARK) for p in self.own):
            raise ValueError("a piece crosses words")
        self.unknown = min(score for score, _ in self.own.values()) - 10.0
        self.split = {piece: self._last_merge(piece) for piece in self.own} if merges else {}
        self.root: dict = {}
        for piece, end in self.own.items():
            node = self.root
            for c in piece:
                node = node.setdefault(c, {})
            if not merges or self.split[piece] is not None:
                node[""] = end
        apart = re.escape("".join(c for c in map(chr, range(128)) if not any(c in p for p in self.own)))
        self.word = re.compile(f"{MARK}*[^{MARK}{apart}]+|{MARK}+" + (f"|[{apart}]" if apart else ""))
        self.known: dict[str, bytes] = {}
        #: By the ids of two pieces in one number, left times ``many`` and right.
        self.stay: dict[int, bool] = {}
        self.many = len(self.pieces)

    @classmethod
    def load(cls, path: str = MODEL) -> "Codec":
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        usable = [not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)) for i in range(n)]
        byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if not all(sp.is_byte(i) for i in byte_ids):
            raise ValueError("the model has no byte pieces")
        # of a merge model the scores are whole ranks, of a unigram model logarithms
        scores = [sp.get_score(i) for i in range(n)]
        merges = all(x == int(x) for x in scores)
        return cls([sp.id_to_piece(i) for i in range(n)], scores, byte_ids, usable, merges)

    def words(self, text: str) -> list[str]:
        """Marked words in order. A mark that the text contains stands alone, as an empty word."""
        if not text:
            return []
        found: list[str] = []
        for k, part in enumerate(text.split(MARK)):
            if k:
                found.append("")
            found += self.word.findall((MARK if k == 0 else "") + part.replace(" ", MARK))
        return found

    def _merged(self, text: str) -> tuple[list[str], tuple[str, str]]:
        """The pieces that merging by score makes of a text, and the two parts of the last merge."""
        parts, last = list(text), ("", "")
        while len(parts) > 1:
            scored = [self.own.get(a + b, (-np.inf,))[0] for a, b in zip(parts, parts[1:])]
            top = max(scored)
            if top == -np.inf:
                break
            at = scored.index(top)
            last = (parts[at], parts[at + 1])
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts, last

    def _last_merge(self, piece: str) -> tuple[str, str] | None:
        """The two parts of the last merge that makes a piece, empty for one character; None if the merges don't make it."""
        parts, last = self._merged(piece)
        return last if parts == [piece] else None

    def _edge(self, piece: str, side: int) -> list[tuple[str, float]]:
        """The parts that touch one side of a piece, from its outermost character to the whole, with their scores."""
        found = []
        while piece:
            found.append((piece, self.own.get(piece, (-np.inf,))[0]))
            piece = self.split[piece][side] if len(piece) > 1 else ""
        return found[::-1]

    def stay_apart(self, left: int, right: int) -> bool:
        """Whether the merges of two pieces' joint text end in these two pieces; ``left`` is -1 for none.

        Merges are taken by score and a part is nearly always merged before what it is a part of. Then the
        border is crossed just when, growing both sides along their edges by score, the two parts at the
        border have a joint piece of a better score than the next step of either side; of equals the left
        goes first. For the few pieces with a later part all merges are made.
        """
        if left < 0:
            return True
        own = self.own
        a, b = self._edge(self.pieces[left], 1), self._edge(self.pieces[right], 0)
        if any(x[1] <= y[1] for edge in (a, b) for x, y in zip(edge[1:], edge[2:])):
            return self._merged(self.pieces[left] + self.pieces[right])[0] == [self.pieces[left], self.pieces[right]]
        i = j = 0
        while True:
            cross = own.get(a[i][0] + b[j][0])
            next_a = a[i + 1][1] if i + 1 < len(a) else -np.inf
            next_b = b[j + 1][1] if j + 1 < len(b) else -np.inf
            if cross is not None and cross[0] > next_a and cross[0] >= next_b:
                return False
            if next_a == next_b == -np.inf:
                return True
            if next_a >= next_b:
                i += 1
            else:
                j += 1

    def segment(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """Piece ids (32-bit integers) of every word of a sorted list of distinct words, depth first along shared prefixes.

        On the stack, by depth: the forward score, the start and the id of the last piece (-1: no piece
        covers the character), and the places in the piece trie that are still open with their starts.
        """
        root, unknown, merges, stay, many = self.root, self.unknown, self.merges, self.stay, self.many
        best, start, ids, live = [0.0], [0], [-1], [[]]
        before = ""
        for word in words:
            depth = 0
            for a, b in zip(before, word):
                if a != b:
                    break
                depth += 1
            del best[depth + 1 :], start[depth + 1 :], ids[depth + 1 :], live[depth + 1 :]
            for d in range(depth, len(word)):
                c = word[d]
                going = []
                for begin, node in live[d]:
                    node = node.get(c)
                    if node is not None:
                        going.append((begin, node))
                node = root.get(c)
                if node is not None:
                    going.append((d, node))
                top, at, piece = -1e30, d, -1
                for begin, node in going:
                    end = node.get("")
                    if end is None:
                        continue
                    if merges:
                        pair = ids[begin] * many + end[1]
                        apart = stay.get(pair)
                        if apart is None:
                            apart = stay[pair] = self.stay_apart(ids[begin], end[1])
                        if apart:
                            top, at, piece = 0.0, begin, end[1]
                            break
                    elif best[begin] + end[0] > top:
                        top, at, piece = best[begin] + end[0], begin, end[1]
                if not merges and "" not in (node or {}) and best[d] + unknown > top:
                    top, at, piece = best[d] + unknown, d, -1
                best.append(top)
                start.append(at)
                ids.append(piece)
                live.append(going)
            before = word
            path: list[int] = []
            d = len(word)
            while d:
                if ids[d] >= 0:
                    path.append(ids[d])
                else:
                    path.extend(self.byte_ids[b] for b in reversed(word[start[d] : d].encode("utf-8", "replace")))
                d = start[d]
            path.reverse()
            yield word, pack(path)

    def encode(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all texts and the offsets of each text's ids."""
        values, sizes = [], np.zeros(len(texts) + 1, dtype=np.int64)
        found = [self.words(t or "") for t in texts]
        distinct = set(chain.from_iterable(found))
        if len(self.known) > REMEMBERED:
            self.known = {w: self.known[w] for w in distinct if w in self.known}
        if len(self.stay) > REMEMBERED:
            self.stay.clear()
        self.known[""] = pack([self.byte_ids[b] for b in MARK.encode()])
        self.known.update(self.segment(sorted(distinct.difference(self.known))))
        get = self.known.__getitem__
        for k, own in enumerate(found):
            ids = np.frombuffer(b"".join(map(get, own)), dtype=np.int32)
            values.append(ids)
            sizes[k + 1] = len(ids)
        return (np.concatenate(values) if values else np.zeros(0, dtype=np.int32)), np.cumsum(sizes)

    def decode(self, ids: Sequence[int]) -> str:
        """The text of piece ids; the space of the leading mark goes."""
        data = b"".join(map(self.piece_bytes.__getitem__, ids))
        return data[1:].decode("utf-8", "replace") if data[:1] == b" " else data.decode("utf-8", "replace")


def _encoded(codec: Codec, texts: list) -> tuple[pa.Array, pa.Array]:
    """Numbers of pieces and lists of piece ids of some texts."""
    values, offsets = codec.encode(texts)
    null = [t is None for t in texts]
    lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values), mask=pa.array(null))
    return pa.array(np.diff(offsets), mask=np.array(null, dtype=bool)), lists


def encode(df: DataFrame, codec: Codec, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_pieces, piece_ids): one pass without a shuffle; words are shared within a worker."""
    shared = df.sparkSession.sparkContext.broadcast(codec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            for i, j in blocks(column, BLOCK):
                count, lists = _encoded(shared.value, column.slice(i, j - i).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), count, lists], ["doc_id", "n_pieces", "piece_ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_pieces bigint, piece_ids array<int>"
    )


def decode(df: DataFrame, codec: Codec, id_col: str = "doc_id", ids_col: str = "piece_ids") -> DataFrame:
    """(doc_id, text) from piece ids."""
    shared = df.sparkSession.sparkContext.broadcast(codec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("piece_ids")
            texts = (shared.value.decode(x.values.to_numpy().tolist()) if x.is_valid else None for x in column)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("piece_ids")).mapInArrow(run, f"doc_id {kind}, text string")


def encode_and_check(df: DataFrame, codec: Codec, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_pieces, piece_ids, text_sha256, exact): pieces, digest of the decoded text, whether it is the text.

    Both ways run in one worker, so the text is sent to it once and the comparison needs no join.
    """
    shared = df.sparkSession.sparkContext.broadcast(codec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            for i, j in blocks(column, BLOCK):
                texts = column.slice(i, j - i).to_pylist()
                count, lists = _encoded(shared.value, texts)
                back = [shared.value.decode(x.values.to_numpy().tolist()) if x.is_valid else None for x in lists]
                digest = [None if t is None else hashlib.sha256(t.encode("utf-8", "replace")).hexdigest() for t in back]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), count, lists, pa.array(digest, pa.string()), pa.array([a == b for a, b in zip(texts, back)])],
                    ["doc_id", "n_pieces", "piece_ids", "text_sha256", "exact"],
                )

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_pieces bigint, piece_ids array<int>, text_sha256 string, exact boolean"
    )
