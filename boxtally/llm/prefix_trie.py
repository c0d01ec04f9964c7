"""The trie of the beginnings that conversations share.

A turn's id is a number of fixed width in big-endian bytes: the length of its text in bytes, then 128 bits of a
digest of role and text. A conversation is the key of its turns' ids in order, so every beginning of whole turns is a
node, and texts never leave the scan. Copies of a conversation are one key with a count.

Keys are cut into ranges by value, so that a first turn that a third of all conversations share is spread over as
many tasks as its keys need. A task reads its range in blocks of bounded size and builds an adaptive radix tree of
each (``radix_tree``). What lies between the first and the last key of a block is finished there; the nodes on these
two paths may go on in the next block, so they leave as one row a path with what has been counted below them, and
are joined in the next pass, where a block takes in many neighbouring paths. Passes go on until one block holds all.

Which turns a ``rebuilt`` conversation has: its own from turn ``h`` on, after the first ``h`` of another.

Defined results: a null role or text counts as empty. Turns without a number come first; turns with equal numbers
are ordered by their ids. Rows without a conversation id are left out. Repeated rows are turns like any other. An
empty table has no nodes. Extra columns are ignored. The key of one conversation is a value of its row, 20 bytes a
turn; everything else is held in blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxtally.llm.ordering import numbered
from boxtally.llm.radix_tree import RadixTree
from boxtally.session import cut_lineage

LENGTH_BYTES = 4
#: Bytes of a turn's id: the length of the text and a digest of 16 bytes.
WIDTH = LENGTH_BYTES + 16
#: Bytes in a block of keys or paths, and the least number of paths in one: more than the two that a block leaves, so that passes end.
BLOCK_BYTES = 1 << 18
BLOCK_PATHS = 8
#: Bytes that a task reads, in blocks, where the input needs more tasks than a shuffle has.
TASK_BYTES = 256 << 20
#: Bytes of a list of ids that travel as one row.
IDS_BYTES = 1 << 16
#: Rows that leave a task at a time.
OUT_ROWS = 1 << 14

#: What is known of each node from depth ``first`` to the end of the key: conversations, smallest id, children, leaves and saved bytes below those, digest of the ids that end here.
PATHS = "key binary, first int, n array<bigint>, least array<bigint>, children array<bigint>, leaves array<bigint>, saved array<bigint>, ends array<string>"
NODES = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
NOTHING = hashlib.sha256(b"").hexdigest()


def turn_id(role: Column, text: Column) -> Column:
    """The id of a turn in hexadecimal digits. The length of the role tells role and text apart."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    length = F.lpad(F.hex(F.octet_length(text)), 2 * LENGTH_BYTES, "0")
    return F.concat(length, F.upper(F.md5(F.concat_ws(":", F.octet_length(role).cast("string"), role, text).cast("binary"))))


def sequences(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, ids): the ids of each conversation's turns in order."""
    rows = turns.filter(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), turn_id(F.col(role), F.col(text)).alias("id")
    )
    ordered = F.sort_array(F.collect_list(F.struct("turn", "id")))
    return rows.groupBy("conv_id").agg(ordered.alias("t")).select("conv_id", F.col("t.id").alias("ids"))


def rebuilt(own: DataFrame, every: int = 5, span: int = 9) -> DataFrame:
    """(conv_id, ids): the first h turns of conversation c − c % every, then the own turns from turn h on; h = crc32(c) % span."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % span).cast("int")
    left = own.select("conv_id", "ids", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % every).alias("base"))
    right = own.select(F.col("conv_id").alias("base"), F.col("ids").alias("others"))
    begin = F.coalesce(F.slice("others", F.lit(1), F.col("h")), F.array().cast("array<string>"))
    rest = F.slice("ids", F.col("h") + 1, F.greatest(F.size("ids"), F.lit(1)))
    return left.join(right, "base", "left").select("conv_id", F.concat(begin, rest).alias("ids"))


def keys(conversations: DataFrame) -> DataFrame:
    """(conv_id, key): the ids one after the other."""
    return conversations.select("conv_id", F.unhex(F.array_join("ids", "")).alias("key"))


def _sorted_ranges(df: DataFrame, order: Sequence[str], size: int, ranges_by: Sequence[str]) -> DataFrame:
    """``df``, which holds ``size`` bytes, in sorted ranges: a block each as far as a shuffle has tasks, then several."""
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, min(-(-size // BLOCK_BYTES), usual), -(-size // TASK_BYTES))
    return df.repartitionByRange(parts, *ranges_by).sortWithinPartitions(*order)


def listed(by_key: DataFrame, size: int) -> DataFrame:
    """(key, first_id, n, ids): the ids of equal keys in ascending order, as comma-joined lists of bounded size.

    Ranges go by key and id, so copies of one conversation are spread over many tasks.
    """
    schema = pa.schema([("key", pa.binary()), ("first_id", pa.int64()), ("n", pa.int64()), ("ids", pa.string())])

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        key, ids = None, []
        for batch in batches:
            for k, c in zip(batch.column("key"), batch.column("conv_id").to_pylist()):
                k = k.as_py()
                if ids and (k != key or 20 * len(ids) >= IDS_BYTES):
                    yield {"key": key, "first_id": ids[0], "n": len(ids), "ids": ",".join(map(str, ids))}
                    ids = []
                key = k
                ids.append(c)
        if ids:
            yield {"key": key, "first_id": ids[0], "n": len(ids), "ids": ",".join(map(str, ids))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for row in lists(batches):
            rows.append(row)
            held += len(row["key"]) + len(row["ids"])
            if held > BLOCK_BYTES:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    order = ["key", "conv_id"]
    return _sorted_ranges(by_key, order, size, order).mapInArrow(run, "key binary, first_id bigint, n bigint, ids string")


def as_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """One path for each key of the sorted rows of ``listed``; the digest of its ids runs over the lists."""
    key = path = digest = None
    for batch in batches:
        for row in zip(*[batch.column(c) for c in ("key", "first_id", "n", "ids")]):
            k, first, n, ids = (x.as_py() for x in row)
            if k != key:
                if path is not None:
                    path["ends"] = [digest.hexdigest()]
                    yield path
                key, digest = k, hashlib.sha256(ids.encode())
                path = {"key": k, "first": len(k) // WIDTH, "n": [n], "least": [first], "children": [0], "leaves": [0], "saved": [0]}
                continue
            digest.update(b"," + ids.encode())
            path["n"][0] += n
    if path is not None:
        path["ends"] = [digest.hexdigest()]
        yield path


def _one_block(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    held = list(as_paths(batches))
    if held:
        yield held


def _key_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    held, size = [], 0
    for p in as_paths(batches):
        held.append(p)
        size += len(p["key"]) + 100
        if size > BLOCK_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def _path_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows that follow each other with one number of a block."""
    held: list[dict] = []
    for batch in batches:
        for i in range(batch.num_rows):
            p = batch.slice(i, 1).to_pylist()[0]
            if held and held[0]["block"] != p["block"]:
                yield held
                held = []
            held.append(p)
    if held:
        yield held


class _Block:
    """The nodes of some neighbouring paths, in the order of their keys."""

    def __init__(self, paths: list[dict]):
        tree = RadixTree(WIDTH)
        for i, p in enumerate(paths):
            tree.insert(p["key"], i)
        self.parent, self.depth, self.id, end = [], [], [], [0] * len(paths)
        for at, (parent, depth, last, values) in enumerate(tree.aligned()):
            self.parent.append(parent)
            self.depth.append(depth)
            self.id.append(last)
            for i in values:
                end[i] = at
        size = len(self.parent)
        self.n, self.children, self.leaves, self.saved = ([0] * size for _ in range(4))
        self.least: list[int | None] = [None] * size
        self.ends: list[str | None] = [None] * size
        for i, p in enumerate(paths):
            at = end[i]
            for k in range(len(p["n"]) - 1, -1, -1):
                self.n[at] += p["n"][k]
                self.children[at] += p["children"][k]
                self.leaves[at] += p["leaves"][k]
                self.saved[at] += p["saved"][k]
                self._lower(at, p["least"][k])
                self.ends[at] = self.ends[at] or p["ends"][k]
                at = self.parent[at]
        self.open = [False] * size
        self.first, self.last = end[0], size - 1

    def _lower(self, at: int, value: int | None) -> None:
        if value is not None and (self.least[at] is None or value < self.least[at]):
            self.least[at] = value

    def _way(self, at: int) -> list[int]:
        way = []
        while at >= 0:
            way.append(at)
            at = self.parent[at]
        return way[::-1]

    def leave_open(self) -> None:
        """The nodes on the way to the first and to the last key may go on in other blocks."""
        for at in (*self._way(self.first), *self._way(self.last)):
            self.open[at] = True

    def settle(self) -> None:
        """Everything that is known of the finished nodes, each added to its parent."""
        for at in range(len(self.parent) - 1, -1, -1):
            if self.open[at]:
                continue
            if not self.children[at]:
                self.leaves[at] += 1
            self.saved[at] += (self.n[at] - 1) * int.from_bytes(self.id[at][:LENGTH_BYTES], "big")
            up = self.parent[at]
            if up >= 0:
                self.n[up] += self.n[at]
                self.children[up] += 1
                self.leaves[up] += self.leaves[at]
                self.saved[up] += self.saved[at]
                self._lower(up, self.least[at])

    def open_paths(self) -> list[dict]:
        one, other = self._way(self.first), self._way(self.last)
        shared = sum(a == b for a, b in zip(one, other))
        out = []
        for way, skip in ((one, 0), (other, shared)):
            part = way[skip:]
            if part:
                fields = {f: [getattr(self, f)[i] for i in part] for f in ("n", "least", "children", "leaves", "saved", "ends")}
                out.append({"key": b"".join(self.id[i] for i in way), "first": skip, **fields})
        return out

    def prefix_digests(self) -> dict[int, bytes]:
        """A digest of the prefix of every open node, by which children in one block find their parent in another."""
        found: dict[int, bytes] = {}
        running = {-1: hashlib.md5()}
        for at in sorted({*self._way(self.first), *self._way(self.last)}):
            running[at] = running[self.parent[at]].copy()
            running[at].update(self.id[at])
            found[at] = running[at].digest()
        return found


_STEP = f"kind string, {NODES}, own binary, up binary, {PATHS}"
_KINDS = {
    "bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()),
}
_FIELDS = [(c.split()[0], _KINDS[c.split()[1]]) for c in _STEP.split(", ")]
_SCHEMA = pa.schema(_FIELDS)
NODE_COLUMNS = [c.split()[0] for c in NODES.split(", ")]


def _pass(blocks: Iterator[list[dict]], later: bool, top: bool) -> Iterator[pa.RecordBatch]:
    """Finished nodes and open paths of each block; in the top pass the only block leaves nothing open.

    A node whose parent is open says by ``up`` whose child it is; in later passes, whose nodes were open before, a node gives its ``own``.
    """
    for held in blocks:
        block = _Block(held)
        digests = block.prefix_digests() if not top else {}
        if not top:
            block.leave_open()
        block.settle()
        own = _own_digests(block) if later else [None] * len(block.parent)
        rows: list[dict] = []
        for at, up in enumerate(block.parent):
            if block.open[at]:
                continue
            waits = up >= 0 and block.open[up]
            rows.append({
                "kind": "node", "conv_id": block.least[at], "depth": block.depth[at], "parent_conv_id": None if up < 0 or waits else block.least[up],
                "n_convs": block.n[at], "n_children": block.children[at], "n_leaves": block.leaves[at], "saved_tokens": block.saved[at],
                "ends_sha256": block.ends[at] or NOTHING, "own": own[at], "up": digests[up] if waits else None,
            })
            if len(rows) >= OUT_ROWS:
                yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)
                rows = []
        if not top:
            rows += [{"kind": "path", **p} for p in block.open_paths()]
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)


def _own_digests(block: _Block) -> list[bytes]:
    """The digest of every prefix of a block of paths; a state is kept only while it can have children."""
    out, way = [], [hashlib.md5()]
    for depth, last in zip(block.depth, block.id):
        del way[depth:]
        state = way[-1].copy() if way else hashlib.md5()
        state.update(last)
        way.append(state)
        out.append(state.digest())
    return out


def trie(conversations: DataFrame) -> DataFrame:
    """One row a node of the trie of (conv_id, ids): see ``NODES``."""
    by_key = cut_lineage(keys(conversations))
    size = by_key.agg(F.coalesce(F.sum(F.length("key") + 28), F.lit(0))).first()[0]
    lists = cut_lineage(listed(by_key, size))
    top = size <= BLOCK_BYTES
    order = ["key", "first_id"]
    source = lists.coalesce(1).sortWithinPartitions(*order) if top else _sorted_ranges(lists, order, size, ["key"])
    parts, read = [], _one_block if top else _key_blocks
    while True:
        out = cut_lineage(source.mapInArrow(lambda batches, read=read, later=bool(parts), top=top: _pass(read(batches), later, top), _STEP))
        parts.append(out.filter("kind = 'node'").select(*NODE_COLUMNS, "own", "up"))
        if top:
            break
        paths, read = out.filter("kind = 'path'").select(*[c.split()[0] for c in PATHS.split(", ")]), _path_blocks
        size, rows = paths.agg(F.coalesce(F.sum(F.length("key") + 48 * F.size("n")), F.lit(0)), F.count("*")).first()
        top = size <= BLOCK_BYTES or rows <= BLOCK_PATHS
        if top:
            source = paths.withColumn("block", F.lit(0).cast("long")).coalesce(1)
        else:
            # neighbours in the order of the keys share a block, however the rows are dealt out
            many = max(BLOCK_PATHS, BLOCK_BYTES * rows // size)
            source = numbered(paths, [F.col("key")], "place").withColumn("block", F.floor(F.col("place") / many)).repartition("block").sortWithinPartitions("block", "place")
    nodes = parts[0]
    for p in parts[1:]:
        nodes = nodes.unionByName(p)
    done = nodes.filter("up is null").select(*NODE_COLUMNS)
    if len(parts) == 1:
        return done
    parents = nodes.filter("own is not null").select(F.col("own").alias("up"), F.col("conv_id").alias("__parent"))
    waiting = nodes.filter("up is not null").join(parents, "up")
    return done.unionByName(waiting.select(*[F.col("__parent" if c == "parent_conv_id" else c).alias(c) for c in NODE_COLUMNS]))


def rebuilt_trie(turns: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations."""
    return trie(rebuilt(cut_lineage(sequences(turns))))
