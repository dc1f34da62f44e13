"""Exact dedup with Patricia tries: every copy is given the smallest doc_id that has its text.

Map tasks put their own texts into a trie and send each distinct text once for IDS ids that have it. Rows are then
partitioned by byte length and content hash, and each partition inserts full byte strings, in the order of their smallest ids, into one compressed
radix trie. So the first row of a text brings its owner, which is all that the terminal node keeps: the other ids are put out as they are met,
and a text that a third of all rows have takes no more memory than any other. Equality is that of whole byte strings; the hash only spreads them.
A trie above its memory spills its largest subtrees to the shared checkpoint folder and settles them one by one at the end.

Defined results
* null text or null doc_id: the row takes no part. Empty texts are copies of each other.
* repeated rows (same doc_id, same text) are one document, not copies. A doc_id with several texts may be listed with several owners.
* the owner itself is not listed, nor are documents without copy. Empty input: no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import io
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import checkpoint_root, remote, slim

TRIE_BYTES, IDS, ID_BYTES = 128 << 20, 10_000, 48
SENT = pa.schema([("length", pa.int64()), ("hash", pa.int64()), ("text", pa.binary()), ("ids", pa.list_(pa.int64())), ("first", pa.int64())])


class Node:
    __slots__ = ("label", "kids", "ids")

    def __init__(self, label: bytes, ids: list | None = None):
        self.label, self.kids, self.ids = label, None, ids


def shared_prefix(a: bytes, at: int, b: bytes) -> int:
    """Length of the common prefix of a[at:] and b, by bisection over block comparisons."""
    lo, hi = 0, min(len(a) - at, len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[at + lo : at + mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


class Trie:
    """A compressed radix trie over byte strings; ``folder`` is where subtrees beyond ``limit`` bytes are written.

    ``keep``: terminal nodes keep all ids. Else they keep the first one, and the others go to ``out`` as (id, first id).
    """

    def __init__(self, folder: str | None = None, limit: int = TRIE_BYTES, keep: bool = False):
        self.root, self.size, self.folder, self.limit, self.keep = Node(b""), 0, folder, limit, keep
        self.out: list[tuple[int, int]] = []
        self.away: dict[bytes, list] = {}  # first bytes of subtrees that were spilled: [files, rows in memory, their size]
        self.depth = 1

    def insert(self, key: bytes, ids: list) -> None:
        if self.away and (part := self.away.get(key[: self.depth])) is not None:
            self._later(part, key, ids)
            return
        node, at = self.root, 0
        while True:
            if at == len(key):
                if node.ids is None:
                    node.ids = []
                self._add(node, ids)
                return
            if node.kids is None:
                node.kids = {}
            child = node.kids.get(key[at])
            if child is None:
                node.kids[key[at]] = child = Node(key[at:], [])
                self.size += len(key) - at + 200
                self._add(child, ids)
                break
            if key.startswith(child.label, at):
                at += len(child.label)
                node = child
                continue
            n = shared_prefix(key, at, child.label)
            upper = Node(child.label[:n])
            child.label = child.label[n:]
            upper.kids = {child.label[0]: child}
            node.kids[upper.label[0]] = upper
            self.size += 200
            node, at = upper, at + n
        if self.folder and self.size > max(self.limit, 2 * len(key) + 1_000):  # a text larger than the memory is no reason to spill
            self._spill()

    def _add(self, node: Node, ids: list) -> None:
        if self.keep:
            node.ids += ids
            self.size += ID_BYTES * len(ids)
            return
        if not node.ids:
            node.ids, ids = ids[:1], ids[1:]
        self.out += [(i, node.ids[0]) for i in ids if i != node.ids[0]]

    def walk(self, node: Node | None = None, prefix: bytes = b""):
        """(text, ids) of all terminal nodes."""
        todo = [(node or self.root, prefix)]
        while todo:
            x, p = todo.pop()
            p += x.label
            if x.ids is not None:
                yield p, x.ids
            todo += [(k, p) for k in (x.kids or {}).values()]

    def settled(self):
        """What is left to put out, and then the same of each subtree that was spilled, in the order in which its rows came."""
        yield self.out
        self.root, self.size, self.out = Node(b""), 0, []
        for first, (files, rows, _) in self.away.items():
            sub = Trie(self.folder, self.limit)
            sub.depth = 2 * len(first) + 4  # doubled, so long common beginnings take few steps
            for part in [*map(self._load, files), rows]:
                for key, ids in part:
                    sub.insert(key, ids)
                yield sub.out
                sub.out = []
            yield from sub.settled()

    def _spill(self) -> None:
        """Write out subtrees, the largest first, until half of the memory is free. A subtree is all strings that begin with the same ``depth`` bytes."""
        by: dict[bytes, list] = {}
        for key, ids in self.walk():
            if len(key) >= self.depth:
                by.setdefault(key[: self.depth], []).append((key, ids))
        ranked = sorted(by.items(), key=lambda x: -sum(len(k) for k, _ in x[1]))
        gone, moved = set(), 0
        for first, rows in ranked:
            if moved >= self.size / 2:
                break
            moved += sum(len(k) + 200 for k, _ in rows)
            gone.add(first)
            part = self.away.setdefault(first, [[], [], 0])
            for key, ids in rows:
                self._later(part, key, ids)
        kept = [r for r in self.walk() if r[0][: self.depth] not in gone or len(r[0]) < self.depth]
        self.root, self.size, folder, self.folder = Node(b""), 0, self.folder, None
        for key, ids in kept:
            self.insert(key, ids)
        self.folder = folder

    def _later(self, part: list, key: bytes, ids: list) -> None:
        part[1].append((key, ids))
        part[2] += len(key) + 100
        if part[2] > max(1 << 16, self.limit // 16):
            part[0].append(self._store(part[1]))
            part[1], part[2] = [], 0

    def _store(self, rows: list) -> str:
        from pyarrow.fs import FileSystem

        fs, root = FileSystem.from_uri(self.folder)
        fs.create_dir(root)
        path = f"{root}/{uuid4().hex}"
        table = pa.table({"k": pa.array([k for k, _ in rows], pa.binary()), "i": pa.array([i for _, i in rows], pa.list_(pa.int64()))})
        buf = io.BytesIO()
        with pa.ipc.new_stream(buf, table.schema) as w:
            w.write_table(table)
        with fs.open_output_stream(path) as f:
            f.write(buf.getvalue())
        return path

    def _load(self, path: str) -> list:
        from pyarrow.fs import FileSystem

        fs, _ = FileSystem.from_uri(self.folder)
        with fs.open_input_stream(path) as f:
            table = pa.ipc.open_stream(f.read()).read_all()
        fs.delete_file(path)
        return list(zip(table.column("k").to_pylist(), table.column("i").to_pylist()))


def own(batches, limit: int):
    """The distinct texts of a map task (a trie at a time, of up to ``limit`` bytes), with their ids."""
    import xxhash

    def send(trie):
        rows = [(t, ids[k : k + IDS]) for t, i in trie.walk() for ids in (sorted(set(i)),) for k in range(0, len(ids), IDS)]
        for k in range(0, len(rows), 2000):
            part = rows[k : k + 2000]
            yield pa.RecordBatch.from_arrays([pa.array([len(t) for t, _ in part]), pa.array([xxhash.xxh64_intdigest(t) - (1 << 63) for t, _ in part]), pa.array([t for t, _ in part], pa.binary()), pa.array([i for _, i in part], pa.list_(pa.int64())), pa.array([i[0] for _, i in part], pa.int64())], schema=SENT)

    trie = Trie(keep=True)
    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
            trie.insert(t, [i])
            if trie.size > limit:
                yield from send(trie)
                trie = Trie(keep=True)
    yield from send(trie)


def settle(batches, folder: str, limit: int):
    """(doc_id, owner_id) for the copies of a partition, whose rows stand in the order of their smallest ids."""
    trie = Trie(f"{folder}/trie-{uuid4().hex}", limit)

    def put(pairs):
        if pairs:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*pairs)], ["doc_id", "owner_id"])

    for b in batches:
        for t, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            trie.insert(t, ids)
            if len(trie.out) > 50_000:
                yield from put(trie.out)
                trie.out = []
    for pairs in trie.settled():
        yield from put(pairs)


def copies(docs: DataFrame, limit: int = TRIE_BYTES) -> DataFrame:
    """doc_id, owner_id: every document whose text another one of smaller doc_id has, and the smallest such."""
    folder = checkpoint_root(docs.sparkSession)
    source = slim(docs, "doc_id", "text").where("doc_id is not null and text is not null")
    sent = source.mapInArrow(remote(__name__, "own", limit=limit // 2), "length long, hash long, text binary, ids array<long>, first long")
    placed = sent.repartition("length", "hash").sortWithinPartitions("first").select("text", "ids")
    return placed.mapInArrow(remote(__name__, "settle", folder=folder, limit=limit), "doc_id long, owner_id long").distinct()  # repeated rows of several partitions
