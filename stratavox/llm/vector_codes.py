"""Vector codes: the parts of integer vectors replaced by entries of learnt codebooks.

The codebooks are learnt from all vectors by Lloyd rounds with exact integer arithmetic. Vectors lie
in blocks, and each block keeps a heap of its parts for every entry, keyed by the slack between the
bounds of a part's distances to its own and to any other entry. A round takes from the heaps only the
parts whose slack the entries' drift has used up; those are measured against all entries again, all
others keep their entry, which is proved by their slack.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, remove

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
#: Integers beyond this are set to it, so that all distances and sums fit 64 bits.
LARGEST = 1 << 26
#: Vectors of a block; a heap item holds its place in the block in so many low bits.
BLOCK_BITS = 11
#: Bounds are whole numbers of 1/256, rounded so that they stay bounds.
FINE = 256
FAR = 1 << 48
STATE = "ids array<long>, labels array<{label}>, width int, parts binary, entries binary, sizes binary, heaps binary, sums array<long>"


def kept_vectors(vectors: DataFrame, name: str = "embedding") -> DataFrame:
    """Rows whose vector is no null and has no null or non-finite component."""
    bad = F.exists(name, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.filter(F.col(name).isNotNull() & ~bad)


def _integers(flat: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(flat.astype(np.float64) * SCALE), -LARGEST, LARGEST).astype(np.int64)


def _cut(rows: np.ndarray) -> np.ndarray:
    """Vectors (n by width) in ``PARTS`` equal parts, the last filled up with zeros."""
    n, width = rows.shape
    size = max(1, -(-width // PARTS))
    return np.pad(rows, ((0, 0), (0, size * PARTS - width))).reshape(n, PARTS, size)


def _distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    return np.stack([((x - entry) ** 2).sum(1) for entry in book], 1)


def _nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row (lower index on ties) and the slack to the second one."""
    d = _distances(x, book)
    own = d.argmin(1)
    if len(book) == 1:
        return own, np.full(len(x), FAR, np.int64)
    first = np.sqrt(np.take_along_axis(d, own[:, None], 1)[:, 0].astype(np.float64))
    np.put_along_axis(d, own[:, None], np.iinfo(np.int64).max, 1)
    return own, np.floor((np.sqrt(d.min(1).astype(np.float64)) - first) * FINE).astype(np.int64) - 1


class Block:
    """Up to 2 ** BLOCK_BITS vectors in parts, the entry of each part, and the heaps by part position and entry."""

    def __init__(self, x: np.ndarray, books: np.ndarray):
        self.x, k = x, books.shape[1]
        self.entries = np.zeros((len(x), PARTS), np.uint8)
        self.heaps = [[[] for _ in range(k)] for _ in range(PARTS)]
        self.sums = np.zeros((PARTS, k, x.shape[2] + 1), np.int64)
        for p in range(PARTS):
            self._enter(p, np.arange(len(x)), books[p], np.zeros(k, np.int64))
            for heap in self.heaps[p]:
                heapq.heapify(heap)

    @classmethod
    def read(cls, row: dict, k: int) -> Block:
        self = cls.__new__(cls)
        self.x = np.frombuffer(row["parts"], f"<i{row['width']}").astype(np.int64).reshape(len(row["ids"]), PARTS, -1)
        self.entries = np.frombuffer(row["entries"], np.uint8).reshape(-1, PARTS).copy()
        items = np.split(np.frombuffer(row["heaps"], "<i8"), np.cumsum(np.frombuffer(row["sizes"], "<i4"))[:-1])
        self.heaps = [[items[p * k + e].tolist() for e in range(k)] for p in range(PARTS)]
        self.sums = np.zeros((PARTS, k, self.x.shape[2] + 1), np.int64)
        return self

    def _enter(self, p: int, rows: np.ndarray, book: np.ndarray, used: np.ndarray) -> None:
        """Measure ``rows`` of part position ``p``, add them to their entry's sums and heap items."""
        x = self.x[rows, p]
        own, slack = _nearest(x, book)
        self.entries[rows, p] = own
        items = ((slack + used[own]) << BLOCK_BITS) | rows
        for e in np.unique(own):
            at = own == e
            self.sums[p, e, :-1] += x[at].sum(0)
            self.sums[p, e, -1] += at.sum()
            self.heaps[p][e] += items[at].tolist()

    def move(self, books: np.ndarray, used: np.ndarray) -> int:
        """Rescan the parts whose slack is used up; returns how many. ``sums`` are what has changed."""
        scanned = 0
        for p in range(PARTS):
            loose = []
            for e, heap in enumerate(self.heaps[p]):
                bound = (int(used[p, e]) + 1) << BLOCK_BITS
                while heap and heap[0] < bound:
                    loose.append(heapq.heappop(heap) & ((1 << BLOCK_BITS) - 1))
            if not loose:
                continue
            rows = np.array(loose)
            old = self.entries[rows, p]
            x = self.x[rows, p]
            own, slack = _nearest(x, books[p])
            for row, e, s in zip(loose, own.tolist(), slack.tolist(), strict=True):
                heapq.heappush(self.heaps[p][e], ((s + int(used[p, e])) << BLOCK_BITS) | row)
            self.entries[rows, p] = own
            moved = own != old
            np.add.at(self.sums[p, :, :-1], own[moved], x[moved])
            np.subtract.at(self.sums[p, :, :-1], old[moved], x[moved])
            np.add.at(self.sums[p, :, -1], own[moved], 1)
            np.subtract.at(self.sums[p, :, -1], old[moved], 1)
            scanned += len(rows)
        return scanned

    def row(self, ids: pa.Array, labels: pa.Array) -> list:
        top = int(np.abs(self.x).max(initial=0))
        width = 2 if top < 1 << 15 else 4
        heaps = [heap for part in self.heaps for heap in part]
        sizes = np.array([len(h) for h in heaps], "<i4")
        flat = np.concatenate([np.array(h, "<i8") for h in heaps]) if len(self.x) else np.zeros(0, "<i8")
        return [ids, labels, width, self.x.astype(f"<i{width}").tobytes(), self.entries.tobytes(), sizes.tobytes(), flat.tobytes(), self.sums.ravel().tolist()]


def _batch(rows: list[list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _arrow_schema(label: pa.DataType) -> pa.Schema:
    kinds = {"ids": pa.list_(pa.int64()), "labels": pa.list_(label), "width": pa.int32(), "parts": pa.binary(), "entries": pa.binary(), "sizes": pa.binary(), "heaps": pa.binary(), "sums": pa.list_(pa.int64())}
    return pa.schema(list(kinds.items()))


def _started(books: np.ndarray, width: int):
    """Batches of (vec_id, label, embedding) to blocks with all their parts entered."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = _arrow_schema(batch.column(1).type)
            for start in range(0, batch.num_rows, 1 << BLOCK_BITS):
                part = batch.slice(start, 1 << BLOCK_BITS)
                flat = part.column(2).flatten().to_numpy(zero_copy_only=False)
                block = Block(_cut(_integers(flat).reshape(part.num_rows, width)), books)
                yield _batch([block.row(part.column(0).to_pylist(), part.column(1).to_pylist())], schema)

    return run


def _moved(books: np.ndarray, used: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = _arrow_schema(batch.column("labels").type.value_type)
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                block = Block.read(row, books.shape[1])
                block.move(books, used)
                yield _batch([block.row(row["ids"], row["labels"])], schema)

    return run


def _coded(books: np.ndarray, used: np.ndarray):
    """Blocks to rows of (vec_id, label, code, error) under the final codebooks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column("labels").type.value_type
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                block = Block.read(row, books.shape[1])
                block.move(books, used)
                error = sum(((block.x[:, p] - books[p][block.entries[:, p]]) ** 2).sum(1) for p in range(PARTS))
                code = [bytes(e).hex() for e in block.entries]
                yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(row["labels"], label), pa.array(code, pa.string()), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    return run


def _summed(state: DataFrame, shape: tuple[int, ...]) -> np.ndarray:
    """The blocks' ``sums`` added up: as many numbers as the codebooks have, and a count for each entry."""
    out = np.zeros(int(np.prod(shape)), np.int64)
    for r in state.select(F.posexplode("sums")).groupBy("pos").agg(F.sum("col").alias("s")).collect():
        out[r["pos"]] = r["s"]
    return out.reshape(shape)


def _updated(books: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Entries replaced by the floors of their parts' means; unused entries stay."""
    n = sums[..., -1:]
    return np.where(n > 0, sums[..., :-1] // np.maximum(n, 1), books)


def _drift(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """For parts of each entry, what their slack loses when the entries move: own way plus the longest other one."""
    way = np.sqrt(((new - old) ** 2).sum(2).astype(np.float64))
    if way.shape[1] == 1:
        return np.zeros(way.shape, np.int64)
    order = np.sort(way, 1)
    other = np.where((way == order[:, -1:]) & ((way == order[:, -1:]).sum(1, keepdims=True) == 1), order[:, -2:-1], order[:, -1:])
    return np.ceil((way + other) * FINE).astype(np.int64) + (way.max(1, keepdims=True) > 0)


def codebooks_text(books: np.ndarray) -> str:
    return ",".join(map(str, books.ravel().tolist()))


def encode(vectors: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error) of every kept vector, and the codebooks (part, entry, component).

    ``vectors`` has vec_id (an integer), label (any type) and embedding (an array of numbers); other
    columns are ignored. Vectors that are null or have null or non-finite components are dropped. The
    first entries are the parts of the ``ENTRIES`` least vec_ids, null ids last and rows of one id by
    their vectors; with fewer vectors there are fewer entries. Vectors of another length than the
    first one are dropped; a length that ``PARTS`` does not divide is filled up with zeros.
    Components beyond 16,384 count as that. Repeated rows count each; an empty table gives no rows.

    Blocks with their heaps are a table in the shared folder, written once a round from the one
    before, which is deleted then. The driver sees the codebooks and their sums alone. Results do not
    depend on how vectors fall into blocks: the sums are whole numbers, and heaps only save work.
    """
    spark = vectors.sparkSession
    kept = kept_vectors(vectors).select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")
    first = kept.orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(ENTRIES).collect()
    label = vectors.schema["label"].dataType.simpleString()
    schema = f"vec_id long, label {label}, code string, error long"
    width = len(first[0]["embedding"]) if first else 0
    if not width:
        none = np.zeros((PARTS, 0, 0), np.int64)
        found = kept.select("vec_id", "label", F.lit("00" * PARTS).alias("code"), F.lit(0).cast("long").alias("error"))
        return (found.filter(F.size("embedding") == 0) if first else found.limit(0)), none
    first = [r["embedding"] for r in first if len(r["embedding"]) == width]
    books = _cut(_integers(np.array(first, np.float64))).transpose(1, 0, 2)
    kept = kept.filter(F.size("embedding") == width)
    sums, used = np.zeros((*books.shape[:2], books.shape[2] + 1), np.int64), np.zeros(books.shape[:2], np.int64)
    state = materialise(kept.mapInArrow(_started(books, width), STATE.format(label=label)), "blocks")
    for left in range(rounds - 1, -1, -1):
        sums = sums + _summed(state, sums.shape)
        new = _updated(books, sums)
        used, books = used + _drift(books, new), new
        moved = state.mapInArrow(_moved(books, used), state.schema) if left else state.mapInArrow(_coded(books, used), schema)
        moved = materialise(moved, "blocks" if left else "codes")
        remove(spark, state)
        state = moved
    return state, books


def codes(vectors: DataFrame) -> DataFrame:
    """``encode`` with label_error, the errors summed over equal labels (nulls together), and the codebooks' digest."""
    coded, books = encode(vectors)
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    found = coded.join(sums, coded["label"].eqNullSafe(sums["of"]))
    return found.select("vec_id", "code", "error", "label_error", F.sha2(F.lit(codebooks_text(books)), 256).alias("codebooks_sha256"))
