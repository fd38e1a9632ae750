"""SentencePiece encoding and decoding by vectorised merge rounds."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import giving_back

SPACE = "▁"
#: Pieces of a text that no vocabulary entry can span: a run of spaces and what follows it.
SEGMENT = re.compile(r" *[^ ]+| +")
#: Segments that a task remembers; beyond it, it starts anew.
REMEMBERED = 150_000
#: Segments that are encoded at once: each of their characters takes some hundred bytes meanwhile.
AT_ONCE = 10_000
NEVER = np.int64(1) << 40


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Number and value of the fields of a protocol buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        else:
            size, at = varint(at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


class Codec:
    """A byte-fallback BPE model file as numpy tables.

    Symbols are the ids of pieces, and above them numbers for single characters that occur in
    pieces without being one. ``ranks`` orders pieces by falling score, equal for equal scores.
    The text is segmented at spaces, which is exact because no piece has a space after another
    character; the constructor checks that, and that the model is of the kind it can encode.
    """

    NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6

    def __init__(self, model: bytes, end_id: int = 2):
        pieces, scores, kinds = [], [], []
        for number, value in _fields(model):
            if number == 1:
                own = dict(_fields(value))
                pieces.append(own[1].decode())
                scores.append(np.frombuffer(own.get(2, b"\0\0\0\0"), "<f4")[0])
                kinds.append(own.get(3, self.NORMAL))
            elif number == 3:
                own = dict(_fields(value))
                if own.get(1) != b"identity" or own.get(3, 1) != 1 or own.get(4, 1) != 0:
                    raise ValueError("only identity normalisation with a dummy prefix and all white space kept is supported")
            elif number == 2:
                if dict(_fields(value)).get(3) != 2:
                    raise ValueError("only BPE models are supported")
        kinds = np.array(kinds)
        if (kinds == self.USER).any() or (kinds == self.UNUSED).any() or (kinds == self.BYTE).sum() != 256:
            raise ValueError("only models with byte fallback and without user-defined or unused pieces are supported")
        self.end_id, self.n_pieces = end_id, len(pieces)
        normal = {p: i for i, p in enumerate(pieces) if kinds[i] == self.NORMAL}
        if any(SPACE in p.lstrip(SPACE) for p in normal):
            raise ValueError("a piece spans a space")
        symbols = dict(normal)
        for c in sorted({c for p in normal for c in p}):
            symbols.setdefault(c, len(pieces) + len(symbols) - len(normal))
        self.bytes_from = int(np.flatnonzero(kinds == self.BYTE)[0])
        # Characters by code point, and the byte ids of all others.
        self.chars = np.full(0x110000, -1, np.int32)
        for c, s in symbols.items():
            if len(c) == 1:
                self.chars[ord(c)] = s
        rank_of = {s: r for r, s in enumerate(sorted({scores[i] for i in normal.values()}, reverse=True))}
        rank = {p: rank_of[scores[i]] for p, i in normal.items()}
        lefts, rights, made = [], [], []
        eager = np.zeros(len(pieces), bool)
        for p, i in normal.items():
            for k in range(1, len(p)):
                a, b = p[:k], p[k:]
                if a in symbols and b in symbols:
                    lefts.append(symbols[a]), rights.append(symbols[b]), made.append(i)
                for part in (a, b):
                    if part in normal and len(part) > 1 and rank[part] >= rank[p]:
                        eager[normal[part]] = True
        self.width = np.int64(max(symbols.values()) + 1)
        keys = np.array(lefts, np.int64) * self.width + np.array(rights, np.int64)
        order = np.argsort(keys)
        self.keys, self.made = keys[order], np.array(made, np.int64)[order]
        self.ranks = np.full(len(pieces), NEVER)
        for p, i in normal.items():
            self.ranks[i] = rank[p]
        #: Pieces that a longer piece follows at once if it can: their merges go one at a time.
        self.eager = eager
        self.joint = self._joints(normal)
        self.output = [b"" if k in (self.CONTROL, self.UNKNOWN) else bytes([i - self.bytes_from]) if k == self.BYTE else p.replace(SPACE, " ").encode() for i, (p, k) in enumerate(zip(pieces, kinds, strict=True))]
        self.output[int(np.flatnonzero(kinds == self.UNKNOWN)[0])] = " ⁇ ".encode()
        self.is_byte, self.is_normal = kinds == self.BYTE, kinds == self.NORMAL
        self.is_silent = kinds == self.CONTROL

    def _joints(self, normal: dict[str, int]) -> np.ndarray:
        """Sorted keys of the pairs of characters that stand side by side within some piece."""
        return np.array(sorted({ord(a) << 21 | ord(b) for p in normal for a, b in zip(p, p[1:])}), np.int64)

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of the merge of neighbours; NEVER where there is none."""
        keys = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        found = (self.keys[at] == keys) & (left >= 0) & (right >= 0)
        piece = np.where(found, self.made[at], 0)
        return np.where(found, self.ranks[piece], NEVER), piece

    def encode_segments(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all segments and the ends of each.

        Each round finds the least rank of every word's neighbours and merges it there: the
        leftmost place first, and all further places of the same piece at once if no longer piece
        could come before them. Then the arrays are compacted. Words are segments, cut further
        between characters that no piece joins, so that unbroken text of any length has short ones.
        """
        text = "".join(segments).replace(" ", SPACE)
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        sizes = np.fromiter(map(len, segments), np.int64, len(segments))
        segment = np.repeat(np.arange(len(segments)), sizes)
        if not len(code):
            return np.zeros(0, np.int32), np.cumsum(sizes)
        pair = code[:-1] << 21 | code[1:]
        at = np.minimum(np.searchsorted(self.joint, pair), len(self.joint) - 1)
        cut = np.ones(len(code), bool)
        cut[1:] = (segment[1:] != segment[:-1]) | (self.joint[at] != pair)
        word = np.cumsum(cut) - 1
        symbol = self.chars[code].astype(np.int64)
        done_place, done_symbol = [], []
        place = np.arange(len(code))
        rank, piece = self._pairs(symbol, word)
        while len(symbol):
            starts = np.flatnonzero(np.diff(word, prepend=-1))
            least = np.minimum.reduceat(rank, starts)
            sizes_now = np.diff(starts, append=len(word))
            open_word = np.repeat(least < NEVER, sizes_now)
            if not open_word.all():
                done_place.append(place[~open_word]), done_symbol.append(symbol[~open_word])
                symbol, word, place, rank, piece = (x[open_word] for x in (symbol, word, place, rank, piece))
                if not len(symbol):
                    break
                keep = least < NEVER
                least, sizes_now = least[keep], sizes_now[keep]
                starts = np.cumsum(sizes_now) - sizes_now
            hit = rank == np.repeat(least, sizes_now)
            spot = np.flatnonzero(hit)
            owner = word[spot]
            first = np.ones(len(spot), bool)
            first[1:] = owner[1:] != owner[:-1]
            lead = np.repeat(piece[spot[first]], np.diff(np.flatnonzero(first), append=len(spot)))
            # Further places in a word: of the same piece, which no longer piece follows at once.
            spot = spot[first | ((piece[spot] == lead) & ~self.eager[piece[spot]])]
            spot = self._apart(spot)
            symbol[spot] = piece[spot]
            alive = np.ones(len(symbol), bool)
            alive[spot + 1] = False
            touched = np.zeros(len(symbol), bool)
            touched[spot] = True
            before = spot - 1
            before = before[before >= 0]
            before = before - ~alive[before]
            touched[before[before >= 0]] = True
            symbol, word, place, rank, piece, touched = (x[alive] for x in (symbol, word, place, rank, piece, touched))
            again = np.flatnonzero(touched)
            follow = np.minimum(again + 1, len(symbol) - 1)
            r, p = self._look_up(symbol[again], symbol[follow])
            r[(again + 1 >= len(symbol)) | (word[follow] != word[again])] = NEVER
            rank[again], piece[again] = r, p
        place, symbol = np.concatenate([*done_place, place]), np.concatenate([*done_symbol, symbol])
        order = np.argsort(place, kind="stable")
        place, symbol = place[order], symbol[order]
        return self._with_bytes(code, segment, place, symbol, len(segments))

    def _pairs(self, symbol: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        right = np.append(symbol[1:], -1)
        rank, piece = self._look_up(symbol, right)
        rank[:-1][word[1:] != word[:-1]] = NEVER
        rank[-1] = NEVER
        return rank, piece

    @staticmethod
    def _apart(spot: np.ndarray) -> np.ndarray:
        """Leftmost places such that no two overlap: every second one in a run of neighbours."""
        run = np.ones(len(spot), bool)
        run[1:] = spot[1:] != spot[:-1] + 1
        start = np.maximum.accumulate(np.where(run, np.arange(len(spot)), 0))
        return spot[(np.arange(len(spot)) - start) % 2 == 0]

    def _with_bytes(self, code, segment, place, symbol, n_segments) -> tuple[np.ndarray, np.ndarray]:
        """Ids with byte pieces where a character is no piece, and the end of each segment."""
        out = (symbol < 0) | (symbol >= self.n_pieces)
        owner = segment[place]
        if not out.any():
            return symbol.astype(np.int32), np.searchsorted(owner, np.arange(n_segments), "right")
        c = code[place]
        n = np.where(out, 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF), 1)
        end = np.cumsum(n)
        ids = np.repeat(symbol, n)
        for i in np.flatnonzero(out):
            ids[end[i] - n[i] : end[i]] = self.bytes_from + np.frombuffer(chr(c[i]).encode(), np.uint8)
        return ids.astype(np.int32), np.searchsorted(np.repeat(owner, n), np.arange(n_segments), "right")

    def decode(self, ids: np.ndarray) -> str:
        """The text of one document's ids, as the library's decode gives it.

        The space of the dummy prefix goes. Byte pieces in a row are read as UTF-8, each byte that
        belongs to no character becoming one replacement character.
        """
        shown = ids[~self.is_silent[ids]]
        if not len(shown):
            return ""
        if self.is_silent[ids[:-1]].any():
            return self._decode_broken(ids)
        ids = shown
        data = b"".join([self.output[i] for i in ids.tolist()])
        if self.is_normal[ids[0]] and data[:1] == b" ":
            data = data[1:]
        try:
            return data.decode()
        except UnicodeDecodeError:
            return self._decode_broken(ids)

    def _decode_broken(self, ids: np.ndarray) -> str:
        parts, run, first = [], bytearray(), True

        def flush() -> None:
            at = 0
            while at < len(run):
                size = next((k for k in (1, 2, 3, 4) if _is_char(run[at : at + k], k)), 0)
                parts.append(bytes(run[at : at + size]).decode() if size else "�")
                at += size or 1
            run.clear()

        for i in ids.tolist():
            if self.is_byte[i]:
                run.extend(self.output[i])
            else:
                flush()
                own = self.output[i].decode()
                parts.append(own[1:] if first and self.is_normal[i] and own[:1] == " " else own)
            first &= bool(self.is_silent[i])
        flush()
        return "".join(parts)


def _is_char(data: bytes, size: int) -> bool:
    try:
        return len(data) == size and len(bytes(data).decode()) == 1
    except UnicodeDecodeError:
        return False


class Encoder:
    """A codec with the segments it has met; ids of a document come from those of its segments."""

    def __init__(self, model: bytes):
        self.codec = Codec(model)
        self.reset()

    def reset(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, with the end id last."""
        if len(self.known) > REMEMBERED:
            self.reset()
        # The dummy prefix is a space in front of a text that is not empty.
        parts = [SEGMENT.findall(" " + t.replace(SPACE, " ")) if t else [] for t in texts]
        fresh = list(set().union(*parts) - self.known.keys())
        if fresh:
            self.known.update(zip(fresh, range(len(self.known), len(self.known) + len(fresh)), strict=True))
            ids, ends, total = [self.ids], [self.ends], len(self.ids)
            for start in range(0, len(fresh), AT_ONCE):
                own, own_ends = self.codec.encode_segments(fresh[start : start + AT_ONCE])
                ids.append(own)
                ends.append(own_ends + total)
                total += len(own)
            self.ids, self.ends = np.concatenate(ids), np.concatenate(ends)
        out = []
        for p in parts:
            rows = np.fromiter(map(self.known.__getitem__, p), np.int64, len(p))
            start, size = self.ends[rows], self.ends[rows + 1] - self.ends[rows]
            total = int(size.sum())
            own = np.empty(total + 1, np.int32)
            # Flat places of all segments of the text: ranges laid end to end.
            own[:total] = self.ids[np.arange(total) + np.repeat(start - (np.cumsum(size) - size), size)]
            own[total] = self.codec.end_id
            out.append(own)
        return out


def _parts(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Rows whose values of ``column`` have together about ``most`` bytes, or elements."""
    values = batch.column(column)
    length = pc.list_value_length(values) if pa.types.is_list(values.type) else pc.binary_length(values)
    size = np.cumsum(pc.fill_null(length, 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        base = size[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(size, base + most, "right")))
        yield batch.slice(start, end - start)
        start = end


def _with_column(docs: DataFrame, source: str, to: str, kind: T.DataType, most: int, start) -> DataFrame:
    """``docs`` with ``to`` computed from ``source`` by the function that ``start()`` returns, part by part."""
    kept = [f for f in docs.schema.fields if f.name.lower() != to.lower() or f.name == source]
    # What is replaced does not come back from the task.
    returned = [f.name for f in kept if to != source or f.name != source]
    hidden = "__made" if to == source else to
    schema = T.StructType([*[f for f in kept if f.name in returned], T.StructField(hidden, kind)])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = start()
        for batch in batches:
            for part in _parts(batch, source, most):
                yield pa.RecordBatch.from_arrays([*part.select(returned).columns, make(part.column(source))], names=[f.name for f in schema.fields])

    out = docs.select(*[F.col(f"`{f.name}`") for f in kept]).mapInArrow(lambda batches: giving_back(rows(batches)), schema)
    return out.withColumnRenamed(hidden, to) if to == source else out


def encode(docs: DataFrame, model: bytes, text: str = "text", to: str = "ids", bytes_a_round: int = 1_000_000) -> DataFrame:
    """``docs`` with array<int> ``to``: the ids of each whole text, an end id last; a null text counts as empty.

    Equal to the sentencepiece library's ids for BPE models with byte fallback and identity
    normalisation. Every distinct segment is encoded once a task, as long as it is remembered.
    Memory is bounded by ``bytes_a_round``, the longest text and ``REMEMBERED`` segments. Rows and
    other columns stay as they are; a column named ``to`` is replaced.
    """

    def start():
        encoder = Encoder(model)

        def make(texts: pa.Array) -> pa.Array:
            out = encoder.batch(pc.fill_null(texts, "").to_pylist())
            ends = np.cumsum([0, *map(len, out)]).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(out)))

        return make

    return _with_column(docs, text, to, T.ArrayType(T.IntegerType()), bytes_a_round, start)


def decode(docs: DataFrame, model: bytes, ids: str = "ids", to: str = "decoded", ids_a_round: int = 500_000) -> DataFrame:
    """``docs`` with string ``to``: the text of each array of ids; null for null, empty for none."""

    def start():
        codec = Codec(model)

        def make(rows: pa.Array) -> pa.Array:
            flat = rows.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            sizes = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            present = rows.is_valid().to_pylist()
            texts = [codec.decode(flat[e - n : e]) if ok else None for e, n, ok in zip(ends, sizes, present, strict=True)]
            return pa.array(texts, pa.string())

        return make

    return _with_column(docs, ids, to, T.StringType(), ids_a_round, start)


def model_bytes(path: str) -> bytes:
    """The model file, read on the driver; its size is that of the tokenizer, whatever the data."""
    with open(path, "rb") as f:
        return f.read()
