"""Operator 2: cost-balanced packing of documents into token sequences."""

from __future__ import annotations

import heapq
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import durable

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
CARRY = f"{PIECE}, ids binary"
#: Attention cost of a piece of n tokens is n + n * n / QUADRATIC_AT: at that length the quadratic part equals the linear.
QUADRATIC_AT = 2048.0
#: Tokens that one packing block holds; it bounds a task's memory whatever the size of its input split.
BLOCK_TOKENS = 4_000_000
#: Words, and pieces of words, that a worker remembers the ids of. Pieces are looked up for new words alone.
CACHE_WORDS, CACHE_PIECES = 300_000, 100_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: How the word tokenizer splits a normalised text; a token never crosses these pieces. (A fixed value of its vocabulary file.)
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PLAN = ["NFC(), Replace(", "Lowercase()", _PIECES, "ByteLevel(add_prefix_space=False"]
#: Texts with these are encoded whole: special tokens, a capital whose lower case depends on its place, separators that
#: Python and the tokenizer class differently.
_WHOLE = regex.compile("<\\||\u03a3|[\x1c-\x1f]")


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE's letters for bytes: printable Latin-1 stands for itself, the rest is numbered from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Ids(dict):
    """Ids by text, made when first asked for. At most `most` are kept, none of them long; they are dropped once three
    times as many came too late to be kept, so that a new kind of text does not find it full of the last."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.late = make, most, 0

    def __missing__(self, text: str) -> bytes:
        ids = self.make(text)
        if len(text) > 64:
            return ids
        if len(self) < self.most:
            self[text] = ids
            return ids
        self.late += 1
        if self.late > 3 * self.most:
            self.clear()
            self.late = 0
        return ids


class WordTokenizer:
    """Ids of whole texts as little-endian bytes, word by word through bounded caches.

    Words are cut into what the tokenizer's own splitter cuts a normalised text into, none of which crosses white space, so the ids
    are those of encoding the whole; tokenizers with another plan are called on whole texts."""

    def __init__(self, path: str, eos: int):
        from tokenizers import Tokenizer

        self.tok, self.eos = Tokenizer.from_file(path), np.array([eos], dtype="<u4").tobytes()
        plan = f"{self.tok.normalizer} {self.tok.pre_tokenizer}".replace("\\\\", "\\")
        split, model, letters = regex.compile(_PIECES).findall, self.tok.model, _byte_letters()
        self.known = all(x in plan for x in _PLAN)

        def piece(p: str) -> bytes:
            spelt = p if p.isascii() else p.encode().decode("latin-1")
            return b"".join([t.id.to_bytes(4, "little") for t in model.tokenize(spelt.translate(letters))])

        self.pieces = _Ids(piece, CACHE_PIECES)
        self.words = _Ids(lambda w: b"".join(map(self.pieces.__getitem__, split(unicodedata.normalize("NFC", w).lower()))), CACHE_WORDS)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __call__(self, texts: list[str | None]) -> Iterator[bytes]:
        for t in texts:
            if not t:
                yield self.eos
            elif not self.known or _WHOLE.search(t):
                yield self._whole(t) + self.eos
            else:
                yield b"".join(map(self.words.__getitem__, t.split())) + self.eos


@lru_cache(maxsize=2)
def word_tokenizer(path: str, eos: int) -> WordTokenizer:
    """One per worker process, so that its tasks share what it remembers of words."""
    return WordTokenizer(path, eos)


def cost(n: float) -> float:
    return n + n * n / QUADRATIC_AT


def assign(lengths: list[int], n_sequences: int, capacity: int) -> list[list[tuple[int, int, int]]]:
    """Pieces (item, from, length) of each sequence: items by descending cost, each to the cheapest sequence with room.

    An item goes whole to the cheapest sequence that holds it; if none does, it fills the cheapest one with room and the
    rest goes on. Items beyond all capacity stay unassigned. Ties keep the items' order, so the result is a function of the input."""
    room, spent = np.full(n_sequences, capacity), np.zeros(n_sequences)
    seqs: list[list[tuple[int, int, int]]] = [[] for _ in range(n_sequences)]
    todo = [(-n, i, 0) for i, n in enumerate(lengths) if n]
    heapq.heapify(todo)
    rest = n_sequences * capacity
    while todo and rest:
        left, i, at = heapq.heappop(todo)
        left = -left
        s = int(np.where(room >= left, spent, np.inf).argmin())
        if room[s] < left:  # none holds it whole
            s = int(np.where(room > 0, spent, np.inf).argmin())
        n = min(left, int(room[s]))
        seqs[s].append((i, at, n))
        room[s] -= n
        spent[s] += cost(n)
        rest -= n
        if n < left:
            heapq.heappush(todo, (n - left, i, at + n))
    return seqs


def _pack(items: list[tuple[int, int, int, bytes]], n_sequences: int, capacity: int, first_id: int) -> tuple[list[tuple], list[tuple]]:
    """Rows of the sequences' pieces, and the items (doc_id, start, doc_tokens, ids) that no sequence took."""
    rows, used = [], [0] * len(items)
    whole: list[list[tuple[int, int]]] = [[] for _ in items]
    for k, pieces in enumerate(assign([len(x[3]) // 4 for x in items], n_sequences, capacity)):
        offset = 0
        for i, at, n in pieces:
            doc, start, total, ids = items[i]
            rows.append((doc, start + at, n, zlib.crc32(ids[4 * at : 4 * (at + n)]), total, first_id + k, offset))
            offset += n
            whole[i].append((at, n))
            used[i] += n
    rest = []
    for i, (doc, start, total, ids) in enumerate(items):
        if used[i] < len(ids) // 4:  # pieces are cut from the front, so the rest is one run
            at = max((a + n for a, n in whole[i]), default=0)
            rest.append((doc, start + at, total, ids[4 * at :]))
    return rows, rest


def _batches(rows: list[tuple], rest: list[tuple] = ()) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    cols = [pa.array([r[j] for r in rows] + [(d, s, len(x) // 4, zlib.crc32(x), n, None, None)[j] for d, s, n, x in rest], pa.int64()) for j in range(7)]
    cols.append(pa.array([None] * len(rows) + [x[3] for x in rest], pa.binary()))
    yield pa.RecordBatch.from_arrays(cols, [*names, "ids"])


def pack(documents: DataFrame, tokenizer_path: str | None = None, capacity: int = 4096, eos: int = 2, group: int = 256) -> DataFrame:
    """Pack all documents into sequences of at most `capacity` tokens; one row per piece.

    A document's tokens are its text's ids and then `eos`; null and empty texts have `eos` alone. Each input task tokenizes
    its rows once, in blocks of BLOCK_TOKENS, and fills as many sequences as its tokens fill entirely, by descending cost
    into the cheapest with room. What is left of a task (under one sequence) goes with the rests of up to `group` tasks into
    shared sequences, so padding doesn't grow with the number of tasks. Only those rests, at most 16 kB a task, are shuffled.
    Rows repeated under one doc_id are packed each; extra columns are ignored; an empty table gives no rows."""
    ship(documents.sparkSession)
    path = tokenizer_path or default_tokenizer()

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tok, task = word_tokenizer(path, eos), TaskContext.get().partitionId()
        items: list[tuple[int, int, int, bytes]] = []
        held, next_id = 0, task << 32
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                for doc, ids in zip(part.column(0).to_pylist(), tok(part.column(1).to_pylist()), strict=True):
                    items.append((doc, 0, len(ids) // 4, ids))
                    held += len(ids) // 4
                if held >= BLOCK_TOKENS:
                    n = held // capacity
                    rows, items = _pack(items, n, capacity, next_id)
                    next_id += n
                    held = sum(len(x[3]) // 4 for x in items)
                    yield from _batches(rows)
        n = held // capacity
        rows, items = _pack(items, n, capacity, next_id)
        yield from _batches(rows, items)

    def finish(key, pieces):
        order = sorted(zip(*(pieces.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens", "ids")), strict=True))
        total = sum(len(x[3]) // 4 for x in order)
        rows, rest = _pack(order, -(-total // capacity), capacity, (1 << 62) + (key[0].as_py() << 32))
        assert not rest
        return pa.Table.from_batches(list(_batches(rows))).drop_columns(["ids"])

    made = durable(documents.select("doc_id", "text").mapInArrow(fill, CARRY).withColumn("of", F.spark_partition_id()))
    rests = made.where("ids IS NOT NULL").select((F.col("of") / group).cast("long").alias("of"), "doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids")
    return made.where("ids IS NULL").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset").union(rests.groupBy("of").applyInArrow(finish, PIECE))
