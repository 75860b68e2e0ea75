"""Packing of tokenised documents into training sequences (operator 7).

Method: vector bin packing by the dot-product heuristic. An item has three sizes (tokens, segments,
loss-bearing tokens) and a sequence has a limit for each. Into the open sequence goes the item, among
those that fit, whose sizes have the largest weighted dot product with the room left; the weight of a
dimension is its total demand against its limit. Items may be cut: a document longer than a sequence
gives whole sequences first, and where nothing fits the best item is cut to fill the room exactly.
A sequence that ends before it is full, by another limit or at the end of a task, is cut into sequences
whose lengths are powers of two, which need no padding.

A task packs its own rows from a bounded buffer and carries its open sequence over to the next
buffer, so there is no shuffle and no task gathers more than a buffer. Sequence ids hold the task's
partition number in their upper bits. The result depends on the order of rows in a partition; a task
that runs again reads the same file part, and rows of a lost task are never mixed with another run's.

Defined results: a null or empty text is the end id alone. Repeated rows are packed each for itself.
An empty table gives no rows; a very long text is cut. Items of equal size are taken in the order of reading. Columns other
than the named ones are ignored.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Generator, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tidewright.llm import token_ids
from tidewright.llm.bpe import DEFAULT_VOCABULARY
from tidewright.llm.common import release, text_slices

END_ID = 1


@dataclass(frozen=True)
class Limits:
    """What a sequence may hold; ``buffer`` bounds the ids that a task holds at once (beside one document's)."""

    tokens: int = 2048
    segments: int = 256
    loss_tokens: int = 2048
    buffer: int = 1_000_000


@dataclass
class Sequence:
    """An open sequence: pieces as (document number, start, length) and the sums of their sizes."""

    pieces: list[tuple[int, int, int]] = field(default_factory=list)
    tokens: int = 0
    loss: int = 0

    def add(self, item: tuple[int, int, int], loss: int) -> None:
        self.pieces.append(item)
        self.tokens += item[2]
        self.loss += loss


def loss_of(item: tuple[int, int, int], masked: dict[int, int]) -> int:
    """Loss-bearing ids of a piece: those from the document's first loss-bearing id on."""
    number, start, length = item
    return max(0, start + length - max(start, masked.get(number, 0)))


def pack_items(items: list[tuple[int, int, int]], limits: Limits, masked: dict[int, int], open_one: Sequence | None = None) -> tuple[list[Sequence], Sequence]:
    """Full sequences and the one still open, for pieces (document number, start, length <= limits.tokens).

    ``masked`` has, by document number, how many of its first ids bear no loss (instruction prompts).
    """
    pools: dict[tuple[int, int], deque] = {}
    for item in items:
        pools.setdefault((item[2], loss_of(item, masked)), deque()).append(item)
    sizes = sorted(pools)
    table = np.array(sizes, dtype=np.float64).reshape(-1, 2)
    count = np.array([len(pools[s]) for s in sizes])
    slot = {s: k for k, s in enumerate(sizes)}
    demand = np.array([(table[:, 0] * count).sum() / limits.tokens, count.sum() / limits.segments, (table[:, 1] * count).sum() / limits.loss_tokens])
    weight = demand / max(demand.sum(), 1e-9) / np.array([limits.tokens, limits.segments, limits.loss_tokens], dtype=np.float64) ** 2
    done: list[Sequence] = []
    now = open_one or Sequence()

    def put_back(item: tuple[int, int, int]) -> None:
        nonlocal table, count
        size = (item[2], loss_of(item, masked))
        if size not in slot:
            slot[size] = len(sizes)
            sizes.append(size)
            table, count = np.vstack([table, size]), np.append(count, 0)
        pools.setdefault(size, deque()).appendleft(item)
        count[slot[size]] += 1

    left = int(count.sum())
    while left:
        room = limits.tokens - now.tokens, limits.segments - len(now.pieces), limits.loss_tokens - now.loss
        if min(room[0], room[1]) <= 0:
            done.append(now)
            now = Sequence()
            continue
        score = table[:, 0] * (weight[0] * room[0]) + weight[1] * room[1] + table[:, 1] * (weight[2] * room[2])
        live = count > 0
        best = int(np.argmax(np.where(live & (table[:, 0] <= room[0]) & (table[:, 1] <= room[2]), score, -1.0)))
        if live[best] and table[best, 0] <= room[0] and table[best, 1] <= room[2]:
            now.add(pools[sizes[best]].popleft(), sizes[best][1])
            count[best] -= 1
            left -= 1
            continue
        best = int(np.argmax(np.where(live, score, -1.0)))
        number, start, length = pools[sizes[best]][0]
        take = min(length, room[0])
        while take and loss_of((number, start, take), masked) > room[2]:
            take -= max(1, loss_of((number, start, take), masked) - room[2])
        if take <= 0:  # no room for a loss-bearing id: the sequence is as full as it can be
            done.append(now)
            now = Sequence()
            continue
        pools[sizes[best]].popleft()
        count[best] -= 1
        left -= 1
        piece = (number, start, take)
        now.add(piece, loss_of(piece, masked))
        if take < length:
            put_back((number, start + take, length - take))
            left += 1
    return done, now


def powers_of_two(last: Sequence) -> list[Sequence]:
    """The pieces of a sequence that isn't full, cut into sequences whose lengths are powers of two."""
    out, pieces, left = [], deque(last.pieces), last.tokens
    while left:
        room = 1 << (left.bit_length() - 1)
        left -= room
        now = Sequence()
        while room:
            number, start, length = pieces.popleft()
            take = min(length, room)
            now.add((number, start, take), 0)
            room -= take
            if take < length:
                pieces.appendleft((number, start + take, length - take))
        out.append(now)
    return out


def pack(docs: DataFrame, limits: Limits = Limits(), vocabulary: str = DEFAULT_VOCABULARY, with_ids: bool = False, prompt_column: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids if asked).

    ``prompt_column`` names a text that stands before ``text`` in a document and bears no loss.
    """
    columns = ["doc_id", "text", *([prompt_column] if prompt_column else [])]
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = token_ids.loaded(vocabulary).encode_all
        end = int(END_ID).to_bytes(4, "little")
        next_id = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        held: dict[int, tuple[int | None, bytes]] = {}  # document number -> doc_id and ids
        masked: dict[int, int] = {}
        opened, number, ids_held = Sequence(), 0, 0
        waiting: list[tuple[int, int, int]] = []

        def rows(sequences: list[Sequence]) -> pa.RecordBatch:
            nonlocal next_id
            out: list[tuple] = []
            pieces: list[bytes] = []
            for s in sequences:
                offset = 0
                for n, start, length in s.pieces:
                    doc_id, raw = held[n]
                    piece = raw[4 * start : 4 * (start + length)]
                    out.append((doc_id, start, length, zlib.crc32(piece), len(raw) // 4, next_id, offset))
                    if with_ids:
                        pieces.append(piece)
                    offset += length
                next_id += 1
            columns = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)]
            if with_ids:
                ends = np.concatenate([[0], np.cumsum([len(p) // 4 for p in pieces])])
                columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(pieces), "<u4").astype(np.int32))))
            return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in schema.split(", ")])

        def flush(last: bool) -> Generator[pa.RecordBatch, None, int]:
            nonlocal opened, waiting
            done, opened = pack_items(waiting, limits, masked, opened)
            waiting = []
            if last:
                done.append(opened)
                opened = Sequence()
            done = [part for s in done for part in ([s] if s.tokens == limits.tokens else powers_of_two(s))]
            for k in range(0, len(done), 512):
                yield rows(done[k : k + 512])
            keep = {n for n, _, _ in opened.pieces}
            for n in [n for n in held if n not in keep]:
                del held[n]
                masked.pop(n, None)
            return sum(len(raw) for _, raw in held.values()) // 4

        for batch in batches:
            ids = batch.column(0).cast(pa.int64()).to_pylist()
            prompts = batch.column(2).cast(pa.large_binary()) if prompt_column else None
            for first, texts in text_slices(batch, "text"):
                leads = encode([prompts[first + k].as_py() or b"" for k in range(len(texts))]) if prompts is not None else None
                for k, raw in enumerate(encode(texts)):
                    if leads is not None and leads[k]:
                        masked[number] = len(leads[k]) // 4
                        raw = leads[k] + raw
                    raw += end
                    held[number] = ids[first + k], raw
                    n = len(raw) // 4
                    whole = n // limits.tokens * limits.tokens if not masked.get(number) else 0
                    for s in range(0, whole, 512 * limits.tokens):
                        yield rows([Sequence([(number, at, limits.tokens)], limits.tokens) for at in range(s, min(whole, s + 512 * limits.tokens), limits.tokens)])
                    while whole < n:
                        waiting.append((number, whole, min(limits.tokens, n - whole)))
                        whole += limits.tokens
                    number += 1
                    ids_held += n
                    if ids_held >= limits.buffer:
                        ids_held = yield from flush(False)
        yield from flush(True)
        release()

    return docs.select(*columns).mapInArrow(run, schema)
