"""Operator 10: hierarchical multi-length packing.

Documents are routed to context-size tiers by their token count, each tier is packed into windows of its
own size, the gaps of long windows are filled from the shorter tiers, and the windows of a tier are dealt
to step groups of equal token count and nearly equal attention cost.

Everything happens inside the partitions of the input: no rows are shuffled, so no key can be hot. A task
holds one pool of about ``pool_tokens`` tokens and what the pool before it has left.

Defined cases: a null text is an empty one, which has the end id alone; repeated rows and repeated or null
doc_ids are documents of their own; an empty table gives no rows; other columns are not read. A document of
any length is cut into windows of the longest tier and one remainder. The last tokens of a partition fill
windows whose sizes are powers of two, so no sequence is padded.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens

TIERS = (1024, 512, 256)
END_ID = 0
STEP_TOKENS = 16 * 1024
POOL_TOKENS = 1 << 20

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, context_size int, step_group long"


@dataclass
class Document:
    doc_id: int | None
    ids: bytes  # little-endian unsigned 32-bit

    @property
    def n(self) -> int:
        return len(self.ids) // 4


@dataclass
class Piece:
    doc: Document
    start: int
    length: int

    def cut(self, length: int) -> tuple[Piece, Piece]:
        return Piece(self.doc, self.start, length), Piece(self.doc, self.start + length, self.length - length)


@dataclass
class Pool:
    """Pieces by length; ``take`` gives the longest that is not over a bound."""

    by_length: dict[int, list[Piece]] = field(default_factory=dict)
    mask: int = 0
    tokens: int = 0

    def add(self, piece: Piece) -> None:
        self.by_length.setdefault(piece.length, []).append(piece)
        self.mask |= 1 << piece.length
        self.tokens += piece.length

    def _pop(self, length: int) -> Piece:
        pieces = self.by_length[length]
        piece = pieces.pop()
        if not pieces:
            del self.by_length[length]
            self.mask &= ~(1 << length)
        self.tokens -= length
        return piece

    def take(self, most: int) -> Piece | None:
        if found := self.mask & ((1 << (most + 1)) - 1):
            return self._pop(found.bit_length() - 1)
        return None

    def shortest(self) -> Piece | None:
        return self._pop((self.mask & -self.mask).bit_length() - 1) if self.mask else None


class Packer:
    """Packs one stream of documents. ``sequences`` are (context size, pieces)."""

    def __init__(self, tiers: tuple[int, ...] = TIERS):
        assert tiers and all(t & (t - 1) == 0 for t in tiers), "context sizes are powers of two"
        self.tiers = sorted(tiers, reverse=True)
        self.pools = {t: Pool() for t in self.tiers}

    def route(self, doc: Document) -> Iterator[tuple[int, list[Piece]]]:
        """Whole windows of the longest tier leave at once; the remainder goes to the smallest tier that holds it."""
        longest, whole = self.tiers[0], Piece(doc, 0, doc.n)
        while whole.length >= longest:
            head, whole = whole.cut(longest)
            yield longest, [head]
        if whole.length:
            self.pools[min(t for t in self.tiers if t >= whole.length)].add(whole)

    def _fill(self, window: list[Piece], gap: int, pools: list[Pool]) -> None:
        """Whole pieces as long as any fits, the longest first; then one piece is cut to close the gap."""
        while gap:
            for pool in pools:
                if piece := pool.take(gap):
                    window.append(piece)
                    gap -= piece.length
                    break
            else:
                pool = next(p for p in reversed(pools) if p.mask)
                head, rest = pool.shortest().cut(gap)
                window.append(head)
                self.pools[min(t for t in self.tiers if t >= rest.length)].add(rest)
                return

    def pack(self) -> Iterator[tuple[int, list[Piece]]]:
        """Full windows, tier by tier, as long as the pieces at hand fill them."""
        for i, tier in enumerate(self.tiers):
            pools = [self.pools[t] for t in self.tiers[i:]]
            while pools[0].mask and sum(p.tokens for p in pools) >= tier:
                first = pools[0].take(tier)
                window = [first]
                self._fill(window, tier - first.length, pools)
                yield tier, window

    def rest(self) -> Iterator[tuple[int, list[Piece]]]:
        """What is left, cut into windows whose sizes are powers of two."""
        yield from self.pack()
        left = [p for t in self.tiers for n in sorted(self.pools[t].by_length, reverse=True) for p in self.pools[t].by_length[n]]
        self.pools = {t: Pool() for t in self.tiers}
        total = sum(p.length for p in left)
        while total:
            size = min(self.tiers[0], 1 << (total.bit_length() - 1))
            total -= size
            window: list[Piece] = []
            gap = size
            while gap:
                piece = left.pop(0)
                if piece.length > gap:
                    piece, tail = piece.cut(gap)
                    left.insert(0, tail)
                window.append(piece)
                gap -= piece.length
            yield size, window


def step_groups(sequences: list[tuple[int, list[Piece]]], step_tokens: int) -> list[int]:
    """The step of each sequence, from 0: equal tokens in each step of a context size, costs dealt out in a snake."""
    steps, base = [0] * len(sequences), 0
    for size in sorted({s for s, _ in sequences}, reverse=True):
        mine = [i for i, (s, _) in enumerate(sequences) if s == size]
        n = max(1, -(-len(mine) * size // step_tokens))
        mine.sort(key=lambda i: -sum(p.length**2 for p in sequences[i][1]))
        for k, i in enumerate(mine):
            turn, at = divmod(k, n)
            steps[i] = base + (at if turn % 2 == 0 else n - 1 - at)
        base += n
    return steps


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    tiers: tuple[int, ...] = TIERS,
    end_id: int = END_ID,
    step_tokens: int = STEP_TOKENS,
    pool_tokens: int = POOL_TOKENS,
    with_ids: bool = True,
) -> DataFrame:
    """A row for each piece of a document (columns doc_id, text), with its ids if ``with_ids``.

    sequence_id and step_group hold the partition in their upper bits.
    """
    names = [c.split(" ")[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, packer, tail = tokens.library_cache(tokenizer_path, tokens.KEPT_FEW), Packer(tiers), int(end_id).to_bytes(4, "little")
        base = TaskContext.get().partitionId() << 33
        counts = {"sequence": 0, "step": 0}

        def rows(sequences: list[tuple[int, list[Piece]]]) -> pa.RecordBatch:
            columns: dict[str, list] = {name: [] for name in names}
            ids: list[bytes] = []
            steps = step_groups(sequences, step_tokens)
            for (size, pieces), step in zip(sequences, steps, strict=True):
                offset = 0
                for piece in pieces:
                    own = piece.doc.ids[4 * piece.start : 4 * (piece.start + piece.length)]
                    row = (piece.doc.doc_id, piece.start, piece.length, tokens.crc32_of(own), piece.doc.n, base + counts["sequence"], offset, size, base + counts["step"] + step)
                    for column, value in zip(columns.values(), row, strict=True):
                        column.append(value)
                    if with_ids:
                        ids.append(own)
                    offset += piece.length
                counts["sequence"] += 1
            counts["step"] += max(steps, default=-1) + 1
            arrays = [pa.array(v, pa.int32() if k == "context_size" else pa.int64()) for k, v in columns.items()]
            if with_ids:
                ends = [0]
                for x in ids:
                    ends.append(ends[-1] + len(x) // 4)
                arrays.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(b"".join(ids))])))
            return pa.RecordBatch.from_arrays(arrays, names + ["ids"] * with_ids)

        ready: list[tuple[int, list[Piece]]] = []
        held = 0
        for batch in batches:
            doc_ids, column = batch.column(0).to_pylist(), batch.column(1)
            for begin, end in tokens.slices(column):
                for doc_id, ids in zip(doc_ids[begin:end], cache.encode(tokens.texts_of(column, begin, end)), strict=True):
                    doc = Document(doc_id, ids + tail)
                    held += doc.n
                    ready += packer.route(doc)
                    if held >= pool_tokens:
                        yield rows([*ready, *packer.pack()])
                        ready, held = [], 0
        yield rows([*ready, *packer.rest()])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, SCHEMA + ", ids array<int>" * with_ids)
