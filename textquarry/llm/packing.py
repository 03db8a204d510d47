"""Packing documents into training sequences: best-fit decreasing with a segment tree.

Documents are tokenised where they are read. An overlong document is first cut into
full windows; the tails of a pool of documents are sorted by decreasing length and
each goes to the open window with the least room that still takes it, which a segment
tree over room sizes finds in log(window) steps. A pool closes after ``pool_tokens``,
so memory does not depend on the size of a task's input; the padding a pool leaves is a
few windows in thousands. There is no shuffle. Sequence ids carry the task's number in their
high bits; reruns over the same files agree.

Edge cases: a null or empty text is the end id alone; repeated rows are packed each
on its own; null doc_ids pass through; an empty table gives no pieces. Only the two named columns
are read.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.llm.tokens import encoder, slices

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, sequence_tokens long"


#: What a worker holds at once: words whose ids it remembers (in each of two generations), bytes of text it cuts into words, pieces it hands on.
REMEMBER, SLICE, ROWS = 100_000, 2 << 20, 1_000


class Rooms:
    """Counts of open windows by room left (0..size), in a segment tree that finds the least room >= a length."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, room: int, window: int) -> None:
        self.open[room].append(window)
        k = room + self.leaves
        while k:
            self.tree[k] += 1
            k >>= 1

    def take(self, length: int) -> tuple[int, int] | None:
        """The tightest open window that takes ``length``: (room, window), removed from the tree; None if there is none."""
        tree, k = self.tree, length + self.leaves
        if not tree[k]:
            while k > 1 and (k & 1 or not tree[k + 1]):  # up until a right sibling holds something
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.leaves:
                k = 2 * k if tree[2 * k] else 2 * k + 1
        room = k - self.leaves
        while k:
            tree[k] -= 1
            k >>= 1
        return room, self.open[room].pop()


def best_fit(lengths: list[int], window: int) -> tuple[list[int], list[int], list[int]]:
    """Best-fit decreasing: each piece's window and offset, and the tokens in each window. Lengths are 1..window."""
    rooms, fill = Rooms(window), []
    where, offset = [0] * len(lengths), [0] * len(lengths)
    for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        n = lengths[k]
        room, w = rooms.take(n) or (window, len(fill))
        if w == len(fill):
            fill.append(0)
        where[k], offset[k] = w, fill[w]
        fill[w] += n
        if room > n:
            rooms.add(room - n, w)
    return where, offset, fill


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 1024, tokenizer: str = "byte_bpe_50k.json", keeps_spaces: bool = True, end_id: int = 0, pool_tokens: int = 1 << 20) -> DataFrame:
    """One row per piece, with its token ids as little-endian unsigned 32-bit integers.

    ``sequence_tokens`` is the number of tokens in the piece's sequence; the sequence is padded from there to ``window``.
    """
    schema = pa.schema([(n, pa.binary() if n == "ids" else pa.int64()) for n in ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "sequence_tokens")])

    def pieces(batches):
        with encoder(tokenizer, keeps_spaces, REMEMBER) as enc:
            yield from pieces_of(batches, enc)

    def pieces_of(batches, enc):
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 40
        pool: list[tuple[int | None, np.ndarray]] = []
        n = used = 0

        def close():
            nonlocal pool, used
            rows: list[tuple] = []
            for d, ids in pool:
                rows += [(d, at, ids[at : at + window], len(ids)) for at in range(0, len(ids), window)]
            where, offset, fill = best_fit([len(r[2]) for r in rows], window)
            for a in range(0, len(rows), ROWS):
                part, at = rows[a : a + ROWS], slice(a, a + ROWS)
                cols = [[r[0] for r in part], [r[1] for r in part], [len(r[2]) for r in part], [r[2].astype("<u4").tobytes() for r in part], [r[3] for r in part], [base + used + w for w in where[at]], offset[at], [fill[w] for w in where[at]]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)
            pool, used = [], used + len(fill)

        for batch in batches:
            for a, b in slices(batch.column("text"), SLICE):
                part = batch.slice(a, b - a)
                ids, at = enc.encode(part.column("text"))
                for d, x, y in zip(part.column("doc_id").to_pylist(), at[:-1], at[1:], strict=True):
                    pool.append((d, np.append(ids[x:y], np.uint32(end_id))))
                    n += y - x + 1
                    if n >= pool_tokens:
                        yield from close()
                        n = 0
        if pool:
            yield from close()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(pieces, PIECES)
