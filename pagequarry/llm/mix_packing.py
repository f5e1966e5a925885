"""Packing documents into training windows of fixed length, mixed by deficit round-robin.

Every source is a queue of tokens. In each round a queue's credit grows by its quantum, its target
share of a window; it sends as many whole tokens as it has credit for, and the rest, its deficit, is
carried to the next round. A queue that has run dry leaves, and the quanta of the others grow in
proportion. What the rounds send is one stream, and windows are cut from it end to end, so only the
very last one can be short.

The credit of a queue after any round is a number known from the quanta alone (fixed-point, one
line per phase between two queues running dry). So each document finds its rounds and windows by
itself: the deficits that a partition carries in are computed, not waited for, and tokens are never
shuffled.

Where there are many sources the schedule is a tree: the largest have queues of their own, and the
others' queues are streams that a deficit round-robin of the same kind has mixed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagequarry.llm import byte_bpe
from pagequarry.llm.common import map_batches, slices, stash, worker_cache

WINDOW = 2048
# Queues of one round-robin; where there are more sources, some of its queues are round-robins themselves.
MOST_QUEUES = 256
# Numbers in a table of rounds by queues; more rounds are looked at one part after the other.
_CELLS = 1 << 21
# Compiled schedules that a task keeps.
_SCHEDULES = 64
# Rows of the table of queue offsets that may be sent to every executor; more are joined by shuffle.
BROADCAST_ROWS = 500_000
_POINT = 16


class Schedule:
    """The rounds in closed form: for each phase its first round, and per queue the credit at its
    start and the quantum (tokens times 2**16)."""

    def __init__(self, totals: list[int], shares: list[float], window: int = WINDOW):
        self.totals = np.array(totals, np.int64)
        full = self.totals << _POINT
        weights = np.array([s if n else 0.0 for s, n in zip(shares, totals)], float)
        weights[(self.totals > 0) & ~(weights > 0)] = 1e-9  # what is not wanted comes last, but comes
        rounds, credits, quanta = [0], [np.zeros(len(totals), np.int64)], []
        while True:
            left = full - credits[-1]
            active = left > 0
            if not active.any():
                break
            part = np.where(active, weights, 0.0)
            quantum = np.where(active, np.maximum(1, np.rint(part / part.sum() * (window << _POINT))), 0).astype(np.int64)
            steps = int(np.min(-(-left[active] // quantum[active])))
            quanta.append(quantum)
            rounds.append(rounds[-1] + steps)
            credits.append(np.minimum(full, credits[-1] + steps * quantum))
        self.rounds = np.array(rounds, np.int64)
        self.credits = np.array(credits)
        self.quanta = np.array([*quanta, np.zeros(len(totals), np.int64)])

    def sent(self, rounds: np.ndarray) -> np.ndarray:
        """Tokens that each queue has sent before each of ``rounds``."""
        phase = np.searchsorted(self.rounds, rounds, "right") - 1
        credit = self.credits[phase] + (rounds - self.rounds[phase])[:, None] * self.quanta[phase]
        return np.minimum(credit >> _POINT, self.totals)

    def round_of(self, queue: np.ndarray, token: np.ndarray) -> np.ndarray:
        """The round in which a queue sends its token of that number."""
        credit = (token + 1) << _POINT
        found = np.zeros(len(token), np.int64)
        for q in np.unique(queue):
            mine = queue == q
            phase = np.searchsorted(self.credits[:, q], credit[mine], "left") - 1
            missing = credit[mine] - self.credits[phase, q]
            found[mine] = self.rounds[phase] + -(-missing // np.maximum(1, self.quanta[phase, q])) - 1
        return found

    def _turns(self, queue: np.ndarray, base: np.ndarray, length: np.ndarray):
        """Every document with each round that sends a token of it, in the documents' order."""
        first = self.round_of(queue, base)
        count = self.round_of(queue, base + length - 1) - first + 1
        slow = count > length  # rounds without a token: better looked up from the tokens
        steps = np.where(slow, length, count)
        doc = np.repeat(np.arange(len(queue)), steps)
        ranks = np.arange(len(doc)) - np.repeat(np.cumsum(steps) - steps, steps)
        turn = first[doc] + ranks
        if slow.any():
            own = slow[doc]
            turn[own] = self.round_of(queue[doc[own]], base[doc[own]] + ranks[own])
            new = np.ones(len(doc), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (turn[1:] != turn[:-1])
            doc, turn = doc[new], turn[new]
        return doc, turn

    def pieces(self, queue: np.ndarray, base: np.ndarray, length: np.ndarray):
        """Cut documents (their queue, first token there, tokens) at the rounds.

        Returns per piece: document, start and length in it, and place in the stream of all queues;
        in the documents' order.
        """
        doc, turn = self._turns(queue, base, length)
        turns, back = np.unique(turn, return_inverse=True)
        mine = queue[doc]
        before, after, place = (np.zeros(len(doc), np.int64) for _ in range(3))
        order = np.argsort(back, kind="stable")
        step = max(1, _CELLS // max(1, len(self.totals)))
        for low in range(0, len(turns), step):
            some = turns[low : low + step]
            at = order[np.searchsorted(back[order], low) : np.searchsorted(back[order], low + len(some))]
            row, col = back[at] - low, mine[at]
            sent, then = self.sent(some), self.sent(some + 1)
            sizes = then - sent
            before[at], after[at] = sent[row, col], then[row, col]
            place[at] = (sent.sum(1)[:, None] + np.cumsum(sizes, 1) - sizes)[row, col]
        begin = np.maximum(base[doc], before)
        end = np.minimum(base[doc] + length[doc], after)
        keep = end > begin
        at = place + begin - before
        return doc[keep], (begin - base[doc])[keep], (end - begin)[keep], at[keep]


def windows(doc: np.ndarray, start: np.ndarray, length: np.ndarray, at: np.ndarray, window: int = WINDOW):
    """Cut pieces that reach into the next windows at each; neighbours in the document that are
    neighbours in one window become one piece. Same columns as ``Schedule.pieces``."""
    if not len(doc):
        return doc, start, length, at
    spans = (at + length - 1) // window - at // window + 1
    which = np.repeat(np.arange(len(doc)), spans)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(spans) - spans, spans)
    low = np.maximum(at[which], (at[which] // window + nth) * window)
    high = np.minimum((at + length)[which], (low // window + 1) * window)
    doc, start = doc[which], start[which] + (low - at[which])
    size = high - low
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (low[1:] != high[:-1]) | (low[1:] // window != low[:-1] // window)
    firsts = np.flatnonzero(new)
    return doc[firsts], start[firsts], np.add.reduceat(size, firsts), low[firsts]


class Tree:
    """Round-robins of at most ``most`` queues each, node 0 on top.

    In a node with more sources than that, the half with the largest shares have a queue each. The
    others are put together by how long they last at their share, so that those that share a queue
    run dry at about the same time, and those without a share are among themselves. A node's round is
    as long as what it has of a window, so every window holds a round of every node.
    """

    def __init__(self, totals: list[int], shares: list[float], most: int, window: int = WINDOW):
        if most < 2:
            raise ValueError("a round-robin needs at least two queues")
        tokens, weight = np.array(totals, np.int64), np.maximum(0.0, np.array(shares, float))
        lasts = np.divide(tokens, weight, out=np.full(len(tokens), np.inf), where=weight > 0)
        # Per source its node and queue there; per node the one above and its queue there, and what its queues hold.
        self.node, self.queue = np.zeros(len(tokens), np.int64), np.zeros(len(tokens), np.int64)
        self.above, self.place, self.totals, self.shares, self.rounds = [0], [0], [None], [None], [window]
        todo = [(0, np.arange(len(tokens)))]
        while todo:
            node, members = todo.pop()
            groups = [members[i : i + 1] for i in range(len(members))]
            if len(members) > most:
                ranked = members[np.argsort(-weight[members], kind="stable")]
                wanted = int((weight[ranked] > 0).sum())
                own = min(most // 2, wanted) if wanted else most // 2
                if own < wanted < len(members) and most - own < 2:
                    own -= 1
                rest = ranked[own:]
                rest = rest[np.argsort(lasts[rest], kind="stable")]
                split, slots = max(0, wanted - own), most - own
                if 0 < split < len(rest):
                    some = min(slots - 1, max(1, round(slots * split / len(rest))))
                    shared = [*np.array_split(rest[:split], some), *np.array_split(rest[split:], slots - some)]
                else:
                    shared = np.array_split(rest, slots)
                groups = [ranked[i : i + 1] for i in range(own)] + [g for g in shared if len(g)]
            self.totals[node] = [int(tokens[g].sum()) for g in groups]
            self.shares[node] = [float(weight[g].sum()) for g in groups]
            spare = self.shares[node].count(0.0)
            whole = sum(self.shares[node])
            for at, group in enumerate(groups):
                if len(group) == 1:
                    self.node[group], self.queue[group] = node, at
                else:
                    todo.append((len(self.above), group))
                    self.above.append(node)
                    self.place.append(at)
                    self.totals.append(None)
                    self.shares.append(None)
                    part = self.shares[node][at] / whole if self.shares[node][at] else 1 / spare
                    self.rounds.append(max(1, round(self.rounds[node] * part)))

    def top(self) -> np.ndarray:
        """The queue of the top node that each source is in."""
        node, queue = self.node.copy(), self.queue.copy()
        while (inner := node > 0).any():
            queue[inner] = np.array(self.place)[node[inner]]
            node[inner] = np.array(self.above)[node[inner]]
        return queue

    def pieces(self, schedule, source: np.ndarray, base: np.ndarray, length: np.ndarray):
        """As ``Schedule.pieces`` for documents of sources: a piece in the stream of a node is a
        document of a queue in the node above. ``schedule`` gives a node's schedule."""
        doc, start = np.arange(len(source)), np.zeros(len(source), np.int64)
        rows = [doc, start, length, base, self.node[source], self.queue[source]]
        while (inner := rows[4] > 0).any():
            parts = [[r[~inner] for r in rows]]
            for node in np.unique(rows[4][inner]):
                doc, start, length, base, _, queue = (r[rows[4] == node] for r in rows)
                which, begin, size, at = schedule(int(node)).pieces(queue, base, length)
                up = [np.full(len(which), v[node], np.int64) for v in (self.above, self.place)]
                parts.append([doc[which], start[which] + begin, size, at, *up])
            rows = [np.concatenate(r) for r in zip(*parts)]
        order = np.lexsort((rows[1], rows[0]))
        doc, start, length, base, _, queue = (r[order] for r in rows)
        which, begin, size, at = schedule(0).pieces(queue, base, length)
        return doc[which], start[which] + begin, size, at


def tokenised(docs: DataFrame, source: str, tokenizer: bytes, end_id: int, text: str, id_col: str) -> DataFrame:
    """part, source, doc_id, n, ids (packed), before: tokens of this source earlier in this partition."""
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer)
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe.load(shared.value, worker_cache("byte_bpe"))
        part, sent, end = TaskContext.get().partitionId(), {}, np.array([end_id], bpe.kind).tobytes()
        for batch in slices(batches, "text"):
            packed = [bpe.encode(t or "") + end for t in batch.column("text").to_pylist()]
            sizes = [len(p) // bpe.kind.itemsize for p in packed]
            before = []
            for q, n in zip(batch.column("source").to_pylist(), sizes):
                before.append(sent.get(q, 0))
                sent[q] = before[-1] + n
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([part] * len(sizes), pa.int32()),
                    batch.column("source"),
                    batch.column("id"),
                    pa.array(sizes, pa.int64()),
                    pa.array(before, pa.int64()),
                    pa.array(packed, pa.binary()),
                ],
                ["part", "source", "doc_id", "n", "before", "ids"],
            )

    schema = T.StructType(
        [
            T.StructField("part", T.IntegerType()),
            T.StructField("source", T.StringType()),
            T.StructField("doc_id", kind),
            T.StructField("n", T.LongType()),
            T.StructField("before", T.LongType()),
            T.StructField("ids", T.BinaryType()),
        ]
    )
    return map_batches(
        docs.select(F.col(id_col).alias("id"), F.col(source).cast("string").alias("source"), F.col(text).alias("text")),
        run,
        schema,
    )


def pack(
    docs: DataFrame,
    tokenizer: bytes,
    targets: dict[str | None, float] | None = None,
    window: int = WINDOW,
    end_id: int = 1,
    text: str = "text",
    id_col: str = "doc_id",
    source: str = "source",
    most_queues: int = MOST_QUEUES,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """All documents, tokenised, cut and packed into windows of ``window`` tokens.

    ``targets`` gives each source's share of a window; without it, each source has its share of all
    tokens, so all run dry together. Every document ends with ``end_id``, every id is in exactly one
    piece, and every window but the last is full. Returns per piece doc_id, queue, start, length,
    doc_tokens, sequence_id, offset and ids (binary, little-endian unsigned 32-bit). A null or empty
    text is its end id alone; null sources are a queue like others, repeated rows are packed each,
    an empty table gives no rows, other columns are ignored. With more than ``most_queues`` sources
    the smaller ones are mixed by round-robins of their own (see ``Tree``), whose streams share the
    queues; ``queue`` is the one on top. The driver holds a row per source.
    """
    spark = docs.sparkSession
    held = stash(tokenised(docs, source, tokenizer, end_id, text, id_col), "tokens")
    sums = stash(held.groupBy("source", "part").agg(F.sum("n").alias("sum")), "token-sums")
    counts = [tuple(r) for r in sums.groupBy("source").agg(F.sum("sum")).collect()]
    counts.sort(key=lambda c: (c[0] is None, c[0]))
    names, totals = [c[0] for c in counts], [c[1] for c in counts]
    shares = [float(targets.get(name, 0.0)) for name in names] if targets else [float(n) for n in totals]
    tree = Tree(totals, shares, most_queues, window)
    top = tree.top().tolist()
    numbers = spark.createDataFrame(list(zip(names, range(len(names)), top)), "name string, number int, queue int")
    shared = spark.sparkContext.broadcast(tree)
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("source", F.col("part").alias("at"), F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("first"))
    if len(names) <= broadcast_rows:
        numbers = F.broadcast(numbers)
    bases = bases.join(numbers, F.col("source").eqNullSafe(F.col("name"))).select("name", "at", "first", "number", "queue")
    bases = stash(bases, "token-bases")
    if bases.count() <= broadcast_rows:
        bases = F.broadcast(bases)
    kind = docs.schema[id_col].dataType
    ids_kind = "<u2" if _narrow(tokenizer) else "<u4"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value
        schedule = lru_cache(_SCHEDULES)(lambda node: Schedule(tree.totals[node], tree.shares[node], tree.rounds[node]))
        for batch in slices(batches, "ids", 4 << 20):
            sources, base, sizes = (
                batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("number", "base", "n")
            )
            doc, start, length, at = windows(*tree.pieces(schedule, sources, base, sizes), window)
            # Pieces come in the documents' order, so they are one array of ids, cut at their lengths.
            ids = np.concatenate([np.frombuffer(b, ids_kind) for b in batch.column("ids").to_pylist()]).astype("<u4")
            offsets = np.concatenate([[0], np.cumsum(length) * 4])
            which = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(which),
                    batch.column("queue").take(which),
                    pa.array(start),
                    pa.array(length),
                    batch.column("n").take(which),
                    pa.array(at // window),
                    pa.array(at % window),
                    pa.Array.from_buffers(
                        pa.binary(), len(doc), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(ids.tobytes())]
                    ),
                ],
                ["doc_id", "queue", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
            )

    longs = ["start", "length", "doc_tokens", "sequence_id", "offset"]
    schema = T.StructType(
        [T.StructField("doc_id", kind), T.StructField("queue", T.IntegerType())]
        + [T.StructField(c, T.LongType()) for c in longs]
        + [T.StructField("ids", T.BinaryType())]
    )
    same = F.col("source").eqNullSafe(F.col("name")) & (F.col("part") == F.col("at"))
    placed = held.join(bases, same).select(
        "doc_id", "queue", "number", (F.col("first") + F.col("before")).alias("base"), "n", "ids"
    )
    return map_batches(placed, cut, schema)


def _narrow(tokenizer: bytes) -> bool:
    import json

    return max(json.loads(tokenizer)["model"]["vocab"].values()) < 1 << 16
