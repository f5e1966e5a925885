"""Token counts by a finite-state transducer over characters.

A sequence of pieces is the encoding of its text exactly if each piece encodes to itself and each
two neighbours encode to themselves side by side: the first merge across a boundary would also be
made in the two neighbours alone. So the encoding of every prefix is that of a shorter prefix and
one more piece, and there is one such piece. A state holds the starts from which a piece may still
reach past the place read (what has been read since is the beginning of a piece), each with the
piece before it and its count; a transition on a character settles the prefix that it ends and emits
the change of the count. States and transitions are compiled from the model when first needed and
kept in a bounded table. Where no piece joins two characters, every state goes to the same one, the
start; paths from one such place to the next are kept as single transitions, in a table of their own.

A chunk of a text is a map from states to states. It is stored for every start a piece might have
that reaches into the chunk, and every start from which one might leave it, as the first piece, the
last piece and the count between; a state entering picks the starts that fit. Its size is bounded by
the longest piece whatever the chunk's length. Maps compose associatively, by a prefix scan.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagequarry.llm.common import map_batches, slices, worker_cache
from pagequarry.llm.sp_model import Memo, PieceModel, load

CHUNK_CHARS = 1 << 16
# Texts of more bytes are counted chunk by chunk in different tasks.
SPREAD_BYTES = 1 << 20
MOST_STATES = 300_000
# Characters after which two runs over a chunk are no longer looked at for meeting in one state.
MEETING = 4096


class Span(NamedTuple):
    """The encoding between two starts: first and last piece (None: joins with nothing that may
    follow) and the number of tokens."""

    first: str
    tokens: int
    last: str | None


# Entry (what has been read of the piece that reaches in) to exit (the same at the end) to span.
ChunkMap = dict[str, dict[str, Span]]


class State(dict):
    """Transitions by character: (next state, change of the number of tokens).

    ``live``: (characters read since a possible start, piece before that start or None if it cannot
    join, tokens up to the start less tokens up to here); the last entry is the place itself.
    """

    __slots__ = ("live", "machine")

    def __init__(self, live: tuple, machine: Transducer):
        super().__init__()
        self.live, self.machine = live, machine

    def __missing__(self, char: str) -> tuple[State, int]:
        step = self[char] = self.machine.step(self.live, char)
        return step


class Transducer:
    def __init__(self, model: PieceModel, most: int = MOST_STATES):
        self.model, self.most = model, most
        self.longest = max(map(len, model.ids), default=1)
        self.beginnings = {p[:n] for p in model.ids for n in range(1, len(p))}
        self.joins = {p[i : i + 2] for p in model.ids for i in range(len(p) - 1)}
        self.whole = Memo(lambda piece: model.merge(piece) == [piece])
        self.side_by_side = Memo(lambda pair: model.merge(pair[0] + pair[1]) == list(pair))
        self.states: dict[tuple, State] = {}
        self.start = State((("", None, 0),), self)
        self.paths = Memo(self.walk)

    def tokens(self, piece: str) -> int:
        return 1 if piece in self.model.ids else len(piece.encode("utf-8", "surrogatepass"))

    def fits(self, before: str | None, piece: str) -> bool:
        """Whether ``piece`` may follow ``before`` in an encoding."""
        return before is None or before[-1] + piece[0] not in self.joins or self.side_by_side[before, piece]

    def step(self, live: tuple, char: str) -> tuple[State, int]:
        before = live[-1][1]
        if before is not None and before[-1] + char not in self.joins:
            return self.start[char]
        found, going = None, []
        for read, before, tokens in live:
            piece = read + char
            if found is None and (not read or piece in self.model.ids and self.whole[piece]) and self.fits(before, piece):
                found = piece, tokens + self.tokens(piece)
            if piece in self.beginnings:
                going.append((piece, before, tokens))
        piece, change = found
        return self.state((*((r, b, t - change) for r, b, t in going), ("", piece, 0))), change

    def state(self, live: tuple) -> State:
        known = self.states.get(live)
        if known is None:
            if len(self.states) >= self.most:
                self.forget()
            known = self.states[live] = State(live, self)
        return known

    def forget(self) -> None:
        """Drop all transitions; they are compiled anew when needed."""
        for state in self.states.values():
            state.clear()
        self.states.clear()
        self.start.clear()

    def count(self, text: str) -> int:
        """Tokens of a normalised text, path by path."""
        return sum(map(self.paths.__getitem__, self.model.units(text)))

    def walk(self, text: str) -> int:
        """The same, character by character."""
        state, tokens = self.start, 0
        for char in text:
            state, change = state[char]
            tokens += change
        return tokens

    def text_count(self, text: str) -> int:
        return self.count(self.model.normaliser.text(text))

    def cuts(self, size: int, width: int) -> list[int]:
        """Where the chunks of a text begin, and its end; no chunk but the last is shorter than the
        longest piece."""
        return [*range(0, size, max(width, self.longest)), size] if size else [0]

    def entries(self, text: str, cut: int) -> list[str]:
        """What may have been read of a piece that reaches over the cut, the shortest first."""
        near = text[max(cut - self.longest + 1, 0) : cut]
        return ["", *(near[-n:] for n in range(1, len(near) + 1) if near[-n:] in self.beginnings)]

    def chunk(self, text: str, begin: int, end: int) -> ChunkMap:
        """The map of ``text[begin:end]``; of the text around it, only what a piece before ``begin``
        may cover is read. The end of the text has one exit, the place itself."""
        found: ChunkMap = {}
        base: list[tuple[State, int]] = []
        base_spans: dict[str, Span] = {}
        for read in self.entries(text, begin) if begin else [""]:
            spans, met = self._run(text, begin - len(read), begin, end, base)
            if met is not None:  # from here on it is the first run, some tokens apart
                first, apart = met
                spans = {left: Span(first, s.tokens + apart, s.last) for left, s in base_spans.items()}
            if not read:
                base_spans = spans
            spans = {left: span for left, span in spans.items() if len(span.first) > len(read)}
            if end == len(text):
                spans = {left: span for left, span in spans.items() if not left}
            if spans:
                found[read] = spans
        return found

    def _run(self, text: str, start: int, begin: int, end: int, base: list[tuple[State, int]]):
        """Spans from ``start`` to every exit at ``end``, or the first piece and the difference to
        the run in ``base``, once both are in the same state and both first pieces are settled.
        ``base`` is filled by the run that begins at ``begin``: state and tokens after each of the
        first characters, None while its first piece is open."""
        state, tokens, at = self.start, 0, start
        firsts: list[str] = []  # of the prefix that ends after each character, until all agree
        settled = None
        while at < end:
            state, change = state[text[at]]
            tokens += change
            at += 1
            if settled is None:
                piece = state.live[-1][1]
                firsts.append(piece if len(piece) == at - start else firsts[at - start - len(piece) - 1])
                starts = {at - start - len(read) for read, _, _ in state.live}
                agreed = {firsts[n - 1] if n else None for n in starts}
                if len(agreed) == 1:
                    settled = agreed.pop()
            elif start != begin and at - begin > MEETING:
                break
            passed = at - begin
            if start == begin and passed <= MEETING:
                base.append((state if settled is not None else None, tokens))
            elif settled is not None and 0 < passed <= len(base) and base[passed - 1][0] is state:
                return {}, (settled, tokens - base[passed - 1][1])
        for char in text[at:end]:
            state, change = state[char]
            tokens += change
        spans = {}
        for read, last, ahead in state.live:
            n = end - start - len(read)
            if n > 0:
                spans[read] = Span(settled if settled is not None else firsts[n - 1], tokens + ahead, last)
        return spans, None

    def compose(self, a: ChunkMap, b: ChunkMap) -> ChunkMap:
        """The map of ``a``'s text followed by ``b``'s."""
        out: ChunkMap = {}
        for read, spans in a.items():
            through = {}
            for over, left in spans.items():
                for exit_, right in b.get(over, {}).items():
                    if self.fits(left.last, right.first):
                        through[exit_] = Span(left.first, left.tokens + right.tokens, right.last)
            if through:
                out[read] = through
        return out

    def scan(self, maps: list[ChunkMap]) -> list[ChunkMap]:
        """All prefixes composed, in as many rounds as the number of chunks has binary digits; the
        compositions of a round don't depend on each other."""
        maps, step = list(maps), 1
        while step < len(maps):
            maps = maps[:step] + [self.compose(maps[i - step], maps[i]) for i in range(step, len(maps))]
            step *= 2
        return maps

    def chunk_counts(self, text: str, width: int = CHUNK_CHARS) -> list[int]:
        """Tokens of the text up to the end of each chunk, as if it ended there; the last is the
        text's own count."""
        text = self.model.normaliser.text(text)
        cuts = self.cuts(len(text), width)
        return [m[""][""].tokens for m in self.scan([self.chunk(text, a, b) for a, b in zip(cuts, cuts[1:])])]


def pack_map(found: ChunkMap) -> bytes:
    return pickle.dumps({read: {left: tuple(span) for left, span in spans.items()} for read, spans in found.items()})


def unpack_map(packed: bytes) -> ChunkMap:
    return {read: {left: Span(*span) for left, span in spans.items()} for read, spans in pickle.loads(packed).items()}


def _machine(content: bytes) -> Transducer:
    cache = worker_cache("transducers")
    if "machine" not in cache or cache["of"] != hash(content):
        cache["machine"], cache["of"] = Transducer(load(content, {})), hash(content)
    return cache["machine"]


def _n_bytes(text: str | None) -> int:
    return len(text.encode("utf-8", "surrogatepass")) if text else 0


def count_tokens(
    docs: DataFrame,
    model: bytes,
    text: str = "text",
    id_col: str = "doc_id",
    width: int = CHUNK_CHARS,
    spread: int = SPREAD_BYTES,
) -> DataFrame:
    """Tokens of every whole text under a SentencePiece BPE ``model`` (the file's content).

    Returns the id, n_bytes and n_tokens, one row per input row. A null text counts as empty (0 and
    0); repeated rows are counted each; an empty table gives no rows; other columns are ignored. A
    text of up to ``spread`` bytes is read through in its own task, without a shuffle. A longer one
    becomes rows of ``width`` characters, which are compiled to chunk maps wherever they land; a
    task then scans the maps of a text, some hundred bytes each. The table is read once for each of
    the two. A scan of the table must number its rows alike when it is repeated, as files do.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType
    rows = docs.selectExpr(f"`{id_col}` AS id", f"`{text}` AS text")
    size = F.coalesce(F.octet_length("text"), F.lit(0))

    def schema(*more: T.StructField) -> T.StructType:
        return T.StructType([T.StructField("doc_id", kind), T.StructField("n_bytes", T.LongType()), *more])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _machine(shared.value)
        for batch in slices(batches, "text"):
            texts = batch.column("text").to_pylist()
            tokens = [machine.text_count(t) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(map(_n_bytes, texts), pa.int64()), pa.array(tokens, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _machine(shared.value)
        reach = machine.longest - 1
        for batch in slices(batches, "text"):
            for i, whole in enumerate(batch.column("text").to_pylist()):
                normal = machine.model.normaliser.text(whole)
                cuts = machine.cuts(len(normal), width)
                ids, row, n_bytes = batch.column("id").slice(i, 1), batch.column("row").slice(i, 1), _n_bytes(whole)
                for part, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    context = min(a, reach)
                    arrays = [
                        ids, pa.array([n_bytes], pa.int64()), row, pa.array([part], pa.int32()),
                        pa.array([context], pa.int32()), pa.array([b == len(normal)]),
                        pa.array([normal[a - context : b]], pa.string()),
                    ]
                    yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_bytes", "row", "part", "context", "last", "text"])

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _machine(shared.value)
        for batch in slices(batches, "text"):
            maps = []
            # A character after the chunk says that the text goes on; nothing else of it is read.
            for piece, begin, last in zip(*(batch.column(c).to_pylist() for c in ("text", "context", "last"))):
                end = len(piece)
                maps.append(pack_map(machine.chunk(piece if last else piece + "\0", begin, end)))
            columns = {c: batch.column(c) for c in ("doc_id", "n_bytes", "row", "part")}
            yield pa.RecordBatch.from_arrays([*columns.values(), pa.array(maps, pa.binary())], [*columns, "map"])

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _machine(shared.value)
        for batch in batches:
            tokens = []
            for maps in batch.column("maps").to_pylist():
                whole = machine.scan([unpack_map(m["map"]) for m in maps])[-1]
                tokens.append(whole[""][""].tokens)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(tokens, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    result = schema(T.StructField("n_tokens", T.LongType()))
    place = (T.StructField("row", T.LongType()), T.StructField("part", T.IntegerType()))
    here = map_batches(rows.where(size <= spread), counted, result)
    chunks = map_batches(
        rows.withColumn("row", F.monotonically_increasing_id()).where(size > spread),
        cut,
        schema(
            *place,
            T.StructField("context", T.IntegerType()),
            T.StructField("last", T.BooleanType()),
            T.StructField("text", T.StringType()),
        ),
        rows=16,
    )
    maps = map_batches(chunks.repartition("row", "part"), mapped, schema(*place, T.StructField("map", T.BinaryType())))
    by_text = maps.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("n_bytes").alias("n_bytes"),
        F.sort_array(F.collect_list(F.struct("part", "map"))).alias("maps"),
    )
    return here.unionByName(map_batches(by_text.select("doc_id", "n_bytes", "maps"), scanned, result, rows=16))
