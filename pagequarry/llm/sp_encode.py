"""SentencePiece encoding that keeps offsets, and decoding.

A text is normalised by longest prefix through the model's character map, which records where each
resulting character comes from. The normalised text is encoded unit by unit (units met before come
from a bounded table), and every piece is projected back to the bytes of the original text.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pagequarry.llm.common import map_batches, slices, worker_cache
from pagequarry.llm.sp_model import Memo, PieceModel, load

SLICE_BYTES = 4 << 20


class Encoder:
    def __init__(self, model: PieceModel):
        self.model = model
        self.known = Memo(self.packed, most=400_000)

    def packed(self, unit: str) -> tuple[bytes, bytes]:
        """A unit's ids and piece widths, as the bytes of their arrays (no piece is 256 characters long)."""
        ids, widths = self.model.encode_unit(unit)
        return array("i", ids).tobytes(), bytes(widths)

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and the first and the end byte of each in the original text."""
        plain, origin = self.model.normaliser.aligned(text)
        parts = list(map(self.known.__getitem__, self.model.units(plain)))
        ids = np.frombuffer(b"".join([p[0] for p in parts]), np.int32)
        widths = np.frombuffer(b"".join([p[1] for p in parts]), np.uint8)
        ends = np.cumsum(widths, dtype=np.int64)
        return ids, origin[ends - widths], origin[ends]


def encode(docs: DataFrame, model: bytes, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Encode every whole text, decode the ids again.

    Returns the id, ids (array of int), begins and ends (bytes of the original text that each piece
    stands for; of a character spelled in bytes, the last piece has it all) and decoded. One row
    per input row, no shuffle; a null text counts as empty and has empty arrays; other columns are
    ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType

    def arrays(lists, lengths) -> pa.Array:
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        values = np.concatenate(lists).astype(np.int32) if lists else np.zeros(0, np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = worker_cache("encoders")
        if "encoder" not in cache or cache["of"] != hash(shared.value):
            cache["encoder"], cache["of"] = Encoder(load(shared.value, {})), hash(shared.value)
        encoder = cache["encoder"]
        for batch in slices(batches, "text", SLICE_BYTES):
            found = [encoder.encode(t or "") for t in batch.column("text").to_pylist()]
            lengths = [len(f[0]) for f in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    arrays([f[0] for f in found], lengths),
                    arrays([f[1] for f in found], lengths),
                    arrays([f[2] for f in found], lengths),
                    pa.array([encoder.model.decode(f[0].tolist()) for f in found], pa.string()),
                ],
                ["doc_id", "ids", "begins", "ends", "decoded"],
            )

    ints = T.ArrayType(T.IntegerType())
    schema = T.StructType(
        [
            T.StructField("doc_id", kind),
            T.StructField("ids", ints),
            T.StructField("begins", ints),
            T.StructField("ends", ints),
            T.StructField("decoded", T.StringType()),
        ]
    )
    return map_batches(docs.selectExpr(f"`{id_col}` AS id", f"`{text}` AS text"), encoded, schema)
