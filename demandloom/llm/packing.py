"""Concatenate and cut: one endless row of token ids, cut into windows of fixed length."""

from __future__ import annotations

import base64
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from ..sources.checkpoints import work_dir
from .arrays import BYTE_VALUE, slices, span_hashes, text_arrays

LETTER, NUMBER, OTHER, BLANK, SLOW = range(5)
SIMPLE = 0x250
CACHED_PIECES = 2_000_000


def _kind(code: int) -> int:
    """Character class of a code point; ``SLOW`` for those that the quick split leaves to the tokenizer."""
    c = chr(code)
    if code == 0x27 or code >= 0x80 and c.isspace():
        return SLOW
    if code < 0x80 and code in (9, 10, 11, 12, 13, 32):
        return BLANK
    kind = unicodedata.category(c)[0]
    return {"L": LETTER, "N": NUMBER}.get(kind, OTHER)


def split_pieces(data: np.ndarray, bounds: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the pre-tokens of all rows, and which rows need the tokenizer itself (apostrophes, rare characters).

    Runs of letters, of digits and of other marks are pieces and take one space before them; of a longer blank run, the last
    character stands apart. The pieces of a row cover it without gaps.
    """
    kind = kinds[np.minimum(data, 0x7F)].copy()
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        first, second = data[lead].astype(np.int64), data[np.minimum(lead + 1, len(data) - 1)]
        code = ((first & 0x1F) << 6) | (second & 0x3F)
        kind[lead] = np.where((first < 0xE0) & (code < SIMPLE), kinds[np.minimum(code, SIMPLE - 1)], SLOW)
        tail = np.flatnonzero((data >= 0x80) & (data < 0xC0))
        kind[tail] = kind[tail - 1]  # of longer characters all rows are slow, so their later bytes do not matter
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    before = np.concatenate(([SLOW], kind[:-1]))
    after = np.concatenate((kind[1:], [SLOW]))
    space = data == 0x20
    gap = np.concatenate(([False], ~space[:-1])) if len(data) else space
    blank = kind == BLANK
    start = edge[:-1] | np.where(blank, (before != BLANK) | ((after != BLANK) & ~edge[1:]), (before != kind) & ((before != BLANK) | gap))
    slow = np.zeros(len(bounds) - 1, bool)
    odd = np.flatnonzero((kind == SLOW) | (data >= 0xE0))
    slow[np.searchsorted(bounds, odd, "right") - 1] = True
    return np.flatnonzero(start), slow


class PieceTokenizer:
    """Token ids of whole texts; the ids of pieces are kept, so each piece is encoded once.

    ``ranks`` names the same vocabulary as merge ranks, which encodes single pieces several times faster.
    """

    def __init__(self, path: str, end_id: int, ranks: str | None = None):
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id = Tokenizer.from_file(path), end_id
        self.pieces = None
        if ranks is not None:
            import tiktoken

            with open(ranks, "rb") as lines:
                merged = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.pieces = tiktoken.Encoding("pieces", pat_str=r"(?s:.+)", mergeable_ranks=merged, special_tokens={})
        self.kinds = np.array([_kind(c) for c in range(SIMPLE)], np.uint8)
        self.known: dict[int, bytes] = {}
        self.specials = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_pieces(self, pieces: list[str]) -> list[bytes]:
        if self.pieces is None:
            return self._encode(pieces)
        encode = self.pieces.encode_ordinary
        return [array("I", encode(p)).tobytes() for p in pieces]

    def __call__(self, column: pa.Array) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, with the end id."""
        data, bounds = text_arrays(column)
        start, slow = split_pieces(data, bounds, self.kinds)
        raw = data.tobytes()
        for special in self.specials:
            at = raw.find(special)
            while at >= 0:
                slow[np.searchsorted(bounds, at, "right") - 1] = True
                at = raw.find(special, at + 1)
        end = np.concatenate((start[1:], [len(data)])).astype(np.int64)
        row = np.searchsorted(bounds, start, "right") - 1
        quick = ~slow[row]
        start, end, row = start[quick], end[quick], row[quick]
        hashes, first, back = np.unique(span_hashes(BYTE_VALUE[data], start, end), return_index=True, return_inverse=True)
        if len(self.known) > CACHED_PIECES:
            self.known.clear()
        names = hashes.tolist()
        new = [i for i, h in enumerate(names) if h not in self.known]
        pieces = [raw[a:b].decode() for a, b in zip(start[first[new]].tolist(), end[first[new]].tolist())] if new else []
        for i, ids in zip(new, self._encode_pieces(pieces)):
            self.known[names[i]] = ids
        found = [self.known[h] for h in names]
        flat = np.frombuffer(b"".join(found), "<u4")
        size = np.array([len(x) // 4 for x in found], np.int64)
        begin = np.cumsum(size) - size
        length = size[back]
        total = np.cumsum(length)
        ids = flat[np.repeat(begin[back] - (total - length), length) + np.arange(total[-1] if len(total) else 0)] if len(flat) else flat
        per_row = np.bincount(row, length, len(bounds) - 1).astype(np.int64)
        at = np.cumsum(per_row) - per_row
        last, whole = np.array([self.end_id], "<u4").tobytes(), ids.tobytes()
        out = [whole[4 * a : 4 * (a + n)] + last for a, n in zip(at.tolist(), per_row.tolist())]
        late = np.flatnonzero(slow).tolist()
        for i, got in zip(late, self._encode([raw[bounds[i] : bounds[i + 1]].decode() for i in late]) if late else []):
            out[i] = got + last
        return out


def pack_sequences(
    records: DataFrame, tokenizer: str, key: str = "SKU", text: str = "Product_Name", sequence_tokens: int = 2048, end_id: int = 1,
    ranks: str | None = None,
) -> DataFrame:
    """Pack the token ids of all item texts into sequences of ``sequence_tokens``: one row per piece of an item.

    ``tokenizer`` is the path of a public tokenizer file on every executor, ``ranks`` that of the same vocabulary as merge ranks. Each text gives its ids and then ``end_id``. The
    first pass writes the ids with their place in the partition; prefix sums over the partition totals give each text its place
    in one endless row, which is cut every ``sequence_tokens``. All sequences are full but the last, so nothing is padded except
    there. Returns (key, ``start``, ``length``, ``token_ids``, ``item_tokens``, ``sequence_id``, ``offset``): ``start`` counts the
    item's ids before the piece, ``offset`` those before it in the sequence, ``token_ids`` holds little-endian unsigned 32-bit
    ids. A null or empty text is the end id alone; an empty table gives no rows; repeated rows and null keys are packed like
    any other; a text of any length runs over as many sequences as it needs. Other columns are dropped.
    """
    schema = T.StructType([
        T.StructField(key, records.schema[key].dataType), T.StructField("_part", T.IntegerType()), T.StructField("_at", T.LongType()),
        T.StructField("_n", T.LongType()), T.StructField("_ids", T.BinaryType()),
    ])

    def encode(batches):
        encoder, part, at = PieceTokenizer(tokenizer, end_id, ranks), TaskContext.get().partitionId(), 0
        for batch in slices(batches, text):
            ids = encoder(batch.column(text))
            n = np.array([len(x) // 4 for x in ids], np.int64)
            place = at + np.cumsum(n) - n
            at = int(place[-1] + n[-1])
            columns = [batch.column(key), pa.array(np.full(len(n), part, np.int32)), pa.array(place), pa.array(n), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    spark = records.sparkSession
    path = f"{work_dir(spark)}/tokens"
    records.select(key, text).mapInArrow(encode, schema).write.option("compression", "zstd").parquet(path)
    tokens = spark.read.schema(schema).parquet(path)
    totals = tokens.groupBy("_part").agg(F.max(F.col("_at") + F.col("_n")).alias("_total"))
    # One row per partition of the first pass: its size is the number of tasks, not of rows.
    before = totals.selectExpr("_part", "sum(_total) OVER (ORDER BY _part) - _total AS _base")
    placed = tokens.join(F.broadcast(before), "_part").withColumn("_first", F.col("_base") + F.col("_at"))
    size = F.lit(sequence_tokens).cast("long")
    cut = placed.withColumn(
        "sequence_id", F.explode(F.sequence(F.floor(F.col("_first") / size), F.floor((F.col("_first") + F.col("_n") - 1) / size)))
    )
    start = F.greatest(F.col("sequence_id") * size - F.col("_first"), F.lit(0).cast("long"))
    end = F.least((F.col("sequence_id") + 1) * size - F.col("_first"), F.col("_n"))
    return cut.withColumn("start", start).select(
        key, "start", (end - F.col("start")).alias("length"),
        F.col("_ids").substr((F.col("start") * 4 + 1).cast("int"), ((end - F.col("start")) * 4).cast("int")).alias("token_ids"),
        F.col("_n").alias("item_tokens"), "sequence_id", (F.col("_first") + F.col("start") - F.col("sequence_id") * size).alias("offset"),
    )
