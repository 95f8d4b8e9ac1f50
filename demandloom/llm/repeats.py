"""Removal of repeated passages by a sparse suffix array: sampled splitters, multikey quicksort in buckets, borders compared."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..sources.checkpoints import work_dir
from .arrays import BASE, BYTE_VALUE, mix, slices, text_arrays
from .components import stored

#: Bytes of text that are looked at together, and bytes of suffixes in one bucket.
BLOCK_BYTES, BUCKET_BYTES = 4 << 20, 32 << 20
LEAF_ROWS = 512
_LOW = np.uint64(24)
_INVERSE = pow(BASE, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)[:n]


def window_minima(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest of every ``width`` consecutive values."""
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[: len(x) - span], x[span:])
        span *= 2
    rest = width - span
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def anchors(data: np.ndarray, valid: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Anchor, first and last start of every run of strings with one anchor, and hashes of the anchor's gram and of the run's bytes.

    ``valid`` marks the starts of strings of ``length`` bytes inside one text. A string's anchor is the place of its smallest
    gram hash, the first one if equal, so equal strings have it at the same offset.
    """
    with np.errstate(over="ignore"):
        back = powers(_INVERSE, len(data))
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE_VALUE[data] * powers(BASE, len(data)), out=total[1:])
        grams = mix((total[gram:] - total[:-gram]) * back[: len(data) - gram + 1])
        marked = (grams >> _LOW << _LOW) | np.arange(len(grams), dtype=np.uint64)
        anchor = (window_minima(marked, length - gram + 1) & np.uint64((1 << 24) - 1)).astype(np.int64)
        start = np.flatnonzero(valid[: len(anchor)])
        anchor = anchor[start]
        new = np.ones(len(start), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)
        at = np.flatnonzero(new)
        first, last, place = start[at], start[np.append(at[1:], len(start)) - 1] if len(at) else start, anchor[at]
        shape = ((last - first) * 65536 + place - first).astype(np.uint64)
        whole = mix((total[last + length] - total[first]) * back[first] + mix(shape + np.uint64(1)))
    return place, first, last, grams[place], whole


def multikey_order(words: np.ndarray) -> np.ndarray:
    """Row order by columns of 64-bit words: quicksort into smaller, equal and larger, the equal ones by their next word."""
    out, todo, depth_of_rows = [], [(np.arange(len(words)), 0)], words.shape[1]
    while todo:
        rows, depth = todo.pop()
        if len(rows) <= 1 or depth == depth_of_rows:
            out.append(rows)
        elif len(rows) <= LEAF_ROWS:
            out.append(rows[np.lexsort(words[rows, depth:].T[::-1])])
        else:
            word = words[rows, depth]
            pivot = np.partition(word, len(word) // 2)[len(word) // 2]
            less, same = word < pivot, word == pivot
            todo += [(rows[~(less | same)], depth), (rows[same], depth + 1), (rows[less], depth)]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def byte_rows(column: pa.Array, width: int) -> np.ndarray:
    """A binary column as a matrix of bytes, zero-padded to ``width``, a multiple of eight."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    out = np.zeros((len(column), width), np.uint8)
    out[np.arange(width)[None, :] < np.diff(bounds)[:, None]] = raw[bounds[0] : bounds[-1]]
    return out


def common_bytes(rows: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Bytes that each row shares with the row before it in ``order``; none for the first."""
    out = np.zeros(len(order), np.int64)
    for i in range(1, len(order), 1 << 16):
        at = order[i : i + (1 << 16)]
        differ = rows[at] != rows[order[i - 1 : i - 1 + len(at)]]
        out[i : i + len(at)] = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    return out


def place_ranks(batch: pa.Table, names: list[str]) -> np.ndarray:
    """Dense rank of each row by the given columns, nulls last; equal rows have equal ranks."""
    order = pc.sort_indices(batch, [(c, "ascending") for c in names], null_placement="at_end").to_numpy()
    new = np.zeros(len(order), bool)
    for c in names:
        x = batch.column(c)
        x = x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x
        code = pc.fill_null(x.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)[order]
        new[1:] |= code[1:] != code[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def runs(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of consecutive values of one row begin and end (inclusive), for pairs in order."""
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1] + 1)
    at = np.flatnonzero(new)
    return at, np.append(at[1:], len(row)) - 1 if len(at) else at


def bucket_repeats(right: np.ndarray, left: np.ndarray, low: np.ndarray, high: np.ndarray, rank: np.ndarray, length: int, open_ends: bool) -> tuple[np.ndarray, ...]:
    """Strings in a bucket of suffixes that start earlier too, and the first of those that may go on in other buckets.

    Row i has the bytes from its anchor on, the bytes before it backwards, and stands for the strings that begin ``low`` to
    ``high`` bytes before it. For an offset r, two rows' strings are equal if they share ``length - r`` bytes of the suffix and
    r bytes before; both are read off the common prefixes of neighbours in suffix order and in order of the bytes before.
    Returns row and r of repeated strings (in row order), and row and r of first strings whose suffixes touch a border.
    """
    n = len(rank)
    order, before = multikey_order(right.view(">u8").astype(np.uint64)), multikey_order(left.view(">u8").astype(np.uint64))
    shared, shared_left = common_bytes(right, order), common_bytes(left, before)
    found, edges = [], []
    right_id, left_id = np.empty(n, np.int64), np.empty(n, np.int64)
    for r in range(int(low.min(initial=0)), int(high.max(initial=-1)) + 1):
        apart = shared < length - r
        ids = np.cumsum(apart)
        right_id[order] = ids
        if open_ends:
            at_edge = np.ones(n, bool)
        else:
            at_edge = (right_id == ids[0]) | (right_id == ids[-1])
        here = (low <= r) & (r <= high)
        size = np.bincount(right_id[here], minlength=int(ids[-1]) + 1)
        here &= (size[right_id] > 1) | at_edge
        rows = np.flatnonzero(here)
        if not len(rows):
            continue
        left_id[before] = np.cumsum(shared_left < r)
        both = right_id[rows] * (n + 1) + left_id[rows]
        _, kind = np.unique(both, return_inverse=True)
        least = np.full(int(kind.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, kind, rank[rows])
        again = rank[rows] > least[kind]
        found.append((rows[again], np.full(int(again.sum()), r)))
        ends = rows[~again & at_edge[rows]]
        edges.append((ends, np.full(len(ends), r)))
    empty = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    row, r = (np.concatenate(x) for x in zip(*(found or empty)))
    by_row = np.lexsort((r, row))
    return row[by_row], r[by_row], *(np.concatenate(x) for x in zip(*(edges or empty)))


def identified(records: DataFrame, key: str, text: str) -> DataFrame:
    """(``key``, ``h``, ``text``): rows with equal key and h are the same document."""
    h = F.coalesce(F.xxhash64(F.col(text)), F.lit(0))
    return records.select(F.col(key).alias("key"), h.alias("h"), F.col(text).alias("text"))


def same(a: str, b: str) -> Column:
    return (F.col(f"{a}.h") == F.col(f"{b}.h")) & F.col(f"{a}.key").eqNullSafe(F.col(f"{b}.key"))


def remove_repeats(records: DataFrame, key: str = "SKU", text: str = "Product_Name", length: int = 100) -> DataFrame:
    """Cut passages that stand earlier too: (key, ``n_bytes``, ``spans``, ``kept``), one row per input row.

    Texts are UTF-8 bytes. Every byte inside a string of ``length`` bytes that also starts earlier (in a text with a smaller
    key, or before it in the same text) is removed; strings are judged on the input and never cross texts. ``spans`` are the
    maximal removed runs (``start``, ``end`` exclusive) in order, ``kept`` the other bytes, joined.

    Suffixes start at anchors only: the place of the smallest hash of a gram of ``length // 5`` bytes in a string, which
    equal strings have at one offset; about one byte in forty is an anchor. Within a block of text equal neighbourhoods are settled on the
    spot and only the first goes on. Anchors whose gram occurs once in all texts are discarded. The other
    suffixes, each with the bytes before it, are cut from the texts and dealt to buckets by sampled splitters over their
    leading bytes; buckets are sorted by multikey quicksort, forwards and backwards, and the common prefixes of neighbours
    tell which strings are equal. Strings whose suffixes touch a bucket's border go on as one row per bucket and different string,
    and are compared across buckets by 128-bit hashes, as are neighbourhoods in a block.

    A null or empty text has no bytes. Null keys come last in the order. Texts under one key (or without) are ordered by a
    hash; rows with equal key and text are one document, so their copies do not count as earlier. Texts shorter than
    ``length`` lose nothing; long ones are read in overlapping blocks. An empty table gives no rows; other columns are dropped.
    The key is a number, a text, a date or a time.
    """
    spark = records.sparkSession
    root = work_dir(spark)
    key_type = records.schema[key].dataType
    gram = max(length // 5, 1)
    items = identified(records, key, text)
    long = T.LongType()
    scan = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("key", key_type)] + [T.StructField(c, long) for c in ("h", "gram", "at", "end")])
    ONCE, SEEN, KNOWN, CUT = range(4)

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per block: repeated neighbourhoods (CUT), anchors whose gram came twice (KNOWN) or once (ONCE), grams seen twice (SEEN)."""
        for part in slices(batches, "text", BLOCK_BYTES):
            rank = place_ranks(pa.Table.from_batches([part]), ["key", "h"])
            part = part.take(pa.array(np.unique(rank, return_index=True)[1]))  # in order, copies of a row once
            data, bounds = text_arrays(part.column("text"))
            for begin in range(0, len(data), BLOCK_BYTES):
                here = data[begin : begin + BLOCK_BYTES + length - 1]
                if len(here) < length:
                    continue
                edge = bounds[(bounds > begin) & (bounds < begin + len(here))] - begin
                valid = np.ones(len(here), np.int8)
                valid[len(here) - length + 1 :] = 0
                for e in edge.tolist():
                    valid[max(e - length + 1, 0) : e] = 0
                valid[BLOCK_BYTES:] = 0
                place, first, last, grams, whole = anchors(here, valid.astype(bool), length, gram)
                if not len(place):
                    continue
                by = np.lexsort((first, whole, grams))
                again = np.zeros(len(place), bool)
                again[by[1:]] = (whole[by[1:]] == whole[by[:-1]]) & (grams[by[1:]] == grams[by[:-1]])
                row = np.searchsorted(bounds, begin + first, "right") - 1
                base = begin - bounds[row]
                cut = np.flatnonzero(again)
                a, b = covers(row[cut], first[cut] + base[cut], last[cut] + base[cut] + length)
                yield emit(part, CUT, row[cut][a], start=(first + base)[cut][a], end=b)
                kept = np.flatnonzero(~again)
                value, at, n = np.unique(grams[kept], return_inverse=True, return_counts=True)
                packed = (place + base) << 32 | (place - first) << 16 | (place - last)
                known = n[at] > 1
                yield emit(part, KNOWN, row[kept[known]], start=packed[kept[known]])
                yield emit(part, ONCE, row[kept[~known]], start=packed[kept[~known]], grams=grams[kept[~known]])
                yield emit(part, SEEN, None, grams=value[n > 1])

    def covers(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First span of every group of overlapping or touching ones in a row, and the group's end; spans are in order."""
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (start[1:] > end[:-1])
        at = np.flatnonzero(new)
        return at, end[np.append(at[1:], len(row)) - 1] if len(at) else end

    def emit(part: pa.RecordBatch, kind: int, row: np.ndarray | None, start=None, end=None, grams=None) -> pa.RecordBatch:
        n = len(grams) if row is None else len(row)
        keys = pa.nulls(n, part.column("key").type) if row is None else part.column("key").take(pa.array(row))
        hs = pa.nulls(n, pa.int64()) if row is None else part.column("h").take(pa.array(row))
        longs = [pa.nulls(n, pa.int64()) if x is None else pa.array(x) for x in (None if grams is None else grams.view(np.int64), start, end)]
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), keys, hs, *longs], names=scan.names)

    found = stored(items.where(F.octet_length("text") >= length).mapInArrow(scanned, scan), root, "anchors")
    # A gram that blocks share: there is one row per block, so no group grows with the rows behind it.
    shared = found.where(F.col("kind").isin(ONCE, SEEN)).withColumn("blocks", F.count(F.lit(1)).over(Window.partitionBy("gram")))
    shared = shared.where((F.col("blocks") > 1) & (F.col("kind") == ONCE)).select("key", "h", "at")
    repeated = stored(found.where(F.col("kind") == KNOWN).select("key", "h", "at").union(shared), root, "repeated")
    lists = repeated.groupBy("key", "h").agg(F.collect_list("at").alias("anchors"))

    suffix = T.StructType([
        T.StructField("right", T.BinaryType()), T.StructField("left", T.BinaryType()), T.StructField("key", key_type), T.StructField("h", long),
        T.StructField("at", long),
    ])

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", BLOCK_BYTES):
            data, bounds = text_arrays(part.column("text"))
            lists = part.column("anchors")
            all_at = pc.list_flatten(lists).to_numpy(zero_copy_only=False)
            all_row = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            for i in range(0, len(all_at), 1 << 15):
                at, row = all_at[i : i + (1 << 15)], all_row[i : i + (1 << 15)]
                spot, high, low = bounds[row] + (at >> 32), at >> 16 & 0xFFFF, at & 0xFFFF
                columns = []
                for n, sign in ((length - low, 1), (high, -1)):
                    ends = np.cumsum(n)
                    inner = np.arange(int(ends[-1])) - np.repeat(ends - n, n)
                    taken = data[np.repeat(spot, n) + inner] if sign > 0 else data[np.repeat(spot, n) - 1 - inner]
                    columns.append(pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(np.concatenate(([0], ends)).astype(np.int32)), pa.py_buffer(taken)]))
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([*columns, part.column("key").take(take), part.column("h").take(take), pa.array(at)], names=suffix.names)

    result = T.StructType([T.StructField("key", key_type)] + [T.StructField(c, long) for c in ("h", "start", "end", "w1", "w2")] + [T.StructField("settled", T.BooleanType())])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Repeated spans of a bucket, and its first strings at the borders; a bucket beyond the bound is sorted in pieces, all open."""
        held, size, pieces = [], 0, 0
        for batch in batches:
            for part in (batch.slice(i, 1 << 14) for i in range(0, batch.num_rows, 1 << 14)):
                held.append(part)
                size += part.nbytes
                if size > 4 * BUCKET_BYTES:
                    yield from sorted_bucket(held, True)
                    held, size, pieces = [], 0, pieces + 1
        if held:
            yield from sorted_bucket(held, pieces > 0)

    def sorted_bucket(held: list[pa.RecordBatch], open_ends: bool) -> Iterator[pa.RecordBatch]:
        bucket = pa.Table.from_batches(held).combine_chunks()
        at = bucket.column("at").to_numpy()
        spot, high, low = at >> 32, at >> 16 & 0xFFFF, at & 0xFFFF
        right = byte_rows(bucket.column("right").combine_chunks(), -(-length // 8) * 8)
        left = byte_rows(bucket.column("left").combine_chunks(), -(-(length - gram + 1) // 8) * 8)
        rank = place_ranks(bucket.append_column("spot", pa.array(spot)).select(["key", "h", "spot"]), ["key", "h", "spot"])
        row, r, edge, edge_r = bucket_repeats(right, left, low, high, rank, length, open_ends)
        a, b = runs(row, r)
        n = len(a)
        spread = mix((spot[row[a]] * 65536 + r[a]).astype(np.uint64)).view(np.int64)
        yield rows_of(bucket, row[a], spot[row[a]] - r[b], spot[row[a]] - r[a] + length, spread, np.zeros(n, np.int64), True)
        with np.errstate(over="ignore"):
            for i in range(0, len(edge), 1 << 14):
                e, k = edge[i : i + (1 << 14)], edge_r[i : i + (1 << 14)]
                place = np.arange(length)[None, :]
                before = place < k[:, None]
                x = np.where(before, left[e[:, None], np.maximum(k[:, None] - 1 - place, 0)], right[e[:, None], np.maximum(place - k[:, None], 0)])
                v = BYTE_VALUE[x]
                w1 = mix((v * powers(BASE, length)[None, :]).sum(1, dtype=np.uint64) + mix(k.astype(np.uint64)))
                w2 = mix((mix(v) * powers(BASE ^ 0x5555555555555554, length)[None, :]).sum(1, dtype=np.uint64))
                yield rows_of(bucket, e, spot[e] - k, spot[e] - k + length, w1.view(np.int64), w2.view(np.int64), False)

    def rows_of(bucket: pa.Table, row, start, end, w1, w2, settled: bool) -> pa.RecordBatch:
        take = pa.array(row)
        keys = [bucket.column(c).take(take).combine_chunks() for c in ("key", "h")]
        keys = [k.chunk(0) if isinstance(k, pa.ChunkedArray) else k for k in keys]
        return pa.RecordBatch.from_arrays([*keys, *map(pa.array, (start, end, w1, w2)), pa.array(np.full(len(row), settled))], names=result.names)

    picked = items.alias("t").join(lists.alias("a"), same("t", "a")).select("t.key", "t.h", "t.text", "a.anchors")
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), repeated.count() * 2 * length // BUCKET_BYTES)
    dealt = picked.mapInArrow(suffixes, suffix).repartitionByRange(buckets, "right", "left")
    place = F.struct(F.col("key").isNull().alias("last"), "key", "h", "start")
    first = F.min(F.when(~F.col("settled"), place)).over(Window.partitionBy("w1", "w2"))
    across = dealt.mapInArrow(compared, result).withColumn("first", first).where(F.col("settled") | (place > F.col("first")))
    spans = across.select("key", "h", "start", "end").union(found.where(F.col("kind") == CUT).select("key", "h", F.col("at").alias("start"), "end"))
    spans = spans.groupBy("key", "h").agg(F.collect_list(F.struct("start", "end")).alias("cut"))
    joined = items.alias("t").join(spans.alias("c"), same("t", "c"), "left").select("t.key", "t.text", "c.cut")

    span = T.ArrayType(T.StructType([T.StructField("start", long), T.StructField("end", long)]))
    final = T.StructType([T.StructField("key", key_type), T.StructField("n_bytes", long), T.StructField("spans", span), T.StructField("kept", T.BinaryType())])

    def kept_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", BLOCK_BYTES):
            data, bounds = text_arrays(part.column("text"))
            cuts = part.column("cut")
            flat, row = pc.list_flatten(cuts), pc.list_parent_indices(cuts).to_numpy(zero_copy_only=False).astype(np.int64)
            start, end = (bounds[row] + flat.field(c).to_numpy(zero_copy_only=False) for c in ("start", "end"))
            depth = np.zeros(len(data) + 1, np.int32)
            np.add.at(depth, start, 1)
            np.add.at(depth, end, -1)
            gone = np.cumsum(depth[:-1]) > 0
            opens, ends = gone.copy(), gone.copy()
            opens[1:] &= ~gone[:-1]
            ends[:-1] &= ~gone[1:]
            text_edge = bounds[1:-1][(bounds[1:-1] > 0) & (bounds[1:-1] < len(data))]
            opens[text_edge] = gone[text_edge]
            ends[text_edge - 1] = gone[text_edge - 1]
            opens, ends = np.flatnonzero(opens), np.flatnonzero(ends) + 1
            of = np.searchsorted(bounds, opens, "right") - 1
            spans = pa.StructArray.from_arrays([pa.array(opens - bounds[of]), pa.array(ends - bounds[of])], ["start", "end"])
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(part.num_rows + 1)).astype(np.int32)), spans)
            left = np.concatenate(([0], np.cumsum(~gone)))[bounds]
            whole = pa.Array.from_buffers(pa.large_binary(), part.num_rows, [None, pa.py_buffer(left.astype(np.int64)), pa.py_buffer(data[~gone])])
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(np.diff(bounds)), lists, whole.cast(pa.binary())], names=final.names)

    out = joined.mapInArrow(kept_bytes, final)
    return out.select(F.col("key").alias(key), "n_bytes", "spans", "kept")
