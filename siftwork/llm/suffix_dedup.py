"""Suffix-array dedup: bytes covered by a string of `width` bytes that also starts elsewhere.

Equal strings must meet in one shard before suffixes are sorted. Content decides where: the least
hash of the grams in a window of `width` bytes is the same in equal windows. Consecutive windows
with the same least gram form a run, and the bytes they cover are its context; every window is in one.

1. Counts of (gram, context) over all documents. Grams seen once are done: nothing repeats there.
2. Equal contexts repeat as a whole. Where a gram has several contexts, one of each is cut by the
   distance of windows to their gram, so that stretches share all but a few bytes of a window or
   are told apart. Stretches that still differ meet in a shard by their common core, where a
   suffix array by induced sorting and permuted common prefixes find the windows that repeat.
   Cores of more stretches than a shard should hold are settled by counting their windows, with
   partial sums, so no group has to fit into a task.
3. Covered stretches go back to their documents, which are cut once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwork.llm import words as w
from siftwork.llm.batches import batches_of
from siftwork.llm.bitmap import Bitmap
from siftwork.llm.induced_sort import permuted_prefixes, prefix_sums, span, suffix_array
from siftwork.llm.names import col, free, numbered
from siftwork.sources.checkpoints import discard, materialize

WIDTH = 200
GRAM = 32
STEP = 16  # windows of a context that share a core
SHARD_BYTES = 1 << 18
SHARD_CONTEXTS = 1 << 14


def _sliding(values: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """The best of each run of `width` values."""
    have, out = 1, values
    while have < width:
        step = min(have, width - have)
        out = best(out[: len(out) - step], out[step:])
        have += step
    return out


def _gram_hashes(data: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sums, down = prefix_sums(data)
    return w.mix((sums[gram:] - sums[:-gram]) * down[: len(data) - gram + 1]), sums, down


@dataclass
class _Runs:
    owner: np.ndarray  # text number
    low: np.ndarray  # the context, as places in the texts' bytes
    high: np.ndarray
    gram: np.ndarray
    context: np.ndarray
    again: np.ndarray  # 1 if the context holds its gram more than once, so windows may repeat inside


def _again(hashes: np.ndarray, least: np.ndarray, inside: np.ndarray, start: np.ndarray, stop: np.ndarray, reach: int) -> np.ndarray:
    edge = np.zeros(reach, np.uint64)
    most = _sliding(np.concatenate((edge, np.where(inside, least, np.uint64(0)), edge)), reach + 1, np.maximum)
    places = np.flatnonzero(most == hashes)
    value, wanted = hashes[places], least[start]
    at, end = np.searchsorted(places, start), np.searchsorted(places, stop + reach)
    seen, k = np.zeros(len(start), np.int64), np.arange(len(start))
    while len(k):
        seen[k] += value[at[k]] == wanted[k]
        at[k] += 1
        k = k[(at[k] < end[k]) & (seen[k] < 2)]
    return seen // 2


def _runs(data: np.ndarray, offsets: np.ndarray, width: int) -> _Runs:
    """The runs of windows that lie within one text; at most `width` windows to a run."""
    gram = min(GRAM, width)
    if len(data) < width:
        none = np.zeros(0, np.int64)
        return _Runs(none, none, none, none.view(np.uint64), none.view(np.uint64), none)
    hashes, sums, down = _gram_hashes(data, gram)
    least = _sliding(hashes, width - gram + 1, np.minimum)
    n = len(least)
    inside = np.zeros(n + 1, np.int32)
    size = np.diff(offsets)
    some = size >= width
    np.add.at(inside, offsets[:-1][some], 1)
    np.add.at(inside, np.minimum(offsets[1:][some] - width + 1, n), -1)
    inside = np.cumsum(inside[:n]) > 0
    fresh = inside.copy()
    fresh[1:] &= (least[1:] != least[:-1]) | ~inside[:-1]
    fresh[offsets[:-1][some]] = True
    start = np.flatnonzero(fresh)
    stop = np.flatnonzero(inside & ~np.concatenate((inside[1:] & ~fresh[1:], [False]))) + 1
    pieces = -(-(stop - start) // width)
    if len(start) and pieces.max() > 1:
        which = np.repeat(np.arange(len(start)), pieces)
        start = start[which] + width * (np.arange(len(which)) - (np.cumsum(pieces) - pieces)[which])
        stop = np.minimum(stop[which], start + width)
    high = stop + width - 1
    content = w.mix(span(sums, down, start, high) ^ w.mix((high - start).astype(np.uint64)))
    return _Runs(np.searchsorted(offsets, start, "right") - 1, start, high, least[start], content, _again(hashes, least, inside, start, stop, width - gram))


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64), pa.int64())


def _physical(row: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A number for a place of a row, other for other places."""
    return w.mix(row.view(np.uint64)) + place.astype(np.uint64)


def _repeated(docs: DataFrame, width: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Grams that occur more than once; (gram, context) that do; one place of each context of a gram with several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in w.chunks(batches, "text"):
            data, offsets = w.utf8(rows.column(1))
            found = _runs(data, offsets, width)
            row = rows.column(0).to_numpy()[found.owner]
            yield pa.RecordBatch.from_arrays([_long(found.gram), _long(found.context), _long(_physical(row, found.low - offsets[found.owner])), pa.array(found.again, pa.int64())], ["gram", "context", "place", "again"])

    seen = docs.select("row", "text").mapInArrow(run, "gram long, context long, place long, again long")
    each = seen.groupBy("gram", "context").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("place"), F.max("again").alias("again"))
    each = materialize(each, "contexts")
    grams = each.groupBy("gram").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("contexts"), F.max("again").alias("again")).filter("n > 1 or again > 0")
    grams = materialize(grams.select("gram", (F.expr("contexts > 1 or again > 0")).alias("open")), "grams")
    twins = materialize(each.filter("n > 1").select("gram", "context"), "twins")
    heads = materialize(each.join(grams.filter("open"), "gram", "left_semi").select("gram", "context", "place"), "heads")
    discard(each)
    return grams.select("gram"), twins, heads


def _places(docs: DataFrame, grams: DataFrame, heads: DataFrame, width: int) -> DataFrame:
    """Every run of the `grams` (and a few others): its row and context, and the bytes of the `heads`."""
    known, open_places = Bitmap(grams, "gram", grams.count()), Bitmap(heads, "place", heads.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in w.chunks(batches, "text"):
            data, offsets = w.utf8(rows.column(2))
            found = _runs(data, offsets, width)
            k = np.flatnonzero(known.holds(found.gram.view(np.int64)))
            owner, low, high = found.owner[k], found.low[k], found.high[k]
            place = _physical(rows.column(1).to_numpy()[owner], low - offsets[owner])
            ship = open_places.holds(place.view(np.int64))
            whole = data.tobytes()
            bodies = [whole[a:b] if s else None for a, b, s in zip(low.tolist(), high.tolist(), ship.tolist())]
            row = pa.array(owner)
            spans = [pa.array(low - offsets[owner], pa.int64()), pa.array(high - offsets[owner], pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [rows.column(0).take(row), rows.column(1).take(row), _long(found.gram[k]), _long(found.context[k]), _long(place), *spans, pa.array(bodies, pa.binary())], names
            )

    names = ["id", "row", "gram", "context", "place", "low", "high", "body"]
    return docs.mapInArrow(run, "id long, row long, gram long, context long, place long, low long, high long, body binary")


def _stretches(heads: DataFrame, width: int) -> DataFrame:
    """(gram, context, core, first, last, content): the windows of a context by their distance to its gram, STEP to a stretch."""
    gram_size, step = min(GRAM, width), min(STEP, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in w.chunks(batches, "body"):
            data, offsets = w.utf8(rows.column(2))
            if not len(data):
                continue
            hashes, sums, down = _gram_hashes(data, gram_size)
            holder = np.repeat(np.arange(len(rows)), np.diff(offsets))[: len(hashes)]
            hits = np.flatnonzero(hashes == rows.column(0).to_numpy().view(np.uint64)[holder])
            n = np.diff(offsets) - width + 1
            owner = np.repeat(np.arange(len(rows)), n)
            window = offsets[owner] + np.arange(len(owner)) - (np.cumsum(n) - n)[owner]
            at = hits[np.searchsorted(hits, window)]
            part = (at - window) // step
            head = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (at[1:] != at[:-1]) | (part[1:] != part[:-1]))))
            tail = np.concatenate((head[1:], [len(owner)])) - 1
            low, high = window[head], window[tail] + width
            begin = at[head] - part[head] * step
            core = w.mix(span(sums, down, begin, begin - step + 1 + width) ^ w.mix(part[head].astype(np.uint64)))
            content = w.mix(span(sums, down, low, high) ^ w.mix(((high - low) * 4096 + at[head] - low).astype(np.uint64)))
            k, base = pa.array(owner[head]), offsets[owner[head]]
            yield pa.RecordBatch.from_arrays(
                [rows.column(0).take(k), rows.column(1).take(k), _long(core), pa.array(window[head] - base), pa.array(window[tail] - base), _long(content)],
                ["gram", "context", "core", "first", "last", "content"],
            )

    return heads.select("gram", "context", "body").mapInArrow(run, "gram long, context long, core long, first long, last long, content long")


def _shard_windows(bodies: list[bytes], rows: np.ndarray, lows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each context of a shard, the first and last start of a window that also starts elsewhere (-1: none)."""
    sizes = np.array([len(b) for b in bodies], np.int64)
    text = np.frombuffer(b"".join(bodies), np.uint8)
    context = np.repeat(np.arange(len(bodies)), sizes)
    start = np.cumsum(sizes) - sizes
    inner = np.arange(len(text)) - start[context]
    t = np.ones(len(text) + len(bodies) + 1, np.int64)  # a 1 after each context, a 0 at the end
    place = np.arange(len(text)) + context
    t[place] = text.astype(np.int64) + 2
    t[-1] = 0
    source = np.full(len(t), -1, np.int64)
    source[place] = np.where(inner + width <= sizes[context], np.arange(len(text)), -1)
    order = suffix_array(t, 258)
    order = order[source[order] >= 0]  # windows; equal ones have only equal ones between them
    run = np.cumsum(permuted_prefixes(t, order, width)[order] < width)
    there = source[order]
    first, last = np.full(len(bodies), -1, np.int64), np.full(len(bodies), -1, np.int64)
    if len(there):
        physical = _physical(rows[context[there]], lows[context[there]] + inner[there])
        heads = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
        differs = np.minimum.reduceat(physical, heads) != np.maximum.reduceat(physical, heads)
        hit = there[np.repeat(differs, np.diff(np.concatenate((heads, [len(run)]))))]
        low = np.full(len(bodies), np.iinfo(np.int64).max)
        np.minimum.at(low, context[hit], inner[hit])
        np.maximum.at(last, context[hit], inner[hit])
        first = np.where(last >= 0, low, -1)
    return first, last


def _by_suffixes(stretches: DataFrame, width: int) -> DataFrame:
    """(gram, context, first, last) of contexts with repeated windows; stretches of a core share a suffix array."""

    def settle(rows: pa.Table) -> pa.RecordBatch:
        first, last = _shard_windows(rows.column("body").to_pylist(), rows.column("row").to_numpy(), rows.column("low").to_numpy(), width)
        k = pa.array(last >= 0)
        out = [rows.column(c).combine_chunks().filter(k) for c in ("gram", "context")]
        base = rows.column("first").to_numpy()[last >= 0]
        return pa.RecordBatch.from_arrays([*out, pa.array(first[last >= 0] + base), pa.array(last[last >= 0] + base)], ["gram", "context", "first", "last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for rows in w.chunks(batches, "body", SHARD_BYTES):
            held.append(rows)
            table = pa.Table.from_batches(held)
            core = table.column("core").to_numpy()
            cut = int(np.flatnonzero(core == core[-1])[0]) if table.nbytes > SHARD_BYTES else 0
            if cut:  # all but the last core, whose stretches may go on
                yield settle(table.slice(0, cut))
                held = table.slice(cut).combine_chunks().to_batches()
        if held:
            yield settle(pa.Table.from_batches(held))

    n = int(stretches.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stretches.repartition(n, "core").sortWithinPartitions("core").mapInArrow(run, "gram long, context long, first long, last long")


def _by_counts(stretches: DataFrame, width: int) -> DataFrame:
    """The same for cores of any number of stretches: windows are counted by core and hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in w.chunks(batches, "body"):
            data, offsets = w.utf8(rows.column(6))
            sums, down = prefix_sums(data)
            n = np.maximum(np.diff(offsets) - width + 1, 0)
            owner = np.repeat(np.arange(len(rows)), n)
            inner = np.arange(len(owner)) - (np.cumsum(n) - n)[owner]
            at = offsets[owner] + inner
            place = _physical(rows.column(4).to_numpy()[owner], rows.column(5).to_numpy()[owner] + inner)
            take = pa.array(owner)
            start = pa.array(rows.column(3).to_numpy()[owner] + inner)
            out = [*[rows.column(k).take(take) for k in range(3)], start, _long(w.mix(span(sums, down, at, at + width))), _long(place)]
            yield pa.RecordBatch.from_arrays(out, ["core", "gram", "context", "start", "window", "place"])

    columns = ["core", "gram", "context", "first", "row", "low", "body"]
    windows = stretches.select(columns).mapInArrow(run, "core long, gram long, context long, start long, window long, place long")
    twice = windows.groupBy("core", "window").agg(F.min("place").alias("a"), F.max("place").alias("b")).filter("a <> b")
    hit = windows.join(twice.select("core", "window"), ["core", "window"])
    return hit.groupBy("gram", "context").agg(F.min("start").alias("first"), F.max("start").alias("last"))


def _settled(heads: DataFrame, width: int, shard_contexts: int) -> DataFrame:
    """(gram, context, first, last): the first and last repeated window of each context of `heads` that has one."""
    stretches = materialize(_stretches(heads, width), "stretches")
    cores = stretches.groupBy("core").agg(F.count(F.lit(1)).alias("n"), F.min("content").alias("a"), F.max("content").alias("b")).filter("n > 1")
    cores = materialize(cores.select("core", "n", (F.col("a") == F.col("b")).alias("equal")), "cores")
    found = stretches.join(cores.filter("equal"), "core").select("gram", "context", "first", "last")
    open_ones = stretches.join(cores.filter("not equal"), "core").join(heads, ["gram", "context"])
    body = F.expr(f"substring(body, int(first + 1), int(last - first + {width}))")
    open_ones = open_ones.select("core", "n", "gram", "context", "first", "row", (F.col("low") + F.col("first")).alias("low"), body.alias("body"))
    open_ones = materialize(open_ones, "open")
    found = found.union(_by_suffixes(open_ones.filter(F.col("n") <= shard_contexts), width))
    large = open_ones.filter(F.col("n") > shard_contexts)
    if not large.isEmpty():
        found = found.union(_by_counts(large, width))
    # windows of a run lie closer than their width, so what they cover is one stretch
    out = materialize(found.groupBy("gram", "context").agg(F.min("first").alias("first"), F.max("last").alias("last")), "windows")
    discard(stretches, open_ones)
    return out


def _covered(docs: DataFrame, width: int, shard_contexts: int) -> DataFrame:
    """(id, row, spans): the covered stretches of every row of `docs(id, row, text)` that has some, at most one for each run."""
    grams, twins, heads = _repeated(docs, width)
    places = materialize(_places(docs, grams, heads, width), "places")
    bodies = places.filter("body is not null").join(heads, ["gram", "context", "place"], "left_semi")
    bodies = bodies.groupBy("gram", "context").agg(F.min(F.struct("row", "low", "body")).alias("x")).select("gram", "context", "x.row", "x.low", "x.body")
    bodies = materialize(bodies, "bodies")
    found = _settled(bodies, width, shard_contexts)
    part = places.join(found, ["gram", "context"]).select("id", "row", (F.col("low") + F.col("first")).alias("low"), (F.col("low") + F.col("last") + width).alias("high"))
    whole = places.join(twins, ["gram", "context"], "left_semi").select("id", "row", "low", "high")
    # a set: equal rows share it; no more stretches than runs in the text, whose union is taken where the text is
    spans = materialize(part.union(whole).groupBy("id", "row").agg(F.collect_set(F.struct("low", "high")).alias("spans")), "spans")
    discard(places, bodies, found, heads)
    return spans


def _merged(spans: pa.ListScalar) -> np.ndarray:
    """Disjoint stretches in order, as rows (low, high)."""
    if not spans.is_valid:
        return np.zeros((0, 2), np.int64)
    low, high = (spans.values.field(k).to_numpy() for k in (0, 1))
    order = np.argsort(low, kind="stable")
    low, high = low[order], np.maximum.accumulate(high[order])
    fresh = np.concatenate(([True], low[1:] > high[:-1]))
    return np.stack((low[fresh], high[np.concatenate((fresh[1:], [True]))]), 1)


def _kept(text: bytes, spans: np.ndarray) -> bytes:
    if not len(spans):
        return text
    edges = [0, *spans.ravel().tolist(), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))


def _with_spans(docs: DataFrame, width: int, shard_contexts: int, name: str = "_spans") -> DataFrame:
    """`docs` and a column `name` of covered stretches (null: none)."""
    row = F.xxhash64(F.col("doc_id").cast("long"), "text")
    with batches_of(docs.sparkSession, 2048):
        covered = _covered(docs.select(F.col("doc_id").cast("long").alias("id"), row.alias("row"), "text"), width, shard_contexts)
    id_name, key_name, row_name = (free(c, docs.columns) for c in ("_id", "_key", "_row"))
    found = covered.select(F.col("id").alias(id_name), F.col("row").alias(key_name), F.col("spans").alias(name))
    keyed = docs.withColumn(row_name, row)
    same = (F.col(row_name) == F.col(key_name)) & F.col("doc_id").cast("long").eqNullSafe(F.col(id_name))
    return keyed.join(found, same, "left").select(*map(col, docs.columns), name)


def repeat_report(docs: DataFrame, width: int = WIDTH, shard_contexts: int = SHARD_CONTEXTS) -> DataFrame:
    """Per row of `docs(doc_id, text)`: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Texts count as UTF-8 bytes, a null text as none; strings do not cross texts, and all are judged
    on the input. Rows that repeat another row whole repeat all its strings. A null doc_id is
    carried through. Other columns are not read; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in w.chunks(batches, "text"):
            out = []
            for text, spans in zip(rows.column(1), rows.column(2)):
                body, spans = (text.as_buffer().to_pybytes() if text.is_valid else b""), _merged(spans)
                out.append((len(body), int((spans[:, 1] - spans[:, 0]).sum()), len(spans), hashlib.sha256(_kept(body, spans)).hexdigest()))
            columns = list(zip(*out))
            yield pa.RecordBatch.from_arrays([rows.column(0), *[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3])], names)

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    found = _with_spans(docs.select("doc_id", "text"), width, shard_contexts)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return found.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, width: int = WIDTH, shard_contexts: int = SHARD_CONTEXTS) -> DataFrame:
    """`docs` with the repeated bytes cut from `text`; characters that a cut splits go with it.

    All rows stay, also those left empty; null texts stay null. Columns may have any names.
    """
    name, at, spans_at = free("_spans", docs.columns), docs.columns.index("text"), len(docs.columns)
    schema = T.StructType([T.StructField(f"c{k}", f.dataType) for k, f in enumerate(docs.schema)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in w.chunks(batches, f"c{at}"):
            texts = []
            for text, spans in zip(rows.column(at), rows.column(spans_at)):
                body = text.as_buffer().to_pybytes() if text.is_valid else None
                texts.append(body if body is None else _kept(body, _merged(spans)).decode("utf-8", "ignore"))
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if k == at else rows.column(k) for k in range(spans_at)], rows.schema.names[:spans_at])

    return numbered(_with_spans(docs, width, shard_contexts, name)).mapInArrow(run, schema).toDF(*docs.columns)
