"""N-gram Jaccard join: documents whose sets of word shingles overlap enough, and their groups.

T-occurrence search in the manner of DivideSkip. A document with n shingles can only be similar
to one that holds T of them, so its T-1 most frequent lists (the long ones) may be skipped:
every partner shows up in one of the other, short lists. Spark sorts and merges the short lists
of all documents by shingle and counts how often a pair meets; what the counts and places still
allow is decided by binary probes of the remaining shingles in the partner's sorted set.

* Shingle counts over all documents put the frequent lists last. Only shingles above a count that
  at most `FREQUENT` shingles reach (a bound for the broadcast) are told apart; the order affects
  speed alone, never the result.
* Of a shingle's 64-bit hash 48 bits are kept where pairs are verified, which saves a quarter of
  what the sets take; two shingles of a pair agree by accident once in 10^9 pairs of 500 words.
* Before whole sets are shuffled, pairs that cannot reach the overlap go by a parity bit or two per
  shingle: each shingle flips one bit of its set, so bits that differ between two sets never
  outnumber the shingles that only one of them holds. No similar pair is lost.
* Equal sets are one vertex from the start, so copies cost one row each. A vertex is named by a row
  number of this run, never by a doc_id: ids may repeat or be null.
* Lists are not expanded into all pairs: documents meet a few hubs of their lists first, join
  components, and only documents of different components still meet. The share of hubs grows
  until it covers all documents, so every similar pair is either linked or already connected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.llm import words as w
from siftwork.llm.batches import batches_of
from siftwork.llm.bitmap import Bitmap
from siftwork.llm.components import connected_components
from siftwork.sources.checkpoints import discard, materialize

FREQUENT = 1 << 22  # shingles whose frequency the order knows: 20 MB
LEAST_COUNT = 16
_TURN = 1 << 30


def row_keys() -> list[Column]:
    """k1 and k2: 128 bits that name a pair of doc_id and text, null ids included."""
    parts = (F.col("doc_id").cast("long"), F.col("text"))
    return [F.xxhash64(*parts).alias("k1"), F.xxhash64(F.lit(1), *parts).alias("k2")]


def _packed(hashes: np.ndarray, owner: np.ndarray, n: int) -> pa.Array:
    """Per row the upper 48 bits of its sorted hashes, six bytes each."""
    short = (hashes >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
    ends = np.searchsorted(owner, np.arange(n + 1)) * 6
    return pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(short))])


def _parities(hashes: np.ndarray, owner: np.ndarray, n: np.ndarray) -> pa.Array:
    """Per row a power of two of bits, 64 and its `n` hashes at least; each hash flips the bit of its place."""
    sizes = 1 << np.ceil(np.log2(np.maximum(n, 64))).astype(np.int64)
    ends = np.concatenate(([0], np.cumsum(sizes)))
    place = ((hashes >> np.uint64(16)).astype(np.int64) & (sizes[owner] - 1)) + ends[owner]
    bits = np.packbits(np.bincount(place, minlength=ends[-1]).astype(np.uint8) & 1, bitorder="little")
    return pa.BinaryArray.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((ends // 8).astype(np.int32)), pa.py_buffer(bits)])


def _differing(x: bytes, y: bytes) -> int:
    """The number of places whose parity differs, the longer row of bits folded to the shorter."""
    x, y = sorted((np.frombuffer(bits, np.uint64) for bits in (x, y)), key=len)
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _unpacked(packed: bytes) -> np.ndarray:
    out = np.zeros((len(packed) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(packed, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def _counted(held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct tokens of all arrays, sorted, and their counts. Empties `held` and sorts in place, so that little is held twice."""
    tokens = np.concatenate(held)
    held.clear()
    tokens.sort()
    fresh = np.ones(len(tokens), bool)
    np.not_equal(tokens[1:], tokens[:-1], out=fresh[1:])
    edges = np.empty(np.count_nonzero(fresh) + 1, np.uint32)
    edges[:-1], edges[-1] = np.flatnonzero(fresh), len(tokens)
    return tokens[fresh], np.diff(edges)


def _totals(held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct upper halves of all arrays, sorted, and the sums of their lower halves. Empties `held` and sorts in place."""
    both = np.concatenate(held)
    held.clear()
    both.sort()
    tokens = (both >> np.uint64(32)).astype(np.uint32)
    both &= np.uint64(0xFFFFFFFF)
    fresh = np.ones(len(tokens), bool)
    np.not_equal(tokens[1:], tokens[:-1], out=fresh[1:])
    first = np.flatnonzero(fresh)
    return tokens[first], np.add.reduceat(both, first) if len(first) else both


def _range_starts(n: int) -> np.ndarray:
    """Where each of `n` equal ranges of 32-bit tokens begins."""
    return ((np.arange(n, dtype=np.uint64) << np.uint64(32)) // np.uint64(n)).astype(np.uint32)


def _counts(docs: DataFrame, width: int) -> DataFrame:
    """(token, level): upper half of a shingle's hash and the binary logarithm of its document count."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    starts = _range_starts(n)

    def pre_aggregate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            tokens, counts = _counted(held)
            # A part is a range of tokens, so that sorted tokens need no other order to be dealt out.
            bounds = pa.array([*np.searchsorted(tokens, starts), len(tokens)], pa.int32())
            lists = [pa.ListArray.from_arrays(bounds, pa.array(x.view(np.int32))) for x in (tokens, counts)]
            return pa.RecordBatch.from_arrays([pa.array(np.arange(n), pa.int32()), *lists], ["part", "tokens", "counts"])

        for rows in w.chunks(batches, "text"):
            held.append((w.shingles(*w.utf8(rows.column(0)), width)[1] >> np.uint64(32)).astype(np.uint32))
            size += len(held[-1])
            if size > 1 << 21:
                yield flush()
                size = 0
        if held:
            yield flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for rows in batches:
            tokens, counts = (rows.column(k).flatten().to_numpy().view(np.uint32) for k in (1, 2))
            held.append((tokens.astype(np.uint64) << np.uint64(32)) | counts)
        if held:
            tokens, total = _totals(held)
            often = total >= LEAST_COUNT
            level = np.log2(total[often]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(tokens[often].view(np.int32)), pa.array(level)], ["token", "level"])

    parts = docs.select("text").mapInArrow(pre_aggregate, "part int, tokens array<int>, counts array<int>")
    return parts.repartition(n, "part").mapInArrow(merge, "token int, level int")


def _frequent(docs: DataFrame, width: int, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles, at most `bound` of them, sorted, and their levels."""
    counts = materialize(_counts(docs, width), "counts")
    total, least = 0, 64
    for row in counts.groupBy("level").count().orderBy(F.desc("level")).collect():  # a row per power of two
        total += row["count"]
        if total > bound:
            break
        least = row["level"]
    rows = counts.filter(F.col("level") >= least).toPandas()
    discard(counts)
    tokens = rows["token"].to_numpy(np.int32).view(np.uint32)
    order = np.argsort(tokens)
    return tokens[order], rows["level"].to_numpy(np.uint8)[order]


def _prefixes(docs: DataFrame, width: int, percent: int, bound: int) -> DataFrame:
    """(doc_id, k1, k2, n, h1, h2, bits, tokens): size, fingerprint and parities of the set, and its short lists, rarest first."""
    known = docs.sparkSession.sparkContext.broadcast(_frequent(docs, width, bound))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, levels = known.value
        for rows in w.chunks(batches, "text"):
            owner, hashes = w.shingles(*w.utf8(rows.column(3)), width)
            n = np.bincount(owner, minlength=len(rows))
            first = np.cumsum(n) - n
            fingerprints = []
            for salt in (0, 0x5851F42D4C957F2D):
                sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(w.mix(hashes ^ np.uint64(salt)), dtype=np.uint64)))
                fingerprints.append(pa.array(_signed(sums[first + n] - sums[first])))
            bits = _parities(hashes, owner, n)
            level = np.zeros(len(hashes), np.int64)
            if len(tokens):
                short = (hashes >> np.uint64(32)).astype(np.uint32)
                at = np.minimum(np.searchsorted(tokens, short), len(tokens) - 1)
                level = np.where(tokens[at] == short, levels[at], 0).astype(np.int64)
            order = np.argsort(owner * 64 + level, kind="stable")
            place = np.arange(len(owner)) - first[owner]
            skipped = (n * percent + 99) // 100 - 1
            short = order[place < (n - skipped)[owner]]
            lists = w.ragged(_signed(hashes[short]), owner[short], len(rows), pa.int64())
            own = [rows.column(k) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(n, pa.int64()), *fingerprints, bits, lists], ["doc_id", "k1", "k2", "n", "h1", "h2", "bits", "tokens"])

    read = docs.select(F.col("doc_id").cast("long"), *row_keys(), "text")
    return read.mapInArrow(run, "doc_id long, k1 long, k2 long, n long, h1 long, h2 long, bits binary, tokens array<long>")


@dataclass(frozen=True)
class _Texts:
    """Where the texts of the vertices are: the documents, and `heads(doc, k1, k2)`, a row's key per vertex; `parities(doc, n, bits)`."""

    docs: DataFrame
    heads: DataFrame
    parities: DataFrame
    repeat: bool  # whether several rows can have one key


def _sets(texts: _Texts, ids: DataFrame, width: int) -> DataFrame:
    """(doc, tokens): the whole sorted sets of the vertices named in `ids(doc)`, packed."""
    wanted = materialize(texts.heads.join(ids, "doc", "left_semi"), "wanted")
    marks = Bitmap(wanted, "k1", wanted.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            there = marks.holds(batch.column(0).to_numpy())
            for rows in w.chunks(iter([batch.filter(pa.array(there))]), "text"):
                owner, hashes = w.shingles(*w.utf8(rows.column(2)), width)
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), _packed(hashes, owner, len(rows))], ["k1", "k2", "tokens"])

    found = texts.docs.select(*row_keys(), "text").mapInArrow(run, "k1 long, k2 long, tokens binary")
    if texts.repeat:
        found = found.groupBy("k1", "k2").agg(F.first("tokens").alias("tokens"))
    return found.join(wanted, ["k1", "k2"]).select("doc", "tokens")


def _possible(pairs: DataFrame, parities: DataFrame, percent: int) -> DataFrame:
    """The rows of `pairs(a, b)` whose parities allow the required overlap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            both = np.add(rows.column(2).to_numpy(), rows.column(3).to_numpy())
            apart = np.fromiter((_differing(x.as_py(), y.as_py()) for x, y in zip(rows.column(4), rows.column(5))), np.int64, len(rows))
            kept = rows.filter(pa.array(apart * (100 + percent) <= (100 - percent) * both))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], ["a", "b"])

    x, y = (parities.select(F.col("doc").alias(end), F.col("n").alias(f"n_{end}"), F.col("bits").alias(f"bits_{end}")) for end in ("a", "b"))
    both = pairs.select("a", "b").join(x, "a").join(y, "b").select("a", "b", "n_a", "n_b", "bits_a", "bits_b")
    return both.mapInArrow(run, "a long, b long")


def _similar(pairs: DataFrame, texts: _Texts, width: int, percent: int) -> DataFrame:
    """The rows of `pairs(a, b)` that reach the required overlap, found by binary probes."""
    with batches_of(pairs.sparkSession, 2048):
        pairs = materialize(_possible(pairs, texts.parities, percent), "possible")
    ids = materialize(pairs.select(F.col("a").alias("doc")).distinct().union(pairs.select("b").distinct()).distinct(), "ids")
    with batches_of(pairs.sparkSession, 2048):
        sets = materialize(_sets(texts, ids, width), "sets")
    discard(ids)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            keep = []
            left, right = rows.column(2), rows.column(3)
            for k in range(len(rows)):
                x, y = (_unpacked(c[k].as_py()) for c in (left, right))
                if len(x) > len(y):
                    x, y = y, x
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[at] == x).sum())
                keep.append(both * (100 + percent) >= percent * (len(x) + len(y)))
            kept = rows.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], ["a", "b"])

    both = pairs.select("a", "b").join(sets.select(F.col("doc").alias("a"), F.col("tokens").alias("x")), "a")
    both = both.join(sets.select(F.col("doc").alias("b"), F.col("tokens").alias("y")), "b").select("a", "b", "x", "y")
    with batches_of(pairs.sparkSession, 256):
        found = materialize(both.mapInArrow(probe, "a long, b long").distinct(), "links")
    discard(sets, pairs)
    return found


def _groups(texts: _Texts, lists: DataFrame, width: int, percent: int) -> DataFrame:
    """(node, component) over the documents of `lists(token, doc, n, pos)`."""
    turn = F.pmod(F.xxhash64("doc"), F.lit(_TURN))
    # what the pair must share; a shingle behind the first n - needed places of either is a long list for it
    needed = F.ceil(percent * (F.col("n") + F.col("hub_n")) / (100 + percent))
    fits = (100 * F.least("n", "hub_n") >= percent * F.greatest("n", "hub_n")) & (F.col("pos") + needed <= F.col("n")) & (F.col("hub_pos") + needed <= F.col("hub_n"))
    hub_of = lists.groupBy("token").agg(F.min(F.struct(turn.alias("t"), "doc", "n", "pos")).alias("hub"))
    met = lists.join(hub_of, "token").withColumns({"b": F.col("hub.doc"), "hub_n": F.col("hub.n"), "hub_pos": F.col("hub.pos")}).filter((F.col("doc") != F.col("b")) & fits)
    often = met.groupBy(F.col("doc").alias("a"), "b").agg(F.count(F.lit(1)).alias("c"), F.first("n").alias("n"))
    start = materialize(often.filter(700 * F.col("c") >= (100 - percent) * F.col("n")).select("a", "b"), "pairs")
    links = _similar(start, texts, width, percent)
    discard(start)
    done = 0
    while True:
        groups = connected_components(links)
        if done >= _TURN:
            return groups
        named = lists.join(groups.withColumnRenamed("node", "doc"), "doc", "left").select("token", "doc", "n", "pos", F.coalesce("component", "doc").alias("group"), turn.alias("turn"))
        named = materialize(named.filter(F.col("turn") >= done), "named")
        mixed = named.groupBy("token").agg(F.count(F.lit(1)).alias("m"), F.min("group").alias("lo"), F.max("group").alias("hi")).filter("lo < hi")
        lists_left = materialize(named.join(mixed.select("token", "m"), "token"), "lists")
        discard(named, lists)
        longest = lists_left.agg(F.max("m")).first()[0]
        if longest is None:
            return groups
        until = _TURN if longest <= 64 else min(_TURN, max(done * 32, _TURN * 16 // longest))
        hubs = lists_left.filter(F.col("turn") < until).select("token", *[F.col(c).alias(f"hub_{c}") for c in ("doc", "n", "pos", "group", "turn")])
        met = lists_left.join(hubs, "token").filter(
            (F.struct("turn", "doc") > F.struct("hub_turn", "hub_doc")) & (F.col("group") != F.col("hub_group")) & fits
        )
        counted = met.groupBy(F.col("doc").alias("a"), F.col("hub_doc").alias("b"), "n", "hub_n").agg(F.count(F.lit(1)).alias("c"), F.max("pos").alias("i"), F.max("hub_pos").alias("j"))
        most = F.col("c") + F.least(F.col("n") - F.col("i"), F.col("hub_n") - F.col("j")) - 1
        pairs = materialize(counted.filter(most * (100 + percent) >= percent * (F.col("n") + F.col("hub_n"))).select("a", "b"), "pairs")
        links = links.union(_similar(pairs, texts, width, percent))
        lists = lists_left.select("token", "doc", "n", "pos")
        discard(pairs)
        done = until


def _lists_of(worded: DataFrame, heads: DataFrame) -> DataFrame:
    """(doc, n, tokens) of the rows of `worded` that are in `heads(doc)`; only rows that may be copies are shuffled for it."""
    copies = materialize(worded.select("doc").join(heads.select("doc"), "doc", "left_anti").select(F.xxhash64("doc").alias("key")), "copies")
    marks = Bitmap(copies, "key", copies.count())
    rows = worded.select("doc", "n", "tokens", F.xxhash64("doc").alias("key"))

    def marked(as_copy: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(marks.holds(batch.column(3).to_numpy()) == as_copy)).select(["doc", "n", "tokens"])

        return rows.mapInArrow(run, "doc long, n long, tokens array<long>")

    return marked(False).union(marked(True).join(heads.select("doc"), "doc", "left_semi"))


def _judged(docs: DataFrame, width: int, percent: int, frequent: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, k1, k2, n, first) of every row, and `repeated(k1, k2)`, the keys of several rows with words.

    `first` is the key of the row that leads the component: the smallest doc_id, null ids last; its
    fields are no_id, doc_id, k1, k2, doc. It is null where the text has no words.
    """
    docs = docs.select("doc_id", "text")
    with batches_of(docs.sparkSession, 2048):
        rows = materialize(_prefixes(docs, width, percent, frequent).withColumn("doc", F.monotonically_increasing_id()), "prefixes")
    worded, key = rows.filter("n > 0"), ["n", "h1", "h2"]
    repeated = materialize(worded.groupBy("k1", "k2").count().filter("count > 1").select("k1", "k2"), "repeated")
    leader = F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "k1", "k2", "doc")
    classes = materialize(worded.groupBy(*key).agg(F.min(leader).alias("own")), "classes")
    heads = classes.select("own.doc", "own.k1", "own.k2")
    postings = _lists_of(worded, heads).select("doc", "n", F.posexplode("tokens").alias("pos", "token")).select("token", "doc", "n", "pos")
    with batches_of(docs.sparkSession, 2048):
        known = materialize(_shared(postings), "lists")
    # The short lists, most of what was written, are not needed any more.
    prefixes, rows = rows, materialize(rows.drop("tokens"), "rows")
    discard(prefixes)
    groups = _groups(_Texts(docs, heads, rows.select("doc", "n", "bits"), not repeated.isEmpty()), known, width, percent)
    linked = materialize(groups.join(classes.select(F.col("own.doc").alias("node"), "own"), "node"), "linked")
    firsts = linked.groupBy("component").agg(F.min("own").alias("first"))
    moved = linked.join(firsts, "component").select(F.col("node").alias("doc"), "first")
    labels = classes.withColumn("doc", F.col("own.doc")).join(moved, "doc", "left").select(*key, F.coalesce("first", "own").alias("first"))
    return rows.select("doc_id", "k1", "k2", *key).join(labels, key, "left").select("doc_id", "k1", "k2", "n", "first"), repeated


def jaccard_groups(docs: DataFrame, width: int = w.SHINGLE, percent: int = 75, frequent: int = FREQUENT) -> DataFrame:
    """One row per row of `docs(doc_id, text)`: doc_id, n_shingles, component_id.

    Two documents link when 100 * intersection >= percent * union of their distinct shingles;
    component_id is the smallest doc_id reachable by links, the document itself included. Texts
    that are null, empty or without words have no shingles and link with nothing, not even each
    other. A null doc_id links like others, gets its count and a null component_id. Rows that repeat
    a doc_id are judged each by its own text. Other columns of `docs` are not read; an empty table
    gives none.
    """
    judged, _ = _judged(docs, width, percent, frequent)
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("first.doc_id", "doc_id"))
    return judged.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def first_of_groups(docs: DataFrame, width: int = w.SHINGLE, percent: int = 75, frequent: int = FREQUENT) -> DataFrame:
    """Whole rows of `docs`: exactly one of each component of `jaccard_groups`, and every text without words.

    The row with the smallest doc_id stays, null ids last; of rows with equal doc_id and text the
    smallest by its columns in order.
    """
    judged, repeated = _judged(docs, width, percent, frequent)
    extra = materialize(judged.filter("n > 0 and not (k1 = first.k1 and k2 = first.k2)").select("k1", "k2").distinct(), "extra")
    kept = docs.select(F.struct("*").alias("_row"), *row_keys()).join(extra, ["k1", "k2"], "left_anti")
    if repeated.isEmpty():
        return kept.select("_row.*")
    once = kept.join(repeated, ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.min("_row").alias("_row"))
    return kept.join(repeated, ["k1", "k2"], "left_anti").select("_row").union(once.select("_row")).select("_row.*")


def _shared(postings: DataFrame) -> DataFrame:
    """The postings of tokens that more than one document holds.

    Sorted by token within partitions and read once: a row stays if the token before or after it is
    the same. No list is gathered.
    """
    n = int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_token, sent = None, None, True
        for rows in batches:
            if not len(rows):
                continue
            token = rows.column(0).to_numpy()
            before = np.concatenate(([last_token is not None and last_token == token[0]], token[1:] == token[:-1]))
            after = np.concatenate((token[1:] == token[:-1], [False]))
            if before[0] and not sent:
                yield last
            keep = before | after
            last, last_token, sent = rows.slice(len(rows) - 1), token[-1], bool(keep[-1])
            yield rows.filter(pa.array(keep))

    return postings.repartition(n, "token").sortWithinPartitions("token").mapInArrow(run, postings.schema)
