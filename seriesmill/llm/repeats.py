"""Removes long byte strings that occur earlier in the corpus, found with common-prefix interval trees.

A byte goes when it is covered by a string of ``length`` bytes (100) that also starts earlier: in a document of smaller
id, or earlier in the same one. Texts are UTF-8 bytes; strings never cross documents and are judged on the input.

1. Every window of ``length`` bytes names an anchor, the leftmost of its 24-byte grams with the smallest hash. Equal
   windows name equal anchors, so only anchors that occur twice matter, and all equal windows meet at one anchor.
2. Around each such anchor lies the context of all windows that can name it (176 bytes at most). Equal contexts (128 bits of
   hashes) are one: all but the first are covered whole. This takes up exact copies and shared passages before anything is grouped.
3. The different contexts of an anchor form an enhanced suffix array. As equal windows lie alike around their anchors,
   suffixes are compared with those that start as far before theirs: the bytes from the anchor on are sorted once, then
   one byte before it is put in front at a time. A stack scan over the common prefix lengths yields the interval tree; an
   interval whose suffixes are preceded by different bytes is a maximal repeat, and all its occurrences but the earliest
   are covered. (Without anchors, ``SuffixArray`` sorts all suffixes by prefix doubling.)
4. An anchor with more than ``GROUP_LIMIT`` different contexts (the rim of a passage that very many documents share) is
   not put into one array: its windows are compared by 128-bit hashes, minima combined before the shuffle. The result
   is the same.

Defined results: a null text is empty; texts below ``length`` bytes lose nothing; null ids come last; rows with the same
id and text are one document and get the same result; texts with the same id are ordered by hash. An empty table gives
an empty result. Any text length works, windows are taken in pieces. Columns other than the named ones are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesmill.llm import arrays
from seriesmill.llm.common import marks, ready, settle, utf8

LENGTH, GRAM = 100, 24
GROUP_LIMIT = 8192  # contexts whose suffix array (about 200 MB of arrays) fits a Python worker
_PIECE = 4 << 20
_PLACE = np.uint64((1 << 24) - 1)  # low bits of a packed gram: its place in the piece
_CHUNK = 512 << 10
KEY = ["ord", "var"]


# ---- anchors -----------------------------------------------------------------------------------------------------


def anchors(body: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and hashes of the anchors that the windows of all texts name, and hashes of their contexts."""
    span, reach = length - GRAM + 1, length - GRAM  # grams of a window; bytes of a context before its anchor
    places, grams, contexts = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for at in range(0, max(0, len(body) - length + 1), _PIECE):
        low = max(0, at - reach)
        piece = body[low : at + _PIECE + 2 * length]
        prefix = arrays.prefix_hash(piece)
        start = np.arange(len(piece) - GRAM + 1)
        gram = arrays.range_hash(prefix, start, start + GRAM)
        least = (gram & ~_PLACE) | start.astype(np.uint64)
        width = 1
        while width * 2 <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        n = len(piece) - length + 1
        least = np.minimum(least[:n], least[span - width : span - width + n])
        first = np.arange(n) + low
        inside = (first >= at) & (first < at + _PIECE) & (first + length <= ends[np.searchsorted(ends, first, side="right")])
        chosen = np.unique((least[inside] & _PLACE).astype(np.int64))
        doc = np.searchsorted(ends, chosen + low, side="right") - 1
        begin = np.maximum(chosen - reach, ends[doc] - low)
        around = arrays.range_hash(prefix, begin, np.minimum(chosen + length, ends[doc + 1] - low))
        places.append(chosen + low)
        grams.append(gram[chosen])
        contexts.append(arrays.mix64(around ^ (chosen - begin).astype(np.uint64)))
    return np.concatenate(places), np.concatenate(grams), np.concatenate(contexts)


def _anchor_rows(length: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in arrays.slices(batch.column("text")):
                keys = batch.slice(at, len(part))
                at += len(part)
                body, ends = arrays.joined(part)
                place, gram, context = anchors(body, ends, length)
                doc = np.searchsorted(ends, place, side="right") - 1
                right = np.minimum(ends[doc + 1] - place, length)
                columns = [pa.array(gram.view(np.int64)), pa.array(context.view(np.int64)), *[keys.column(c).take(pa.array(doc)) for c in KEY]]
                columns += [pa.array((place - ends[doc]).astype(np.int32)), pa.array(right.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["gram", "id", *KEY, "pos", "right"])

    return rows


def _contexts(length: int):
    """The bytes of the contexts that are wanted of each text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[str, list] = {c: [] for c in ("gram", "kinds", "left", "context", *KEY, "pos")}
        for batch in batches:
            for text, ord_, var, at in zip(*[batch.column(c) for c in ("text", *KEY, "at")]):
                raw, ord_, var = text.as_py().encode("utf-8", "replace"), ord_.as_py(), var.as_py()
                wanted = (at.values.field(c).to_pylist() for c in ("pos", "gram", "kinds"))
                for pos, gram, kinds in zip(*wanted):
                    left = min(pos, length - GRAM)
                    for c, v in zip(out, (gram, kinds, left, raw[pos - left : pos + length], ord_, var, pos)):
                        out[c].append(v)
                if len(out["pos"]) >= 20_000:
                    yield _batch(out)
        if out["pos"]:
            yield _batch(out)

    return rows


def _batch(out: dict[str, list]) -> pa.RecordBatch:
    types = {"gram": pa.int64(), "kinds": pa.int64(), "left": pa.int32(), "context": pa.binary(), "ord": pa.int64(), "var": pa.int32(), "pos": pa.int32()}
    batch = pa.RecordBatch.from_arrays([pa.array(v, types[c]) for c, v in out.items()], list(out))
    for v in out.values():
        v.clear()
    return batch


# ---- enhanced suffix array ------------------------------------------------------------------------------------------


class SuffixArray:
    """Sorted suffixes of several byte strings with at least ``least`` bytes, and the common prefixes of neighbours.

    With ``anchors``, the place in each string of bytes that they may share, suffixes are sorted and compared only with
    those that start as far before their anchor, and only those that have ``least`` bytes in common with another are listed.
    """

    def __init__(self, strings: list[bytes], least: int, anchors: np.ndarray | None = None):
        sizes = np.array([len(s) for s in strings], np.int64)
        first = np.concatenate(([0], np.cumsum(sizes + 1)))  # a separator, smaller than any byte, ends each string
        n = int(first[-1])
        symbols = np.zeros(n, np.int16)
        body = np.frombuffer(b"".join(strings), np.uint8)
        inner = np.ones(n, bool)
        inner[first[1:] - 1] = False
        symbols[inner] = body.astype(np.int16) + 1
        self.owner = np.repeat(np.arange(len(strings)), sizes + 1)
        self.first, self.left = first, np.full(n, -1, np.int16)
        self.left[1:] = symbols[:-1]
        self.left[self.left == 0] = -1  # starts of strings have no byte before
        if anchors is None:
            until = np.repeat(first[1:] - 1, sizes + 1) - np.arange(n)  # bytes up to the end of the string
            self.suffixes, self.common = _sorted_suffixes(symbols.astype(np.int64), until, int(sizes.max(initial=0)), least)
        else:
            self.suffixes, self.common = _suffixes_at_anchors(symbols, body, first, anchors.astype(np.int64), least)

    def intervals(self, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and last suffix and depth of the tree's intervals whose suffixes are preceded by different bytes."""
        left = self.left[self.suffixes]
        changes = np.concatenate(([0], np.cumsum((left[1:] != left[:-1]) | (left[1:] < 0) | (left[:-1] < 0))))
        turns = np.flatnonzero(np.diff(np.concatenate(([False], self.common >= least, [False])).astype(np.int8)))
        low, high = turns[::2], turns[1::2]
        some = changes[high] > changes[low]  # else all intervals within are preceded by the same byte
        low, high = low[some], high[some]
        if not len(low):
            return low, high, low
        bounds = np.stack((low, high), axis=1).ravel()
        depth = np.minimum.reduceat(np.append(self.common, 0), bounds)[::2]
        flat = depth == np.maximum.reduceat(np.append(self.common, 0), bounds)[::2]  # one interval and none within
        out = [(low[flat], high[flat], depth[flat])]
        nested = [i for a, b in zip(low[~flat].tolist(), high[~flat].tolist()) for i in self._nested(a, b, changes)]
        out.append(tuple(np.array(nested, np.int64).reshape(-1, 3).T))
        return tuple(np.concatenate(c) for c in zip(*out))

    def _nested(self, first: int, last: int, changes: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """The intervals between two suffixes by a stack scan over their common prefixes."""
        common, changes = [*self.common[first:last].tolist(), 0], changes[first : last + 1].tolist()
        stack: list[tuple[int, int]] = []
        for i, depth in enumerate(common):  # i: right end of what may close now
            low = i
            while stack and stack[-1][0] > depth:
                size, low = stack.pop()
                if changes[i] > changes[low]:
                    yield first + low, first + i, size
            if depth and (not stack or stack[-1][0] < depth):
                stack.append((depth, low))

    def maximal_repeats(self, least: int) -> Iterator[tuple[int, np.ndarray]]:
        """Length and all occurrences (places) of every repeat that cannot be extended to either side."""
        for low, high, size in zip(*(c.tolist() for c in self.intervals(least))):
            yield size, self.suffixes[low : high + 1]

    def repeats_at_once(self, least: int, limit: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``maximal_repeats``, many together: lengths, how many occurrences each has, and all occurrences in a row.

        About ``limit`` occurrences come at once; a repeat is never split.
        """
        low, high, size = self.intervals(least)
        many = high - low + 1
        cuts = np.flatnonzero(np.diff(np.cumsum(many) // limit)) + 1
        for low, many, size in zip(*(np.split(c, cuts) for c in (low, many, size))):
            if len(low):
                ends = np.cumsum(many)
                yield size, many, self.suffixes[np.repeat(low - ends + many, many) + np.arange(ends[-1])]


def _sorted_suffixes(symbols: np.ndarray, until: np.ndarray, longest: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes by prefix doubling from 4 symbols on; levels[k] ranks the prefixes of 4 * 2^k symbols."""
    n = len(symbols)
    padded = np.concatenate((symbols, np.zeros(3, np.int64)))
    code = padded[:n]
    for i in range(1, 4):
        code = code << 9 | padded[i : n + i]
    levels, width = [np.unique(code, return_inverse=True)[1]], 4
    while width < longest:
        rank = levels[-1]
        after = np.zeros(n, np.int64)
        after[:-width] = rank[width:] + 1
        levels.append(np.unique(rank * (n + 1) + after, return_inverse=True)[1])
        width *= 2
    start = np.flatnonzero(until >= least)
    suffixes = start[np.argsort(levels[-1][start], kind="stable")]
    a, b = suffixes[:-1].copy(), suffixes[1:].copy()
    room = np.minimum(until[a], until[b])
    common = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        same = (levels[k][a] == levels[k][b]) & (common < room)
        common += same * (4 << k)
        a, b = np.minimum(a + same * (4 << k), n - 1), np.minimum(b + same * (4 << k), n - 1)
    going = np.ones(len(a), bool)
    for _ in range(3):
        going &= (symbols[a] == symbols[b]) & (common < room)
        common += going
        a, b = np.minimum(a + going, n - 1), np.minimum(b + going, n - 1)
    return suffixes, np.minimum(common, room)  # common[i]: of suffixes i and i + 1


def _suffixes_at_anchors(
    symbols: np.ndarray, body: np.ndarray, first: np.ndarray, anchors: np.ndarray, least: int
) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes by their distance from the anchor: the bytes from it on are sorted once, then one byte more before it is put
    in front at a time, which a stable sort by that byte alone brings into order. What has no partner left is out."""
    n, at = len(anchors), first[:-1] + anchors
    right = np.diff(first) - 1 - anchors
    wide = -(-int(right.max(initial=0)) // 8) * 8
    padded = np.concatenate((body, np.zeros(wide + 1, np.uint8)))
    tails = np.lib.stride_tricks.sliding_window_view(padded, wide)[at - np.arange(n)] * (np.arange(wide) < right[:, None])
    words = tails.astype(np.uint8).view(">u8").astype(np.uint64)
    order = np.lexsort((right, *words.T[::-1]))
    tails, right = tails[order], right[order]
    differ = np.concatenate((tails[1:] != tails[:-1], np.ones((max(n - 1, 0), 1), bool)), axis=1)
    shared = np.minimum(np.argmax(differ, axis=1), np.minimum(right[1:], right[:-1])).astype(np.int32)
    least_of = [shared]  # least_of[j][i]: least of shared[i : i + 2^j]
    while 2 << len(least_of) - 1 <= len(shared):
        last, step = least_of[-1], 1 << len(least_of) - 1
        least_of.append(np.minimum(last[:-step], last[step:]))
    table = np.zeros((len(least_of), len(shared)), np.int32)
    for row, values in zip(table, least_of):
        row[: len(values)] = values

    suffixes, commons = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    rank, at, room = np.arange(n), at[order], anchors[order]
    near = shared >= max(1, least - int(room.max(initial=0)))  # neighbours with the same bytes before; others never reach least
    back = 0
    while len(rank) > 1:
        pair = np.flatnonzero(near)
        span = np.frexp(rank[pair + 1] - rank[pair])[1] - 1
        common = np.zeros(len(rank), np.int64)
        common[pair] = back + np.minimum(table[span, rank[pair]], table[span, rank[pair + 1] - (1 << span)])
        deep = common >= least
        listed = deep.copy()
        listed[1:] |= deep[:-1]
        suffixes.append(at[listed] - back)
        commons.append(common[listed])
        back += 1
        group = np.concatenate(([0], np.cumsum(~near)))
        keep = np.concatenate((near, [False])) | np.concatenate(([False], near))
        keep &= room >= back
        rank, at, room, group = rank[keep], at[keep], room[keep], group[keep]
        before = symbols[at - back]
        order = np.argsort(before, kind="stable")
        rank, at, room, group, before = (c[order] for c in (rank, at, room, group, before))
        near = (before[1:] == before[:-1]) & (group[1:] == group[:-1])
    return np.concatenate(suffixes), np.concatenate(commons)[: max(0, sum(map(len, commons)) - 1)]


def later_runs(
    strings: list[bytes], doc: np.ndarray, base: np.ndarray, length: int = LENGTH, anchors: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs (string, start, end) covered by repeats of ``length`` bytes or more that also start earlier.

    String i lies at byte ``base[i]`` of the document with rank ``doc[i]``; strings of one document may overlap. With
    ``anchors``, only repeats that lie alike around the anchors of their strings count.
    """
    tree = SuffixArray(strings, length, anchors)
    edge = np.zeros(int(tree.first[-1]) + 1, np.int64)
    for size, many, found in tree.repeats_at_once(length):
        owner, starts = tree.owner[found], np.cumsum(many) - many
        docs, at = doc[owner], base[owner] + found - tree.first[owner]
        lowest = docs == np.repeat(np.minimum.reduceat(docs, starts), many)
        earliest = np.minimum.reduceat(np.where(lowest, at, np.iinfo(np.int64).max), starts)
        later = ~lowest | (at > np.repeat(earliest, many))
        edge += np.bincount(found[later], minlength=len(edge))
        edge -= np.bincount(found[later] + np.repeat(size, many)[later], minlength=len(edge))
    covered = np.concatenate(([False], np.cumsum(edge) > 0, [False]))
    turns = np.flatnonzero(covered[1:] != covered[:-1])
    start, end = turns[::2], turns[1::2]
    owner = tree.owner[start] if len(start) else np.zeros(0, np.int64)
    return owner, start - tree.first[owner], end - tree.first[owner]


def _tree_runs(length: int):
    """Covered runs of rows that come sorted by anchor; whole anchors are taken together, about ``_CHUNK`` bytes at once."""

    def runs_of(rows: pa.Table) -> pa.RecordBatch:
        ord_, var = (rows.column(c).to_numpy() for c in KEY)
        left = rows.column("left").to_numpy()
        base = rows.column("pos").to_numpy().astype(np.int64) - left
        order = np.lexsort((var, ord_))
        fresh = np.concatenate(([False], (ord_[order][1:] != ord_[order][:-1]) | (var[order][1:] != var[order][:-1])))
        doc = np.empty(len(order), np.int64)
        doc[order] = np.cumsum(fresh)
        owner, start, end = later_runs(rows.column("context").to_pylist(), doc, base, length, left)
        values = [ord_[owner], var[owner], base[owner] + start, base[owner] + end]
        return pa.RecordBatch.from_arrays([pa.array(values[0]), pa.array(values[1])] + [pa.array(v.astype(np.int32)) for v in values[2:]], [*KEY, "start", "end"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) * (2 * length) >= _CHUNK:
                table = pa.Table.from_batches(held)
                gram = table.column("gram").to_numpy()
                cuts = np.flatnonzero(gram[1:] != gram[:-1]) + 1
                at = 0
                for cut in cuts.tolist():
                    if (cut - at) * (2 * length) >= _CHUNK or cut == cuts[-1]:
                        yield runs_of(table.slice(at, cut - at))
                        at = cut
                held = table.slice(at).to_batches()
        if held:
            yield runs_of(pa.Table.from_batches(held))

    return rows


def _windows(length: int):
    """128-bit hash and place of every window of every context."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                piece, ids, which, starts = batch.slice(i, 500), [], [], []
                for k, (context, pos, left) in enumerate(zip(*[piece.column(c).to_pylist() for c in ("context", "pos", "left")])):
                    for s in range(len(context) - length + 1):
                        ids.append(xxhash.xxh3_128_digest(context[s : s + length]))
                        which.append(k)
                        starts.append(pos - left + s)
                own = [piece.column(c).take(pa.array(which, pa.int64())) for c in KEY]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), *own, pa.array(starts, pa.int32())], ["id", *KEY, "pos"])

    return rows


# ---- tables ----------------------------------------------------------------------------------------------------------


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``ord`` and ``var`` (order of documents), ``doc_id``, ``text``, ``null_text`` and the other columns as the struct ``row``.

    Only where ids repeat are texts told apart.
    """
    own = [docs[c] for c in docs.columns if c != text_col]
    rest = (F.struct(*own) if own else F.lit(None)).alias("row")
    null = docs[text_col].isNull().alias("null_text")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), null, rest)
    docs = docs.withColumn("ord", F.coalesce("doc_id", F.lit(2**63 - 1)))
    if docs.groupBy("ord").count().filter("count > 1").isEmpty():
        return docs.withColumn("var", F.lit(0))
    versions = docs.select("ord", F.xxhash64("text").alias("h")).distinct()
    versions = versions.withColumn("var", F.row_number().over(Window.partitionBy("ord").orderBy("h")) - 1)
    return docs.withColumn("h", F.xxhash64("text")).join(versions, ["ord", "h"]).drop("h")


def covered_runs(docs: DataFrame, length: int = LENGTH, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """``ord``, ``var``, ``start``, ``end`` of covered byte ranges; ranges may overlap. ``docs`` comes from ``keyed``."""
    place = F.struct(*KEY, "pos")
    named = docs.filter(F.octet_length("text") >= length).select("text", *KEY)
    rows = named.mapInArrow(_anchor_rows(length), "gram bigint, id bigint, ord bigint, var int, pos int, right int")
    same, anchor = Window.partitionBy("gram", "id").orderBy(*KEY, "pos"), Window.partitionBy("gram")
    rows = rows.repartition("gram").withColumn("nth", F.dense_rank().over(same))  # one exchange and one sort for all three
    rows = rows.withColumn("kind", F.dense_rank().over(anchor.orderBy("id"))).withColumn("kinds", F.max("kind").over(anchor))
    rows = rows.filter("nth > 1 OR kinds > 1")
    known = F.col("nth") == 1  # a context that occurred before is covered whole and needs no further look
    found = settle(rows.select(F.when(known, F.col("gram")).alias("gram"), F.when(known, F.col("kinds").cast("long")).alias("kinds"), *KEY, "pos", "right"), "contexts")
    start = F.col("pos") - F.least("pos", F.lit(length - GRAM))
    copies = found.filter("gram IS NULL").select(*KEY, start.alias("start"), (F.col("pos") + F.col("right")).alias("end"))

    todo = found.filter("gram IS NOT NULL").groupBy(*KEY).agg(F.collect_list(F.struct("pos", "gram", "kinds")).alias("at"))  # bounded by a text
    schema = "gram bigint, kinds bigint, left int, context binary, ord bigint, var int, pos int"
    wanted = marks(found.filter("gram IS NOT NULL").select(F.xxhash64(*KEY)))  # other texts are not moved
    work = settle(named.filter(wanted(F.xxhash64(*KEY))).join(todo, KEY).select("text", *KEY, "at").mapInArrow(_contexts(length), schema), "contexts")
    runs = "ord bigint, var int, start int, end int"
    few = work.filter(F.col("kinds") <= group_limit).drop("kinds").repartition("gram").sortWithinPartitions("gram")
    trees = few.mapInArrow(_tree_runs(length), runs)

    crowded = work.filter(F.col("kinds") > group_limit)
    windows = settle(crowded.mapInArrow(_windows(length), "id binary, ord bigint, var int, pos int"), "windows")
    least = windows.groupBy("id").agg(F.min(place).alias("p"), F.count("*").alias("n")).filter("n > 1").drop("n")
    rim = windows.join(least, "id").filter(place != F.col("p"))
    rim = rim.select(*KEY, F.col("pos").alias("start"), (F.col("pos") + length).alias("end"))
    return copies.unionByName(trees).unionByName(rim)


def spans(runs: DataFrame) -> DataFrame:
    """Per document the maximal covered runs, an ascending array of ``start`` and ``end``."""
    order = Window.partitionBy(*KEY).orderBy("start", "end")
    upto = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.withColumn("new", F.when(F.col("start") <= upto, 0).otherwise(1))
    runs = runs.withColumn("run", F.sum("new").over(order))
    runs = runs.groupBy(*KEY, "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return runs.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))


def kept_bytes(raw: Column, removed: Column) -> Column:
    """The bytes outside the removed spans, one after another."""
    n = F.octet_length(raw)
    piece = lambda s, i: F.substring(
        raw, F.when(i == 0, 0).otherwise(F.get(removed, i - 1)["end"]) + 1,
        s["start"] - F.when(i == 0, 0).otherwise(F.get(removed, i - 1)["end"]),
    )
    last = F.coalesce(F.element_at(removed, -1)["end"], F.lit(0))
    pieces = F.transform(removed, piece)
    return F.aggregate(pieces, F.lit(b""), lambda a, b: F.concat(a, b), lambda a: F.concat(a, F.substring(raw, last + 1, n - last)))


def whole_characters(raw: Column, removed: Column) -> Column:
    """Spans widened so that they begin and end between characters."""

    def inner(at: Column) -> Column:  # is the byte at this place not the first of its character
        return F.coalesce(F.conv(F.hex(F.substring(raw, at + 1, 1)), 16, 10).cast("int").between(128, 191), F.lit(False))

    def back(at: Column, step: int, tries: int) -> Column:
        return at if not tries else F.when(inner(at), back(at + step, step, tries - 1)).otherwise(at)

    return F.transform(removed, lambda s: F.struct(back(s["start"], -1, 3).alias("start"), back(s["end"], 1, 3).alias("end")))


def _with_spans(docs: DataFrame, length: int, id_col: str, text_col: str, group_limit: int) -> DataFrame:
    ready(docs.sparkSession)
    rows = keyed(docs, id_col, text_col)
    gone = settle(spans(covered_runs(rows, length, group_limit)), "spans")
    none = F.array().cast("array<struct<start:int,end:int>>")
    cut = marks(gone.select(F.xxhash64(*KEY)))(F.xxhash64(*KEY))
    whole = rows.filter(~cut).withColumn("spans", none)  # texts that lose nothing are not moved
    out = rows.filter(cut).join(gone, KEY, "left").withColumn("spans", F.coalesce("spans", none))
    return whole.unionByName(out).withColumn("raw", utf8(F.col("text")))


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", group_limit: int = GROUP_LIMIT) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``spans`` (removed byte ranges) and ``kept`` (the remaining bytes) of every row."""
    out = _with_spans(docs, length, id_col, text_col, group_limit).select("doc_id", "raw", "spans")
    kept = F.when(F.size("spans") == 0, F.col("raw")).otherwise(kept_bytes(F.col("raw"), F.col("spans")))
    return out.select("doc_id", F.octet_length("raw").cast("long").alias("n_bytes"), "spans", kept.alias("kept"))


def without_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """The rows of ``docs`` with the repeats cut out of their texts.

    A character of which a byte goes, goes whole. A text may become empty; its row stays. Null texts stay null.
    ``chars_col`` is counted anew.
    """
    out = _with_spans(docs, length, id_col, text_col, GROUP_LIMIT)
    out = out.withColumn("spans", whole_characters(F.col("raw"), F.col("spans")))
    cut = F.when(F.size("spans") == 0, F.col("text")).otherwise(kept_bytes(F.col("raw"), F.col("spans")).cast("string"))
    out = out.withColumn("cut", F.when(F.col("null_text"), None).otherwise(cut))
    made = {text_col: F.col("cut"), chars_col: F.when(F.size("spans") == 0, F.col(f"row.{chars_col}")).otherwise(F.char_length("cut").cast("long")) if chars_col in docs.columns else None}
    return out.select(*[(made[c] if c in made else F.col("row").getField(c)).alias(c) for c in docs.columns])
