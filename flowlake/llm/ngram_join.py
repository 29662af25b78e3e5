"""Similarity join of texts by the Jaccard similarity of their word n-gram sets, with a prefix tree.

Words are lower-cased (A-Z) runs of ``[^\\x20\\x09-\\x0D]``. A text's set holds its distinct n-grams; a text
with fewer words has the whole sequence as its one n-gram. Two texts link when ``den * common >= num * union``.

1. Equal sets form classes, so copies are never compared. One global order of n-grams puts those that occur in
   most texts first (``FREQUENT`` ones by counted classes of frequency, all others by hash).
2. Texts that link share an n-gram among the rarest ``n - ceil(num * n / den) + 1`` of each. Texts that share
   one get the least of them as group. A text leaves a group in which no other has a size that it can link with. A group of more than ``BLOCK`` texts is cut into bands of set size, so wide that
   sets that link lie in one band or in neighbours; a text goes to its own band and, as a guest, to the next one. What
   is left is cut into blocks of about ``BLOCK`` texts and every two blocks of a band meet, so a hot group takes many tasks.
3. Within two blocks, counts of the n-grams in bins, about sixteen to a bin, bound the difference of two sets from
   below. Texts that can link with none leave; only the sets of the rest are fetched.
4. The rest are stored in a trie in the common order. All sets of the other block walk down it together: a node's
   overlap with each is its parent's plus its own, shared by all sets below, and a set leaves a subtree as soon as
   what is left of it or below the node cannot reach the overlap that is needed.
   Two texts that share their first group meet in no other.
5. The links' forest goes to distributed connected components. Links are counted, with their copies, where the
   two meet in the least group they share.

N-grams are compared by 64-bit hashes and equal sets are recognised by 64-bit sums: among 10^9 different sets
two are mistaken with a chance of about one in thirty.

Edge cases: texts without words, and null, have empty sets and are linked with nothing; rows that repeat a
doc_id are rows of their own; a null doc_id has itself as component if nothing else is linked; an empty table
gives an empty result; further columns are left aside.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlake.llm import kernels as K
from flowlake.llm.components import components
from flowlake.llm.routing import numbered, without_ids
from flowlake.session import cut_lineage, drop_scratch, temporary_tables

#: N-grams that are counted before the counts are handed on.
BUFFER = 4 << 20
#: Most n-grams with a counted frequency (16 bytes each, broadcast); the rest are ordered by hash.
FREQUENT = 1 << 20
#: An n-gram of more than this share of all texts is a group of its own.
HOT_SHARE = 0.05
BLOCK = 512
#: Cells of the table of a trie's elements and the sets that walk down it.
PROBE_CELLS = 48 << 20
_BINS = (5, 14)  # least and most bits of a bin's number
_ROUTE_BITS = 1 << 26


class Rule(NamedTuple):
    """N-gram width and the threshold num / den."""
    width: int = 3
    num: int = 90
    den: int = 100

    def prefix(self, size: np.ndarray) -> np.ndarray:
        return size - (-(-self.num * size // self.den)) + 1

    def band(self, size: Column) -> Column:
        """The band of a set size: sizes of sets that link are in the same one or in neighbours."""
        width = max(math.log(self.den / self.num) * (1 + 1e-9), 1e-3)  # wider than the ratio, so rounding parts no pair
        return F.floor(F.log(size) / width).cast("int")

    def needed(self, size: int, sizes: np.ndarray) -> np.ndarray:
        """Least common n-grams of sets that link."""
        return -(-self.num * (size + sizes) // (self.num + self.den))


def ngram_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct n-grams of a slice, by row, then hash."""
    found = K.words(data, offsets, K.NOT_SPACE)
    count = np.bincount(found.row, minlength=len(offsets) - 1)
    begin = np.searchsorted(found.row, np.arange(len(offsets) - 1))
    hashes = K.windows(found.hash, width)
    whole = found.row[:len(hashes)] == found.row[width - 1:] if len(hashes) else np.zeros(0, bool)
    rows, values = [found.row[:len(hashes)][whole]], [hashes[whole]]
    for short in range(1, width):
        at = np.flatnonzero(count == short)
        if len(at):
            rows.append(at)
            values.append(K.windows(found.hash, short)[begin[at]])
    row, value = np.concatenate(rows), np.concatenate(values)
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    first = np.ones(len(row), bool)
    first[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[first], value[first]


def _set_names(row: np.ndarray, value: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row the size of its set and a 64-bit name of the set (0 without n-grams)."""
    size = np.bincount(row, minlength=rows)
    total = np.zeros(len(value) + 1, np.uint64)
    np.cumsum(K.mix(value ^ np.uint64(0x5851F42D4C957F2D)), out=total[1:], dtype=np.uint64)
    end = np.cumsum(size)
    name = K.mix(total[end] - total[end - size] + size.astype(np.uint64))
    return size, np.where(size > 0, name, 0).astype(np.uint64)


def binned(row: np.ndarray, value: np.ndarray, size: np.ndarray) -> list[bytes]:
    """Per row how many n-grams lie in each of its bins (255 at most), by the leading bits of their hashes. The
    number of bins is the power of two that gives a bin eight to sixteen n-grams."""
    bits = np.clip(np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64) - 4, *_BINS)
    end = np.cumsum(1 << bits)
    begin = end - (1 << bits)
    counts = np.bincount(begin[row] + (value >> (64 - bits[row]).astype(np.uint64)).astype(np.int64), minlength=int(end[-1]) if len(end) else 0)
    counts = np.minimum(counts, 255).astype(np.uint8)
    return [counts[a:b].tobytes() for a, b in zip(begin.tolist(), end.tolist())]


def _count(rule: Rule):
    """Per text its set's name, size and bins; n-grams that occur in several texts of a buffer, with that number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        buffer: list[np.ndarray] = []
        held = 0

        def counts() -> pa.RecordBatch:
            token, n = np.unique(np.concatenate(buffer or [np.zeros(0, np.uint64)]), return_counts=True)
            often = n > 1
            none = pa.nulls(int(often.sum()), pa.int64())
            return pa.RecordBatch.from_pydict({"doc_id": none, "node": none, "size": none, "bins": pa.nulls(len(none), pa.binary()),
                                               "token": K.signed(token[often]), "n": pa.array(n[often])})

        for batch in batches:
            for low, high, data, offsets in K.text_slices(batch.column(1)):
                rows = high - low
                row, value = ngram_sets(data, offsets, rule.width)
                size, name = _set_names(row, value, rows)
                bins = binned(row, value, size)
                none = pa.nulls(rows, pa.int64())
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column(0).slice(low, rows), "node": K.signed(name), "size": pa.array(size),
                    "bins": pa.array(bins, pa.binary()), "token": none, "n": none})
                fresh = np.array([not (x in seen or seen.add(x)) for x in name.tolist()], bool)
                value = value[fresh[row]]
                buffer.append(value)
                held += len(value)
                if held > BUFFER:
                    yield counts()
                    buffer, held = [], 0
        yield counts()
    return run


class Order(NamedTuple):
    """The global order: counted n-grams, sorted by hash, with their class of frequency."""
    tokens: np.ndarray
    classes: np.ndarray
    quick: np.ndarray

    @classmethod
    def of(cls, tokens: np.ndarray, counts: np.ndarray) -> Order:
        order = np.argsort(tokens)
        quick = np.zeros(1 << 20, bool)
        quick[tokens >> np.uint64(44)] = True
        return cls(tokens[order], np.floor(4 * np.log2(np.maximum(counts[order], 1))).astype(np.uint8), quick)

    def rank(self, value: np.ndarray) -> np.ndarray:
        """Class of frequency, 0 for those that were not counted."""
        out = np.zeros(len(value), np.uint8)
        if len(self.tokens):
            at = np.flatnonzero(self.quick[value >> np.uint64(44)])
            place = np.minimum(np.searchsorted(self.tokens, value[at]), len(self.tokens) - 1)
            hit = self.tokens[place] == value[at]
            out[at[hit]] = self.classes[place[hit]]
        return out


def _prefixes(rule: Rule, shared, hot_class: int):
    """(token, node) of the rarest n-grams of every different set; ``hot`` marks n-grams that are groups by themselves."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order: Order = shared.value
        seen: set[int] = set()
        for batch in batches:
            for low, high, data, offsets in K.text_slices(batch.column(0)):
                row, value = ngram_sets(data, offsets, rule.width)
                size, name = _set_names(row, value, high - low)
                fresh = np.array([not (x in seen or seen.add(x)) for x in name.tolist()], bool)
                own = fresh[row]
                row, value = row[own], value[own]
                rank = order.rank(value)
                by = np.lexsort((value, rank, row))
                row, value, rank = row[by], value[by], rank[by]
                kept = np.where(fresh, size, 0)
                place = np.arange(len(row)) - (np.cumsum(kept) - kept)[row]
                early = place < rule.prefix(size)[row]
                yield pa.RecordBatch.from_pydict({
                    "token": K.signed(value[early]), "node": K.signed(name[row[early]]), "hot": pa.array(rank[early] >= hot_class)})
    return run


def _sets(rule: Rule, shared):
    """(node, set) of the texts whose bit is set in the map; sets are sorted hashes as bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits: np.ndarray = shared.value
        seen: set[int] = set()
        for batch in batches:
            for low, high, data, offsets in K.text_slices(batch.column(0)):
                row, value = ngram_sets(data, offsets, rule.width)
                size, name = _set_names(row, value, high - low)
                bit = (name & np.uint64(_ROUTE_BITS - 1)).astype(np.int64)
                asked = (bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1
                wanted = [k for k in np.flatnonzero(asked & (size > 0)).tolist() if not (int(name[k]) in seen or seen.add(int(name[k])))]
                end = np.cumsum(size)
                yield pa.RecordBatch.from_pydict({
                    "node": K.signed(name[wanted]),
                    "ngrams": pa.array([value[end[k] - size[k]: end[k]].tobytes() for k in wanted], pa.binary())})
    return run


def _halves(table: pa.Table) -> tuple[np.ndarray, np.ndarray, bool]:
    """Which rows lie in the first and which in the second of the two blocks; whether they are one block."""
    block = table.column("block").to_numpy()
    i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
    return np.flatnonzero(block == i), np.flatnonzero(block == j), i == j


def folded(bins: np.ndarray, width: int) -> np.ndarray:
    """Rows of bins as rows of ``width`` coarser ones."""
    return bins.reshape(len(bins), width, -1).sum(2, dtype=np.int32)


def _possible(rule: Rule):
    """Of every two blocks, the texts that can link with another one by sizes and bins."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in K.streamed_groups(batches, _MEETING):
            if table.num_rows < 2:
                continue
            left, right, same = _halves(table)
            guest = table.column("guest").to_numpy(zero_copy_only=False)
            size = table.column("size").to_numpy().astype(np.int64)
            group, leader = table.column("first").to_numpy(), table.column("leader")[0].as_py()
            bins = [np.frombuffer(x, np.uint8).astype(np.int16) for x in table.column("bins").to_pylist()]
            width = np.array([len(x) for x in bins])
            keep = np.zeros(table.num_rows, bool)
            by_width = {int(w): right[width[right] == w] for w in np.unique(width[right])}
            stored = {w: np.stack([bins[k] for k in at]) for w, at in by_width.items()}
            for k in left.tolist():
                for w, at in by_width.items():
                    near = np.flatnonzero((rule.den * np.minimum(size[k], size[at]) >= rule.num * np.maximum(size[k], size[at])) & (at != k)
                                          & ~(guest[k] & guest[at]))  # guests meet in their own band
                    if not len(near):
                        continue
                    both = min(w, len(bins[k]))  # the coarser bins are sums of the finer ones
                    apart = np.abs(folded(stored[w][near], both) - folded(bins[k][None], both)).sum(1)
                    most = (size[k] + size[at[near]] - apart) // 2  # common n-grams at most
                    elsewhere = (group[at[near]] == group[k]) & (group[k] != leader)  # they meet in their first group
                    can = near[(most >= rule.needed(size[k], size[at[near]])) & ~elsewhere]
                    if len(can):
                        keep[k] = True
                        keep[at[can]] = True
            if keep.any():
                yield from table.filter(pa.array(keep)).select([*_MEETING, "block", "guest", "node"]).to_batches()
    return run


class Trie:
    """Sets in a trie with path compression. Elements are numbered so that frequent ones come first.

    A node has the run of elements that all sets below share after its parent's, its children, the stored sets
    that end with it, and the least and largest size of the sets below.
    """

    def __init__(self, sets: list[np.ndarray]):
        self.elements, code, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        self.rank = np.empty(len(self.elements), np.int64)
        self.rank[np.lexsort((self.elements, -often))] = np.arange(len(self.elements))
        size = np.array([len(s) for s in sets])
        row = np.repeat(np.arange(len(sets)), size)
        ranked = self.rank[code]
        ranked = ranked[np.lexsort((ranked, row))]
        ends = np.cumsum(size)
        paths = [ranked[b - n:b] for b, n in zip(ends, size)]
        order = sorted(range(len(sets)), key=lambda k: paths[k].tolist())
        shared = [0]  # elements that neighbours in path order have in common from the start
        for a, b in zip(order, order[1:]):
            n = min(len(paths[a]), len(paths[b]))
            differ = np.flatnonzero(paths[a][:n] != paths[b][:n])
            shared.append(int(differ[0]) if len(differ) else n)
        self.size = size
        #: (run, children, sets that end here, end of the run, least size, largest size)
        self.nodes: list[tuple] = []
        self.roots: list[int] = []
        todo = [(0, len(sets), 0, self.roots)]
        while todo:
            low, high, depth, siblings = todo.pop()
            while low < high and len(paths[order[low]]) == depth:
                low += 1  # written with the parent
            while low < high:
                end = low + 1
                while end < high and shared[end] > depth:
                    end += 1
                members = order[low:end]
                to = min([len(paths[order[low]]), *shared[low + 1:end]])
                children: list[int] = []
                sizes = size[members]
                siblings.append(len(self.nodes))
                self.nodes.append((paths[order[low]][depth:to], children, [k for k in members if size[k] == to], to,
                                   int(sizes.min()), int(sizes.max())))
                todo.append((low, end, to, children))
                low = end

    def links(self, probes: list[np.ndarray], rule: Rule) -> tuple[np.ndarray, np.ndarray]:
        """(probe, set) of all probes and stored sets that link."""
        width = max(1, PROBE_CELLS // max(1, len(self.elements)))
        found = [self._walk(probes[a:a + width], a, rule) for a in range(0, len(probes), width)]
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def _walk(self, probes: list[np.ndarray], first: int, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
        size = np.array([len(p) for p in probes])
        member = np.zeros((len(self.elements), len(probes)), np.uint8)
        for k, ngrams in enumerate(probes):
            place = np.minimum(np.searchsorted(self.elements, ngrams), len(self.elements) - 1)
            member[self.rank[place[self.elements[place] == ngrams]], k] = 1
        linked_probes, linked_sets = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        todo = [(node, np.arange(len(probes)), np.zeros(len(probes), np.int64)) for node in self.roots]
        while todo:
            node, alive, overlap = todo.pop()
            run, children, ending, to, least, largest = self.nodes[node]
            part = member[run] if len(alive) == len(probes) else member[run][:, alive]
            overlap = overlap + part.sum(0, dtype=np.int64)
            for k in ending:
                hit = alive[overlap >= rule.needed(size[alive], to)]
                linked_probes.append(hit + first)
                linked_sets.append(np.full(len(hit), k))
            if children:
                rest = np.minimum(size[alive] - overlap, largest - to)
                on = overlap + rest >= rule.needed(size[alive], max(least, to))
                if on.any():
                    todo += [(child, alive[on], overlap[on]) for child in children]
        return np.concatenate(linked_probes), np.concatenate(linked_sets)


def _linked(rule: Rule):
    """(node, root, links) of the texts with a link in their two blocks: the least node of their tree, counted links."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in K.streamed_groups(batches, _MEETING):
            if table.num_rows < 2:
                continue
            left, right, same = _halves(table)
            guest = table.column("guest").to_numpy(zero_copy_only=False)
            sets = [np.frombuffer(x, np.uint64) for x in table.column("ngrams").to_pylist()]
            node, copies = table.column("node").to_numpy(), table.column("copies").to_numpy()
            groups = [set(x) for x in table.column("leaders").to_pylist()]
            firsts = [min(g) for g in groups]
            leader = table.column("leader")[0].as_py()
            probe, stored = Trie([sets[k] for k in right.tolist()]).links([sets[k] for k in left.tolist()], rule)
            a, b = left[probe], right[stored]
            once = (a < b if same else np.ones(len(a), bool)) & ~(guest[a] & guest[b])
            parent = list(range(table.num_rows))

            def root(k: int) -> int:
                while parent[k] != k:
                    parent[k] = parent[parent[k]]
                    k = parent[k]
                return k

            links = np.zeros(table.num_rows, np.int64)
            for k, other in zip(a[once].tolist(), b[once].tolist()):
                x, y = root(k), root(other)
                if x != y:
                    parent[max(x, y, key=node.__getitem__)] = min(x, y, key=node.__getitem__)
                meet = firsts[k] if firsts[k] == firsts[other] else min(groups[k] & groups[other])
                if meet == leader:  # of the groups that both are in, this one counts the link
                    links[k] += copies[other]
                    links[other] += copies[k]
            roots = np.array([root(k) for k in range(table.num_rows)])
            some = np.flatnonzero((links > 0) | (roots != np.arange(len(roots))))
            if len(some):
                yield pa.RecordBatch.from_pydict({"node": pa.array(node[some]), "root": pa.array(node[roots[some]]), "links": pa.array(links[some])})
    return run


#: Rows with these in common meet in one task.
_MEETING = ["leader", "band", "i", "j"]


def _fields(*names: str) -> str:
    kinds = {"bins": "binary", "ngrams": "binary", "hot": "boolean", "guest": "boolean", "band": "int", "i": "int", "j": "int", "block": "int"}
    return ", ".join(f"{n} {kinds.get(n, 'long')}" for n in names)


def _bitmap(nodes: DataFrame) -> np.ndarray:
    """The map of ``nodes`` in a fixed number of bits (8 MB)."""
    bits = np.zeros(_ROUTE_BITS // 8, np.uint8)
    place = F.col("node").bitwiseAND(F.lit(_ROUTE_BITS - 1))
    rows = (nodes.groupBy(F.floor(place / 32768).alias("bucket")).agg(F.bitmap_construct_agg(place % 32768).alias("bits")))
    for row in rows.toLocalIterator():
        bits[row.bucket * 4096:(row.bucket + 1) * 4096] = np.frombuffer(bytes(row.bits), np.uint8)
    return bits


def _order(counted: DataFrame, texts: int) -> tuple[Order, int]:
    """The global order and the class from which an n-gram is hot.

    The classes' sizes decide the least frequency that is kept, so that at most FREQUENT n-grams are.
    """
    totals = counted.filter("token IS NOT NULL").groupBy("token").agg(F.sum("n").alias("n"))
    totals = cut_lineage(totals.filter("n > 2"), "frequent")
    power = F.floor(F.log2("n")).cast("int")
    sizes = {r.p: r.c for r in totals.groupBy(power.alias("p")).agg(F.count(F.lit(1)).alias("c")).collect()}
    least, total = 63, 0
    while least > 0 and total + sizes.get(least, 0) <= FREQUENT:
        total += sizes.get(least, 0)
        least -= 1
    table = totals.filter(power > least).toPandas()
    drop_scratch(totals)
    hot = max(int(np.floor(4 * np.log2(max(HOT_SHARE * texts, 64)))), 1)
    return Order.of(table["token"].to_numpy(np.int64).view(np.uint64), table["n"].to_numpy(np.int64)), min(hot, 255)


def similar_documents(docs: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, n_links (documents it links with)."""
    with temporary_tables(docs.sparkSession):
        found, known = _similar(docs, rule, id_col, text_col)
    return found.join(known, "node", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def _similar(docs: DataFrame, rule: Rule, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, node) of all rows and (node, component_id, n_links) of all sets; all else is temporary."""
    spark = docs.sparkSession
    text = docs.select(F.col(text_col).alias("text"))
    counted = cut_lineage(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
                          .mapInArrow(K.releasing(_count(rule)), _fields("doc_id", "node", "size", "bins", "token", "n")), "sets")
    named = counted.filter("token IS NULL")
    classes = cut_lineage(named.filter("size > 0").groupBy("node").agg(
        F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.first("size").alias("size"), F.first("bins").alias("bins")), "classes")
    order, hot = _order(counted, classes.count())
    found = cut_lineage(named.select("doc_id", F.col("size").alias("n_shingles"), F.expr("CASE WHEN size > 0 THEN node END").alias("node")),
                        "found", outlives=True)
    drop_scratch(counted)
    shared = spark.sparkContext.broadcast(order)

    rows = text.mapInArrow(K.releasing(_prefixes(rule, shared, hot)), _fields("token", "node", "hot"))
    rows = rows.withColumn("_salt", F.when(F.col("hot"), F.pmod("node", F.lit(1024))).otherwise(0))
    same = Window.partitionBy("token", "_salt")
    groups = (rows.withColumn("least", F.min("node").over(same)).withColumn("most", F.max("node").over(same))
              .filter("hot OR least <> most").select(F.expr("CASE WHEN hot THEN token ELSE least END").alias("leader"), "node").distinct())
    groups = cut_lineage(groups, "groups")
    firsts = groups.groupBy("node").agg(F.min("leader").alias("first"))
    near = cut_lineage(_near_sizes(rule, cut_lineage(groups.join(classes.select("node", "size"), "node"), "sized")), "near")
    wide = classes.select("node", "bins").join(firsts, "node")  # joins the rows that are still there, once they have their places
    dealt = _dealt(rule, near, near).join(wide, "node").select(*_MEETING, "block", "guest", "node", "size", "first", "bins")
    possible = cut_lineage(dealt.repartition(*_MEETING).sortWithinPartitions(*_MEETING)
                           .mapInArrow(_possible(rule), _fields(*_MEETING, "block", "guest", "node")), "possible")
    members = groups.join(possible.select("node").distinct(), "node")
    leaders = members.groupBy("node").agg(F.collect_set("leader").alias("leaders"))  # at most a prefix long
    shared = spark.sparkContext.broadcast(_bitmap(possible.select("node")))
    sets = text.mapInArrow(K.releasing(_sets(rule, shared)), _fields("node", "ngrams")).join(leaders, "node").dropDuplicates(["node"])
    met = (possible.join(sets.join(classes.select("node", "copies"), "node"), "node")
           .repartition(*_MEETING).sortWithinPartitions(*_MEETING)
           .mapInArrow(_linked(rule), _fields("node", "root", "links")))
    links = cut_lineage(met, "links")
    least = components(links.select(F.col("node").alias("u"), F.col("root").alias("v")))
    counts = links.groupBy("node").agg(F.sum("links").alias("links"))
    in_component = (classes.join(least, "node", "left").join(counts, "node", "left")
                    .withColumn("component", F.coalesce("component", "node")))
    firsts = in_component.groupBy("component").agg(F.min("first_id").alias("component_id"))
    known = in_component.join(firsts, "component").select(
        "node", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return found, cut_lineage(known, "known", outlives=True)


def _near_sizes(rule: Rule, sized: DataFrame) -> DataFrame:
    """The rows of ``sized`` (leader, node, size) whose leader has another row of a size that can link with theirs."""
    sizes = sized.groupBy("leader", "size").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("leader").orderBy("size")  # a row for each size, however many texts have it
    before, after = F.lag("size").over(order), F.lead("size").over(order)
    near = (F.col("n") > 1) | F.coalesce(rule.den * before >= rule.num * F.col("size"), F.lit(False)) | F.coalesce(
        rule.den * F.col("size") >= rule.num * after, F.lit(False))
    return sized.join(sizes.withColumn("near", near).filter("near").select("leader", "size"), ["leader", "size"])


def _placed(rule: Rule, sized: DataFrame) -> DataFrame:
    """For each leader and set size the bands that its sets go to, as guests or not, and the bands' numbers of blocks."""
    by_size = sized.groupBy("leader", "size").agg(F.count(F.lit(1)).alias("n"))
    by_size = by_size.withColumn("all", F.sum("n").over(Window.partitionBy("leader")))
    own = rule.band(F.col("size"))
    whole = F.array(F.struct(F.lit(-1).alias("band"), F.lit(False).alias("guest")))
    banded = F.array(F.struct(own.alias("band"), F.lit(False).alias("guest")), F.struct((own + 1).alias("band"), F.lit(True).alias("guest")))
    placed = by_size.withColumn("role", F.explode(F.when(F.col("all") <= BLOCK, whole).otherwise(banded))).select("leader", "size", "n", "role.band", "role.guest")
    blocks = F.ceil(F.sum("n").over(Window.partitionBy("leader", "band")) / BLOCK).cast("int")
    return placed.withColumn("blocks", blocks).drop("n")


def _dealt(rule: Rule, rows: DataFrame, narrow: DataFrame) -> DataFrame:
    """``rows`` (leader, node, size, ..) for each two blocks that they are part of: ``_MEETING``, own block, guest or not.

    ``narrow`` has leader, node and size of the same rows, for counting.
    """
    placed = rows.join(cut_lineage(_placed(rule, narrow), "placed"), ["leader", "size"])
    return (placed.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .select("leader", "band", F.least("block", "other").cast("int").alias("i"), F.greatest("block", "other").cast("int").alias("j"),
                    "block", "guest", *[c for c in rows.columns if c != "leader"]))


def without_near_copies(docs: DataFrame, rule: Rule, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: all that are linked with nothing and of each group the one with the smallest id.

    Rows are told apart by id and a 64-bit hash of the text, as an id may repeat with another text, or lack; a row
    without an id stays only if no other of its group has one.
    """
    plain, name = numbered(docs)
    keyed = plain.withColumn("_key", F.xxhash64(name[id_col], name[text_col]))
    with temporary_tables(docs.sparkSession):
        found = similar_documents(keyed, rule, "_key", name[text_col]).filter("n_links > 0")
        own = keyed.select("_key", F.col(name[id_col]).alias("_id"))
        linked = cut_lineage(found.select(F.col("doc_id").alias("_key"), "component_id").join(own, "_key"), "linked")
        least = linked.groupBy("component_id").agg(F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_key")).alias("first"))
        dropped = cut_lineage(linked.select("_key").join(least.select("first._key"), "_key", "left_anti"), "dropped", outlives=True)
    return without_ids(keyed, "_key", dropped).select(plain.columns).toDF(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    return similar_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 3) - 1], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * common >= 90 * (a.n + b.n - common)),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.c)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.c) AS component_id,
       (SELECT count(*) FROM e WHERE e.x = d.doc_id) AS n_links
FROM documents d LEFT JOIN n USING (doc_id) JOIN r USING (doc_id) GROUP BY d.doc_id
"""
