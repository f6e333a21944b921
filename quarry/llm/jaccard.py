"""N-gram Jaccard join with signature trees (operator 8).

Two documents link when the Jaccard likeness of their sets of distinct word shingles
is at least similarity (given in hundredths). The result is exact; no link is lost.

1. A document becomes its set of 64-bit shingle hashes. Documents of equal sets form
   a class, found by a 128-bit digest of the set; from here a class counts once.
2. Candidates. If two sets of sizes up to r link, they differ in at most d of their
   elements, with d = floor(2 r (100 - s) / (100 + s)). The hash space is dealt into
   m > d even parts; then at least m - d parts hold the same elements in both sets. So
   each set emits a key for each part, over its part's elements, for its own size band
   and, where a partner may lie there, the next. A set that shares fewer than m - d of
   a band's keys with any other class has no link there and goes, exactly; this
   leaves little but near copies, however many texts share a passage. Empty parts tell
   nothing: they are not emitted, and count as shared, unless a set has m - d of them.
   Classes that still share a key are joined to the key's least class: a number of
   edges in proportion to the keys, not to the pairs. Components of these edges hold
   every link.
3. Links. The classes of a candidate component are compared by signature tree: a
   node holds the OR of its sets' bitmaps and the range of their sizes; pairs of nodes
   are walked from the top and dropped when the greatest possible overlap is below the
   least that a link needs, or when all their sets are already connected.
4. A component too large for one task is dealt into blocks, first compared within
   blocks that all hold some common pivots, then, by pairs of blocks whose sets are not
   too different in size to link, the classes outside the component's largest connected
   part against all others.

Edge cases: null or wordless text has an empty set, size 0, and links with nothing,
so its component is its own id, or that of the id's other texts. A text of fewer words than a shingle is one shingle.
Rows that repeat an id and its text are one document; of different texts under one id,
each row keeps its own set and they count as connected. A null id stays alone. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from quarry.llm.common import give_back, lean, materialize, texts_of
from quarry.llm.components import components

FANOUT = 16
#: Bits of all bitmaps of one tree.
TREE_BITS = 1 << 28


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, elementwise."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles of `size` words. Words are what
    ASCII white space separates, A-Z lower-cased: as bytes.lower and bytes.split do."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    h = np.fromiter(map(digest, words), np.uint64, len(words))
    size = min(size, len(words))
    n = len(h) - size + 1
    out = np.full(n, size, np.uint64)
    for i in range(size):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
    return np.unique(out)


class Bands:
    """Size bands and the greatest difference of two linked sets within one."""

    def __init__(self, similarity: int, step: int = 1):
        self.s = similarity
        self.step = step

    def differ(self, top: int) -> int:
        return 2 * top * (100 - self.s) // (100 + self.s)

    def parts(self, top: int) -> int:
        """A quarter more than the differences, and some more for small sets."""
        d = self.differ(top)
        return d + 1 + max(4, (d + 1) // 4)

    def _top(self, low: int) -> int:
        top = low
        for _ in range(self.step):
            top = max(low + 1, top * 100 // self.s)
        return top

    def tops(self, n: int) -> list[int]:
        """Tops of the bands in which a set of n elements emits: its own band, and the
        next if a set of n / similarity elements lies beyond its own."""
        own = self._top(1)
        while own < n:
            own = self._top(own + 1)
        return [own, self._top(own + 1)] if n * 100 // self.s > own else [own]


def keys_of(elements: np.ndarray, top: int, bands: Bands) -> tuple[np.ndarray, int]:
    """The keys of one band, and how many of them must be shared. Parts are even ranges
    of the hashes, so each is a run of the sorted set; its key mixes the sum of its
    elements' mixed hashes."""
    d = bands.differ(top)
    if d == 0:  # only equal sets link, and they are one class already
        return np.empty(0, np.uint64), 0
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(elements ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)])
    parts = bands.parts(top)
    edges = (np.arange(1, parts, dtype=np.float64) * (2.0**64 / parts)).astype(np.uint64)
    at = np.concatenate([[0], np.searchsorted(elements, edges), [len(elements)]])
    part = np.arange(parts, dtype=np.uint64) + np.uint64(top) * np.uint64(1 << 32)
    keys = _mix(_mix(part) + (total[at[1:]] - total[at[:-1]]))
    full = at[1:] > at[:-1]
    need = parts - d - int((~full).sum())
    return (keys[full], need) if need > 0 else (keys, 0)


def _digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed numbers."""
    digest = xxhash.xxh3_128_intdigest(s.tobytes())
    return (digest >> 64) - (1 << 63), (digest & ((1 << 64) - 1)) - (1 << 63)


def _summaries(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, one, two = [], [], []
            for text in texts_of(batch):
                s = shingle_set(text, size)
                h1, h2 = _digest(s)
                n.append(len(s))
                one.append(h1)
                two.append(h2)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("t"), *(pa.array(x, pa.int64()) for x in (n, one, two))], ["id", "t", "n", "h1", "h2"])

    return lean(run)


def _keys(size: int, similarity: int):
    bands = Bands(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(id, band, need, keys): a row for each band that a set emits in. The id is
        the first half of the set's digest."""
        known: dict[int, list[int]] = {}
        for batch in batches:
            ids, tops, needs, keys, ends = [], [], [], [], [0]
            for text in texts_of(batch):
                s = shingle_set(text, size)
                if not len(s):
                    continue
                i = _digest(s)[0]
                if len(s) not in known:
                    known[len(s)] = bands.tops(len(s))
                for top in known[len(s)]:
                    got, need = keys_of(s, top, bands)
                    if len(got):
                        ids.append(i)
                        tops.append(top)
                        needs.append(need)
                        keys.append(got)
                        ends.append(ends[-1] + len(got))
                if ends[-1] > 500_000:
                    yield _key_batch(ids, tops, needs, keys, ends)
                    ids, tops, needs, keys, ends = [], [], [], [], [0]
            yield _key_batch(ids, tops, needs, keys, ends)

    return lean(run)


def _key_batch(ids, tops, needs, keys, ends) -> pa.RecordBatch:
    flat = np.concatenate(keys).view(np.int64) if keys else np.empty(0, np.int64)
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(tops, pa.int32()), pa.array(needs, pa.int32()), lists], ["id", "band", "need", "keys"])


class SignatureTree:
    """Sets in the order given, FANOUT to a node, level by level to one root."""

    def __init__(self, sets: list[np.ndarray], similarity: int):
        self.s, self.sets = similarity, sets
        size = np.array([len(x) for x in sets], np.int64)
        words = np.unique(np.concatenate(sets))
        width = 64
        while width < len(words) and width * 2 * len(sets) <= TREE_BITS:
            width *= 2
        self.exact = len(words) <= width
        maps = np.zeros((len(sets), width // 64), np.uint64)
        for row, s in zip(maps, sets):  # set by set: all bits' numbers at once take more than the bitmaps
            bit = np.searchsorted(words, s).astype(np.uint64) if self.exact else s & np.uint64(width - 1)
            np.bitwise_or.at(row, bit >> np.uint64(6), np.uint64(1) << (bit & np.uint64(63)))
        excess = size - np.bitwise_count(maps).sum(axis=1, dtype=np.int64)
        self.maps, self.low, self.high, self.excess = [maps], [size], [size], [excess]
        while len(self.low[-1]) > 1:
            at = np.arange(0, len(self.low[-1]), FANOUT)
            self.maps.append(np.bitwise_or.reduceat(self.maps[-1], at, axis=0))
            self.low.append(np.minimum.reduceat(self.low[-1], at))
            self.high.append(np.maximum.reduceat(self.high[-1], at))
            self.excess.append(np.maximum.reduceat(self.excess[-1], at))
        self.root = list(range(len(sets)))
        self.left = len(sets)  # connected parts

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return i

    def unite(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.root[max(i, j)] = min(i, j)
            self.left -= 1

    def possible(self, level: int, a: range, b: range) -> np.ndarray:
        """Which pairs of nodes may hold a link: greatest overlap against least need."""
        ma, mb = slice(a.start, a.stop), slice(b.start, b.stop)
        right = self.maps[level][mb]  # row by row, since bitmaps may be wide
        common = np.array([np.bitwise_count(row & right).sum(axis=1, dtype=np.int64) for row in self.maps[level][ma]])
        more = np.minimum(self.excess[level][ma][:, None], self.excess[level][mb][None, :])
        most = np.minimum(common + more, np.minimum(self.high[level][ma][:, None], self.high[level][mb][None, :]))
        la, lb = self.low[level][ma][:, None], self.low[level][mb][None, :]
        return most * (100 + self.s) >= self.s * (la + lb)

    def linked(self, i: int, j: int) -> bool:
        x, y = self.sets[i], self.sets[j]
        both = len(np.intersect1d(x, y, assume_unique=True))
        return 100 * both >= self.s * (len(x) + len(y) - both)

    def _members(self, level: int, i: int) -> range:
        span = FANOUT**level
        return range(i * span, min((i + 1) * span, len(self.sets)))

    def _joined(self, level: int, i: int, j: int) -> bool:
        """Whether all sets below the two nodes are one connected part already."""
        first = self.find(i * FANOUT**level)
        return all(self.find(x) == first for x in self._members(level, j)) and all(self.find(x) == first for x in self._members(level, i))

    def _walk(self, level: int, a: range, b: range) -> None:
        """Compare the nodes a with the nodes b of one level, each pair once."""
        for i, j in zip(*map(np.ndarray.tolist, np.nonzero(self.possible(level, a, b)))):
            i, j = a.start + i, b.start + j
            if i >= j:
                continue
            if level == 0:
                if self.find(i) != self.find(j) and (self.exact or self.linked(i, j)):
                    self.unite(i, j)
            elif not self._joined(level, i, j):
                self._walk(level - 1, self._children(level, i), self._children(level, j))
            if self.left == 1:
                return

    def _children(self, level: int, i: int) -> range:
        return range(i * FANOUT, min((i + 1) * FANOUT, len(self.low[level - 1])))

    def connect(self) -> list[int]:
        """The least index of each set's connected part. Pairs that lie close in the
        tree come first, so that later ones are often connected already."""
        for level in range(1, len(self.low)):
            for node in range(len(self.low[level])):
                if self.left == 1:
                    break
                below = self._children(level, node)
                self._walk(level - 1, below, below)
        return [self.find(i) for i in range(len(self.sets))]


def _compare(size: int, similarity: int, large: int = 500):
    def parts(pdf: pd.DataFrame) -> pd.DataFrame:
        sets = [shingle_set(t, size) for t in pdf["text"]]
        order = sorted((i for i in range(len(sets)) if len(sets[i])), key=lambda i: (int(sets[i][0]), len(sets[i])))
        if not order:
            return pd.DataFrame({"a": [], "b": []}, dtype=str)
        tree = SignatureTree([sets[i] for i in order], similarity)
        first: dict[str, int] = {}
        for at, i in enumerate(order):
            label = pdf["label"].iat[i]
            if label is not None and label == label:
                tree.unite(first.setdefault(label, at), at)
        names = np.array(["%d %d" % _digest(sets[i]) for i in order], object)
        return pd.DataFrame({"a": names, "b": names[tree.connect()]})

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Connected parts of one cell's sets, by the names of their classes. Sets with
        a label are known to be connected with the others of that label."""
        out = parts(pdf)
        if len(pdf) >= large:  # small cells are many, and take little
            give_back()
        return out

    return run


def jaccard_components(docs: DataFrame, shingle: int = 5, similarity: int = 80, id_col: str = "doc_id", text_col: str = "text", cell_rows: int = 4096, cell_shingles: int = 1_000_000, pivots: int = 64) -> DataFrame:
    """(id, n_shingles, component_id) for every document; ids are integers, others an error."""
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise ValueError(f"{id_col} is {docs.schema[id_col].dataType.simpleString()}, not an integer")
    # t tells the texts of one id apart.
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("t"), F.col(text_col).alias("text"))
    sums = materialize(rows.mapInArrow(_summaries(shingle), "id long, t long, n long, h1 long, h2 long"), "jaccard-sums")

    # Classes of equal sets; the row of the least id stands for each. From here a class
    # goes by its digest, since an id may have texts in several classes.
    classes = sums.where("n > 0 and id is not null").groupBy("h1", "h2").agg(F.min(F.struct("id", "t")).alias("r"), F.max("n").alias("n"))
    classes = materialize(classes.select("h1", "h2", F.col("r.id").alias("rep"), F.col("r.t").alias("t"), "n", F.concat_ws(" ", "h1", "h2").alias("name")), "jaccard-classes")
    copies = sums.join(classes.select("h1", "h2", "rep", F.col("t").alias("rep_t")), ["h1", "h2"]).where("id <> rep or t <> rep_t")
    copies = materialize(copies.select("id", "t").distinct(), "jaccard-copies")
    reps = rows.where("id is not null").join(_small(copies), ["id", "t"], "left_anti")
    keyed = materialize(_shared_keys(reps, _keys(shingle, similarity)).distinct(), "jaccard-keys")
    enough = materialize(keyed.groupBy("id", "band").agg(F.count("*").alias("c"), F.min("need").alias("need")).where("c >= need").select("id", "band"), "jaccard-enough")
    left = keyed.join(_small(enough), ["id", "band"]).select("id", "key")
    shared = materialize(left.groupBy("key").agg(F.min("id").alias("head"), F.max("id").alias("last")).where("head < last").select("key", "head"), "jaccard-shared")
    linked = left.join(_small(shared), "key")
    heads = linked.where("id <> head").groupBy("id").agg(F.collect_set("head").alias("heads"))
    # A class and all its keys' heads hang on the least of them: one edge for each class
    # and few between heads. A class has no more heads than keys.
    least = F.least(F.col("id"), F.array_min("heads"))
    edges = heads.select(F.explode(F.concat(F.array("id"), F.col("heads"))).alias("a"), least.alias("b"))
    groups = components(edges, hashed=True)
    members = materialize(classes.join(groups, classes.h1 == groups.node).select(F.col("rep").alias("id"), "t", "name", "n", F.col("label").alias("grp")), "jaccard-members")

    # Cells: one per component, or blocks of a large one with its pivots in each.
    size = members.groupBy("grp").agg(F.count("*").alias("rows"), F.sum("n").alias("shingles"))
    size = size.select("grp", "rows", F.greatest(F.ceil(F.col("rows") / cell_rows), F.ceil(F.col("shingles") / cell_shingles)).alias("blocks"))
    placed = members.join(materialize(size, "jaccard-sizes"), "grp")
    own = F.pmod(F.xxhash64("name"), F.col("blocks"))
    pivot = F.pmod(F.xxhash64("name", F.lit(1)), F.ceil(F.col("rows") / pivots)) == 0
    placed = materialize(placed.select("id", "t", "name", "grp", "blocks", "n", own.alias("own"), ((F.col("blocks") > 1) & pivot).alias("pivot")), "jaccard-placed")
    compare = _compare(shingle, similarity)
    in_cells = F.when(F.col("pivot"), F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array("own"))
    here = _small(placed.select("id", "t", "grp", "blocks", "own", "pivot"))
    cells = rows.join(here, ["id", "t"]).select("grp", F.explode(in_cells).alias("cell"), "text", F.lit(None).cast("string").alias("label"))
    links = materialize(cells.groupBy("grp", "cell").applyInPandas(compare, "a string, b string").where("a <> b"), "jaccard-links")

    if placed.where("blocks > 1").limit(1).count():
        links = links.union(_across_blocks(placed, rows, links, shingle, similarity, cell_rows, cell_shingles))
    # Classes of one id count as connected: ids with several, or with an empty set too.
    digest = F.when(F.col("n") > 0, F.struct("h1", "h2"))
    several = sums.where("id is not null").groupBy("id").agg(F.min(digest).alias("first"), F.max(digest).alias("last"), F.max(F.col("n") == 0).alias("empty"))
    several = several.where((F.col("first") != F.col("last")) | F.col("empty")).where("first is not null")
    several = materialize(several.select("id", "first", (F.col("first") != F.col("last")).alias("differ")), "jaccard-several")
    same = sums.where("n > 0").join(several.where("differ"), "id")
    same = same.select(F.concat_ws(" ", "h1", "h2").alias("a"), F.concat_ws(" ", "first.h1", "first.h2").alias("b")).where("a <> b").distinct()
    final = components(links.unionByName(same), hashed=True)

    # From classes back to documents: the least id of all classes of a component.
    final = materialize(classes.join(final, classes.name == final.node, "left").select("h1", "h2", "rep", "label"), "jaccard-final")
    least = materialize(final.where("label is not null").groupBy("label").agg(F.min("rep").alias("least")), "jaccard-least")
    named = materialize(final.join(least, "label", "left").select("h1", "h2", F.coalesce("least", "rep").alias("least")), "jaccard-named")
    beside = sums.where("n = 0").join(several.select("id", "first"), "id", "left").select("id", "n", "first.h1", "first.h2")
    out = sums.where("n > 0").select("id", "n", "h1", "h2").unionByName(beside).join(named, ["h1", "h2"], "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("least", "id")).alias("component_id"))


def _shared_keys(reps: DataFrame, keys, one_in: int = 128, hot: int = 64) -> DataFrame:
    """(id, band, need, key) of the keys that more than one class has.

    A window over the key tells them apart with one shuffle. Keys that very many classes
    share are dealt out by class as well: those that occur `hot` times and in two classes
    among one text in one_in, by a hash of the id, are known to be shared. All others are
    decided by the window, whose groups are thereby short."""
    # Rows are few columns wide, since a task sorts all that it gets: band and need are one number.
    both = (F.shiftleft(F.col("band").cast("long"), 32) + F.col("need")).alias("both")
    emitted = lambda rows: rows.mapInArrow(keys, "id long, band int, need int, keys array<long>").select("id", both, F.explode("keys").alias("key"))
    some = emitted(reps.where(F.pmod(F.xxhash64("id"), F.lit(one_in)) == 0))
    often = some.groupBy("key").agg(F.count("*").alias("c"), F.min("id").alias("first"), F.max("id").alias("last"))
    often = materialize(often.where(f"c >= {hot} and first < last").select("key", F.lit(True).alias("often")), "jaccard-often")
    rows, alike, known = emitted(reps), Window.partitionBy("key"), F.lit(False)
    if often.limit(1).count():
        # dealt: the id where the key is shared by very many, else null.
        rows = rows.join(_small(often), "key", "left").select("id", "both", "key", F.when(F.col("often"), F.col("id")).alias("dealt"))
        alike, known = Window.partitionBy("key", "dealt"), F.col("dealt").isNotNull()
    rows = rows.withColumns({"first": F.min("id").over(alike), "last": F.max("id").over(alike)})
    rows = rows.where(known | (F.col("first") < F.col("last")))
    return rows.select("id", F.shiftright("both", 32).cast("int").alias("band"), F.col("both").bitwiseAND(0xFFFFFFFF).cast("int").alias("need"), "key")


def _small(written: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """Marked for broadcast if it has few rows (here of numbers and a digest or two, under
    150 bytes each); larger ones are shuffled."""
    return F.broadcast(written) if written.limit(rows + 1).count() <= rows else written


def _in_block_pairs(large: DataFrame, similarity: int, cell_rows: int, cell_shingles: int) -> DataFrame:
    """large (name, grp, n, main, and others) with cells: the pairs of blocks that a set is in, each
    of a block of the rest and any other.

    Blocks are of one band of sizes. Sets of bands that are not neighbours differ in size
    by more than linked sets can, so only blocks of one band or of two neighbours meet."""
    # A little wide, so that rounding leaves no linked sizes two bands apart.
    width = max(1e-3, math.log(100 / similarity)) * 1.0001
    large = large.withColumn("band", F.floor(F.log("n") / width).cast("int"))
    half = lambda count, n: F.greatest(F.ceil(2 * count / cell_rows), F.ceil(2 * n / cell_shingles)).cast("int")
    sums = {f"{kind}_{what}": F.sum(F.when(F.col("main") == (kind == "main"), value).otherwise(0)) for kind in ("rest", "main") for what, value in (("rows", F.lit(1)), ("n", F.col("n")))}
    by_band = large.groupBy("grp", "band").agg(*[v.alias(k) for k, v in sums.items()])
    # A row for each component with all its bands, which are about a hundred at most. What fits
    # into one block as a whole is one, whatever its bands.
    number = {kind: half(F.col(f"{kind}_rows"), F.col(f"{kind}_n")) for kind in ("rest", "main")}
    whole = {kind: half(F.sum(f"{kind}_rows"), F.sum(f"{kind}_n")) <= 1 for kind in ("rest", "main")}
    counts = by_band.groupBy("grp").agg(F.collect_list(F.struct("band", *[v.alias(k) for k, v in number.items()])).alias("bands"), *[v.alias(f"one_{k}") for k, v in whole.items()])
    counts = materialize(counts.where(F.exists("bands", lambda b: b["rest"] > 0)), "jaccard-halves")
    large = large.join(counts, "grp")
    own = F.filter("bands", lambda b: b["band"] == F.col("band"))[0]
    near = F.filter("bands", lambda b: F.abs(b["band"] - F.col("band")) <= 1)
    none = F.array().cast("array<string>")

    def mine(kind: str) -> Column:
        """The block of a set of this kind."""
        banded = F.concat_ws(" ", F.lit(kind), F.col("band").cast("string"), F.pmod(F.xxhash64("name", F.lit(2)), own[kind]).cast("string"))
        return F.when(F.col(f"one_{kind}"), F.lit(kind)).otherwise(banded)

    def blocks(kind: str) -> Column:
        """All blocks of this kind that may have sets of a near size."""
        some = lambda b: F.transform(F.sequence(F.lit(0), b[kind] - 1), lambda i: F.concat_ws(" ", F.lit(kind), b["band"].cast("string"), i.cast("string")))
        banded = F.flatten(F.transform(near, lambda b: F.when(b[kind] > 0, some(b)).otherwise(none)))
        return F.when(~F.col(f"one_{kind}"), banded).when(F.exists(near, lambda b: b[kind] > 0), F.array(F.lit(kind))).otherwise(none)

    large = large.withColumn("mine", F.when(F.col("main"), mine("main")).otherwise(mine("rest")))
    others = F.when(F.col("main"), blocks("rest")).otherwise(F.concat(blocks("rest"), blocks("main")))
    large = large.withColumn("cells", F.transform(others, lambda o: F.concat_ws("|", F.least(o, F.col("mine")), F.greatest(o, F.col("mine")))))
    return large.drop("mine", "bands", "band", "one_rest", "one_main")


def _across_blocks(placed: DataFrame, rows: DataFrame, links: DataFrame, shingle: int, similarity: int, cell_rows: int, cell_shingles: int) -> DataFrame:
    """Links between blocks of large components: all sets outside the largest connected
    part (the rest) against every set that is not too large or small for them. A text becomes
    its set before it is copied to the cells."""
    parts = components(links, hashed=True)
    large = placed.where("blocks > 1").select("id", "t", "name", "grp", "n")
    large = materialize(large.join(parts, large.name == parts.node, "left").select("id", "t", "name", "grp", "n", F.coalesce("label", "name").alias("label")), "jaccard-large")
    biggest = large.groupBy("grp", "label").agg(F.count("*").alias("c")).groupBy("grp").agg(F.max_by("label", F.struct("c", "label")).alias("main"))
    large = materialize(large.join(materialize(biggest, "jaccard-main"), "grp").withColumn("main", F.col("label") == F.col("main")), "jaccard-split")
    paired = _in_block_pairs(large, similarity, cell_rows, cell_shingles).where(F.size("cells") > 0)
    paired = materialize(paired.select("id", "t", "grp", "label", "cells"), "jaccard-pairs")
    # Names of cells take under 50 bytes; so many are broadcast at most.
    few = (paired.agg(F.sum(F.size("cells"))).first()[0] or 0) <= 1_000_000
    cells = rows.join(F.broadcast(paired) if few else paired, ["id", "t"]).select("grp", F.explode("cells").alias("cell"), "text", "label")
    return materialize(cells.groupBy("grp", "cell").applyInPandas(_compare(shingle, similarity), "a string, b string").where("a <> b"), "jaccard-links2")
