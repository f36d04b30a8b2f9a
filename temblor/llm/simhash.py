"""SimHash fingerprints, linked by BK-trees over shards.

A BK-tree keys the children of a node by their Hamming distance to it; a search
with radius r follows only the edges from d - r to d + r. One tree over all
documents, broadcast to all tasks, would have no size bound and its searches
would visit about half of it, so trees are built per shard and only those who
can find something in a shard's tree are sent to it:

* ``fingerprint_links`` (radius 2 or less, exact). The 64 bits are cut into
  four blocks. Fingerprints at distance 2 agree on two blocks at least, so a
  shard is a pair of blocks with its 32 bits, six per fingerprint. Shards with
  more than ``CROWDED`` fingerprints are cut again by pairs of bytes of the other
  32 bits, which leaves 16 free bits: no shard holds more than 65,536.
* ``near_duplicates`` (five words, similarity 0.8 by default). The radius is
  wide there, so shards are anchors: the least of a document's shingle hashes
  under each of several orders. Two documents of similarity s share one given
  anchor with probability s and miss all six with (1 - s) ** 6, 0.006 % at 0.8.
  Fingerprints in the radius are checked by the exact Jaccard similarity of
  their shingle sets. A task holds the sets of one anchor's different texts.

Equal fingerprints or texts are put together before any search, so the largest
groups of copies cost one row per shard.

Defined cases: null and empty texts, and those of white space only, have no
words and fingerprint 0, and link like any other; fewer words than a shingle
are one shingle; repeated ids and rows are allowed; a null id never is a
group's id unless all its ids are null; further columns are dropped by
``fingerprints`` and ``fingerprint_groups`` and kept by ``near_duplicates``.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from temblor.llm.components import components
from temblor.session import materialize

SEED = 42
#: A to Z in lower case, other bytes as they are.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Shingles hashed at a time, so that one long text needs little memory.
CHUNK = 1 << 15
#: Fingerprints in a shard above which it is cut again.
CROWDED = 2048
#: Seeds of independent orders of shingle hashes.
ORDERS = np.random.default_rng(SEED).integers(0, 1 << 64, 16, dtype=np.uint64)


def reordered(hashes: np.ndarray, order: int) -> np.ndarray:
    """Hashes under an order: a full 64-bit finaliser after the order's seed, so that no order follows another."""
    h = hashes ^ ORDERS[order]
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_hashes(text: str | None, length: int) -> Iterator[np.ndarray]:
    """XXH64 of the word shingles of a whole text, repeats included, in chunks."""
    words = (text or "").encode("utf-8").translate(LOWER).split()
    if not words:
        return
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes + 1) - 1
    length = min(length, len(words))
    begins, ends = (ends - sizes)[: len(words) - length + 1].tolist(), ends[length - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    for k in range(0, len(begins), CHUNK):
        part = zip(begins[k:k + CHUNK], ends[k:k + CHUNK])
        yield np.array([digest(joined[i:j], SEED) for i, j in part], dtype="<u8")


def fingerprint(chunks) -> int:
    """Bits set in over half of the hashes, as a signed 64-bit number."""
    ones, total = np.zeros(64, dtype=np.int64), 0
    for h in chunks:
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
        total += len(h)
    if not total:
        return 0
    return int(np.packbits(2 * ones > total, bitorder="little").view("<i8")[0])


class BKTree:
    """Fingerprints under integer Hamming distances."""

    def __init__(self):
        self.root = None

    def search(self, value: int, radius: int) -> list[tuple[int, int]]:
        """``(distance, fingerprint)`` of all within the radius."""
        found, todo = [], [self.root] if self.root else []
        while todo:
            node, children = todo.pop()
            d = (node ^ value).bit_count()
            if d <= radius:
                found.append((d, node))
            if children:
                todo.extend(child for edge, child in children.items() if d - radius <= edge <= d + radius)
        return found

    def add(self, value: int) -> None:
        """Hang a new fingerprint below the path of its distances."""
        if self.root is None:
            self.root = (value, {})
            return
        at = self.root
        while (d := (at[0] ^ value).bit_count()) and d in at[1]:
            at = at[1][d]
        if d:
            at[1][d] = (value, {})


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """``id, fp`` (a signed long) of each whole text."""
    @F.pandas_udf("bigint")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: fingerprint(shingle_hashes(x, words))).astype("int64")

    return docs.select(F.col(id_col), run(F.coalesce(F.col(text), F.lit(""))).alias("fp"))


def _bits(value, parts: tuple[int, ...], width: int, start: int = 0):
    """The named parts of ``width`` bits, joined into one number."""
    mask = (1 << width) - 1
    out = F.lit(0).cast("bigint")
    for k in parts:
        out = F.shiftleft(out, width).bitwiseOR(F.shiftrightunsigned(value, start + k * width).bitwiseAND(F.lit(mask)))
    return out


def fingerprint_links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """Links ``a, b`` that join all distinct fingerprints within the radius.

    Of the links inside a shard, those are given that are needed to hold its
    fingerprints together, at most one per fingerprint and shard.
    """
    if radius > 2:
        raise ValueError("shards by pairs of blocks find distances up to 2")
    pairs = list(combinations(range(4), 2))
    fp = F.col("fp")
    shards = F.array(*[F.struct(F.lit(k).alias("pair"), _bits(fp, p, 16).alias("bits"))
                       for k, p in enumerate(pairs)])
    rows = fps.select("fp", F.explode(shards).alias("s")).select("fp", "s.pair", "s.bits")
    crowded = rows.groupBy("pair", "bits").count().where(F.col("count") > CROWDED).select(
        "pair", "bits", F.lit(True).alias("crowded"))
    rest = F.lit(0).cast("bigint")
    for k, p in enumerate(pairs):
        others = tuple(x for x in range(4) if x not in p)
        rest = F.when(F.col("pair") == k, _bits(fp, others, 16)).otherwise(rest)
    cut = F.array(*[F.struct(F.lit(k).alias("part"), _bits(F.col("rest"), p, 8).alias("more"))
                    for k, p in enumerate(pairs)])
    whole = F.array(F.struct(F.lit(-1).alias("part"), F.lit(0).cast("bigint").alias("more")))
    placed = (rows.join(crowded, ["pair", "bits"], "left").withColumn("rest", rest)
              .select("fp", "pair", "bits", F.explode(F.when(F.col("crowded"), cut).otherwise(whole)).alias("s"))
              .select("fp", "pair", "bits", "s.part", "s.more"))
    keys = ["pair", "bits", "part", "more"]
    dealt = placed.repartition(*keys).sortWithinPartitions(*keys, "fp")

    def search(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, values in _groups(parts, keys, ["fp"]):
            links = list(_tree_links(values[0], radius))
            if links:
                yield pd.DataFrame(links, columns=["a", "b"])

    return dealt.mapInPandas(search, "a bigint, b bigint")


def _groups(parts: Iterator[pd.DataFrame], keys: list[str], columns: list[str]):
    """Runs of two rows or more with equal keys, across batches; the rows must be sorted by them."""
    last, held = None, None
    for frame in parts:
        if not len(frame):
            continue
        by = [frame[k].to_numpy() for k in keys]
        new = np.ones(len(frame), dtype=bool)
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in by])
        if last is not None and all(c[0] == x for c, x in zip(by, last)):
            new[0] = False
        starts = np.flatnonzero(new).tolist()
        data = [frame[c].tolist() for c in columns]
        for begin, end in zip([0, *starts] if not new[0] else starts, [*starts, len(frame)] if not new[0]
                              else [*starts[1:], len(frame)]):
            part = [c[begin:end] for c in data]
            if held is not None and begin == 0 and not new[0]:
                for have, more in zip(held, part):
                    have.extend(more)
            else:
                if held is not None and len(held[0]) > 1:
                    yield last, held
                held = part
            last = tuple(c[begin] for c in by)
    if held is not None and len(held[0]) > 1:
        yield last, held


def _tree_links(values: list[int], radius: int) -> Iterator[tuple[int, int]]:
    """Links that join the values within the radius, by one BK-tree."""
    tree, above = BKTree(), {}

    def top(x: int) -> int:
        while above[x] != x:
            above[x] = above[above[x]]
            x = above[x]
        return x

    for value in values:
        above[value] = value
        for _, other in tree.search(value, radius):
            one, two = top(value), top(other)
            if one != two:
                above[one] = two
                yield value, other
        tree.add(value)


def fingerprint_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = 3,
                       radius: int = 2) -> DataFrame:
    """``id, fingerprint`` (16 hex digits) and ``component_id``, the least id reachable."""
    found = materialize(fingerprints(docs, id_col, text, words))
    distinct = materialize(found.groupBy("fp").agg(F.min(id_col).alias("first")))
    joined = components(fingerprint_links(distinct.select("fp"), radius)).withColumnRenamed("node", "fp")
    rooted = distinct.join(joined, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return found.join(named, "fp").select(
        id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def row_key(id_col, text):
    """Id and text of a document as one key without nulls."""
    return F.concat(F.coalesce(id_col.cast("string"), F.lit("null")), F.lit(":"),
                    F.xxhash64(F.coalesce(text, F.lit(""))).cast("string"))


def sketches(docs: DataFrame, id_col: str, text: str, words: int, anchors: int) -> DataFrame:
    """``id, key, same, fp, anchors``: digest of the words, fingerprint, the least hash under each order."""
    @F.pandas_udf("same string, fp bigint, anchors array<bigint>")
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for x in texts:
            same = xxhash.xxh3_128_hexdigest(b" ".join((x or "").encode("utf-8").translate(LOWER).split()))
            chunks = list(shingle_hashes(x, words))
            least = [0] * anchors
            every = np.unique(np.concatenate([*chunks, np.empty(0, dtype="<u8")]))  # as sets, like the similarity
            if len(every):
                for k in range(anchors):
                    least[k] = int(reordered(every, k).min().view(np.int64))
            rows.append((same, fingerprint([every]), least))
        return pd.DataFrame(rows, columns=["same", "fp", "anchors"])

    done = docs.select(F.col(id_col).alias("id"), row_key(F.col(id_col), F.col(text)).alias("key"),
                       run(F.coalesce(F.col(text), F.lit(""))).alias("s"))
    return done.select("id", "key", "s.same", "s.fp", "s.anchors")


#: Room for rounding where a share of a set is turned into a number of shingles.
TINY = 1e-9


class Shard:
    """Documents of one shard: a BK-tree of fingerprints, their shingle sets, and who is linked to whom.

    A document's prefix are its least shingles, so many that a document as similar
    as asked for shares one of them. How many two prefixes share bounds what the
    sets share, so pairs are left out only where they cannot be similar.
    """

    def __init__(self, radius: int, similarity: float):
        self.radius, self.similarity = radius, similarity
        self.tree, self.at = BKTree(), {}
        self.names, self.sets, self.above = [], [], []
        self.places: dict[int, array] = {}
        #: Size, shingles behind the prefix, and last shingle of the prefix.
        self.sizes, self.behind = np.empty(64, dtype=np.int64), np.empty(64, dtype=np.int64)
        self.last = np.empty(64, dtype="<u8")

    def top(self, k: int) -> int:
        while self.above[k] != k:
            self.above[k] = self.above[self.above[k]]
            k = self.above[k]
        return k

    def hopeful(self, mine: np.ndarray, prefix: list[int], last: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents that can be similar, and how many shingles of the prefix they share."""
        lists = [np.frombuffer(self.places[h], dtype=np.int64) for h in prefix if h in self.places]
        if not lists:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        others, shared = np.unique(np.concatenate(lists), return_counts=True)
        # Of the prefix that ends first, all that the sets share is in the other prefix too.
        rest = np.where(self.last[others] >= last, len(mine) - len(prefix), self.behind[others])
        least = self.similarity / (1 + self.similarity) * (len(mine) + self.sizes[others])
        can = shared + rest >= least - TINY
        return others[can], shared[can]

    def add(self, name: str, fp: int, text: str, words: int) -> Iterator[tuple[str, str]]:
        """Links of a new document to earlier ones, one per group that it belongs to."""
        mine = np.unique(np.concatenate([*shingle_hashes(text, words), np.empty(0, dtype="<u8")]))
        prefix = mine[:len(mine) - math.ceil(self.similarity * len(mine) - TINY) + 1].tolist()
        last = prefix[-1] if prefix else 0
        me = len(self.names)
        self.above.append(me)
        if me and prefix:
            others, shared = self.hopeful(mine, prefix, last)
            within = np.zeros(me, dtype=bool)
            if len(others):
                within[[k for _, other in self.tree.search(fp, self.radius) for k in self.at[other]]] = True
            # First what the tree found; similar texts may have far fingerprints, so then the rest of the shard.
            for k in others[np.lexsort((-shared, ~within[others]))].tolist():
                if self.top(k) != self.top(me) and _alike(mine, self.sets[k], self.similarity):
                    self.above[self.top(me)] = self.top(k)
                    yield name, self.names[k]
        if me == len(self.sizes):
            self.sizes, self.behind, self.last = (np.concatenate([x, np.empty_like(x)])
                                                  for x in (self.sizes, self.behind, self.last))
        self.sizes[me], self.behind[me], self.last[me] = len(mine), len(mine) - len(prefix), last
        for h in prefix:
            self.places.setdefault(h, array("q")).append(me)
        self.names.append(name)
        self.sets.append(mine)
        self.tree.add(fp)
        self.at.setdefault(fp, []).append(me)


def _similar(parts: Iterator[pd.DataFrame], words: int, radius: int, similarity: float) -> Iterator[pd.DataFrame]:
    """Links that hold the similar documents of each shard together."""
    at = shard = None
    for frame in parts:
        links = []
        for key, value, same, fp, text in zip(frame["slot"], frame["anchor"], frame["same"], frame["fp"],
                                              frame["text"]):
            if (key, value) != at:
                at, shard = (key, value), Shard(radius, similarity)
            links.extend(shard.add(same, fp, text, words))
        if links:
            yield pd.DataFrame(links, columns=["a", "b"])


def _alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    small, large = sorted((len(a), len(b)))
    if small < similarity * large - TINY:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (small + large - both) - TINY


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = 5,
                    similarity: float = 0.8, radius: int = 20, anchors: int = 6) -> DataFrame:
    """Add ``group_id``, the least id of the group of near copies, and ``keeper``, true in one row of each.

    A shard's documents are read one by one. The BK-tree gives those within the
    radius, which come first; the others of the shard follow, as a fingerprint can
    be far from that of a similar text. Those whose least shingles show that they
    cannot be similar are left out, and the shingle sets decide. Documents in one
    group already are not compared again. Of rows with equal id and text one comes out.
    """
    found = materialize(sketches(docs, id_col, text, words, anchors))
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("least")
    kinds = materialize(found.groupBy("same").agg(least, F.first("fp").alias("fp"),
                                                  F.first("anchors").alias("anchors")))
    placed = kinds.select("same", F.col("least.key").alias("key"), "fp", F.posexplode("anchors").alias(
        "slot", "anchor"))
    crowd = placed.groupBy("slot", "anchor").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    placed = materialize(placed.join(crowd, ["slot", "anchor"], "left_semi"))
    # One text of each kind that has company goes to its shards.
    texts = docs.select(row_key(F.col(id_col), F.col(text)).alias("key"), F.coalesce(text, F.lit("")).alias("text"))
    wanted = placed.select("same", "key").distinct()
    one = texts.join(wanted.hint("merge"), "key").dropDuplicates(["key"]).select("same", "text")
    dealt = (placed.select("slot", "anchor", "same", "fp").join(one, "same")
             .repartition("slot", "anchor").sortWithinPartitions("slot", "anchor", "same"))
    links = dealt.select("slot", "anchor", "same", "fp", "text").mapInPandas(
        lambda parts: _similar(parts, words, radius, similarity), "a string, b string")
    joined = components(links).withColumnRenamed("node", "same")
    rooted = kinds.select("same", "least").join(joined, "same", "left").withColumn("root", F.coalesce("root", "same"))
    group = rooted.groupBy("root").agg(F.min("least").alias("head"))
    named = rooted.join(group, "root").select("same", "head")
    ids = found.select("key", "same").distinct().join(named, "same").select(
        F.col("key").alias("_key"), F.col("head.id").alias("group_id"),
        (F.col("key") == F.col("head.key")).alias("keeper"))
    kept = [c for c in docs.columns if c not in ("group_id", "keeper")]
    rest = docs.select(*[F.col(f"`{c}`") for c in kept]).withColumn("_key", row_key(F.col(id_col), F.col(text)))
    return rest.join(ids, "_key").dropDuplicates(["_key"]).drop("_key")
