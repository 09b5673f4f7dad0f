"""Exact Jaccard join of shingle sets, as components: the size-aware heavy-light join.

Light sets (up to a boundary size) list every subset as large as the overlap that a partner's size asks for; two light
sets link only if they list a common one. Heavy sets are found through inverted lists of their prefix, the shingles that
come first in a common order, rare ones before frequent ones; light sets near the boundary stand in those lists too. The
boundary is the size up to which listing subsets costs fewer rows than scanning lists.

Frequencies come from a sketch over all documents, a fixed number of counters; they only order the shingles, so results
do not depend on them. Equal sets are one node. Within a list, members are first compared with a few pivots. Lists of up to
``LIST`` members are then compared member by member, where components differ. A longer list gets a centre: each member is
described by the shingles in which it differs from the centre. Two members link only if they have so many of these in common
that few of them need be listed anew, rare ones first (see ``_divided``). So neither a group of copies nor one of near
misses costs with the square of its size, and no link between components is lost.

Defined cases: no words: size 0, a component of its own. Null id: component null. Rows that share an id are one document
and link as any of them does. Ties: the smallest id names a component. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import dealt, forget, small, table, trim, written
from .components import components
from .words import NOT_SPACE, Words, groups, mix, shingle_sets

#: Counters of the sketch, and how many stand in one row.
COUNTERS, ROW = 1 << 21, 1 << 16
#: Sizes beyond this are never light: their subsets are too many at any cost of lists.
LIGHTEST = 40
#: Common prefix shingles that two heavy sets must show before their texts are compared.
AGREE = 4
#: So many members of a list are those that the others are compared with first; half of them have the fewest rare shingles.
PIVOTS = 2
#: Longer lists are divided by centres, so often at most; what is still longer then is compared member by member.
LIST, LEVELS = 256, 2
#: 64-bit words of a signature: bit k tells whether an odd number of the set's shingles fall on k.
SIGNS = 16
#: Weight of a shingle in which two sets differ from a centre: it stands alone for a common prefix.
ENOUGH = 1 << 20


class Rule:
    """n-word shingles; sets link at 100 * intersection >= percent * union."""

    def __init__(self, n: int, percent: int):
        self.n, self.percent = n, percent

    def least(self, size: int) -> int:
        """Smallest size of a partner."""
        return -(-size * self.percent // 100)

    def most(self, size: int) -> int:
        return size * 100 // self.percent

    def overlap(self, a: int, b: int) -> int:
        return -(-self.percent * (a + b) // (100 + self.percent))

    def prefix(self, size: int) -> int:
        """So many shingles of a set that partners share ``AGREE`` of them, or all of their overlap if that is less."""
        return min(size, size - self.least(size) + AGREE)

    def prefix_column(self, size: str) -> Column:
        return F.least(F.col(size), F.col(size) - F.ceil(F.col(size) * self.percent / 100) + AGREE)

    def difference(self, both: Column) -> Column:
        """Upper bound of the shingles in which linked sets of ``both`` shingles together differ."""
        return F.floor((100 - self.percent) * both / (100 + self.percent))

    def radii(self, size: int) -> tuple[float, float]:
        """Members that differ from a centre in no more than the first can't link with those that differ in more than the second."""
        p = self.percent / 100
        inner = 3 * (1 - p)
        return inner * size, (inner + (1 + inner) * (1 - p) / p) * size

    def overlap_column(self, a: str, b: str) -> Column:
        return F.ceil(self.percent * (F.col(a) + F.col(b)) / (100 + self.percent))

    def overlaps(self, size: int) -> list[int]:
        """The overlaps that partners of any size ask for."""
        return sorted({o for b in range(self.least(size), self.most(size) + 1) if (o := self.overlap(size, b)) <= size})

    def subsets(self, size: int) -> int:
        return sum(comb(size, o) for o in self.overlaps(size))


def _texts(b: pa.RecordBatch) -> tuple[list, list[bytes]]:
    return b.column(0).to_pylist(), [(t or b"").lower() for t in b.column(1).cast(pa.binary()).to_pylist()]


def _sets(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[tuple[list, list[np.ndarray]]]:
    for b in batches:
        keys, texts = _texts(b)
        for lo, hi in groups(texts):
            yield keys[lo:hi], shingle_sets(Words(texts[lo:hi], NOT_SPACE), rule.n)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def measured(d: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """Written tables: doc_id, n_shingles and two sums that name the set; and the tasks' counters."""
    kinds = [("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("sum_a", pa.int64()), ("sum_b", pa.int64()), ("row", pa.int32()), ("width", pa.int32()), ("counts", pa.binary())]
    batch = lambda **c: pa.RecordBatch.from_arrays([pa.array(c.get(n, [None] * len(next(iter(c.values())))), t) for n, t in kinds], names=[n for n, _ in kinds])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.uint32)
        for keys, sets in _sets(batches, rule):
            every = np.concatenate(sets)
            np.add(counts, np.bincount((every & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS).astype(np.uint32), out=counts)
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
            a, b = (np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(every ^ np.uint64(x)))]) for x in (1, 0x5851F42D4C957F2D))
            yield batch(doc_id=keys, n_shingles=np.diff(ends), sum_a=_signed(a[ends[1:]] - a[ends[:-1]]), sum_b=_signed(b[ends[1:]] - b[ends[:-1]]))
        for k in range(COUNTERS // ROW):
            part = counts[k * ROW : (k + 1) * ROW]
            width = 1 if part.max() < 256 else 2 if part.max() < 65536 else 4
            yield batch(row=[k], width=[width], counts=[part.astype(f"<u{width}").tobytes()])

    w = written(d.mapInArrow(rows, "doc_id long, n_shingles long, sum_a long, sum_b long, row int, width int, counts binary"), "sets")
    return w.where("row is null").select("doc_id", "n_shingles", "sum_a", "sum_b"), w.where("row is not null").select("row", "width", "counts")


def sketch(counters: DataFrame) -> np.ndarray:
    """The tasks' counters summed; each row's parts are added one at a time, and the driver gets ``COUNTERS`` numbers."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, total = None, None
        made = lambda: pa.RecordBatch.from_pydict({"row": pa.array([row], pa.int32()), "counts": pa.array([total.astype("<u8").tobytes()], pa.binary())})
        for b in batches:
            for r in b.to_pylist():
                if r["row"] != row:
                    if row is not None:
                        yield made()
                    row, total = r["row"], np.zeros(ROW, np.uint64)
                total += np.frombuffer(r["counts"], f"<u{r['width']}")
        if row is not None:
            yield made()

    # first in sixteen parts of each row, so that no task gets one from every task
    some = counters.repartition("row", F.pmod(F.xxhash64("counts"), F.lit(16))).sortWithinPartitions("row").mapInArrow(summed, "row int, counts binary")
    parts = some.withColumn("width", F.lit(8)).repartition("row").sortWithinPartitions("row").mapInArrow(summed, "row int, counts binary").collect()
    out = np.zeros(COUNTERS, np.uint64)
    for r in parts:
        out[r["row"] * ROW : (r["row"] + 1) * ROW] = np.frombuffer(r["counts"], "<u8")
    return out


def boundary(rule: Rule, sizes: dict[int, int], listed: float) -> int:
    """The light sizes: up to here, subsets cost fewer rows than prefixes whose entries each meet ``listed`` others."""
    best, least, subsets, lists = 0, 0.0, 0, 0.0
    for s in range(1, LIGHTEST + 1):
        n = sizes.get(s, 0)
        subsets += n * rule.subsets(s)
        lists += n * rule.prefix(s) * (1 + listed)
        if subsets - lists <= least:
            best, least = s, subsets - lists
    return best


def _subset_tokens(s: np.ndarray, rule: Rule) -> np.ndarray:
    out = []
    for o in rule.overlaps(len(s)):
        whole = mix(s)
        total = whole.sum(dtype=np.uint64)
        # a subset's name is the sum of its members: all, less those left out
        gone = np.array([sum((int(whole[i]) for i in c), 0) & 0xFFFFFFFFFFFFFFFF for c in combinations(range(len(s)), len(s) - o)], np.uint64)
        out.append(mix((total - gone) ^ np.uint64(o * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)))
    return np.concatenate(out)


def postings(d: DataFrame, rule: Rule, light: int, level: np.ndarray) -> DataFrame:
    """token, doc_id, size, weight (a common subset says as much as ``AGREE`` common prefix shingles), name (of the set)."""
    levels = d.sparkSession.sparkContext.broadcast(level)  # COUNTERS bytes

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = levels.value
        for keys, sets in _sets(batches, rule):
            tokens, docs, sizes, weights, names = [], [], [], [], []
            for k, s in zip(keys, sets, strict=True):
                if not len(s) or k is None:
                    continue
                found, name = [], mix(s ^ np.uint64(1)).sum(dtype=np.uint64).view(np.int64)
                if len(s) <= light:
                    sub = _subset_tokens(s, rule)
                    found.append((sub, AGREE))
                if rule.most(len(s)) > light:
                    p = rule.prefix(len(s))
                    by = order[(s & np.uint64(COUNTERS - 1)).astype(np.int64)]
                    # sets are sorted by hash, so a stable sort by level orders by (level, hash)
                    first = s[np.argsort(by, kind="stable")[:p]]
                    found.append((first, 1))
                for t, weight in found:
                    tokens.append(t)
                    weights.append(np.full(len(t), weight, np.int32))
                    docs.append(np.full(len(t), k, np.int64))
                    sizes.append(np.full(len(t), len(s), np.int32))
                    names.append(np.full(len(t), name, np.int64))
            if tokens:
                columns = {"token": _signed(np.concatenate(tokens)), "doc_id": np.concatenate(docs), "size": np.concatenate(sizes), "weight": np.concatenate(weights), "name": np.concatenate(names)}
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], names=list(columns))
        trim()

    return d.mapInArrow(rows, "token long, doc_id long, size int, weight int, name long")


def shared(p: DataFrame, rule: Rule, light: int) -> DataFrame:
    """The written postings whose token stands in several sets, with ``own``: so many prefix shingles of the set stand in no other prefix.

    They may stand in another set beyond its prefix, so ``own`` bounds no overlap; it only orders the pivots.
    """
    # most tokens stand in one set: they go before anything wider is shuffled
    several = written(p.groupBy("token").agg(F.min("name").alias("lo"), F.max("name").alias("hi")).where("lo < hi").select("token"), "shared")
    met = written(p.drop("name").join(several, "token", "left_semi"), "met")
    forget(p, several)
    listed = met.groupBy("doc_id", "size").agg(F.sum((F.col("weight") == 1).cast("int")).alias("n"))
    # rows that share an id count together, which can only lower the number
    own = F.greatest(F.lit(0), rule.prefix_column("size") - F.col("n"))
    has_prefix = F.floor(F.col("size") * 100 / rule.percent) > light
    out = written(met.join(listed.select("doc_id", "size", F.when(has_prefix, own).otherwise(0).cast("int").alias("own")), ["doc_id", "size"]), "postings")
    forget(met)
    return out


def _met(pairs: DataFrame, d: DataFrame) -> DataFrame:
    """The written pairs (a, b) with their texts; ``d`` has no repeated rows. A much-met b is dealt out in parts."""
    ids = written(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "ids")
    t = d.join(small(ids), "doc_id", "left_semi")
    side = lambda c: t.select(F.col("doc_id").alias(c), F.col("text").alias(f"text_{c}"))
    return dealt(pairs.select("a", "b").join(side("a"), "a"), side("b"), pairs, "b").select("a", "b", "text_a", "text_b")


def _set_pairs(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[list[tuple[int, int, np.ndarray, np.ndarray]]]:
    """a, b and their sets, of rows as ``_met`` makes them."""
    for batch in batches:
        a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
        left, right = ([(t or b"").lower() for t in batch.column(c).cast(pa.binary()).to_pylist()] for c in ("text_a", "text_b"))
        for lo, hi in groups([x + y for x, y in zip(left, right, strict=True)]):
            texts = list(dict.fromkeys(left[lo:hi] + right[lo:hi]))
            sets = dict(zip(texts, shingle_sets(Words(texts, NOT_SPACE), rule.n), strict=True))
            yield [(a[i], b[i], sets[left[i]], sets[right[i]]) for i in range(lo, hi)]


def linked(pairs: DataFrame, d: DataFrame, rule: Rule) -> DataFrame:
    """Those of the written pairs (a, b) whose whole texts link."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _set_pairs(batches, rule):
            ok = []
            for a, b, x, y in some:
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both and 100 * both >= rule.percent * (len(x) + len(y) - both):
                    ok.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in ok], pa.int64()) for k in (0, 1)], names=["a", "b"])
        trim()

    return written(_met(pairs, d).mapInArrow(rows, "a long, b long"), "linked")


def differences(pairs: DataFrame, d: DataFrame, rule: Rule) -> DataFrame:
    """Of each member a and its centre b: their sizes, in how many shingles they differ, whether they link, and in which they differ where a is near."""
    kinds = [("a", pa.int64()), ("b", pa.int64()), ("size", pa.int32()), ("size_b", pa.int32()), ("dist", pa.int32()), ("linked", pa.bool_()), ("tokens", pa.list_(pa.int64()))]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _set_pairs(batches, rule):
            out: list[list] = [[] for _ in kinds]
            for a, b, x, y in some:
                apart = np.setxor1d(x, y, assume_unique=True)
                both = (len(x) + len(y) - len(apart)) // 2
                near = len(apart) <= rule.radii(len(y))[1]
                values = (a, b, len(x), len(y), len(apart), bool(both) and 100 * both >= rule.percent * (both + len(apart)), _signed(apart).tolist() if near else None)
                for c, v in zip(out, values, strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(out, kinds, strict=True)], names=[n for n, _ in kinds])
        trim()

    return written(_met(pairs, d).mapInArrow(rows, "a long, b long, size int, size_b int, dist int, linked boolean, tokens array<long>"), "differences")


def _pairs(found: DataFrame) -> DataFrame:
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()


def joined(documents: DataFrame, n: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of each document."""
    rule = Rule(n, percent)
    d = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    sets, counters = measured(d, rule)
    # equal sets are one node, named by its smallest id
    equal = sets.where("n_shingles > 0").groupBy("sum_a", "sum_b", "n_shingles").agg(F.min("doc_id").alias("rep"))
    same = F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("rep")
    member = written(sets.join(equal, ["sum_a", "sum_b", "n_shingles"], "left").select("doc_id", "n_shingles", "sum_a", same), "member")
    rep = member.where("doc_id is not null").groupBy("doc_id").agg(F.min("rep").alias("rep"), F.min("n_shingles").alias("least"), F.max("n_shingles").alias("most"), (F.min("sum_a") != F.max("sum_a")).alias("several"), F.count(F.lit(1)).alias("rows"))
    # an id of several sets stands for itself, and is linked with the nodes of its sets
    rep = written(rep.withColumn("rep", F.when(F.col("several"), F.col("doc_id")).otherwise(F.col("rep"))), "rep")
    own = written(member.join(rep.where("several").select("doc_id"), "doc_id").where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).distinct(), "own")
    if not rep.where("rows > 1").isEmpty():
        d = d.dropDuplicates()

    counts = sketch(counters).astype(np.float64)
    total = max(1.0, counts.sum())
    load = total / COUNTERS
    level = np.frexp(np.floor(counts / (2 * load + 1)))[1].clip(0).astype(np.uint8)
    sizes = {r["n_shingles"]: r["count"] for r in sets.where(F.col("n_shingles").between(1, LIGHTEST)).groupBy("n_shingles").count().collect()}
    light = boundary(rule, sizes, float((counts * np.maximum(counts - load, 0)).sum() / total) * (1 - percent / 100))

    p = written(postings(d, rule, light, level), "postings")
    p = shared(p, rule, light)
    order = [F.xxhash64("doc_id", F.lit(k)).bitwiseAND((1 << 40) - 1) + (F.shiftleft(F.col("own").cast("long"), 40) if k % 2 else 0) for k in range(PIVOTS)]
    pivots = p.groupBy("token").agg(*[F.min_by("doc_id", o).alias(f"m{k}") for k, o in enumerate(order)])
    pivots = written(pivots.select("token", F.array_distinct(F.array(*[f"m{k}" for k in range(PIVOTS)])).alias("pivots")), "pivots")

    # pivots only bring members together early, so pairs that share little may wait for the last step
    star = p.join(pivots, "token").select("doc_id", "weight", F.explode("pivots").alias("pivot")).where("doc_id <> pivot")
    star = star.groupBy("doc_id", "pivot").agg(F.sum("weight").alias("n")).where(F.col("n") >= AGREE)
    side = lambda node, c: rep.select(F.col("doc_id").alias(node), F.col("rep").alias(c), F.col("least").alias(f"least_{c}"), F.col("most").alias(f"most_{c}"))
    star = star.join(side("doc_id", "a"), "doc_id").join(side("pivot", "b"), "pivot")
    star = star.where((100 * F.col("most_a") >= percent * F.col("least_b")) & (100 * F.col("most_b") >= percent * F.col("least_a")))
    star = written(star.where("a <> b").groupBy("a", "b").agg(F.max("n").alias("n")), "star")
    # first each node with the pivot it meets most often, then the members of lists that are still apart
    done = written(_pairs(star.groupBy("a").agg(F.max(F.struct("n", "b")).alias("m")).select("a", "m.b")), "pairs")
    links = linked(done, d, rule).unionByName(own)
    lists = p.join(rep.select("doc_id", F.col("rep").alias("node")), "doc_id").select("token", F.col("node").alias("doc_id"), "size", "weight", "own").distinct()
    odd = rep.where("several").select("doc_id")
    several = written(lists.join(odd, "doc_id", "left_semi"), "several")
    some = not several.isEmpty()
    few, links, of = _divided(lists.join(odd, "doc_id", "left_anti") if some else lists, links, d, rule)
    apart = _across(few, None, of, rule, light, signatures(few.select("doc_id").distinct(), d, rule))
    if some:  # ids of several sets have no one set to tell differences by: they meet all members of their lists
        apart = apart.union(several.select("token", F.col("doc_id").alias("a")).join(lists.select("token", F.col("doc_id").alias("b")), "token").select("a", "b"))
    more = written(_pairs(apart).join(done, ["a", "b"], "left_anti"), "pairs")
    links = links.unionByName(linked(more, d, rule))
    root = components(links)
    out = member.join(root.select(F.col("node").alias("rep"), "root"), "rep", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("root", "rep").alias("component_id"))


def _roots(links: DataFrame):
    """A function that adds root_c, the component so far, to a frame with a node c."""
    root = written(components(links), "roots")
    return lambda df, c: df.join(root.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")), c, "left").withColumn(f"root_{c}", F.coalesce(f"root_{c}", c))


def signatures(ids: DataFrame, d: DataFrame, rule: Rule) -> DataFrame:
    """a and the words of its signature: two sets differ in at least as many shingles as their signatures in bits."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, sets in _sets(batches, rule):
            bit = np.concatenate([mix(s) & np.uint64(64 * SIGNS - 1) for s in sets]).astype(np.int64)
            at = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
            odd = (np.bincount(at * 64 * SIGNS + bit, minlength=len(sets) * 64 * SIGNS) & 1).astype(np.uint8)
            words = np.packbits(odd).view(np.int64).reshape(len(sets), SIGNS)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *[pa.array(words[:, k]) for k in range(SIGNS)]], names=["a", *[f"s{k}" for k in range(SIGNS)]])
        trim()

    t = d.join(small(written(ids, "ids")), "doc_id", "left_semi").select("doc_id", "text")
    return t.mapInArrow(rows, ", ".join(["a long", *[f"s{k} long" for k in range(SIGNS)]])).dropDuplicates(["a"])


def _divided(lists: DataFrame, links: DataFrame, d: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame, object]:
    """Lists (token, doc_id, size, weight, own) with long ones divided; links with those found; components.

    A long list gets a centre c. D(x) are the shingles in which x differs from c. Two sets link if they differ in at most t of
    their shingles, which is the size of D(x) and D(y) less twice what these have in common. Members that differ from c
    in much stay in the list, without c; for those that differ in little, D(x) is listed: shingles that differ in members
    of several components, rare ones first, as many as two members that link can't miss. ``dist`` is the size of D(x), ``few``
    how many of its shingles stand in several components. So a pair is decided in a divided list, or all that it has in
    common is still listed.
    """
    rows = lists.select("token", "doc_id", "size", "weight", "own", F.lit(None).cast("int").alias("dist"), F.lit(None).cast("int").alias("few"))
    columns = rows.columns
    of = _roots(links)
    for level in range(LEVELS):
        named = of(rows.withColumnRenamed("doc_id", "a"), "a").withColumnRenamed("a", "doc_id")
        first = F.shiftleft(F.col("own").cast("long"), 40) + F.xxhash64("doc_id", F.lit(level)).bitwiseAND((1 << 40) - 1)
        mixed = named.groupBy("token").agg(F.min("root_a").alias("lo"), F.max("root_a").alias("hi"), F.count(F.lit(1)).alias("n"), F.min_by("doc_id", first).alias("centre")).where("lo < hi")
        mixed = written(mixed.select("token", "n", "centre"), "mixed")
        rows = written(named.select(columns).join(small(mixed), "token"), "lists")
        # listed differences are compared under a sharper bound, so their lists may be longer
        short = F.col("n") <= F.when(F.col("few").isNull(), LIST).otherwise(16 * LIST)
        long = rows.where(~short & (F.col("doc_id") != F.col("centre")))
        pairs = written(long.select(F.col("doc_id").alias("a"), F.col("centre").alias("b")).distinct(), "pairs")
        if pairs.isEmpty():
            break
        diff = differences(pairs, d, rule)
        found = diff.where("linked").select("a", "b")
        if not found.isEmpty():
            links = links.unionByName(found)
            of = _roots(links)
        inner, _ = rule.radii(1)
        beyond = diff.where(F.col("dist") > inner * F.col("size_b")).select(F.col("a").alias("doc_id"), F.col("b").alias("centre"))
        far = long.join(small(written(beyond, "beyond")), ["doc_id", "centre"]).select(columns)
        rows = written(rows.where(short).select(columns).unionByName(far).unionByName(_anew(diff, of, rule).select(columns)), "lists")
    return rows.select(columns), links, of


def _anew(diff: DataFrame, of, rule: Rule) -> DataFrame:
    """The lists of the shingles in which near members differ from their centre."""
    near = of(of(diff.where("tokens is not null"), "a"), "b")
    out = F.col("root_a") != F.col("root_b")
    least = near.groupBy("b").agg(*[f(F.when(c, F.col(v))).alias(f"{v}_{k}") for k, c in (("any", F.lit(True)), ("out", out)) for v, f in (("dist", F.min), ("size", F.max))])
    each = near.select("a", "b", "root_a", out.alias("out"), "size", "dist", F.explode("tokens").alias("shingle"))
    several = each.groupBy("b", "shingle").agg(F.min("root_a").alias("lo"), F.max("root_a").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi").select("b", "shingle", "n")
    each = each.join(small(written(several, "several")), ["b", "shingle"]).join(small(written(least, "least")), "b")
    # members of the centre's component only need those outside it
    dist, size = (F.when(F.col("out"), F.col(f"{v}_any")).otherwise(F.col(f"{v}_out")) for v in ("dist", "size"))
    most = F.least(size, F.floor(F.col("size") * 100 / rule.percent))
    common = F.greatest(F.lit(1), F.ceil((F.col("dist") + dist - rule.difference(F.col("size") + most)) / 2))
    by = Window.partitionBy("b", "a")
    each = each.withColumn("few", F.count(F.lit(1)).over(by).cast("int")).withColumn("rank", F.row_number().over(by.orderBy("n", "shingle")))
    return each.where(F.col("rank") <= F.col("few") - common + 1).select(F.xxhash64("b", "shingle").alias("token"), F.col("a").alias("doc_id"), "size", F.lit(ENOUGH).alias("weight"), F.lit(0).alias("own"), "dist", "few")


def _sizes(a: str, b: str, rule: Rule) -> Column:
    return 100 * F.least(a, b) >= rule.percent * F.greatest(a, b)


def _across(lists: DataFrame, rep: DataFrame | None, of, rule: Rule, light: int, signs: DataFrame | None = None) -> DataFrame:
    """Pairs in different components whose sizes allow a link and that share enough tokens.

    Of two prefixes, the one that ends first in the common order has all its common shingles in the other. So the overlap
    is at most the common prefix shingles and the rest of that set. Signatures (a, s0 and so on) that differ in more bits than
    linked sets may in shingles rule a pair out at once.
    """
    if rep is not None:
        lists = lists.join(rep.select("doc_id", "rep"), "doc_id").select("token", F.col("rep").alias("doc_id"), "size", "weight").distinct()
    if "dist" not in lists.columns:
        lists = lists.select("*", F.lit(None).cast("int").alias("dist"), F.lit(None).cast("int").alias("few"))
    named = of(lists.select("token", F.col("doc_id").alias("a"), "size", "weight", "dist", "few"), "a").withColumnRenamed("root_a", "root")
    mixed = named.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("token")
    named = _merged(written(named.join(small(written(mixed, "mixed")), "token"), "mixed"))
    # all that a member has in mixed lists, which is as much as it can have in common with any other
    most = written(named.groupBy("a", "size").agg(F.sum("weight").alias("most")), "most")
    named = named.join(small(most), ["a", "size"])
    named = written(named if signs is None else named.join(signs, "a"), "mixed")
    met = _meetings(named, rule, light).groupBy("a", "b", "size", "size_b").agg(F.sum("weight").alias("n"))
    return met.where(F.col("n") >= _needed(rule, light)).select("a", "b")


def _merged(named: DataFrame) -> DataFrame:
    """Lists of the very same members, as the shingles of a passage have, as one: its weights are theirs together."""
    mark = [F.bit_xor(F.xxhash64("a", "weight", "dist", "few", F.lit(k))).alias(f"x{k}") for k in range(2)]
    lists = named.groupBy("token").agg(*mark, F.count(F.lit(1)).alias("n"))
    first = lists.select("token", F.min("token").over(Window.partitionBy("x0", "x1", "n")).alias("first"))
    out = named.join(first, "token").groupBy("first", "a", "size", "root", "dist", "few").agg(F.sum("weight").alias("weight"))
    return written(out.withColumnRenamed("first", "token"), "lists")


def _needed(rule: Rule, light: int) -> Column:
    """So many common tokens of lists have two members that link."""
    overlap = rule.overlap_column("size", "size_b")
    rest = F.greatest(F.col("size") - rule.prefix_column("size"), F.col("size_b") - rule.prefix_column("size_b"))
    some = F.least(F.lit(AGREE), overlap)
    return F.when(F.greatest("size", "size_b") > light, F.greatest(some, overlap - rest)).otherwise(some)


def _meetings(named: DataFrame, rule: Rule, light: int) -> DataFrame:
    """Members a and b of a list that may link, by all that is known of either."""
    words = [c for c in named.columns if c[0] == "s" and c[1:].isdigit()]
    # what two members differ in from their centre must have enough in common
    common = F.ceil((F.col("dist") + F.col("dist_b") - rule.difference(F.col("size") + F.col("size_b"))) / 2)
    can = (F.col("root") < F.col("root_b")) & _sizes("size", "size_b", rule) & F.coalesce(common <= F.least("few", "few_b"), F.lit(True))
    can &= F.least("most", "most_b") >= _needed(rule, light)
    if words:
        can &= sum(F.bit_count(F.col(w).bitwiseXOR(F.col(f"{w}_b"))) for w in words) <= rule.difference(F.col("size") + F.col("size_b"))
    right = named.select("token", F.col("a").alias("b"), *[F.col(c).alias(f"{c}_b") for c in ("root", "size", "dist", "few", "most", *words)])
    return named.join(right, "token").where(can)


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(table(spark, sf_dir, "documents"), n=4, percent=85)


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' ')) END) AS g FROM w),
u AS (SELECT doc_id, unnest(g) AS h FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM u a JOIN u b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * n >= 85 * (len(x.g) + len(y.g) - n)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS root FROM s UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id)
SELECT s.doc_id, CAST(len(g) AS BIGINT) AS n_shingles, min(root) AS component_id FROM s JOIN r USING (doc_id) GROUP BY s.doc_id, len(g)
"""
