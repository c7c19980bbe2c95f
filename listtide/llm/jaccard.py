"""N-gram Jaccard join with signature trees, and the groups of near duplicates that its links form.

1. Documents of equal shingle sets are one class. 2. A set goes to groups by its prefix: so many tokens, in an order that puts frequent
tokens last, that any partner must share several of them. Tokens that one class alone holds drop out, then sets with too few tokens left,
and of what is left of a set, its rarest tokens are enough to meet every partner. 3. Inside a group
the sets form a signature tree: a node has the OR of its sets' token bitmaps and their range of sizes. The traversal of node
pairs drops a pair whose largest possible overlap is too small; sets that remain are compared exactly. 4. A first round does this for
a few groups of each set and joins the links to components. 5. The second round takes every prefix token whose group still
holds several components, so that no link between different components is missed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from listtide.operators.skew import lookup

from .graph import components
from .tables import released, small_batches, table, written
from .words import SPACED, chunks, grams, mix, run_hash, signed, words

SHINGLE = 5
#: A link is NUMERATOR * union <= DENOMINATOR * intersection (0.8).
NUMERATOR, DENOMINATOR = 4, 5
#: A little more than the largest ratio of linked sizes, so that rounding puts no two of them more than one band apart.
BAND = DENOMINATOR / NUMERATOR * 1.0001
#: Counters of token frequency, one for each value of a token's leading bits. Those above HOT times the mean, fewer than
#: 2**SLOT_BITS / HOT, are all that is sent to the tasks.
SLOT_BITS, HOT = 20, 4
#: A prefix is longer by 1 / SPARE of the set than one shared token would need.
SPARE = 5
#: Groups of each set in the first round; most sets of a group in one tree (larger groups are dealt out over several).
LEADS, TREE_SETS = 3, 1000
LEAF, FANOUT = 8, 8
#: Rows of prefixes in one task, and bits of the table that spares shipping sets which no group asks for.
PREFIX_ROWS, ASKED_BITS = 1_000_000, 23
#: Text whose shingles are made at a time.
CHUNK_BYTES = 1 << 18

_U = np.uint64


def shingle_sets(texts: pa.Array) -> Iterator[tuple[int, list[np.ndarray], np.ndarray]]:
    """(first row, sorted distinct shingle hashes of each row, key of each set); 0 is the key of the empty set alone."""
    for row, stop, data, offsets in chunks(texts, CHUNK_BYTES):
        w = words(data, offsets, SPACED)
        at, shingle = grams(w, SHINGLE)
        first = np.searchsorted(at, w.first)
        out, keys = [], np.zeros(stop - row, dtype=np.uint64)
        for d in range(stop - row):
            own = shingle[first[d]:first[d + 1]]
            n = w.first[d + 1] - w.first[d]
            if not len(own) and n:
                own = run_hash(w.hash[w.first[d]:w.first[d + 1]], int(n))
            if len(own):
                own = np.unique(own)
                keys[d] = mix(mix(own).sum(keepdims=True) + _U(len(own)))[0] | _U(1)
            out.append(own)
        yield row, out, keys


def least_overlap(n: np.ndarray | int):
    """Tokens that a set of n shares with any set it links to."""
    return -(-NUMERATOR * n // DENOMINATOR)


def certain(n: np.ndarray | int):
    """Tokens that the prefixes of two linked sets have in common at least, when the smaller set has n."""
    return 1 + n // SPARE


def linked(n_a: int, n_b: int, shared: int) -> bool:
    return DENOMINATOR * shared >= NUMERATOR * (n_a + n_b - shared)


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, n, key) of each document, and (slot, count) of the slots that are frequent among a task's classes."""
    counts, seen, total = np.zeros(1 << SLOT_BITS, dtype=np.int64), set(), 0
    for batch in batches:
        n, keys = np.zeros(batch.num_rows, dtype=np.int64), np.zeros(batch.num_rows, dtype=np.uint64)
        for row, sets, own in shingle_sets(batch.column(0)):
            n[row:row + len(sets)] = [len(s) for s in sets]
            keys[row:row + len(sets)] = own
            new = [s for s, k in zip(sets, own.tolist(), strict=True) if len(s) and k not in seen]
            seen.update(own.tolist())
            if new:
                tokens = np.concatenate(new)
                total += len(tokens)
                counts += np.bincount((tokens >> _U(64 - SLOT_BITS)).astype(np.int64), minlength=len(counts))
        yield _table(batch.column(1), n, signed(keys), None, None)
    hot = np.flatnonzero(counts >= max(3, HOT * total / len(counts)))
    yield _table(None, None, None, np.append(hot, -1), np.append(counts[hot], total))


def _table(doc, n, key, slot, count) -> pa.RecordBatch:
    size = len(slot) if doc is None else len(n)
    cols = [pa.nulls(size, pa.string()) if doc is None else doc, *(pa.nulls(size, pa.int64()) if x is None else pa.array(x, pa.int64()) for x in (n, key, slot, count))]
    return pa.RecordBatch.from_arrays(cols, names=["doc_id", "n", "key", "slot", "count"])


def _levels(spark: SparkSession, survey: DataFrame) -> np.ndarray:
    """Per slot 0, or how many times (as a power of two) its count exceeds the mean."""
    counts = survey.where("slot IS NOT NULL").groupBy("slot").agg(F.sum("count").alias("count"))
    total = (counts.where("slot = -1").select("count").first() or [0])[0]
    mean = max(total / (1 << SLOT_BITS), 1e-9)
    hot = counts.where((F.col("slot") >= 0) & (F.col("count") >= max(3, HOT * mean))).toArrow()
    out = np.zeros(1 << SLOT_BITS, dtype=np.uint8)
    n = hot.column("count").to_numpy()
    out[hot.column("slot").to_numpy()] = np.clip(np.log2(np.maximum(n, 3) / max(mean, 1.0)), 1, 40)
    return out


def _prefixes(levels):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level_of, seen = levels.value, set()
        for batch in batches:
            for _, sets, keys in shingle_sets(batch.column(0)):
                out = []
                for s, k in zip(sets, keys.tolist(), strict=True):
                    if len(s) and k not in seen:
                        seen.add(k)
                        size = len(s) - least_overlap(len(s)) + certain(len(s))
                        need = certain(least_overlap(len(s)))
                        level = level_of[(s >> _U(64 - SLOT_BITS)).astype(np.int64)]
                        s = s[np.argsort(level, kind="stable")[:size]] if level.any() else s[:size]
                        out.append((s, k, need))
                if out:
                    sizes = np.array([len(s) for s, _, _ in out])
                    tokens = np.concatenate([s for s, _, _ in out])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(signed(tokens)), pa.array(signed(np.repeat(np.array([k for _, k, _ in out], dtype=np.uint64), sizes))),
                         pa.array(level_of[(tokens >> _U(64 - SLOT_BITS)).astype(np.int64)].astype(np.int8)),
                         pa.array(np.repeat(np.array([x for _, _, x in out], dtype=np.int32), sizes))], names=["token", "key", "level", "need"])

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct rows (token, key, level, need) whose token two classes hold; frequent tokens, which are dealt out over salts, stay anyway."""
    some = list(batches)
    if not some:
        return
    token, key, level, need = (np.concatenate([b.column(i).to_numpy() for b in some]) for i in range(4))
    order = np.lexsort((key, token))
    token, key, level, need = token[order], key[order], level[order], need[order]
    new = np.ones(len(token), dtype=bool)
    new[1:] = (token[1:] != token[:-1]) | (key[1:] != key[:-1])
    token, key, level, need = token[new], key[new], level[new], need[new]
    same = np.zeros(len(token) + 1, dtype=bool)
    same[1:-1] = token[1:] == token[:-1]
    keep = same[1:] | same[:-1] | (level > 0)
    yield pa.RecordBatch.from_arrays([pa.array(token[keep]), pa.array(key[keep]), pa.array(level[keep]), pa.array(need[keep])],
                                     names=["token", "key", "level", "need"])


def _asked(keys: DataFrame) -> np.ndarray:
    """A table of 2**ASKED_BITS bits, set for the keys: what is sent to the tasks has this size whatever the input's."""
    slots = keys.select(F.shiftrightunsigned("key", 64 - ASKED_BITS).alias("slot")).distinct()
    out = np.zeros(1 << ASKED_BITS, dtype=bool)
    for part in slots.toArrow().to_batches():
        out[part.column(0).to_numpy()] = True
    return np.packbits(out)


def _ship(asked):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = np.unpackbits(asked.value).astype(bool), set()
        for batch in batches:
            for _, sets, keys in shingle_sets(batch.column(0)):
                wanted = np.flatnonzero(bits[(keys >> _U(64 - ASKED_BITS)).astype(np.int64)])
                new = [d for d in wanted.tolist() if len(sets[d]) and int(keys[d]) not in seen]
                new = list({int(keys[d]): d for d in new}.values())
                seen.update(keys[new].tolist())
                if new:
                    yield pa.RecordBatch.from_arrays([pa.array(signed(keys[new])), pa.array([sets[d].tobytes() for d in new], pa.binary())], names=["key", "tokens"])

    return run


class Tree:
    """Signature tree of the sets of one group. Levels go from the root down; the last one is the leaves."""

    def __init__(self, sets: list[np.ndarray], label: np.ndarray):
        self.sets, self.size, self.parent = sets, np.array([len(s) for s in sets]), {int(x): int(x) for x in label}
        self.label = label
        width = 1 << max(6, int(np.ceil(np.log2(2 * self.size.max()))))
        width = min(width, 1 << 14)
        bits = np.zeros((len(sets), width), dtype=np.uint8)
        bits[np.repeat(np.arange(len(sets)), self.size), (np.concatenate(sets) & _U(width - 1)).astype(np.int64)] = 1
        self.bits = np.packbits(bits, axis=1).view(np.uint64)
        self.spare = self.size - np.bitwise_count(self.bits).sum(axis=1)  # tokens beyond the first of a bit
        groups = [np.arange(i, min(i + LEAF, len(sets))) for i in range(0, len(sets), LEAF)]
        self.leaves = groups
        level = self._nodes(groups)
        self.levels = [level]
        while len(level[0]) > 1:
            count = len(level[0])
            level = self._above(level, [np.arange(i, min(i + FANOUT, count)) for i in range(0, count, FANOUT)])
            self.levels.insert(0, level)

    def _nodes(self, groups):
        same = [self.label[g[0]] if (self.label[g] == self.label[g[0]]).all() else -1 for g in groups]
        return (np.stack([np.bitwise_or.reduce(self.bits[g], axis=0) for g in groups]), np.array([self.size[g].min() for g in groups]),
                np.array([self.size[g].max() for g in groups]), np.array([self.spare[g].max() for g in groups]), np.array(same))

    @staticmethod
    def _above(below, groups):
        bits, low, high, spare, same = below
        return (np.stack([np.bitwise_or.reduce(bits[g], axis=0) for g in groups]), np.array([low[g].min() for g in groups]),
                np.array([high[g].max() for g in groups]), np.array([spare[g].max() for g in groups]),
                np.array([same[g[0]] if (same[g] == same[g[0]]).all() else -1 for g in groups]))

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def leaf_pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of leaves that may hold a link, in parts: node pairs are followed downwards and dropped by their bound."""
        stack = [(0, np.array([0]), np.array([0]))]
        while stack:
            depth, x, y = stack.pop()
            bits, low, high, spare, same = self.levels[depth]
            need = least_overlap(np.maximum(low[x], low[y]))
            fit = (high[x] >= least_overlap(low[y])) & (high[y] >= least_overlap(low[x]))
            most = np.bitwise_count(bits[x] & bits[y]).sum(axis=1) + np.minimum(spare[x], spare[y])
            fit &= (np.minimum(most, np.minimum(high[x], high[y])) >= need) & ~((same[x] == same[y]) & (same[x] != -1))
            x, y = x[fit], y[fit]
            if not len(x):
                continue
            if depth + 1 == len(self.levels):
                yield x, y
                continue
            below = len(self.levels[depth + 1][0])
            kids = np.arange(FANOUT)
            left = np.repeat(x * FANOUT, FANOUT * FANOUT) + np.tile(np.repeat(kids, FANOUT), len(x))
            right = np.repeat(y * FANOUT, FANOUT * FANOUT) + np.tile(kids, FANOUT * len(x))
            good = (left < below) & (right < below) & (left <= right)
            left, right = left[good], right[good]
            for k in range(0, len(left), 2048):
                stack.append((depth + 1, left[k:k + 2048], right[k:k + 2048]))

    def links(self) -> Iterator[tuple[int, int]]:
        """Linked pairs of set numbers that join components: enough of them to connect all that is linked within the group."""
        cells = np.arange(LEAF)
        for x, y in self.leaf_pairs():
            a = np.repeat(x * LEAF, LEAF * LEAF) + np.tile(np.repeat(cells, LEAF), len(x))
            b = np.repeat(y * LEAF, LEAF * LEAF) + np.tile(cells, LEAF * len(x))
            good = (a < b) & (b < len(self.sets))
            a, b = a[good], b[good]
            need = least_overlap(np.maximum(self.size[a], self.size[b]))
            roots = np.array([self.root(int(v)) for v in self.label])
            good = (np.minimum(self.size[a], self.size[b]) >= need) & (roots[a] != roots[b])
            a, b, need = a[good], b[good], need[good]
            for k in range(0, len(a), 4096):
                p, q = a[k:k + 4096], b[k:k + 4096]
                both = np.bitwise_count(self.bits[p] & self.bits[q]).sum(axis=1) + np.minimum(self.spare[p], self.spare[q])
                for i, j in zip(p[both >= need[k:k + 4096]].tolist(), q[both >= need[k:k + 4096]].tolist(), strict=True):
                    u, v = self.root(int(self.label[i])), self.root(int(self.label[j]))
                    if u != v and linked(len(self.sets[i]), len(self.sets[j]), len(np.intersect1d(self.sets[i], self.sets[j], assume_unique=True))):
                        self.parent[max(u, v)] = min(u, v)
                        yield i, j


def _join_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) keys of links within each group of sorted rows (group, part, key, label, tokens)."""
    held: list[tuple[int, int, bytes]] = []
    at = None
    out: list[tuple[int, int]] = []

    def close() -> None:
        rows = {k: (label, tokens) for k, label, tokens in held}
        if len(rows) > 1 and len({x[0] for x in rows.values()}) > 1:
            keys = list(rows)
            sets = [np.frombuffer(rows[k][1], dtype=np.uint64) for k in keys]
            order = sorted(range(len(keys)), key=lambda i: (int(sets[i][0]), len(sets[i])))  # likely partners side by side
            keys = [keys[i] for i in order]
            tree = Tree([sets[i] for i in order], np.array([rows[k][0] for k in keys]))
            out.extend((keys[i], keys[j]) for i, j in tree.links())

    for batch in batches:
        for group, part, key, label, tokens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (group, part) != at:
                close()
                held.clear()
                at = (group, part)
            held.append((key, label, tokens))
        if out:
            yield _pairs(out)
            out.clear()
    close()
    if out:
        yield _pairs(out)


def _pairs(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    found = np.array(rows, dtype=np.int64)
    return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])


def _links(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Links within the groups of `rows` (group, part, key, label), each of bounded size."""
    rows = written(rows, "jaccard_groups")
    asked = docs.sparkSession.sparkContext.broadcast(_asked(rows))
    sets = docs.select("text").mapInArrow(released(_ship(asked)), "key long, tokens binary")
    full = rows.join(sets, "key").select("group", "part", "key", "label", "tokens")
    return written(full.repartition("group", "part").sortWithinPartitions("group", "part").mapInArrow(released(_join_groups), "a long, b long"), "jaccard_links")


def _rarest(shared: DataFrame) -> DataFrame:
    """(token, key, level) by which every set still meets each of its partners.

    A linked set has at least `need` tokens in common with any partner among its rows. Sets with fewer rows have no partner; of c
    rows, the first c - need + 1 in one order for all sets (rarest tokens first) hold a common one."""
    own = W.partitionBy("key")
    kept = written(shared.withColumn("c", F.count("*").over(own)).where("c >= need").drop("c"), "jaccard_kept")
    holders = kept.groupBy("token").agg(F.count("*").alias("holders")).where("holders > 1")
    again = kept.join(holders, "token").withColumn("c", F.count("*").over(own)).where("c >= need")
    place = F.row_number().over(own.orderBy("holders", "token"))
    return again.withColumn("place", place).where("place <= c - need + 1").select("token", "key", "level")


def _parts(size: Column) -> Column:
    return F.greatest(F.ceil(size / TREE_SETS), F.lit(1))


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, key) of every row of `docs` (doc_id, text), and (key, root): the classes that links connect to others.

    A null or empty text, or one of white space, has n and key 0 and is linked with nothing."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType
    survey = written(docs.select("text", F.col("doc_id").cast("string")).mapInArrow(released(_survey), "doc_id string, n long, key long, slot long, count long"), "jaccard_survey")
    members = survey.where("slot IS NULL").select(F.col("doc_id").cast(kind).alias("doc_id"), "n", "key")
    levels = spark.sparkContext.broadcast(_levels(spark, survey))
    tokens = members.agg(F.sum(F.col("n") / DENOMINATOR + F.col("n") / SPARE + 1)).first()[0] or 0
    deal = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(tokens // PREFIX_ROWS) + 1)
    salt = F.when(F.col("level") > 0, F.pmod("key", F.pow(F.lit(2.0), "level").cast("long"))).otherwise(0)
    prefix = docs.select("text").mapInArrow(released(_prefixes(levels)), "token long, key long, level byte, need int")
    shared = prefix.repartition(deal, "token", salt).mapInArrow(released(_shared), "token long, key long, level byte, need int")
    shared = written(_rarest(shared), "jaccard_shared")

    # First round: each set in the group of its least shared token under LEADS orders.
    lead = [F.min(F.shiftleft(F.col("level").cast("long"), 56).bitwiseOR(F.shiftrightunsigned(F.xxhash64("token", F.lit(j)), 8))).alias(f"g{j}") for j in range(LEADS)]
    leads = shared.groupBy("key").agg(*lead).select("key", F.explode(F.array_distinct(F.array(*[f"g{j}" for j in range(LEADS)]))).alias("group"))
    sizes = leads.groupBy("group").agg(F.count("*").alias("size")).where("size > 1")
    first = leads.join(sizes, "group").select("group", F.pmod(F.xxhash64("key", "group"), _parts(F.col("size"))).alias("part"), "key", F.col("key").alias("label"))
    links = _links(docs, first)
    roots = components(links)

    # Second round: tokens whose group holds several components. Groups with the same least set are mostly the holders of one
    # passage, so they count as one group and each set goes there once.
    labelled = written(shared.join(roots.withColumnRenamed("node", "key"), "key", "left").select("token", "key", F.coalesce("root", "key").alias("label")), "jaccard_labels")
    groups = labelled.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min("key").alias("group")).where("low <> high")
    open_rows = written(lookup(labelled, groups.select("token", "group"), ["token"], ["key"], "inner").select("group", "key", "label").distinct(), "jaccard_open")
    small, large = _by_size(open_rows)
    n = members.where("key <> 0").groupBy("key").agg(F.max("n").alias("n"))
    narrow, wide = _by_size(written(_banded(large.join(n, "key")), "jaccard_bands"))
    rest = _links(docs, small.unionByName(narrow).select("group", F.lit(0).cast("long").alias("part"), "key", "label").unionByName(_dealt(wide)))
    if rest.limit(1).count():
        label = [roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")) for c in ("a", "b")]
        joined = rest.join(label[0], "a", "left").join(label[1], "b", "left").select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))
        tops = components(joined).withColumnRenamed("node", "key")
        every = roots.select(F.col("node").alias("key"), F.col("root").alias("own")).unionByName(
            tops.join(roots.select(F.col("node").alias("key")), "key", "left_anti").select("key", F.col("key").alias("own")))
        roots = every.join(tops.select(F.col("key").alias("own"), "root"), "own", "left").select("key", F.coalesce("root", "own").alias("root"))
        return members, written(roots, "jaccard_roots")
    return members, roots.withColumnRenamed("node", "key")


def _by_size(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows (group, key, label) of groups that make one tree, and those of larger groups. Sizes are looked up, so that no group is
    brought together by its number."""
    sizes = written(rows.groupBy("group").agg(F.count("*").alias("size")), "jaccard_sizes")
    sized = lookup(rows, sizes, ["group"], ["key"], "inner")
    return sized.where(F.col("size") <= TREE_SETS), sized.where(F.col("size") > TREE_SETS).drop("size")


def _banded(rows: DataFrame) -> DataFrame:
    """Groups (group, key, label, n) split by set size: sizes of linked sets differ by at most a quarter, so they lie in one band of that
    width or in two neighbouring ones. A set goes to its own band and the one below; bands that hold one component drop out."""
    band = F.floor(F.log("n") / F.log(F.lit(BAND))).cast("int")
    each = rows.select(F.explode(F.array(band, band - 1)).alias("band"), "group", "key", "label").select(
        F.xxhash64("group", "band").alias("group"), "key", "label")
    mixed = each.groupBy("group").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("group")
    return lookup(each, written(mixed, "jaccard_mixed"), ["group"], ["key"], "inner").distinct()


def _dealt(rows: DataFrame) -> DataFrame:
    """Large groups in parts of bounded size, so that any two sets of different components meet in one of them.

    A group's sets of its most frequent component form blocks of one kind, all others blocks of the other kind. Every block of the
    first kind meets every block of the second, and those of the second meet each other; two of the first never need to."""
    per = rows.groupBy("group", "label").agg(F.count("*").alias("n"))
    most = per.groupBy("group").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.max("n").alias("n_main"), F.sum("n").alias("size"))
    half = TREE_SETS // 2
    blocks = most.select("group", "main", F.ceil(F.col("n_main") / half).cast("int").alias("first"), F.greatest(F.ceil((F.col("size") - F.col("n_main")) / half), F.lit(1)).cast("int").alias("second"))
    placed = lookup(rows.select("group", "key", "label"), blocks, ["group"], ["key"], "inner").withColumn("is_main", F.col("label") == F.col("main"))
    own = F.pmod(F.xxhash64("key"), F.when(F.col("is_main"), F.col("first")).otherwise(F.col("second"))).cast("int")
    placed = placed.withColumn("own", own)
    # Parts are numbered a * second + b for a main block a and another block b, then for pairs of other blocks b <= c.
    against = F.sequence(F.lit(0), F.col("second") - 1)
    main = F.transform(against, lambda b: (F.col("own") * F.col("second") + b).cast("long"))
    base = F.col("first").cast("long") * F.col("second")
    other = F.concat(F.transform(F.sequence(F.lit(0), F.col("first") - 1), lambda a: (a * F.col("second") + F.col("own")).cast("long")),
                     F.transform(against, lambda b: base + F.least(b, F.col("own")).cast("long") * F.col("second") + F.greatest(b, F.col("own"))))
    return placed.select("group", F.explode(F.when(F.col("is_main"), main).otherwise(other)).alias("part"), "key", "label")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of `docs` (doc_id, text).

    component_id is the smallest doc_id that links reach; null ids do not count, and are answered only where a component has no other.
    Texts without words answer with their own id. Repeated rows stay."""
    members, roots = classes(docs)
    least = members.where("key <> 0").groupBy("key").agg(F.min("doc_id").alias("least"))
    of = written(least.join(roots, "key", "left").select("key", F.coalesce("root", "key").alias("root"), "least"), "jaccard_classes")
    tops = of.groupBy("root").agg(F.min("least").alias("component_id"))
    found = written(of.join(tops, "root").select("key", "component_id"), "jaccard_components")
    texts = members.where("key <> 0").join(found, "key").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return texts.unionByName(members.where("key = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their set size and component."""
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP1_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
t AS (
  SELECT DISTINCT r, array_to_string(list_slice(w, p, p + 4), ' ') AS x
  FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM t GROUP BY r),
pairs AS (SELECT a.r AS a, b.r AS b, count(*) AS k FROM t a JOIN t b ON a.x = b.x AND a.r < b.r GROUP BY a.r, b.r),
e AS (SELECT a, b FROM pairs JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach(r, q) AS (SELECT r, r FROM d UNION SELECT reach.r, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.q)
SELECT d.doc_id, CAST(coalesce(max(n.n), 0) AS BIGINT) AS n_shingles, min(o.doc_id) AS component_id
FROM d LEFT JOIN n ON n.r = d.r JOIN reach ON reach.r = d.r JOIN d o ON o.r = reach.q GROUP BY d.r, d.doc_id
"""
