"""Near-duplicate detection by HyperMinHash sketches, banding, collision-corrected estimates and exact verification.

A document's set is its distinct k-word shingles (64-bit hashes of words `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased). A sketch has
128 buckets; a bucket keeps, of its smallest hash, the number of leading zeros and ten mantissa bits. Empty buckets
borrow from others in a fixed random order, so that small sets have full sketches too.

1. Documents with equal sets form classes; each class goes on as one node, its smallest doc_id.
2. The sketch is cut into 32 bands of 4 registers; nodes that share a band meet. Each meets the pivot of its band
   first, the node that meets most others in all its bands, which is the original in a group of its near copies.
   Estimates sort out the hopeless pairs and full sets confirm the rest. A node's home is the busiest of its pivots.
3. Nodes that were not linked to their home are compared with all nodes of the same home, in blocks of full sets; a
   block hands on only the links that join components.
4. Nodes of different homes that share a band and are still in different components are paired, so no link that
   shares a band is lost. Large bands are compared in blocks here, too, which hand on what passes the estimate.
5. Components of all confirmed links give each document its smallest reachable doc_id.

Two sets with a similarity of 0.8 share none of 32 bands with a chance of about 5e-8.

Documents without words, and rows without doc_id, are linked with nothing. Rows with the same doc_id are one node; links of
either of their texts count. Null texts are empty. Other columns pass through `deduplicate` untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrylake.llm.common import BROADCAST_IDS, HOT_SHARE, connected_components, exact, mix, shingle_sets, skew_join, staged, text_slices, with_ids

BUCKETS, MANTISSA = 128, 10
ROWS = 4
BANDS = BUCKETS // ROWS
_EMPTY = np.uint16(0xFFFF)
#: Estimates within so many standard errors below the threshold are verified.
MARGIN = 5.0
#: Bands with more nodes than this are compared in blocks of this many.
BLOCK = 256
#: Pairs of one hot node that share a task.
PAIRS_A_TASK = 512

_ORDER = np.stack([np.argsort(mix(np.arange(1 + 1000 * b, 1 + 1000 * b + BUCKETS, dtype=np.uint64)), kind="stable") for b in range(BUCKETS)])


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """One row of BUCKETS registers for each sorted set; a row of an empty set stays empty."""
    out = np.full((len(sets), BUCKETS), _EMPTY, np.uint16)
    if not sets:
        return out
    n = np.array([len(s) for s in sets])
    h = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), n)
    bucket = (h >> np.uint64(57)).astype(np.int64)
    cell = row * BUCKETS + bucket
    first = np.ones(len(h), bool)
    first[1:] = cell[1:] != cell[:-1]
    rest = ((h[first] & np.uint64((1 << 57) - 1)) >> np.uint64(4)).astype(np.float64)
    fraction, exponent = np.frexp(rest)
    mantissa = np.where(rest > 0, (fraction * 2 - 1) * (1 << MANTISSA), 0).astype(np.uint16)
    zeros = np.where(rest > 0, 53 - exponent, 60).astype(np.uint16)
    out.reshape(-1)[cell[first]] = (zeros << np.uint16(MANTISSA)) | mantissa
    own = out != _EMPTY
    todo = np.flatnonzero(own.any(1) & ~own.all(1))
    for t in range(BUCKETS):
        if not len(todo):
            break
        take = _ORDER[:, t]
        some, have = out[todo], own[todo]
        fill = (some == _EMPTY) & have[:, take]
        rows, cols = np.nonzero(fill)
        some[rows, cols] = out[todo[rows], take[cols]]
        out[todo] = some
        todo = todo[(some == _EMPTY).any(1)]
    return out


def estimate(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Jaccard estimates of pairs of sketches: share of equal registers, less what unequal sets would agree on by chance."""
    agree = (a == b).mean(1)
    with np.errstate(over="ignore", under="ignore"):
        chance = np.zeros(len(a))
        la, lb = np.maximum(size_a, 1) / BUCKETS, np.maximum(size_b, 1) / BUCKETS
        for i in range(40):
            p = [np.exp(-x * 2.0 ** -(i + 1)) - np.exp(-x * 2.0**-i) for x in (la, lb)]
            chance += p[0] * p[1] / (1 << MANTISSA)
    return np.clip((agree - chance) / (1 - chance), 0, 1)


def likely(est: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, percent: int) -> np.ndarray:
    """Pairs that may reach the threshold: sizes allow it, and the estimate is not far below."""
    low, high = np.minimum(size_a, size_b), np.maximum(size_a, size_b)
    t = percent / 100
    spread = np.sqrt(t * (1 - t) / np.minimum(BUCKETS, np.maximum(low, 1)))
    return (100 * low >= percent * high) & (est >= t - MARGIN * spread)


def _features(k: int, with_set: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = batch.column(1), batch.column(0)
            for a, b in text_slices(texts):
                sets = list(shingle_sets(texts.slice(a, b - a), k))
                columns = [ids.slice(a, b - a), pa.array([len(s) for s in sets], pa.int64())]
                if with_set:
                    columns += [pa.array([x.tobytes() for x in sketches(sets)], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())]
                    names = ["node", "n", "sketch", "hashes"]
                else:
                    # two independent sums over the set, which name the set
                    with np.errstate(over="ignore"):
                        one = [int(s.sum(dtype=np.uint64)) for s in sets]
                        two = [int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)) for s in sets]
                    columns += [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (one, two)]
                    columns.append(pa.array([x.tobytes() if len(s) else None for x, s in zip(sketches(sets), sets, strict=True)], pa.binary()))
                    names = ["doc_id", "n", "set1", "set2", "sketch"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    salt = mix(np.arange(1, BANDS + 1, dtype=np.uint64))
    for batch in batches:
        if batch.num_rows:
            s = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, BUCKETS)
            keys = mix(np.ascontiguousarray(s).view(np.uint64).reshape(-1, BANDS) ^ salt)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), BANDS)), pa.array(keys.reshape(-1).view(np.int64))], names=["node", "band"])


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            c = {n: batch.column(n) for n in batch.schema.names}
            sizes = [c[x].to_numpy() for x in ("n_a", "n_b")]
            sk = [np.frombuffer(b"".join(c[x].to_pylist()), np.uint16).reshape(-1, BUCKETS) for x in ("sketch_a", "sketch_b")]
            good = likely(estimate(*sk, *sizes), *sizes, percent)
            for i in np.flatnonzero(good):
                x, y = (np.frombuffer(c[n][int(i)].as_py(), np.uint64) for n in ("hashes_a", "hashes_b"))
                both = len(np.intersect1d(x, y, assume_unique=True))
                good[i] = 100 * both >= percent * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([pa.array(c[x].to_numpy()[good]) for x in ("a", "b")], names=["a", "b"])

    return run


def _confirmed(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough. Sets are made again from the texts, for these nodes only."""
    some = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    sets = staged(with_ids(texts, some, "doc_id").select("doc_id", "text").mapInArrow(_features(k, True), "node long, n long, sketch binary, hashes binary"), "sets")
    # A hot node's set is dealt to several tasks, each with some of its pairs.
    shares = pairs.groupBy("a").agg(F.ceil(F.count("*") / PAIRS_A_TASK).cast("int").alias("shares"))
    dealt = skew_join(pairs, shares, "a", "inner").withColumn("share", F.pmod(F.xxhash64("b"), F.col("shares")).cast("int"))
    left = sets.select(*(F.col(c).alias(f"{c}_a") for c in ("node", "n", "sketch", "hashes")))
    left = left.join(shares, F.col("node_a") == F.col("a"), "inner").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("a", "shares")
    right = sets.select(*(F.col(c).alias(f"{c}_b") for c in ("node", "n", "sketch", "hashes")))
    # Sets meet their pairs in a shuffle at every size: neither side has a bound.
    full = dealt.join(right.hint("merge"), dealt["b"] == right["node_b"]).join(left.hint("merge"), (F.col("a") == F.col("node_a")) & (dealt["share"] == left["share"]))
    return full.select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b", "hashes_a", "hashes_b").mapInArrow(_verify(percent), "a long, b long").distinct()


def _across(percent: int):
    """Likely pairs of nodes of different components and homes, of one pair of blocks of a large band."""

    def run(rows: pa.Table) -> pa.Table:
        found: list[tuple[int, int]] = []
        s = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint16).reshape(-1, BUCKETS)
        n, node, comp, home, block = (rows.column(c).to_numpy() for c in ("n", "node", "component", "home", "block"))
        one, two = rows.column("i")[0].as_py(), rows.column("j")[0].as_py()
        second = np.flatnonzero(block == two)
        for x in np.flatnonzero(block == one):
            y = second[(comp[second] != comp[x]) & (home[second] != home[x]) & ((node[second] > node[x]) if one == two else True)]
            if len(y):
                m = np.full(len(y), n[x])
                good = y[likely(estimate(np.broadcast_to(s[x], (len(y), BUCKETS)), s[y], m, n[y]), m, n[y], percent)]
                found += [(min(node[x], v), max(node[x], v)) for v in node[good].tolist()]
        a, b = (np.array([x[k] for x in found], np.int64) for k in (0, 1))
        return pa.table({"a": a, "b": b})

    return run


def _meet(percent: int):
    """Links between the strays and the members of one pair of blocks of a home, as many as join their components."""

    def run(rows: pa.Table) -> pa.Table:
        stray, node, comp = rows.column("stray").to_numpy(zero_copy_only=False), rows.column("node").to_numpy(), rows.column("component").to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in rows.column("hashes").to_pylist()]
        size = np.array([len(x) for x in sets])
        left, right = np.flatnonzero(stray), np.flatnonzero(~stray)
        both = np.zeros((len(left), len(right)), np.float32)
        names, cell, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(sets)), size)
        shared = times[cell] > 1
        rank = np.cumsum(times > 1) - 1
        cell, owner = rank[cell[shared]], owner[shared]
        for at in range(0, int(rank[-1]) + 1 if len(rank) else 0, 8192):
            here = (cell >= at) & (cell < at + 8192)
            table = np.zeros((len(sets), 8192), np.float32)
            table[owner[here], cell[here] - at] = 1
            both += table[left] @ table[right].T
        linked = 100 * both >= percent * (size[left][:, None] + size[right][None, :] - both)
        root = {int(c): int(c) for c in comp}

        def top(c: int) -> int:
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        found = []
        for i, j in zip(*np.nonzero(linked), strict=True):
            x, y = left[i], right[j]
            u, v = top(int(comp[x])), top(int(comp[y]))
            if u != v:
                root[max(u, v)] = min(u, v)
                found.append((int(min(node[x], node[y])), int(max(node[x], node[y]))))
        a, b = (np.array([x[k] for x in found], np.int64) for k in (0, 1))
        return pa.table({"a": a, "b": b})

    return run


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """`docs` (doc_id, text): returns doc_id, n_shingles and component_id, one row for each row of `docs`."""
    texts = exact(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = staged(texts.mapInArrow(_features(k, False), "doc_id long, n long, set1 long, set2 long, sketch binary"), "sketches")

    # Classes of equal sets: most have one document, whose node is its own id. One shuffle of the sketches at any size.
    some = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    by = rows.where(some).groupBy("set1", "set2", "n").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies"), F.first("sketch").alias("sketch"))
    nodes = staged(by, "nodes")
    name = F.concat_ws(" ", "set1", "set2", "n")
    classes = nodes.where("copies > 1").select(name.alias("name"), "node")
    named = rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(some, name).alias("name"))
    members = staged(skew_join(named, classes, "name", "left").select("doc_id", "n_shingles", F.coalesce("node", "doc_id").alias("node")), "members")
    nodes = nodes.select("node", "n", "sketch")
    # A doc_id that is repeated with other texts ties their classes.
    twice = members.where("n_shingles > 0").groupBy("doc_id").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("doc_id")
    tied = staged(members.where("n_shingles > 0").join(twice, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("node").alias("b")).distinct(), "tied")

    bands = nodes.select("node", "sketch").mapInArrow(_bands, "node long, band long")
    sizes = staged(bands.groupBy("band").agg(F.count("*").alias("size")).where("size > 1"), "bands")
    hot = [r[0] for r in sizes.where(F.col("size") * HOT_SHARE > max(100_000, BANDS * nodes.count())).select("band").take(HOT_SHARE)]
    shared = staged(skew_join(bands, sizes, "band", "inner", hot), "shared")
    busy = staged(shared.groupBy("node").agg(F.sum("size").alias("busy")), "busy")
    ranked = shared.join(busy, "node").select("band", "node", F.struct("busy", (-F.col("node")).alias("low")).alias("rank"))
    pivots = staged(ranked.groupBy("band").agg(F.max_by("node", "rank").alias("pivot"), F.max("rank").alias("rank")), "pivots")
    met = staged(skew_join(shared.select("band", "node"), pivots, "band", "inner", hot), "met")
    homes = staged(met.groupBy("node").agg(F.max_by("pivot", "rank").alias("home")), "homes")
    ordered = (F.least("pivot", "node").alias("a"), F.greatest("pivot", "node").alias("b"))
    star = staged(met.where("node <> pivot").select(*ordered).distinct(), "pairs")
    links = staged(_confirmed(star, texts, k, percent), "links")

    # Nodes that were not linked to their home, and all nodes of that home.
    def labelled(found: DataFrame) -> DataFrame:
        return staged(skew_join(homes, connected_components(found), "node", "left").withColumn("component", F.coalesce("component", "node")), "labelled")

    known = labelled(links)
    # A node that is a pivot and has another home may lead a home that it is not of itself.
    of_home = homes.select("home").distinct().join(known.select(F.col("node").alias("home"), F.col("component").alias("main")), "home", "left").select("home", F.coalesce("main", "home").alias("main"))
    flagged = skew_join(known, of_home, "home", "inner").withColumn("stray", F.col("component") != F.col("main")).drop("main")
    groups = flagged.groupBy("home").agg(F.count("*").alias("many"), F.sum(F.col("stray").cast("long")).alias("strays"), F.min("component").alias("low"), F.max("component").alias("high"), F.max(F.col("node") == F.col("home")).alias("led"))
    # Two that have only each other were compared, but for two whose home is neither of them.
    groups = groups.where("(many > 2 OR many = 2 AND NOT led) AND strays > 0 AND low < high")
    open_ = staged(skew_join(flagged, groups.select("home", "many", "strays"), "home", "inner"), "open")
    if open_.take(1):
        sets = staged(with_ids(texts, open_.select(F.col("node").alias("doc_id")).distinct(), "doc_id").mapInArrow(_features(k, True), "node long, n long, sketch binary, hashes binary").drop("sketch", "n"), "sets")
        rows, columns = F.ceil(F.col("strays") / BLOCK).cast("int"), F.ceil(F.col("many") / BLOCK).cast("int")
        full = open_.join(sets, "node")
        i, j = F.pmod(F.xxhash64("node"), rows).cast("int"), F.pmod(F.xxhash64("node"), columns).cast("int")
        one = full.where("stray").select("home", "node", "component", "hashes", F.lit(True).alias("stray"), i.alias("i"), F.explode(F.sequence(F.lit(0), columns - 1)).alias("j"))
        two = full.select("home", "node", "component", "hashes", F.lit(False).alias("stray"), F.explode(F.sequence(F.lit(0), rows - 1)).alias("i"), j.alias("j"))
        links = links.union(staged(one.union(two).groupBy("home", "i", "j").applyInArrow(_meet(percent), "a long, b long"), "links"))
        known = labelled(links)

    # Bands whose nodes are still in several components: pairs of different homes, that is, not compared so far.
    spread = skew_join(shared, known, "node", "inner")
    mixed = spread.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min("home").alias("first"), F.max("home").alias("last"))
    mixed = mixed.where("low < high AND first < last").select("band")
    open_ = staged(spread.join(mixed, "band", "left_semi"), "open")
    small = open_.where(F.col("size") <= BLOCK)
    x, y = (small.select("band", F.col("node").alias(c), F.col("component").alias(f"c{c}"), F.col("home").alias(f"h{c}")) for c in ("a", "b"))
    pairs = x.join(y, (x["band"] == y["band"]) & (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & (F.col("ha") != F.col("hb"))).select("a", "b")
    large = open_.where(F.col("size") > BLOCK)
    if large.take(1):
        n_blocks = F.ceil(F.col("size") / BLOCK).cast("int")
        dealt = large.join(with_ids(nodes, large.select("node").distinct(), "node"), "node").select("band", "node", "n", "sketch", "component", "home", n_blocks.alias("blocks")).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("*", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
        pairs = pairs.union(dealt.groupBy("band", "i", "j").applyInArrow(_across(percent), "a long, b long"))
    rest = staged(pairs.distinct().join(star, ["a", "b"], "left_anti"), "pairs")
    if rest.take(1):
        links = links.union(staged(_confirmed(rest, texts, k, percent), "links"))
        known = labelled(links)
    labels = connected_components(links.union(tied)) if tied.take(1) else known.select("node", "component")
    final = skew_join(members, labels, "node", "left")
    return final.select("doc_id", "n_shingles", F.coalesce("component", "node").alias("component_id"))


def deduplicate(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Keeps one document of each component, the one with the smallest doc_id, with all columns.

    Rows without doc_id all stay. Rows that repeat a doc_id with another text are documents of their own: one text keeps the
    id, the others stand under a number made from id and text. Of rows that repeat both, one stays.
    """
    columns = docs.columns
    plain = docs.toDF(*(c if c in ("doc_id", "text") else f"own{i}" for i, c in enumerate(columns)))
    text = F.xxhash64(F.coalesce("text", F.lit("")))
    again = plain.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(text).alias("first"), F.count("*").alias("copies")).where("copies > 1").select("doc_id", "first")
    again = staged(again, "again")
    n = again.limit(BROADCAST_IDS + 1).count()
    if not n:
        kept = near_duplicates(plain, k, percent).where("doc_id = component_id").select("doc_id")
        return plain.where("doc_id IS NOT NULL").join(kept, "doc_id", "left_semi").unionByName(plain.where("doc_id IS NULL")).select(*plain.columns).toDF(*columns)
    number = F.when(F.col("first") != text, F.xxhash64("doc_id", text, F.lit("again"))).otherwise(F.col("doc_id").cast("long"))
    known = plain.join(F.broadcast(again) if n <= BROADCAST_IDS else again, "doc_id", "left").withColumn("number", number)
    found = near_duplicates(known.select(F.col("number").alias("doc_id"), "text"), k, percent)
    kept = found.where("doc_id = component_id").select(F.col("doc_id").alias("number")).distinct()
    mine = known.where("doc_id IS NOT NULL").join(kept, "number", "left_semi")
    single, many = mine.where("first IS NULL"), mine.where("first IS NOT NULL").dropDuplicates(["number"])
    return single.unionByName(many).unionByName(known.where("doc_id IS NULL")).select(*plain.columns).toDF(*columns)
