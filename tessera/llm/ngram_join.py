"""Similarity self-join of documents by the Jaccard index of their word n-grams, by a MinHash LSH forest with exact verification.

Shingles are runs of five words (``SEPARATORS`` end a word; case counts); a text of one to four words is one shingle. Texts that are
equal are one node with a number of copies. A forest has TREES prefix tries; a tree's signature is a string of MinHash values, two
bytes each. The signatures of all trees are sorted once, and the longest prefix that each shares with a neighbour in this order is
kept: sorted strings with these lengths are the tries.

Nodes are neighbours in a trie if their signatures begin with the same values. The shortest prefix that may be matched is the longest
that meets the target recall even for pairs at the threshold itself. Equal ones of these form buckets, and buckets that share nodes form
families (connected components); texts of families alone are read again. A family larger than a block is dealt as pairs of blocks, or
its buckets are if that moves fewer rows, a pair then belonging to its first common tree.

In a block prefixes begin longer, at the longest that misses a pair at the threshold with a chance below 1 - floor. Pairs that share
one in some tree are compared by their exact sets of shingles. A link of similarity s is known to be found with a chance p(s) at this
length, so a node with links has about sum(1 / p(s)) of them; while the mean share found is below the target recall, or nothing was
found, prefixes are shortened by one value and the pairs that this adds are compared. Where texts are very alike, few comparisons are
needed; near the threshold, or without any link, all are made. Blocks return, for each node, the number of its links and the smallest
node that it is linked to through the block: never the pairs.

Edge cases: texts without a word (null, empty) have no shingles, link to nothing and are each their own class, even where equal;
repeated rows are copies; a null id takes part, but a class is named by its smallest id, null if it has none; rows of one id with
different texts are different nodes, and two classes may bear one name; an empty table gives no rows; further columns are ignored by
``similarity_join`` and kept by ``deduplicate``. Shingles are compared as 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SEPARATORS, bounded_batches, flat, materialize, unused, word_hashes
from tessera.llm.components import connected_components

WORDS = 5
THRESHOLD = 0.8
TREES, DEPTH = 16, 8
#: The share of links to find, as estimated on the data; and the least chance of a link at the threshold.
RECALL, FLOOR = 0.999, 0.99
#: Nodes of one side of a block.
BLOCK = 256
#: Most texts whose rows meet their class by broadcast, not by shuffle.
POPULAR = 4096
#: Nodes of small families that one call verifies, on average.
PACK = 64

_RANDOM = np.random.default_rng(20)
_MULTIPLIERS = _RANDOM.integers(1 << 62, (1 << 64) - 1, TREES * DEPTH, dtype=np.uint64) | np.uint64(1)
_ADDENDS = _RANDOM.integers(0, (1 << 64) - 1, TREES * DEPTH, dtype=np.uint64)
_ROLL = _RANDOM.integers(1 << 62, (1 << 64) - 1, 16, dtype=np.uint64) | np.uint64(1)


def chance(similarity, depth: int, trees: int = TREES):
    """That two texts of this similarity share a prefix of so many values in some tree."""
    return 1 - (1 - np.asarray(similarity, dtype=float) ** depth) ** trees


def levels(threshold: float = THRESHOLD, recall: float = RECALL, floor: float = FLOOR) -> list[int]:
    """Lengths to match in turn: from the longest that the floor allows to the longest that meets the recall at the threshold itself."""
    first, last = (max((d for d in range(1, DEPTH + 1) if chance(threshold, d) >= least), default=1) for least in (floor, max(floor, recall)))
    return list(range(first, last - 1, -1))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shingles(words: np.ndarray, bounds: np.ndarray, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of so many words, row by row, and the rows' bounds."""
    words, n = words.astype(np.int64, copy=False).view(np.uint64), np.diff(bounds)
    if ((n > 0) & (n < size)).any():  # these are filled up with nothing
        wide = np.where(n > 0, np.maximum(n, size), 0)
        start = np.concatenate([[0], np.cumsum(wide)])
        filled = np.zeros(start[-1], dtype=np.uint64)
        filled[np.arange(len(words)) + np.repeat(start[:-1] - bounds[:-1], n)] = words
        words, bounds, n = filled, start, wide
    if not len(words):
        return words, bounds
    runs = np.zeros(len(words) - size + 1, dtype=np.uint64)
    for k in range(size):
        runs += words[k : k + len(runs)] * _ROLL[k]
    own = np.ones(len(words), dtype=bool)
    ends = bounds[1:][n > 0]
    for k in range(1, size):
        own[ends - k] = False
    return _mix(runs[own[: len(runs)]]), np.concatenate([[0], np.cumsum(np.maximum(n - size + 1, 0))])


def minhash(hashes: np.ndarray, bounds: np.ndarray, depth: int) -> np.ndarray:
    """For each row with shingles its signatures: 16 bits of each value, big-endian, so that bytes sort as values do."""
    starts = bounds[:-1][np.diff(bounds) > 0]
    values = np.empty((len(starts), TREES, depth), dtype=">u2")
    for tree in range(TREES):
        for k in range(depth):
            own = tree * DEPTH + k
            least = np.minimum.reduceat(hashes * _MULTIPLIERS[own] + _ADDENDS[own], starts)
            values[:, tree, k] = _mix(least) >> np.uint64(48)
    return values


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, pa.int64()))


def _text_key():
    return F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))


def signatures(docs: DataFrame, depth: int) -> DataFrame:
    """doc_id, text_key (SHA-256 of the text) and the signatures of all trees in one string, null for a text without a word."""
    bounded_batches(docs.sparkSession)
    rows = docs.select("doc_id", _text_key().alias("text_key"), word_hashes(F.col("text")).alias("words"))

    def signed(batches):
        for b in batches:
            hashes, bounds = shingles(*flat(b.column("words")))
            own = iter(minhash(hashes, bounds, depth)) if len(hashes) else iter(())
            strings = [next(own).tobytes() if n else None for n in np.diff(bounds)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), pa.array(strings, pa.binary())], ["doc_id", "text_key", "signature"])

    return rows.mapInArrow(signed, f"doc_id {dict(docs.dtypes)['doc_id']}, text_key binary, signature binary")


def forest(nodes: DataFrame, depth: int, last: int) -> DataFrame:
    """node, tree, own (its signature there) and shared: how many values of it a neighbour in sorted order begins with too.

    Ranges of sorted signatures are cut anywhere, so a long run of like ones is many tasks' work. The ends of a range count as
    shared in full, for their neighbours are in other tasks; their buckets are looked up like others. What shares less than the
    shortest prefix can meet nothing and is left out.
    """
    own = F.explode(F.array(*(F.struct(F.lit(t).cast("short").alias("tree"), F.substring("signature", 1 + 2 * depth * t, 2 * depth).alias("own")) for t in range(TREES))))
    rows = nodes.select("node", own.alias("t")).select("node", "t.*")

    def compared(batches):
        held = before = None

        def lengths(rows: list, following) -> pa.RecordBatch:
            nonlocal before
            node, tree, sig = (list(x) for x in zip(*rows))
            chain = [*([before] if before else []), *zip(tree, sig), *([following] if following else [])]
            bits = np.frombuffer(b"".join(t.to_bytes(2, "big") + s for t, s in chain), dtype=">u2").reshape(len(chain), depth + 1)
            same = np.cumprod(bits[1:] == bits[:-1], axis=1).sum(axis=1) - 1  # the first of them is the tree
            with_previous = same[: len(rows)] if before else np.concatenate([[depth], same[: len(rows) - 1]])
            with_next = np.concatenate([with_previous[1:], [same[-1] if following else depth]])
            shared, before = np.maximum(with_previous, with_next), (tree[-1], sig[-1])
            kept = np.flatnonzero(shared >= last)
            columns = [pa.array([node[k] for k in kept], pa.int64()), pa.array([tree[k] for k in kept], pa.int16()), pa.array([sig[k] for k in kept], pa.binary()), pa.array(shared[kept], pa.int32())]
            return pa.RecordBatch.from_arrays(columns, ["node", "tree", "own", "shared"])

        for b in batches:
            rows = list(zip(b.column("node").to_pylist(), b.column("tree").to_pylist(), b.column("own").to_pylist()))
            if not rows:
                continue
            if held:
                yield lengths(held, rows[0][1:])
            held = rows
        if held:
            yield lengths(held, None)

    ordered = rows.repartitionByRange("tree", "own", "node").sortWithinPartitions("tree", "own")  # by node too, for many may be equal
    return ordered.mapInArrow(compared, "node long, tree short, own binary, shared int")


def _shingle_sets(members: DataFrame) -> DataFrame:
    """members: node, copies, signature, text. Gives the distinct shingles of each, sorted, in place of the text."""

    def sets(batches):
        for b in batches:
            hashes, bounds = shingles(*flat(b.column("words")))
            own = [np.unique(hashes[s:e].view(np.int64)) for s, e in zip(bounds, bounds[1:])]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in own])])
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("copies"), b.column("signature"), _lists(np.concatenate([*own, np.empty(0, np.int64)]), ends)], ["node", "copies", "signature", "shingles"])

    rows = members.select("node", "copies", "signature", word_hashes(F.col("text")).alias("words"))
    return rows.mapInArrow(sets, "node long, copies long, signature binary, shingles array<bigint>")


def _common(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of these pairs of sorted sets."""
    if len(i) <= 2 * len(sets):
        out = np.empty(len(i), dtype=np.int64)
        for k, (a, b) in enumerate(zip(i, j)):
            small, large = sorted((sets[a], sets[b]), key=len)
            at = np.searchsorted(large, small)
            out[k] = np.count_nonzero(large[np.minimum(at, len(large) - 1)] == small)
        return out
    # A row a set and a column a shingle that two sets have, some columns at a time.
    ids = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    some = ids[2] > 1
    column, here = np.cumsum(some) - 1, some[ids[1]]
    rows, column = rows[here], column[ids[1][here]]
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    total, step = np.zeros((len(sets), len(sets)), dtype=np.float32), 4096
    for start in range(0, int(some.sum()), step):
        at = slice(*np.searchsorted(column, [start, start + step]))
        part = np.zeros((len(sets), step), dtype=np.float32)
        part[rows[at], column[at] - start] = 1
        total += part @ part.T
    return total[i, j].astype(np.int64)


def _prefixes(values: np.ndarray, depth: int) -> np.ndarray:
    """A number for each row's prefix of so many values in each tree."""
    key = np.zeros(values.shape[:2], dtype=np.uint64)
    for k in range(depth):
        key = key * np.uint64(0xD6E8FEB86659FD93) + values[:, :, k] + np.uint64(1)
    return key


def _links(nodes, copies, values, sets, tree: int, sides, left: int, right: int, threshold: float, recall: float, depths: list[int]):
    """Of each node in a block its links, weighted by copies, the smallest node that it hangs together with there; and the level reached."""
    size = np.array([len(s) for s in sets])
    keys = _prefixes(values, depths[-1])
    same = keys[:, None, :] == keys[None, :, :]
    pairs = same.any(axis=2) if tree < 0 else same[:, :, tree] & (same.argmax(axis=2) == tree)
    pairs = np.triu(pairs, 1) if left == right else pairs & (sides[:, None] == left) & (sides[None, :] == right)
    pairs &= np.minimum(size[:, None], size[None, :]) >= threshold * np.maximum(size[:, None], size[None, :])
    count, low, links = np.zeros(len(nodes), dtype=np.int64), np.arange(len(nodes)), []
    for depth in depths:
        keys = _prefixes(values, depth)
        now = pairs & (keys[:, None, :] == keys[None, :, :]).any(axis=2)
        pairs &= ~now
        i, j = np.nonzero(now)
        if len(i):
            common = _common(sets, i, j)
            like = common / (size[i] + size[j] - common)
            near = like >= threshold
            links.append((i[near], j[near], like[near]))
        if not pairs.any():
            break
        i, j, like = (np.concatenate(x) for x in zip(*links)) if links else (np.empty(0, np.int64),) * 3
        found, expected = np.zeros(len(nodes)), np.zeros(len(nodes))
        for a, b in ((i, j), (j, i)):
            np.add.at(found, a, copies[b])
            np.add.at(expected, a, copies[b] / chance(like, depth))
        if len(i) and np.mean(found[found > 0] / expected[found > 0]) >= recall:
            break
    for i, j, _ in links:
        np.add.at(count, i, copies[j])
        np.add.at(count, j, copies[i])
    changed = bool(links)
    while changed:
        was = low.copy()
        for i, j, _ in links:
            np.minimum.at(low, i, low[j])
            np.minimum.at(low, j, low[i])
        changed = (low != was).any()
    return count, nodes[low], depth


def _verify(placed: DataFrame, threshold: float, recall: float, depths: list[int]) -> DataFrame:
    """node, links, hub: for each block and each node with a link in it."""

    def block(t: pa.Table) -> pa.Table:
        column = lambda name: t.column(name).to_numpy()
        gid, node, copies, side = column("gid"), column("node"), column("copies"), column("side")
        tree, left, right = column("tree"), column("left"), column("right")
        values = np.frombuffer(b"".join(t.column("signature").to_pylist()), dtype=">u2").astype(np.uint64).reshape(t.num_rows, TREES, -1)
        hashes, bounds = flat(t.column("shingles"))
        out = [np.empty((0, 3), np.int64)]
        order = np.argsort(gid, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(gid[order])) + 1):
            nodes, first = np.unique(node[rows], return_index=True)
            rows = rows[first]
            if len(rows) > 1:
                sets = [hashes[bounds[r] : bounds[r + 1]] for r in rows]
                k = rows[0]
                count, hub, _ = _links(nodes, copies[rows], values[rows], sets, tree[k], side[rows], left[k], right[k], threshold, recall, depths)
                out.append(np.column_stack([nodes, count, hub])[count > 0])
        found = np.vstack(out)
        return pa.table({"node": found[:, 0], "links": found[:, 1], "hub": found[:, 2]})

    return placed.groupBy("pack", "tree", "left", "right").applyInArrow(block, "node long, links long, hub long")


def _placed(buckets: DataFrame, families: DataFrame) -> DataFrame:
    """node, gid, tree, n: a group whose pairs are to be compared, with its size: the family (tree -1), or each bucket of it."""
    own = materialize(buckets.join(families, "node").select("node", "key", "tree", "n", F.col("root").alias("family")), "families")
    cost = lambda n: n * F.ceil(n / BLOCK)
    by_bucket = own.groupBy("family", "key").agg(F.max("n").alias("n")).groupBy("family").agg(F.sum(cost(F.col("n"))).alias("by_bucket"))
    by_family = families.groupBy(F.col("root").alias("family")).agg(F.count("*").alias("n"))
    chosen = by_bucket.join(by_family, "family").withColumn("whole", cost(F.col("n")) <= F.col("by_bucket")).select("family", "n", "whole")
    chosen = materialize(chosen, "family-sizes")
    whole = families.withColumnRenamed("root", "family").join(chosen.where("whole"), "family").select("node", F.col("family").alias("gid"), F.lit(-1).alias("tree"), "n")
    parts = own.join(chosen.where("NOT whole").select("family"), "family")
    return whole.unionByName(parts.select("node", F.col("key").alias("gid"), "tree", "n"))


def _buckets(tries: DataFrame, depth: int) -> DataFrame:
    """node, key, tree, n and hub (the smallest node) of prefixes of so many values that several nodes share."""
    rows = tries.select("node", F.col("tree").cast("int").alias("tree"), F.xxhash64("tree", F.substring("own", 1, 2 * depth)).alias("key"))
    crowded = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("hub")).where("n > 1")
    return materialize(rows.join(materialize(crowded, "crowded"), "key"), "buckets")


def _found(docs: DataFrame, nodes: DataFrame, tries: DataFrame, threshold: float, recall: float, depths: list[int], repeats: bool) -> DataFrame:
    """node, links and hub, as blocks give them. repeats: rows may be equal in id and text."""
    buckets = _buckets(tries, depths[-1])
    # A node is tied to the smallest of its hubs (TREES at most), and the others to that one: hubs are few, whatever nodes share them.
    hubs = buckets.groupBy("node").agg(F.collect_set("hub").alias("hubs")).select("node", "hubs", F.array_min("hubs").alias("low"))
    families = connected_components(hubs.select(F.explode(F.array_union(F.array("node"), "hubs")).alias("a"), F.col("low").alias("b")).distinct())
    # The texts of candidates only; each text once, from the row of its smallest id.
    wanted = families.select("node").join(nodes, "node")
    own = docs.select("doc_id", "text", _text_key().alias("text_key_"))
    if repeats:  # each task keeps one of them before texts move
        own = own.groupBy("doc_id", "text_key_").agg(F.first("text").alias("text"))
    texts = own.join(wanted, own["doc_id"].eqNullSafe(wanted["rep"]) & (own["text_key_"] == wanted["text_key"]))
    sets = materialize(_shingle_sets(texts), "shingle-sets")
    placed = _placed(buckets, families)
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.lit(1)).cast("int")
    placed = placed.withColumn("blocks", blocks).withColumn("side", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    packs = max(1, sets.count() // PACK)
    other = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = other.select(
        "node", "gid", "tree", "side", F.least("side", "other").alias("left"), F.greatest("side", "other").alias("right"),
        F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("gid"), F.lit(packs))).otherwise(F.col("gid")).alias("pack"),
    ).join(sets, "node")
    return materialize(_verify(dealt, threshold, recall, depths), "links")


def _each_row(rows: DataFrame, of: DataFrame, total: int) -> DataFrame:
    """rows with what is known of their texts. A text that more than one row in POPULAR has would be a hot key; fewer than POPULAR
    texts can be so, and these are broadcast."""
    often = F.col("n_copies") > max(1, total // POPULAR)
    popular = F.broadcast(of.where(often))
    others = rows.join(popular.select("text_key"), "text_key", "left_anti")
    return rows.join(popular, "text_key").unionByName(others.join(of.where(~often), "text_key"))


def _classes(docs: DataFrame, threshold: float, recall: float, floor: float) -> DataFrame:
    """doc_id, text_key, class_id, rep and rep_key (smallest id and the text of it in the class), n_copies, n_links of each row."""
    bounded_batches(docs.sparkSession)
    depths = levels(threshold, recall, floor)
    signed = materialize(signatures(docs, depths[0]), "signatures")
    worded = signed.where("signature IS NOT NULL")
    nodes = worded.groupBy("text_key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("signature").alias("signature"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    tries = materialize(forest(nodes, depths[0], depths[-1]), "forest")
    repeats = not signed.groupBy("doc_id", "text_key").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    found = _found(docs, nodes, tries, threshold, recall, depths, repeats)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = connected_components(found.select(F.col("node").alias("a"), F.col("hub").alias("b")))
    named = materialize(roots.join(nodes.select("node", "rep", "text_key"), "node"), "roots")
    # Of a class the smallest id; nulls, which name nothing, come last.
    names = named.groupBy("root").agg(F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "text_key")).alias("of"))
    names = materialize(names.select("root", F.col("of.rep").alias("class_rep"), F.col("of.text_key").alias("class_key")), "class-names")
    classes = named.join(names, "root").select("node", "class_rep", "class_key").join(links, "node")
    of = nodes.select("node", "text_key", "rep", "copies").join(classes, "node", "left")
    linked = F.col("links").isNotNull()
    of = of.select(
        "text_key", F.when(linked, F.col("class_rep")).otherwise(F.col("rep")).alias("class_id"), F.when(linked, F.col("class_key")).otherwise(F.col("text_key")).alias("rep_key"),
        F.col("copies").alias("n_copies"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    )
    joined = _each_row(worded.select("doc_id", "text_key"), materialize(of, "classes"), signed.count())
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    alone = signed.where("signature IS NULL").select("text_key", "doc_id", F.col("doc_id").alias("class_id"), F.col("text_key").alias("rep_key"), one.alias("n_copies"), none.alias("n_links"))
    return joined.unionByName(alone)


def similarity_join(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, floor: float = FLOOR) -> DataFrame:
    """A row for each row of docs: doc_id, class_id (the smallest id that it hangs together with by links), n_copies (rows with
    exactly its text, itself included) and n_links (other rows whose Jaccard index with it is at least the threshold, copies included)."""
    return _classes(docs, threshold, recall, floor).select("doc_id", "class_id", "n_copies", "n_links")


def deduplicate(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, floor: float = FLOOR) -> DataFrame:
    """docs with one row of each class: of the rows with its smallest id and that id's text, the first by a hash of all columns.

    Rows without a word are no copies of anything, and all stay.
    """
    of = _classes(docs, threshold, recall, floor)
    # doc_id and text name the row that stays: (1, A) and (1, B) are two nodes, and either may be in any class.
    first = of.where(F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("text_key") == F.col("rep_key")))
    row, all_columns, place, empty = unused(docs.columns, "row", "all", "place", "wordless")
    first = materialize(first.select(F.struct("doc_id", "text_key").alias(row)).distinct(), "stay")
    wordless = ~F.coalesce(docs["text"].rlike(f"[^{SEPARATORS}]"), F.lit(False))
    own = docs.select(F.struct("doc_id", _text_key().alias("text_key")).alias(row), F.struct(*(docs[c] for c in docs.columns)).alias(all_columns), F.xxhash64(*docs.columns).alias(place), wordless.alias(empty))
    # Equal rows are reduced where they are read, so those that a third of the table repeats do not meet in a task.
    worded = own.where(~F.col(empty)).join(first, row, "left_semi").groupBy(row).agg(F.min_by(all_columns, place).alias(all_columns))
    return worded.select(f"{all_columns}.*").unionByName(docs.where(wordless))
