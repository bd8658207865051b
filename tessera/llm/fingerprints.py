"""Document fingerprints: a Merkle tree over sections, paragraphs and their sentences.

The leaves are sentences (pieces of a line that end in . ! ? or the line's end), a paragraph is a line, and a section is a run of
paragraphs that ends at a blank line or at a paragraph whose own hash ends in zero bits, so that an insertion moves no later border.
A node's hash is the SHA-256 of its children's; the fingerprint is the root. Equal roots mean equal texts; where roots differ, sections
that both trees have are paired and set aside, as often as both have them, then paragraphs of the other sections, then sentences of
the other paragraphs: only branches that differ are opened. What is left over locates the edit. Likeness is the share of leaves and
root that both trees have (size of the intersection over size of the union, with repeats), so it is 1 for equal texts only.

All of it is DataFrame functions. Neighbours in the order of ids meet by one shuffle of the texts into ranges of ids: the first text
of each range is handed to the range before it, so no task sees more than its range.

Edge cases: a null text is the empty text, which has one empty leaf; equal texts have equal fingerprints, repeated rows included;
rows of one id are ordered by the text's hash; null ids come last; the only row of a table is its own next; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import let, materialize, range_cuts, rank_among

#: A paragraph whose hash begins so ends its section: one in 16.
BORDER = "0"


def sentences(paragraph: Column) -> Column:
    return F.split(paragraph, "(?<=[.!?]) ")


def _hash(parts: Column) -> Column:
    return F.sha2(F.array_join(parts, ","), 256)


def merkle_tree(text: Column) -> Column:
    """A struct: root, n_leaves, and sections: hash, i (place), below (paragraphs: hash, i, below (sentences: hash, i))."""

    def tree(paragraphs: Column) -> Column:
        """paragraphs: array of struct(hash, below, blank)."""
        n = F.size(paragraphs)
        ends = F.filter(
            F.transform(paragraphs, lambda p, i: F.when((i == n - 1) | p.blank | p.hash.startswith(BORDER), i + 1)),
            lambda x: x.isNotNull(),
        )
        placed = lambda first, end: F.transform(F.slice(paragraphs, first + 1, end - first), lambda p, k: F.struct(p.hash.alias("hash"), (first + k).alias("i"), p.below.alias("below")))

        def sections(e: Column) -> Column:
            def section(end: Column, k: Column) -> Column:
                own = placed(F.when(k == 0, 0).otherwise(F.get(e, k - 1)), end)
                return let(own, lambda below: F.struct(_hash(F.transform(below, lambda p: p.hash)).alias("hash"), k.alias("i"), below.alias("below")))

            return F.transform(e, section)

        return let(
            let(ends, sections),
            lambda s: F.struct(
                _hash(F.transform(s, lambda x: x.hash)).alias("root"),
                F.aggregate(paragraphs, F.lit(0), lambda a, p: a + F.size(p.below)).alias("n_leaves"),
                s.alias("sections"),
            ),
        )

    def paragraph(line: Column) -> Column:
        own = F.transform(sentences(line), lambda x, i: F.struct(F.sha2(x, 256).alias("hash"), i.alias("i")))
        return let(own, lambda leaves: F.struct(_hash(F.transform(leaves, lambda x: x.hash)).alias("hash"), leaves.alias("below"), (F.trim(line) == "").alias("blank")))

    return let(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), paragraph), tree)


def unpaired(a: Column, b: Column) -> Column:
    """Of two arrays of nodes (hash, i, ...) a struct a, b: what is left of each when equal hashes are paired, as often as both have
    them, first places first. Sorting brings equal ones together: n log n for any arrays."""

    def runs(s: Column, side: int) -> Column:
        """Of a sorted array: hash, side, at (index of the first), n."""
        starts = F.filter(F.transform(s, lambda x, k: F.when((k == 0) | (x.hash != F.get(s, k - 1).hash), k)), lambda x: x.isNotNull())
        run = lambda st: F.transform(st, lambda at, k: F.struct(F.get(s, at).hash.alias("hash"), F.lit(side).alias("side"), at.alias("at"), (F.coalesce(F.get(st, k + 1), F.size(s)) - at).alias("n")))
        return let(starts, run)

    def rest(v: Column) -> Column:
        def of(merged: Column) -> Column:
            def left(side: int, own: Column, step: int) -> Column:
                def surplus(x: Column, k: Column) -> Column:
                    other = F.get(merged, k + step)
                    paired = F.when(other.hash == x.hash, F.least(x.n, other.n)).otherwise(0)
                    return F.slice(own, x.at + F.coalesce(paired, F.lit(0)) + 1, F.when(x.side == side, x.n - F.coalesce(paired, F.lit(0))).otherwise(0))

                return F.flatten(F.transform(merged, surplus))

            return F.struct(left(0, v.a, 1).alias("a"), left(1, v.b, -1).alias("b"))

        return let(F.array_sort(F.concat(runs(v.a, 0), runs(v.b, 1))), of)

    return let(F.struct(F.array_sort(a).alias("a"), F.array_sort(b).alias("b")), rest)


def difference(a: Column, b: Column) -> Column:
    """Of two trees a struct: likeness; edited, the places of a's paragraphs that b lacks; and opened, how many sections were."""
    below = lambda nodes: F.flatten(F.transform(nodes, lambda x: x.below))

    def paragraphs(s: Column) -> Column:
        def leaves(p: Column) -> Column:
            def compared(x: Column) -> Column:
                both = a.n_leaves - F.size(x.a)
                return F.struct(
                    (both / (a.n_leaves + b.n_leaves - both + 1)).alias("likeness"), F.array_sort(F.transform(p.a, lambda y: y.i)).alias("edited"), F.size(s.a).alias("opened")
                )

            return let(unpaired(below(p.a), below(p.b)), compared)

        return let(unpaired(below(s.a), below(s.b)), leaves)

    same = F.struct(F.lit(1.0).alias("likeness"), F.array().cast("array<int>").alias("edited"), F.lit(0).alias("opened"))
    return F.when(a.root == b.root, same).otherwise(let(unpaired(a.sections, b.sections), paragraphs))


def likeness(a: Column, b: Column) -> Column:
    return difference(a, b).likeness


def edited_paragraphs(a: Column, b: Column) -> Column:
    """Places of a's paragraphs that b lacks. Empty where the roots are equal."""
    return difference(a, b).edited


def with_next(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """doc_id, text and next_text: the text of the next row by descending id, and of the first for the last.

    Ids are cut at approximate quantiles into ranges of about as many rows. A range's last row takes its neighbour from a copy of
    the next range's first row, one a range, which sorts behind it.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    cuts = range_cuts(rows, "doc_id", ranges or 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    place = F.when(F.col("doc_id").isNull(), -1).otherwise(rank_among(cuts, F.col("doc_id")))
    rows = rows.withColumn("range_", place)
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), F.col("text")]
    # A row a range: its first id, then the text that comes first among rows of that id.
    first = materialize(rows.groupBy("range_").agg(F.max("doc_id").alias("doc_id")), "range-heads")
    own = F.broadcast(first.select(F.col("range_").alias("r"), F.col("doc_id").alias("d")))  # a row a range, so of bounded size
    at_head = rows.join(own, (F.col("range_") == F.col("r")) & F.col("doc_id").eqNullSafe(F.col("d"))).drop("r", "d")
    heads = at_head.groupBy("range_").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    before = first.select("range_", F.lead("range_").over(Window.orderBy("range_")).alias("to"), F.min("range_").over(Window.partitionBy()).alias("low"))
    # The range above gets this range's head; the lowest range gets that of the highest.
    links = F.broadcast(before.select("range_", F.coalesce("to", "low").alias("to")))
    handed = heads.join(links, "range_").select(F.lit(None).cast(dict(rows.dtypes)["doc_id"]).alias("doc_id"), "text", F.col("to").alias("range_"), F.lit(True).alias("handed"))
    window = Window.partitionBy("range_").orderBy("handed", *order)
    both = rows.withColumn("handed", F.lit(False)).unionByName(handed)
    return both.withColumn("next_text", F.lead("text").over(window)).where("NOT handed").select("doc_id", "text", "next_text")


def edited(text: Column, other: Column) -> Column:
    """text with its last half replaced by as much of the beginning of other."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(other, F.lit(1), half))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, its edited text's, the likeness to that and to the next document, and where the edit is: n_edited
    (paragraphs that the edited text lacks), first_edited (the place of the first) and n_opened (sections that were looked into)."""
    pairs = with_next(docs).withColumn("edited", edited(F.col("text"), F.col("next_text")))

    def compared(t: Column) -> Column:
        return let(
            F.struct(difference(t.own, t.edited).alias("e"), difference(t.own, t.next).likeness.alias("next")),
            lambda d: F.struct(
                t.own.root.alias("fingerprint"), t.edited.root.alias("edited_fingerprint"), d.e.likeness.alias("near_edited"), d.next.alias("near_next"),
                F.size(d.e.edited).alias("n_edited"), F.get(d.e.edited, F.lit(0)).alias("first_edited"), d.e.opened.alias("n_opened"),
            ),
        )

    of = F.struct(merkle_tree(F.col("text")).alias("own"), merkle_tree(F.col("edited")).alias("edited"), merkle_tree(F.col("next_text")).alias("next"))
    trees = pairs.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), let(of, compared).alias("t"))
    return trees.select("doc_id", "n_chars", "edited_sha256", "t.*")
