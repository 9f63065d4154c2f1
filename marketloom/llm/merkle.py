"""Document fingerprints as Merkle trees over sections and paragraphs, with DataFrame functions only.

A text is cut after every line feed, sentence end and clause mark into paragraph pieces, which together are the text. A
piece that is still long is cut again where its own characters say so, and at last at a fixed length, so every piece is bounded. A
section ends at a blank line or after a piece whose hash says so, so an edit moves no boundary beyond its own section. A
section's node hashes its pieces' hashes, the root hashes the section nodes, all with SHA-256.

The fingerprint is ``root:section=piece piece.../section=...`` with the first 128 bits of the root and the first 32 bits of
every other node. Equal roots mean equal texts; where roots differ, the differing sections and their differing
pieces locate the edit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import columns_of, parallelism
from .quality import once

CUT = r"(?<=[\n ])(?<=\n|[.,;:!?|] )"  # the first test fails fast at nearly every place
LOWEST = -(1 << 63)
LONG = 128  # code points of a piece at most
RANGES = 4  # of ids, a task
WINDOW, APART = 8, 32  # code points whose hash decides on a cut, and the mean distance of two cuts


def bounded(piece: Column) -> Column:
    """The piece, or its parts of at most LONG code points.

    A cut comes before each window of WINDOW code points whose hash has its lowest bits zero, one in APART, so an edit moves only the
    cuts beside it. Between far cuts, as in a run of one character, parts of LONG are counted off.
    """

    def parts(chars: Column) -> Column:
        marked = lambda i: F.xxhash64(*[F.get(chars, i + j) for j in range(WINDOW)]).bitwiseAND(APART - 1) == 0
        inner = F.filter(F.sequence(F.lit(1), F.size(chars) - WINDOW), marked)
        ends = F.concat(F.array(F.lit(0)), inner, F.array(F.size(chars)))
        upto = lambda e: F.flatten(F.transform(F.slice(e, 1, F.size(e) - 1), lambda a, k: F.sequence(a, F.get(e, k + 1) - 1, F.lit(LONG))))
        cut = lambda b: F.transform(b, lambda a, k: F.array_join(F.slice(chars, a + 1, F.coalesce(F.get(b, k + 1), F.size(chars)) - a), ""))
        return once(once(ends, upto), cut)

    return F.when(F.length(piece) > LONG, once(F.split(piece, ""), parts)).otherwise(F.array(piece))


def leaf(part: Column) -> Column:
    """SHA-256 of a part, then '/' where it ends a section, '.' elsewhere: blank lines do, and one part in eight, by its last digit."""
    return once(F.sha2(part, 256), lambda h: F.concat(h, F.when((part == "\n") | F.endswith(h, F.lit("0")) | F.endswith(h, F.lit("1")), "/").otherwise(".")))


def leaves(pieces: Column) -> Column:
    """Of each piece, the leaves of its bounded parts, joined."""
    return F.transform(pieces, lambda p: F.when(F.length(p) > LONG, F.array_join(F.transform(bounded(p), leaf), "")).otherwise(leaf(p)))


def grown(leaves: Column) -> Column:
    """The tree over the leaves of a text: struct(root, parts), as of ``tree``."""

    def build(sections: Column) -> Column:
        short = lambda s: F.array_join(F.transform(F.split(s, r"\."), lambda h: F.substring(h, 1, 8)), " ")
        return once(F.transform(sections, lambda s: F.sha2(s, 256)), lambda full: F.struct(
            F.substring(F.sha2(F.array_join(full, "."), 256), 1, 32).alias("root"),
            F.transform(sections, lambda s, i: F.concat(F.substring(F.get(full, i), 1, 8), F.lit("="), short(s))).alias("parts"),
        ))

    return once(once(F.array_join(leaves, ""), lambda c: F.split(F.substring(c, F.lit(1), F.length(c) - 1), "/")), build)


def tree(text: Column) -> Column:
    """struct(root, parts): 128 bits of the root; of each section ``node=piece piece ...``."""
    return grown(leaves(F.split(text, CUT)))


def spliced(head: Column, head_leaves: Column, tail: Column, tail_leaves: Column) -> Column:
    """Leaves of the text ``head + tail``, from those of a text that begins with ``head`` and of one that begins with ``tail``.

    A cut depends on the two code points before it, so cuts within the head stay, and those of the tail from its first one
    on. Only the pieces at the seam and at the end are hashed anew.
    """

    def build(p: Column, q: Column) -> Column:
        seam = F.split(F.concat(F.element_at(p, -1), F.element_at(q, 1)), CUT)
        # The first cut of the tail also ends the seam, and the empty piece behind it is dropped.
        longer = F.concat(leaves(once(seam, lambda x: F.slice(x, 1, F.size(x) - 1))), F.slice(tail_leaves, F.lit(2), F.greatest(F.size(q) - 2, F.lit(0))), leaves(F.slice(q, -1, 1)))
        return F.concat(F.slice(head_leaves, F.lit(1), F.size(p) - 1), F.when(F.size(q) > 1, longer).otherwise(leaves(seam)))

    return once(F.split(head, CUT), lambda p: once(F.split(tail, CUT), lambda q: build(p, q)))


def fingerprint(t: Column) -> Column:
    return F.concat(t["root"], F.lit(":"), F.array_join(t["parts"], "/"))


def members(parts: Column) -> Column:
    """All nodes below the root, distinct."""
    return F.array_distinct(F.split(F.replace(F.array_join(parts, " "), F.lit("="), F.lit(" ")), " "))


def likeness(a: Column, b: Column) -> Column:
    """Shared nodes of two trees: twice the common ones over the sum of both, 1 for equal roots only."""
    share = once(members(a["parts"]), lambda x: once(members(b["parts"]), lambda y: 2.0 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y))))
    return F.when(a["root"] == b["root"], F.lit(1.0)).otherwise(F.least(share, F.lit(0.999)))


def differing(a: Column, b: Column) -> Column:
    """The parts of ``b`` that ``a`` lacks, with their place: array of struct(section, pieces that are new)."""
    new = F.filter(F.transform(b["parts"], lambda p, i: F.struct(i.alias("section"), p.alias("part"))), lambda p: ~F.array_contains(a["parts"], p["part"]))
    have = members(a["parts"])
    return F.transform(new, lambda p: F.struct(p["section"].alias("section"), F.array_except(F.split(F.substring_index(p["part"], "=", -1), " "), have).alias("pieces")))


def with_next(docs: DataFrame) -> DataFrame:
    """Adds ``own``, the leaves and the tree of each text, with the text and the ``own`` of the next document in descending id order.

    After the last document comes the first. Documents are dealt to ranges of ids of even size, RANGES a task, by one exchange
    of the texts. Each range also gets the first document of the range after it, so no window crosses a range, and a window holds one range's
    trees. Null ids come last, and documents with one id follow in the order of their texts' hashes. Only one bound and one
    first id per range reach the driver.
    """
    spark, tasks = docs.sparkSession, parallelism(docs.sparkSession)
    n = RANGES * tasks
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("doc_id", F.lit(LOWEST)).alias("key"))
    cuts = rows.agg(F.percentile_approx("key", [i / n for i in range(1, n)] or [0.5], 10 * n).alias("c")).first().c or []
    cuts = sorted(set(cuts))
    place = F.lit(0) if not cuts else F.expr("aggregate(array(" + ",".join(f"{c}L" if c != LOWEST else "(-9223372036854775807L - 1L)" for c in cuts) + "), 0, (a, c) -> a + int(key > c))")
    ranged = rows.withColumn("range", place)
    tops = {r["range"]: r.top for r in ranged.groupBy("range").agg(F.max("key").alias("top")).collect()}
    used = sorted(tops)
    own = once(leaves(F.split("text", CUT)), lambda x: F.struct(x.alias("leaves"), grown(x).alias("tree"))).alias("own")
    if not used:
        return rows.select("doc_id", "text", own, F.col("text").alias("next_text"), own.alias("next"))
    # The first of each range also ends the range above it; the first of all ends the lowest one.
    follows = {tops[r]: used[(i + 1) % len(used)] for i, r in enumerate(used)}
    to = F.create_map(*[F.lit(x) for pair in follows.items() for x in pair])
    extra = ranged.where(F.col("key").isin(list(follows))).select("doc_id", "text", "key", to[F.col("key")].alias("range"), F.lit(1).alias("guest"))
    both = ranged.select("doc_id", "text", "key", "range", F.lit(0).alias("guest")).unionByName(extra)
    order = [F.col("guest"), F.col("key").desc(), F.col("tie")]
    # Sorted before the trees are made, so that only texts are sorted.
    dealt = both.repartitionByRange(tasks, "range").withColumn("tie", F.xxhash64("text")).sortWithinPartitions("range", *order).withColumn("own", own)
    w = Window.partitionBy("range").orderBy(*order)
    return dealt.withColumns({"next_text": F.lead("text").over(w), "next": F.lead("own").over(w)}).where("guest = 0").select("doc_id", "text", "own", "next_text", "next")


def compared(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every document and of its edited text, with their likeness.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many, or all, of the next
    document in descending id order. A null text is empty; an empty text is one empty piece. Repeated rows are
    compared each; a lone document is its own next one. An empty table gives none.
    """
    rows = with_next(columns_of(docs, doc_id=id_col, text=text_col))
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumns({"head": F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - half), "tail": F.substring(F.col("next_text"), F.lit(1), half)})
    edited = grown(spliced(F.col("head"), F.col("own.leaves"), F.col("tail"), F.col("next.leaves")))
    out = once(edited, lambda e: F.struct(
        fingerprint(F.col("own.tree")).alias("fingerprint"), fingerprint(e).alias("edited_fingerprint"),
        likeness(F.col("own.tree"), e).alias("near_edited"), likeness(F.col("own.tree"), F.col("next.tree")).alias("near_next"),
    ))
    return rows.select("doc_id", "n_chars", F.sha2(F.concat("head", "tail"), 256).alias("edited_sha256"), out.alias("o")).select("doc_id", "n_chars", "edited_sha256", "o.*")
