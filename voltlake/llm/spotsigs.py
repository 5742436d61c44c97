"""SpotSigs: signatures of the content words that follow common words.

Each occurrence of an anchor (a common word) with the next ``CHAIN`` content words after it, other common
words skipped, is one spot signature; so is the text's start. A text's fingerprint is its set of signature
hashes. Likeness is Jaccard. The self-join partitions the sets by size into ranges whose ends differ by the
threshold, so that only neighbouring ranges can hold similar sets, and compares sets that share one of
their rarest signatures. All of it is DataFrame expressions.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import (
    bound, bucket_candidates, clean_text, component_sizes, components, drawn_candidates, free, parity, rarest_buckets, small_side, stored,
)

CHAIN = 2
SIMILARITY = 0.8
BLOCK_ROWS = 1000
MAX_BLOCKS = 10_000

# Common words of English, German, French and Spanish that serve as anchors.
ANCHORS = (
    "a an and are as at be but by for from had has have he her his i in is it not of on or she that the their they "
    "this to was we were which will with you "
    "auch auf aus bei das dem den der des die ein eine einem einen einer er es für hat ich im ist mit nicht noch sich "
    "sie sind so um und von vor war wie wir zu zum zur "
    "au aux avec ce ces dans de du elle en est et il ils je la le les leur mais ne nous ou par pas plus pour qui que sa "
    "se ses son sont sur un une vous "
    "al como con del el ella es esta este ha las lo los más me mi muy no o para pero por sin sobre su sus una y ya"
).split()


def signatures(text: Column) -> Column:
    """Sorted distinct 32-bit hashes (as longs) of the spot signatures of ``text``; none for a text without a word.

    Words are runs of letters and digits in lower case. The words become one string in which a blank
    starts each content word and a mark each anchor, so that splitting at blanks leaves every content
    word with the anchors behind it. The chain of an anchor near the end is as short as the words left.
    """
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    joined = F.array_join(F.transform(words, lambda w: F.concat(F.when(w.isin(*ANCHORS), "\x01").otherwise(" "), w)), "")
    # the first group has no content word, only the start and anchors behind it
    groups = F.transform(F.split(F.concat(F.lit("\x01^"), joined), " "), lambda g: F.split(g, "\x01"))

    def spots(all_groups: Column) -> Column:
        def of_group(group: Column, i: Column) -> Column:
            chain = F.concat_ws(" ", *[F.get(F.get(all_groups, i + k), F.lit(0)) for k in range(1, CHAIN + 1)])
            return bound(chain, lambda c: F.transform(
                F.slice(group, 2, F.size(group)),
                lambda anchor: F.xxhash64(anchor, c).bitwiseAND(F.lit(0xFFFFFFFF).cast("long")),
            ))

        return F.flatten(F.transform(all_groups, of_group))

    hashes = F.array_sort(F.array_distinct(bound(groups, spots)))
    return F.when(F.rlike(text, F.lit(r"[\p{L}\p{N}]")), hashes).otherwise(F.array().cast("array<bigint>"))


def fingerprint(signature: Column) -> Column:
    """The set as text: eight hex digits a signature, in order."""
    return F.array_join(F.transform(signature, lambda h: F.lpad(F.lower(F.hex(h)), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard of two sets, 0 without counting where one is empty; two empty sets are alike (1)."""
    shared = F.size(F.array_intersect(a, b))
    return (
        F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0))
        .when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0))
        .otherwise(shared / (F.size(a) + F.size(b) - shared))
    )


def _block_of(key: Column, cuts: list) -> Column:
    """How many of the ascending ``cuts`` are at most ``key``, by bisection; null keys come first."""
    if not cuts:
        return F.lit(0)
    table = F.lit(cuts) if len(cuts) > 1 else F.array(F.lit(cuts[0]))
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(cuts).bit_length()))])

    def step(low: Column, size: Column) -> Column:
        fits = (low + size <= len(cuts)) & (F.get(table, low + size - 1) <= key)
        return F.when(fits, low + size).otherwise(low)

    return F.aggregate(steps, F.lit(0), step)


def with_next(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc, text, signature, next_text, next_signature), where next is the following row by ``key``, after the last the first.

    Quantiles of the key (at most MAX_BLOCKS cuts) deal the rows into blocks; the first row of each block
    also visits the block before, so one shuffle of the texts and a window within blocks suffice. Rows of
    one key follow each other by text; a null key comes first; null texts are empty.
    """
    rows = docs.select(F.col(key).alias("doc"), clean_text(text).alias("text"))
    blocks = max(1, min(MAX_BLOCKS, rows.count() // BLOCK_ROWS))
    cuts: list = []
    if blocks > 1:
        shares = [k / blocks for k in range(1, blocks)]
        cuts = sorted(set(rows.agg(F.percentile_approx("doc", shares, 20 * blocks)).first()[0] or []))
    placed = rows.withColumn("block", _block_of(F.col("doc"), cuts))
    starts = placed.groupBy("block").agg(F.min("doc").alias("start")).orderBy("block").collect()
    before = [(r["start"], starts[k - 1]["block"]) for k, r in enumerate(starts)]
    guests = docs.sparkSession.createDataFrame(before, f"start {docs.schema[key].dataType.simpleString()}, host int")
    own = F.struct(F.col("block").alias("block"), F.lit(False).alias("guest"))
    visit = F.struct(F.col("host").alias("block"), F.lit(True).alias("guest"))
    dealt = placed.join(F.broadcast(guests), F.col("doc").eqNullSafe(F.col("start")), "left").select(
        "doc", "text", F.explode(F.when(F.col("host").isNull(), F.array(own)).otherwise(F.array(own, visit))).alias("at"),
    ).select("doc", "text", "at.block", "at.guest")
    order = W.partitionBy("block").orderBy("guest", "doc", "text")
    signed = dealt.repartition("block").withColumn("signature", signatures(F.col("text")))
    return signed.select(
        "doc", "text", "signature", "guest", F.lead("text").over(order).alias("next_text"),
        F.lead("signature").over(order).alias("next_signature"),
    ).where("not guest").drop("guest")


def edited_report(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: ``key``, n_chars, the fingerprint of the text and of the edited text, and both likenesses.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all) of
    the next row's text.
    """
    rows = with_next(docs, text, key).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(
        F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next_text", F.lit(1), half),
    )
    rows = rows.withColumn("edited", edited).withColumn("edited_signature", signatures(F.col("edited")))
    return rows.select(
        F.col("doc").alias(key), "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("signature")).alias("fingerprint"), fingerprint(F.col("edited_signature")).alias("edited_fingerprint"),
        likeness(F.col("signature"), F.col("edited_signature")).alias("near_edited"),
        likeness(F.col("signature"), F.col("next_signature")).alias("near_next"),
        F.size("signature").alias("n_signatures"), F.xxhash64("signature").alias("set_id"),
    )


def full_report(docs: DataFrame, text: str = "text", key: str = "doc_id", similarity: float = SIMILARITY) -> DataFrame:
    """:func:`edited_report` with set_id and component_id of :func:`near_duplicates`.

    Only rows whose component has another key than their own are looked up, by (``key``, set_id), which spreads groups of
    equal texts over the tasks if they are too many to be broadcast; rows that agree in both have one component, so repeated
    rows, rows of one key with other texts and null keys each come back once.
    """
    near = near_duplicates(docs, text, key, similarity)
    moved = near.where(~F.col(key).eqNullSafe(F.col("component_id"))).groupBy(key, "set_id").agg(F.first("component_id").alias("component_id"))
    moved = stored(moved.withColumnsRenamed({key: "near_key", "set_id": "near_set", "component_id": "near_component"}), "spot-moved")
    free(near)
    report = edited_report(docs, text, key)
    same = F.col(key).eqNullSafe(F.col("near_key")) & (F.col("set_id") == F.col("near_set"))
    found = report.join(small_side(moved), same, "left")
    return found.select(*report.columns, F.coalesce("near_component", key).alias("component_id"))


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", similarity: float = SIMILARITY) -> DataFrame:
    """Per row: ``key``, set_id (equal sets share it) and component_id, the least ``key`` reachable over
    sets of at least this Jaccard likeness.

    Equal sets are one class. Classes are partitioned by set size: range r holds sizes from
    (1 / similarity) ** r on, and a set can only resemble sets of its own range and the next ones on
    either side. In each range, classes that share one of the rarest signatures (as many as a set of that
    likeness cannot avoid) are candidates; sizes prune, then Jaccard is exact. Every set pair of the
    likeness ends in one component. Between these steps a class goes by a number, which ascends with the rows.
    """
    signed = stored(docs.select(F.col(key).alias("doc"), signatures(clean_text(text)).alias("signature")).select(
        "doc", F.xxhash64("signature").alias("id"), "signature"), "spot-sets")
    classes = signed.groupBy("id").agg(F.min("doc").alias("least"), F.first("signature").alias("signature"))
    classes = stored(classes.withColumn("number", F.monotonically_increasing_id()), "spot-classes")
    rows = stored(signed.select("doc", "id"), "spot-rows")
    free(signed)
    sets = classes.where(F.size("signature") > 0).select(F.col("number").alias("id"), "signature")
    parities = stored(sets.select("id", *parity(F.col("signature"))), "spot-parities")
    sized = rarest_buckets(sets.select("id", F.col("signature").alias("members")), similarity)
    span = F.floor(F.log(F.col("n").cast("double")) / F.lit(-log(similarity)) + F.lit(1e-9)).cast("int")
    buckets = sized.select("id", "key", "n", "rest", F.explode(F.array(span, span + 1)).alias("span")).select(
        F.xxhash64("key", "span").alias("key"), "id", "n", "rest").distinct()
    buckets = stored(buckets, "spot-buckets")
    free(sized)
    edges = _compared(bucket_candidates(buckets, None, similarity), sets, similarity)
    found = components(edges, "spot-components")
    known = component_sizes(found)
    between = _compared(drawn_candidates(buckets, known, similarity, parities), sets, similarity)
    free(found, known)
    before = edges.unionByName(between)
    found = components(before, "spot-components")
    known = component_sizes(found)
    more = _compared(bucket_candidates(buckets, known, similarity, parities), sets, similarity)
    free(buckets, parities, found, known)
    linked = components(before.unionByName(more), "spot-components")
    rooted = classes.select("id", "number", "least").join(linked.withColumnRenamed("node", "number"), "number", "left").select(
        "id", "least", F.coalesce("component", "number").alias("component"))
    roots = rooted.groupBy("component").agg(F.min("least").alias("component_id"))
    named = rooted.join(roots, "component").select("id", "component_id")
    near = stored(rows.join(named, "id").select(F.col("doc").alias(key), F.col("id").alias("set_id"), "component_id"), "spot-near")
    free(rows, classes, edges, between, more)
    return near


def _compared(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Edges (u, v) of the pairs whose sizes allow the likeness and whose Jaccard has it. A written table."""
    pairs = stored(pairs, "spot-pairs")
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    ids = stored(ids, "spot-wanted")
    # the sets of no pair stay where they are
    wanted = sets.select("id", "signature").join(small_side(ids), "id", "left_semi")
    both = pairs.join(wanted.select(F.col("id").alias("a"), F.col("signature").alias("sa")), "a").join(
        wanted.select(F.col("id").alias("b"), F.col("signature").alias("sb")), "b")
    smaller, larger = F.least(F.size("sa"), F.size("sb")), F.greatest(F.size("sa"), F.size("sb"))
    alike = both.where((smaller >= F.lit(similarity) * larger) & (likeness(F.col("sa"), F.col("sb")) >= similarity))
    edges = stored(alike.select(F.col("a").alias("u"), F.col("b").alias("v")), "spot-edges")
    free(pairs, ids)
    return edges
