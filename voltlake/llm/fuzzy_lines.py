"""Near-duplicate lines: MinHash candidates, exact Jaccard verification, one line kept per component.

A line's shingles are all its windows of ``WIDTH`` characters, one at every position, lower-cased (a shorter
line is one shingle). Its signature is the bottom of their hashes. Among the ``LONG_BOTTOM`` smallest, ``LONG_RUN``
in a row make a band key; the ``STARTS`` of these whose first hash has the least lower half are taken, spread as they
are they fail apart from each other. A line of less than ``LONG`` shingles has a key of each ``RUN`` in a row of
its ``BOTTOM`` smallest instead, one of less than ``FEW`` of each two as well; lines up to ``LONG`` / 0.8, which may
resemble shorter ones, have both. Lines of Jaccard 0.8 share a key with a chance of 0.99 (by drawing pairs
at random), and lines that are not alike hardly ever share one of ``LONG_RUN`` hashes. Lines
that share a key are compared by the whole sets of their shingles. Everything is DataFrame expressions. Equal lines
are one line from the start: each distinct text is signed once and has a number; occurrences find theirs by two
64-bit hashes. Texts are not kept: those of lines that share a key are taken from the documents again. Tables of
a step are deleted once the next has been written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound, bucket_candidates, component_sizes, components, free, parities, small_side, stored

WIDTH = 5
BOTTOM = 20
RUN = 4
FEW = 16
LONG = 64
LONG_BOTTOM = 100
LONG_RUN = 6
STARTS = 22
#: Lines have some hundreds of shingles, of which pairs of one template differ in a fourth and more: too many for fewer bits.
PARITY_WORDS = 16
SIMILARITY = 0.8
MIN_CHARS = 4


def _shingles(line: str) -> Column:
    """Hashes of the windows at every character (four bytes each), each once."""
    def windows(chars: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.octet_length(chars) - (4 * WIDTH - 1), F.lit(1)), F.lit(4))
        return F.transform(starts, lambda i: F.xxhash64(F.substring(chars, i, F.lit(4 * WIDTH))))

    return F.array_distinct(bound(F.encode(F.lower(line), "UTF-32"), windows))


def _runs(least: Column, length: int) -> Column:
    """Keys of each ``length`` hashes in a row; of all hashes if there are fewer."""
    return F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(least) - length, F.lit(0))),
        lambda i: F.xxhash64(*[F.get(least, i + k) for k in range(length)]),
    )


def _spread_runs(least: Column) -> Column:
    """Keys of ``LONG_RUN`` hashes in a row, for the ``STARTS`` starts of the least lower halves."""
    starts = F.transform(
        F.slice(least, 1, F.greatest(F.size(least) - (LONG_RUN - 1), F.lit(1))),
        lambda h, i: F.shiftleft(h, 32).bitwiseOR(i.cast("long")),
    )
    return bound(least, lambda own: F.transform(F.slice(F.sort_array(starts), 1, STARTS), lambda start: bound(
        start.bitwiseAND(F.lit(0xFFFFFFFF).cast("long")).cast("int"),
        lambda i: F.xxhash64(*[F.get(own, i + k) for k in range(LONG_RUN)]),
    )))


def _signed(lines: DataFrame) -> DataFrame:
    """``lines`` with ``line`` replaced by keys, of runs among the smallest of its shingles' hashes."""
    # one step each outside of lambdas, where sets and sorting of longs are compiled
    shingled = lines.withColumn("own", _shingles("line")).drop("line")
    rest = [c for c in shingled.columns if c != "own"]
    sized = shingled.select(*rest, F.size("own").alias("n"), F.slice(F.sort_array("own"), 1, LONG_BOTTOM).alias("least"))
    few = bound(F.slice("least", 1, BOTTOM), lambda least: F.when(
        F.size(least) < FEW, F.array_union(_runs(least, RUN), _runs(least, 2)),
    ).otherwise(_runs(least, RUN)))
    none = F.array().cast("array<bigint>")
    keys = F.concat(
        F.when(F.col("n") * F.lit(SIMILARITY) <= LONG, few).otherwise(none),
        F.when(F.col("n") >= LONG, _spread_runs(F.col("least"))).otherwise(none),
    )
    return sized.select(*rest, "n", F.array_distinct(keys).alias("keys"))


def _row(text: str) -> Column:
    """Tells rows of one key apart."""
    return F.xxhash64(F.col(text))


def _occurrences(docs: DataFrame, text: str, key: str, min_chars: int) -> DataFrame:
    """doc, row, place (from 0), line of every line that is not blank and long enough to be compared."""
    return docs.select(F.col(key).alias("doc"), _row(text).alias("row"), F.posexplode(F.split(text, "\n"))).select(
        "doc", "row", F.col("pos").alias("place"), F.col("col").alias("line"),
    ).where((F.length(F.trim("line")) >= min_chars) & F.rlike("line", F.lit(r"[^\s\p{Z}]")))


def _hashes() -> list[Column]:
    return [F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("line"), "line").alias("h2")]


def _verified(pairs: DataFrame, lines: DataFrame, similarity: float) -> DataFrame:
    """Edges (u, v) of the pairs of ``lines`` (id, line) whose shingle sets have at least this Jaccard likeness."""
    one = pairs.join(lines.select(F.col("id").alias("a"), F.col("line").alias("la")), "a")
    both = one.join(lines.select(F.col("id").alias("b"), F.col("line").alias("lb")), "b")
    # the texts travel, not the sets, which are many times larger
    counted = both.select("a", "b", bound(_shingles("la"), lambda sa: bound(_shingles("lb"), lambda sb: F.struct(
        F.size(F.array_intersect(sa, sb)).alias("n"), (F.size(sa) + F.size(sb)).alias("total"),
    ))).alias("c"))
    return counted.where(F.col("c.n") >= F.lit(similarity) * (F.col("c.total") - F.col("c.n"))).select(
        F.col("a").alias("u"), F.col("b").alias("v"),
    )


def _texts(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """id and line of the ``wanted`` (id, h1, h2), from the occurrences ``lines``."""
    found = lines.select("line", *_hashes()).join(small_side(wanted), ["h1", "h2"])
    return found.groupBy("id").agg(F.first("line").alias("line"))


def _linked(signed: DataFrame, lines: DataFrame, similarity: float) -> DataFrame:
    """Components (node, component) of the numbers of the distinct lines ``signed`` (id, h1, h2, n, keys) that are near copies."""
    members = signed.select("id", "n", F.explode("keys").alias("key"))
    # the keys of a line are distinct, so a key that comes twice has two lines
    crowded = members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    keys = stored(crowded, "line-keys")
    buckets = stored(members.join(small_side(keys), "key").withColumn("rest", F.col("n")), "line-buckets")
    free(keys)
    wanted = stored(signed.select("id", "h1", "h2").join(small_side(buckets.select("id").distinct()), "id", "left_semi"), "line-wanted")
    texts = stored(_texts(lines, wanted), "line-texts")
    marks = stored(parities(texts.select("id", _shingles("line").alias("members")), PARITY_WORDS), "line-parities")
    free(wanted)

    def alike(known: DataFrame | None) -> DataFrame:
        pairs = stored(bucket_candidates(buckets, known, similarity, marks), "line-pairs")
        edges = stored(_verified(pairs, texts, similarity), "line-edges")
        free(pairs)
        return edges

    first = alike(None)
    found = components(first, "line-components")
    known = component_sizes(found)
    more = alike(known)
    free(buckets, found, known, texts, marks)
    linked = components(first.unionByName(more), "line-components")
    free(first, more)
    return linked


def repeated_lines(
    docs: DataFrame, text: str = "text", key: str = "doc_id", similarity: float = SIMILARITY, min_chars: int = MIN_CHARS,
) -> DataFrame:
    """Per row with lines to drop: doc, row (hash of its text), places (from 0, sorted).

    Of a group the line with the least (doc, row, place) stays. A written table.
    """
    lines = _occurrences(docs, text, key, min_chars)
    distinct = lines.groupBy("line").agg(F.count(F.lit(1)).alias("copies"))
    numbered = distinct.select(F.monotonically_increasing_id().alias("id"), *_hashes(), "copies", "line")
    signed = stored(_signed(numbered), "line-signatures")
    linked = _linked(signed, lines, similarity)
    groups = signed.drop("keys").join(linked, signed.id == linked.node, "left").where("copies > 1 or component is not null")
    groups = stored(groups.select("h1", "h2", F.coalesce("component", "id").alias("group")), "line-groups")
    free(signed, linked)
    grouped = lines.select("doc", "row", "place", *_hashes()).join(small_side(groups), ["h1", "h2"])
    grouped = stored(grouped.select("doc", "row", "place", "group"), "line-repeats")
    # the first key of each group, then its first row, then the place there: plain minima, combined before the shuffle
    rest = grouped
    for column in ("doc", "row", "place"):
        first = rest.groupBy("group").agg(F.min(column).alias("first"))
        rest = rest.join(first, "group").where(F.col(column) == F.col("first")).drop("first")
    kept = rest.select("group", F.col("doc").alias("kept_doc"), F.col("row").alias("kept_row"), F.col("place").alias("kept_place")).distinct()
    dropped = grouped.join(kept, "group").where("doc != kept_doc or row != kept_row or place != kept_place")
    drops = stored(dropped.groupBy("doc", "row").agg(F.sort_array(F.collect_set("place")).alias("places")), "line-drops")
    free(groups, grouped)
    return drops


def _kept(docs: DataFrame, text: str, key: str, similarity: float, min_chars: int) -> DataFrame:
    """doc (the row as it is), lines and the places that stay (kept)."""
    drops = repeated_lines(docs, text, key, similarity, min_chars).select(
        F.col("doc").alias("drop_doc"), F.col("row").alias("drop_row"), "places")
    rows = docs.select(F.struct("*").alias("doc"), F.col(key).alias("key"), _row(text).alias("row"))
    # the text is split behind the join, so that it travels once
    joined = rows.join(drops, (F.col("key") == F.col("drop_doc")) & (F.col("row") == F.col("drop_row")), "left")
    split = joined.select("doc", "places", F.split(F.coalesce(F.col("doc")[text], F.lit("")), "\n").alias("lines"))
    every = F.sequence(F.lit(0), F.size("lines") - 1)
    return split.select(
        "doc", "lines", F.when(F.col("places").isNull(), every).otherwise(F.array_except(every, "places")).alias("kept"),
    )


def _rejoined() -> Column:
    return bound(F.col("lines"), lambda lines: F.array_join(F.transform("kept", lambda i: F.get(lines, i)), "\n"))


def line_report(
    docs: DataFrame, text: str = "text", key: str = "doc_id", similarity: float = SIMILARITY, min_chars: int = MIN_CHARS,
) -> DataFrame:
    """Per row: ``key``, n_lines, n_dropped and dedup_text, the text of the lines that stay.

    Of all lines that a chain of near copies connects, across and within documents, the one with the
    least (``key``, place) stays. Blank lines and lines of fewer than ``min_chars`` characters are structure
    and always stay; with 1, every other line takes part. Null and empty texts are one empty line. Rows with the same key and text
    count as one document; a null key takes no part in comparisons across rows that it could lose. Rows that share a key only are separate.
    """
    rest = _kept(docs.select(key, text), text, key, similarity, min_chars)
    return rest.select(
        F.col("doc")[key].alias(key), F.size("lines").alias("n_lines"), (F.size("lines") - F.size("kept")).alias("n_dropped"),
        _rejoined().alias("dedup_text"),
    )


def deduplicate(
    docs: DataFrame, text: str = "text", key: str = "doc_id", similarity: float = SIMILARITY, min_chars: int = MIN_CHARS,
) -> DataFrame:
    """``docs`` without the dropped lines; a document may become empty but stays. n_chars, if there, is counted anew."""
    rest = _kept(docs, text, key, similarity, min_chars).select(
        "doc", F.when(F.col("doc")[text].isNotNull(), _rejoined()).alias("rejoined"))
    columns = {c: F.col("doc")[c] for c in docs.columns} | {text: F.col("rejoined")}
    if "n_chars" in columns and text != "n_chars":
        columns["n_chars"] = F.length("rejoined").cast(docs.schema["n_chars"].dataType)
    return rest.select(*[value.alias(c) for c, value in columns.items()])
