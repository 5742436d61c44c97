"""Secret scans with a ledger of content-addressed blobs.

Every version of a text is a blob named by its SHA-256. The ledger has a row for each (blob, rule set
version) scanned, with the spans found. A scan looks only at pairs the ledger lacks, each blob once however
many paths have it, and joins the ledger back to all paths. All matching is by DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound, clean_text, small_side, stored

# The kinds of each rule set version in their order, the pattern, the group that must be long, and how long.
RULES = {
    "base-1": [
        ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
        ("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
        ("hex", r"[0-9a-f]{16,}", 0, 16),
    ],
    "added-1": [
        ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
        ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 0, 1),
        ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
    ],
}
KINDS = [kind for rules in RULES.values() for kind, *_ in rules]
SPAN = "array<struct<start:int,rank:int,kind:string,end:int>>"


def _spans(kind: str, pattern: str, group: int, least: int) -> Column:
    """Spans of the leftmost non-overlapping matches in ``text``, in code points, end exclusive.

    The pieces between the matches and the matches alternate, so their lengths give the places. A fold copies what it
    has found with every match; so the n matches are folded in some sqrt(n) blocks of as many, each counted from its
    own begin, and the blocks are moved to their places then: n * sqrt(n) copies of a span at most.
    """
    regex = F.lit(pattern)
    whole, part = F.regexp_extract_all("text", regex, F.lit(0)), F.regexp_extract_all("text", regex, F.lit(group))
    pairs = F.zip_with(
        F.slice(F.split("text", pattern, -1), F.lit(1), F.size(whole)),
        F.arrays_zip(whole.alias("whole"), part.alias("part")),
        lambda gap, m: F.struct(F.length(gap).alias("gap"), F.length(m["whole"]).alias("n"), (F.length(m["part"]) >= least).alias("ok")),
    )
    none = F.array().cast(SPAN)

    def step(state: Column, m: Column) -> Column:
        begin = state["at"] + m["gap"]
        found = F.when(m["ok"], F.concat(state["found"], F.array(span(begin, begin + m["n"])).cast(SPAN))).otherwise(state["found"])
        return F.struct((begin + m["n"]).alias("at"), found.alias("found"))

    def span(begin: Column, end: Column) -> Column:
        return F.struct(begin.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"), end.alias("end"))

    def folded(part: Column) -> Column:
        return F.aggregate(part, F.struct(F.lit(0).alias("at"), none.alias("found")), step)

    def blocks(matches: Column) -> Column:
        width = F.greatest(F.ceil(F.sqrt(F.size(matches))), F.lit(1)).cast("int")
        last = F.greatest(F.ceil(F.size(matches) / width) - 1, F.lit(0)).cast("int")
        each = F.transform(F.sequence(F.lit(0), last), lambda i: folded(F.slice(matches, i * width + 1, width)))
        return bound(each, placed)

    def placed(parts: Column) -> Column:
        begins = F.aggregate(
            parts, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("begins")),
            lambda s, p: F.struct((s["at"] + p["at"]).alias("at"), F.concat(s["begins"], F.array(s["at"])).alias("begins")),
            lambda s: s["begins"],
        )
        moved = lambda p, by: F.transform(p["found"], lambda x: span(x["start"] + by, x["end"] + by))
        return F.flatten(F.zip_with(parts, begins, moved))

    return F.when(F.rlike("text", regex), bound(pairs, blocks)).otherwise(none)


def scan(blobs: DataFrame) -> DataFrame:
    """Ledger rows of ``blobs`` (blob, text, versions): one for each version, with all its spans in order."""
    found = [
        F.when(F.array_contains("versions", version), F.struct(
            F.lit(version).alias("version"),
            F.sort_array(F.concat(*[_spans(*rule) for rule in rules])).alias("spans"),
        ))
        for version, rules in RULES.items()
    ]
    rows = blobs.select("blob", F.explode(F.array(*found)).alias("row")).where("row is not null")
    return rows.select("blob", "row.version", "row.spans").dropDuplicates(["blob", "version"])


def empty_ledger(docs: DataFrame) -> DataFrame:
    return docs.sparkSession.createDataFrame([], f"blob string, version string, spans {SPAN}")


def update_ledger(versions: DataFrame, ledger: DataFrame, text: str = "text", path: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """The paths' blobs (path, blob), and the ledger with every (blob, rule version) pair of them.

    ``versions`` has a row for each version of each path; a null text is the empty text. One path of each
    unseen blob, the least, lends its text to the scan.
    """
    blob = F.sha2(clean_text(text).cast("binary"), 256)
    paths = stored(versions.select(F.col(path).alias("path"), blob.alias("blob")), "secret-paths")
    wanted = paths.groupBy("blob").agg(F.min("path").alias("path")).withColumn(
        "version", F.explode(F.array(*[F.lit(v) for v in RULES])),
    )
    unseen = wanted.join(ledger.select("blob", "version"), ["blob", "version"], "left_anti").groupBy("blob", "path").agg(
        F.sort_array(F.collect_set("version")).alias("versions"),
    )
    unseen = small_side(stored(unseen, "secret-unseen"), 300_000)
    unseen = unseen.withColumnRenamed("blob", "unseen_blob")
    texts = versions.select(F.col(path).alias("text_path"), clean_text(text).alias("text"))
    rows = texts.join(unseen, texts["text_path"].eqNullSafe(unseen["path"])).withColumn(
        "blob", F.sha2(F.col("text").cast("binary"), 256),
    ).where("blob = unseen_blob")
    added = stored(scan(rows.select("blob", "text", "versions")), "secret-ledger")
    return paths, ledger.unionByName(added)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def findings(versions: DataFrame, ledger: DataFrame | None = None, text: str = "text", path: str = "doc_id") -> DataFrame:
    """Per row of ``versions``: path, blob, base_spans and all_spans (by start, then kind in the order of RULES).

    Only blobs with spans are joined back, so a frequent clean blob is no hot key; AQE splits a frequent
    blob with spans.
    """
    paths, ledger = update_ledger(versions, empty_ledger(versions) if ledger is None else ledger, text, path)
    base = next(iter(RULES))
    found = ledger.where(F.size("spans") > 0).groupBy("blob").agg(
        F.sort_array(F.flatten(F.collect_list("spans"))).alias("all_spans"),
        F.sort_array(F.flatten(F.collect_list(F.when(F.col("version") == base, F.col("spans"))))).alias("base_spans"),
    )
    none = F.array().cast(SPAN)
    return paths.join(found, "blob", "left").select(
        "path", "blob", F.coalesce("base_spans", none).alias("base_spans"), F.coalesce("all_spans", none).alias("all_spans"),
    )


def report(docs: DataFrame, ledger: DataFrame | None = None, text: str = "text", path: str = "doc_id") -> DataFrame:
    """Per row: ``path``, counts of the base kinds, SHA-256 of the base spans, and all spans as text."""
    found = findings(docs, ledger, text, path)
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        F.col("path").alias(path), count("assign").alias("n_assign"), count("access").alias("n_access"),
        count("hex").alias("n_hex"), F.sha2(_joined(F.col("base_spans")), 256).alias("base_sha256"),
        _joined(F.col("all_spans")).alias("spans"),
    )
