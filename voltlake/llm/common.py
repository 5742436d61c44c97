"""Helpers shared by the operators: tables of an input folder, written intermediate tables, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of an input folder; any path Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``. Only a session in one process (``local[n]``)
    may go without; it gets a temporary folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="llm-shared-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: Where the tables of :func:`stored` lie.
_PLACES: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


#: With this setting Spark deletes the shuffle files of a query when it ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(frame: DataFrame, name: str) -> DataFrame:
    """``frame`` written to the shared folder and read back: the lineage ends there, so a lost executor
    costs no more than the tasks that read it, and the shuffle files of the write are deleted with its end.
    Tables that no later result reads are given to :func:`free`."""
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        frame.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    back = spark.read.schema(frame.schema).parquet(path)
    _PLACES[back] = path
    return back


def free(*tables: DataFrame) -> None:
    """Delete written tables (as :func:`stored` gave them) once all that reads them is written itself."""
    for frame in tables:
        path = _PLACES.pop(frame, None)
        if path:
            place = frame.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(frame.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def collect_garbage(spark: SparkSession) -> None:
    """Let the driver collect its garbage and give memory back.

    A loop of queries leaves hundreds of plans. By itself the driver's heap grows to its bound before they go, and with
    them the broadcasts that only they hold; one collection takes some tenths of a second.
    """
    spark._jvm.System.gc()


def clean_text(text: str = "text") -> Column:
    """A text column in which null is the empty text."""
    return F.coalesce(F.col(text), F.lit(""))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once; in a lambda an expression would be computed for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def components(edges: DataFrame, name: str = "components", max_rounds: int = 60) -> DataFrame:
    """Smallest reachable node for each node of ``edges`` (u, v): columns node, component.

    Alternating large and small stars: each round links every node's larger (then smaller) neighbours to
    its smallest one. Both are an aggregate with map-side combine and a join on the node, which AQE
    splits where one node has a large share of the edges. Rounds end when the edges no longer change;
    each is written, so the plan stays flat, and then the one before is deleted. Self-loops, repeated and null edges are ignored; nodes
    without another node do not appear in the result. The plans of the rounds are garbage of the driver, which goes at the end.
    """
    edges, mark = _marked(_ordered(edges), name)
    for _ in range(max_rounds):
        before, last = edges, mark
        edges, mark = _marked(_small_star(_large_star(edges)), name)
        free(before)
        if mark == last:
            collect_garbage(edges.sparkSession)
            nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
            roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return nodes.unionByName(roots)
    raise RuntimeError("connected components did not settle")


def component_sizes(found: DataFrame) -> DataFrame:
    """``found`` (node, component) with the size of each component."""
    sizes = found.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    return stored(found.join(sizes, "component"), "component-sizes")


#: Members of several sets up to which :func:`rarest_buckets` broadcasts their counts. There are about as many as rows of
#: text: a bound that tables of some size pass and larger ones do not makes the disk grow faster than the input there.
MEMBERS = 100_000


def rarest_buckets(sets: DataFrame, similarity: float) -> DataFrame:
    """Buckets (key, id, n, rest) of ``sets`` (id, members: array of distinct longs): a set is in the bucket of each of
    its rarest members, as many as two sets of this Jaccard likeness cannot both avoid.

    Two such sets share one of the n - ceil(similarity * n) + 1 first members of each, in any common order;
    with the rarest first, the shared ones are few. Members of one set only come first and need no bucket.
    n is the set's size and rest how many of its members come at this one or later: two sets whose first
    common member this is have no more in common than the smaller rest. Ids that ascend with the rows of ``sets`` take
    less of the shuffle, whose rows are an id and a member each. A written table.
    """
    each = sets.select("id", F.explode("members").alias("key"))
    frequency = stored(each.groupBy("key").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "set-members")
    order = each.join(small_side(frequency, MEMBERS), "key").groupBy("id").agg(
        F.sort_array(F.collect_list(F.struct("df", "key"))).alias("order"),
    )
    shared = order.join(sets.select("id", F.size("members").alias("n")), "id")
    alone = F.col("n") - F.size("order")
    places = F.col("n") - F.ceil(F.lit(similarity) * F.col("n")).cast("int") + 1 - alone
    buckets = stored(shared.where(places > 0).select(
        "id", "n", F.size("order").alias("shared"), F.posexplode(F.slice("order", F.lit(1), places)).alias("place", "one"),
    ).select("one.key", "id", "n", (F.col("shared") - F.col("place")).alias("rest")), "set-buckets")
    free(frequency)
    return buckets


#: Words of 64 bits in a set's parity.
PARITY_WORDS = 4


def parity(members: Column) -> list[Column]:
    """Words p0, p1, ... of a bitmap of a set of hashes (distinct longs), in which each member flips one bit.

    Two sets differ in at least as many members as their bitmaps differ in bits.
    """
    def word(number: int) -> Column:
        def flip(bits: Column, h: Column) -> Column:
            bit = F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63).cast("long")).cast("int"))
            own = F.shiftrightunsigned(h, 6).bitwiseAND(F.lit(PARITY_WORDS - 1).cast("long")) == number
            return F.when(own, bits.bitwiseXOR(bit)).otherwise(bits)

        return F.aggregate(members, F.lit(0).cast("long"), flip).alias(f"p{number}")

    return [word(number) for number in range(PARITY_WORDS)]


def parities(sets: DataFrame, words: int) -> DataFrame:
    """id and the ``words`` (a power of two) words of the bitmap that :func:`parity` describes, of ``sets`` (id, members).

    For large sets, whose bitmaps take more words: generated code, combined in the task that has the set.
    """
    each = sets.select("id", F.explode("members").alias("h")).select(
        "id", F.shiftrightunsigned("h", 6).bitwiseAND(F.lit(words - 1).cast("long")).alias("word"),
        F.call_function("shiftleft", F.lit(1).cast("long"), F.col("h").bitwiseAND(F.lit(63).cast("long")).cast("int")).alias("bit"),
    )
    none = F.lit(0).cast("long")
    return each.groupBy("id").agg(*[
        F.bit_xor(F.when(F.col("word") == number, F.col("bit")).otherwise(none)).alias(f"p{number}") for number in range(words)
    ])


def _may_be_alike(words: list[str], a: str, b: str, total: Column, similarity: float) -> Column:
    """Whether the bitmaps with names led by ``a`` and ``b`` differ in few enough bits for sets of ``total`` members together."""
    apart = sum((F.bit_count(F.col(f"{a}{word}").bitwiseXOR(F.col(f"{b}{word}"))) for word in words), F.lit(0))
    return apart * (1 + similarity) <= total * (1 - similarity) + 1e-6


def _mixed(buckets: DataFrame, known: DataFrame) -> DataFrame:
    """The entries of buckets of several components, with their component and the bucket's largest one (main)."""
    marked = buckets.join(known.withColumnRenamed("node", "id"), "id", "left").select(
        "key", "id", "n", "rest", F.coalesce("component", "id").alias("component"), F.coalesce("size", F.lit(1)).alias("size"),
    )
    order = F.shiftleft(F.col("size").cast("long"), 20).bitwiseOR(F.xxhash64("component").bitwiseAND(F.lit((1 << 20) - 1)))
    mixed = marked.groupBy("key").agg(
        F.max_by("component", order).alias("main"), F.min("component").alias("lo"), F.max("component").alias("hi"),
    ).where("lo < hi").select("key", "main")
    return marked.join(mixed, "key")


def bucket_candidates(
    buckets: DataFrame, known: DataFrame | None, similarity: float, parities: DataFrame | None = None,
) -> DataFrame:
    """Pairs (a, b) to verify in each bucket (key, id, n, rest), without all pairs of a bucket.

    First (``known`` is None) every id meets the least one of its bucket. Then, with the components of
    what that verified, ids of different components meet; the bucket's largest component is not compared
    with itself, and a bucket of one component not at all. ``parities`` (id and the words of :func:`parity` for every
    id, where n is the size of the same set) drop pairs that differ in too many members to be alike, and no other.
    """
    words = [] if parities is None else [c for c in parities.columns if c != "id"]
    if known is None:
        least = buckets.groupBy("key").agg(F.min(F.struct("id", "n", "rest")).alias("one")).select(
            "key", F.col("one.id").alias("b"), F.col("one.n").alias("nb"), F.col("one.rest").alias("rb"))
        enough = F.least("rest", "rb") * (1 + similarity) >= (F.col("n") + F.col("nb")) * similarity - 1e-6
        pairs = buckets.join(least, "key").where("id != b").where(enough)
        if not words:
            return pairs.select(F.col("id").alias("a"), "b").distinct()
        one = pairs.select("id", "b", (F.col("n") + F.col("nb")).alias("total")).distinct().join(parities, "id")
        two = parities.select(F.col("id").alias("b"), *[F.col(word).alias(f"y{word}") for word in words])
        return one.join(two, "b").where(_may_be_alike(words, "", "y", F.col("total"), similarity)).select(F.col("id").alias("a"), "b")
    marked = _mixed(buckets, known)
    if words:
        marked = marked.join(parities, "id")
    odd = marked.where("component != main").select(
        "key", "main", F.col("id").alias("x"), F.col("component").alias("cx"), F.col("n").alias("nx"), F.col("rest").alias("rx"),
        *[F.col(word).alias(f"x{word}") for word in words],
    )
    other = marked.select(
        "key", F.col("id").alias("y"), F.col("component").alias("cy"), F.col("n").alias("ny"), F.col("rest").alias("ry"),
        *[F.col(word).alias(f"y{word}") for word in words],
    )
    # of two sets this alike, the smaller rest at their first common member holds the common part
    enough = F.least("rx", "ry") * (1 + similarity) >= (F.col("nx") + F.col("ny")) * similarity - 1e-6
    if words:
        enough &= _may_be_alike(words, "x", "y", F.col("nx") + F.col("ny"), similarity)
    pairs = odd.join(other, "key").where("cx != cy and (cy = main or x < y)").where(enough)
    return pairs.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


#: Ids of a bucket that meet each other in one draw of :func:`drawn_candidates`, on average.
DRAWN = 4


def drawn_candidates(buckets: DataFrame, known: DataFrame, similarity: float, parities: DataFrame) -> DataFrame:
    """Pairs (a, b) to verify between the two steps of :func:`bucket_candidates`, some for each entry of a bucket.

    The ids of a bucket of several components are dealt by their hashes into groups of about ``DRAWN``, and those of other
    components meet in their group. That joins nearly all of a large group of alike ids, whose links would else all
    come up, with the square of its size, when ids of different components meet. What it misses is left to that step.
    """
    marked = _mixed(buckets, known)
    entries = marked.groupBy("key").agg(F.count(F.lit(1)).alias("entries"))
    deal = F.pmod(F.xxhash64("id", "key"), F.ceil(F.col("entries") / DRAWN)).alias("deal")
    words = [c for c in parities.columns if c != "id"]
    dealt = marked.join(entries, "key").select("key", deal, "id", "n", "rest", "component").join(parities, "id")
    other = dealt.select("key", "deal", *[F.col(c).alias(f"y{c}") for c in ("id", "n", "rest", "component", *words)])
    enough = F.least("rest", "yrest") * (1 + similarity) >= (F.col("n") + F.col("yn")) * similarity - 1e-6
    enough &= _may_be_alike(words, "", "y", F.col("n") + F.col("yn"), similarity)
    pairs = dealt.join(other, ["key", "deal"]).where("id > yid and component != ycomponent").where(enough)
    return pairs.select(F.col("id").alias("a"), F.col("yid").alias("b")).distinct()


def _ordered(edges: DataFrame) -> DataFrame:
    """Each link once, as (larger, smaller)."""
    return (
        edges.where(F.col("u") != F.col("v"))
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )


def _marked(edges: DataFrame, name: str) -> tuple[DataFrame, dict]:
    """``edges`` written, and their number and sum of hashes, taken while they are written."""
    mark = Observation()
    table = stored(edges.observe(
        mark, F.count(F.lit(1)).alias("edges"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("hashes"),
    ), name)
    return table, mark.get


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    larger = edges.select(F.col("v").alias("u"), F.col("u").alias("w"))
    return _ordered(larger.join(least, "u").select(F.col("w").alias("u"), F.col("m").alias("v")))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    linked = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _ordered(linked.unionByName(least.select("u", F.col("m").alias("v"))))


#: Rows up to which a side of a join is broadcast by request (some tens of megabytes at most); more rows shuffle.
BROADCAST_ROWS = 1_000_000


def small_side(frame: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``frame``, with a broadcast hint if it has been counted to have ``most`` rows or less.

    Meant for written tables of a few fixed-width columns, where counting reads no more than file footers.
    """
    return F.broadcast(frame) if frame.count() <= most else frame
