"""Entropy balancing of sources to token targets, in DataFrame operations.

The rates r_d of the documents minimise the token-weighted relative entropy
sum(size_d * (r_d ln r_d - r_d + 1)) under the constraints sum of r_d * size_d over a source = its
target and r_d <= 2. The solution is exponentially tilted, r_d = min(2, exp(lambda_source)), and lambda
solves the convex dual. Each Newton step sums the gradient and the Hessian of the dual over the
documents' own terms, cap included; documents of equal source and size have equal terms and are counted
together first. Sources are disjoint, so the Hessian is diagonal. Steps end when every source is within
TOLERANCE of its target, or after NEWTON_STEPS.

Rounding into copies: every document gets floor(r) copies. The tokens still wanted are met by one more
copy of the documents in the order of a hash: sums by ranges of the hash find the range where a source's
want ends, which is divided again until it holds at most EDGE_ROWS rows. What lies before it is taken
whole; within it, documents are taken by falling size while they fit, and the smallest one left if that
comes nearer. So no source is gathered in one task, and only the last range of each is held in one row.

Rows equal in doc_id, text and source are numbered, so each is a unit of its own. Hashes do not depend on
how rows are dealt over partitions, so reruns agree. Sources are told apart one by one and their levels
found over all of them in one window: there may be many thousand, not millions.

Defined results: a null text has size 0; a null source is a source, last in order; targets of sources
without words are 0; empty input gives no rows; other columns are ignored (and kept by mix()).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, numbered, small, with_row

#: Fixed values of the mixture.
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST_COPIES = 2.0

NEWTON_STEPS, TOLERANCE = 60, 1e-9
#: Rows of the range in which documents are chosen one by one; bits of the hash, and of one division of a range.
EDGE_ROWS = 4096
HASH_BITS, RANGE_BITS = 60, 4
WORD = r"[^\x20\x09-\x0D]+"


def targets(sums: DataFrame) -> DataFrame:
    """source, tokens, target of each source: weighted shares of SHARE times all tokens, levelled below MOST_COPIES times its own."""
    everything = Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_source = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(by_source)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(rank - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    at = sums.withColumn("weight", weight).withColumn("cap", F.col("tokens") * MOST_COPIES)
    # Sources reach their cap in the order of cap / weight. With the first ones capped, the rest share what is left by weight.
    so_far = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = at.withColumns({"all_tokens": F.sum("tokens").over(everything), "caps": F.sum("cap").over(so_far) - F.col("cap"), "rest": F.sum("weight").over(everything) - F.sum("weight").over(so_far) + F.col("weight")})
    level = (F.col("all_tokens") * SHARE - F.col("caps")) / F.col("rest")
    # Capping a source that need not be lowers the level: the first source below its cap has the highest.
    at = at.withColumn("level", F.when(level * F.col("weight") <= F.col("cap"), level))
    at = at.withColumn("level", F.max("level").over(everything))
    return at.select("source", "tokens", F.when(F.col("tokens") > 0, F.least("cap", F.coalesce(F.col("level") * F.col("weight"), "cap"))).otherwise(F.lit(0.0)).alias("target"))


def balanced(cells: DataFrame, goals: DataFrame) -> DataFrame:
    """goals (source, tokens, target) with the rate of each source's documents; cells: source, size and n documents of that size."""
    goals = materialize(goals.withColumn("lam", F.lit(0.0)), "mix-goals")
    rate = F.least(F.lit(MOST_COPIES), F.exp("lam"))
    term = F.col("n") * F.col("size")
    for _ in range(NEWTON_STEPS):
        solved = small(goals)
        own = cells.alias("c").join(solved.alias("g"), F.col("c.source").eqNullSafe(F.col("g.source")))
        sums = own.groupBy("g.source", "tokens", "target", "lam").agg(F.sum(term * rate).alias("reached"), F.sum(term * F.exp("lam")).alias("hessian"))
        gradient = F.col("reached") - F.col("target")
        # Beyond the cap the dual has no curvature; the uncapped term keeps the step finite, and leads back.
        step = F.when((F.col("target") > 0) & (F.col("hessian") > 0), F.least(F.log(F.lit(MOST_COPIES)), F.col("lam") - gradient / F.col("hessian"))).otherwise(F.col("lam"))
        open_ = (F.col("target") > 0) & (F.abs(gradient) > TOLERANCE * F.col("target"))
        stepped = materialize(sums.select("source", "tokens", "target", F.when(open_, step).otherwise(F.col("lam")).alias("lam"), open_.alias("open")), "mix-step")
        discard(goals)
        more, goals = stepped.filter("open").limit(1).count(), stepped
        if not more:
            break
    return goals.select("source", "tokens", "target", F.when(F.col("target") > 0, rate).otherwise(F.lit(0.0)).alias("rate"))


def same_source(a: str, b: str) -> Column:
    return F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))


def edges(units: DataFrame, goals: DataFrame) -> DataFrame:
    """goals with low and high: hashes below low are taken, those from high on are not; open: tokens wanted of those between."""
    whole = F.floor(F.col("rate") + 1e-9)
    found = goals.withColumns({"whole": whole, "low": F.lit(0).cast("long"), "high": F.lit(1 << HASH_BITS).cast("long"), "open": F.greatest(F.lit(0.0), F.col("rate") - whole) * F.col("tokens")})
    counts = units.groupBy("source").agg(F.count("*").alias("n"))
    found = found.alias("g").join(counts.alias("c"), same_source("g", "c")).select("g.*", "n")
    shift, found = HASH_BITS, materialize(found, "mix-edges")
    while shift > 0 and found.filter(F.col("n") > EDGE_ROWS).limit(1).count():
        shift -= RANGE_BITS
        wide = F.col("n") > EDGE_ROWS
        inside = units.alias("u").join(small(found.filter(wide)).alias("g"), same_source("u", "g")).filter("unit >= low AND unit < high")
        sums = inside.groupBy("g.source", "open", F.shiftright("unit", shift).alias("part")).agg(F.sum("size").alias("sum"), F.count("*").alias("n"))
        before = F.coalesce(F.sum("sum").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        # The last range that begins at or before the end of what is wanted.
        last = sums.withColumn("before", before).filter("before <= open").groupBy("source").agg(F.max_by(F.struct("part", "before", "n"), "part").alias("last"))
        at = found.alias("g").join(last.alias("l"), same_source("g", "l"), "left")
        low = F.call_function("shiftleft", F.col("last.part"), F.lit(shift))
        narrowed = at.select("g.source", "tokens", "target", "rate", "whole", F.coalesce(low, "low").alias("low"), F.coalesce(low + F.lit(1 << shift), "high").alias("high"), (F.col("open") - F.coalesce("last.before", F.lit(0))).alias("open"), F.coalesce("last.n", "n").alias("n"))
        narrowed = materialize(narrowed, "mix-edges")
        discard(found)
        found = narrowed
    return found


def chosen(units: DataFrame, found: DataFrame) -> DataFrame:
    """(source, unit) taken within the last range of each source."""
    inside = units.filter("size > 0").alias("u").join(small(found).alias("g"), same_source("u", "g")).filter("unit >= low AND unit < high")
    listed = inside.groupBy("g.source", "open", "unit").agg(F.sum("size").alias("tokens")).groupBy("source", "open").agg(F.reverse(F.array_sort(F.collect_list(F.struct("tokens", "unit")))).alias("all"))
    start = F.struct("open", F.array().cast("array<bigint>").alias("units"), F.lit(None).cast("struct<tokens:bigint,unit:bigint>").alias("least"))

    def take(acc: Column, x: Column) -> Column:
        got = F.struct((acc["open"] - x["tokens"]).alias("open"), F.array_append(acc["units"], x["unit"]).alias("units"), acc["least"].alias("least"))
        return F.when(acc["open"] >= x["tokens"], got).otherwise(F.struct(acc["open"].alias("open"), acc["units"].alias("units"), x.alias("least")))

    nearer = lambda acc: F.when(acc["least"]["tokens"] < 2 * acc["open"], F.array_append(acc["units"], acc["least"]["unit"])).otherwise(acc["units"])
    return materialize(listed.select("source", F.explode(F.aggregate("all", start, take, nearer)).alias("unit")), "mix-chosen")


def unit_of(key: Column, copy: Column) -> Column:
    """The place of a row in the order in which documents are taken."""
    return F.xxhash64(key, copy).bitwiseAND(F.lit((1 << HASH_BITS) - 1))


def size_of(docs: DataFrame) -> Column:
    return F.coalesce(F.regexp_count(docs["text"], F.lit(WORD)), F.lit(0)).cast("long")


class Plan:
    """What decides the copies of documents: each source's rate and range, and the units taken within it."""

    def __init__(self, units: DataFrame) -> None:
        cells = materialize(units.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-cells")
        goals = balanced(cells, targets(cells.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("tokens"))))
        self.found = edges(units, goals)
        self.taken = chosen(units, self.found)
        discard(cells)

    def applied(self, rows: DataFrame) -> DataFrame:
        """rows (with source and unit) with source_size, target, rate and copies."""
        out = rows.alias("r").join(small(self.found).alias("g"), same_source("r", "g"))
        out = out.join(small(self.taken.withColumn("taken", F.lit(1))).alias("t"), same_source("r", "t") & (F.col("r.unit") == F.col("t.unit")), "left")
        more = F.when(F.col("r.unit") < F.col("low"), 1).otherwise(F.coalesce("taken", F.lit(0)))
        return out.select("r.*", F.col("g.tokens").alias("source_size"), "target", "rate", (F.col("whole") + more).cast("int").alias("copies"))


def copies(docs: DataFrame, seed: int = 29) -> DataFrame:
    """doc_id, source, size, source_size, target, rate and copies of every row of docs."""
    key = F.xxhash64(F.lit(seed), docs["doc_id"], docs["text"], docs["source"])
    base = materialize(with_row(docs.select(docs["doc_id"], docs["source"], size_of(docs).alias("size"), key.alias("key"))), "mix-rows")
    units = numbered(base, ["key"]).select("doc_id", "source", "size", unit_of(F.col("key"), F.col("copy")).alias("unit"))
    return Plan(units).applied(units).drop("unit")


def mix(docs: DataFrame, seed: int = 29) -> DataFrame:
    """The mixture itself: the rows of docs, each as many times as it has copies, with all columns of docs.

    Of rows equal in all columns, only the texts are written once more, to number them; others are taken as they are read.
    """
    whole = F.struct(*[docs[c] for c in docs.columns])
    rows = docs.select(whole.alias("it"), docs["source"], size_of(docs).alias("size"), F.xxhash64(F.lit(seed), *[x for c in docs.columns for x in (docs[c], docs[c].isNull())]).alias("key"))
    base = materialize(with_row(rows.select("source", "size", "key")), "mix-rows")
    base = numbered(base, ["key"])
    again = materialize(base.filter("copy > 0").select("key").distinct(), "mix-repeated")
    plan = Plan(base.select("source", "size", unit_of(F.col("key"), F.col("copy")).alias("unit")))
    if again.limit(1).count():
        many = numbered(materialize(with_row(rows.join(small(again), "key", "left_semi")), "mix-repeats"), ["key"]).select("it", "source", "key", "copy")
        rows = rows.join(small(again), "key", "left_anti").select("it", "source", "key", F.lit(0).cast("long").alias("copy")).unionByName(many)
    else:
        rows = rows.select("it", "source", "key", F.lit(0).cast("long").alias("copy"))
    units = rows.select("it", "source", unit_of(F.col("key"), F.col("copy")).alias("unit"))
    return plan.applied(units).filter("copies > 0").select("it", F.explode(F.sequence(F.lit(1), "copies"))).select("it.*")
