"""Mixing sources to target weights by entropy balancing; DataFrame functions only.

Rates w of documents minimise the relative entropy to the corpus, ``sum of w log w - w + 1`` over documents with
``0 <= w <= ceiling``, under one constraint a source: its words, ``sum of size * w``, are its target. The convex dual has one
multiplier a source, and rates are the exponential tilt ``w = min(ceiling, exp(multiplier * size / mean size))``: long documents
make up most of what a source must gain or lose. Newton steps on the dual are aggregations over a histogram (source, size,
documents), so a source that holds a third of all rows is a partial sum in every task; a step that leaves the bracket of
the solution is replaced by its middle. A target is at most ``ceiling`` times its source, so a solution exists.

Rates become whole copies: each document gets the whole part of its rate, and one more copy goes to documents in the order of
``u / part``, where u is a uniform hash of the document and part the rest of its rate, until the words of the source's target
are spent. So a document's chance of one more is that part. The order is cut into bins of bounded expected size,
so only bin totals are accumulated along a source; inside the one bin where the words run out, documents are taken that still fit,
largest first, in a few passes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, Workspace, carried, text_of, unpacked

#: Weights of sources in order of their names, repeating.
WEIGHTS = (5, 2, 1)


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def _ranked(sources: DataFrame, work: Workspace) -> DataFrame:
    """``sources`` with ``position``: the place in code-point order, null last, without one global sort task."""
    n = max(1, int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = sources.repartitionByRange(n, F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
    held = work.put(ordered.withColumn("uid", F.monotonically_increasing_id()).withColumn("part", F.shiftright("uid", 33)), "ordered")
    before = F.expr("sum(n) over (order by part) - n")  # one row a partition
    parts = held.groupBy("part").agg(F.count("*").alias("n"), F.min("uid").alias("low")).select("part", "low", before.alias("before"))
    return held.join(F.broadcast(parts), "part").select("source", "source_size", (F.col("before") + F.col("uid") - F.col("low")).alias("position"))


def source_targets(sources: DataFrame, work: Workspace, weights: tuple[int, ...] = WEIGHTS, ceiling: int = 3) -> DataFrame:
    """``source, source_size, target`` for ``sources`` (source, source_size).

    Shares follow the weights; what exceeds ``ceiling`` times a source goes to the others by weight, until none
    is above. The shares of the others stay in proportion to their weights, so the state of the
    loop is one number, the words a unit of weight gets.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("position") % len(weights) + 1).cast("int"))
    table = work.put(_ranked(sources, work).withColumn("weight", weight), "weights")
    work.drop("ordered")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    unit, bounded = 0.0, -1
    while True:
        full = F.col("weight") * unit >= ceiling * F.col("source_size")
        row = table.agg(
            F.sum(F.when(full, ceiling * F.col("source_size")).otherwise(0)).alias("spent"), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("open"), F.sum(F.when(full, 1).otherwise(0)).alias("n")
        ).first()
        if not row["open"] or row["n"] == bounded:
            break
        bounded, unit = row["n"], (total - row["spent"]) / row["open"]
    target = F.least(F.col("weight") * unit, (ceiling * F.col("source_size")).cast("double"))
    return table.select("source", "source_size", target.alias("target"))


def balance(histogram: DataFrame, targets: DataFrame, work: Workspace, ceiling: int = 3, rounds: int = 60, tolerance: float = 1e-6) -> DataFrame:
    """``source, slope``: the multiplier of the size, by Newton's method on the dual; gradient and curvature are sums over the histogram.

    ``histogram``: h_source, size, n. A source without words, or without a target, has no row and rate 0. What the tolerance
    leaves open is spent by the copies.
    """
    measured = histogram.where("size > 0").groupBy("h_source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"), F.min("size").alias("least"))
    # where even the shortest document reaches the ceiling, all do: the solution is not beyond
    top = F.log(F.lit(float(ceiling))) * F.col("mean") / F.col("least") * (1 + 1e-12)
    open_ = targets.where("source_size > 0 and target > 0").join(measured, F.col("source").eqNullSafe(F.col("h_source")))
    more, full = F.col("target") > F.col("source_size"), F.col("target") >= ceiling * F.col("source_size") * (1 - 1e-12)
    start = open_.select("source", "target", "mean", F.when(full, top).otherwise(0.0).alias("m"), F.when(more, F.lit(0.0)).alias("low"), F.when(more, top).otherwise(0.0).alias("high"), F.lit(1.0).alias("error"))
    duals = work.put(start, "duals-0")
    for step in range(1, rounds + 1):
        x = F.col("size") / F.col("mean")
        free = F.col("m") * x < F.log(F.lit(float(ceiling)))
        tilt = F.col("size") * F.col("n") * F.when(free, F.exp(F.col("m") * x)).otherwise(float(ceiling))
        sums = histogram.join(duals, F.col("h_source").eqNullSafe(F.col("source"))).groupBy("source", "target", "mean", "m", "low", "high")
        sums = sums.agg(F.sum(tilt).alias("words"), F.sum(F.when(free, tilt * x).otherwise(0.0)).alias("bend"))
        short = F.col("words") < F.col("target")
        sums = sums.withColumns({"low": F.when(short, F.col("m")).otherwise(F.col("low")), "high": F.when(short, F.col("high")).otherwise(F.col("m")), "error": F.abs(F.col("target") - F.col("words")) / F.col("target")})
        sums = sums.withColumn("newton", F.when(F.col("bend") > 0, F.col("m") + (F.col("target") - F.col("words")) / F.col("bend")))
        inside = F.col("newton").isNotNull() & (F.col("low").isNull() | (F.col("newton") > F.col("low"))) & (F.col("newton") < F.col("high"))
        moved = F.when(F.col("error") <= tolerance, F.col("m")).when(inside, F.col("newton")).otherwise((F.coalesce("low", F.col("high") * 2) + F.col("high")) / 2)
        duals = work.put(sums.select("source", "target", "mean", moved.alias("m"), "low", "high", "error"), f"duals-{step}")
        work.drop(f"duals-{step - 1}")
        worst = duals.agg(F.max("error")).first()[0]
        if worst is None or worst <= tolerance:
            break
    return duals.select("source", (F.col("m") / F.col("mean")).alias("slope"))


def mix_rows(sized: DataFrame, work: Workspace, weights: tuple[int, ...], ceiling: int, bin_rows: int) -> DataFrame:
    """Of written rows (id, source, size, uid): ``source_size, target, rate, copies`` beside them."""
    histogram = work.put(sized.groupBy(F.col("source").alias("h_source"), "size").agg(F.count("*").alias("n")), "histogram")
    sources = histogram.groupBy(F.col("h_source").alias("source")).agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = work.put(source_targets(sources, work, weights, ceiling), "targets")
    duals = balance(histogram, targets, work, ceiling)

    told = targets.join(duals.toDF("d_source", "slope"), F.col("source").eqNullSafe(F.col("d_source")), "left").select(F.col("source").alias("r_source"), "source_size", "target", "slope")
    rate = F.when(F.col("slope").isNull(), 0.0).otherwise(F.least(F.exp(F.col("slope") * F.col("size")), F.lit(float(ceiling))))
    whole = F.floor(rate + 1e-7).cast("long")  # a rate within rounding of a whole number is that number
    part = F.when(rate - whole > 1e-7, rate - whole).otherwise(0.0)
    given = histogram.join(told, F.col("h_source").eqNullSafe(F.col("r_source"))).groupBy("r_source", "source_size", "target", "slope").agg(F.sum(whole * F.col("size") * F.col("n")).alias("given"))
    rates = work.put(given.select("r_source", "source_size", "target", "slope", F.greatest(F.lit(0.0), F.col("target") - F.col("given")).alias("rest")), "rates")

    # bins along the order of u / part: its odds map it to 0..1, and the words run out about the middle
    bins = max(1, -(-sized.count() // bin_rows))
    u = (F.pmod(F.xxhash64("id", "size", F.lit(11)), F.lit(1 << 52)) + 1) / float(1 << 52)
    rated = sized.join(rates, sized["source"].eqNullSafe(rates["r_source"])).select("id", "source", "size", "uid", "source_size", "target", "rest", rate.alias("rate"), whole.alias("whole"), part.alias("part"))
    placed = rated.withColumn("key", F.when((F.col("part") > 0) & (F.col("size") > 0), u / (u + F.col("part")))).withColumn("bin", F.floor(F.col("key") * bins))
    totals = placed.where("key is not null").groupBy("source", "bin").agg(F.sum("size").alias("words"))
    totals = totals.withColumn("before", F.expr("sum(words) over (partition by source order by bin) - words"))
    joined = totals.join(rates, totals["source"].eqNullSafe(rates["r_source"]))
    state = F.when(F.col("before") + F.col("words") <= F.col("rest"), 1).when(F.col("before") < F.col("rest"), 0)
    cuts = joined.select(F.col("source").alias("c_source"), F.col("bin").alias("c_bin"), state.alias("state"), (F.col("rest") - F.col("before")).alias("budget")).where("state is not null")
    cuts = work.put(cuts, "cuts")

    # in the bin where the words run out: take in order while it fits, then what still fits, largest first
    edge = cuts.where("state = 0")
    open_ = placed.join(edge, placed["source"].eqNullSafe(edge["c_source"]) & (placed["bin"] == edge["c_bin"])).select("source", "size", "key", "id", "uid", "budget")
    chosen = None
    for step in range(6):
        order = "key, id, uid" if step == 0 else "size desc, key, id, uid"
        run = open_.withColumn("run", F.expr(f"sum(size) over (partition by source order by {order} rows unbounded preceding)"))
        marked = run.withColumn("fits", F.col("run") <= F.col("budget"))
        spent = F.expr("coalesce(max(case when fits then run end) over (partition by source), 0)")
        held = work.put(marked.withColumn("budget", F.col("budget") - spent).select("source", "size", "key", "id", "uid", "budget", "fits"), f"fill-{step}")
        taken = held.where("fits").select(F.col("uid").alias("t_uid"))
        chosen = taken if chosen is None else chosen.unionByName(taken)
        open_ = held.where("not fits and size <= budget").drop("fits")
        if open_.isEmpty():
            break
    before = cuts.where("state = 1").select("c_source", "c_bin", "state")
    extra = placed.join(before, placed["source"].eqNullSafe(before["c_source"]) & (placed["bin"] == before["c_bin"]), "left").join(chosen, placed["uid"] == chosen["t_uid"], "left")
    copies = F.col("whole") + F.when((F.col("state") == 1) | F.col("t_uid").isNotNull(), 1).otherwise(0)
    return extra.select("id", "size", "source", F.col("source_size").cast("long").alias("source_size"), "target", "rate", F.least(copies, F.lit(ceiling)).cast("long").alias("copies"), "uid")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, ceiling: int = 3, bin_rows: int = 1024, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """``doc_id, size, source, source_size, target, rate, copies, taken`` of every row of ``docs``.

    Size: words of the text (null: 0). A document is taken ``copies`` times, at most ``ceiling``; documents of no
    words have rate 1 and cost nothing, or 0 where their source has no words. Null sources are one source, the
    last; null ids are one id. Order, and so the result, depends on ids, sizes and sources alone; rows that agree in all three are
    interchangeable. An empty table gives no rows. Columns of other names are not read.
    """
    with Workspace(docs.sparkSession, "mixing") as work:
        sized = docs.select(docs[id_column].alias("id"), docs[source_column].alias("source"), word_count(text_of(docs, text_column)).alias("size"))
        sized = work.put(sized.withColumn("uid", F.monotonically_increasing_id()), "sized")
        out = mix_rows(sized, work, weights, ceiling, bin_rows)
        out = work.put(out.select(F.col("id").alias("doc_id"), "size", "source", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken")), "result")
        work.clear("result")
        return out


def apply_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, ceiling: int = 3, bin_rows: int = 1024, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """Rows of ``docs`` (all columns, of any names) as often as the mix takes them: repeated for further copies, gone for none.

    Nulls, repeated rows, ties and documents without words as in ``mix_sources``; an empty table gives an empty one.
    """
    with Workspace(docs.sparkSession, "mixing") as work:
        rows = carried(docs, id=id_column, source=source_column, body=text_column)
        rows = rows.select("row", "id", "source", word_count(text_of(rows, "body")).alias("size"))
        rows = work.put(rows.withColumn("uid", F.monotonically_increasing_id()), "rows", "zstd")
        mixed = work.put(mix_rows(rows.select("id", "source", "size", "uid"), work, weights, ceiling, bin_rows).where("copies > 0").select("uid", "copies"), "mixed")
        # what joins the texts grows with them: the plan of large inputs at every size
        repeated = rows.select("row", "uid").join(mixed.hint("merge"), "uid").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
        out = work.put(repeated.select(*unpacked(docs.columns)), "rows-taken", "zstd")
        work.clear("rows-taken")
        return out
