"""Mixing of sources to target weights by Pareto order sampling, in DataFrame operations only.

A document of a source whose target is r times the source's size is due floor(r) certain copies. What is left of the target
is sampled with unequal probabilities: a document's inclusion probability is in proportion to its size (rounded down to a
64th of an octave), at most 1, so that the probabilities times the sizes add up to the words wanted; those that reach 1 are
certain too. Each document draws a uniform number u from its id and text; the sampled ones of a source are those with the
smallest odds of u divided by the odds of their inclusion, as many as bring the source's words nearest to its target. The rank
at which to stop is found by counts in buckets of the ranking variable, twice refined, so that no task ever holds all
documents of a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import drop_stored, fresh, only, stored

#: Buckets in each of the refinements of the ranking variable.
BUCKETS = 4096
#: Classes of size in an octave.
CLASSES = 64


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """df with, for each name of `sums`, the sum of its column over all rows before this one in `order`. The rows are dealt by
    ranges of the order: a task holds one range, and one more the ranges' own sums, a row for each partition."""
    ranged = stored(df.repartitionByRange(*order).withColumn("range_", F.spark_partition_id()), "ranges")
    before = Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    whole = ranged.groupBy(F.col("range_").alias("r")).agg(*[F.sum(c).alias(f"{n}_") for n, c in sums.items()])
    whole = whole.select("r", *[F.coalesce(F.sum(f"{n}_").over(before), F.lit(0)).alias(f"{n}_") for n in sums])
    inside = Window.partitionBy("range_").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.join(whole, F.col("range_") == F.col("r"))
    return out.select(*df.columns, *[(F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(f"{n}_")).alias(n) for n, c in sums.items()])


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """src, source_size, target for each source of sizes (src, source_size): sources by code point, null last, weigh
    `weights`, repeating, and share `share` of all sizes; none is above `most` times its own, the excess is reshared by
    weight. One row a source; the level at which the sources that aren't capped fill is found by running sums over ranges of
    sources, of which there may be many.
    """
    named = running(sizes, [F.col("src").asc_nulls_last()], {"rank": F.lit(1)})
    w = F.array(*[F.lit(float(x)) for x in weights])[(F.col("rank") % len(weights)).cast("int")]
    s = named.select("src", "source_size", w.alias("w"), (F.col("source_size") * F.lit(float(most))).alias("cap"))
    # by the level (cap / w) at which each is full: before it, caps below are spent and the rest fill by weight
    s = running(s.withColumn("full", F.col("cap") / F.col("w")), [F.col("full"), F.col("src").asc_nulls_last()], {"spent": F.col("cap"), "weighed": F.col("w")})
    s = stored(s, "levels")
    total = s.agg(F.sum("source_size").alias("n"), F.sum("w").alias("w")).first()
    s = s.withColumn("level", (F.lit(float(total.n or 0) * share) - F.col("spent")) / (F.lit(float(total.w or 0)) - F.col("weighed")))
    # the first source that stays under its cap sets the level for it and all after it
    fills = s.where(F.col("level") * F.col("w") <= F.col("cap")).agg(F.min(F.struct("full", F.col("src").isNull(), F.coalesce("src", F.lit("")), "level")).alias("m")).first()
    level = F.lit(float(fills.m.level)) if fills and fills.m else F.lit(float("inf"))
    return s.select("src", "source_size", F.least("cap", level * F.col("w")).alias("target"))


def with_draw(docs: DataFrame, seed: int, doc_id: str, text: str, source: str) -> DataFrame:
    """docs with src, size and u: the source, the words of the text, and a uniform number from id and text."""
    draw = F.pmod(F.xxhash64(F.col(f"`{doc_id}`"), F.col(f"`{text}`"), F.lit(seed)), F.lit(1 << 52)).cast("double") / F.lit(float(1 << 52))
    return docs.withColumns({"src": F.col(f"`{source}`").cast("string"), "size": word_count(F.col(f"`{text}`")), "u": draw})


def pareto_mix(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0, seed: int = 17, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, inclusion for each row of docs.

    size: words of the text (null: 0); source_size and target: of the row's source (null is a source of its own, the last);
    copies: how often the mix takes the row; taken: its words times copies; inclusion: the probability of the copy that is
    sampled beyond the certain ones (0 where none is wanted, and for a row without words). Texts are only counted and hashed,
    whole, where they are. Of rows that tie in the draw (repeats of an id
    and text), all or none are taken beyond certain copies. Reruns, and other partitions of the same rows, agree.
    """
    rows = stored(with_draw(only(docs, doc_id, text, source), seed, doc_id, text, source).select(F.col(f"`{doc_id}`").alias("id"), "src", "size", "u"), "sizes")
    out = apportioned(rows, stops(rows, weights, share, most))
    inclusion = F.when((F.col("size") > 0) & (F.col("want") > 0), F.col("p")).otherwise(F.lit(0.0))
    return out.select(F.col("id").alias(doc_id), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", inclusion.alias("inclusion"))


def mix_documents(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0, seed: int = 17, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of docs, all columns, that the mix of pareto_mix() takes at least once, and how often as the last column:
    mix_copies, or if docs have a column of that name _mix_copies.

    The table of sources decides, joined to the documents where they are if Spark finds it small enough to send round."""
    rows = stored(with_draw(only(docs, doc_id, text, source), seed, doc_id, text, source).select("src", "size", "u"), "sizes")
    found = stops(rows, weights, share, most)
    drop_stored(rows)
    renamed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    keyed = with_draw(renamed.select("row", *[F.col("row")[c].alias(n) for c, n in ((doc_id, "id"), (text, "txt"), (source, "org"))]), seed, "id", "txt", "org")
    out = apportioned(keyed.select("row", "src", "size", "u"), found).where("copies > 0")
    name = "mix_copies" if "mix_copies" not in {c.lower() for c in docs.columns} else fresh(docs, "mix_copies")
    return out.select(*[F.col("row")[c].alias(c) for c in docs.columns], F.col("copies").alias(name))


def size_class(size: Column) -> Column:
    """The size rounded down to a CLASSES-th of an octave."""
    return F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(size, F.lit(1)).cast("double")) * CLASSES) / CLASSES)


def inclusion_scale(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """t, scale for each source that wants more than its certain copies: the inclusion probability of a document is scale times
    its size class, at most 1, and these times the sizes add up to what is wanted.

    From the largest class down: if all above are certain, the rest share what is left in proportion; the first class whose
    probability then isn't over 1 sets the scale. A window holds the classes of one source: CLASSES an octave of sizes at most,
    whatever the number of documents."""
    classes = rows.where("size > 0").groupBy("src", size_class(F.col("size")).alias("g")).agg(F.sum("size").alias("words"))
    classes = classes.join(targets.select(F.col("s"), "want"), F.col("src").eqNullSafe(F.col("s"))).where("want > 0")
    down = Window.partitionBy("s").orderBy(F.desc("g"))
    above = F.coalesce(F.sum("words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(F.col("g") * F.col("words")).over(down.rowsBetween(0, Window.unboundedFollowing))
    scaled = classes.withColumn("scale", (F.col("want") - above) / rest).where(F.col("scale") * F.col("g") <= 1)
    return scaled.groupBy(F.col("s").alias("t")).agg(F.max_by("scale", "g").alias("scale"))


def stops(rows: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """For each source of rows (src, size, u): s, source_size, target, certain, want (words beyond the certain copies), scale (of
    inclusion probabilities; null: all are 1), q_stop and with_stop (the last draw of the sample, and whether it is in it; null:
    all are). One row a source, as a stored table."""
    targets = source_targets(rows.groupBy("src").agg(F.sum("size").alias("source_size")), weights, share, most)
    due = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    certain = F.floor(due + F.lit(1e-12)).cast("long")
    targets = targets.select(F.col("src").alias("s"), "source_size", "target", certain.alias("certain"))
    targets = stored(targets.withColumn("want", F.greatest(F.col("target") - F.col("certain") * F.col("source_size"), F.lit(0.0))), "targets")
    n = targets.count()
    scaled = stored(targets.join(inclusion_scale(rows, targets), F.col("s").eqNullSafe(F.col("t")), "left").drop("t"), "scales", n)
    ranked = with_rank(rows, scaled)
    fine = lambda n: F.floor(F.col("q") * F.lit(float(n)))
    # the first bucket in which a source's running words reach what is wanted
    coarse = ranked.groupBy("s", fine(BUCKETS).alias("b")).agg(F.sum("size").alias("words"), F.first("want").alias("want"))
    upto = coarse.withColumn("upto", F.sum("words").over(Window.partitionBy("s").orderBy("b"))).where(F.col("upto") >= F.col("want"))
    reach = stored(upto.groupBy("s").agg(F.min(F.struct("b", (F.col("upto") - F.col("words")).alias("before"))).alias("m")).select(F.col("s").alias("t"), "m.*"), "coarse", n)
    # then in one of BUCKETS parts of that bucket, and last among the few draws in that part
    inside = ranked.select("s", "q", "size", "want").join(reach, F.col("s").eqNullSafe(F.col("t")) & (fine(BUCKETS) == F.col("b"))).drop("t")
    finer = inside.groupBy("s", fine(BUCKETS * BUCKETS).alias("c")).agg(F.sum("size").alias("words"), F.first("before").alias("before"), F.first("want").alias("want"))
    upto = finer.withColumn("upto", F.sum("words").over(Window.partitionBy("s").orderBy("c")) + F.col("before")).where(F.col("upto") >= F.col("want"))
    reach2 = stored(upto.groupBy("s").agg(F.min(F.struct("c", (F.col("upto") - F.col("words")).alias("before"))).alias("m")).select(F.col("s").alias("t"), "m.*"), "fine", n)
    last = ranked.select("s", "q", "size", "want").join(reach2, F.col("s").eqNullSafe(F.col("t")) & (fine(BUCKETS * BUCKETS) == F.col("c")))
    draws = last.groupBy("s", "q").agg(F.sum("size").alias("words"), F.first("before").alias("before"), F.first("want").alias("want"))
    draws = draws.withColumn("upto", F.sum("words").over(Window.partitionBy("s").orderBy("q")) + F.col("before"))
    # taken: every draw up to the one that comes nearest to what is wanted, the one before the crossing or the crossing
    crossing = draws.where(F.col("upto") >= F.col("want")).groupBy("s").agg(F.min(F.struct("q", "upto", "words", "want")).alias("m"))
    over = F.col("m.upto") - F.col("m.want") <= F.col("m.want") - (F.col("m.upto") - F.col("m.words"))
    stop = crossing.select(F.col("s").alias("t"), F.col("m.q").alias("q_stop"), over.alias("with_stop"))
    out = stored(scaled.join(stop, F.col("s").eqNullSafe(F.col("t")), "left").drop("t"), "stops", n)
    for table in (targets, scaled, reach, reach2):
        drop_stored(table)
    return out


def with_rank(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows with their source's row, p, the inclusion probability, and q, the ranking variable's odds put on [0, 1] in the same
    order: 0 where inclusion is certain."""
    p = F.least(F.coalesce(F.col("scale") * size_class(F.col("size")), F.lit(1.0)), F.lit(1.0))
    odds = (F.col("u") / (1 - F.col("u"))) * ((1 - F.col("p")) / F.col("p"))
    joined = rows.join(found, F.col("src").eqNullSafe(F.col("s"))).withColumn("p", F.greatest(p, F.lit(1e-12)))
    return joined.withColumn("q", odds / (1 + odds))


def apportioned(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows (src, u, ...) with their source's row and copies."""
    # without a stop rounding left a source just short of what is wanted: all of it is taken; without words there is nothing to
    stopped = F.coalesce((F.col("q") < F.col("q_stop")) | ((F.col("q") == F.col("q_stop")) & F.col("with_stop")), F.col("want") > 0)
    extra = stopped & (F.col("size") > 0) & (F.col("want") > 0)
    return with_rank(rows, found).withColumn("copies", F.col("certain") + extra.cast("long"))
