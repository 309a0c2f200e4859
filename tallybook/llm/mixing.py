"""Mixing sources to target weights by Efraimidis-Spirakis sampling; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallybook.llm.common import WORD, own, written

CELLS = 4096


def quality_weight(text: Column) -> Column:
    """Sampling weight of a text, 0.5 to 1.5: half and the share of ASCII letters among its characters."""
    text = F.coalesce(text, F.lit(""))
    return F.lit(0.5) + F.length(F.regexp_replace(text, "[^A-Za-z]+", "")) / F.greatest(F.length(text), F.lit(1))


def uniform(id_text: Column, seed: int) -> Column:
    """A number in (0, 1) that an id and a seed fix."""
    digits = F.substring(F.md5(F.concat(id_text, F.lit(f"|{seed}"))), 1, 12)
    return (F.conv(digits, 16, 10).cast("long").cast("double") + 0.5) / float(1 << 48)


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), budget: float = 1.5, most_epochs: float = 2.0, seed: int = 17,
                weight: Column | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep_text: bool = True) -> DataFrame:
    """Every row of `docs` with size, source_size, target (its source's) and taken, the words that the mix takes of it.

    Sources in code-point order, null last, take `weights` in turn and share `budget` times all words.  A target stops at
    `most_epochs` times its source's words and the excess goes to the others by weight.  Of a source, every document is
    taken whole as often as the target holds whole epochs.  For what is left, each document draws an exponential key
    divided by its weight (`weight`, by default quality_weight of the text), and documents are taken in the order of their
    keys until the running sum of words meets the rest; the document at the edge is in if half of it at least fits.

    No source is sorted whole.  Keys fall into CELLS cells by a rising function; the words of each cell are summed with
    partial sums, and only the one cell of a source that holds the edge is sorted, to find the key at which to stop.  Then
    one pass compares each document with the stop of its source.  Ranking the sources is a window over one row per source.
    Size and key are read from the texts once and written; only the last pass reads texts again, and without `keep_text`, which
    leaves out their column, none does.

    Null and empty texts have size 0 and take 0.  A null source is a source.  Rows that share id, key and size are taken
    or left together.  Keys depend on the id alone: reruns agree.  An empty table gives an empty one.  Columns of `docs`
    named size, source_size, target or taken are replaced; all others come through unchanged.
    """
    src, key, cell, tag = own("src", "key", "cell", "tag")
    new = ("size", "source_size", "target", "taken")
    columns = [c for c in docs.columns if c.lower() not in new and (keep_text or c != text_col)]
    tag_of = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    if weight is None:
        weight = quality_weight(F.col(text_col))
    # a null source is told from any text by its first character
    src_of = F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("t"))
    sized = docs.select(*[F.col(f"`{c}`") for c in columns], F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long").alias("size"),
                        src_of.alias(src), tag_of.alias(tag), (-F.ln(uniform(tag_of, seed)) / weight).alias(key))
    sized = sized.withColumn(cell, F.least(F.floor((1 - F.exp(-F.col(key))) * CELLS), F.lit(CELLS - 1)).cast("int"))

    if keep_text:
        short = written(sized.select(src, cell, key, tag, "size"))
    else:
        sized = short = written(sized)
    cells = written(short.groupBy(src, cell).agg(F.sum("size").alias("words")))
    plan = sources_plan(cells.groupBy(src).agg(F.sum("words").alias("source_size")), src, weights, budget, most_epochs)
    before = F.sum("words").over(W.partitionBy(src).orderBy(cell).rowsBetween(W.unboundedPreceding, -1))
    edge = cells.withColumn("before", F.coalesce(before, F.lit(0))).join(plan, src)
    edge = edge.filter((F.col("before") < F.col("rest")) & (F.col("before") + F.col("words") >= F.col("rest")))
    # one row per source: the cell that holds the edge and what it may give
    edge = written(edge.select(src, F.col(cell).alias("edge_cell"), (F.col("rest") - F.col("before")).alias("room")))
    inside = short.select(src, cell, key, tag, "size").join(edge.withColumnRenamed("edge_cell", cell), [src, cell])
    running = F.sum("size").over(W.partitionBy(src).orderBy(key, tag, "size").rowsBetween(W.unboundedPreceding, W.currentRow))
    inside = inside.withColumn("running", running).filter(F.col("running") - F.col("size") / 2 <= F.col("room"))
    stop = inside.groupBy(src).agg(F.max(F.struct(key, tag)).alias("stop"))
    plan = written(plan.join(edge.select(src, "edge_cell"), src, "left").join(stop, src, "left"))

    got = sized.join(plan, src)
    more = (F.col("rest") > 0) & ((F.col(cell) < F.col("edge_cell")) | ((F.col(cell) == F.col("edge_cell")) & F.coalesce(F.struct(key, tag) <= F.col("stop"), F.lit(False))))
    taken = F.col("size") * (F.col("epochs") + F.coalesce(more, F.lit(False)).cast("long"))
    return got.select(*columns, "size", "source_size", "target", taken.alias("taken"))


def sources_plan(sources: DataFrame, src: str, weights: tuple[int, ...], budget: float, most_epochs: float) -> DataFrame:
    """Per source: target, whole epochs and the words left over.  Sources fill up in the order of their limit over their
    weight; those before the first that does not fill up are at their limit, the others share what is left by weight."""
    ranked = sources.withColumn("rank", F.row_number().over(W.orderBy(src)) - 1)
    share = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumns({"share": share, "limit": F.col("source_size") * most_epochs})
    order = W.orderBy(F.col("limit") / F.col("share"), "rank")
    ahead, behind = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(W.currentRow, W.unboundedFollowing)
    everything = W.partitionBy()
    ranked = ranked.withColumns({"all": F.sum("source_size").over(everything) * budget, "used": F.coalesce(F.sum("limit").over(ahead), F.lit(0.0)),
                                 "open": F.sum("share").over(behind)})
    ranked = ranked.withColumn("full", F.col("limit") * F.col("open") <= (F.col("all") - F.col("used")) * F.col("share"))
    left = F.min(F.when(~F.col("full"), F.struct((F.col("limit") / F.col("share")).alias("at"), "rank", (F.col("all") - F.col("used")).alias("words"), "open"))).over(everything)
    ranked = ranked.withColumn("left", left)
    target = F.when(F.col("full"), F.col("limit")).otherwise(F.col("left.words") * F.col("share") / F.col("left.open"))
    ranked = ranked.withColumn("target", F.least(target, F.col("limit")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    ranked = ranked.withColumn("epochs", epochs)
    return ranked.select(src, "source_size", "target", "epochs", (F.col("target") - F.col("epochs") * F.col("source_size")).alias("rest"))
