"""Edit scripts as they are shown: changes with the lines around them, gaps that open, old and new side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.operators.ranking import runs


def fold(steps: DataFrame, keys: list[str], context: int = 3, opened: DataFrame | None = None) -> DataFrame:
    """``keys, pos, kind, old_no, new_no, value, hidden``: steps within ``context`` places of a change, and a row for each gap between.

    ``steps`` are edit scripts. A gap's row has the place and the numbers of its first line and how many lines it hides; other
    rows hide null. ``opened`` has ``keys, new_no``: gaps that begin at one of those lines are shown in full; a line inside of
    a gap opens nothing, and repeats change nothing. Windows are of one script each.
    """
    order = Window.partitionBy(*keys).orderBy("pos")
    near = F.max((F.col("kind") != "same").cast("int")).over(order.rowsBetween(-context, context)) == 1
    marked = runs(steps.select(*keys, "pos", "kind", "old_no", "new_no", "value", near.alias("_near")), keys, ["pos"], "_near")
    if opened is not None:
        begins = F.first("new_no").over(Window.partitionBy(*keys, "run").orderBy("pos"))
        asked = opened.select(*keys, F.col("new_no").alias("_begins")).distinct().withColumn("_open", F.lit(True))
        marked = marked.withColumn("_begins", F.when(~F.col("_near"), begins)).join(asked, [*keys, "_begins"], "left")
        marked = marked.withColumn("_near", F.col("_near") | F.coalesce("_open", F.lit(False)))
    own = F.when(F.col("_near"), F.col("pos"))
    rows = marked.groupBy(*keys, "run", "_near", own.alias("_own")).agg(F.min("pos").alias("pos"), F.min("kind").alias("kind"), F.min("old_no").alias("old_no"), F.min("new_no").alias("new_no"), F.min("value").alias("value"), F.count("*").alias("hidden"))
    shut = lambda yes, no: F.when(F.col("_near"), no).otherwise(yes)
    return rows.select(*keys, "pos", shut(F.lit("gap"), F.col("kind")).alias("kind"), "old_no", "new_no", shut(F.lit(None), F.col("value")).alias("value"), shut(F.col("hidden"), F.lit(None)).alias("hidden"))


def side_by_side(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, row, kind, left_no, left, right_no, right, hidden``: what ``fold`` gives in two columns, rows from 1.

    Of a stretch of deletions and the additions right after it the k-th stand side by side; what one has more faces nothing
    (kind ``del`` or ``add``, else ``changed``). Unchanged lines stand on both sides, gaps on none, with the numbers they begin at.
    """
    order = Window.partitionBy(*keys).orderBy("pos")
    before = F.coalesce(F.lag("kind").over(order), F.lit(""))
    opens = F.when(F.col("kind") == "del", before != "del").when(F.col("kind") == "add", ~before.isin("del", "add")).otherwise(True)
    blocks = rows.withColumn("_opens", opens.cast("int")).withColumn("_block", F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    placed = blocks.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys, "_block", "kind").orderBy("pos")))
    of = lambda other, c: F.max(F.when(F.col("kind") != other, F.col(c)))
    kind = F.when(F.count("*") == 2, "changed").otherwise(F.min("kind"))
    pairs = placed.groupBy(*keys, "_block", "_nth").agg(kind.alias("kind"), of("add", "old_no").alias("left_no"), of("add", "value").alias("left"), of("del", "new_no").alias("right_no"), of("del", "value").alias("right"), F.max("hidden").alias("hidden"))
    row = F.row_number().over(Window.partitionBy(*keys).orderBy("_block", "_nth"))
    return pairs.select(*keys, row.alias("row"), "kind", "left_no", "left", "right_no", "right", "hidden")
