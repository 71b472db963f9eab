"""Hierarchies to one ordered source: a directory's files become headed sections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.runtime import materialize

#: The heading commands from the highest level down.
LEVELS = ("part", "chapter", "section", "subsection", "subsubsection", "paragraph", "subparagraph")


def extended_levels(deepest: int = 10) -> tuple[str, ...]:
    """The plain section commands and their further ``sub`` levels down to ``deepest``."""
    return ("part", "chapter", *("sub" * n + "section" for n in range(deepest)))


def heading(depth: Column, starting_part: str = "chapter", levels: tuple[str, ...] = LEVELS) -> Column:
    """The command for a depth, the lowest one for depths beyond the list."""
    first = levels.index(starting_part)
    at = F.least(depth + first + 1, F.lit(len(levels))).cast("int")
    return F.element_at(F.array(*[F.lit(x) for x in levels]), at)


def walk_key(path: Column) -> Column:
    """Sorts like a top-down walk: a directory's files, then its directories, each by name."""
    parts = F.split(path, "/")
    return F.transform(parts, lambda x, i: F.struct(F.when(i == F.size(parts) - 1, 0).otherwise(1).alias("f"), x.alias("n")))


def sections(docs: DataFrame, starting_part: str = "chapter", path_col: str = "path", levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """Adds ``depth`` (directories above the file), ``command`` and the walk's sort ``key``."""
    depth = F.size(F.split(F.col(path_col), "/")) - 1
    return docs.withColumn("depth", depth).withColumn("command", heading(F.col("depth"), starting_part, levels)).withColumn("key", walk_key(F.col(path_col)))


def number_parts(rows: DataFrame, by: str, order: str) -> DataFrame:
    """Adds ``part``, the place (from 1) of a row among those with the same ``by``, in order of ``order``.

    One shuffle by ranges of (by, order), so a large group is spread over tasks.  The rows
    a task holds are numbered in place; what stands before them is a sum over tasks.
    """
    sorted_ = rows.repartitionByRange(by, order).sortWithinPartitions(by, order).withColumn("_task", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    kept = materialize(sorted_, "ordered")
    counts = kept.groupBy(by, "_task").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(by).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = materialize(counts.select(F.col(by).alias("_by"), F.col("_task").alias("_t"), (before - F.col("_first") + 1).alias("_shift")), "starts")
    same = kept[by].eqNullSafe(starts["_by"]) & (kept["_task"] == starts["_t"])
    return kept.join(starts, same).withColumn("part", F.col("_at") + F.col("_shift")).drop("_task", "_at", "_by", "_t", "_shift")


def compile_tree(docs: DataFrame, by: str, starting_part: str = "chapter", path_col: str = "path", text_col: str = "text") -> DataFrame:
    """The source of each ``by``, as its parts in walk order: ``by, part, command, source``.

    A part is a file: a heading with its stem, then its text.  A source of any size is
    many rows, never one; :func:`joined` makes one row where a source is known to be small,
    and the text sink writes the parts as they come.
    """
    title = F.concat(F.lit("\\"), F.col("command"), F.lit("{"), T.stem(F.col(path_col)), F.lit("}\n"), F.col(text_col))
    made = sections(docs, starting_part, path_col).select(by, F.struct("key", F.col(path_col)).alias("_key"), "command", title.alias("source"))
    return number_parts(made, by, "_key").select(by, "part", "command", "source")


def joined(parts: DataFrame, by: str) -> DataFrame:
    """``by, source, n_parts``: the parts of small sources as one text each."""
    ordered = F.array_sort(F.collect_list(F.struct("part", "source")))
    return parts.groupBy(by).agg(F.array_join(F.transform(ordered, lambda x: x["source"]), "\n").alias("source"), F.count("*").alias("n_parts"))


def build(nodes: DataFrame, builders: dict[str, Column], kind_col: str = "kind", out: str = "source") -> DataFrame:
    """Adds ``out`` by the builder of each row's kind; a kind without a builder is an error, as it is in no output."""
    kind = F.col(kind_col)
    made = F.raise_error(F.concat(F.lit("no builder for kind "), F.coalesce(kind, F.lit("null")))).cast("string")
    for name, expression in reversed(builders.items()):
        made = F.when(kind == name, expression).otherwise(made)
    return nodes.withColumn(out, made)


def composed(nodes: DataFrame, text_col: str = "source") -> DataFrame:
    """The composed string of each root: its nodes' texts in preorder, as ``root, part, source``.

    ``nodes`` has node_id, parent_id, ord and the text.
    """
    rows = places(nodes).select("root", "key", F.col(text_col).alias("source"))
    return number_parts(rows, "root", "key").select("root", "part", "source")


def document(body: Column, documentclass: str = "article", bibliography: str | None = None) -> Column:
    """Preamble, body and bibliography of a whole document."""
    end = f"\n\\bibliography{{{bibliography}}}" if bibliography else ""
    return F.concat(F.lit(f"\\documentclass{{{documentclass}}}\n\\begin{{document}}\n"), body, F.lit(end + "\n\\end{document}\n"))


def preamble(title: Column, author: Column, date: Column, documentclass: str = "article") -> Column:
    """Class, title, author and date, each on a line; null ones are left out."""
    return F.concat_ws("\n", F.lit(f"\\documentclass{{{documentclass}}}"), *[F.concat(F.lit(f"\\{name}{{"), value, F.lit("}")) for name, value in (("title", title), ("author", author), ("date", date))])


def itemize(items: Column) -> Column:
    """An array as a list environment."""
    lines = F.transform(items, lambda x: F.concat(F.lit("\\item "), x))
    return F.concat(F.lit("\\begin{itemize}\n"), F.array_join(lines, "\n"), F.lit("\n\\end{itemize}"))


def misplaced(nodes: DataFrame, parent_kind: str = "document", allowed: tuple[str, ...] = ("itemize",)) -> DataFrame:
    """Nodes ``(node_id, parent_id, kind)`` below a parent of a kind that does not take them."""
    up = nodes.filter(F.col("kind") == parent_kind).select(F.col("node_id").alias("parent_id"))
    return nodes.join(up, "parent_id", "left_semi").filter(~F.col("kind").isin(*allowed))


def preorder(nodes: DataFrame) -> DataFrame:
    """``nodes`` (node_id, parent_id, ord) with ``root``, ``depth`` and a ``key`` that sorts a root's nodes in preorder.

    One join a level, on the parent, to any depth.  A node that no root reaches hangs in a
    cycle or below a parent that is not there: that is an error, not a lost row.
    """
    rows = nodes.select("node_id", "parent_id", "ord")
    level = materialize(rows.filter("parent_id IS NULL").select("node_id", F.col("node_id").alias("root"), F.lit(0).alias("depth"), F.array("ord").alias("key")), "level-0")
    levels, seen, total = [level], level.count(), rows.count()
    while seen < total:
        up = level.select(F.col("node_id").alias("parent_id"), "root", "depth", F.col("key").alias("_up"))
        level = materialize(rows.join(up, "parent_id").select("node_id", "root", (F.col("depth") + 1).alias("depth"), F.concat("_up", F.array("ord")).alias("key")), f"level-{len(levels)}")
        met = level.count()
        if not met:
            raise ValueError(f"{total - seen} nodes hang in a cycle or below a parent that is not there")
        levels, seen = [*levels, level], seen + met
    return nodes.join(reduce(DataFrame.unionByName, levels), "node_id")


def places(nodes: DataFrame) -> DataFrame:
    """``nodes`` (node_id, parent_id, ord) with ``root``, ``depth`` and a number ``key`` that sorts a root's nodes in preorder.

    The tour that enters and leaves every node is a list, ranked by pointer doubling: each element knows a later
    one and how many enterings and leavings lie between, and takes over its target's target, so the rounds are
    the logarithm of the longest tour, whatever the depth.  Rows stay of one size and no element has two
    before it, so no key is hot.  Siblings with equal ``ord`` go by id.  A node that no root reaches
    is an error, as in :func:`preorder`.
    """
    rows = materialize(nodes.select("node_id", "parent_id", F.struct("ord", "node_id").alias("_order")), "tour-nodes")
    total = rows.count()
    kids = materialize(number_parts(rows.filter("parent_id IS NOT NULL"), "parent_id", "_order").select("parent_id", "node_id", "part"), "tour-children")
    first = kids.filter("part = 1").select(F.col("parent_id").alias("node"), F.col("node_id").alias("to"))
    enter = rows.select(F.col("node_id").alias("node")).join(first, "node", "left")
    enter = enter.select("node", F.lit(False).alias("out"), F.coalesce("to", "node").alias("to"), F.col("to").isNull().alias("to_out"), F.lit(1).alias("hops"), F.lit(1).alias("level"), F.lit(False).alias("done"))
    next_ = kids.select("parent_id", (F.col("part") - 1).alias("part"), F.col("node_id").alias("_next"))
    leave = kids.join(next_, ["parent_id", "part"], "left").select(F.col("node_id").alias("node"), F.lit(True).alias("out"), F.coalesce("_next", "parent_id").alias("to"), F.col("_next").isNull().alias("to_out"), F.lit(1).alias("hops"), F.lit(-1).alias("level"), F.lit(False).alias("done"))
    last = rows.filter("parent_id IS NULL").select(F.col("node_id").alias("node"), F.lit(True).alias("out"), F.col("node_id").alias("to"), F.lit(True).alias("to_out"), F.lit(0).alias("hops"), F.lit(0).alias("level"), F.lit(True).alias("done"))
    long = lambda df: df.withColumns({c: F.col(c).cast("long") for c in ("hops", "level")})
    tour = materialize(long(enter.unionByName(leave).unionByName(last)), "tour-0")
    for i in range((2 * total).bit_length() + 1):
        going = tour.filter("NOT done")
        if going.isEmpty():
            break
        ahead = tour.select(F.col("node").alias("to"), F.col("out").alias("to_out"), F.col("to").alias("_to"), F.col("to_out").alias("_out"), F.col("hops").alias("_hops"), F.col("level").alias("_level"), F.col("done").alias("_done"))
        went = going.join(ahead, ["to", "to_out"]).select("node", "out", F.col("_to").alias("to"), F.col("_out").alias("to_out"), (F.col("hops") + F.col("_hops")).alias("hops"), (F.col("level") + F.col("_level")).alias("level"), F.col("_done").alias("done"))
        tour = materialize(tour.filter("done").unionByName(went), f"tour-{i + 1}")
    met = tour.filter("done AND NOT out").select(F.col("node").alias("node_id"), F.col("to").alias("root"), (1 - F.col("level")).cast("int").alias("depth"), F.expr("-((hops + level) div 2)").alias("key"))
    if (reached := met.count()) < total:
        raise ValueError(f"{total - reached} nodes hang in a cycle or below a parent that is not there")
    return nodes.join(met, "node_id")
