"""Indented key-value text to key paths, as a native fold over the lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.runtime import ship


def _parts(line: Column) -> Column:
    bare = T.strip(line)
    at = F.instr(bare, ":")
    return F.struct(
        F.floor((F.length(line) - F.length(F.ltrim(line))) / 2).cast("int").alias("level"),
        T.strip(F.substring(bare, F.lit(1), at - 1)).alias("key"),
        T.strip(F.substr(bare, at + 1)).alias("value"),
    )


#: Lines folded into one array before arrays are joined.
BLOCK = 256


def flatten_lines(text: Column) -> Column:
    """``path = value`` lines of a text.

    Lines without a colon are passed over.  Two spaces are a level.  A key joins the
    path if it stands exactly one level below it; deeper ones do not, and their values
    go to the path that is open.

    The fold goes block by block: growing one array line by line would copy it each time.
    """
    lines = F.filter(F.split(T.normalize_newlines(text), "\n"), lambda x: F.contains(x, F.lit(":")))
    none = F.array().cast("array<string>")

    def step(acc: Column, part: Column) -> Column:
        cut = F.slice(acc["path"], F.lit(1), part["level"])
        path = F.when((part["key"] != "") & (F.size(cut) == part["level"]), F.concat(cut, F.array(part["key"]))).otherwise(cut)
        return T.once(path, lambda p: F.struct(p.alias("path"), F.when(part["value"] != "", F.concat(acc["out"], F.array(F.concat(F.array_join(p, "."), F.lit(" = "), part["value"])))).otherwise(acc["out"]).alias("out")))

    def fold(acc: Column, block: Column) -> Column:
        inner = F.aggregate(F.transform(block, _parts), F.struct(acc["path"].alias("path"), none.alias("out")), step)
        return T.once(inner, lambda x: F.struct(x["path"].alias("path"), F.concat(acc["out"], F.array(x["out"])).alias("out")))

    blocks = lambda ls: F.transform(F.sequence(F.lit(0), F.floor(F.size(ls) / BLOCK).cast("int")), lambda i: F.slice(ls, i * BLOCK + 1, F.lit(BLOCK)))
    start = F.struct(none.alias("path"), F.array().cast("array<array<string>>").alias("out"))
    return F.aggregate(T.once(lines, blocks), start, fold, lambda acc: F.flatten(acc["out"]))


def naturalize(path: Column, text: Column) -> Column:
    """The path line, then the flattened lines."""
    head = F.concat(F.lit("source_path: "), path)
    return T.strip(F.array_join(F.concat(F.array(head), flatten_lines(text)), "\n"))


def document_text(docs: DataFrame, path_col: str = "source_path", text_col: str = "text") -> DataFrame:
    """The text that engine A chunks: flattened YAML, or a path line and the text."""
    path, text = F.col(path_col), F.col(text_col)
    yaml = F.lower(path).endswith(".yaml") | F.lower(path).endswith(".yml")
    return docs.withColumn(text_col, F.when(yaml, naturalize(path, text)).otherwise(T.header_a(path, text)))


def pretty_yaml(docs: DataFrame, path_col: str = "source_path", text_col: str = "text") -> DataFrame:
    """Parse and dump the text of ``.yml`` files, keys in order; unreadable text stays as it is.

    The one text operator that needs a parser, so it runs in Arrow batches, on those rows alone.
    """
    import pyarrow as pa

    ship(docs.sparkSession)

    def run(batches):
        try:
            import yaml
        except ImportError:  # without the parser texts stay raw
            yaml = None

        def pretty(raw):
            try:
                return yaml.safe_dump(yaml.safe_load(raw), sort_keys=False, allow_unicode=True)
            except Exception:  # any malformed text stays raw
                return raw

        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts = batch.column(at).to_pylist()
            yield batch.set_column(at, text_col, pa.array([t if yaml is None or t is None else pretty(t) for t in texts], pa.string()))

    hit = F.lower(F.col(path_col)).endswith(".yml")
    return docs.filter(~F.coalesce(hit, F.lit(False))).unionByName(docs.filter(hit).mapInArrow(run, docs.schema))
