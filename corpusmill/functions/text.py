"""Text scalars as native column expressions (no Python workers).

Positions and lengths are code points.  Null stays null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that stripping takes off, white space of Unicode and the separators U+001C to U+001F.
EDGES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value bound to a lambda's variable; a plain column would be computed anew at each use."""
    return F.transform(F.array(value), use)[0]


def normalize_newlines(text: Column) -> Column:
    """CR LF and CR become LF."""
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def squeeze_blank_lines(text: Column) -> Column:
    """Runs of three or more LF become two; most texts have none and skip the pattern."""
    return once(text, lambda t: F.when(F.contains(t, F.lit("\n\n\n")), F.regexp_replace(t, "\n{3,}", "\n\n")).otherwise(t))


def strip(text: Column) -> Column:
    """The characters of EDGES off both ends, in one pass."""
    return F.btrim(text, F.lit(EDGES))


def is_blank(text: Column) -> Column:
    """No character but those of EDGES; ends at the first other one."""
    return ~text.rlike(f"[^{EDGES}]")


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix(path: Column) -> Column:
    """The last dot part with its dot; none for a leading dot."""
    return F.regexp_extract(file_name(path), r"(?<=.)(\.[^.]+)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def relative(path: Column, root: str) -> Column:
    """Relative to ``root``, else unchanged."""
    base = root.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(base)), F.substr(path, F.lit(len(base) + 1))).otherwise(path)


def path_tokens(path: Column) -> Column:
    return F.transform(F.filter(F.split(path, r"[/._\-]+"), lambda x: x != ""), lambda x: F.lower(x))


def header_a(path: Column, text: Column) -> Column:
    return F.concat(F.lit("source_path: "), path, F.lit("\n"), text)


def header_b(rel: Column, text: Column) -> Column:
    """The path, stem and tokens lines, an empty line, and the text."""
    tokens = F.array_join(path_tokens(rel), " ")
    lines = F.concat_ws("\n", F.concat(F.lit("__DOC_PATH__ "), rel), F.concat(F.lit("__DOC_STEM__ "), stem(rel)), F.when(tokens != "", F.concat(F.lit("__DOC_TOKENS__ "), tokens)))
    return F.concat(lines, F.lit("\n\n"), text)


def query_tokens_a(question: Column) -> Column:
    """Lower case, ``?`` and ``,`` as spaces, split at white space; repeats stay."""
    return F.filter(F.split(F.translate(F.lower(question), "?,", "  "), r"\s+"), lambda x: x != "")


def query_tokens_b(question: Column) -> Column:
    return F.filter(F.split(F.lower(strip(question)), r"\s+"), lambda x: x != "")


def count_of(hay: Column, needle: Column) -> Column:
    """Non-overlapping occurrences; 0 for an empty needle."""
    found = (F.octet_length(hay) - F.octet_length(F.replace(hay, needle, F.lit("")))) / F.octet_length(needle)
    return F.when(F.octet_length(needle) > 0, found).otherwise(0).cast("int")


# Fixed value: white space as ``\s`` of the SQL has it; that of Java has U+000B too.
SQL_SPACE = r"[ \t\n\f\r]+"


def words(text: Column, space: str = r"\s+") -> Column:
    return F.filter(F.split(text, space), lambda x: x != "")


def token_count(text: Column, space: str = r"\s+") -> Column:
    """The default tokenizer counts white-space words."""
    return F.size(words(text, space))


def truncate_tokens(text: Column, n: int, space: str = r"\s+") -> Column:
    """The first ``n`` tokens, joined by a space; shorter texts stay as they are."""
    return F.when(token_count(text, space) > n, F.array_join(F.slice(words(text, space), 1, n), " ")).otherwise(text)


def source_tag(path: Column, chunk_id: Column, score: Column) -> Column:
    """The score rounds as the binary number it is, half to even; ``%.4f`` of Java rounds its shortest decimal half up."""
    return F.format_string("[source=%s chunk=%d score=%s]", path, chunk_id, F.call_function("format_number", score, F.lit("0.0000")))


def semantic_tags(tags: Column) -> Column:
    """Comma list to trimmed items; empty ones are skipped."""
    return F.filter(F.transform(F.split(tags, ","), lambda x: F.trim(x)), lambda x: x != "")


def link_macro(kind: str, url: Column) -> Column:
    """What the link macros expand to."""
    # Link texts and footnotes of the macros.
    label, foot = {"seehere": ("see here", False), "clickurl": ("url", False), "seeherefooter": ("see here", True), "clickurlfooter": ("here", True)}[kind]
    link = F.concat(F.lit("\\href{"), url, F.lit("}{" + label + "}"))
    return F.concat(link, F.lit("\\footnote{\\url{"), url, F.lit("}}")) if foot else link


def comment_node(side: str, target: Column, name: Column, text: Column, shift: Column) -> Column:
    """The two drawing commands of a comment at the top right or top left of a node."""
    here, there, sign, bend = ("south west", "north east", "", "-|") if side == "right" else ("south east", "north west", "-", "|-")
    edge = "east" if side == "right" else "west"
    node = F.concat(F.lit(f"\\node[gray, anchor={here}] ("), name, F.lit(f") at ([xshift={sign}"), shift, F.lit(",yshift=6mm]"), target, F.lit(f".{there}) {{\\shortstack{{"), text, F.lit("}};"))
    draw = F.concat(F.lit("\\draw[dashed, gray, <-] ("), name, F.lit(f".{here}) {bend} ("), target, F.lit(f".{edge});"))
    return F.concat(node, F.lit("\n"), draw)


def graph_output(directory: Column, name: Column) -> Column:
    """Where the figure of ``name`` (``.dot`` or not) is written: beside the nearest ancestor ``src``; null without one."""
    base = F.regexp_replace(name, r"\.dot$", "")
    project = F.regexp_extract(F.concat(directory, F.lit("/")), r"^(.*)/src/(?!.*/src/)", 1)
    inside = F.concat(directory, F.lit("/")).rlike("/src/")
    return F.when(inside, F.concat(project, F.lit("/out/"), base, F.lit(".pdf")))


def any_suffix(path: Column, extensions: Iterable[str], strict: bool) -> Column:
    """Is the suffix listed?  ``strict`` compares the last suffix; else the name may end with a longer one."""
    listed = [e.lower() for e in extensions]
    if strict:
        return F.lower(suffix(path)).isin(listed)
    name, out = F.lower(file_name(path)), F.lit(False)
    for e in listed:
        out = out | (F.endswith(name, F.lit(e)) & (F.length(name) > len(e)))
    return out
