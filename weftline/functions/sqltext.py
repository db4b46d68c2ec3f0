"""Cleaning of SQL text and extraction of the tables it names, as expressions."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.binding import let

GAP = r"\s+"


def spaced(*words: str) -> str:
    """A pattern of words with white space between and after them."""
    return GAP.join((*words, ""))


#: Statements that write, in the order in which they are tried.
UNLESS_THERE = rf"\b(?:{GAP}{GAP.join(('IF', 'NOT', 'EXISTS'))})?"
WRITES = (spaced("INSERT", "INTO"), spaced("CREATE", "TABLE" + UNLESS_THERE), spaced("MERGE", "INTO"), spaced("UPDATE"))
#: The second part of a qualified name.
QUOTED, PLAIN = '"[^"]+"', r"[\w$]+"


def is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.length(c)


def plain(pattern: str) -> str:
    """The pattern without Unicode classes: on ASCII text it matches the same, in a fraction of the time."""
    return pattern.replace("(?iU)", "(?i)").replace("(?U)", "").replace("(?U:", "(?:")


def strip_space(c: Column) -> Column:
    """Without leading and trailing white space of any script."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def split_statements(c: Column) -> Column:
    """The non-empty pieces between semicolons, stripped; quotes aren't looked at."""
    return F.filter(F.transform(F.split(c, ";"), strip_space), lambda s: s != "")


#: A literal, a quoted name or a comment, up to where it ends. Possessive loops: the engine runs them without recursion.
_CLOSED = r"""'(?:[^']++|'')*+'|"[^"]*+"|--[^\n]*+|/\*(?s:.*?)\*/"""
_STATEMENT = rf"""(?:[^;'"/-]++|{_CLOSED}|['"/-])++;?"""


def split_statements_quoted(c: Column) -> Column:
    """As split_statements, but semicolons in literals, quoted names and comments don't count, and each ends its piece.

    A quote or comment that isn't closed is text. Statements may be of any length.
    """
    pieces = F.regexp_extract_all(c, F.lit(_STATEMENT), 0)
    return F.filter(F.transform(pieces, strip_space), lambda s: ~s.isin("", ";"))


def strip_literals(c: Column) -> Column:
    """Without what stands between a quote and the next one. A single character is split at without a pattern: every other
    piece is a literal, unless the last quote isn't closed."""
    outside = lambda pieces: F.when(F.size(pieces) % 2 == 1, F.array_join(F.filter(pieces, lambda _, i: i % 2 == 0), ""))
    return F.coalesce(let(F.split(c, "'"), outside), F.regexp_replace(c, "'[^']*'", ""))


def strip_line_comments(c: Column) -> Column:
    return F.regexp_replace(c, r"--[^\n]*", "")


def strip_block_comments(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)/\*.*?\*/", "")


_CAST = r"(?U)::\w+"


def strip_casts(c: Column) -> Column:
    return F.when(is_ascii(c), F.regexp_replace(c, plain(_CAST), "")).otherwise(F.regexp_replace(c, _CAST, ""))


def clean_sql(c: Column, ascii_only: bool = False) -> Column:
    """Literals, line comments, block comments and casts go, in this order. ascii_only: the text is known to be ASCII."""
    rest = strip_block_comments(strip_line_comments(strip_literals(c)))
    return F.regexp_replace(rest, plain(_CAST) if ascii_only else _CAST, "")


def object_pattern(prefix: str) -> str:
    """Qualified names that begin with prefix: two parts, the second one quoted or not."""
    return rf"(?iU)\b({re.escape(prefix)}[\w.]+?[.](?:{QUOTED}|{PLAIN}))"


def match_objects(c: Column, prefix: str, ascii_only: bool = False) -> Column:
    """All qualified names, as written."""
    pattern = object_pattern(prefix)
    return F.regexp_extract_all(c, F.lit(plain(pattern) if ascii_only else pattern), 1)


def is_object(c: Column, prefix: str, ascii_only: bool = False) -> Column:
    """Whether a match is a table's name: no parenthesis, AS, number before the prefix, or wildcard."""
    pattern = rf"[()]|(?U:\bAS\b)|(?U:\d)+{re.escape(prefix)}|\.\*"
    return ~c.rlike(plain(pattern) if ascii_only else pattern)


def normal_name(c: Column) -> Column:
    return F.lower(F.replace(c, F.lit('"'), F.lit("")))


def bare_name(c: Column) -> Column:
    """normal_name, without single quotes too."""
    return F.lower(F.translate(c, "\"'", ""))


def target_of(cleaned: Column, prefix: str, ascii_only: bool = False) -> Column:
    """The table that a cleaned statement writes, or null: the first kind of write whose first place names one."""
    known = plain if ascii_only else str
    tries = []
    for write in WRITES:
        place = F.regexp_extract(cleaned, known(rf"(?iU){write}([^\s()]+)"), 1)
        name = F.regexp_extract(place, known(object_pattern(prefix)), 1)
        tries.append(let(name, lambda n: F.when((n != "") & is_object(n, prefix, ascii_only), normal_name(n))))
    return F.coalesce(*tries)


def sources_of(cleaned: Column, target: Column, prefix: str, ascii_only: bool = False) -> Column:
    """The other tables that it names: distinct, sorted; with a null target none is left out."""
    matches = F.array_distinct(match_objects(cleaned, prefix, ascii_only))
    names = F.transform(F.filter(matches, lambda m: is_object(m, prefix, ascii_only)), normal_name)
    return F.sort_array(F.array_distinct(F.filter(names, lambda n: ~n.eqNullSafe(target))))


def _is_doubtful(names: Column, low: str) -> Column:
    """Whether lower-cased names have in them what is_object has to look at: patterns only where plain text is found."""
    marks = [names.contains(x) for x in ("(", ")", ".*")]
    return reduce(or_, marks) | (names.contains("as") & names.rlike(r"\bas\b")) | names.rlike(rf"\d{low}")


def _plain_lineage(c: Column, prefix: str) -> Column:
    """lineage_of ASCII text, or null where a name needs a closer look.

    The cleaned text is lower-cased once, patterns take no notice of case, and a write is searched for only where its
    first word is. The prefix comes first in the pattern and its boundary is looked at where it was found.
    """
    low = re.escape(prefix.lower())
    named = rf"{low}(?<=\b{low})[\w.]+?[.](?:{QUOTED}|{PLAIN})"
    names = lambda k: F.regexp_extract_all(k, F.lit(named), 0)

    def first(k: Column, write: str) -> Column:
        write = write.lower()
        place = F.regexp_extract(k, rf"{write}([^\s()]+)", 1)
        return F.get(names(F.when(k.contains(re.match(r"(?:\\b)?(\w+)", write)[1]), place)), F.lit(0))

    def record(f: Column) -> Column:
        doubtful = let(F.concat_ws("\n", f["t"], f["all"]), lambda n: _is_doubtful(n, low))
        bare = lambda n: F.replace(n, F.lit('"'), F.lit(""))
        found = F.array_distinct(F.transform(f["all"], bare))
        target = bare(f["t"])
        others = F.when(f["t"].isNull(), found).otherwise(F.array_remove(found, target))
        return F.when(~doubtful, F.struct(target.alias("target"), F.sort_array(others).alias("sources")))

    both = lambda k: F.struct(F.coalesce(*(first(k, w) for w in WRITES)).alias("t"), names(k).alias("all"))
    return let(F.lower(clean_sql(c, True)), lambda k: let(both(k), record))


def lineage_of(c: Column, prefix: str) -> Column:
    """A struct of target and sources: the text is cleaned once, and the target found once.

    ASCII texts take the patterns without Unicode classes, which match the same there, and those without doubtful names
    the short way.
    """

    def found(ascii_only: bool) -> Column:
        aimed = lambda k: let(target_of(k, prefix, ascii_only), lambda t: F.struct(t.alias("target"), sources_of(k, t, prefix, ascii_only).alias("sources")))
        return let(clean_sql(c, ascii_only), aimed)

    # a prefix that isn't ASCII may match ASCII text by the case rules of Unicode alone
    if not prefix.isascii():
        return found(False)
    return F.coalesce(F.when(is_ascii(c), _plain_lineage(c, prefix)), F.when(is_ascii(c), found(True)).otherwise(found(False)))


def occurrences(c: Column, word: str) -> Column:
    """How often a text has a word, not overlapping."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(word), F.lit("")))) / F.lit(len(word))).cast("long")


#: What is counted in the upper-cased text, by metric.
COMPLEXITY = {"subqueries": "SELECT ", "joins": "JOIN ", "unions": "UNION", "case_statements": "CASE", "window_functions": "OVER(", "ctes": "WITH "}


def complexity(c: Column) -> Column:
    """A struct of textual counts; the first SELECT is no subquery."""
    up = F.upper(c)
    counts = {name: occurrences(up, word) for name, word in COMPLEXITY.items()}
    counts["subqueries"] = F.greatest(counts["subqueries"] - 1, F.lit(0).cast("long"))
    return F.struct(*(v.alias(k) for k, v in counts.items()))


_INNER = "[^)]+"
#: Lint rules: name, pattern, group of the example.
LINT = (
    ("Redundant type cast", r"'[^']+'::(?:" + "|".join(("text", "bigint", "integer", "numeric", "smallint", "date")) + ")", 0),
    ("Excessive parentheses", rf"\({{4}}{_INNER}\){{4}}", 0),
    ("Tautological condition", r"\(1 = 1\)", 0),
    ("Nested null check", r"IS NOT NULL\){3}", 0),
    ("Odd symbols in identifiers", r"(\${2,}|\^+|\*{2,})", 1),
    ("Complex AND condition", rf"\({{2}}{_INNER}\) AND \({_INNER}\){{2}}", 0),
)


#: What a match of each rule has in it: texts that have none of these aren't searched.
LINT_MARKS = (("'::",), ("((((",), ("(1 = 1)",), ("IS NOT NULL)))",), ("$$", "^", "**"), (") AND (",))


def lint(c: Column) -> Column:
    """Issues found: array of (type, count, examples: two at most), in the order of the rules."""

    def found(rule: tuple[str, str, int], marks: tuple[str, ...]) -> Column:
        name, pattern, group = rule
        marked = reduce(or_, (c.contains(m) for m in marks))
        matches = F.when(marked, F.regexp_extract_all(c, F.lit(pattern), group)).otherwise(F.array().cast("array<string>"))
        return F.struct(F.lit(name).alias("type"), matches.alias("found"))

    hits = F.filter(F.array(*map(found, LINT, LINT_MARKS)), lambda i: F.size(i["found"]) > 0)
    return F.transform(hits, lambda i: F.struct(i["type"].alias("type"), F.size(i["found"]).cast("long").alias("count"), F.slice(i["found"], 1, 2).alias("examples")))


def line_count(c: Column) -> Column:
    return occurrences(c, "\n") + 1


def fingerprint(c: Column, model: str, temperature: float) -> Column:
    """Key of a refinement: md5 of the statement, the model and its temperature."""
    return F.md5(F.concat_ws("_", c, F.lit(model), F.lit(float(temperature)).cast("string")))


def preview(c: Column, limit: int = 200) -> Column:
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit("..."))).otherwise(c)
