"""What a model answers, as expressions: lineage in JSON or nearly so, and SQL among other words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.binding import let
from weftline.functions.sqltext import bare_name, strip_space

FENCE = "`" * 3
COLON, LIST = r"\s*:\s*", r"\[(.*?)\]"
#: What stands before and after the statement in a prompt.
ASK, ASKED = f"\n\nSQL Query:\n{FENCE}sql\n", f"\n{FENCE}"


def clean_controls(c: Column) -> Column:
    """Runs of control characters become a space."""
    return strip_space(F.regexp_replace(c, r"[\x00-\x1F]+", " "))


def json_block(c: Column) -> Column:
    """From the first opening brace to the last closing one; null if there is none."""
    return F.regexp_substr(c, F.lit(r"(?s)\{.*\}"))


def build_messages(sql: Column, system: str, prompt: str) -> Column:
    """(role, content) messages that ask for a statement's lineage; braces in it are doubled."""
    doubled = F.replace(F.replace(sql, F.lit("{"), F.lit("{{")), F.lit("}"), F.lit("}}"))
    human = F.concat(F.lit(prompt), F.lit(ASK), doubled, F.lit(ASKED))
    return F.array(
        F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")),
        F.struct(F.lit("human").alias("role"), human.alias("content")),
    )


def parse_json(block: Column) -> Column:
    """Lineage of a JSON object, null where it is none; a text for sources is a list of one, other kinds are empty."""
    none = F.array().cast("array<string>")

    def lineage(v: Column) -> Column:
        def named(kind: Column) -> Column:
            listed = F.try_variant_get(v, "$.sources", "array<string>")
            alone = F.array(F.try_variant_get(v, "$.sources", "string"))
            return F.coalesce(F.when(kind == "STRING", alone).when(kind.startswith("ARRAY"), listed), none)

        found = let(F.schema_of_variant(F.try_variant_get(v, "$.sources", "variant")), named)
        names = F.transform(F.filter(found, lambda s: s.isNotNull() & (s != "")), bare_name)
        target = F.coalesce(bare_name(F.try_variant_get(v, "$.target", "string")), F.lit(""))
        return F.when(F.schema_of_variant(v).startswith("OBJECT"), F.struct(target.alias("target"), names.alias("sources")))

    return let(F.try_parse_json(block), lineage)


def _unquoted(c: Column) -> Column:
    return F.lower(F.regexp_replace(strip_space(c), "^[\"']+|[\"']+$", ""))


def _first_group(c: Column, patterns: tuple[str, ...]) -> Column:
    """The group of the first pattern that matches; empty if none does."""

    def group(pattern: str) -> Column:
        return let(F.regexp_substr(c, F.lit(pattern)), lambda m: F.when(m.isNotNull(), F.regexp_extract(m, pattern, 1)))

    return F.coalesce(*(group(f"(?is){p}") for p in patterns), F.lit(""))


def parse_loosely(c: Column) -> Column:
    """Lineage by patterns, from text that isn't JSON: double quotes are tried first, then single ones, then none."""
    quotes = ('"', "'")
    targets = (*(rf"{q}target{q}{COLON}{q}([^{q}]+){q}" for q in quotes), rf"""target["']?{COLON}["']?([^"',\s}}]+)""")
    lists = (*(rf"{q}sources{q}{COLON}{LIST}" for q in quotes), rf"""sources["']?{COLON}{LIST}""")
    by = tuple(f"{q}([^{q}]+){q}" for q in quotes)

    def items(inner: Column) -> Column:
        filled = [let(F.regexp_extract_all(inner, F.lit(p), 1), lambda x: F.when(F.size(x) > 0, x)) for p in by]
        return F.coalesce(*filled, F.regexp_extract_all(inner, F.lit(r"([^,\]\s]+)"), 1))

    def lineage(text: Column) -> Column:
        found = let(_first_group(text, lists), items)
        sources = F.transform(F.filter(found, lambda s: strip_space(s) != ""), _unquoted)
        return F.struct(_unquoted(_first_group(text, targets)).alias("target"), sources.alias("sources"))

    return let(c, lineage)


def parse_response(c: Column) -> Column:
    """Lineage of an answer: its JSON block if that parses, the patterns otherwise."""
    return let(clean_controls(c), lambda text: F.coalesce(parse_json(json_block(text)), parse_loosely(text)))


#: Lines that begin so are chatter about the SQL, not SQL.
CHATTER = ("output:", "refined:", "refined sql", "the refined", "here is", "following is", "i have", FENCE)


def refined_sql(c: Column) -> Column:
    """The SQL of an answer: that in a sql fence, or any fence, or all lines but chatter, ended by a semicolon."""
    fences = [rf"(?s){FENCE}{tag}\s*\n(.*?)\n{FENCE}" for tag in ("sql", "")]
    begins = "^(?:" + "|".join(CHATTER) + ")"
    lines = F.filter(F.split(strip_space(c), "\n"), lambda line: ~F.lower(strip_space(line)).rlike(begins))
    rest = strip_space(F.array_join(lines, "\n"))
    ended = F.when((rest != "") & ~rest.endswith(";"), F.concat(rest, F.lit(";"))).otherwise(rest)
    found = [F.when(c.rlike(p), strip_space(F.regexp_extract(c, p, 1))) for p in fences]
    return F.coalesce(F.when(c.contains(f"{FENCE}sql"), found[0]), F.when(c.contains(FENCE), found[1]), ended)


def placeholder_prompt(prompt: Column) -> Column:
    """The prompt, with a place for the query if it has none."""
    block = ASK + "{query}" + ASKED + "\n\nYour Response (JSON ONLY):"
    return F.when(prompt.contains("{query}"), prompt).otherwise(F.concat(prompt, F.lit(block)))


def clean_reflection(c: Column) -> Column:
    """An improved prompt without comment lines and its heading."""
    lines = F.filter(F.split(strip_space(c), "\n"), lambda x: ~(x.startswith("#") | F.lower(x).startswith("improved prompt:")))
    return strip_space(F.array_join(lines, "\n"))
