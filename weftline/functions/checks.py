"""Checks of a lineage record, as expressions: each gives (valid, message)."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.binding import let

_NAMES = "array<string>"


def _verdict(valid: Column, good: str, bad: Column) -> Column:
    return F.struct(F.coalesce(valid, F.lit(False)).alias("valid"), F.when(valid, F.lit(good)).otherwise(bad).alias("message"))


def _say(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else F.coalesce(p, F.lit("")) for p in parts))


def _all_of(errors: Column, good: str | Column) -> Column:
    said = F.lit(good) if isinstance(good, str) else good
    none = lambda e: F.coalesce(F.size(e) == 0, F.lit(False))
    return let(errors, lambda e: F.struct(none(e).alias("valid"), F.when(F.size(e) == 0, said).otherwise(F.array_join(e, "; ")).alias("message")))


def check_format(target: Column, sources: Column) -> Column:
    """A record has a target that is text, and a list of sources."""
    bad = F.when(target.isNull(), F.lit("'target' should be a string")).otherwise(F.lit("'sources' should be a list"))
    return _verdict(target.isNotNull() & sources.isNotNull(), "Valid format", bad)


def _named_fault(kind: str, name: Column) -> Column:
    """What is wrong with a schema.table name; null if nothing is."""
    dots = F.length(name) - F.length(F.replace(name, F.lit("."), F.lit("")))
    return F.when(dots != 1, _say(f"{kind} '", name, "' should be fully qualified (schema.table)")).when(
        name.startswith(".") | name.endswith("."), _say(f"{kind} '", name, "' has missing schema or table name")
    )


def check_target(target: Column) -> Column:
    fault = F.when(F.coalesce(target, F.lit("")) == "", F.lit("Target cannot be empty")).otherwise(_named_fault("Target", target))
    return let(fault, lambda f: _verdict(f.isNull(), "Valid target name", f))


def check_sources(sources: Column) -> Column:
    """All sources are schema.table; none at all is valid."""
    faults = F.transform(
        sources,
        lambda s, i: F.when(s.isNull(), _say("Source ", i.cast("string"), " is not a string: None"))
        .when(s == "", _say("Source ", i.cast("string"), " is empty"))
        .otherwise(_named_fault("Source", s)),
    )
    errors = F.filter(faults, lambda e: e.isNotNull())
    good = F.when(F.size(sources) == 0, F.lit("No sources (valid case)")).otherwise(F.lit("All source names valid"))
    valid = lambda e: F.size(e) == 0
    return let(errors, lambda e: F.struct(valid(e).alias("valid"), F.when(valid(e), good).otherwise(F.array_join(e, "; ")).alias("message")))


def _is_derived(name: Column) -> Column:
    named = lambda low: [low.rlike(r"^(?:(?:t|subquery|cte)_\d+|.*_alias)$"), low.isin("t1", "t2", "subquery", "derived")]
    return let(F.lower(name), lambda low: reduce(or_, named(low)))


def check_derived(sources: Column, target: Column | None = None) -> Column:
    """No source is named as an alias or subquery is, and the target isn't among them."""
    errors = F.transform(F.filter(sources, _is_derived), lambda s: _say("Derived table detected: ", s))
    if target is not None:
        own = F.when((target != "") & F.array_contains(sources, target), F.array(_say("Target '", target, "' should not appear in sources")))
        errors = F.concat(errors, F.coalesce(own, F.array().cast(_NAMES)))
    return _all_of(errors, "No derived tables detected")


def repeats(sources: Column) -> Column:
    """Sources that an earlier one equals, but for case."""
    return let(F.transform(sources, F.lower), lambda low: F.filter(sources, lambda s, i: F.array_position(low, F.lower(s)) <= i))


def check_unique(sources: Column) -> Column:
    shown = lambda again: F.array_join(F.transform(again, lambda s: _say("'", s, "'")), ", ")
    return let(repeats(sources), lambda again: _verdict(F.size(again) == 0, "All sources are unique", _say("Duplicate sources found: [", shown(again), "]")))


def check_qualified(names: Column) -> Column:
    loose = F.filter(names, lambda n: ~F.coalesce(n, F.lit("")).contains("."))
    return _all_of(F.transform(loose, lambda n: _say("Name '", n, "' is not fully qualified")), "All names are fully qualified")


def set_sizes(expected: Column, actual: Column) -> dict[str, Column]:
    """The sizes of two sets of sources, e and a, and of what they share, hits."""
    e, a = F.array_distinct(expected), F.array_distinct(actual)
    return {"e": F.size(e), "a": F.size(a), "hits": F.size(F.array_intersect(e, a)).cast("double")}


def shares(e: Column, a: Column, hits: Column) -> tuple[Column, Column]:
    """Precision and recall by the sizes of set_sizes()."""
    share = lambda of: F.when((e == 0) & (a == 0), 1.0).when(of > 0, hits / F.greatest(of, F.lit(1))).otherwise(0.0)
    return share(a), share(e)


def scores(p: Column, r: Column) -> Column:
    """A struct of precision, recall and F1."""
    total = p + r
    f1 = F.when(total > 0, 2 * p * r / F.when(total > 0, total).otherwise(1.0)).otherwise(0.0)
    return F.struct(p.alias("precision"), r.alias("recall"), f1.alias("f1_score"))


def prf1(expected: Column, actual: Column) -> Column:
    """Precision, recall and F1 of two sets of sources; two empty ones agree fully."""
    sizes = F.struct(*(v.alias(k) for k, v in set_sizes(expected, actual).items()))

    def both(n: Column) -> Column:
        p, r = shares(n["e"], n["a"], n["hits"])
        return F.struct(p.alias("p"), r.alias("r"))

    return let(let(sizes, both), lambda s: scores(s["p"], s["r"]))


def comprehensive(target: Column, sources: Column, expected: Column | None = None) -> Column:
    """All checks in order: status, the check that failed first (or comprehensive), its message, and metrics.

    expected: sources to score against; where null, or none is given, metrics are null.
    """
    checks = (
        ("format", check_format(target, sources)),
        ("target", check_target(target)),
        ("sources", check_sources(sources)),
        ("derived_tables", check_derived(sources, target)),
        ("uniqueness", check_unique(sources)),
        ("qualification", check_qualified(F.concat(F.array(target), sources))),
    )
    failed = lambda kind: lambda o: F.when(~F.coalesce(o["valid"], F.lit(False)), F.struct(F.lit(kind).alias("kind"), o["message"].alias("message")))
    passed = F.struct(F.lit("comprehensive").alias("kind"), F.lit("All validations passed").alias("message"))
    # coalesce stops at the first that failed: later checks aren't evaluated
    first = F.coalesce(*(let(check, failed(kind)) for kind, check in checks), passed)
    none = F.lit(None).cast("struct<precision:double,recall:double,f1_score:double>")

    def verdict(o: Column) -> Column:
        good = o["kind"] == "comprehensive"
        metrics = none if expected is None else F.when(good & expected.isNotNull(), prf1(expected, sources))
        return F.struct(
            F.when(good, F.lit("SUCCESS")).otherwise("FAILED").alias("status"), o["kind"].alias("validation_type"), o["message"].alias("message"), metrics.alias("metrics"),
        )

    return let(first, verdict)


#: Names of two parts, one a line. Possessive loops: the engine runs them without recursion.
_TWO_PART_NAMES = r"\A[^.\n]++\.[^.\n]++(?:\n[^.\n]++\.[^.\n]++)*+\z"


def name_lines(target: Column, sources: Column) -> Column:
    """All names of a record, one a line; a null one is empty."""
    return F.array_join(F.concat(F.array(target), sources), "\n", "")


def _surely_good(target: Column, sources: Column, lines: Column) -> Column:
    """Whether all checks pass, as far as one look at all names together tells: true only where they do.

    As many lines as names, each of two parts in lower case, and all names differ: none is null, empty, a repeat or the
    target. Of the names of derived tables only those in _alias have a dot.
    """
    names = F.concat(F.array(target), sources)
    breaks = F.length(lines) - F.length(F.replace(lines, F.lit("\n"), F.lit("")))
    named = lines.rlike(_TWO_PART_NAMES) & (F.lower(lines) == lines) & ~lines.contains("_alias") & (breaks == F.size(sources))
    return named & (F.size(F.array_distinct(names)) == F.size(sources) + 1)


def outcome(target: Column, sources: Column, lines: Column) -> Column:
    """comprehensive()'s validation_type alone, without a message. lines: a column of name_lines(), which is read often."""
    dots = lambda n: F.length(n) - F.length(F.replace(n, F.lit("."), F.lit("")))
    unnamed = lambda n: n.isNull() | (dots(n) != 1) | n.startswith(".") | n.endswith(".")
    faults = {
        "format": target.isNull() | sources.isNull(),
        "target": unnamed(target),
        "sources": F.exists(sources, unnamed),
        "derived_tables": F.exists(sources, _is_derived) | F.array_contains(sources, target),
        "uniqueness": F.size(repeats(sources)) > 0,
        # qualification can't fail any more: all names have a dot
    }
    first = reduce(lambda w, k: w.when(faults[k], k), faults, F.when(_surely_good(target, sources, lines), "comprehensive"))
    return first.otherwise("comprehensive")


def outcome_message(kind: Column, target: Column, sources: Column) -> Column:
    """comprehensive()'s message, where its validation_type is known: only the check that failed is evaluated."""
    checks = {
        "format": check_format(target, sources), "target": check_target(target), "sources": check_sources(sources),
        "derived_tables": check_derived(sources, target), "uniqueness": check_unique(sources),
    }
    return reduce(lambda w, k: w.when(kind == k, checks[k]["message"]), checks, F).otherwise("All validations passed")


_CRITICAL = {"UNION ALL": "UNION ALL operations", "SELECT": "SELECT statements", "INSERT INTO": "INSERT operations", "FROM": "FROM clauses"}
_SOFTER = {"JOIN": "JOIN operations", "CASE": "CASE statements", "COALESCE": "COALESCE functions", "WHERE": "WHERE clauses"}


def _counts(a: Column, b: Column, words: dict[str, str]) -> Column:
    """How often each word is in two upper-cased texts."""
    from weftline.functions.sqltext import occurrences

    return F.array(*(F.struct(F.lit(w).alias("word"), F.lit(what).alias("what"), occurrences(a, w).alias("original"), occurrences(b, w).alias("refined")) for w, what in words.items()))


def _upper(original: Column, refined: Column) -> Column:
    return F.struct(F.upper(original).alias("a"), F.upper(refined).alias("b"))


def keeps_structure(original: Column, refined: Column) -> Column:
    """preserved()'s passed alone: whether the counts of critical words agree."""
    from weftline.functions.sqltext import occurrences

    return let(_upper(original, refined), lambda t: reduce(and_, (occurrences(t["a"], w) == occurrences(t["b"], w) for w in _CRITICAL)))


def preserved(original: Column, refined: Column) -> Column:
    """Whether refined SQL keeps the structure: counts of critical words, up to the first that differ, and warnings."""
    differs = lambda c: c["original"] != c["refined"]
    changed = lambda c: _say(c["what"], " count changed: ", c["original"].cast("string"), " -> ", c["refined"].cast("string"))

    def verdict(t: Column, critical: Column, faults: Column) -> Column:
        until = F.when(F.size(faults) > 0, F.array_position(F.transform(critical, differs), True)).otherwise(len(_CRITICAL))
        entry = lambda x: F.struct(x["word"], F.struct(x["original"].alias("original"), x["refined"].alias("refined"), (x["original"] == x["refined"]).alias("match")))
        none = F.array().cast(_NAMES)
        return F.struct(
            (F.size(faults) == 0).alias("passed"),
            F.map_from_entries(F.transform(F.slice(critical, 1, until.cast("int")), entry)).alias("critical_checks"),
            F.when(F.size(faults) == 0, F.transform(F.filter(_counts(t["a"], t["b"], _SOFTER), differs), changed)).otherwise(none).alias("warnings"),
            F.when(F.size(faults) > 0, changed(faults[0])).alias("error"),
        )

    def judged(t: Column) -> Column:
        return let(_counts(t["a"], t["b"], _CRITICAL), lambda critical: let(F.filter(critical, differs), lambda faults: verdict(t, critical, faults)))

    return let(_upper(original, refined), judged)


def error_report(status: Column, kind: Column, message: Column, metrics: Column, error: Column, target: Column, sources: Column) -> Column:
    """A validation's outcome as the text that a reflecting model is shown."""
    scores = F.format_string("Precision: %.4f, Recall: %.4f", metrics["precision"], metrics["recall"])
    scored = F.when(metrics["f1_score"] >= 1, F.concat(F.lit("PERFECT F1 SCORE = 1.0\n"), scores)).otherwise(
        F.concat(F.format_string("SUCCESS with F1 score: %.4f\n", metrics["f1_score"]), scores)
    )
    good = F.when(metrics.isNotNull(), scored).otherwise("All validations passed")
    listed = F.array_join(F.transform(sources, lambda s: _say("'", s, "'")), ", ")
    now = F.when(error.isNotNull(), _say("Extraction error: ", error)).otherwise(_say("Current extraction: target='", F.coalesce(target, F.lit("N/A")), "', sources=[", listed, "]"))
    said = F.when(F.coalesce(message, F.lit("")) != "", _say(F.upper(F.coalesce(kind, F.lit("validation"))), ": ", message))
    return F.when(status == "SUCCESS", good).otherwise(F.concat_ws("\n", said, now))
