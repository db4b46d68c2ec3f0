"""The engine for one statement, record or graph at a time: plain Python values in and out, the same programs inside.

For tables use the operators; these classes are for notebooks and small tools.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import checks
from weftline.functions.responses import parse_response
from weftline.functions.sqltext import bare_name
from weftline.operators import graph
from weftline.operators.lineage import edges_of, statements, with_lineage
from weftline.operators.model import LineageExtractor
from weftline.operators.refinement import Refiner, session_stats
from weftline.operators.scoring import validate
from weftline.sources.files import lineage_records

_RECORD = "target string, sources array<string>"


@dataclass
class Lineage:
    """A target and its sources."""

    target: str | None
    sources: list[str] = field(default_factory=list)

    def to_dict(self) -> dict:
        return asdict(self)

    def to_json(self, indent: int | None = 2) -> str:
        return json.dumps(self.to_dict(), indent=indent, ensure_ascii=False)

    @property
    def source_count(self) -> int:
        return len(self.sources)

    def add_source(self, name: str | None) -> None:
        """At the end, unless it is empty or there already."""
        if name and name not in self.sources:
            self.sources.append(name)


def _one(df: DataFrame) -> dict:
    return df.first().asDict(recursive=True)


class PatternExtractor:
    """Lineage by patterns of names that begin with a prefix."""

    def __init__(self, spark: SparkSession, prefix: str) -> None:
        self.spark, self.prefix = spark, prefix

    def extract(self, sql: str) -> Lineage:
        r = _one(with_lineage(self.spark.createDataFrame([(sql,)], "sql string"), self.prefix))
        return Lineage(r["target"], r["sources"])


class ModelExtractor:
    """Lineage by a configured model, a statement or a list of them."""

    def __init__(self, spark: SparkSession, extractor: LineageExtractor) -> None:
        self.spark, self.extractor = spark, extractor

    def extract(self, sql: str) -> dict:
        return self.batch_extract([sql])[0]

    def extract_with_result(self, sql: str) -> Lineage:
        r = self.extract(sql)
        return Lineage(r["target"], r["sources"])

    def batch_extract(self, statements: list[str]) -> list[dict]:
        """A record each, in order; those that failed have an error and the beginning of the statement."""
        df = self.spark.createDataFrame(list(enumerate(statements)), "i long, sql string")
        rows = self.extractor.extract(df).orderBy("i").collect()
        keep = lambda r: {k: v for k, v in r.asDict(recursive=True).items() if k in ("target", "sources") or (k in ("error", "query") and v is not None)}
        return [keep(r) for r in rows]

    def test_connection(self) -> bool:
        return self.extractor.works(self.spark)

    def get_config_info(self) -> dict:
        return self.extractor.config()


class SqlRefiner:
    """Refinement of statements, one or a list, and the figures of the session."""

    def __init__(self, spark: SparkSession, refiner: Refiner) -> None:
        self.spark, self.refiner = spark, refiner
        self._results: list[tuple[bool, float, int]] = []

    def refine_sql(self, sql: str, use_cache: bool = True) -> dict:
        return self.batch_refine([sql], use_cache)[0]

    def batch_refine(self, statements: list[str], use_cache: bool = True) -> list[dict]:
        """A result each, in order; answers from the cache don't count as requests of the session."""
        df = self.spark.createDataFrame(list(enumerate(statements)), "i long, sql string")
        rows = [r.asDict(recursive=True) for r in self.refiner.refine(df, use_cache).orderBy("i").collect()]
        self._results += [(r["success"], r["processing_time"] or 0.0, len(r["sql"] or "") // 4) for r in rows if not r["from_cache"]]
        return [{k: v for k, v in r.items() if k != "i"} for r in rows]

    def get_session_stats(self) -> dict:
        """Totals, success rate and averages of the session's requests, and the configuration."""
        df = self.spark.createDataFrame(self._results, "success boolean, processing_time double, estimated_tokens long")
        names = ("model", "temperature", "max_tokens", "max_retries", "retry_delay", "timeout", "delay_between")
        return _one(session_stats(df)) | {"config": {k: getattr(self.refiner, k) for k in names}}

    def clear_cache(self) -> None:
        self.refiner.clear_cache()


def parse_answer(spark: SparkSession, text: str) -> Lineage:
    """Lineage of a model's answer."""
    r = _one(spark.createDataFrame([(text,)], "s string").select(parse_response(F.col("s")).alias("r")).select("r.*"))
    return Lineage(r["target"], r["sources"])


def normalise(spark: SparkSession, names: list[str]) -> list[str]:
    """Names without quotes, in lower case."""
    return _one(spark.createDataFrame([(names,)], "n array<string>").select(F.transform("n", bare_name).alias("n")))["n"]


def split_statements(spark: SparkSession, content: str, quoted: bool = False) -> list[str]:
    df = spark.createDataFrame([("", content)], "filename string, content string")
    return [r["full_sql"] for r in statements(df, quoted).orderBy("statement_index").collect()]


class Validator:
    """Checks of one record: (valid, message) each."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark

    def _check(self, column: Column, target: str | None, sources: list[str] | None) -> tuple[bool, str]:
        r = _one(self.spark.createDataFrame([(target, sources)], _RECORD).select(column.alias("v")).select("v.*"))
        return r["valid"], r["message"]

    def output_format(self, record: Mapping) -> tuple[bool, str]:
        for key in ("target", "sources"):
            if key not in record:
                return False, f"Missing '{key}'"
        return self._check(checks.check_format(F.col("target"), F.col("sources")), record["target"], record["sources"])

    def target_name(self, target: str | None) -> tuple[bool, str]:
        return self._check(checks.check_target(F.col("target")), target, [])

    def source_names(self, sources: list[str]) -> tuple[bool, str]:
        return self._check(checks.check_sources(F.col("sources")), None, sources)

    def no_derived_tables(self, sources: list[str], target: str | None = None) -> tuple[bool, str]:
        return self._check(checks.check_derived(F.col("sources"), F.col("target")), target, sources)

    def unique_sources(self, sources: list[str]) -> tuple[bool, str]:
        return self._check(checks.check_unique(F.col("sources")), None, sources)

    def fully_qualified_names(self, names: list[str]) -> tuple[bool, str]:
        return self._check(checks.check_qualified(F.col("sources")), None, names)

    def precision_recall_f1(self, expected: list[str], actual: list[str]) -> tuple[float, float, float]:
        df = self.spark.createDataFrame([(expected, actual)], "e array<string>, a array<string>")
        return tuple(_one(df.select(checks.prf1(F.col("e"), F.col("a")).alias("m")).select("m.*")).values())

    def comprehensive(self, record: Mapping, expected: Mapping | None = None) -> dict:
        """Status, the check that failed or comprehensive, message, the record, and metrics against the expected one."""
        rows = [(record.get("target"), record.get("sources"), None if not expected else expected.get("sources"))]
        df = self.spark.createDataFrame(rows, "target string, actual array<string>, expected array<string>")
        r = _one(validate(df))
        out = {"status": r["status"], "validation_type": r["validation_type"], "message": r["message"], "result": dict(record)}
        return out | ({"metrics": r["metrics"]} if r["metrics"] is not None else {})


class LineageGraph:
    """A graph of lineage records; records can be added."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self._records = spark, []

    def build(self, records: Mapping | list[Mapping]) -> LineageGraph:
        self._records += [records] if isinstance(records, Mapping) else list(records)
        return self

    def edges(self) -> DataFrame:
        """(seq, src, tgt), in the order in which edges were first seen."""
        e = edges_of(lineage_records(self.spark, self._records), "seq")
        return e.select((F.col("row") * 100_000 + F.col("at")).alias("seq"), "src", "tgt")

    def nodes(self) -> dict[str, str]:
        """Each table's class; targets without sources too."""
        loose = lineage_records(self.spark, self._records).filter("target IS NOT NULL").select(F.col("target").alias("tgt"))
        return {r["node"]: r["kind"] for r in graph.classify(self.edges(), loose).collect()}

    def summary(self) -> dict:
        """Counts of tables, relationships and classes, their sorted names, and edges of a cycle if there is one."""
        e, kinds = self.edges(), self.nodes()
        n = {r["metric"]: r["value"] for r in graph.summary(e, graph.classify(e)).collect()}
        names = {k: sorted(x for x, kind in kinds.items() if kind == k) for k in ("source", "target", "intermediate")}
        return {"tables": n["tables"], "relationships": n["relationships"], **{f"{k}s": v for k, v in names.items()}, "cycle": graph.one_cycle(e)}

    def paths(self, source: str, target: str, max_paths: int = 5) -> list[list[str]]:
        return [r["path"] for r in graph.simple_paths(self.edges(), source, target, max_paths).orderBy("path_no").collect()]

    def view(self, target: str | None = None, depth: int | None = None, exclude_intermediates: bool = False) -> dict:
        """What a picture shows: title, nodes with colour and place, edges, legend."""
        nodes, shown = graph.lineage_view(self.edges(), target, depth, exclude_intermediates)
        rows = [r.asDict() for r in nodes.collect()]
        kinds = self.spark.createDataFrame([(r["node"], r["kind"]) for r in rows], "node string, kind string")
        legend = {r["entry"]: r["colour"] for r in graph.legend(kinds, target, exclude_intermediates).collect()}
        title = graph.title("Data Lineage", target, depth, exclude_intermediates)
        return {"title": title, "nodes": rows, "edges": [tuple(r) for r in shown.collect()], "legend": legend}

    def export_to_dot(self, path: str = "lineage.dot") -> str:
        return graph.write_dot(self.edges(), path)
