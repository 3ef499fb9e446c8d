"""What there is to choose from, as small tables: options, modes, filters, suggestion modes, dictionaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.operators.filters import MODES, REGISTRY
from quillspark.operators.suggest import MODES as SUGGESTION_MODES
from quillspark.sources.dictionaries import catalogue
from quillspark.sources.options import OPTIONS, Options, join_list


def options(spark: SparkSession, current: Options | None = None) -> DataFrame:
    """key, type, default, value of each option; lists as text between colons."""
    current = current or Options({})

    def text(v: object) -> str:
        return join_list(v) if isinstance(v, tuple) else str(v).lower() if isinstance(v, bool) else str(v)

    return spark.createDataFrame([(k, kind, text(default), text(current[k])) for k, (kind, default) in OPTIONS.items()], "key string, type string, default string, value string")


def modes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(name, [f for f, _ in steps]) for name, steps in MODES.items()], "mode string, filters array<string>")


def filters(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f.name, float(f.order)) for f in REGISTRY.values()], "filter string, order double")


def suggestion_modes(spark: SparkSession) -> DataFrame:
    rows = [(m.name, list(m.scans), m.ngrams, m.soundslike_weight, m.typo_analysis, m.span, m.limit) for m in SUGGESTION_MODES.values()]
    return spark.createDataFrame(rows, "mode string, scans array<int>, ngrams boolean, soundslike_weight int, typo_analysis boolean, span int, `limit` int")


def dicts(spark: SparkSession, folder: str) -> DataFrame:
    """The catalogue of a folder's dictionaries, by file names alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder).select("path")
    names = [r[0].rsplit("/", 1)[-1] for r in files.toLocalIterator()]
    return catalogue(spark, names)
