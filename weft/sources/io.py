"""Sources and sinks: annotation sets, analysis results, photos, vocabularies, reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions.rules import Rule
from weft.functions.text import MAX_UPLOAD, upload_verdict
from weft.schemas import ANALYSIS, ANNOTATIONS, IMAGE

REQUIRED_ATTRIBUTES = ["category", "material", "pattern", "style"]
#: Rows of a report that may be collected.
MAX_REPORT_ROWS = 10_000


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """One row an image; the split defaults to val; a byte-order mark is tolerated."""
    images = spark.read.schema(ANNOTATIONS).option("multiLine", True).json(path).select(F.explode("images").alias("i"))
    return images.select("i.*").withColumn("split", F.coalesce("split", F.lit("val")))


def write_annotations(df: DataFrame, path: str) -> None:
    """JSON lines, an image a line, nulls kept."""
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).write.text(path)


def write_annotation_document(df: DataFrame, path: str, version: int = 1) -> None:
    """An annotation set as the one document that read_annotations() reads; for a set of at most MAX_REPORT_ROWS images (larger ones as lines)."""
    rows = [json.loads(r[0]) for r in df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})).limit(MAX_REPORT_ROWS + 1).collect()]
    if len(rows) > MAX_REPORT_ROWS:
        raise ValueError("an annotation document has few images; write this set as lines")
    text = json.dumps({"version": version, "images": rows}, ensure_ascii=False, indent=2)
    df.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """vocabulary() of a YAML or JSON file: {"attributes": {name: {"labels": [{"value", "prompt", "group"}], "confidence_cap", "enabled"}}}; attributes that are not enabled are left out."""
    entries = {}
    for name, spec in (_payload(spark, path).get("attributes") or {}).items():
        if spec.get("enabled", True) or name in REQUIRED_ATTRIBUTES:
            entries[name] = [{"label": x["value"], "prompt": x.get("prompt"), "group": x.get("group", "other"), "cap": float(spec.get("confidence_cap", 1.0))} for x in spec.get("labels") or []]
    return vocabulary(spark, entries)


def read_detector_groups(spark: SparkSession, path: str) -> dict[str, str]:
    """The detector's labels and their coarse groups, for coarse_label(), from the same file."""
    return {str(k).strip().lower(): v for k, v in (_payload(spark, path).get("detector_group_map") or {}).items()}


def read_rules(spark: SparkSession, path: str) -> list[Rule]:
    """Consistency rules of a YAML or JSON file: {"rules": [{"code", "severity", "penalty", "when", "require", "message"}]}, in order."""
    return [Rule(x["code"], x.get("severity", "error"), float(x.get("penalty", 0.1)), x.get("when") or {}, x.get("require") or {}, x.get("message", "")) for x in _payload(spark, path).get("rules") or []]


def read_material_groups(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """Groups of materials, by name, from a file of rules."""
    return {k: list(v) for k, v in (_payload(spark, path).get("material_groups") or {}).items()}


def _payload(spark: SparkSession, path: str) -> dict:
    """What a configuration file holds: JSON if it begins as such, YAML otherwise."""
    text = _whole_text(spark, path)
    if text.lstrip().startswith("{") and path.endswith(".json"):
        return json.loads(text)
    try:
        import yaml
    except ImportError as missing:
        raise ImportError(f"reading {path} needs PyYAML; a .json file does not") from missing
    return yaml.safe_load(text) or {}


def _whole_text(spark: SparkSession, path: str) -> str:
    """A small configuration file, by any path that Spark reads."""
    return spark.read.text(path, wholetext=True).first()[0].removeprefix("\ufeff")


def read_annotation_lines(spark: SparkSession, path: str) -> DataFrame:
    """What write_annotations() wrote."""
    return spark.read.schema(IMAGE).json(path)


def read_images(spark: SparkSession, path: str, decode: bool = True) -> DataFrame:
    """Photos of a folder: decoded (BGR bytes) or as stored."""
    return spark.read.format("image").load(path).select("image.*") if decode else spark.read.format("binaryFile").load(path)


def admit_uploads(df: DataFrame, content: str = "content", max_bytes: int = MAX_UPLOAD) -> DataFrame:
    """Adds admission: ok, empty, too_large or unsupported."""
    return df.withColumn("admission", upload_verdict(F.col(content), max_bytes))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ANALYSIS).json(path)


def flatten_results(results: DataFrame) -> DataFrame:
    """One row a garment, and one for each photo without any: request_id, success, reason, position, item.*"""
    rows = results.select("request_id", "success", "reason", F.posexplode_outer("items").alias("position", "item"))
    return rows.select("request_id", "success", "reason", "position", "item.*")


def predictions_long(garments: DataFrame) -> DataFrame:
    """request_id, id, attribute, label, score: every score of every head, with the head's own value and confidence."""
    heads = F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(f"attributes.{a}.value").alias("value"), F.col(f"attributes.{a}.confidence").alias("confidence"), F.col(f"attributes.{a}.scores").alias("scores")) for a in REQUIRED_ATTRIBUTES])
    rows = garments.select("request_id", "id", F.explode(heads).alias("h")).where("h.value is not null")
    return rows.select("request_id", "id", "h.attribute", "h.value", "h.confidence", F.explode_outer("h.scores").alias("label", "score"))


def vocabulary(spark: SparkSession, entries: dict[str, list[dict]]) -> DataFrame:
    """attribute, idx, label, grp, prompt, cap from a parsed vocabulary; raises if a needed attribute or its labels are missing."""
    missing = [a for a in REQUIRED_ATTRIBUTES if a not in entries]
    empty = [a for a, labels in entries.items() if not labels]
    if missing or empty:
        raise ValueError(f"vocabulary lacks attributes {missing} and labels of {empty}")
    rows = [(a, i, x["label"], x.get("group", "other"), x.get("prompt"), float(x.get("cap", 1.0))) for a, labels in entries.items() for i, x in enumerate(labels)]
    return spark.createDataFrame(rows, "attribute string, idx int, label string, grp string, prompt string, cap double")


def write_report(report: DataFrame, path: str) -> None:
    """A small report as one JSON document in the folder `path`, by any path that Spark writes; larger tables go to Parquet."""
    rows = [json.loads(r[0]) for r in report.select(F.to_json(F.struct("*"))).limit(MAX_REPORT_ROWS + 1).collect()]
    if len(rows) > MAX_REPORT_ROWS:
        raise ValueError("a report has few rows; write this table as Parquet")
    text = json.dumps(rows, ensure_ascii=False, indent=1)
    report.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
