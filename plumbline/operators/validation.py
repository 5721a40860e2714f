"""Accuracy against ground truth: verdicts, facts and their citations."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.paths import indexed
from plumbline.operators.relational import confusion


VERDICTS = ["pass", "fail", "unknown", "not_applicable"]


class LabelError(ValueError):
    """A label that can't be used."""


def labels_of(documents: Iterable[tuple[str, object]]) -> tuple[list[tuple], list[tuple]]:
    """Rows (device_id, ir_path, value, line) and (device_id, rule_id, expected) of parsed label documents.

    A document names its ``config_id`` and holds ``ir_facts`` (path: {value, line}) and
    ``expected_verdicts`` (rule: verdict); lists are joined as facts are compared, by commas.
    """
    facts, verdicts = [], []
    for name, raw in documents:
        if not isinstance(raw, dict) or not raw.get("config_id"):
            raise LabelError(f"{name}: a label needs a config_id")
        for path, fact in (raw.get("ir_facts") or {}).items():
            if not isinstance(fact, dict) or "value" not in fact:
                raise LabelError(f"{name}: {path} needs a value")
            v = fact["value"]
            text = None if v is None else ",".join(map(str, v)) if isinstance(v, list) else str(v).lower() if isinstance(v, bool) else str(v)
            facts.append((str(raw["config_id"]), str(path), text, fact.get("line")))
        for rule, verdict in (raw.get("expected_verdicts") or {}).items():
            if verdict not in VERDICTS:
                raise LabelError(f"{name}: {rule} can't be {verdict!r}")
            verdicts.append((str(raw["config_id"]), str(rule), str(verdict)))
    return facts, verdicts


FACT_LABEL, VERDICT_LABEL = "device_id string, ir_path string, value string, line int", "device_id string, rule_id string, expected string"


_LABEL = "config_id string, ir_facts map<string,struct<value:variant,line:int>>, expected_verdicts map<string,string>"


def labels(files: DataFrame) -> DataFrame:
    """file, device_id, kind (fact or verdict), name, value, line, error of label files in JSON (file, text).

    What ``labels_of`` makes of parsed documents, on executors.  A file that isn't JSON or names no ``config_id`` is one
    row with ``error``, as is each fact without a value (a null is one) and each verdict of another name; the rest of
    such a file counts.  Facts and verdicts that are null or empty give no rows; a file that comes twice is read twice."""
    rows = files.select("file", F.from_json("text", _LABEL, {"mode": "PERMISSIVE"}).alias("d")).select("file", "d.*")
    named = F.coalesce("config_id", F.lit("")) != ""
    lost = rows.where(~named).select("file", F.lit("a label needs a config_id").alias("error"))
    facts = rows.where(named).select("file", F.col("config_id").alias("device_id"), F.explode("ir_facts").alias("name", "f"))
    value = F.col("f.value")
    text = F.coalesce(F.array_join(F.try_variant_get(value, "$", "array<string>"), ","), F.try_variant_get(value, "$", "string"))
    valued = facts.select("file", "device_id", F.lit("fact").alias("kind"), "name", text.alias("value"), F.col("f.line").alias("line"), F.when(value.isNull(), F.concat("name", F.lit(" needs a value"))).alias("error"))
    expected = rows.where(named).select("file", F.col("config_id").alias("device_id"), F.explode("expected_verdicts").alias("name", "value"))
    wrong = ~F.coalesce(F.col("value").isin(*VERDICTS), F.lit(False))
    said = expected.select("file", "device_id", F.lit("verdict").alias("kind"), "name", F.when(~wrong, F.col("value")).alias("value"), F.lit(None).cast("int").alias("line"), F.when(wrong, F.concat("name", F.lit(" can't be "), F.coalesce("value", F.lit("null")))).alias("error"))
    return valued.unionByName(said).unionByName(lost, allowMissingColumns=True)


def fact_labels(found: DataFrame) -> DataFrame:
    """The facts of ``labels`` as ``fact_accuracy`` takes them."""
    return found.where("kind = 'fact' and error is null").select("device_id", F.col("name").alias("ir_path"), "value", "line")


def verdict_labels(found: DataFrame) -> DataFrame:
    """The verdicts of ``labels`` as ``verdicts`` takes them."""
    return found.where("kind = 'verdict' and error is null").select("device_id", F.col("name").alias("rule_id"), F.col("value").alias("expected"))


def verdicts(found: DataFrame, labels: DataFrame) -> DataFrame:
    """One row of counts and rates over labels (device_id, rule_id, expected).

    A label ``unknown`` or ``not_applicable`` counts for agreement only through equal verdicts.
    """
    rows = labels.join(found.select("device_id", "rule_id", "verdict"), ["device_id", "rule_id"], "left")
    sharp = rows.where("expected in ('pass', 'fail')")
    said = F.when(F.col("verdict").isin("pass", "fail"), F.col("verdict") == "fail")
    same = rows.agg(F.bround(F.avg((F.col("expected") == F.coalesce("verdict", F.lit("absent"))).cast("double")), 6).alias("verdict_agreement"), F.bround(F.avg((F.coalesce("verdict", F.lit("unknown")) == "unknown").cast("double")), 6).alias("verdict_unknown_rate"))
    return confusion(sharp, F.col("expected") == "fail", said).crossJoin(same)


def fact_accuracy(facts: DataFrame, labels: DataFrame) -> DataFrame:
    """One row over labels (device_id, ir_path, value, line): values right, citations right.

    A null value holds if nothing was written; list values are compared as their joined members, and members of
    lists have an index in their path (``interfaces[0].name``).
    """
    order = F.struct("file", "line_no", "sub")
    own = indexed(facts)
    scalar = own.where("op = 'set'").groupBy("device_id", "ir_path").agg(F.max_by("value", order).alias("said"), F.max_by("line_no", order).alias("at"))
    listed = own.where("op = 'append'").groupBy("device_id", "ir_path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), "value"))), lambda x: x["value"]), ",").alias("said"), F.min_by("line_no", order).alias("at"))
    rows = labels.join(scalar.unionByName(listed), ["device_id", "ir_path"], "left")
    right = F.col("value").eqNullSafe(F.col("said"))
    cited = F.col("line").isNotNull() & right
    return rows.agg(
        F.count("*").alias("facts"), F.count_if(right).alias("right"), F.bround(F.coalesce(F.try_divide(F.count_if(right).cast("double"), F.count("*")), F.lit(0.0)), 6).alias("fact_accuracy"),
        F.bround(F.coalesce(F.try_divide(F.count_if(cited & (F.col("line") == F.col("at"))).cast("double"), F.count_if(cited)), F.lit(0.0)), 6).alias("citation_agreement"),
    )


def mean_coverage(coverage: DataFrame) -> DataFrame:
    """The mean of the devices' rounded percentages."""
    return coverage.agg(F.bround(F.avg("percent"), 1).alias("mean_coverage"))
