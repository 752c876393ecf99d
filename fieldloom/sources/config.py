"""Content-type definitions: one YAML file per category."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

# Fixed value: validation prompt of fields that declare none.
DEFAULT_VALIDATE_PROMPT = """Prüfe den extrahierten Wert auf Plausibilität und Qualität.

Extrahierter Wert: {raw_result}

Bewerte:
1. Ist der Wert syntaktisch korrekt (keine HTML-Tags, keine Artefakte)?
2. Ist der Wert inhaltlich plausibel für das Feld?
3. Ist der Wert vollständig oder abgeschnitten?

Antworte NUR in diesem Format:
QUALITY: HIGH | MEDIUM | LOW | INSUFFICIENT
SCORE: 0.0-1.0
NOTES: Kurze Begründung
RESULT: Der bereinigte/korrigierte Wert (oder der Original-Wert wenn korrekt)"""

_SCHEMA = (
    "config string, error string, internal_name string, display_name string, display_name_en string, template string, "
    "field_groups map<string,array<string>>, active_groups array<string>, "
    "prompts array<struct<internal_name:string,display_name:string,display_name_en:string,field_group:string,prompt_template:string,"
    "extract_prompt:string,validate_prompt:string,output_format:string,field_type:string,required_confidence:double,max_retries:int,"
    "entity_type:string,translatable:boolean,translation_context:string>>"
)
_PROMPT_KEYS = (
    "internal_name display_name display_name_en field_group prompt_template extract_prompt validate_prompt output_format "
    "field_type required_confidence max_retries entity_type translatable translation_context"
).split()


def _parse(name: str, text: str) -> dict:
    import yaml

    row = dict.fromkeys(("config", "error", "internal_name", "display_name", "display_name_en", "template", "field_groups", "active_groups", "prompts"))
    row["config"] = name
    try:
        data = yaml.safe_load(text) or {}
        category = data.get("category")
        if category is None:
            row["error"] = "missing category section"
            return row
        for name in ("internal_name", "display_name", "display_name_en", "active_groups"):
            row[name] = category.get(name)
        row["template"] = category.get("steckbrief_template")
        groups = category.get("field_groups")
        row["field_groups"] = None if groups is None else {k: list(v or []) for k, v in groups.items()}
        prompts = data.get("prompts")
        row["prompts"] = None if prompts is None else [{k: p.get(k) for k in _PROMPT_KEYS} for p in prompts]
    except Exception as problem:  # a broken file is a row of its own
        row["error"] = str(problem).split("\n")[0]
    return row


def write_category_configs(definitions: DataFrame, folder: str) -> None:
    """One file per row of ``definitions`` (config, text), in a folder named by ``config``, which is unique."""
    rows = definitions.select("config", "text").repartition("config")
    rows.write.mode("overwrite").partitionBy("config").text(folder)


def read_category_configs(spark: SparkSession, folder: str, written: bool = False) -> DataFrame:
    """One row per definition with nested groups and prompts; unreadable files carry ``error``.

    A definition is a file ``*.yaml`` of the folder, or what ``write_category_configs`` wrote to it.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([_parse(name, text) for name, text in zip(batch["name"], batch["value"])])

    if written:
        files = spark.read.schema("value string, config string").text(folder, wholetext=True).select(F.col("config").alias("name"), "value")
    else:
        files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.yaml").select(
            F.element_at(F.split("_metadata.file_path", "/"), -1).alias("name"), "value")
    return files.mapInPandas(parse, _SCHEMA)


def declared_categories(configs: DataFrame) -> DataFrame:
    return configs.where("error IS NULL").select("config", "internal_name", "display_name", "display_name_en", "template", "field_groups", "active_groups")


def declared_prompts(configs: DataFrame) -> DataFrame:
    """One row per prompt with defaults filled; display_order is 10 x position."""
    rows = configs.where("error IS NULL").select("config", F.col("internal_name").alias("category"), F.posexplode("prompts").alias("pos", "p"))
    return rows.select(
        "config", "category", "p.internal_name", "p.display_name", "p.display_name_en", "p.field_group",
        F.coalesce("p.prompt_template", "p.extract_prompt", F.lit("")).alias("extract_prompt"),
        F.coalesce("p.validate_prompt", F.lit(DEFAULT_VALIDATE_PROMPT)).alias("validate_prompt"),
        F.coalesce("p.output_format", "p.field_type", F.lit("text")).alias("field_type"),
        F.coalesce("p.required_confidence", F.lit(0.6)).alias("required_confidence"), F.coalesce("p.max_retries", F.lit(3)).alias("max_retries"),
        "p.entity_type", F.coalesce("p.translatable", F.lit(True)).alias("translatable"), "p.translation_context",
        ((F.col("pos") + 1) * 10).alias("display_order"))


def config_tables(configs: DataFrame) -> dict[str, DataFrame]:
    """Row tables that ``operators.configuration.validate_config`` checks."""
    good = configs.where("error IS NULL")
    prompts = good.select("config", F.posexplode("prompts").alias("position", "p")).select("config", "position", "p.*")
    groups = good.select("config", F.explode("field_groups").alias("group_name", "fields"))
    return {
        "categories": good.select("config", "internal_name", "display_name", "template", F.col("field_groups").isNotNull().alias("has_groups"), F.col("active_groups").isNotNull().alias("has_active")),
        "prompts": prompts.select("config", "position", "internal_name", "display_name", "field_group", "prompt_template", "extract_prompt"),
        "groups": groups.select("config", "group_name", F.explode_outer("fields").alias("field")),
        "active": good.select("config", F.explode("active_groups").alias("group_name")),
        "unreadable": configs.where("error IS NOT NULL").select("config", "error"),
    }
