"""Templates: stored as JSON, one file each; read, listed, checked as data."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Names that the data sheet uses itself.
RESERVED = ("data", "summary", "source_file", "parsed_at")
KINDS = ("text", "number", "date", "currency")
MOST_NAME, MOST_DESCRIPTION, SHOWN = 100, 300, 3
SCHEMA = "name string, prompt_description string, fields array<struct<name string, type string, description string, optional boolean, number_locale string>>, examples map<string,string>, provider map<string,string>, run_options map<string,string>"


@dataclass(frozen=True)
class Field:
    name: str
    kind: str = "text"
    optional: bool = False
    locale: str = "vi-VN"
    description: str = ""


@dataclass(frozen=True)
class Template:
    name: str
    prompt_description: str = ""
    fields: tuple[Field, ...] = ()
    examples: dict = field(default_factory=dict)
    provider: dict = field(default_factory=dict)
    run_options: dict = field(default_factory=dict)


def problem(t: Template) -> str | None:
    """What is wrong with a template's structure, the first thing only."""
    if not isinstance(t.name, str) or not t.name.strip():
        return "Template name must be a non-empty string"
    if not isinstance(t.prompt_description, str):
        return "Template prompt description must be a string"
    if not t.fields:
        return "Template must have at least one field"
    if len({f.name for f in t.fields}) != len(t.fields):
        return "Template field names must be unique"
    for i, f in enumerate(t.fields, 1):
        if not isinstance(f.name, str) or not f.name.strip():
            return f"Field {i} name must be a non-empty string"
        if not isinstance(f.description, str):
            return f"Field {i} description must be a string"
    return None


def _safe(name: str) -> str:
    return ("".join("_" if c in '<>:"/\\|?*' else c for c in name).strip(" .") or "untitled")[:200]


class Store:
    """Templates in a folder of the driver, one JSON file each, written whole or not at all."""

    def __init__(self, folder: str):
        self.folder = Path(folder)

    def path(self, name: str) -> Path:
        return self.folder / f"{_safe(name)}.json"

    def save(self, t: Template) -> Path:
        wrong = problem(t)
        if wrong:
            raise ValueError(wrong)
        data = asdict(t) | {"fields": [{"name": f.name, "type": f.kind, "description": f.description, "optional": f.optional, "number_locale": f.locale} for f in t.fields]}
        self.folder.mkdir(parents=True, exist_ok=True)
        part = self.path(t.name).with_suffix(".part")
        part.write_text(json.dumps(data, ensure_ascii=False, indent=2), encoding="utf-8")
        os.replace(part, self.path(t.name))
        return self.path(t.name)

    def load(self, name: str) -> Template | None:
        """None if there is none of that name; a file that cannot be read as a template is a ValueError."""
        if not name or not self.path(name).exists():
            return None
        try:
            d = json.loads(self.path(name).read_text(encoding="utf-8"))
            fields = tuple(Field(f["name"], f.get("type", "text"), bool(f.get("optional", False)), f.get("number_locale", "vi-VN"), f.get("description", "")) for f in d["fields"])
            t = Template(d["name"], d.get("prompt_description", ""), fields, d.get("examples", {}), d.get("provider", {}), d.get("run_options", {}))
        except (KeyError, TypeError, json.JSONDecodeError, AttributeError) as e:
            raise ValueError(f"{self.path(name)} is no template: {e}") from e
        wrong = problem(t) or next((f"unknown type {f.kind}" for f in t.fields if f.kind not in KINDS), None)
        if wrong:
            raise ValueError(wrong)
        return t

    def names(self) -> list[str]:
        return sorted(p.stem for p in self.folder.glob("*.json"))

    def exists(self, name: str) -> bool:
        return bool(name) and self.path(name).exists()

    def delete(self, name: str) -> bool:
        if not self.exists(name):
            return False
        self.path(name).unlink()
        return True

    def duplicate(self, name: str, new: str) -> Template:
        t = self.load(name)
        if t is None:
            raise ValueError(f"no template {name}")
        if self.exists(new):
            raise ValueError(f"there is a template {new}")
        copy = Template(new, t.prompt_description, t.fields, t.examples, t.provider, t.run_options)
        self.save(copy)
        return copy


def catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """(stem, name, description, field_count, file_size, modified) of every template file, by stem; one that is no JSON is left out."""
    files = spark.read.schema(SCHEMA + ", _broken string").option("multiLine", "true").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").option("pathGlobFilter", "*.json").json(folder)
    stem = F.regexp_replace(F.regexp_replace("_metadata.file_name", r"\.json$", ""), "%20", " ")
    rows = files.select(stem.alias("stem"), F.col("_metadata.file_size").alias("file_size"), F.col("_metadata.file_modification_time").alias("modified"), "name", "prompt_description", "fields", "_broken")
    return rows.where("_broken is null").select("stem", F.coalesce("name", "stem").alias("name"), F.coalesce("prompt_description", F.lit("")).alias("description"), F.coalesce(F.size("fields"), F.lit(0)).alias("field_count"), "file_size", "modified").orderBy("stem")


def saved_states(spark: SparkSession, folder: str) -> DataFrame:
    """(path, session_id, saved_at, progress, current_file, remaining_files, file_size) of each saved state, the newest first; files that
    cannot be read are left out."""
    schema = "saved_at double, metadata struct<session_id string, progress double, current_file string, remaining_files long>, _broken string"
    files = spark.read.schema(schema).option("multiLine", "true").option("columnNameOfCorruptRecord", "_broken").option("pathGlobFilter", "processing_state_*.json").json(folder)
    rows = files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("file_size"), "saved_at", "metadata", "_broken").where("_broken is null")
    return rows.select("path", F.coalesce("metadata.session_id", F.lit("unknown")).alias("session_id"), F.coalesce("saved_at", F.lit(0.0)).alias("saved_at"), F.coalesce("metadata.progress", F.lit(0.0)).alias("progress"), F.coalesce("metadata.current_file", F.lit("")).alias("current_file"), F.coalesce("metadata.remaining_files", F.lit(0)).alias("remaining_files"), "file_size").orderBy(F.desc("saved_at"), "path")


def structural_problem(name: str = "template") -> Column:
    """Of the columns `name`, prompt_description and fields (array<struct<name, description, ...>>): what is wrong with a template's structure, the
    first thing only; null if nothing is."""
    names = F.transform("fields", lambda f: f["name"])
    bad = lambda test: F.filter(F.transform("fields", lambda f, i: F.when(test(f), i + 1)), lambda i: i.isNotNull())
    nameless, plain = bad(lambda f: f["name"].isNull() | (F.trim(f["name"]) == "")), bad(lambda f: f["description"].isNull())
    # a field's name is looked at before its description, fields in their order
    first_name, first_text = (F.coalesce(F.get(x, F.lit(0)), F.lit(2**31 - 1)) for x in (nameless, plain))
    # The messages.
    return (
        F.when(F.coalesce(F.trim(name), F.lit("")) == "", "Template name must be a non-empty string")
        .when(F.col("prompt_description").isNull(), "Template prompt description must be a string")
        .when(F.coalesce(F.size("fields"), F.lit(0)) <= 0, "Template must have at least one field")
        .when(F.size(F.array_distinct(names)) < F.size(names), "Template field names must be unique")
        .when((F.size(nameless) > 0) & (first_name <= first_text), F.concat(F.lit("Field "), first_name.cast("string"), F.lit(" name must be a non-empty string")))
        .when(F.size(plain) > 0, F.concat(F.lit("Field "), first_text.cast("string"), F.lit(" description must be a string")))
    )


def structural_problems(templates: DataFrame) -> DataFrame:
    """templates(template, prompt_description, fields): (template, problem) of those that may not be saved."""
    return templates.select("template", structural_problem().alias("problem")).where("problem is not null")


def template_files(spark: SparkSession, folder: str) -> DataFrame:
    """Every template file as a row: stem, the columns of SCHEMA, and problem: that it is no JSON, what is wrong with its structure, or a type that
    there is none of; null for one that can be used. A field without a type is text, without a locale vi-VN, without a description empty."""
    files = spark.read.schema(SCHEMA + ", _broken string").option("multiLine", "true").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").option("pathGlobFilter", "*.json").json(folder)
    stem = F.regexp_replace(F.regexp_replace("_metadata.file_name", r"\.json$", ""), "%20", " ")
    filled = F.transform("fields", lambda f: F.struct(f["name"].alias("name"), F.coalesce(f["type"], F.lit("text")).alias("type"), F.coalesce(f["description"], F.lit("")).alias("description"), F.coalesce(f["optional"], F.lit(False)).alias("optional"), F.coalesce(f["number_locale"], F.lit("vi-VN")).alias("number_locale")))
    rows = files.select(stem.alias("stem"), "name", F.coalesce("prompt_description", F.lit("")).alias("prompt_description"), filled.alias("fields"), "examples", "provider", "run_options", "_broken")
    unknown = F.get(F.filter(F.transform("fields", lambda f: f["type"]), lambda t: ~t.isin(*KINDS)), F.lit(0))
    problem_ = F.when(F.col("_broken").isNotNull(), "The file is no template").otherwise(F.coalesce(structural_problem("name"), F.concat(F.lit("unknown type "), unknown)))
    return rows.withColumn("problem", problem_).drop("_broken")


def editor_errors(fields: DataFrame) -> DataFrame:
    """fields(template, pos from 0, name, kind, description, locale): (template, pos, part, message) of what an editor rejects. Of a name the
    first rule counts; a name that was accepted earlier in the same template, whatever its case, is taken."""
    # The messages.
    name = F.trim(F.coalesce("name", F.lit("")))
    rows = fields.withColumn("_name", name).withColumn("_key", F.lower("_name"))
    own = F.when(F.col("_name") == "", "Tên trường không được để trống").when(F.length("_name") > MOST_NAME, F.concat(F.lit("Tên trường quá dài ("), F.length("_name").cast("string"), F.lit(f"/{MOST_NAME} ký tự)"))).when(F.col("_key").isin(*RESERVED), F.concat(F.lit('Tên trường "'), "_name", F.lit('" là từ khóa dành riêng')))
    rows = rows.withColumn("_own", own)
    nth = F.sum(F.when(F.col("_own").isNull(), 1).otherwise(0)).over(Window.partitionBy("template", "_key").orderBy("pos"))
    about_name = F.coalesce("_own", F.when(F.col("_nth") > 1, F.concat(F.lit('Tên trường "'), "_name", F.lit('" đã tồn tại'))))
    n = F.length(F.coalesce("description", F.lit("")))
    about_text = F.when(n > MOST_DESCRIPTION, F.concat(F.lit("Mô tả quá dài ("), n.cast("string"), F.lit(f"/{MOST_DESCRIPTION} ký tự)")))
    about_locale = F.when((F.col("kind") == "currency") & (F.trim(F.coalesce("locale", F.lit(""))) == ""), "Locale không được để trống cho trường currency")
    said = F.array(*(F.when(m.isNotNull(), F.struct(F.lit(i).alias("order"), F.lit(part).alias("part"), m.alias("message"))) for i, (part, m) in enumerate((("name", about_name), ("description", about_text), ("locale", about_locale)))))
    return rows.withColumn("_nth", nth).select("template", "pos", F.explode(F.array_compact(said)).alias("x")).select("template", "pos", "x.part", "x.message", "x.order")


def error_banner(errors: DataFrame) -> DataFrame:
    """(template, banner): the first errors of each template as one line, and how many more there are. Each task keeps the first few."""
    order = Window.partitionBy("template").orderBy("pos", "order")
    first = errors.withColumn("r", F.row_number().over(order)).where(f"r <= {SHOWN}")
    said = first.groupBy("template").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", F.concat(F.lit("Row "), (F.col("pos") + 1).cast("string"), F.lit(": "), "message").alias("m")))), lambda x: x["m"]), " • ").alias("said"))
    more = errors.groupBy("template").agg((F.count("*") - SHOWN).alias("more"))
    return said.join(more, "template").select("template", F.when(F.col("more") > 0, F.concat("said", F.lit(" • and "), F.col("more").cast("string"), F.lit(" more..."))).otherwise(F.col("said")).alias("banner"))
