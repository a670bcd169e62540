"""Line-delimited records: articles, decomposed articles, tickets, results, raw ticket exports, with the checks of their keys.

Readers are lazy; check_unique() and require() run a job and raise InputError with an example.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from askwright.functions.masking import allowed_columns, clean_value
from askwright.functions.text import entity_form
from askwright.sources.tables import InputError

FICHE = "fiche_id string, client string, title string, text string, source string, meta map<string,string>"
STEP = (
    "struct<n:int,start:int,end:int,text:string,kind:string,role:string,level:int,condition:string,after_failure:boolean,on_failure:int,goto:int,"
    "instruction:string,entities:array<string>,refers_to:array<string>,sources:array<string>>"
)
DECOMPOSED = (
    "fiche_id string, client string, title string, source string, text string, text_sha256 string, status string, confidence string, reasons array<string>,"
    f"sections array<struct<title:string,role:string,start:int,end:int>>, steps array<{STEP}>, entities array<struct<canonical:string,kind:string,count:int>>,"
    "references array<string>, methods map<string,string>, checks map<string,int>, boilerplate_removed int, masked map<string,int>, version int"
)
TICKET = "ticket_id string, client string, text string, category string, expected array<string>, notes string, meta map<string,string>"
RESULT = (
    "engine string, run int, ticket_id string, client string, expected array<string>, kind string, fiches array<string>, titles map<string,string>, score double,"
    "question string, latency_s double, usage struct<input_tokens:int,output_tokens:int,search_calls:int>, error string,"
    "route struct<level:string,rule:string,key:string,fiche_id:string>, degraded string"
)
KINDS, LEVELS = ["fiche", "question", "abstain"], ["L0", "L1", "L2", "L3", "L4"]


def require(df: DataFrame, bad: Column, what: str) -> DataFrame:
    found = df.where(bad).limit(1).collect()
    if found:
        raise InputError(f"{what}: {found[0].asDict()}")
    return df


def check_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    twice = df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").limit(1).collect()
    if twice:
        raise InputError(f"duplicate {'/'.join(keys)}: {[twice[0][k] for k in keys]}")
    return df


def _json(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    rows = spark.read.schema(f"{schema}, _bad string").option("columnNameOfCorruptRecord", "_bad").json(paths).cache()
    return require(rows, F.col("_bad").isNotNull(), "not a record").drop("_bad")


def _blank(name: str) -> Column:
    return F.trim(F.coalesce(F.col(name), F.lit(""))) == ""


def read_fiches(spark: SparkSession, paths: str | list[str], client: str | None = None) -> DataFrame:
    """Articles; a missing client is the one given, a missing title the id; with a client, its articles only."""
    rows = _json(spark, paths, FICHE)
    require(rows, F.col("fiche_id").isNull() | F.col("text").isNull(), "not an article")
    named = rows.withColumn("client", F.coalesce(F.when(~_blank("client"), F.col("client")), F.lit(client))).withColumn("title", F.coalesce(F.when(~_blank("title"), F.col("title")), F.col("fiche_id")))
    require(named, F.col("client").isNull(), "no client")
    return named.where(F.col("client") == client) if client else named


def read_decomposed(spark: SparkSession, paths: str | list[str], client: str | None = None) -> DataFrame:
    rows = require(_json(spark, paths, DECOMPOSED), _blank("fiche_id"), "no id")
    return check_unique(rows.where(F.col("client") == client) if client else rows, ["client", "fiche_id"])


def read_tickets(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Labelled tickets: id, client and text are needed, and a ticket stands once; ids are trimmed, blank notes are null."""
    rows = require(_json(spark, paths, TICKET), _blank("ticket_id") | _blank("client") | _blank("text"), "a required field is missing")
    trimmed = rows.select(
        F.trim("ticket_id").alias("ticket_id"), F.trim("client").alias("client"), "text", F.when(~_blank("category"), F.trim("category")).alias("category"),
        F.array_distinct("expected").alias("expected"), F.when(~_blank("notes"), F.trim("notes")).alias("notes"), "meta",
    )
    return check_unique(trimmed, ["client", "ticket_id"])


def decision_problem() -> Column:
    """Why a decision is not one: kind, a shown fiche's id, the route's level."""
    return (
        F.when(~F.coalesce(F.col("kind").isin(KINDS), F.lit(False)), "unknown_kind")
        .when((F.col("kind") == "fiche") & (F.coalesce(F.size("fiches"), F.lit(0)) < 1), "no_fiche")
        .when(F.col("route.level").isNotNull() & ~F.col("route.level").isin(LEVELS), "unknown_level")
    )


def read_results(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Decision records of all files (a path may be a pattern); the required keys are there and each decision is one."""
    rows = _json(spark, paths, RESULT)
    missing = F.col("engine").isNull() | F.col("run").isNull() | F.col("ticket_id").isNull() | F.col("client").isNull() | F.col("fiches").isNull()
    return require(require(rows, missing, "is this a results file?"), decision_problem().isNotNull(), "not a decision")


def labels_of(rows: DataFrame) -> DataFrame:
    """rows: id, expected (JSON text), skipped.  Labels that can be read; skipped rows and malformed ones are left out."""
    return rows.where(~F.coalesce("skipped", F.lit(False))).select("id", F.from_json("expected", "array<string>").alias("expected")).where("expected is not null")


def references_of(rows: DataFrame, most: int = 500) -> DataFrame:
    """rows: id, text, expected.  Reference questions: ids that begin with 'ref-', text on one line and cut."""
    text = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))
    good = rows.where(F.col("id").rlike(r"^ref-[\w-]+$") & (text != ""))
    return labels_of(good.withColumn("skipped", F.lit(False))).join(good.select("id", text.substr(1, most).alias("text")), "id")


def scrub_export(rows: DataFrame, id_col: str, order_col: str, kept: list[str], free: list[str], persons: list[str]) -> tuple[DataFrame, list[str]]:
    """A raw ticket export (all strings): rows whose id is one, the first of each id by order_col, kept columns cleaned with the
    names of the row's person columns, which go.  Returns the tickets and the unknown columns, which are dropped too.

    Header names are compared without case and accents.
    """
    form = {c: c for c in rows.columns}
    keep, unknown = allowed_columns(list(form), kept, [*persons, id_col, order_col])
    w = Window.partitionBy(F.trim(id_col)).orderBy(order_col)
    valid = rows.where(F.trim(F.coalesce(F.col(id_col), F.lit(""))).rlike(r"^I\d+[A-Za-z0-9_-]*$")).withColumn("__k", F.row_number().over(w)).where("__k = 1")
    people = F.array(*[F.col(p) for p in persons]) if persons else None
    return valid.select(F.trim(id_col).alias("ticket_id"), *[clean_value(F.coalesce(F.col(c), F.lit("")), people=people, free=c in free).alias(c) for c in keep]), unknown


def resolve_headers(found: list[str], wanted: list[str], spark: SparkSession) -> dict[str, str]:
    """wanted name -> the found header of the same name without case and accents."""
    forms = spark.createDataFrame([(c,) for c in [*found, *wanted]], "c string").select("c", entity_form(F.col("c")).alias("f")).collect()
    of = {r.c: r.f for r in forms}
    return {w: next((c for c in found if of[c] == of[w]), None) for w in wanted}
