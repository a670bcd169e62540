"""What a model answered, read as data: proposals as VARIANT columns, and the documents that it selected; and a scoring profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from askwright.operators.graph import written

MOST_CHARS = 60_000  # a longer text is not sent to a model
SECTION_ROLES = ["symptom", "cause", "prerequisite", "resolution", "workaround", "escalation", "info", "other"]
STEP_ROLES = ["prerequisite", "resolution", "workaround", "escalation", "other"]
WEIGHTS = {"title": 3.0, "entities": 5.0, "chunk": 1.0}
BOOST = 4.0


def _said(item: Column, name: str) -> Column:
    """A field that is a string with something in it, trimmed; else null."""
    value = F.try_variant_get(item, f"$.{name}", "variant")
    text = F.when(F.schema_of_variant(value) == "STRING", F.trim(F.try_variant_get(item, f"$.{name}", "string")))
    return F.when(text != "", text)


def _items(answers: DataFrame, name: str) -> DataFrame:
    """id, ord, item: the elements of a list of the answers; what is no list has none."""
    read = answers.where(F.length("text") <= MOST_CHARS).select("id", F.try_variant_get(F.try_parse_json("answer"), f"$.{name}", "array<variant>").alias("items"))
    return read.select("id", F.posexplode("items").alias("ord", "item"))


def _object(item: Column) -> Column:
    return F.coalesce(F.schema_of_variant(item).startswith("OBJECT"), F.lit(False))


def proposed_steps(answers: DataFrame) -> DataFrame:
    """id, ord, quote, kind, role, condition, failure, instruction, malformed: the steps that answers propose.

    answers: id, text, answer (JSON: steps with quote, kind, section_role, condition, on_failure, instruction).  malformed says
    why an element is no step: not_an_object, no_quote or bad_kind; null for steps.  A role that steps do not have is `other`.
    An answer that is no JSON has no elements, nor has one about a text of over 60,000 characters.
    """
    item = F.col("item")
    kind, role = _said(item, "kind"), _said(item, "section_role")
    told = _items(answers, "steps").select(
        "id", "ord", _object(item).alias("object"), _said(item, "quote").alias("quote"), kind.alias("kind"), F.when(role.isin(STEP_ROLES), role).otherwise("other").alias("role"),
        _said(item, "condition").alias("condition"), _said(item, "on_failure").alias("failure"), _said(item, "instruction").alias("instruction"),
    )
    wrong = F.when(~F.col("object"), "not_an_object").when(F.col("quote").isNull(), "no_quote").when(~F.coalesce(F.col("kind").isin("check", "action"), F.lit(False)), "bad_kind")
    return told.withColumn("malformed", wrong).drop("object")


def proposed_sections(answers: DataFrame) -> DataFrame:
    """id, ord, heading, role, malformed: the headings that answers propose, malformed without a heading or a known role."""
    told = _items(answers, "sections").select("id", "ord", _said(F.col("item"), "heading").alias("heading"), _said(F.col("item"), "role").alias("role"))
    return told.withColumn("malformed", F.col("heading").isNull() | ~F.coalesce(F.col("role").isin(SECTION_ROLES), F.lit(False)))


def proposal_report(answers: DataFrame) -> DataFrame:
    """id, skipped, unreadable, steps, sections, malformed: one row an answer."""
    counted = lambda df, name, good: df.groupBy("id").agg(F.count(F.when(good, 1)).alias(name), F.count(F.when(~good, 1)).alias(f"bad_{name}"))
    steps = counted(proposed_steps(answers), "steps", F.col("malformed").isNull())
    sections = counted(proposed_sections(answers), "sections", ~F.col("malformed"))
    rows = answers.select("id", (F.length("text") > MOST_CHARS).alias("skipped"), F.try_parse_json("answer").isNull().alias("unreadable"))
    told = rows.join(steps, "id", "left").join(sections, "id", "left").na.fill(0, ["steps", "sections", "bad_steps", "bad_sections"])
    return told.select("id", "skipped", (~F.col("skipped") & F.col("unreadable")).alias("unreadable"), "steps", "sections", (F.col("bad_steps") + F.col("bad_sections")).alias("malformed"))


def chosen_documents(candidates: DataFrame, answers: DataFrame, annexes: DataFrame, most: int) -> DataFrame:
    """query, part, place, key, expanded: the documents that an answer is made from.

    candidates: query, place (from 1), parent, title; annexes: the same; answers: query, answer (JSON with `indexes`, from 1).
    A document's key is its parent, else its title.  Primaries are the candidates chosen, in the order of the answer, each once,
    whole numbers within range only, `most` at most after that; they are expanded to whole documents and are no annexes.  A
    single candidate is chosen whatever was answered; without a readable answer the first is.  Where the answer chooses none,
    the first candidate is shown as it is, beside all annexes.
    """
    key = F.coalesce(F.when(F.col("parent") != "", F.col("parent")), F.col("title"))
    known = candidates.select("query", "place", key.alias("key"))
    sizes = known.groupBy("query").agg(F.count("*").alias("n"))
    read = sizes.join(answers, "query", "left").select("query", "n", F.try_parse_json("answer").alias("v"))
    listed = F.try_variant_get("v", "$.indexes", "array<variant>")
    whole = lambda x: F.when(F.schema_of_variant(x) == "BIGINT", F.try_variant_get(x, "$", "bigint"))
    said = F.array_distinct(F.filter(F.transform(F.coalesce(listed, F.expr("cast(array() as array<variant>)")), whole), lambda k: k.isNotNull() & (k >= 1) & (k <= F.col("n"))))
    picked = F.when((F.col("n") == 1) | F.col("v").isNull(), F.array(F.lit(1).cast("bigint"))).otherwise(F.slice(said, 1, most))
    told = read.select("query", picked.alias("picked"))
    chosen = told.select("query", F.posexplode("picked").alias("at", "place")).join(known, ["query", "place"]).select("query", (F.col("at") + 1).alias("place"), "key", F.lit(True).alias("expanded"))
    none = told.where(F.size("picked") == 0).join(known.where("place = 1"), "query").select("query", F.lit(1).alias("place"), "key", F.lit(False).alias("expanded"))
    beside = annexes.select("query", "place", key.alias("key")).join(chosen.select("query", "key"), ["query", "key"], "left_anti")
    place = F.row_number().over(Window.partitionBy("query").orderBy("place"))
    annex = beside.select("query", F.lit("annex").alias("part"), place.alias("place"), "key", F.lit(False).alias("expanded"))
    return chosen.unionByName(none).select("query", F.lit("primary").alias("part"), "place", "key", "expanded").unionByName(annex)


def profile_scores(fields: DataFrame, tags: DataFrame, asked: DataFrame, top: int, weights: dict[str, float] = WEIGHTS, boost: float = BOOST) -> DataFrame:
    """query, doc, score, boosted, rank: field scores by their weights, times a boost for the entities asked for.

    fields: query, doc, field, score; tags: doc, entity; asked: query, entity.  The boost grows linearly from 1 to `boost` with
    the share of a question's entities that a document carries; a question that names none has no boost.  Ties rank by doc.
    """
    weight = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    base = fields.where(F.col("field").isin(list(weights))).groupBy("query", "doc").agg(F.sum(F.col("score") * F.try_element_at(weight, F.col("field"))).alias("base"))
    base = written(base, "base")  # read twice
    asked = asked.select("query", "entity").distinct()
    wanted = asked.groupBy("query").agg(F.count("*").alias("wanted"))
    met = base.select("query", "doc").join(asked, "query").join(tags.select("doc", "entity").distinct(), ["doc", "entity"], "left_semi").groupBy("query", "doc").agg(F.count("*").alias("met"))
    told = base.join(wanted, "query", "left").join(met, ["query", "doc"], "left").withColumn("share", F.coalesce(F.col("met") / F.col("wanted"), F.lit(0.0)))
    scored = told.select("query", "doc", F.round(F.col("base"), 6).alias("score"), F.round(F.col("base") * (1 + (boost - 1) * F.col("share")), 6).alias("boosted"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("boosted"), "doc"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= top)
