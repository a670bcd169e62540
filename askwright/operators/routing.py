"""Routing by tables that people validated: levels L0 to L2, their builders and the ladder."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from askwright.functions.text import NEGATIONS


def current_decision(reviews: DataFrame, sources: DataFrame) -> DataFrame:
    """reviews: fiche_id, source_sha256, status, revision, decided_at; sources: fiche_id, sha.  The highest revision on the
    current text; `stale` if only other texts were decided, `proposed` if none was."""
    w = Window.partitionBy("fiche_id").orderBy(F.desc("revision"), F.desc("decided_at"), F.desc("status"))
    mine = reviews.join(sources, "fiche_id").where("source_sha256 = sha").withColumn("k", F.row_number().over(w)).where("k = 1")
    other = reviews.select("fiche_id").distinct().withColumn("any", F.lit(True))
    rows = sources.join(mine.select("fiche_id", "status", "revision"), "fiche_id", "left").join(other, "fiche_id", "left")
    return rows.select("fiche_id", F.coalesce("status", F.when(F.col("any"), "stale").otherwise("proposed")).alias("status"), "revision")


def alias_tables(aliases: DataFrame) -> DataFrame:
    """aliases: fiche_id, key (sorted routing tokens, joined), status.  One row a key: claimed by one validated fiche (l1), by
    several (collision), blocked by a fiche under review, or pending when nobody claims it yet."""
    ok = F.col("status") == "validated"
    per = aliases.groupBy("key").agg(F.array_sort(F.collect_set(F.when(ok, F.col("fiche_id")))).alias("claimed"), F.array_sort(F.collect_set(F.when(F.col("status") == "review", F.col("fiche_id")))).alias("waiting"))
    outcome = F.when(F.size("claimed") > 1, "collision").when((F.size("claimed") == 1) & (F.size("waiting") > 0), "blocked").when(F.size("claimed") == 1, "l1").when(F.size("waiting") > 0, "pending")
    return per.withColumn("outcome", outcome).where("outcome is not null")


def code_owners(codes: DataFrame) -> DataFrame:
    """codes: code, fiche.  Codes that one fiche alone holds."""
    return codes.groupBy("code").agg(F.countDistinct("fiche").alias("n"), F.min("fiche").alias("fiche")).where("n = 1").select("code", "fiche")


def identifier_scope(resolutions: DataFrame) -> DataFrame:
    """resolutions: query, identifier, fiche.  Fiches that all identifiers of a query share, and those of any."""
    n = resolutions.groupBy("query").agg(F.countDistinct("identifier").alias("n"))
    held = resolutions.groupBy("query", "fiche").agg(F.countDistinct("identifier").alias("k")).join(n, "query")
    return held.groupBy("query").agg(F.array_sort(F.collect_list(F.when(F.col("k") == F.col("n"), F.col("fiche")))).alias("shared"), F.array_sort(F.collect_list("fiche")).alias("any"))


def match_aliases(questions: DataFrame, entries: DataFrame, most_uncovered: int = 1) -> DataFrame:
    """questions: query, tokens; entries: fiche_id (null: it only blocks), alias, tokens, app (or '').

    An alias matches if all its tokens are in the question: an inverted index on tokens finds them (each entry by all its
    tokens, counted), so no question meets every alias.  The most specific match strictly includes all matches of other
    fiches and all blockers; then at most one token may be left, and no negation.
    """
    q = questions.select("query", F.col("tokens").alias("qt"))
    e = entries.withColumn("entry", F.xxhash64(F.coalesce("fiche_id", F.lit("")), "alias", F.array_join("tokens", " ")))
    counted = q.select("query", F.explode("qt").alias("t")).join(e.select("entry", F.size("tokens").alias("n"), F.explode("tokens").alias("t")), "t").groupBy("query", "entry", "n").agg(F.count("*").alias("k")).where("k = n")
    hits = counted.select("query", "entry").join(e, "entry")
    a = hits.where("fiche_id is not null").select("query", "entry", "fiche_id", "alias", "tokens", "app")
    b = hits.select("query", F.col("fiche_id").alias("f2"), F.col("tokens").alias("t2"))
    rival = a.join(b, "query").where("f2 is null or f2 <> fiche_id")
    beaten = rival.where(~((F.size(F.array_except("t2", "tokens")) == 0) & (F.size("t2") < F.size("tokens")))).select("query", "entry").distinct()
    winners = a.join(beaten, ["query", "entry"], "left_anti")
    w = Window.partitionBy("query").orderBy(F.desc(F.size("tokens")), F.array_join("tokens", " "), "alias")
    best = winners.withColumn("k", F.row_number().over(w)).where("k = 1").join(q, "query")
    left = F.array_except("qt", "tokens")
    decided = (F.size(left) <= most_uncovered) & ~F.arrays_overlap(left, F.array(*map(F.lit, NEGATIONS)))
    return best.select("query", "fiche_id", "alias", F.size(left).alias("uncovered"), decided.alias("decided"))


def lookup_intent(questions: DataFrame, table: DataFrame) -> DataFrame:
    """questions: query, intent, app ('' if none); table: intent, app, fiche, blocked.  exact, offer and the reason."""
    per = table.groupBy("intent", "app").agg(F.array_sort(F.collect_set("fiche")).alias("fiches"), F.max("blocked").alias("blocked"))
    by_intent = table.groupBy("intent").agg(F.array_sort(F.collect_set("fiche")).alias("all"), F.max("blocked").alias("any_blocked"))
    generic = per.where("app = ''").select("intent", F.col("fiches").alias("generic"), F.col("blocked").alias("generic_blocked"))
    rows = questions.join(per, ["intent", "app"], "left").join(by_intent, "intent", "left").join(generic, "intent", "left")
    has_app = F.col("app") != ""
    reason = (
        F.when(F.col("intent").isNull(), "no_intent")
        .when(has_app & F.col("blocked"), "pending_review")
        .when(has_app & (F.size("fiches") == 1), "intent_app")
        .when(has_app & F.col("fiches").isNotNull(), "several_fiches")
        .when(has_app & F.col("generic").isNotNull(), "no_fiche_for_app_generic_offered")
        .when(has_app | F.col("all").isNull(), "no_fiche")
        .when(F.col("any_blocked"), "pending_review")
        .when((F.size("generic") == 1) & (F.size("all") == 1) & (F.col("generic") == F.col("all")), "intent_no_app")
        .when(F.size("all") > 1, "several_fiches")
        .otherwise("fiche_of_an_application")
    )
    out = rows.withColumn("reason", reason)
    exact = F.when(F.col("reason") == "intent_app", F.col("fiches")[0]).when(F.col("reason") == "intent_no_app", F.col("generic")[0])
    offer = F.when(F.col("reason").isin("intent_app", "intent_no_app", "no_fiche", "no_intent"), "").when(has_app & F.col("fiches").isNotNull(), F.array_join("fiches", "|")).when(has_app, F.array_join("generic", "|")).otherwise(F.array_join("all", "|"))
    return out.select("query", exact.alias("exact"), offer.alias("offer"), "reason")


def ladder(levels: list[DataFrame], questions: DataFrame) -> DataFrame:
    """levels: frames (query, fiche_id) in order; each decides only what those before left open."""
    open_, out = questions.select("query"), None
    for i, level in enumerate(levels):
        hit = open_.join(level.select("query", "fiche_id"), "query").withColumn("level", F.lit(f"L{i}"))
        out = hit if out is None else out.unionByName(hit)
        open_ = open_.join(hit.select("query"), "query", "left_anti")
    rest = open_.select("query", F.lit(None).cast("string").alias("fiche_id"), F.lit("none").alias("level"))
    return out.unionByName(rest)


def claims(proposals: DataFrame) -> DataFrame:
    """proposals: entry, ord, member.  The first entry that claims a member keeps it; the others are refused."""
    w = Window.partitionBy("member").orderBy("ord", "entry")
    return proposals.withColumn("accepted", F.row_number().over(w) == 1)


def seen_references(references: DataFrame, aliases: DataFrame) -> DataFrame:
    """references: ref, tokens, fiche; aliases: fiche, tokens.  References whose expected fiche has an alias within their tokens."""
    hit = references.join(aliases.withColumnRenamed("tokens", "at"), "fiche").where(F.size(F.array_except("at", "tokens")) == 0)
    return hit.select("ref").distinct()


def routable(fiches: DataFrame, superseded: DataFrame) -> DataFrame:
    """fiches: fiche, searchable, canonical; superseded: fiche.  Fiches that may be reviewed and routed to: searchable, no
    duplicate of another, replaced by none."""
    own = fiches.where(F.col("searchable") & (F.col("canonical") == F.col("fiche"))).select("fiche")
    return own.join(superseded.select("fiche").distinct(), "fiche", "left_anti")


def number_table(holders: DataFrame, resolve: DataFrame, status: DataFrame) -> DataFrame:
    """holders: number, fiche; resolve: fiche, target (what pruning leads to); status: fiche, status.  Level 0 for numbers: what
    the holders lead to is one fiche that is not rejected (l0), several (collision); a rejected one gives no row."""
    led = holders.join(resolve, "fiche", "left").select("number", F.coalesce("target", "fiche").alias("fiche")).distinct()
    per = led.groupBy("number").agg(F.array_sort(F.collect_set("fiche")).alias("fiches"))
    one = per.withColumn("fiche", F.when(F.size("fiches") == 1, F.col("fiches")[0])).join(status, "fiche", "left")
    kept = one.where((F.size("fiches") > 1) | (F.coalesce("status", F.lit("")) != "rejected"))
    return kept.select("number", "fiche", "fiches", F.when(F.size("fiches") > 1, "collision").otherwise("l0").alias("outcome"))


def intent_table(decisions: DataFrame, taxonomy: DataFrame, proposals: DataFrame, unknown: DataFrame) -> DataFrame:
    """Level 2: decisions: fiche, intent, fingerprint, app; taxonomy: intent, now (fingerprint); proposals: fiche, intent, app (of
    fiches under review); unknown: fiche (under review without a usable proposal).

    (intent, app, fiches, pending, outcome): a key is blocked while a fiche under review may share it: one proposed for the
    intent and the same or no application, or any unknown one.  Decisions on changed or unknown intents give no key.
    """
    usable = decisions.join(taxonomy, "intent").where("fingerprint = now").select("intent", F.coalesce("app", F.lit("")).alias("app"), "fiche")
    keys = usable.groupBy("intent", "app").agg(F.array_sort(F.collect_set("fiche")).alias("fiches"))
    waiting = proposals.select("intent", F.coalesce("app", F.lit("")).alias("other"), F.col("fiche").alias("p"))
    shared = keys.join(waiting, "intent", "left").withColumn("p", F.when((F.col("other") == F.col("app")) | (F.col("other") == "") | (F.col("app") == ""), F.col("p")))
    per = shared.groupBy("intent", "app", "fiches").agg(F.collect_set("p").alias("named"))
    blind = unknown.agg(F.array_sort(F.collect_set("fiche")).alias("blind"))  # fiches under review: a reviewer's list
    both = per.crossJoin(F.broadcast(blind)).withColumn("pending", F.array_sort(F.array_union("named", "blind")))
    outcome = F.when(F.size("pending") > 0, "blocked").when(F.size("fiches") > 1, "collision").otherwise("l2")
    return both.select("intent", "app", "fiches", "pending", outcome.alias("outcome"))


def match_numbers(resolutions: DataFrame, routable_: DataFrame) -> DataFrame:
    """resolutions: query, identifier, fiche, entry (the identifier is a table's entry for the fiche).  Level 0 decides where all
    identifiers of a question share one routable fiche and an entry is among them: query, fiche, key (the least entry)."""
    n = resolutions.groupBy("query").agg(F.countDistinct("identifier").alias("n"))
    held = resolutions.groupBy("query", "fiche").agg(F.countDistinct("identifier").alias("k"), F.min(F.when(F.col("entry"), F.col("identifier"))).alias("key")).join(n, "query").where("k = n")
    alone = held.groupBy("query").agg(F.count("*").alias("c"), F.min(F.struct("fiche", "key")).alias("m")).where("c = 1")
    return alone.select("query", "m.fiche", "m.key").where("key is not null").join(routable_.select("fiche"), "fiche", "left_semi").select("query", "fiche", "key")


def question_app(named: DataFrame, model: DataFrame) -> DataFrame:
    """named: query, apps (those the question names); model: query, app.  The one application that the code reads wins; the
    model's counts only where the code reads none, or it is among several."""
    row = named.join(model, "query", "left")
    by_code, by_model = F.size("apps") == 1, F.col("app").isNotNull() & ((F.size("apps") == 0) | F.array_contains("apps", F.col("app")))
    return row.select("query", F.when(by_code, F.col("apps")[0]).when(by_model, F.col("app")).alias("app"), F.when(by_code, "code").when(by_model, "model").alias("source"))


def table_mismatch(tables: dict, current: dict) -> str | None:
    """Why routing tables may not be used for the current code, client, run and knowledge base; None if they may."""
    for key in ("code_version", "client", "run_id", "kb_sha256"):
        if current.get(key) is not None and (tables.get(key) or "") != (current[key] or ""):
            return key
    return None


def kb_digest(fiches: DataFrame) -> DataFrame:
    """fiches: fiche, sha256.  One digest of all, whatever their order: digests of 256 parts by the id's hash, then one of these."""
    lines = fiches.select(F.sha2("fiche", 256).substr(1, 2).alias("part"), F.concat_ws(" ", "fiche", "sha256").alias("line"))
    parts = lines.groupBy("part").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("line")), "\n"), 256).alias("sha"))
    return parts.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "sha"))), lambda x: x["sha"]), "\n"), 256).alias("kb_sha256"))


def taxonomy_changes(old: DataFrame, new: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(removed intents, orphaned decisions): old, new: intent, fingerprint; decisions: fiche, intent, fingerprint.  An orphan names
    an intent that is gone or that has another fingerprint now."""
    gone = old.join(new, "intent", "left_anti").select("intent")
    return gone, decisions.join(new, ["intent", "fingerprint"], "left_anti").select("fiche", "intent")


def review_queue(fiches: DataFrame, referenced: DataFrame, issues: DataFrame) -> DataFrame:
    """fiches: fiche, label.  The place of each in the review: those that reference questions expect, then those in a collision
    or a blocked key, then by label."""
    flag = lambda df, name: df.select("fiche").distinct().withColumn(name, F.lit(0))
    rows = fiches.join(flag(referenced, "r"), "fiche", "left").join(flag(issues, "i"), "fiche", "left").na.fill(1, ["r", "i"])
    return rows.select("fiche", "r", "i", "label").orderBy("r", "i", F.lower("label"), "fiche")


def decision_problem() -> Column:
    """Why a review decision is refused, the first reason that holds; columns: status, intent, known_intent, aliases_ok, codes_ok,
    sha_current, decided_by."""
    return (
        F.when(~F.col("status").isin("validated", "rejected", "deferred"), "unknown_status")
        .when(F.trim(F.coalesce("decided_by", F.lit(""))) == "", "no_reviewer")
        .when(~F.col("sha_current"), "text_changed")
        .when((F.col("status") == "validated") & F.col("intent").isNotNull() & ~F.col("known_intent"), "unknown_intent")
        .when((F.col("status") == "validated") & ~F.col("aliases_ok"), "alias_refused")
        .when((F.col("status") == "validated") & ~F.col("codes_ok"), "code_not_unique")
    )
