"""Extraction that columns and joins express: codes, vocabularies, verified proposals, file routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from askwright.functions.text import entity_form


def hex_codes(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"(?<![\w-])0x([0-9a-fA-F]{4,8})\b"), 1), F.upper)


def negative_codes(text: Column) -> Column:
    """Negative results, down to -2^31, as the hexadecimal codes that they stand for."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"(?<![\w.])-(2\d{9})\b"), 1), lambda n: n.cast("long"))
    return F.transform(F.filter(found, lambda n: n <= 1 << 31), lambda n: F.hex(F.lit(1 << 32) - n))


def vocabulary_entities(texts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """id, t against terms of two characters or more: those that the folded text contains, the longest first.

    All terms are read, however many; a vocabulary that Spark knows to be small is broadcast, others meet the texts in parts."""
    terms = vocabulary.select("term", entity_form(F.col("term")).alias("k")).where(F.length("term") >= 2)
    folded = texts.select("id", F.explode(F.array(entity_form(F.col("t")))).alias("t"))  # a generator: once a text, not once a pair
    hit = folded.join(terms, F.contains(F.col("t"), F.col("k")))
    return hit.select("id", "term", F.row_number().over(Window.partitionBy("id").orderBy(F.desc(F.length("term")), "term")).cast("long").alias("rank"))


def verified_aliases(rows: DataFrame) -> DataFrame:
    """id, canonical, aliases, t: aliases stay if the text says them; an entity needs its name or one alias there."""
    kept = F.filter("aliases", lambda a: F.contains(F.lower("t"), F.lower(a)))
    out = rows.withColumn("kept", kept).where((F.size("kept") > 0) | F.contains(F.lower("t"), F.lower("canonical")))
    return out.select("id", "canonical", F.array_join("kept", "|").alias("aliases"))


def novel_entities(candidate: DataFrame, reference: DataFrame) -> DataFrame:
    """doc, canonical of a rewording that its source does not hold; menu labels may differ."""
    return candidate.where(~F.col("canonical").startswith("menu:")).join(reference, ["doc", "canonical"], "left_anti")


def copy_routes(files: DataFrame, done: DataFrame) -> DataFrame:
    """Files (no folders) that were not copied yet, by kind."""
    ext = F.lower(F.regexp_extract("name", r"\.([^./]+)$", 1))
    kind = F.when(ext.isin("mp3", "wav", "m4a"), "audio").when(ext.isin("mp4", "mov", "avi"), "video").otherwise("other")
    return files.where(~F.col("name").endswith("/")).join(done, "name", "left_anti").select("name", kind.alias("kind"))


def canonical_set(entities: Column, kinds: list[str] | None = None) -> Column:
    """Canonical names of an array of extracted entities, sorted, each once."""
    kept = entities if kinds is None else F.filter(entities, lambda e: e["kind"].isin(kinds))
    return F.array_sort(F.array_distinct(F.transform(kept, lambda e: e["canonical"])))


def novel(candidate: DataFrame, reference: DataFrame, key: str) -> DataFrame:
    """key, canonical: what a generated line names and its reference does not."""
    return candidate.select(key, "canonical").distinct().join(reference.select(key, "canonical").distinct(), [key, "canonical"], "left_anti")


def kept_triples(triples: DataFrame, kept: DataFrame) -> DataFrame:
    """triples: doc, subject, relation, object; kept: doc, entity.  Triples of which subject or object is a kept entity."""
    names = kept.select("doc", F.col("entity").alias("e")).distinct()
    ends = triples.withColumn("e", F.explode(F.array_distinct(F.array("subject", "object"))))
    return ends.join(names, ["doc", "e"], "left_semi").select("doc", "subject", "relation", "object").distinct()


def alias_rows(entities: DataFrame) -> DataFrame:
    """entities: canonical, aliases.  'name|alias|alias' of each with an alias."""
    return entities.where(F.size("aliases") > 0).select(F.concat_ws("|", F.array("canonical"), F.array_sort(F.array_distinct("aliases"))).alias("row"))


def locked_entities(called: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """called: call, pos, name; vocabulary: name.  A call's names as the vocabulary writes them, each once, in order; others go."""
    from askwright.functions.text import entity_form

    known = vocabulary.groupBy(entity_form(F.col("name")).alias("k")).agg(F.min("name").alias("written"))
    hits = called.withColumn("k", entity_form(F.col("name"))).join(known, "k").groupBy("call", "written").agg(F.min("pos").alias("pos"))
    return hits.groupBy("call").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "written"))), lambda x: x["written"]).alias("names"))


#: The head block of a call's transcript, and what makes a session risky.
SUMMARY = r"(?is)(?:Probleme|Problème)\s*:(.*?)(?=---\s*Transcription|\z)"
RISKS = {
    "mfa_reset": r"(?is)(r[ée]initialis|reset|supprim|d[ée]sactiv|contourn|bypass).{0,40}(mfa|2fa|authentification (multi|[àa] deux)|double authentification|authenticator)",
    "privileged_access": r"(?is)((donn|accord|ajout|attribu|grant|elev|[ée]lev)\w*.{0,40}(droits?|acc[eè]s|r[oô]le)\s+(d['e ]?\s?)?(admin|global|privil[eè]g|[ée]lev))|(devenir|be|make me)\s+(global\s+)?admin",
    "data_deletion": r"(?is)(supprim|effac|delete|wipe|purge)\w*.{0,40}(donn[ée]es|fichiers?|bo[iî]te (mail|aux)|mailbox|compte|data|files|account)",
    "security_incident": r"(?is)(phishing|hame[cç]onnage|ransomware|rançongiciel|compromis|piratage|pirat[ée]|malware|fuite de donn[ée]es|data breach)",
}
KNOWN_CODE = r"^0x[0-9A-Fa-f]{8}$|^AADSTS\d{5,6}$|^[A-Z]{3,5}-\d{3,6}$|(?i:^(error|erreur|code)?\s*\d{3,8}$)|^[A-Z][A-Z0-9_]{5,40}$"


def call_summary(content: Column) -> Column:
    """The block that heads a transcript, 4000 characters at most; without it the first 3000."""
    found = content.rlike(SUMMARY)
    block = F.regexp_replace(F.concat(F.lit("Probleme :"), F.regexp_extract(content, SUMMARY, 1)), r"\s+$", "")
    return F.when(found, block.substr(1, 4000)).otherwise(F.coalesce(content, F.lit("")).substr(1, 3000))


def risk_flags(text: Column) -> Column:
    return F.filter(F.array(*[F.when(text.rlike(RISKS[k]), F.lit(k)) for k in sorted(RISKS)]), lambda x: x.isNotNull())


def checked_variables(proposed: DataFrame) -> DataFrame:
    """proposed: text, name, value, confidence.  Values that stand in the text; an error code of no known shape is trusted half at
    most."""
    value = F.trim("value").substr(1, 256)
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence")))
    capped = F.when((F.col("name") == "error_code") & ~F.trim("value").rlike(KNOWN_CODE), F.least(sure, F.lit(0.5))).otherwise(sure)
    rows = proposed.where((value != "") & F.contains(F.lower("text"), F.lower(value)) & ~F.contains(value, F.lit("[REDACTED]")))
    return rows.withColumn("value", value).withColumn("confidence", capped)
