"""Column functions that mask personal data and secrets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from askwright.functions.text import strip_accents

# The patterns (Java syntax; (?U) makes classes and boundaries Unicode).
EMAIL = r"(?U)[\w.+-]+@[\w-]+(?:\.[\w-]+)+"
PHONE = r"(?U)(?<![\w+])(?:(?:\+|00)\d{2,3}[\s.-]?(?:\(0\)[\s.-]?)?|0)[1-9](?:[\s.-]?\d{2}){4}(?!\w)"
TICKET_EMAIL = r"(?U)(?<![\w.+-])[\w.+-]{1,64}@[\w-]{1,63}(?:\.[\w-]{1,63}){1,8}"
TICKET_PHONE = (
    r"(?U)(?<![\w+])(?!\d{2}([./ -])\d{2}\1\d{4})(?:(?:\+|00)\d{2,3}[\s.-]?(?:\(0\)[\s.-]?)?|0)[1-9](?:[\s.-]?\d{2}){4}(?!\w)"
)
SECRET = r"(?i)(mot de passe|password|passwd|pwd|mdp)\s*[:=]\s*\S+"
PLACEHOLDER = r"\[(?:email|phone|nom|mention|masqué|masked)\]"
SPELLED = r"(?i)\b(minuscule|majuscule|en capitale|j'epelle|je vous epelle|epelle|lettre par lettre|chiffre par chiffre|comme dans le mot)\b"
SPACED_DIGITS = r"(?:\b\d\b[\s,.-]+){4,}\d\b"


def scrub(text: Column, extra: list[str] = ()) -> Column:
    out = F.regexp_replace(F.regexp_replace(text, EMAIL, "[email]"), PHONE, "[phone]")
    for pattern in extra:
        out = F.regexp_replace(out, pattern, "[masked]")
    return out


def scrub_counts(text: Column) -> Column:
    """Map of placeholder to the number of places masked, in the order that scrub() masks them."""
    no_mail = F.regexp_replace(text, EMAIL, "[email]")
    return F.create_map(F.lit("[email]"), F.regexp_count(text, F.lit(EMAIL)), F.lit("[phone]"), F.regexp_count(no_mail, F.lit(PHONE)))


# Signatures, greetings, mail headers, mentions (Java syntax).
NAME_WORD = r"[A-ZÀ-ÖØ-Þ][\w'’-]*"
NAMES = rf"{NAME_WORD}(?:(?:[ \t]+|[ \t]*,[ \t]*|[ \t]+(?:et|and|&)[ \t]+){NAME_WORD}){{0,3}}"
FORMULA = (
    r"(?:(?:^[ \t>]*|(?<=[\s,.;!]))(?i:(?:(?:bien|très|meilleures)\s+)?cordialement|bien\s+à\s+(?:vous|toi)"
    r"|(?:sinc[èe]res\s+|meilleures\s+|bonnes\s+)?salutations|(?:best|kind|warm)\s+regards|regards"
    r"|merci(?:\s+(?:d['’]avance|par\s+avance|beaucoup|bien))?)|^[ \t>]*(?i:cdlt|cdt|slts|bàv|bav))"
)
SIGNATURE_END = rf"[ \t]*[,.!:]?[ \t]*(?:{NAME_WORD}(?:[ \t]+{NAME_WORD}){{0,2}})?[ \t]*[,.!]?[ \t]*$"
GREETING = (
    r"^([ \t>]*(?i:bonjour|bonsoir|hello|hi|salut|cher|chère|chers|chères|dear)[ \t]+)"
    rf"(?:(?:(?i:m\.|mme\.?|mlle\.?|monsieur|madame|mr\.?|mrs\.?|ms\.?)[ \t]+)?{NAMES})(?=[ \t]*(?:[,!.:]|$))"
)
HEADER = (
    r"(?i)^([ \t>]*(?:de|from|à|to|cc|cci|bcc|envoyé\s+par|sent\s+by|expéditeur|destinataire|répondre\s+à|reply-to|de\s+la\s+part\s+de)[ \t]*:)[ \t]*\S[^\n]*$"
)
HEADER_A = r"(?i)^([ \t>]*a[ \t]*:)[ \t]*[^\n]*(?:@|\[email\])[^\n]*$"
MENTION = rf"(?<![\w.])@[ \t]?(?:{NAME_WORD}|\w[\w.'’-]*)(?:[ \t]+{NAME_WORD}){{0,2}}"
PERSON_WORD = r"(?U)[\p{L}\p{Nl}\p{M}][\w'’-]{2,}"


def cut_signature(text: Column) -> Column:
    """Up to the first closing formula that ends its line with something before it."""
    return F.regexp_replace(text, rf"(?dmU)\A(?s:(\s*+[^\s].*?))(?<![ \t\n,;:])[ \t\n,;:]*+(?:(?<=[ \t\n,;:])|(?<=[\s,.;!])|(?=^)){FORMULA}{SIGNATURE_END}(?s:.*)\z", "$1")


def mask_names(text: Column, people: Column) -> Column:
    """The people of a row's person columns (array of strings) in its text: two neighbouring words in either order in any case,
    single words only where they are capitalised.  A single word in capitals is an account, no person."""
    lower = lambda v: F.coalesce(v, F.lit("")).rlike(r"\p{Ll}")
    each = F.transform(people, lambda v: F.struct(F.regexp_extract_all(F.coalesce(v, F.lit("")), F.lit(PERSON_WORD), 0).alias("w"), lower(v).alias("low")))
    known = F.filter(each, lambda p: (F.size(p["w"]) > 1) | ((F.size(p["w"]) == 1) & p["low"]))
    gap = r"[ \t]+"
    pairs = F.flatten(
        F.transform(
            F.filter(known, lambda p: F.size(p["w"]) > 1),
            lambda p: F.flatten(F.zip_with(F.slice(p["w"], F.lit(1), F.size(p["w"]) - 1), F.slice(p["w"], F.lit(2), F.size(p["w"]) - 1), lambda a, b: F.array(F.concat(a, F.lit(gap), b), F.concat(b, F.lit(gap), a)))),
        )
    )
    singles = F.flatten(F.transform(F.filter(known, lambda p: p["low"]), lambda p: p["w"]))
    any_of = lambda words: F.array_join(F.transform(F.sort_array(F.transform(F.array_distinct(words), lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), lambda x: x["w"]), "|")
    first = F.when(F.size(pairs) > 0, F.regexp_replace(text, F.concat(F.lit(r"(?iU)(?<!\w)(?:"), any_of(pairs), F.lit(r")(?!\w)")), F.lit("[nom]"))).otherwise(text)
    shout = any_of(F.transform(singles, lambda w: F.upper(w)))
    capital = F.concat(F.lit(r"(?U)(?<!\w)(?=\p{Lu})(?!(?:"), shout, F.lit(r")(?!\w))(?iU:"), any_of(singles), F.lit(r")(?!\w)"))
    return F.when(F.size(singles) > 0, F.regexp_replace(first, capital, F.lit("[nom]"))).otherwise(first)


def clean_value(text: Column, most: int = 30_000, people: Column | None = None, free: bool = True) -> Column:
    """A ticket's kept value: cut; of free text the signature off, greeting and mail headers masked; then addresses, numbers and
    mentions, and last the names of the row's people.  The order is part of the rule."""
    out = text.substr(1, most)
    if free:
        out = cut_signature(out)
        out = F.regexp_replace(out, f"(?dmU){GREETING}", "$1[nom]")
        for header in (HEADER, HEADER_A):
            out = F.regexp_replace(out, f"(?dmU){header}", "$1 [masqué]")
    for label, pattern in (("[email]", TICKET_EMAIL), ("[phone]", TICKET_PHONE), ("[mention]", f"(?U){MENTION}")):
        out = F.regexp_replace(out, pattern, label)
    if people is not None:
        out = mask_names(out, people)
    return out.substr(1, most)


def recleaned(rows, key: list[str], free: list[str], structured: list[str] = (), people: list[str] = (), most: int = 30_000):
    """Stored rows cleaned again: only the rows that change are returned, with their key and new values.  Columns that are
    neither key, free text nor structured are emptied (the allow-list decides what may be kept)."""
    names = F.array(*[F.col(c).cast("string") for c in people]) if people else None
    new = {c: clean_value(F.coalesce(F.col(c), F.lit("")), most, names) for c in free}
    keep = {*key, *free, *structured}
    emptied = {c: F.lit("").alias(c) for c in rows.columns if c not in keep}
    changed = F.lit(False)
    for c in (*free, *emptied):
        changed = changed | ~F.coalesce(F.col(c).cast("string"), F.lit("")).eqNullSafe(new.get(c, F.lit("")))
    picked = [F.col(c) if c in key or c in structured else new[c].alias(c) if c in new else emptied[c] for c in rows.columns]
    return rows.where(changed).select(*picked)


def allowed_columns(found: list[str], kept: list[str], dropped: list[str]) -> tuple[list[str], list[str]]:
    """(columns to keep in the order found, unknown ones to report): whatever is neither kept nor known as dropped is not kept."""
    return [c for c in found if c in kept], [c for c in found if c not in kept and c not in dropped]


def readable(text: Column) -> Column:
    """Without placeholders."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, PLACEHOLDER, " "), r"\s+", " "))


def redact_secrets(text: Column) -> Column:
    return F.regexp_replace(text, SECRET, "$1: [REDACTED]")


def looks_sensitive(text: Column) -> Column:
    """Two markers of spelling out, or five single digits in a row."""
    return (F.regexp_count(strip_accents(text), F.lit(SPELLED)) >= 2) | text.rlike(SPACED_DIGITS)


def redact_sensitive(text: Column, most: int = 600) -> Column:
    """Sentences that spell something out go, runs of single digits are masked, the rest is cut at a space."""
    spelled = lambda s: (F.regexp_count(strip_accents(s), F.lit(SPELLED)) >= 1)
    kept = F.filter(F.split(F.trim(text), r"(?<=[.!?])\s+|\n+"), lambda s: ~spelled(s) & (F.trim(s) != ""))
    out = F.trim(F.array_join(F.transform(kept, lambda s: F.regexp_replace(s, SPACED_DIGITS, "[...]")), " "))
    cut = F.when(F.length(out) > most, F.concat(F.regexp_replace(out.substr(1, most), r" [^ ]*$", ""), F.lit("..."))).otherwise(out)
    return F.when(cut != "", cut)
