"""Column functions on text: foldings, tokens, keys, identifiers.

Several normal forms live side by side on purpose: each decision was tuned on its own, so they are never merged.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists, in natural order.
SEARCH_STOP = (
    "le la les l un une des de du d et ou pour avec sans sur sous dans par au aux ce cette ces cet est "
    "sont a ont ete etre que qui quoi comment pourquoi quand ou en se ne pas non oui plus tres the a an of to in on for "
    "with and or is are"
).split()
QUERY_STOP = (
    "je tu il elle on nous vous ils elles me te lui leur leurs mon ma mes ton ta tes son sa ses notre nos votre vos "
    "moi toi ai as avons avez suis es sommes etes etait fait faire peux peut pouvez dois doit devez veux veut voulez "
    "mais donc car ni si aussi bien tout tous toute toutes rien chose bonjour merci cordialement svp stp salut "
    "madame monsieur depuis encore deja toujours jamais besoin "
    "i me my we our you your he she it its they them their this that these those am was were be been being have has "
    "had do does did can could would should will shall may might must need needs please thanks thank hello hi dear "
    "regards how what why when where which who there here from by at as but if so not no yes all any some also just "
    "still"
).split()
ROUTE_STOP = (
    "a ai as au aux avec c ce ces cet cette comment d dans de des dois doit du elle elles en est et etre "
    "faut il ils j je l la le les leur leurs lui m ma me mes moi mon n ne nos notre nous on ont ou par peut "
    "peux pour pouvez puis qu quand que quel quelle quelles quels qui quoi s sa se ses si son sont sur suis "
    "svp t ta te tes toi ton tu un une vos votre vous y bonjour merci "
    "an and are at be by can could do does for from hello hi how i in is it its me my of on or please "
    "that the this to what when where why with you your"
).split()
NEGATIONS = "pas plus non jamais aucun aucune rien sans ni impossible not no never none nothing unable".split()
# Verbs that open an instruction.  Of the regular French ones, in -er, the polite imperative in -ez is built.
ER_VERBS = (
    "cliquer fermer selectionner redemarrer relancer verifier controler tester consulter regarder observer confirmer identifier demander noter taper entrer "
    "appuyer lancer executer aller supprimer desinstaller installer reinstaller connecter deconnecter reconnecter copier coller renommer vider reinitialiser "
    "desactiver activer modifier configurer reconfigurer patienter allumer rallumer debrancher rebrancher brancher retirer inserer remplacer effacer ajouter "
    "creer cocher decocher valider contacter essayer naviguer acceder rechercher telecharger synchroniser forcer purger nettoyer deverrouiller reparer utiliser "
    "demarrer arreter quitter positionner placer glisser deplacer imprimer scanner partager exporter importer sauvegarder enregistrer restaurer basculer indiquer "
    "signaler accepter refuser autoriser bloquer debloquer actualiser recharger reessayer recommencer verrouiller deployer envoyer transferer derouler developper"
).split()
OTHER_VERBS = (
    "ouvrir ouvrez choisir choisissez saisir saisissez attendre attendez eteindre eteignez mettre mettez repondre repondez rafraichir rafraichissez reprendre "
    "reprenez joindre joignez rendez faire faites suivre suivez assurez s'assurer"
).split()
ENGLISH_VERBS = (
    "click open close select choose restart reboot relaunch verify check ensure confirm test look see identify ask note type enter press launch run go navigate "
    "delete remove uninstall install reinstall connect disconnect reconnect copy paste rename clear empty reset disable enable modify change configure wait turn "
    "switch unplug plug insert replace add create tick untick validate contact try access search download sync force purge clean unlock repair use start stop quit "
    "save restore update refresh reload retry sign log make"
).split()
ACTION_VERBS = [*ER_VERBS, *(v[:-2] + "ez" for v in ER_VERBS), *OTHER_VERBS, *ENGLISH_VERBS]
FILLERS = (
    "tout d'abord|dans un premier temps|dans un second temps|pour commencer|si besoin|au besoin|ensuite|puis|enfin|d'abord|egalement|aussi|alors|maintenant|"
    "then|next|finally|first|also|now"
)
PLACES = "dans sur depuis via une apres avant au a partir lorsque des une_fois from in on after once within under".split()
CONDITIONS = (
    r"^(?:et |mais |ou )?(?:si|s'ils?|lorsqu'|lorsque|quand|dans le cas ou|en cas d'|en cas de|au cas ou|sinon|if|when|in case|unless|sauf si|otherwise)(?![a-z])"
    r"[^,:;]{0,160}?(?= ?[,:;]| (?:alors|then)(?![a-z]))"
)
LIGATURES = {"œ": "oe", "Œ": "oe", "æ": "ae", "Æ": "ae", "ß": "ss", "ø": "o", "Ø": "o", "đ": "d", "Đ": "d", "ł": "l", "Ł": "l"}


def _single_folds() -> tuple[str, str]:
    """Accented Latin letters whose compatibility decomposition is one ASCII letter and marks."""
    source, target = "", ""
    for code in range(0xC0, 0x250):
        plain = unicodedata.normalize("NFKD", chr(code)).encode("ascii", "ignore").decode()
        if len(plain) == 1:
            source, target = source + chr(code), target + plain
    return source, target


_FOLD = _single_folds()


def strip_accents(text: Column) -> Column:
    """Latin accents off; combining marks dropped; other characters stay."""
    return F.regexp_replace(F.translate(text, *_FOLD), r"[̀-ͯ]", "")


def fold_ascii(text: Column) -> Column:
    """Decomposed, ASCII only (what has no ASCII form is deleted), lower case."""
    return F.lower(F.regexp_replace(strip_accents(text), r"[^\x00-\x7F]", ""))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def plain(text: Column) -> Column:
    return collapse(fold_ascii(F.replace(text, F.lit("’"), F.lit("'"))))


def tokenize(text: Column) -> Column:
    """Search tokens: [a-z0-9]+ of the folded text, two characters at least, stop words out; a bag."""
    return F.filter(F.regexp_extract_all(fold_ascii(text), F.lit("[a-z0-9]+"), 0), lambda t: (F.length(t) > 1) & ~t.isin(SEARCH_STOP))


_ASCII_OF = dict(zip(*_FOLD))
_STOPS = frozenset(SEARCH_STOP)


def search_tokens(text: str) -> list[str]:
    """tokenize() of one text, for tasks that read Arrow."""
    if not text.isascii():
        text = re.sub(r"[^\x00-\x7F]", lambda m: _ASCII_OF.get(m[0], ""), text)
    return [t for t in re.findall("[a-z0-9]{2,}", text.lower()) if t not in _STOPS]


def fold_token(token: Column) -> Column:
    """Of four letters or more: final s goes (not ss, us, is), then a final ee loses one e; numbers never change."""
    no_s = F.when((F.length(token) >= 4) & token.endswith("s") & ~token.rlike("(ss|us|is)$"), token.substr(F.lit(1), F.length(token) - 1)).otherwise(token)
    no_e = F.when((F.length(no_s) >= 4) & no_s.endswith("ee"), no_s.substr(F.lit(1), F.length(no_s) - 1)).otherwise(no_s)
    return F.when(token.rlike("^[0-9]+$"), token).otherwise(no_e)


def _route_fold(text: Column) -> Column:
    for ligature, spelled in LIGATURES.items():
        text = F.replace(text, F.lit(ligature), F.lit(spelled))
    text = F.lower(strip_accents(text))
    text = F.regexp_replace(text, r"(?U)\b(?:can['’]t|cannot)\b", "can not")
    text = F.regexp_replace(text, r"(?U)\bwon['’]t\b", "will not")
    text = F.regexp_replace(text, r"(?U)\bshan['’]t\b", "shall not")
    return F.regexp_replace(text, r"(?U)\b(\w+)n['’]t\b", "$1 not")


def route_tokens(text: Column) -> Column:
    """Routing tokens: each once, in order of first appearance."""
    kept = F.filter(F.regexp_extract_all(_route_fold(text), F.lit("[a-z0-9]+"), 0), lambda t: (F.length(t) > 1) & ~t.isin(ROUTE_STOP))
    folded = F.transform(kept, fold_token)
    return F.array_distinct(F.filter(folded, lambda t: (F.length(t) > 1) & ~t.isin(ROUTE_STOP)))


def opening_verb(line: Column) -> Column:
    """The verb that opens a step: after a condition, as the line begins, or after a leading place; past one filler word.  Null
    if none does."""
    bare = plain(F.regexp_replace(line, r"^\s*(?:(?:[EÉeé]tape|ETAPE|ÉTAPE|[Ss]tep|STEP)\s*\d{1,2}\s*[:.)\-–]?|\d{1,2}[.)](?!\d)|[a-zA-Z][.)](?=\s)|[-*•–·▪●◦➢➤►✓✔])\s+", ""))
    comma = F.instr(bare, ",")
    place = (comma > 1) & (comma <= 61) & F.substring_index(bare, " ", 1).isin(PLACES)
    tries = F.filter(
        F.array(
            F.when(bare.rlike(CONDITIONS), F.regexp_replace(F.regexp_replace(bare, CONDITIONS, ""), "^[ ,:;]+", "")),
            bare,
            F.when(place, F.ltrim(bare.substr(comma + 1, F.length(bare)))),
        ),
        lambda x: x.isNotNull(),
    )

    def verb(x: Column) -> Column:
        after = F.regexp_replace(F.regexp_replace(x, rf"^(?:{FILLERS})(?=[ ,])[ ,]*", ""), "^alors ", "")
        word = F.regexp_replace(F.regexp_extract(after, r"^([a-z'-]+)", 1), r"^['-]+|['-]+$", "")
        form = F.when(word.startswith("s'") & ~word.isin(ACTION_VERBS), word.substr(F.lit(3), F.length(word))).otherwise(word)
        return F.when(form.isin(ACTION_VERBS), form).when(F.substring_index(form, "-", 1).isin(ACTION_VERBS), F.substring_index(form, "-", 1))

    return F.get(F.filter(F.transform(tries, verb), lambda x: x.isNotNull()), F.lit(0))


def opens_with_verb(line: Column) -> Column:
    return opening_verb(line).isNotNull()


def token_key(text: Column) -> Column:
    return F.array_sort(route_tokens(text))


def ignored_characters(text: Column) -> Column:
    """One-character letters and digits that routing drops."""
    return F.array_distinct(F.filter(F.regexp_extract_all(_route_fold(text), F.lit("[a-z0-9]+"), 0), lambda t: (F.length(t) == 1) & ~t.isin(ROUTE_STOP)))


def alias_ok(text: Column) -> Column:
    return (F.size(ignored_characters(text)) == 0) & (F.size(route_tokens(text)) >= 2)


def exclusion_form(text: Column) -> Column:
    """Upper case, no accents, other characters one space, a space on either side."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.upper(strip_accents(text)), "[^A-Z0-9]+", " ")), F.lit(" "))


def loose_key(text: Column) -> Column:
    return F.lower(collapse(F.regexp_replace(text, " ", " ")))


def body_chars(text: Column, title: Column) -> Column:
    """Non-space characters without the first occurrence of the title and leading number signs."""
    body, head = collapse(text), collapse(title)
    at = F.instr(body, head)
    cut = F.when((F.length(head) > 0) & (at > 0), F.concat(body.substr(F.lit(1), at - 1), F.lit(" "), body.substr(at + F.length(head), F.length(body)))).otherwise(body)
    return F.length(F.regexp_replace(F.regexp_replace(cut, r"\s+", ""), "^#+", ""))


def entity_form(text: Column) -> Column:
    return F.lower(collapse(strip_accents(text)))


def canonical_intent(text: Column) -> Column:
    """UPPER_SNAKE name of 3 to 64 characters, else null."""
    name = F.regexp_replace(F.regexp_replace(F.upper(strip_accents(text)), "[^A-Z0-9]+", "_"), "^_+|_+$", "")
    return F.when(name.rlike("^[A-Z][A-Z0-9_]{2,63}$"), name)


def slug(text: Column, reserved: tuple[str, ...] = ()) -> Column:
    """A column's name in lower-case ASCII; names that begin with a digit or are taken by the store get a prefix."""
    name = F.regexp_replace(F.regexp_replace(fold_ascii(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(name.isin(list(reserved)), F.concat(F.lit("field_"), name)).when(name.rlike("^[0-9]"), F.concat(F.lit("c_"), name)).otherwise(name)


def dictionary_slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def sanitize_query(text: Column, most: int = 1000) -> Column:
    """Operators of a query language out, cut at the last space within `most`; nothing left: '*'."""
    clean = collapse(F.translate(text, '+-|"*()~\\', " " * 9))
    head = clean.substr(1, most)
    cut = F.when(F.length(clean) <= most, clean).when(F.instr(head, " ") > 0, F.regexp_replace(head, r" [^ ]*$", "")).otherwise(head)
    return F.when(cut == "", "*").otherwise(cut)


def fiche_id_for(path: Column) -> Column:
    """First KB number of the last part of a path, else that part without a known extension."""
    name = F.element_at(F.split(path, r"[/\\]"), -1)
    number = F.regexp_extract(name, r"(?i)(KB[0-9]{5,})", 1)
    return F.when(number != "", F.upper(number)).otherwise(F.regexp_replace(name, r"(?i)\.(md|markdown|txt|html|htm|docx|pdf)$", ""))


def step_title(text: Column) -> Column:
    """First clause of 8 to 90 characters, else the first 89 and an ellipsis."""
    line = collapse(text)
    clause = F.regexp_extract(line, r"^([^.;:!?]{8,90})(?:[.;:!?]|$)", 1)
    return F.when(clause != "", F.trim(clause)).when(F.length(line) > 90, F.concat(line.substr(1, 89), F.lit("…"))).otherwise(line)


def fallback_symptom(text: Column, most: int = 160) -> Column:
    line = F.trim(F.substring_index(F.trim(text), "\n", 1))
    head = line.substr(1, most)
    return F.when(F.length(line) <= most, line).otherwise(F.concat(F.regexp_replace(head, r" [^ ]*$", ""), F.lit("...")))


def confidence(score: Column) -> Column:
    return F.when(score.isNull(), "unknown").when(score >= 2.5, "high").when(score >= 1.5, "medium").otherwise("low")


def digest(text: Column, hexes: int = 64) -> Column:
    return F.sha2(text, 256).substr(1, hexes)


def split_half(key: Column, rule: str) -> Column:
    """Deterministic halves by SHA-256: profile (first byte), calibration (last digit), scoreboard (eighth digit)."""
    h = F.sha2(key.cast("string"), 256)
    digit = {"profile": h.substr(2, 1), "calibration": h.substr(64, 1), "scoreboard": h.substr(8, 1)}[rule]
    even = F.conv(digit, 16, 10).cast("int") % 2 == 0
    names = {"profile": ("0", "1"), "calibration": ("calibration", "test"), "scoreboard": ("A", "B")}[rule]
    return F.when(even, names[0]).otherwise(names[1])


def canonical_identifiers(text: Column) -> Column:
    """Article numbers in capitals and hexadecimal codes with a small x, as the extraction reads them."""
    parts = F.split(F.regexp_replace(text, r"(?i)\b(kb\d+|0x[0-9a-f]+)\b", "\x01$1\x01"), "\x01")
    return F.array_join(
        F.transform(parts, lambda x, i: F.when(i % 2 == 0, x).when(F.lower(x).startswith("kb"), F.upper(x)).otherwise(F.concat(F.lit("0x"), x.substr(F.lit(3), F.length(x))))), ""
    )


def label_text(text: Column, title: Column, fiche_id: Column) -> Column:
    """A label without article numbers and the separators around them; else the title so reduced, else the id."""
    bare = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"(?i)\bKB\s?[-_]?\d+\b", " "), r"^[\s\-–—:|]+|[\s\-–—:|]+$|\s+(?=\s)", ""))
    return F.coalesce(F.when(bare(text) != "", bare(text)), F.when(bare(title) != "", bare(title)), fiche_id)


def guide_text(html: Column) -> Column:
    """A knowledge article as lines: comments out, cells apart, block ends as line ends, no empty lines (entities aside)."""
    out = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    out = F.regexp_replace(F.regexp_replace(out, r"(?i)</t[dh]>", " | "), r"(?i)</(?:p|div|li|tr|h\d)>|<br\s*/?>", "\n")
    lines = F.transform(F.split(F.regexp_replace(out, r"<[^>]*>", ""), "\n"), collapse)
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def truncate(text: Column, most: int) -> Column:
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.rtrim(text.substr(1, most - 1)), F.lit("…")))


def initials(name: Column) -> Column:
    """First letters of the first two words, in capitals; '?' without any."""
    words = F.filter(F.split(F.trim(name), r"\s+"), lambda w: w != "")
    letters = F.upper(F.array_join(F.transform(F.slice(words, 1, 2), lambda w: w.substr(1, 1)), ""))
    return F.when(F.size(words) > 0, letters).otherwise("?")


def fingerprint(parts: Column) -> Column:
    """Sixteen hex digits of the SHA-256 of sorted parts, a line each."""
    return F.sha2(F.array_join(F.array_sort(parts), "\n"), 256).substr(1, 16)
