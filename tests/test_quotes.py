"""Quotes: golden cases, and random texts against a search in normal form, character by character."""

import random

import pyarrow as pa
import pytest

from askwright.functions import quotes
from askwright.functions.unicode_text import normal_form

TEXT = "Intro.\n1. Fermez  Outlook.\n2. L’imprimante affiche « Erreur 0x80070005 » :\n   cliquez sur **OK**."


@pytest.mark.parametrize(
    "text, quote, want",
    [
        (TEXT, "1. Fermez Outlook.", "Fermez  Outlook."),
        (TEXT, "L'imprimante affiche \"Erreur 0x80070005\": cliquez sur OK.", TEXT[TEXT.index("L’") :]),
        ("Redémarrez le poste puis relancez.", "Redémarrez l'ordinateur puis relancez.", None),
        ("Redémarrez le poste puis relancez.", "émarrez le poste", None),
        ("Redémarrez le poste puis relancez.", "Re", None),
        ("Redémarrez le poste puis relancez.", "Redémarrez le poste…", "Redémarrez le poste"),
        ("Tapez `ipconfig /all` puis Entrée", "tapez ipconfig /all", "Tapez `ipconfig /all`"),
        ("Fichier – Options", "fichier - options", "Fichier – Options"),
        ("cliquez sur O**K** ici", "sur OK", "sur O**K**"),
        ("démarrer", "demarrer", None),
        ("ouvrez écran", "Écran", None),
        ("foo_bar baz", "bar baz", "bar baz"),
        ("a  b", " ", None),
        ("", "abc", None),
        (None, "abc", None),
        ("abc", None, None),
        ("STRASSE Straße", "strasse straße", "STRASSE Straße"),
        ("x " * 50_000 + "the end", "The End!", "the end"),
    ],
)
def test_golden_spans(text, quote, want):
    span = quotes.find_quote(text, quote)
    assert (text[slice(*span)] if span else None) == want


def test_order_is_kept():
    text = "Redémarrez le poste. Ouvrez Teams. Redémarrez le poste."
    source = quotes.Source(text)
    first = source.find("redémarrez le poste")
    assert first == (0, 19) and source.find("Redémarrez le poste", first[1])[0] == text.rindex("R")
    assert source.find("Ouvrez Teams", len(text)) == source.find("Ouvrez Teams")  # nothing after: from the start


def slow(text, quote):
    """The first place where the quote's normal form stands between characters of the text that are no letters or digits."""
    body, places = normal_form(text)
    needle = normal_form(quote)[0].strip().rstrip(" .;:,!")
    for i in range(len(body) if len(needle) >= 3 else 0):
        if body.startswith(needle, i):
            start, stop = places[i], places[i + len(needle) - 1] + 1
            if not text[start - 1 : start].isalnum() and not text[stop : stop + 1].isalnum():
                return start, stop
    return None


def test_random_texts_equal_a_search_by_characters():
    rng = random.Random(1)
    found = 0
    for _ in range(4000):
        text = "".join(rng.choices(["ab", "Cd", "é", "x", " ", " ", "  ", "\n", ",", "’", '"', "(", ")", "-", "–"], k=rng.randint(1, 30)))
        a = rng.randrange(len(text))
        quote = text[a : a + rng.randint(1, 12)].upper().strip()
        if not quote or quotes.re.match(quotes.LIST_MARKER, quote):
            continue
        want, got = slow(text, quote), quotes.find_quote(text, quote)
        assert got == want, (text, quote)
        found += want is not None
    assert found > 500


def test_whole_texts_are_cut_by_arrays(monkeypatch):
    """what arrays cut equals what the tokens of chunks give, and a text of such characters goes through no chunk."""
    rng = random.Random(2)
    made = ["".join(rng.choices(["ab", "C9", "é", "_", " ", "\t", "\n", ".", "’", "«", "(", ":", "–", "²", "日", "\0"], k=rng.randint(0, 40))) for _ in range(500)]
    for text in made:
        forms, starts, stops = quotes.tokens(text)
        offsets = [sum(map(len, forms[:i])) for i in range(len(forms) + 1)]
        assert quotes._cut(text) == ("".join(forms), offsets, starts, stops), text
    assert all(quotes._cut(x) is None for x in ("a*b", "Straße", "…", "é", "\U0001f600"))
    some = [*made, None, "", "  2. Straße *x*.", "a) ﬁn !"]
    assert quotes.needles(some) == [quotes.needle_of(quotes._bare(q)) if q else "" for q in some]
    monkeypatch.setattr(quotes, "_pieces", None)
    assert quotes.find_quote("Ouvrez l’écran (F2), puis « Fermer ».", "L'ÉCRAN (f2)") == (7, 19)


def test_a_batch_cuts_each_text_and_quote_once(monkeypatch):
    """rows give what find_quote() gives, and equal texts, quotes and pairs of a batch are not cut or looked for again."""
    rng = random.Random(4)
    some = ["".join(rng.choices(["ab", "Cd", "é", " ", " ", "\n", ",", "’", "«", "(", "…", "*", "2. "], k=rng.randint(0, 30))) for _ in range(60)]
    asked = [None, "", " ", "ab", *(t[2:9].upper() for t in some)]
    rows = [(rng.choice([None, *some]), rng.choice(asked)) for _ in range(3000)] + [(t, t[2:9].upper()) for t in some]
    want = [quotes.find_quote(t, q) or (None, None) for t, q in rows]
    count = {"sources": 0, "cuts": 0}

    class Counted(quotes.Source):
        def __init__(self, text):
            count["sources"] += 1
            super().__init__(text)

    cut = quotes._cut_into
    monkeypatch.setattr(quotes, "Source", Counted)
    monkeypatch.setattr(quotes, "_cut_into", lambda *a: (count.update(cuts=count["cuts"] + 1), cut(*a)))
    got = quotes.find_quote_udf.func(*(pa.array(c, pa.string()) for c in zip(*rows))).to_pylist()
    assert [(x["start"], x["end"]) for x in got] == want and sum(a is not None for a, _ in want) > 30
    assert count["sources"] <= len(set(some)) and count["cuts"] == 2
    monkeypatch.setattr(quotes, "CUT", 20)
    assert quotes.find_quote_udf.func(*(pa.array(c, pa.string()) for c in zip(*rows))).to_pylist() == got
    assert len(quotes.find_quote_udf.func(pa.array([], pa.string()), pa.array([], pa.string()))) == 0
