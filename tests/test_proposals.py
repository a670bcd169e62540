"""Proposed steps: placing, merging and linking against step-by-step forms over random documents."""

import random
import re

from askwright.functions import quotes
from askwright.functions.segment import FAILURE
from askwright.operators import proposals as p
from askwright.operators import spans

ASKED = "doc long, ord int, quote string, condition string, failure string"


def fold(text, items):
    """Places by looking at whole words, one proposal after another."""
    def find(quote, after):
        words = [re.escape(w) for w in re.findall(r"\w+", quote or "")]
        if not words:
            return None
        hits = [m.span() for m in re.finditer(r"(?i)\b" + r"\s+".join(words) + r"\b", text)]
        return next((h for h in hits if h[0] >= after), hits[0] if hits else None)

    cursor, taken, out = 0, [], []
    for n, quote, condition, failure in items:
        span = find(quote, cursor)
        if span is None or any(a < span[1] and span[0] < b for a, b in taken):
            out.append((n, None, None, None, None, None, None, True))
            continue
        taken.append(span)
        cursor = span[1]
        c = find(condition, max(0, span[0] - 300))
        if c and (c[0] < span[0] - 300 or c[1] > span[1]):
            c = None
        f = find(failure, span[1])
        out.append((n, *span, *(c or (None, None)), *(f or (None, None)), False))
    return out


def test_places_equal_the_fold(spark):
    rng = random.Random(2)
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma"]
    docs, asked, want = [], [], []
    for doc in range(150):
        text = " ".join(rng.choices(words, k=rng.randint(1, 160)))
        docs.append((doc, text))
        some = lambda: " ".join(rng.choices(words, k=rng.randint(1, 3))).upper() if rng.random() < 0.9 else None
        items = [(n, some(), some(), some()) for n in range(rng.randint(1, 8))]
        asked += [(doc, *x) for x in items]
        want += [(doc, *x) for x in fold(text, items)]
    docs += [(900, None), (901, "")]
    asked += [(900, 0, "alpha", None, None), (901, 0, "alpha", None, None), (902, 0, "alpha", None, None)]
    want += [(d, 0, None, None, None, None, None, None, True) for d in (900, 901, 902)]
    rng.shuffle(asked)
    found = p.locate(spark.createDataFrame(docs, "doc long, text string"), spark.createDataFrame(asked, ASKED))
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)
    assert 100 < sum(r[-1] for r in want) < len(want) - 200 and sum(r[4] is not None for r in want) > 50
    assert p.locate(spark.createDataFrame(docs, "doc long, text string"), spark.createDataFrame([], ASKED)).collect() == []


def test_rewordings_may_not_add_technical_content(spark):
    text = "1. Tapez `ipconfig /all` puis Entrée.\n2. Ouvrez Fichier > Options."
    docs = spark.createDataFrame([(1, text)], "doc long, text string")
    asked = [(1, 0, "Tapez ipconfig /all puis Entrée", None, None), (1, 1, "Ouvrez Fichier > Options", None, None), (1, 2, "absent du texte", None, None)]
    located = p.locate(docs, spark.createDataFrame(asked, ASKED))
    said = [(1, 0, "Lancez `ipconfig /all`"), (1, 0, "Lancez `netsh winsock reset`"), (1, 1, "Allez dans Fichier > Options"), (1, 1, "Erreur 0x80070005"), (1, 2, "Redémarrez")]
    kept = p.kept_instructions(located, docs, spark.createDataFrame(said, "doc long, ord int, instruction string"))
    assert sorted((r.ord, r.instruction) for r in kept.collect()) == [(0, "Lancez `ipconfig /all`"), (1, "Allez dans Fichier > Options")]


def test_overlaps_equal_all_pairs(spark):
    rng = random.Random(3)
    make = lambda: [(rng.randrange(4), a, a + rng.choice([0, 1, 5, 40, 700])) for a in (rng.randrange(2000) for _ in range(120))]
    left, right = make(), make()
    schema = "doc long, start int, end int"
    want = sorted((d, a, b, x, y) for d, a, b in left for e, x, y in right if d == e and a < y and x < b and b > a and y > x)
    for width in (16, 256, 5000):
        found = spans.overlapping(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), width)
        assert sorted((r.doc, r.left.start, r.left.end, r.right.start, r.right.end) for r in found.collect()) == want


def sequential(proposed, rules):
    """Merging and linking of one document, one step after another."""
    def share(a, b):
        return max(0, min(a[1], b[1]) - max(a[0], b[0])) / (max(a[1], b[1]) - min(a[0], b[0]))

    steps, used = [], set()
    for s in proposed:
        s = {**s, "level": 0, "number": None, "after": False, "goto": None, "sources": "proposal"}
        for k in sorted(range(len(rules)), key=lambda k: (-share(s["span"], rules[k]["span"]), -rules[k]["span"][0])):
            r = rules[k]
            if k in used or share(s["span"], r["span"]) < 0.5:
                break
            used.add(k)
            s |= {x: r[x] for x in ("level", "number", "after", "goto")} | {"sources": "proposal|rule"}
            if r["condition"]:
                s |= {"condition": r["condition"], "cond": r["cond"]}
            if r["role"] not in ("other", "unknown", "preamble"):
                s["role"] = r["role"]
            break
        steps.append(s)
    steps = steps or [{**r, "fail": None, "sources": "rule"} for r in rules]
    steps.sort(key=lambda s: s["span"])
    numbers = {}
    for n, s in enumerate(steps, 1):
        s |= {"n": n, "on_failure": None, "to": None}
        s["after"] = s["after"] or bool(s["condition"] and s["cond"] >= s["span"][0] and FAILURE.match(s["condition"]))
        if s["number"] is not None:
            numbers[s["number"]] = n
    for k, s in enumerate(steps):
        before = steps[k - 1] if k else None
        if s["after"] and before and before["on_failure"] is None:
            before["on_failure"] = s["n"]
        goal = numbers.get(s["goto"], s["goto"] if s["goto"] and 1 <= s["goto"] <= len(steps) else None) if s["goto"] is not None else None
        if goal is not None and goal != s["n"]:
            if s["after"] and before:
                before["on_failure"] = goal
            else:
                s["to"] = goal
        if s["fail"] and s["on_failure"] is None:
            s["on_failure"] = next((o["n"] for o in steps if o is not s and share(o["span"], s["fail"]) > 0), None)
    return [(s["n"], *s["span"], s["role"], s["level"], s["condition"], s["after"], s["on_failure"], s["to"], s["sources"]) for s in steps]


def test_merging_and_linking_equal_the_sequence(spark):
    rng = random.Random(5)
    proposed, rules, want = [], [], []
    for doc in range(300):
        edges = sorted(rng.sample(range(0, 900, 2), 2 * rng.randint(1, 9)))
        base = [(a, b) for a, b in zip(edges[::2], edges[1::2])]
        ps, rs = [], []
        for a, b in base:
            said = rng.choice([None, "Sinon", "Si besoin", "si le problème persiste"])
            if rng.random() < 0.7 and doc % 7:
                start = rng.choice([a, a, a - 400])
                ps.append({"span": (a, b), "role": "other", "condition": said, "cond": start, "fail": (f := rng.randrange(900), f + 60) if rng.random() < 0.4 else None})
            if rng.random() < 0.7:
                middle = (a + b) // 2
                for x, y in [(a, middle), (middle, b)] if rng.random() < 0.15 else [(a, max(a + 1, b - rng.choice([0, 1, (b - a) // 2 + 1])))]:
                    rs.append({"span": (x, y), "role": rng.choice(["resolution", "preamble"]), "condition": rng.choice([None, None, "otherwise", "if needed"]), "cond": x,
                               "level": rng.randrange(3), "number": rng.choice([None, 1, 2, 3, 4]), "after": rng.random() < 0.2, "goto": rng.choice([None, None, 0, 1, 2, 3, 9])})
        proposed += [(doc, *s["span"], s["role"], s["condition"], s["cond"], *(s["fail"] or (None, None))) for s in ps]
        rules += [(doc, *s["span"], s["role"], s["condition"], s["cond"], s["level"], s["number"], s["after"], s["goto"]) for s in rs]
        want += [(doc, *x) for x in sequential(ps, rs)]
    a = spark.createDataFrame(proposed, "doc long, start int, end int, role string, condition string, cond_start int, fail_start int, fail_end int")
    b = spark.createDataFrame(rules, "doc long, start int, end int, role string, condition string, cond_start int, level int, number int, after_failure boolean, goto int")
    found = p.link_steps(p.merge_steps(a, b))
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)
    assert p.link_steps(p.merge_steps(a.limit(0), b.limit(0))).collect() == []


def test_sentence_steps_are_letters_of_the_text(spark):
    text = "Bonjour.  Cliquez sur OK !\n Redémarrez le poste ; «Ouvrez Teams». Puis rien.\n\n- Ouvrez ceci. Fermez cela\nVérifiez encore\n\n\tVérifiez l'heure. si besoin. Ok"
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "Ouvrez " * 20_000 + ". Fermez ça")], "doc long, text string")
    found = sorted((r.doc, r.start, r.end, r.step) for r in p.sentence_steps(p.paragraph_blocks(docs)).collect())
    assert [f[3] for f in found if f[0] == 1] == ["Cliquez sur OK !", "Redémarrez le poste ;", "«Ouvrez Teams».", "Vérifiez l'heure. si besoin."]
    assert all(text[a:b] == step for d, a, b, step in found if d == 1)
    assert len([f for f in found if f[0] == 4]) == 2 and quotes.find_quote(text, found[0][3])[0] == found[0][1]
