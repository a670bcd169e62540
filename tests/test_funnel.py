"""The semantic funnel against its rules, question by question, over small random worlds."""

import random

import numpy as np
import pytest

from askwright.operators import funnel

LEVELS = ["answered", "cited", "identifier", "update"]


def brute_pool(named, carried):
    """Articles that the longest possible beginning of the known levels keeps, and whether a designating level is among them."""
    known = {lv: sorted({e for level, e in named if level == lv and e in carried}) for lv in LEVELS}
    active = [lv for lv in LEVELS if known[lv]]
    for n in range(len(active), 0, -1):
        kept = None
        for lv in active[:n]:
            sets = [carried[e] for e in known[lv]]
            reach = set.intersection(*sets) if lv == "answered" else set.union(*sets)
            kept = reach if kept is None else kept & reach
        if kept:
            return kept, bool({"answered", "cited"} & set(active[:n]))
    return None, False


def brute_find(q, vector, named, carried, entries, same, newer, floor, margin, offer):
    stand = lambda f: newer.get(same.get(f, f), same.get(f, f))
    pool, designated = brute_pool(named, carried)
    strong = pool is not None
    pool = {stand(f) for f in (pool if strong else {f for _, f, _ in entries if f not in same})}
    best = {}
    for entry, fiche, v in entries:
        if fiche in pool and entry != q:
            best.setdefault(fiche, []).append(round(sum(a * b for a, b in zip(vector, v)), 6))
    ranked = sorted(((-max(s), f) for f, s in best.items()))
    if not ranked:
        return "abstain", "semantic_no_candidate", None, None, None
    first, second = -ranked[0][0], -ranked[1][0] if len(ranked) > 1 else None
    lead = second is None or (round(first - second, 6) > 0 and round(first - second, 6) >= margin)
    if designated and second is None or first >= (offer if strong and floor <= 1 else floor) and lead:
        return "fiche", "semantic_" + ("designated" if designated else "single" if second is None else "clear_lead"), ranked[0][1], None, None
    if first < offer:
        return "abstain", "semantic_nothing_close", None, None, None
    close = [f for s, f in ranked if -s >= offer and round(first + s, 6) < margin]
    spoken = {e for _, e in named}
    if len(close) > 1:
        for kind in ("app", "err", "evt", "os"):
            values = {f: {e for e, fs in carried.items() if f in fs and e.startswith(kind + ":") and e not in spoken} for f in close}
            if all(values.values()):
                telling = {e for v in values.values() for e in v if any(e not in values[f] for f in close)}
                if 2 <= len(telling) <= 5 and all(values[f] & telling for f in close):
                    return "question", "semantic_close_entity", None, kind, sorted(telling)
    reason = "semantic_close_choice" if first >= floor else "semantic_below_floor"
    return "question", reason, None, "fiche", [str(f) for s, f in ranked if -s >= offer][:3]


def world(seed):
    rng = random.Random(seed)
    fiches = list(range(12))
    entries = [(100 + i, rng.choice(fiches), [rng.choice([-0.6, 0.0, 0.3, 0.6]) for _ in range(3)]) for i in range(30)]
    entries += [(200 + i, f, v) for i, (_, f, v) in enumerate(entries[:6])]  # equal scores
    index = [(f"{kind}:{rng.randrange(3)}", f) for kind in ("app", "err", "os", "update", "kb") for f in fiches if rng.random() < 0.8]
    index += index[:5]  # repeated rows
    same, newer = {11: 10, 9: 8}, {8: 3, 5: 6}
    questions, asked = [], []
    for q in range(40):
        questions.append((q, -1, [rng.choice([-0.6, 0.0, 0.3, 0.6]) for _ in range(3)]))
        for _ in range(rng.choice([0, 1, 2, 3, 4])):
            level = rng.choice(LEVELS + ["application"])
            asked.append((q, level, f"{rng.choice(['app', 'err', 'os', 'update', 'kb', 'none'])}:{rng.randrange(3)}"))
    questions.append((104, -1, entries[4][2]))  # a question that is an entry
    return questions, asked, index, entries, same, newer


@pytest.mark.parametrize("seed, thresholds", [(1, (0.45, 0.1, 0.2)), (2, (0.3, 0.2, 0.1)), (3, (1.1, 0.05, 0.2))])
def test_decisions_equal_the_rules(spark, seed, thresholds):
    floor, margin, offer = thresholds
    questions, asked, index, entries, same, newer = world(seed)
    q = spark.createDataFrame(questions, "query long, own long, vector array<float>")
    a = spark.createDataFrame(asked, "query long, level string, entity string")
    i = spark.createDataFrame(index, "entity string, fiche long")
    e = spark.createDataFrame(entries, "entry long, fiche long, vector array<float>")
    canonical = spark.createDataFrame(list(same.items()), "fiche long, canonical long")
    superseded = spark.createDataFrame(list(newer.items()), "fiche long, superseded_by long")
    scores = funnel.funnel_scores(q, a, i, e, canonical, superseded, top=5, least=offer)
    found = {r["query"]: r for r in funnel.semantic_find(scores, q, a, i, floor, margin, offer).collect()}
    assert len(found) == len(questions)
    carried = {}
    for entity, fiche in index:
        carried.setdefault(entity, set()).add(fiche)
    f32 = lambda v: [np.float32(x).item() for x in v]
    reasons = set()
    for number, _, vector in questions:
        named = [(lv, x) for who, lv, x in asked if who == number]
        want = brute_find(number, f32(vector), named, carried, [(n, f, f32(v)) for n, f, v in entries], same, newer, floor, margin, offer)
        r = found[number]
        assert (r.kind, r.reason, r.fiche, r.asks, r.options) == want, number
        reasons.add(r.reason)
    assert len(reasons) >= 4


def test_pool_is_joined_before_vectors_are_multiplied(spark):
    """No nested loop: candidates meet their entries and their question by equal keys; only the pool's pairs are multiplied."""
    q = spark.createDataFrame([(1, 0, [1.0]), (2, 0, [1.0])], "query long, own long, vector array<float>")
    e = spark.createDataFrame([(i, i % 10, [0.5]) for i in range(100)], "entry long, fiche long, vector array<float>")
    scores = funnel.pool_scores(q, spark.createDataFrame([(1, 3), (2, 4), (2, 5)], "query long, fiche long"), e)
    plan = scores._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert sorted((r["query"], r["fiche"]) for r in scores.collect()) == [(1, 3), (2, 4), (2, 5)]


def test_nothing_to_ask_and_nothing_to_find(spark):
    q = spark.createDataFrame([(1, 0, [1.0])], "query long, own long, vector array<float>")
    none = lambda s: spark.createDataFrame([], s)
    a, i, e = none("query long, level string, entity string"), none("entity string, fiche long"), none("entry long, fiche long, vector array<float>")
    twins = none("fiche long, canonical long"), none("fiche long, superseded_by long")
    found = funnel.semantic_find(funnel.funnel_scores(q, a, i, e, *twins), q, a, i, 0.4, 0.1, 0.2).collect()
    assert [(r.kind, r.reason, r.ranked, r.candidates) for r in found] == [("abstain", "semantic_no_candidate", [], 0)]
    assert funnel.semantic_find(funnel.funnel_scores(q.limit(0), a, i, e, *twins), q.limit(0), a, i, 0.4, 0.1, 0.2).collect() == []
