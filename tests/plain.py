"""Plain Python versions of the scoring semantics, written apart from the library."""

import re
from collections import Counter
from functools import cache


def normalize(t):
    if not t:
        return ""
    m = re.match(r"\w+[-.)]\s*", t)
    t = t[m.end() :] if m else t
    m = re.match(r"\d+\.\d+\s*", t)
    t = t[m.end() :] if m else t
    return " ".join("".join(ch for ch in t.lower() if re.match(r"[\w\s]", ch)).split())


def lcs(a, b):
    @cache
    def at(i, j):
        if i == len(a) or j == len(b):
            return 0
        return at(i + 1, j + 1) + 1 if a[i] == b[j] else max(at(i + 1, j), at(i, j + 1))

    return at(0, 0)


def ratio(a, b):
    return round(200 * lcs(a, b) / (len(a) + len(b))) / 100 if a or b else 1.0


def match(p, g, t, keywords=None):
    """Score and method of a pair, or None."""
    if p.get("type") != g.get("type"):
        return None
    a, b = p.get("text") or "", g.get("text") or ""
    if min(len(a), len(b)) < 5:
        return (1.0, "exact_match_short") if a.lower().strip() == b.lower().strip() else None
    x, y = normalize(a), normalize(b)
    if x == y:
        return 1.0, "exact_match"
    short, long_ = sorted((len(x), len(y)))
    if short > 10 and (x in y or y in x) and short / long_ >= 0.6:
        return short / long_, "substring_match"
    if (r := ratio(x, y)) >= t:
        return r, "semantic_match"
    if keywords:
        k, m = keywords(a), keywords(b)
        if k and m and len(k & m) / len(k | m) >= t:
            return len(k & m) / len(k | m), "keyword_match"
    return None


def assign(pred, gold, t, keywords=None):
    """Accepted (pred position, gold position, score, method) in order, and the map of ids."""
    edges = [(-m[0], i, j, m[1]) for i, p in enumerate(pred) for j, g in enumerate(gold) if (m := match(p, g, t, keywords))]
    used_p, used_g, out, ids = set(), set(), [], {}
    for s, i, j, how in sorted(edges):
        if i in used_p or j in used_g:
            continue
        used_p.add(i)
        used_g.add(j)
        out.append((i, j, -s, how))
        if pred[i].get("id") and gold[j].get("id"):
            ids[pred[i]["id"]] = gold[j]["id"]
    return out, ids


def hits(pred, gold, ids):
    there = {(r["source"], r["target"], r["type"]) for r in gold}
    return sum((ids.get(r["source"]), ids.get(r["target"]), r["type"]) in there for r in pred)


def score(pred, gold, t, keywords=None):
    """tp, fp, fn of entities and of relations, and the methods' counts."""
    taken, ids = assign(pred["entities"], gold["entities"], t, keywords)
    out = []
    for tp, kind in ((len(taken), "entities"), (hits(pred["relations"], gold["relations"], ids), "relations")):
        out.append((tp, len(pred[kind]) - tp, len(gold[kind]) - tp))
    return out[0], out[1], Counter(how for *_, how in taken)
