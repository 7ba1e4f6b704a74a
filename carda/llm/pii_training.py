"""Fit the personal-item tagger: python -m carda.llm.pii_training SF_DIR [ROWS].

At most ROWS texts (default 12,000: job descriptions and post contents in id order, two to one) are labelled by where an item stands: what follows a word
announcing a phone, a document, a place or a person is one. The conditional random field then learns the items' own
shapes along with their surroundings; context features are dropped at random while fitting, so that items are also
known by themselves. A tenth of the rows is held out.
"""

from __future__ import annotations

import json
import math
import random
import re
import sys
from collections import Counter, defaultdict
from pathlib import Path

import pandas as pd

from carda.llm import pii
from carda.llm.pii import MAX_SPAN, candidates, decode, narrow, span_features

# Words that announce an item, used for labels only.
ANNOUNCE = {
    "phone": r"(?:请打|手机|来电|☎|请致电|电话[:：]|Teléfono:|Llamar al|Tfno|Interesados,) ?$",
    "id_number": r"(?:居留号[:：]|证号|证件|con documento|NIE/DNI:|a nombre de) ?$",
    "name": r"(?:联系人[:：]|请问|负责人|店找|Contacto: Sra?\.|Preguntar por|Pregunta por D\.|Persona responsable:) ?$",
    "address": r"(?:地址[:：]|店在|请到|Dirección:|Entrevistas en|encontrarás en) ?$",
}
_NAME_END = re.compile(r"^(?:，随时|，中文| ?。| ?！| ?!|\.| en el local|$|\n| )")


def gold(n: str, c: list[tuple[int, int, str]]) -> list[int]:
    """The candidates that are items: announced ones, longest first, and every e-mail."""
    out: list[int] = []
    taken: list[tuple[int, int]] = []
    for i in sorted(range(len(c)), key=lambda i: (-(c[i][1] - c[i][0]), c[i][0])):
        a, b, t = c[i]
        if b - a > MAX_SPAN[t] or any(a < y and x < b for x, y in taken):
            continue
        if t == "email" or (re.search(ANNOUNCE[t], n[max(0, a - 24) : a]) and (t != "name" or _NAME_END.match(n[b : b + 9]))):
            if t == "phone" and sum(ch.isdigit() or ch in pii.HAN_DIGITS for ch in n[a:b]) < 9:
                continue
            out.append(i)
            taken.append((a, b))
    return sorted(out, key=lambda i: c[i][0])


def marginals(c: list[tuple[int, int, str]], s: list[float]) -> tuple[float, list[float]]:
    """Log partition function over segmentations and each candidate's probability, by forward and backward sums."""
    points = sorted({0, *(x for a, b, _ in c for x in (a, b))})
    at = {p: k for k, p in enumerate(points)}
    fwd = [-math.inf] * len(points)
    fwd[0] = 0.0
    by_end, by_start = defaultdict(list), defaultdict(list)
    for i, (a, b, _) in enumerate(c):
        by_end[at[b]].append(i)
        by_start[at[a]].append(i)

    def add(x: float, y: float) -> float:
        if x == -math.inf:
            return y
        if y == -math.inf:
            return x
        return max(x, y) + math.log1p(math.exp(-abs(x - y)))

    for k in range(1, len(points)):
        v = fwd[k - 1]
        for i in by_end[k]:
            v = add(v, fwd[at[c[i][0]]] + s[i])
        fwd[k] = v
    bwd = [0.0] * len(points)
    for k in range(len(points) - 2, -1, -1):
        v = bwd[k + 1]
        for i in by_start[k]:
            v = add(v, bwd[at[c[i][1]]] + s[i])
        bwd[k] = v
    z = fwd[-1]
    return z, [math.exp(min(0.0, fwd[at[a]] + s[i] + bwd[at[b]] - z)) for i, (a, b, _) in enumerate(c)]


def fit(rows: list[tuple[str, list, list[int]]], epochs: int = 5, rate: float = 0.4, l2: float = 1e-4, drop: float = 0.35, seed: int = 11) -> dict[str, float]:
    w: dict[str, float] = defaultdict(float)
    g2: dict[str, float] = defaultdict(lambda: 1e-6)
    r = random.Random(seed)
    feats = [[span_features(n, *x) for x in c] for n, c, _ in rows]
    for epoch in range(epochs):
        loss = 0.0
        order = list(range(len(rows)))
        r.shuffle(order)
        for k in order:
            n, c, y = rows[k]
            no_context = r.random() < drop
            fs = [[f for f in ff if not (no_context and ("|c=" in f or "|l" in f.replace("|len", "") or "&c=" in f))] for ff in feats[k]]
            s = [sum(w.get(f, 0.0) for f in ff) for ff in fs]
            z, p = marginals(c, s)
            loss += z - sum(s[i] for i in y)
            grad: dict[str, float] = defaultdict(float)
            for i, ff in enumerate(fs):
                d = (i in y) - p[i]
                if abs(d) > 1e-4:
                    for f in ff:
                        grad[f] += d
            for f, d in grad.items():
                d -= l2 * w[f]
                g2[f] += d * d
                w[f] += rate * d / math.sqrt(g2[f])
        print("epoch", epoch, "loss per row", round(loss / max(1, len(rows)), 4), flush=True)
    return w


def main(sf_dir: str, limit: int = 12_000) -> None:
    jobs = pd.read_parquet(f"{sf_dir}/jobs_clean.parquet", columns=["id", "description"]).sort_values("id")
    posts = pd.read_parquet(f"{sf_dir}/posts.parquet", columns=["id", "content"]).sort_values("id")
    texts = [t for t in jobs.description if isinstance(t, str) and t][: limit * 2 // 3] + [t for t in posts.content if isinstance(t, str) and t][: limit // 3]
    given: Counter = Counter()
    for t in texts:
        for m in re.finditer(r"(?:Sra?\. |por D\. |Preguntar por |responsable: |请问|联系人：|到店找 |负责人)([A-ZÁÉÍÓÚÑ][\wáéíóúñ]+)", t):
            given[m[1].lower()] += 1
    names = sorted(g for g, k in given.items() if k >= 3)
    pii._given_names = lambda: frozenset(names)
    rows = []
    for t in texts:
        n = narrow(t)
        c = [x for x in candidates(n) if x[1] - x[0] <= MAX_SPAN[x[2]]]
        if c:
            rows.append((n, c, gold(n, c)))
    held = rows[::10]
    w = fit([x for k, x in enumerate(rows) if k % 10])
    w = {f: round(v, 3) for f, v in w.items() if abs(v) >= 0.05}
    hit = miss = extra = 0
    for n, c, y in held:
        got = set(decode(c, [sum(w.get(f, 0.0) for f in span_features(n, *x)) for x in c]))
        hit, miss, extra = hit + len(got & set(y)), miss + len(set(y) - got), extra + len(got - set(y))
    print(f"held out: {hit} right, {miss} missed, {extra} extra; {len(w)} weights")
    Path(pii.__file__).with_name("pii_model.json").write_text(json.dumps({"given": names, "weights": dict(sorted(w.items()))}, ensure_ascii=False, indent=0))


if __name__ == "__main__":
    main(sys.argv[1], *(int(a) for a in sys.argv[2:3]))
