"""Plain restatements that the operators' results are held against."""

from __future__ import annotations

import re
import zlib
from struct import pack

import public_tokenizers
from tokenizers import Tokenizer


def tokenizer(name: str) -> Tokenizer:
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return t


def ids_of(t: Tokenizer, text: str | None) -> list[int]:
    return [*t.encode(text or "", add_special_tokens=False).ids, 2]


def crc(ids: list[int]) -> int:
    return zlib.crc32(pack(f"<{len(ids)}I", *ids))


def shingle_set(text: str | None) -> set[tuple[str, ...]]:
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)}


def components(sets: dict[int, set], percent: int = 75) -> dict[int, int]:
    up = {d: d for d in sets}

    def root(x: int) -> int:
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    where: dict = {}
    for d in ids:
        for s in sets[d]:
            where.setdefault(s, []).append(d)
    for a in ids:
        near: dict[int, int] = {}
        for s in sets[a]:
            for b in where[s]:
                if b > a:
                    near[b] = near.get(b, 0) + 1
        for b, both in near.items():
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {d: root(d) for d in ids}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def pii_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    for kind, pattern in PII.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False,
                "card": 13 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def bootstrap(found: list[dict], least_docs: int, least_trust: float, least_score: float, turns: int) -> set[tuple]:
    """Spans (row, kind, start, end) that pattern-instance scoring adds to occurrences (dicts)."""
    base: dict[str, str] = {}
    shape, seed = {}, {}
    instances, docs = {}, {}
    for o in found:
        if o["kind"]:
            base[o["node"]] = min(base.get(o["node"], o["kind"]), o["kind"])
        if o["shape"]:
            shape[o["node"]] = min(shape.get(o["node"], o["shape"]), o["shape"])
        seed[o["node"]] = seed.get(o["node"], False) or o["seed"]
        for c in o["contexts"]:
            instances.setdefault(c, set()).add(o["node"])
            docs.setdefault(c, set()).add(o["_row"])
    able = {c: i for c, i in instances.items() if len(docs[c]) >= least_docs and len(i) >= least_docs}
    known = {n: base.get(n) or "secret" for n in seed if n in base or seed[n]}
    news: dict[str, str] = {}
    for _ in range(turns):
        trusted = {}
        for c, nodes in able.items():
            counts: dict[str, int] = {}
            for n in nodes & known.keys():
                counts[known[n]] = counts.get(known[n], 0) + 1
            if counts:
                n, of = max((n, k) for k, n in counts.items())
                if n / (len(nodes) + 1) >= least_trust:
                    trusted[c] = of, n / (len(nodes) + 1)
        fresh = {}
        for node, form in shape.items():
            if node in base or node in news:
                continue
            doubt: dict[str, float] = {}
            for c, (of, trust) in trusted.items():
                if node in able[c] and (form == of or (of == "secret" and seed[node])):
                    doubt[of] = doubt.get(of, 1.0) * (1 - min(trust, 0.999))
            passed = [(1 - d, k) for k, d in doubt.items() if 1 - d >= least_score]
            if passed:
                fresh[node] = max(passed)[1]
        if not fresh:
            break
        news |= fresh
        known |= fresh
    named = news | base
    return {(o["_row"], named[o["node"]], o["start"], o["end"]) for o in found if not o["kind"] and o["node"] in named}


def without_templates(rows: list[tuple], similarity: float, documents: int) -> list[tuple]:
    """Documents (id, text) without the lines of templates that recur, by a plain tree."""
    import xxhash

    def mask(line: str) -> tuple[str, ...]:
        own = line.split()
        out = ["<*>" if any(c.isdigit() for c in t) else t for t in own]
        return tuple(own if len(own) < 4 and set(out) == {"<*>"} else out)

    name = {}
    for _, text in rows:
        for x in (text or "").split("\n"):
            if m := mask(x):
                name[m] = xxhash.xxh3_64_intdigest("\0".join(m).encode()) & (1 << 63) - 1
    leaves: dict[tuple, list] = {}
    for m in sorted(name, key=name.get):
        leaves.setdefault((len(m), m[:3]), []).append(m)
    template = {}
    for lines in leaves.values():
        up, items = {m: m for m in lines}, [(m, list(m)) for m in lines]
        while True:
            kept: list[tuple] = []
            for m, tokens in items:
                best, most = None, -1.0
                for other, held in kept:
                    pairs = list(zip(tokens, held))
                    agree = sum("<*>" in p or p[0] == p[1] for p in pairs) / len(pairs)
                    fixed = sum("<*>" not in p and p[0] == p[1] for p in pairs) / len(pairs)
                    if fixed < similarity - 0.2:
                        agree = 0
                    if agree > most:
                        best, most = (other, held), agree
                if best is not None and most >= similarity:
                    best[1][:] = [a if a == b else "<*>" for a, b in zip(best[1], tokens)]
                    up[m] = best[0]
                else:
                    kept.append((m, list(tokens)))
            done = len(kept) == len(items)
            items = kept
            if done:
                break
        for m in lines:
            at = m
            while up[at] != at:
                at = up[at]
            template[m] = at
    where: dict[tuple, set] = {}
    for d, text in rows:
        for x in (text or "").split("\n"):
            if m := mask(x):
                where.setdefault(template[m], set()).add((d, text))
    common = set()
    for m, docs in where.items():
        n = len(m)
        need = 2 * documents if n < 4 else documents - (documents - min(documents, 2)) * (min(n, 50) - 4) // 46
        if len(docs) >= max(need, documents) or len({t for _, t in docs}) >= need:
            common.add(m)
    return [(d, "\n".join(x for x in (text or "").split("\n") if template.get(mask(x)) not in common)) for d, text in rows]


def mixed(rows: list[tuple], mixing) -> tuple[dict[int, tuple], float]:
    """Each document's source, language, topic, tokens, raked share and probability, and the margins' residual."""
    from math import log

    def features(text: str | None) -> list[int]:
        words = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").replace("\n", " ").split(" ")
        return [zlib.crc32(w.strip(".,;:!?\"'()[]#$%&*|").encode()) % mixing.CELLS for w in words]

    documents: dict[int, int] = {}
    for _, text, *_ in rows:
        for f in set(features(text)):
            documents[f] = documents.get(f, 0) + 1
    able = [f for f, n in documents.items() if mixing.LEAST <= n <= mixing.COMMON * len(rows)]
    chosen = sorted(able, key=lambda f: (-documents[f], f))[: mixing.TOPICS]
    cell, tokens = {}, {}
    for d, text, lang, source, *_ in rows:
        own = features(text)
        scores = [(own.count(f) * log(len(rows) / documents[f]), -k) for k, f in enumerate(chosen)]
        best = max(scores, default=(0, 0))
        cell[d] = source or "", lang or "", f"t{chosen[-best[1]]}" if best[0] > 0 else "other"
        tokens[d] = len(own)
    sums: dict[tuple, float] = {}
    for d, c in cell.items():
        sums[c] = sums.get(c, 0) + tokens[d]
    total = sum(sums.values())
    margin = lambda w, m: {v: sum(x for c, x in w.items() if c[m] == v) for v in {c[m] for c in w}}
    shares = []
    for m in range(3):
        raw = {v: n**mixing.TEMPER for v, n in margin(sums, m).items()}
        shares.append({v: x / sum(raw.values()) for v, x in raw.items()})
    w = {c: n / total for c, n in sums.items()}
    for _ in range(mixing.SWEEPS):
        worst = 0.0
        for m in range(3):
            now = margin(w, m)
            worst = max(worst, max(abs(now[v] - s) for v, s in shares[m].items()))
            w = {c: x * shares[m][c[m]] / now[c[m]] for c, x in w.items()}
        if worst < mixing.TOLERANCE:
            break
    whole = sum(w.values())
    w = {c: x / whole for c, x in w.items()}
    residual = max(abs(margin(w, m)[v] - s) for m in range(3) for v, s in shares[m].items())
    low, high = 0.0, 1 / min(w[c] / n for c, n in sums.items())
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(1, mid * w[c] / n) * n for c, n in sums.items()) < mixing.BUDGET * total else (low, mid)
    return {d: (*c, tokens[d], w[c], min(1, high * w[c] / sums[c])) for d, c in cell.items()}, residual


def severity(text: str | None, model) -> tuple[float, float]:
    """P(toxic) and expected severity from the model's features, weights and thresholds."""
    from math import exp, log

    words = set((text or "").lower().split())
    counts: dict[str, int] = {}
    for word in words:
        core = re.sub(r"^\W+|\W+$", "", word)
        for f in [core, *(core[:k] + "-" for k in (2, 3, 4, 5) if len(core) > k)] if core else []:
            counts[f] = counts.get(f, 0) + 1
    weight = dict(zip(model.features, model.weights))
    score = model.length_weight * log(1 + len(words)) + sum(weight[f] * log(1 + n) for f, n in counts.items() if f in weight)
    p = [1 / (1 + exp(min(60, max(-60, t - score)))) for t in model.thresholds]
    return p[0], sum(p)
