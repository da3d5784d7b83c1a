"""Plain brute-force versions of the operators, on Python lists."""

from __future__ import annotations

import hashlib
import itertools
import math
import re

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(_LOWER))


def edited(docs: list[tuple[int, str | None]]) -> dict[int, tuple[int, str]]:
    """doc_id -> (n_chars, sha256 of the half-replaced text); unique ids."""
    rows = sorted(docs, reverse=True)
    out = {}
    for i, (d, t) in enumerate(rows):
        t, following = t or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(t) // 2
        text = t[: len(t) - half] + following[:half] if half else t
        out[d] = (len(t), hashlib.sha256(text.encode()).hexdigest())
    return out


def contamination(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]], window: int = 13) -> dict[int, tuple]:
    patterns: dict[tuple, set[str]] = {}
    for item, text in items:
        w = words(text)
        m = min(window, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            patterns.setdefault(tuple(w[i : i + m]), set()).add(str(item))
    sizes = {len(p) for p in patterns}
    out = {}
    for d, text in docs:
        w = words(text)
        hit, found = set(), set()
        for m in sizes:
            for i in range(len(w) - m + 1):
                if (names := patterns.get(tuple(w[i : i + m]))) is not None:
                    hit.update(range(i, i + m))
                    found |= names
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


def dedup_lines(docs: list[tuple[int, str | None]], min_words: int = 50) -> dict[int, str | None]:
    """Unique ids. Deletes each line in a run of min_words words or more that has an earlier copy."""
    rows = sorted((d, t) for d, t in docs if t is not None)
    lines = [(i, j, x) for i, (_, t) in enumerate(rows) for j, x in enumerate(t.split("\n"))]
    place = {}
    for n, (_, _, x) in enumerate(lines):
        place.setdefault(x, []).append(n)
    gone = set()
    for n, (i, _, x) in enumerate(lines):
        best = 0
        for m in place[x]:
            if m >= n:
                break
            k = 0
            while n + k < len(lines) and lines[n + k][0] == i and lines[m + k][0] == lines[m][0] and lines[m + k][2] == lines[n + k][2]:
                k += 1
            best = max(best, k)
        if best and sum(len(lines[n + k][2].split()) for k in range(best)) >= min_words:
            gone.update(range(n, n + best))
    out = {d: t for d, t in docs if t is None}
    for i, group in itertools.groupby(enumerate(lines), key=lambda x: x[1][0]):
        out[rows[i][0]] = "\n".join(x[2] for n, x in group if n not in gone)
    return out


def shingles(text: str | None, n: int = 5) -> frozenset:
    w = words(text)
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def similar(docs: list[tuple[int, str | None]]) -> dict[int, tuple[int, int]]:
    """doc_id -> (class id, links) by all pairs with Jaccard >= 0.8 (through shared shingles); unique ids."""
    sets = {d: shingles(t) for d, t in docs}
    by = {}
    for d, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(d)
    shared: dict[tuple[int, int], int] = {}
    for ds in by.values():
        for a, b in itertools.combinations(sorted(ds), 2):
            shared[a, b] = shared.get((a, b), 0) + 1
    links = dict.fromkeys(sets, 0)
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for (a, b), k in shared.items():
        if 5 * k >= 4 * (len(sets[a]) + len(sets[b]) - k):
            links[a] += 1
            links[b] += 1
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {d: (find(d), links[d]) for d in sets}


def _hash(*parts: str | int | tuple, seed: int = 42) -> int:
    """The public XXH64, chained over values: strings, ints as (value, bytes), each seeded by the hash before."""
    import xxhash

    for p in parts:
        raw = p.encode() if isinstance(p, str) else (p[0] % 2 ** (8 * p[1])).to_bytes(p[1], "little")
        seed = xxhash.xxh64(raw, seed=seed).intdigest()
    return seed - 2**64 if seed >= 2**63 else seed


def imatch(docs: list[tuple[int, str | None]], low: float = 0.001, high: float = 0.05, rates=(16, 64, 256, 1024), subsets=16, few=8) -> dict[int, tuple[str, str, float, float]]:
    """doc_id -> (fingerprint, fingerprint of the edited text, likeness to it, likeness to the next document); unique ids."""
    import re

    terms = lambda t: {w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower()) if w}
    n, df = len(docs), {}
    for _, t in docs:
        for w in terms(t):
            df[w] = df.get(w, 0) + 1
    lo, hi = max(2, low * n), max(2, high * n)
    drawn = {}
    for w, k in df.items():
        if k >= lo:
            h = _hash(w)
            cells = [(i * subsets + c) for i, r in enumerate(rates) if (c := _hash((i + 1, 4), (h, 8)) % r) < subsets]
            drawn[w] = (h | 1 if k > hi else h & -2, k > hi, cells)

    def parts(t):
        out = {}
        known = [drawn[w] for w in terms(t) if w in drawn]
        for name, ok in (("band", lambda over: not over), ("all", lambda over: True)):
            by = {}
            for h, over, cells in known:
                for c in cells if ok(over) else ():
                    by.setdefault(c, []).append(h)
            out[name] = {c: _hash((c, 4), *((h, 8) for h in sorted(hs))) for c, hs in by.items()}
        out["few"] = sum(1 for h, over, cells in known for c in cells if not over and c < subsets) < few
        out["own"] = _hash(t or "")
        return out

    def printed(p):
        x = p["all" if p["few"] else "band"]
        return "-".join(f"{x[c] % 2**64:016x}" for c in sorted(x)) or f"t{p['own'] % 2**64:016x}"

    def likeness(p, q):
        if not p["all"] and not q["all"]:
            return float(p["own"] == q["own"])
        a, b = (x["all" if p["few"] or q["few"] else "band"] for x in (p, q))
        return sum(a.get(c) == b.get(c) for c in a.keys() & b.keys()) / max(1, len(a.keys() | b.keys()))

    order = sorted(((d, t or "") for d, t in docs), reverse=True)
    out = {}
    for (d, t), (_, after) in zip(order, order[1:] + order[:1]):
        half = len(t) // 2
        new = t[: len(t) - half] + after[:half]
        p, q, r = parts(t), parts(new), parts(after)
        out[d] = (printed(p), printed(q), likeness(p, q), likeness(p, r))
    return out


def quality_features(text: str, words: int, shapes: int) -> dict[int, int]:
    """Feature number -> count, by loops over words and signs."""
    top = 2**64 - 1

    def mix(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & top
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & top
        return x ^ (x >> 31)

    out = {}
    for w in globals()["words"](text):
        raw = w.encode()
        h = sum((b + 1) * pow(0x9E3779B97F4A7C15, i, 2**64) for i, b in enumerate(raw)) + len(raw) * 0xD6E8FEB86659FD93 & top
        f = mix(h) % words
        out[f] = out.get(f, 0) + 1
    shape = []
    for b in text.encode():
        s = "l" if 97 <= b <= 122 or b >= 128 else "U" if 65 <= b <= 90 else "0" if 48 <= b <= 57 else " " if b in (9, 11, 12, 13) else chr(b)
        if not (s in "lU0" and shape and shape[-1] == s):
            shape.append(s)
    for n in (3, 4):
        for i in range(len(shape) - n + 1):
            h = n
            for s in shape[i : i + n]:
                h = h * 257 + ord(s) & top
            f = words + mix(h) % shapes
            out[f] = out.get(f, 0) + 1
    return out


def vote(point: list[float], points: list[list[float]], labels: list[int], k: int, power: float) -> float:
    """Score by all cosines: the k nearest, and those as near as the last of them."""
    unit = lambda v: [x / (math.sqrt(sum(y * y for y in v)) or 1) for x in v]
    p = unit(point)
    cosine = [sum(a * b for a, b in zip(p, unit(q))) for q in points]
    last = sorted(cosine)[-min(k, len(cosine))]
    near = [(c**power, y) for c, y in zip(cosine, labels) if c >= last - 2e-6 and c > 0]
    total = sum(w for w, _ in near)
    return sum(w * y for w, y in near) / total if total > 1e-12 else sum(labels) / len(labels)
