"""Plain Python versions of operators, for small tables."""

from __future__ import annotations

import hashlib
import math
import os
import re
from collections import defaultdict

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fingerprint(text: str | None) -> int:
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = WORD.findall(low)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints: dict[int, int], radius: int = 3) -> dict[int, int]:
    """Per doc_id the smallest doc_id reachable; all pairs are compared."""
    ids, up = sorted(prints), {i: i for i in prints}

    def top(i: int) -> int:
        while up[i] != i:
            i = up[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return {i: top(i) for i in ids}


def without_repeats(texts: dict[int, str], least: int = 50) -> dict[int, tuple[str, int, int]]:
    """Per doc_id the text left, its lines and the lines removed."""
    runs, own = defaultdict(list), {i: t.split("\n") for i, t in texts.items()}
    for i in sorted(own):
        sizes = [len(WORD.findall(x)) for x in own[i]]
        found = set()
        for a in range(len(sizes)):
            for b in range(a, len(sizes)):
                if sum(sizes[a : b + 1]) >= least:
                    found.add((a, b))
                    break
        for b in range(len(sizes)):
            for a in range(b, -1, -1):
                if sum(sizes[a : b + 1]) >= least:
                    found.add((a, b))
                    break
        for a, b in found:
            runs[tuple(own[i][a : b + 1])].append((i, a, b))
    gone = defaultdict(set)
    for places in runs.values():
        for i, a, b in sorted(places)[1:]:
            gone[i].update(range(a, b + 1))
    return {i: ("\n".join(x for k, x in enumerate(ls) if k not in gone[i]), len(ls), len(gone[i])) for i, ls in own.items()}


def copies(docs: dict[int, tuple[str, str]], seed: int, power: float = 0.5) -> dict[int, int]:
    """Per doc_id (text, source) the number of copies of a Poisson mixture."""
    size = defaultdict(int)
    for text, source in docs.values():
        size[source] += len(text)
    share = {s: n**power for s, n in size.items()}
    out = {}
    for i, (_, source) in docs.items():
        rate = share[source] / sum(share.values()) * sum(size.values()) / size[source]
        u = int(hashlib.md5(f"count:{seed}:{i}".encode()).hexdigest()[:13], 16) / 2**52
        log, total, n = -rate, math.exp(-rate), 0
        while total <= u:
            n += 1
            log += math.log(rate / n)
            total += math.exp(log)
        out[i] = n
    return out


def cnn_score(net, text: str, chunk: int) -> float:
    """The network's score, window by window."""
    x = list(text.encode().ljust(net.width, b"\0"))
    windows = [sum(net.tables[k][x[i + k]] for k in range(net.width)) for i in range(len(x) - net.width + 1)]
    n = max(1, len(windows) // chunk)
    maxima = [np.max(windows[c * chunk : (c + 1) * chunk if c + 1 < n else None], axis=0) + net.bias for c in range(n)]
    z = np.concatenate([np.max(maxima, axis=0), np.mean(maxima, axis=0), np.min(maxima, axis=0)])
    return float(1 / (1 + np.exp(-(np.maximum(z, 0) @ net.out + net.rest))))


def spans(turns: list, template) -> tuple:
    """Chat spans from all prefixes at once, compared character by character."""
    outs = [template(turns[: k + 1]) for k in range(len(turns))]
    replaced = [a[len(os.path.commonprefix([a, b])) :] for a, b in zip(outs, outs[1:], strict=False)]
    closing = next((r for r in sorted({"", *replaced}, key=len, reverse=True) if all(o.endswith(r) for o in outs)), "")
    rewritten = next((k + 1 for k, r in enumerate(replaced) if len(r) > len(closing)), None)
    ends = [len(o) - len(closing) for o in outs]
    whole = len(outs) if rewritten is None else rewritten
    return outs[-1] if outs else "", [(a, b) if k < whole else (0, 0) for k, (a, b) in enumerate(zip([0, *ends], ends, strict=False))], rewritten


def poisson_upto(rate: float, k: int) -> float:
    """The probability of at most k, each term by itself."""
    low = max(0, math.floor(rate - 15 * math.sqrt(rate) - 60))
    return math.fsum(math.exp(i * math.log(rate) - rate - math.lgamma(i + 1)) for i in range(low, k + 1))


def quality_statistics(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = defaultdict(list)
    for i in range(len(words) - 2):
        windows[tuple(words[i : i + 3])].append(i)
    repeated = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated)


def robust(x: np.ndarray, factor: float, floors: tuple, prior: tuple, prior_rows: int, share: float, per_e: int, starts: list | None = None) -> tuple[float, np.ndarray]:
    """The smallest determinant, and the squared distances by its estimate: concentration steps with numpy's covariance,
    inverse and determinant, until the rows chosen stay the same."""
    n, p = x.shape
    fixed = np.diag(np.square(np.array(floors, float)))

    def estimate(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c = np.cov(rows.T, bias=True).reshape(p, p) * factor
        return rows.mean(axis=0), (len(rows) * c + prior_rows * np.diag(np.square(np.array(prior, float)))) / (len(rows) + prior_rows) + fixed

    def distances(m: np.ndarray, c: np.ndarray) -> np.ndarray:
        return np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)

    if starts is None:
        binned = np.sort(np.floor(x / 50), axis=0)
        q1, q2, q3 = (binned[math.ceil(q * n / 4) - 1] for q in (1, 2, 3))
        starts = [(q2 * 50, np.diag(np.square((q3 - q1) * 50 / 1.349)) + fixed), estimate(x), (q2 * 50, fixed)]
    else:
        starts = [estimate(x[at]) for at in starts]
    best = None
    for m, c in starts:
        before = None
        for _ in range(20):
            d = distances(m, c)
            bins = np.floor(per_e * np.log1p(d))
            near = bins <= np.sort(bins)[math.ceil(share * n) - 1]
            m, c = estimate(x[near])
            if before is not None and (near == before).all():
                break
            before = near
        if best is None or np.linalg.det(c) < best[0] * (1 - 1e-9):
            best = np.linalg.det(c), distances(m, c)
    return best


def toxicity_features(text: str, words: dict, stems: dict, second: set, signs: str, plain: dict) -> list[float]:
    """The dense features, word by word."""
    disguised = re.compile(r"[^\W\d_][0-9@$!*.\-_']+[^\W\d_]|^[0-9@$]+[^\W\d_]{2}")
    trim = lambda w: w.lower().strip(signs)

    def look(w: str) -> tuple[str, float]:
        if w in words:
            return "word", words[w]
        best = max([stems[w[:k]] for k in range(3, 9) if len(w) >= k and w[:k] in stems], default=0.0)
        return ("stem", best) if best else ("", 0.0)

    raw = text.split()
    kinds, weights, seconds, caps, hidden, undone = [], [], [], 0, 0, 0
    for i, r in enumerate(raw):
        w = trim(r)
        kind, weight = look(w)
        if w in second:
            seconds.append(i)
        caps += len(w) > 1 and r.isupper()
        if disguised.search(w):
            hidden += 1
            if not weight:
                kind, weight = look(trim(w.translate(plain)))
                undone += kind != ""
        kinds.append(kind)
        weights.append(min(255, round(10 * weight)) / 10)
    n, hits = max(1, len(raw)), [i for i, k in enumerate(kinds) if k]
    near = sum(1 for i in hits if seconds and min(abs(i - j) for j in seconds) <= 5)
    data = text.encode()
    upper, lower = sum(65 <= b <= 90 for b in data), sum(97 <= b <= 122 for b in data)
    marks = sum(b in b".,;:()[]{}<>*_~#%&$|+=/\\-\"'" for b in data)
    w, s = kinds.count("word"), kinds.count("stem")
    return [
        math.log1p(len(raw)), w, 100 * w / n, s, 100 * s / n, sum(weights), 100 * sum(weights) / n, max(weights, default=0),
        sum(1 for k, x in zip(kinds, weights, strict=True) if k and x >= 3), 100 * len(seconds) / n, near / max(1, len(hits)), upper / max(1, upper + lower), caps / n,
        100 * (data.count(b"!") + data.count(b"?")) / max(1, len(data)), 100 * marks / max(1, len(data)), 100 * (hidden + 4 * undone) / n,
    ]


def boosted_score(x: list[float], boosted, knots: tuple) -> float:
    """The trees one after the other, each from its root to a leaf; then linear interpolation between the knots."""
    margin = boosted.start
    for tree in boosted.grown:
        k = 0
        while tree[k][0] >= 0:
            f, cut, _ = tree[k]
            k = 2 * k + (2 if sum(c < x[f] for c in boosted.cuts[f]) > cut else 1)
        margin += boosted.rate * tree[k][2]
    at, p = (v.tolist() for v in knots)
    if margin <= at[0] or len(at) == 1:
        return p[0]
    for a, b, pa, pb in zip(at, at[1:], p, p[1:], strict=False):
        if margin <= b:
            return pa + (pb - pa) * (margin - a) / (b - a)
    return p[-1]


def isotonic(y: list[float]) -> list[float]:
    """The rising sequence nearest to y: at each place the largest, over beginnings, of the smallest mean over ends."""
    n = len(y)
    return [max(min(sum(y[a : b + 1]) / (b + 1 - a) for b in range(i, n)) for a in range(i + 1)) for i in range(n)]
