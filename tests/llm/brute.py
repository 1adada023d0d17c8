"""Plain versions of the contracts, over small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
KINDS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"), "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def substrings(docs, k=20):
    """docs: (doc_id, text); rows with both equal are one."""
    seen, out = set(), {}
    for key, text in sorted(set(docs), key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")):
        words = WORD.findall(text or "")
        gone = [False] * len(words)
        for i in range(len(words) - k + 1):
            window = tuple(words[i : i + k])
            if window in seen:
                gone[i : i + k] = [True] * k
            seen.add(window)
        out[key, text] = (len(words), sum(gone), " ".join(w for w, g in zip(words, gone, strict=True) if not g))
    return out


def shingles(text, n=5):
    words = WORD.findall((text or "").translate(LOW))
    if len(words) >= n:
        return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    return frozenset([tuple(words)]) if words else frozenset()


def components(docs, share=75):
    sets = [(k, shingles(t)) for k, t in docs]
    root = {k: k for k, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, p) in enumerate(sets):
        for b, q in sets[:i]:
            both = len(p & q)
            if both and 100 * both >= share * len(p | q):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {(k, t): (len(s), find(k)) for (k, t), (_, s) in zip(docs, sets, strict=True)}


def luhn(digits):
    total = 0
    for i, c in enumerate(digits[::-1]):
        x = int(c) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def pii(text):
    out = []
    for kind, pattern in KINDS.items():
        for m in pattern.finditer(text or ""):
            d = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}
            if good[kind]:
                out.append((kind, m.start(), m.end()))
    return out


def lines(docs, least=8):
    seen, out = set(), {}
    for key, text in sorted(set(docs), key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")):
        rows = (text or "").split("\n")
        solid = [i for i, x in enumerate(rows) if WORD.findall(x)]
        gone = set()
        for p in range(len(solid)):
            q, n = p, 0
            while q < len(solid) and n < least:
                n += len(WORD.findall(rows[solid[q]]))
                q += 1
            if n < least:
                break
            window = tuple(rows[i] for i in solid[p:q])
            if window in seen:
                gone |= set(range(solid[p], solid[q - 1] + 1))
            seen.add(window)
        out[key, text] = (len(rows), len(gone), "\n".join(x for i, x in enumerate(rows) if i not in gone))
    return out


BETWEEN = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contamination(docs, items, window=13):
    split = lambda t: [x for x in BETWEEN.split((t or "").translate(LOW)) if x]
    windows = {}
    for item, text in items:
        w = split(text)
        for i in range(max(1, len(w) - window + 1)) if w else ():
            windows.setdefault(tuple(w[i : i + window]), set()).add(item)
    out = {}
    for key, text in docs:
        w, hit, found = split(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if (ids := windows.get(tuple(w[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    found |= ids
        out[key, text] = (len(w), len(hit), sorted(x for x in found if x is not None), bool(hit) and 20 * len(hit) >= len(w))
    return out


def rules(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    words, seen = WORD.findall(text), {}
    for i in range(len(words) - 4):
        seen.setdefault(tuple(words[i : i + 5]), []).append(i)
    hit = {i + j for at in seen.values() if len(at) > 1 for i in at for j in range(5)}
    lines = text.split("\n")
    dup = sum(bool(WORD.search(x)) and x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), len(words) < 10 or 100 * len(hit) > 20 * len(words)


def runs(text):
    words = [x for x in BETWEEN.split((text or "").translate(LOW)) if x]
    return len(words), [" ".join(words[i : i + k]).encode() for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def resampled(docs, target, percent=5):
    """docs: (doc_id, text); a row (doc_id, n_features, weight, score, rank) for each."""
    buckets = 10000
    count = lambda texts: Counter(zlib.crc32(x) % buckets for t in texts for x in runs(t)[1])
    raw, aim = count(t for _, t in docs), count(target)
    s, t = sum(raw.values()), sum(aim.values())
    gain = {b: math.floor(1000 * math.log((aim[b] + 1) * (s + buckets) / ((n + 1) * (t + buckets)))) for b, n in raw.items()}
    out = []
    for key, text in docs:
        n, found = runs(text)
        h = int(digest(f"42:{'' if key is None else key}")[:8], 16)
        weight = sum(gain[zlib.crc32(x) % buckets] for x in found)
        out.append([key, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    fit = sorted((x for x in out if x[4] >= 20), key=lambda x: (-x[3], x[0] is not None, x[0] or 0))
    rank = {id(x): i + 1 for i, x in enumerate(fit[: len(fit) * percent // 100])}
    return [(*x[:4], rank.get(id(x))) for x in out]


def merkle(docs, fanout=2):
    """docs: rows (doc_id, text, lang, source, n_chars); (doc_id, leaf, subroot, root, proof, folded) of each."""
    name = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    hashed = lambda k, t, g, s, n: digest("".join(map(name, (k, s, g, n, t))))

    def tree(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([digest("".join(out[-1][i : i + fanout])) for i in range(0, len(out[-1]), fanout)])
        return out

    def path(levels, at):
        out = []
        for level in levels[:-1]:
            first = at - at % fanout
            out.append((level[first:at], level[at + 1 : first + fanout]))
            at //= fanout
        return out

    groups = {}
    for r in docs:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        rows = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, hashed(*r)))
        trees[g] = rows, tree([hashed(*r) for r in rows])
    top = tree([trees[g][1][-1][0] for g in order])
    out = []
    for j, g in enumerate(order):
        rows, levels = trees[g]
        for i, r in enumerate(rows):
            steps = path(levels, i) + path(top, j)
            bad = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            end = hashed(*r[:4], r[4] + 1) if bad else levels[0][i]
            for a, b in steps:
                end = digest("".join(a) + end + "".join(b))
            out.append((r[0], levels[0][i], levels[-1][0], top[-1][0], digest("".join("".join(a + b) for a, b in steps)), end))
    return out
