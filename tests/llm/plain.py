"""Plain versions of what the operators compute, for small inputs."""

import re
import zlib
from collections import Counter

LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def words(text, lower=False):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW) if lower else text or "")


def shingles(text, k):
    w = words(text, lower=True)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def components(docs, k, num, den=100):
    """doc_id -> smallest doc_id reachable over similar sets."""
    sets = {d: shingles(t, k) for d, t in docs}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and den * both >= num * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def without_repeats(docs, window):
    """doc_id -> words that stay."""
    seen, out = set(), {}
    for d, text in sorted(docs):
        w, gone = words(text), set()
        for i in range(len(w) - window + 1):
            g = tuple(w[i : i + window])
            if g in seen:
                gone.update(range(i, i + window))
            seen.add(g)
        out[d] = (len(w), [x for i, x in enumerate(w) if i not in gone])
    return out


def edits(item, text):
    """Fewest word edits between the item and any window of the text."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        new = [i] + [0] * len(text)
        for j, y in enumerate(text, 1):
            new[j] = min(row[j - 1] + (x != y), row[j] + 1, new[j - 1] + 1)
        row = new
    return min(row)


def discounts(counts):
    n = Counter(counts.values())
    if not all(n[i] for i in (1, 2, 3, 4)):
        return [0, 0.5, 0.5, 0.5]
    y = n[1] / (n[1] + 2 * n[2])
    return [0] + [min(max(i - (i + 1) * y * n[i + 1] / n[i], 0.05), i - 0.05) for i in (1, 2, 3)]


def collocations(docs, least, longest, top):
    """(lang, rank, phrase, a, l, r, n, score) of the best phrases of each language."""
    f, n = {}, Counter()
    for text, lang in docs:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.setdefault(lang, Counter()).update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        big = {g: a for g, a in c.items() if len(g) > 1 and a >= least}
        rows = []
        for g, a in big.items():
            cuts = [(2000000 * a // (c[g[:k]] + c[g[k:]]), k) for k in range(1, len(g))]
            score, k = min(cuts)
            inside = (x for x in big if len(x) > len(g) and any(x[i : i + len(g)] == g for i in range(len(x))))
            if not any(100 * big[x] >= 80 * a for x in inside):
                rows.append((-score, -a, " ".join(g).encode(), c[g[:k]], c[g[k:]]))
        out += [(lang, i, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(rows)[:top], 1)]
    return out


def without_repeated_bytes(docs, length):
    """doc_id -> bytes, bytes gone, runs gone, what stays."""
    seen, out = set(), {}
    for d, text in sorted(docs):
        raw = (text or "").encode()
        gone = [False] * (len(raw) + 1)
        for i in range(len(raw) - length + 1):
            g = raw[i : i + length]
            if g in seen:
                gone[i : i + length] = [True] * length
            seen.add(g)
        runs = sum(x and not y for x, y in zip(gone, [False, *gone]))
        out[d] = (len(raw), sum(gone), runs, bytes(b for b, x in zip(raw, gone) if not x))
    return out


def near(x, y):
    """Whether two different words are one edit apart."""
    if len(x) < len(y):
        x, y = y, x
    if len(x) - len(y) > 1 or x == y:
        return False
    i = next((i for i in range(len(y)) if x[i] != y[i]), len(y))
    return x[i + 1 :] == (y[i + 1 :] if len(x) == len(y) else y[i:])


def spellings(docs, least, times, ratio, drop):
    """word -> form, root, n, near words, n of the form."""
    n = Counter()
    for d, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", (text or "").translate(LOW)):
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if drop and h % drop == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= least and k >= times}
    out = {}
    for w, k in n.items():
        around = sorted((-n[x], x) for x in n if near(w, x))
        fits = bool(around) and -around[0][0] >= ratio * k
        out[w] = (around[0][1] if fits else None, k, len(around), -around[0][0] if fits else None)

    def root(w):
        return root(out[w][0]) if out[w][0] else w

    return {w: (x[0], root(w), *x[1:]) for w, x in out.items()}
