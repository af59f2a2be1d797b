"""Plain versions of the operators, for small inputs."""

import re
from collections import Counter, defaultdict
from hashlib import sha256

WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def raw(text):
    return (text or "").encode()


def lower(data):
    return data.lower()  # bytes.lower() changes A-Z only


def sha(data):
    return sha256(data).hexdigest()


def substring(docs, window=13):
    """docs: list of (doc_id, text)."""
    words = [WORD.findall(raw(t)) for _, t in docs]
    first = {}
    for (d, _), w in zip(docs, words):
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, d), d)
    out = []
    for (d, _), w in zip(docs, words):
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                gone.update(range(i, i + window))
        out.append((d, len(w), len(gone), sha(b" ".join(x for i, x in enumerate(w) if i not in gone))))
    return sorted(out)


def suffix(docs, length=400):
    count = Counter()
    for _, t in docs:
        b = raw(t)
        count.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = []
    for d, t in docs:
        b = raw(t)
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g))))
    return sorted(out)


def lines(docs, least=10):
    key = lambda x: lower(x.strip(b" \t\n\v\f\r"))
    first, holders = {}, defaultdict(set)
    for d, t in docs:
        for x in raw(t).split(b"\n"):
            first[key(x)] = min(first.get(key(x), d), d)
            holders[key(x)].add(d)
    out = []
    for d, t in docs:
        rows = raw(t).split(b"\n")
        kept = [x for x in rows if len(key(x).decode()) < least or len(holders[key(x)]) < 2 or first[key(x)] == d]
        out.append((d, len(rows), len(rows) - len(kept), sha(b"\n".join(kept))))
    return sorted(out)


TEST_WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def benchmark(docs, items, window=10):
    patterns = []
    for name, t in items:
        w = TEST_WORD.findall(lower(raw(t)))
        patterns += [(w[i : i + window], str(name)) for i in range(max(1, len(w) - window + 1) if w else 0)]
    by_first = defaultdict(list)
    for p, name in patterns:
        by_first[p[0]].append((p, name))
    out = []
    for d, t in docs:
        w = TEST_WORD.findall(lower(raw(t)))
        hit, found = set(), set()
        for i, x in enumerate(w):
            for p, name in by_first.get(x, ()):
                if w[i : i + len(p)] == p:
                    hit.update(range(i, i + len(p)))
                    found.add(name)
        out.append((d, len(w), len(hit), len(found), sha(",".join(sorted(found)).encode()), bool(hit)))
    return sorted(out)


def base_rules(docs):
    out = []
    for d, t in docs:
        b = raw(t)
        w = WORD.findall(b)
        full = [x for x in b.split(b"\n") if WORD.search(x)]
        grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        again = set()
        for i in range(len(w) - 4):
            if grams[tuple(w[i : i + 5])] > 1:
                again.update(range(i, i + 5))
        chars = sum(len(x.decode()) for x in w)
        out.append((d, len(w), chars, sum(c in "#*$%&|<>" for c in t or ""), len(full) - len(set(full)), len(again), len(w) < 10 or 100 * len(again) > 20 * len(w)))
    return sorted(out)


def features(text):
    """The statistics of one text, one by one, in the order of rulefit.FEATURES."""
    b = raw(text)
    w = WORD.findall(b)
    n = len(w)
    if not n:
        return [0.0] * 19
    full = [x for x in b.split(b"\n") if WORD.search(x)]
    low = [lower(x) for x in w]
    upper = sum(65 <= x <= 90 for x in b) + sum(b[i] == 0xC3 and 0x80 <= b[i + 1] <= 0x9E for i in range(len(b) - 1))
    letters = sum(65 <= x <= 90 or 97 <= x <= 122 or x >= 0xC0 for x in b)
    grams = Counter(tuple(w[i : i + 5]) for i in range(n - 4))
    again = {j for i in range(n - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    dup = len(full) - len(set(full))
    by = lambda x, y: x / max(y, 1)
    own = [
        sum(len(x.decode()) for x in w), sum(x in b"#*$%&|<>" for x in b), len(again), len(b.decode()), max(Counter(low).values()), sum(x == y for x, y in zip(low, low[1:])),
        sum(48 <= x <= 57 for x in b), b.count(b"!"), b.count(b"|"), sum(x in b".?!" for x in b), b.count(b","), sum(len(x) <= 3 for x in w), sum(len(x) > 20 for x in w),
    ]
    return [float(n), by(len(full), n), by(dup, len(full)), by(upper, letters), by(letters, len(b.decode())), by(len(set(low)), n**0.8), *(by(x, n) for x in own)]


def score(x, base, rules, weights):
    """The chance of label 1: every rule of the model read word by word."""
    z = base
    for conditions, weight in zip(rules, weights):
        if all((x[k] > t) == above for k, above, t in conditions):
            z += weight
    return 1 / (1 + 2.718281828459045**-z)
