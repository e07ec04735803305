"""Plain Python versions of the operators' contracts, over (doc_id, text) rows."""

import bisect
import hashlib
import math
import re
import zlib
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
SPANS = (("assign", ASSIGN, 0), ("access", re.compile("AKIA[A-Z0-9]+"), 16), ("hex", re.compile("[0-9a-f]+"), 32))


def words(text):
    return WORD.findall(text or "")


def op1(text):
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    n = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))
    return (*n, n[0] < 20 or 100 * n[4] > 30 * n[0])


def op4(text):
    found = []
    for order, (kind, pattern, least) in enumerate(SPANS):
        for m in pattern.finditer(text or ""):
            if len(m.group(1)) >= 8 if kind == "assign" else len(m.group()) >= least:
                found.append((m.start(), order, kind, m.end()))
    found.sort()
    line = ",".join(f"{k}:{s}:{e}" for s, _, k, e in found)
    return (*(sum(x[2] == k for x in found) for k, *_ in SPANS), hashlib.sha256(line.encode()).hexdigest())


def random_parts(run, ratios, alphabet, evidence, threshold):
    """Parts of a run of identifier characters that the models call random."""
    if len(run) < 12:
        return []
    total = lambda x: sum(ratios[alphabet.index(a) * len(alphabet) + alphabet.index(b)] for a, b in zip(x, x[1:]))
    ordinary = any(len(x) >= 4 and total(x) < 0 for x in re.split("[/_=-]", run))
    if total(run) >= evidence and total(run) >= threshold * (len(run) - 1) and not ordinary:
        return [(0, len(run))]
    out, held, at = [], [], 0
    for piece in [*re.split("[/_=-]", run), None]:
        if piece is None or len(piece) > 1 and total(piece) < threshold * (len(piece) - 1):
            if held and sum(x[2] for x in held) >= evidence:
                out.append((held[0][0], held[-1][1]))
            held = []
        elif len(piece) > 1:
            held.append((at, at + len(piece), total(piece)))
        at += len(piece or "") + 1
    return out


def op9(rows, k=13):
    first = {}
    for doc, text in rows:
        w = words(text)
        for i in range(len(w) - k + 1):
            if doc is not None:
                key = tuple(w[i : i + k])
                first[key] = min(first.get(key, doc), doc)
    out = []
    for doc, text in rows:
        w = words(text)
        gone = {j for i in range(len(w) - k + 1) if doc is not None and first[tuple(w[i : i + k])] < doc for j in range(i, i + k)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def fold(doc):
    return zlib.crc32(("" if doc is None else str(doc)).encode()) % 7 == 2


def lower(text):
    return (text or "").translate({i: i + 32 for i in range(65, 91)})


def op10_base(rows):
    count = Counter()
    for doc, text in rows:
        if not fold(doc):
            count.update([*words(lower(text)), None])
    n, v = sum(count.values()), len(count)
    out = []
    for doc, text in rows:
        tokens = [*words(lower(text)), None]
        out.append((doc, fold(doc), len(tokens), sum(count[t] > 0 for t in tokens), n, sum(math.log10((count[t] + 1) / (n + v + 1)) for t in tokens)))
    return out


class Ctw:
    """Context-tree weighting with explicit nodes, learned one byte of one text at a time."""

    def __init__(self, depth):
        self.depth, self.n = depth, {}

    def learn(self, text):
        for ctx, node, one in self._bits(text):
            for d in range(len(ctx) + 1):
                self.n.setdefault((ctx[len(ctx) - d :], node), [0, 0])[one] += 1

    def _bits(self, text):
        data = b"\n" * self.depth + b"".join(w.encode() + b" " for w in words(lower(text))) + b"\n"
        for i in range(self.depth, len(data)):
            for k in range(8):
                yield data[i - self.depth : i], (data[i] + 256) >> (8 - k), data[i] >> (7 - k) & 1

    def finish(self):
        def kt(a, b):
            return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)

        kids = {}
        self.w = {}
        for ctx, node in sorted(self.n, key=lambda x: -len(x[0])):
            own = kt(*self.n[ctx, node])
            below = kids.get((ctx, node))
            w = own if below is None else max(own, below) + math.log1p(math.exp(-abs(own - below))) - math.log(2)
            self.w[ctx, node] = (1.0 if below is None else math.exp(own - math.log(2) - w))
            if ctx:
                kids[ctx[1:], node] = kids.get((ctx[1:], node), 0.0) + w

    def log10(self, text):
        total = 0.0
        for ctx, node, one in self._bits(text):
            p, left = 0.0, 1.0
            for d in range(len(ctx) + 1):
                at = (ctx[len(ctx) - d :], node)
                a, b = self.n.get(at, (0, 0))
                gamma = 1.0 if d == len(ctx) else self.w.get(at, 0.5)
                p, left = p + left * gamma * (b + 0.5) / (a + b + 1), left * (1 - gamma)
            total += math.log10(p if one else 1 - p)
        return total


def alignment(a, b, k=5):
    """Similarity of two texts by their longest common subsequence of occurrence-labelled shingles."""

    def labelled(text):
        w = words(text)
        seen = Counter()
        out = {}
        for s in [tuple(w[i : i + k]) for i in range(len(w) - k + 1)] or ([tuple(w)] if w else []):
            out[s, seen[s]] = len(out)
            seen[s] += 1
        return out

    x, y = labelled(a), labelled(b)
    tails = []
    for p in (y[s] for s in x if s in y):
        i = bisect.bisect_left(tails, p)
        tails[i : i + 1] = [p]
    return len(tails) / (len(x) + len(y) - len(tails)) if x or y else float(a == b)
