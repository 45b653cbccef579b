"""Plain versions of the operators' results, for small fixtures."""

import collections
import hashlib
import math
import re
import zlib

A_TO_Z = {i: i + 32 for i in range(65, 91)}
SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def crc(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode())


def discounts(counts, k=5):
    n = collections.Counter(counts)
    for top in range(k, 0, -1):
        if all(n[r] for r in range(1, top + 2)):
            tail = (top + 1) * n[top + 1] / n[1]
            if tail < 1:
                d = {r: ((r + 1) * n[r + 1] / (r * n[r]) - tail) / (1 - tail) for r in range(1, top + 1)}
                if all(0 < x < 1 for x in d.values()):
                    return d
    return {r: 1 - 0.5 / r for r in range(1, k + 1)}


class Katz:
    def __init__(self, texts, order):
        self.order, self.counts, self.d = order, [], []
        for n in range(1, order + 1):
            c = collections.Counter(g for t in texts for g in self.grams(t, n))
            self.counts.append(c)
            self.d.append(discounts(c.values()))
        self.by = [collections.defaultdict(list) for _ in range(order)]
        for n, c in enumerate(self.counts):
            for g, x in c.items():
                self.by[n][g[:-1]].append((g[-1], x))
        self.cache = {}

    @staticmethod
    def tokens(text):
        return SPACE_WORD.findall((text or "").translate(A_TO_Z)) + [0]

    def grams(self, tokens, n):
        full = [None] * (n - 1) + tokens
        return [tuple(full[i : i + n]) for i in range(len(tokens))]

    def p(self, gram):
        n = len(gram)
        if not n:
            raise ValueError
        history, d = gram[:-1], self.d[n - 1]

        def lower(w):
            return 1 / (len(self.counts[0]) + 1) if n == 1 else self.p(gram[1:-1] + (w,))

        if history not in self.cache:
            own = self.by[n - 1][history]
            total = sum(x for _, x in own)
            whole = total + (not any(d.get(x, 1) < 1 for _, x in own))
            left = 1 - sum(d.get(x, 1) * x for _, x in own) / whole if own else 1
            self.cache[history] = whole, left / (1 - sum(lower(w) for w, _ in own)) if own else 1
        whole, alpha = self.cache[history]
        x = self.counts[n - 1][gram]
        return d.get(x, 1) * x / whole if x else alpha * lower(gram[-1])

    def score(self, text):
        return sum(math.log10(self.p(g)) for g in self.grams(self.tokens(text), self.order))


def rules(text):
    text = text or ""
    words = SPACE_WORD.findall(text)
    windows = collections.defaultdict(list)
    for i in range(len(words) - 4):
        windows[tuple(words[i : i + 5])].append(i)
    again = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(5)}
    lines, seen = 0, set()
    for line in text.split("\n"):
        if SPACE_WORD.search(line):
            lines += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), lines, len(again), n < 10 or 100 * len(again) > 20 * n


def leaks(text, items, width=10):
    def words(t):
        return ALNUM_WORD.findall((t or "").translate(A_TO_Z))

    own, hit, found = words(text), set(), set()
    for item, t in items:
        w = words(t)
        size = min(width, len(w))
        for i in range(len(w) - size + 1 if size else 0):
            for j in range(len(own) - size + 1):
                if own[j : j + size] == w[i : i + size]:
                    hit.update(range(j, j + size))
                    if item is not None:
                        found.add(str(item))
    return len(own), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def shingles(text, width=5):
    w = SPACE_WORD.findall((text or "").translate(A_TO_Z))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} - {()}


def components(rows, percent=85):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[root(i)].append(d)
    return [(d, len(sets[i]), min(least[root(i)])) for i, (d, _) in enumerate(rows)]


def repeats(rows, length=400):
    raws, seen = [(d, (t or "").encode()) for d, t in rows], collections.Counter()
    for _, raw in raws:
        seen.update(raw[i : i + length] for i in range(len(raw) - length + 1))
    out = []
    for d, raw in raws:
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if seen[raw[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(raw, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def licences(text):
    w = ALNUM_WORD.findall((text or "").translate(A_TO_Z))
    places, labels = [], set()
    for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
        p = phrase.split()
        own = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        places += own
        labels |= {label} if own else set()
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def line_units(text, min_chars=40):
    """(start, end, normal form) of the lines with a word, and of the sentences that are long enough and no whole line."""
    out, at = [], 0
    for line in text.split("\n"):
        whole = " ".join(line.lower().split())
        if whole:
            out.append((at, at + len(line), whole))
        i = 0
        while i < len(line):
            if line[i].isspace() or line[i] in ".!?":
                i += 1
                continue
            j = i + 1
            while j < len(line):
                k = j
                while k < len(line) and line[k] in ".!?":
                    k += 1
                if k > j and (k == len(line) or line[k].isspace()):
                    j = k
                    break
                j = max(k, j + 1)
            normal = " ".join(line[i:j].lower().split())
            if j - i >= min_chars and normal != whole:
                out.append((at + i, at + j, normal))
            i = j
        at += len(line) + 1
    return out


def without_repeated_units(rows, key):
    """(id, length, removed, sha of the rest): a unit's first place by id (none last), then key, then place stays."""
    rank = {(d, t): (d is None, d or 0, key(d, t)) for d, t in rows}
    units = {x: line_units(x[1] or "") for x in rank}
    first = {}
    for x, own in units.items():
        for a, _, name in own:
            first[name] = min(first.get(name, (rank[x], a)), (rank[x], a))
    out = []
    for d, t in rows:
        gone, text = set(), t or ""
        for a, b, name in units[d, t]:
            if (rank[d, t], a) != first[name]:
                gone.update(range(a, b + (text[b : b + 1] == "\n" and (a == 0 or text[a - 1] == "\n"))))
        left = "".join(c for i, c in enumerate(text) if i not in gone)
        out.append((d, len(text), len(gone), hashlib.sha256(left.encode()).hexdigest()))
    return out


def band_verdict(text, bands):
    """(ratio, whether the text passes its bands) by the compressor alone."""
    import zstandard

    def ratio(raw):
        return len(raw) / len(zstandard.ZstdCompressor(level=bands.level).compress(raw)) if raw else 0.0

    raw = (text or "").encode()
    limits = [(lo, hi) for to, lo, hi in bands.whole if to is None or len(raw) < to][0]
    k = bands.chunk_bytes
    parts = [raw[i : i + k] for i in range(0, len(raw), k)]
    if len(raw) >= k:
        parts = [p for p in parts if len(p) == k] + ([raw[-k:]] if len(raw) % k else [])
    else:
        parts = []
    bad = [p for p in parts if not bands.chunk[0] <= ratio(p) <= bands.chunk[1]]
    whole = ratio(raw)
    return whole, limits[0] <= whole <= limits[1] and len(bad) <= bands.bad_chunks * len(parts)


def text_vector(text, n, vector):
    """The sum, over the n-grams of letters (runs of others are one space), of the products of the letters' vectors."""
    codes = []
    for ch in text or "":
        low = ch.lower()
        code = (ord(low) if len(low) == 1 else ord(ch)) if ch.isalpha() else 0
        if code or not codes or codes[-1]:
            codes.append(code)
    total = None
    for i in range(len(codes) - n + 1):
        bound = [1] * len(vector(codes[i], 0))
        for place in range(n):
            bound = [int(a) * int(b) for a, b in zip(bound, vector(codes[i + place], place))]
        total = bound if total is None else [a + b for a, b in zip(total, bound)]
    return total, any(ch.isalpha() for ch in text or "")


def languages(train, texts, n, vector):
    """(language, cosine) of each text by prototypes from (text, language) pairs."""
    prototypes = {}
    for text, lang in train:
        v, _ = text_vector(text, n, vector)
        if v is not None:
            prototypes[lang] = [a + b for a, b in zip(prototypes.get(lang, [0] * len(v)), v)]
    out = []
    for text in texts:
        v, lettered = text_vector(text, n, vector)
        if not lettered:
            out.append(("und", 0.0))
            continue
        size = lambda x: math.sqrt(sum(a * a for a in x))
        cosines = {lang: 0.0 if v is None else sum(a * b for a, b in zip(v, p)) / (size(v) * size(p)) for lang, p in sorted(prototypes.items())}
        best = max(cosines, key=cosines.get)
        out.append((best, min(max(cosines[best], 0.0), 1.0)))
    return out


def text_features(text):
    """The fifteen measures of a text."""
    text = text or ""
    raw, words, lines = text.encode(), SPACE_WORD.findall(text), text.split("\n")
    low = [w.translate(A_TO_Z) for w in words]
    n, size = max(len(words), 1), max(len(raw), 1)
    _, chars, symbols, dup, again, _ = rules(text)
    pairs = collections.Counter(zip(low, low[1:]))
    share = lambda chosen, of: sum(b in chosen for b in raw) / of
    return [
        math.log1p(len(raw)), math.log1p(len(words)), chars / n, share(range(65, 91), size), symbols / n, share(b"0123456789", size), share(b".,;:", n), share(b"!?", n),
        dup / len(lines), again / n, len(set(low)) / n, len(words) / len(lines), share(range(128, 256), size), math.log1p(max((len(w.encode()) for w in words), default=0)), max(pairs.values(), default=0) / n,
    ]


def additive_model(xs, ys, how):
    """A function that scores measures, boosted in plain loops: single features in turn, then the most promising pairs."""
    quantile = lambda v, q: v[int(q)] + (v[min(int(q) + 1, len(v) - 1)] - v[int(q)]) * (q - int(q))

    def edges(column, bins):
        v = sorted(column)
        return sorted({quantile(v, k / bins * (len(v) - 1)) for k in range(1, bins)})

    def place(x, cuts):
        return sum(c <= x for c in cuts)

    def tree(g, h, depth):
        total = sum(g) ** 2 / (sum(h) + how.smoothing)
        if depth and len(g) > 1:
            gains = [sum(g[:c]) ** 2 / (sum(h[:c]) + how.smoothing) + sum(g[c:]) ** 2 / (sum(h[c:]) + how.smoothing) for c in range(1, len(g))]
            cut = gains.index(max(gains)) + 1
            if gains[cut - 1] > total + 1e-9:
                return tree(g[:cut], h[:cut], depth - 1) + tree(g[cut:], h[cut:], depth - 1)
        return [sum(g) / (sum(h) + how.smoothing)] * len(g)

    def rows_first(g, h):
        r_g, r_h = [sum(r) for r in g], [sum(r) for r in h]
        gains = [sum(r_g[:c]) ** 2 / (sum(r_h[:c]) + how.smoothing) + sum(r_g[c:]) ** 2 / (sum(r_h[c:]) + how.smoothing) for c in range(1, len(g))]
        cut, out = gains.index(max(gains)) + 1, []
        for part in (slice(0, cut), slice(cut, None)):
            leaf = tree([sum(c) for c in zip(*g[part])], [sum(c) for c in zip(*h[part])], 1)
            out += [leaf] * len(g[part])
        return out

    def grid(g, h):
        if min(len(g), len(g[0])) < 2:
            return [[0.0] * len(g[0]) for _ in g]
        turned = rows_first([list(c) for c in zip(*g)], [list(c) for c in zip(*h)])
        both = rows_first(g, h), [list(c) for c in zip(*turned)]
        cells = len(g) * len(g[0])
        worth = [sum(x * a for x, a in zip(sum(m, []), sum(g, []))) - sum(x * x * (b + how.smoothing / cells) for x, b in zip(sum(m, []), sum(h, []))) / 2 for m in both]
        return both[worth.index(max(worth))]

    n = len(xs[0])
    rate = (sum(ys) + 1) / (len(ys) + 2)
    start = math.log(rate / (1 - rate))
    cuts, coarse = ([edges([x[f] for x in xs], b) for f in range(n)] for b in (how.bins, how.pair_bins))
    bins, cells = ([[place(x[f], c[f]) for f in range(n)] for x in xs] for c in (cuts, coarse))
    tables = [[0.0] * (len(c) + 1) for c in cuts]
    total = [start] * len(ys)

    def slopes():
        p = [1 / (1 + math.exp(-t)) for t in total]
        return [y - q for y, q in zip(ys, p)], [q * (1 - q) for q in p]

    for _ in range(how.rounds):
        for f in range(n):
            g, h, size = [0.0] * len(tables[f]), [0.0] * len(tables[f]), len(tables[f])
            for b, a, c in zip(bins, *slopes()):
                g[b[f]] += a
                h[b[f]] += c
            step = [how.rate * v for v in tree(g, h, 2)]
            tables[f] = [tables[f][k] + step[k] for k in range(size)]
            total = [t + step[b[f]] for t, b in zip(total, bins)]

    def sums(a, b):
        g, h = ([[0.0] * (len(coarse[b]) + 1) for _ in range(len(coarse[a]) + 1)] for _ in range(2))
        for c, x, y in zip(cells, *slopes()):
            g[c[a]][c[b]] += x
            h[c[a]][c[b]] += y
        return g, h

    def promise(pair):
        g, h = sums(*pair)
        return sum(x * y for x, y in zip(sum(g, []), sum(grid(g, h), [])))

    pairs = sorted(((a, b) for a in range(n) for b in range(a + 1, n)), key=promise, reverse=True)[: how.pairs]
    grids = {p: [[0.0] * (len(coarse[p[1]]) + 1) for _ in range(len(coarse[p[0]]) + 1)] for p in pairs}
    for _ in range(how.pair_rounds):
        for (a, b), own in grids.items():
            step = grid(*sums(a, b))
            grids[a, b] = [[v + how.rate * s for v, s in zip(r, t)] for r, t in zip(own, step)]
            total = [t + how.rate * step[c[a]][c[b]] for t, c in zip(total, cells)]
            own = grids[a, b]

    def score(x):
        own = [place(x[f], coarse[f]) for f in range(n)]
        out = start + sum(tables[f][place(x[f], cuts[f])] for f in range(n)) + sum(v[own[a]][own[b]] for (a, b), v in grids.items())
        return 1 / (1 + math.exp(-out))

    return score


def licence_labels(texts, templates, agree):
    """(labels, score) of each text: base phrases, and templates at every place where key phrases and enough weight agree."""
    files = [ALNUM_WORD.findall((t or "").translate(A_TO_Z)) for t in texts]
    df = collections.Counter(w for f in files for w in set(f))
    weight = lambda w: math.log((1 + len(files)) / (1 + df[w])) + 1e-3
    out = []
    for text, own in zip(texts, files):
        base = licences(text)[4]
        labels, best = set(filter(None, base.split(","))), 1.0 if base else 0.0
        for label, passage, needs in templates:
            words = passage.split()
            for start in range(1 - len(words), len(own)):
                there = [0 <= start + k < len(own) and own[start + k] == w for k, w in enumerate(words)]
                keys = [next(k for k in range(len(words)) if words[k : k + len(p.split())] == p.split()) for p in needs]
                if not all(all(there[k : k + len(p.split())]) for k, p in zip(keys, needs)):
                    continue
                share = sum(weight(w) for w, t in zip(words, there) if t) / sum(map(weight, words))
                if share >= agree - 1e-9:
                    labels.add(label)
                    best = max(best, min(share, 1.0))
        out.append((",".join(sorted(labels)), best))
    return out
