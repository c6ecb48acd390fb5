"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from fractions import Fraction

WORD = re.compile(r"[^\x20\x09-\x0D]+")


class Union:
    def __init__(self):
        self.up = {}

    def root(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.root(a), self.root(b)))
        self.up[b] = a


def similar_pairs(sets: dict, least: float):
    """Pairs of keys whose sets have Jaccard similarity of ``least`` or
    more: exact, by the rarest elements of each set."""
    count = Counter(x for s in sets.values() for x in s)
    seen = defaultdict(list)
    for key in sorted(sets, key=lambda k: len(sets[k])):
        s = sorted(sets[key], key=lambda x: (count[x], x))
        prefix = s[:len(s) - int(len(s) * least * 0.999) + 1]
        for other in {o for x in prefix for o in seen[x]}:
            both = len(sets[key] & sets[other])
            if Fraction(both, len(sets[key]) + len(sets[other]) - both) >= Fraction(str(least)):
                yield other, key
        for x in prefix:
            seen[x].append(key)


def line_dedup(rows, shingle=8, least=0.8):
    """rows: (id, text); text of each after dropping all but the first of
    similar lines."""
    places = defaultdict(list)
    for i, t in sorted({r for r in rows if r[1] is not None}, key=lambda r: (r[0] is None, r[0])):
        for n, line in enumerate(t.split("\n")):
            if WORD.search(line):
                places[line].append((i is None, i, n))
    sets = {x: {x[j:j + shingle] for j in range(max(1, len(x) - shingle + 1))} for x in places}
    u = Union()
    for a, b in similar_pairs(sets, least):
        u.join(a, b)
    first = {}
    for line, ps in places.items():
        r = u.root(line)
        first[r] = min([first[r], *ps] if r in first else ps)
    out = []
    for i, t in rows:
        if t is None:
            out.append((i, None))
            continue
        kept = [x for n, x in enumerate(t.split("\n")) if not WORD.search(x) or first[u.root(x)] == (i is None, i, n)]
        out.append((i, "\n".join(kept)))
    return out


def suffix_dedup(texts, length=400):
    """(bytes, removed, spans, kept bytes) of each text."""
    raws = [(t or "").encode() for t in texts]
    count = Counter(hash(r[i:i + length]) for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        end = 0
        for i in range(len(r) - length + 1):
            if count[hash(r[i:i + length])] > 1:
                for j in range(max(i, end), i + length):
                    gone[j] = 1
                end = i + length
        spans = sum(1 for i in range(len(r)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(r), sum(gone), spans, bytes(b for b, g in zip(r, gone) if not g)))
    return out


def fingerprint(text, width=3):
    import xxhash
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())) if w]
    grams = [b" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def simhash_groups(rows, distance=2):
    """(fingerprint, smallest id reachable, group) of rows (id, text)."""
    fps = [fingerprint(t) for _, t in rows]
    u = Union()
    distinct = sorted(set(fps))
    for i, a in enumerate(distinct):
        u.root(a)
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= distance:
                u.join(a, b)
    first = {}
    for (i, _), f in zip(rows, fps):
        r = u.root(f)
        if i is not None:
            first[r] = min(first.get(r, i), i)
    return [(f, first.get(u.root(f)), u.root(f)) for f in fps]


def base_features(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    inside = {i + k for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1 for k in range(8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)),
            len(inside), len(words) < 20 or 100 * len(inside) > 30 * len(words))


def quality_rules(rows):
    """kept of each (id, text), by the rules' own conditions and plain EM."""
    import math
    from tallyframe.llm import quality_rules as Q
    sql = lambda c: c.replace(" = ", " == ")
    votes, failed = [], []
    for _, t in rows:
        n, chars, symbols, dup, rep, base = base_features(t)
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        env = {"n_words": n, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": rep,
               "n_lines": len(lines), "n_ended_lines": sum(1 for x in lines if re.search(Q.LINE_END, x)),
               "n_capitals": len(re.findall("[A-Z]", t or "")), "n_exclaims": (t or "").count("!"),
               "n_marks": len(re.findall(Q.MARKS, t or ""))}
        votes.append([-1 if eval(sql(bad), {}, env) else 1 if eval(sql(good), {}, env) else 0 for _, good, bad in Q.RULES])
        failed.append(base)
    k = len(Q.RULES)
    prior, g, b = Q.PRIOR, [Q.RIGHT_ON_GOOD] * k, [Q.RIGHT_ON_BAD] * k
    bound = lambda x, r: max(r[0], min(r[1], x))

    def post():
        out = []
        for v in votes:
            s = math.log(prior / (1 - prior))
            for j, x in enumerate(v):
                s += math.log(g[j] / (1 - b[j])) if x == 1 else math.log((1 - g[j]) / b[j]) if x == -1 else 0
            out.append(1 / (1 + math.exp(-s)))
        return out
    for _ in range(Q.ROUNDS):
        p = post()
        prior = bound((sum(p) + Q.PSEUDO * Q.PRIOR) / (len(p) + Q.PSEUDO), Q.PRIOR_RANGE)
        g = [bound((sum(x for x, v in zip(p, votes) if v[j] == 1) + Q.PSEUDO * Q.RIGHT_ON_GOOD)
                   / (sum(x for x, v in zip(p, votes) if v[j]) + Q.PSEUDO), Q.GOOD_RANGE) for j in range(k)]
        b = [bound((sum(1 - x for x, v in zip(p, votes) if v[j] == -1) + Q.PSEUDO * Q.RIGHT_ON_BAD)
                   / (sum(1 - x for x, v in zip(p, votes) if v[j]) + Q.PSEUDO), Q.BAD_RANGE) for j in range(k)]
    return [not f and p >= Q.KEEP_AT for f, p in zip(failed, post())]


def mix(rows, weights=(1, 2, 3), most=3, seed="mix-1"):
    """(size, source size, target, copies) of rows (id, text, source)."""
    import hashlib
    sizes = [len(WORD.findall(t or "")) for _, t, _ in rows]
    names = sorted({s for *_, s in rows}, key=lambda s: (s is None, (s or "").encode()))
    total = {s: sum(n for n, r in zip(sizes, rows) if r[2] == s) for s in names}
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(sizes))
    while open_:
        unit = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if unit * weight[s] > most * total[s]}
        for s in over or open_:
            target[s] = float(most * total[s]) if over else unit * weight[s]
        left -= sum(target[s] for s in over)
        open_ -= over or open_
    copies = [0] * len(rows)
    for s in names:
        mine = [i for i, r in enumerate(rows) if r[2] == s]
        ask = round(target[s])
        full, part = divmod(ask, total[s]) if total[s] else (0, 0)
        draw = lambda i: (hashlib.md5(f"{seed}:{rows[i][0]}".encode()).hexdigest(), rows[i][0], sizes[i])
        run = 0
        out = []
        for i in sorted(mine, key=draw):
            copies[i] = full if sizes[i] else 0
            run += sizes[i]
            if run <= part:
                copies[i] += 1 if sizes[i] else 0
                done = run
            else:
                out.append(i)
        done = sum(sizes[i] for i in mine if i not in out)
        more = [i for i in out if 0 < sizes[i] <= part - done]
        if more:
            copies[max(more, key=lambda i: (sizes[i], draw(i)))] += 1
    return [(n, total[r[2]], target[r[2]], c) for n, r, c in zip(sizes, rows, copies)]


def terms(text, digits=True):
    import re
    keep = "0-9A-Za-z" if digits else "A-Za-z"
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(rf"[{keep}\x80-\U0010ffff]+", low)


def lexical_search(docs, items, k=10):
    """[(item, rank, id, score)] of all items."""
    import math
    from collections import Counter
    each = [Counter(terms(t)) for _, t in docs]
    n_docs, length = sum(1 for c in each if c), sum(c.total() for c in each)
    df = Counter(t for c in each for t in c)
    out = []
    for item, text in set(items):
        found = []
        for (i, _), c in zip(docs, each):
            n = c.total()
            score = 0
            for t in terms(text):
                if c[t]:
                    m = 25 + 75 * n * n_docs // length
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * (10**9 * c[t] // (1000 * c[t] + 8 * m))
            if score > 0:
                found.append((-score, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(found)[:k], 1)]
    return out


def vector_topk(rows, is_query, k=5):
    """[(query id, rank, id, score)] over rows (id, vector or None)."""
    import math
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
            if v is not None and all(x is not None and math.isfinite(256 * x) for x in v)]
    out = []
    for a, (i, q) in enumerate(good):
        if is_query(i):
            clip = lambda s: max(-(2**63 - 1), min(2**63 - 1, s))
            found = sorted((-clip(sum(x * y for x, y in zip(q, v))), j is None, j)
                           for b, (j, v) in enumerate(good) if a != b and len(v) == len(q))
            out += [(i, r, j, -s) for r, (s, _, j) in enumerate(found[:k], 1)]
    return out


def source_audit(docs, least=3, ranks=200):
    """[(lang, source, part, item, value, rank)] over (text, lang, source)."""
    from collections import Counter
    docs = [(t or "", a or "", s or "") for t, a, s in docs]
    df, lc, gc = Counter(), Counter(), Counter()
    for t, a, s in docs:
        here = Counter(terms(t, digits=False))
        for x, n in here.items():
            df[a, x] += 1
            lc[a, x] += n
            gc[a, s, x] += n
    groups = {(a, s) for _, a, s in docs}
    out = []
    for lang in {a for a, _ in groups}:
        kept = [x for a, x in df if a == lang and df[a, x] >= least]
        v = len(kept)

        def shares(count):
            n = sum(map(count, kept))
            return {x: 1 + 10**9 * (count(x) + 1) // (n + v) for x in kept}
        own = {s: shares(lambda x, s=s: gc[lang, s, x]) for a, s in groups if a == lang}
        q = shares(lambda x: lc[lang, x])
        f = lambda p, q: (p - q) * (p - q) // q
        for s, p in own.items():
            pair = [(h, sum(f(p[x], r[x]) for x in kept)) for h, r in own.items() if h != s]
            term = [(x, f(p[x], q[x])) for x in kept if gc[lang, s, x] and p[x] > q[x]]
            order = lambda r: (-r[1], r[0].encode())
            out += [(lang, s, "pair", i, x, n) for n, (i, x) in enumerate(sorted(pair, key=order), 1)]
            out += [(lang, s, "term", i, x, n) for n, (i, x) in enumerate(sorted(term, key=order)[:ranks], 1)]
    return out
