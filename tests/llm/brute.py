"""Plain Python versions of the operators' contracts, over lists of (id, text)."""

import base64
import collections
import hashlib
import re
import zlib

import numpy as np

BLANK = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def order(docs):
    return sorted(docs, key=lambda d: (d[0] is None, d[0] or 0, d[1] or ""))


def bpe(docs):
    import public_tokenizers as p
    import tiktoken
    with open(p.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    e = tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = []
    for i, t in docs:
        ids = e.encode_ordinary(t or "")
        out.append((i, len(ids), sha(" ".join(map(str, ids))), sha((t or "").encode())))
    return out


def shingles(t):
    w = BLANK.findall((t or "").translate(LOWER))
    if 0 < len(w) < 5:
        return {tuple(w)}
    return {tuple(w[k:k + 5]) for k in range(len(w) - 4)}


def near(docs):
    sets = {i: shingles(t) for i, t in docs}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    common = collections.Counter((a, b) for h in holders.values() for a in h for b in h if a < b)
    for (a, b), n in common.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    return [(i, len(s), root(i), root(i) == i) for i, s in sets.items()]


def token_files(docs):
    import public_tokenizers as p
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(p.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    start, out = 0, []
    for i, x in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, d[1] or "")):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def substrings(docs, width=20):
    seen, out = set(), []
    for i, t in order(docs):
        w = BLANK.findall(t or "")
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            x = tuple(w[k:k + width])
            if x in seen:
                gone[k:k + width] = [True] * width
            seen.add(x)
        out.append((i, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g))))
    return out


def urls(pages, rules):
    out = []
    for i, u in pages:
        host = path = ""
        if u and "://" in u:
            m = re.match(r"([^/?#]*)([^?#]*)", u.split("://", 1)[1], re.S)
            host, path = m[1].translate(LOWER), m[2]
        fit = [(r, v) for r, v in rules for h, p in [(r.split("/", 1)[0], "/" + r.split("/", 1)[1])]
               if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fit, key=lambda x: len(x[0])) if fit else (None, "allow")
        out.append((i, host, path, rule, verdict))
    return out


def decontaminate(docs, items):
    windows = collections.defaultdict(set)
    for i, t in items:
        w = ALNUM.findall((t or "").translate(LOWER))
        for k in range(max(1, len(w) - 9)) if w else []:
            windows[tuple(w[k:k + 10])].add(i)
    out = []
    for i, t in docs:
        w = ALNUM.findall((t or "").translate(LOWER))
        hit, found = [False] * len(w), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                x = windows.get(tuple(w[k:k + n]))
                if x is not None:
                    found |= x
                    hit[k:k + n] = [True] * n
        names = sorted(str(x) for x in found if x is not None)
        out.append((i, len(w), sum(hit), len(names), sha(",".join(names)), any(hit)))
    return out


def lm(docs):
    """(id, held out, tokens, known, training tokens), and the base score."""
    held = {i: zlib.crc32((b"" if i is None else str(i).encode())) % 10 == 0 for i, _ in docs}
    tokens = [(i, [*BLANK.findall((t or "").translate(LOWER)), " "]) for i, t in docs]
    count = collections.Counter(x for i, w in tokens if not held[i] for x in w)
    n, v = sum(count.values()), len(count)
    return [(i, held[i], len(w), sum(count[x] > 0 for x in w), n,
             sum(np.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)) for i, w in tokens]


def quality(docs):
    out = []
    for i, t in docs:
        w = BLANK.findall(t or "")
        count = collections.Counter(tuple(w[k:k + 8]) for k in range(len(w) - 7))
        covered = {j for k in range(len(w) - 7) if count[tuple(w[k:k + 8])] > 1 for j in range(k, k + 8)}
        seen, again = set(), 0
        for line in (t or "").split("\n"):
            if BLANK.search(line):
                again += line in seen
                seen.add(line)
        out.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), again, len(covered),
                    len(w) < 20 or 100 * len(covered) > 30 * len(w)))
    return out
