"""Plain versions of what the operators compute, over lists of (doc_id, text)."""

import hashlib
import re
import string
import zlib
from collections import defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
AZ = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


class Sets:
    def __init__(self):
        self.up = {}

    def find(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a


def simhash(docs):
    prints = {}
    for i, t in docs:
        w = WORD.findall((t or "").translate(AZ))
        shingles = [" ".join(w[k : k + 4]) for k in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    sets, ids = Sets(), sorted(prints)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                sets.join(i, j)
    return {i: (f"{prints[i]:016x}", sets.find(i)) for i in ids}


def mixing_targets(sizes):
    """{source: size} -> {source: target}: share, cap, share the excess again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, free, left = {}, list(order), float(sum(sizes.values()))
    while free:
        whole = sum(weight[s] for s in free)
        full = [s for s in free if left * weight[s] / whole > 3 * sizes[s]]
        if not full:
            target |= {s: left * weight[s] / whole for s in free}
            break
        for s in full:
            target[s] = 3.0 * sizes[s]
        left -= sum(3 * sizes[s] for s in full)
        free = [s for s in free if s not in full]
    return target


def substrings(docs, size=13):
    first = {}
    words = {i: WORD.findall(t or "") for i, t in docs}
    for i in sorted(words):
        for k in range(len(words[i]) - size + 1):
            first.setdefault(tuple(words[i][k : k + size]), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - size + 1):
            if first[tuple(w[k : k + size])] < i:
                gone |= set(range(k, k + size))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def tokens(docs, tokenizer):
    at, out = 0, {}
    for i, t in sorted(docs):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        out[i] = (at, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids)))
        at += len(ids)
    return out


def licence_base(docs):
    phrases = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
    out = {}
    for i, t in docs:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(AZ))
        found = [(k, label) for phrase, label in phrases.items() for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
        places = [k for k, _ in found]
        out[i] = (len(w), len(found), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in found})))
    return out


def media(text):
    raw = (text or "").encode()
    payload = raw + bytes(max(1, -(-len(raw) // 64)) * 64 - len(raw))
    return len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])


def shards(docs, limit):
    bits = {i: f"{int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16):060b}" for i, _ in docs}
    size = {i: len((t or "").encode()) for i, t in docs}
    out = {}

    def place(ids, depth):
        total = sum(size[i] for i in ids)
        if total <= limit or len(ids) == 1:
            for i in ids:
                out[i] = (bits[i][:depth], total, len(ids))
            return
        halves = defaultdict(list)
        for i in ids:
            halves[bits[i][depth]].append(i)
        for part in halves.values():
            place(part, depth + 1)

    if docs:
        place([i for i, _ in docs], 0)
    return out


def near_groups(docs, size=5, similarity=0.8):
    """{doc_id: least id of its group} by all pairs."""
    sets, ids, shingles = Sets(), sorted(i for i, _ in docs), {}
    for i, t in docs:
        w = WORD.findall((t or "").translate(AZ))
        shingles[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = shingles[i], shingles[j]
            if min(len(a), len(b)) < similarity * max(len(a), len(b)):
                continue
            both = len(a & b)
            if (both / (len(a) + len(b) - both) if a or b else 1.0) >= similarity:
                sets.join(i, j)
    return {i: sets.find(i) for i in ids}
