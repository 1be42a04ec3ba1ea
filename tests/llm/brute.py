"""Plain-Python versions of the operators' contracts."""

import hashlib
import math
import re
import struct
from collections import defaultdict

import xxhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def exact_dedup(rows):
    groups = defaultdict(list)
    norm = {}
    for i, (doc_id, text) in enumerate(rows):
        norm[i] = re.sub(r"[\x20\x09-\x0D]+", " ", text or "")
        groups[norm[i]].append(doc_id)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [x for x in groups[norm[i]] if x is not None]
        keep = min(ids) if ids else None
        out.append((doc_id, keep, len(groups[norm[i]]), hashlib.sha256(norm[i].encode()).hexdigest()))
    return out


def decontaminate(docs, items, window=10):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    wins = set()
    for item, text in items:
        w = cut(text)
        for i in range(max(len(w) - window + 1, 1) if w else 0):
            wins.add((item, tuple(w[i : i + window])))
    out = {}
    for doc, text in docs:
        w, hit, found = cut(text), set(), set()
        for item, win in wins:
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit.update(range(i, i + len(win)))
                    found.add(str(item))
        out[doc] = (len(w), len(hit), sorted(found))
    return out


def link_classes(rows, n=4, num=85, den=100):
    sets = []
    for _, text in rows:
        w = words((text or "").translate(LOWER))
        sets.append({tuple(w[i : i + n]) for i in range(max(len(w) - n + 1, 1))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if rows[i][0] is not None and rows[j][0] is not None and a and b and den * len(a & b) >= num * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            r = find(i)
            least[r] = min(least.get(r, doc), doc)
    return [(doc, len(sets[i]), least.get(find(i)) if doc is not None else None) for i, (doc, _) in enumerate(rows)]


def dedup_lines(docs, min_words):
    """Maximal repeated runs by trying every pair of places; docs are (id, text) in order of id."""
    lines = []
    cut = {}
    for doc, text in docs:
        cut[doc] = re.split(r"\n(?=[\x20\x09\x0B-\x0D]*[^\x20\x09-\x0D])", text) if text is not None else []
        seq = [(doc, i, tuple(words(x))) for i, x in enumerate(cut[doc]) if words(x)]
        lines.append(seq)
    gone = set()
    for di, late in enumerate(lines):
        for ei in range(di + 1):
            early = lines[ei]
            for a in range(len(late)):
                for b in range(len(early)):
                    if ei == di and b >= a:
                        break
                    k = 0
                    while a + k < len(late) and b + k < len(early) and late[a + k][2] == early[b + k][2] and late[a + k][1] == late[a][1] + k and early[b + k][1] == early[b][1] + k and not (ei == di and b + k >= a):
                        k += 1
                    if k and sum(len(x[2]) for x in late[a : a + k]) >= min_words:
                        gone.update((x[0], x[1]) for x in late[a : a + k])
    return {doc: None if text is None else "\n".join(x for i, x in enumerate(cut[doc]) if (doc, i) not in gone) for doc, text in docs}


def greedy_pieces(word, initial, continuing):
    at, n = 0, 0
    while at < len(word):
        pieces = initial if at == 0 else continuing
        for end in range(len(word), at, -1):
            if word[at:end] in pieces:
                at, n = end, n + 1
                break
        else:
            return -1
    return n


def xx64(*values, seed=42):
    """Spark's xxhash64 of longs, 32-bit ints (as ("int", v)), strings and nulls, signed."""
    h = seed
    for v in values:
        if v is not None:
            raw = struct.pack("<i", v[1]) if isinstance(v, tuple) else v.encode() if isinstance(v, str) else struct.pack("<q", v)
            h = xxhash.xxh64_intdigest(raw, h & (2**64 - 1))
    return h - 2**64 if h >= 2**63 else h


def permutation(n, seed, rounds=6):
    a = math.isqrt(n - 1) + 1 if n > 1 else 1
    b = -(-n // a)

    def through(k):
        x, y, p, q = k // b, k % b, a, b
        for i in range(1, rounds + 1):
            x, y, p, q = y, (x + xx64(y, seed, ("int", i)) % p) % p, q, p
        return x * q + y

    out = []
    for k in range(n):
        k = through(k)
        while k >= n:
            k = through(k)
        out.append(k)
    return out


def mix(rows, block_words, shard_slots, bucket_rows, seed=17, epochs=1.5, most=2.0, weights=(5, 2, 1)):
    """({doc_id: taken}, {(shard, slot): (source, text)}) of rows (doc_id, text, source)."""
    buckets = max(1, len(rows) // bucket_rows)
    names = sorted({s for _, _, s in rows}, key=lambda s: (s is None, (s or "").encode()))
    stream = {s: [] for s in names}
    place = lambda r: (xx64(r[0], len(words(r[1]))) % buckets, r[0])
    for doc, text, source in sorted(rows, key=place):
        stream[source] += [(doc, w) for w in words(text)]
    size = {s: len(stream[s]) for s in names}
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    low, high = 0.0, 1e12  # the level at which capped shares add up, by bisection
    for _ in range(300):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(most * size[s], level * w[s]) for s in names) < epochs * sum(size.values()) else (low, level)
    blocks = {s: -(-size[s] // block_words) for s in names}
    want = {s: min(2 * blocks[s], round(min(most * size[s], high * w[s]) * blocks[s] / size[s])) if size[s] else 0 for s in names}
    cards = [s for s in names for _ in range(want[s])]
    n = max(len(cards) // bucket_rows, 1)
    hashes = [xx64(("int", seed), i) for i in range(len(cards))]
    order = sorted(range(len(cards)), key=lambda i: (hashes[i] % n, hashes[i], i))
    perm = {s: permutation(blocks[s], xx64(s, ("int", seed))) for s in names if blocks[s]}
    turn, taken, slots = dict.fromkeys(names, 0), {r[0]: 0 for r in rows}, {}
    for at, card in enumerate(order):
        s = cards[card]
        block = perm[s][turn[s] % blocks[s]]
        turn[s] += 1
        part = stream[s][block * block_words : (block + 1) * block_words]
        for doc, _ in part:
            taken[doc] += 1
        slots[divmod(at, shard_slots)] = (s, " ".join(x for _, x in part))
    return taken, slots
