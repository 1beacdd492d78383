"""Brute-force versions of the corpus operators, one document after another."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

WHITE = " \t\n\x0b\x0c\r"


def lowered(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def words(text: str) -> list[str]:
    return [w for w in re.split(f"[{WHITE}]+", lowered(text)) if w]


def without_lines(docs: dict[int, str]) -> dict[int, tuple[int, int, str]]:
    first = {}
    for i in sorted(docs):
        for line in docs[i].split("\n"):
            first.setdefault(lowered(line.strip(WHITE)), i)
    out = {}
    for i, text in docs.items():
        lines = text.split("\n")
        keys = [lowered(line.strip(WHITE)) for line in lines]
        kept = [line for line, k in zip(lines, keys, strict=True) if len(k) < 10 or first[k] == i]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def shingles(text: str, n: int = 5) -> frozenset:
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)])


def near_groups(docs: dict[int, str]) -> dict[int, int]:
    sets = {i: shingles(t) for i, t in docs.items()}
    root = {i: i for i in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    held = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            held[x].append(i)
    for i, s in sets.items():
        for j in {j for x in s for j in held[x] if j < i}:
            both = len(s & sets[j])
            if 100 * both >= 75 * (len(s) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in docs}


def without_repeats(docs: dict[int, str], length: int = 100) -> dict[int, tuple[int, int, int, bytes]]:
    seen, out = set(), {}
    for i in sorted(docs):
        data = docs[i].encode()
        gone = bytearray(len(data))
        for s in range(len(data) - length + 1):
            window = data[s : s + length]
            if window in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(window)
        kept = bytes(x for x, g in zip(data, gone, strict=True) if not g)
        spans = sum(1 for j, g in enumerate(gone) if g and not (j and gone[j - 1]))
        out[i] = (len(data), sum(gone), spans, kept)
    return out


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def personal(text: str) -> list[tuple[str, int, int]]:
    """Base spans, by kind and start."""
    found = []

    def add(kind, pattern, good):
        found.extend((kind, m.start(), m.end()) for m in re.finditer(pattern, text) if good(m[0], re.sub("[^0-9]", "", m[0])))

    add("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m, d: True)
    add("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m, d: all(int(p) <= 255 for p in m.split(".")))
    add("card", r"[0-9]([\x20-]?[0-9])+", lambda m, d: 16 <= len(d) <= 19 and luhn(d))
    add("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m, d: 8 <= len(d) <= 15)
    return found


def top(vectors: dict[int, list[int]], queries: list[int], k: int) -> list[tuple[int, int, int, int]]:
    out = []
    for q in queries:
        scores = sorted(
            (-sum(a * b for a, b in zip(vectors[q], v, strict=False)), i) for i, v in vectors.items() if i != q
        )
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scores[:k], 1)]
    return out


def sha(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def merkle_leaf(row: tuple) -> str:
    """Of (doc_id, source, lang, n_chars, text)."""
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree_levels(nodes: list[str]) -> list[list[str]]:
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def merkle(rows: list[tuple]) -> dict:
    """Per doc_id of rows (doc_id, source, lang, n_chars, text): leaf, subroot, root, proof_sha256, folded_root, verified."""
    langs = defaultdict(list)
    for row in rows:
        langs[row[2]].append(row)
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: tree_levels([merkle_leaf(r) for r in sorted(langs[x], key=lambda r: r[0])]) for x in order}
    top = tree_levels([trees[x][-1][0] for x in order])
    out = {}
    for place, x in enumerate(order):
        for pos, row in enumerate(sorted(langs[x], key=lambda r: r[0])):
            hit = zlib.crc32(str(row[0]).encode()) % 7 == 0 and row[3] is not None
            node = merkle_leaf((*row[:3], row[3] + 1, row[4])) if hit else merkle_leaf(row)
            proof = []
            for levels, i in ((trees[x], pos), (top, place)):
                for nodes in levels[:-1]:
                    other = nodes[i ^ 1 : (i ^ 1) + 1]
                    proof += other
                    node = sha(*other, node) if i % 2 else sha(node, *other)
                    i //= 2
            root = top[-1][0]
            out[row[0]] = (merkle_leaf(row), trees[x][-1][0], root, sha(*proof), node, node == root)
    return out


def phrases(rows: list[tuple], support: int, k: int) -> list[tuple]:
    """Of (lang, text): (lang, rank, phrase, a, l, r, n, score)."""
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lowered(text or "")):
            w = [x for x in re.split("[ \t]+", piece) if x]
            totals[lang or "und"] += len(w)
            counts[lang or "und"].update(tuple(w[i : i + m]) for m in range(1, 6) for i in range(len(w) - m + 1))
    out = []
    for lang, c in counts.items():
        held = {p: a for p, a in c.items() if a >= support and len(p) > 1}
        found = []
        for p, a in held.items():
            if any(c[q] >= a for q in held if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))):
                continue
            score, cut = min((1000 * a * totals[lang] // (c[p[:j]] * c[p[j:]]), j) for j in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), c[p[:cut]], c[p[cut:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:k], 1):
            out.append((lang, rank, p.decode(), -a, left, right, totals[lang], -score))
    return out


def rendezvous(key: object, weights: list[float]) -> int:
    def cost(s: int) -> float:
        text = "" if key is None else str(key)
        u = (int(hashlib.md5(f"{text}:{s}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        return -math.log(u) / weights[s]

    return min(range(len(weights)), key=cost)
