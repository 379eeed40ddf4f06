"""Plain Python versions of the corpus operators, for tests: slow, row by row, without Spark."""

from __future__ import annotations

import hashlib
import re
import struct
import zlib

import numpy as np
import xxhash

WORD = re.compile("[^\\x20\\x09-\\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def simhash(text: str | None, width: int = 3) -> int:
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [" ".join(words)]
    votes = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for bit in range(64):
            votes[bit] += h >> bit & 1
    return sum(1 << bit for bit in range(64) if 2 * votes[bit] > len(shingles))


def components(edges: list[tuple[int, int]], nodes: list[int]) -> dict[int, int]:
    """Smallest id reachable, by union-find."""
    parent = {n: n for n in nodes}

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near_groups(fps: dict[int, int], most: int = 2) -> dict[int, int]:
    ids = sorted(fps)
    own = np.array([fps[i] for i in ids], dtype=np.uint64)
    edges = []
    for i, fp in enumerate(own):
        near = np.nonzero(np.bitwise_count(own[i + 1 :] ^ fp) <= most)[0]
        edges += [(ids[i], ids[i + 1 + j]) for j in near]
    return components(edges, ids)


def url_verdict(url: str | None, rules, default: str = "allow") -> tuple[str, str, str | None, str]:
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = host.translate(LOWER)
    best = None
    for rule_host, rule_path, action in rules:
        if (host == rule_host or host.endswith("." + rule_host)) and path.startswith(rule_path):
            key = (len(rule_host) + len(rule_path), len(rule_host), action == "block", rule_host, rule_path)
            best = max(best, key) if best else key
    return host, path, best and best[3] + best[4], ("block" if best[2] else "allow") if best else default


def mix(docs: list[tuple[int | None, str | None, str | None]], weights=(5.0, 2.0, 1.0), share=1.5, most=2.0):
    """(doc_id, text, source) -> per document (size, source_size, target, taken)."""
    sizes = [len(WORD.findall(t or "")) for _, t, _ in docs]
    sources = sorted({s for _, _, s in docs}, key=lambda s: (s is None, s or ""))
    total = {s: sum(n for n, d in zip(sizes, docs, strict=True) if d[2] == s) for s in sources}
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sources)}
    goal, free, left = {}, list(sources), share * sum(sizes)
    while free:  # whoever would pass its bound stops there; the rest is dealt again
        whole = sum(weight[s] for s in free)
        full = [s for s in free if left * weight[s] / whole >= most * total[s]]
        if not full:
            goal |= {s: left * weight[s] / whole for s in free}
            break
        for s in full:
            goal[s] = most * total[s]
        left -= sum(goal[s] for s in full)
        free = [s for s in free if s not in full]
    return sizes, total, goal


def sha1(payload: bytes) -> str:
    return hashlib.sha1(payload).hexdigest()


def crc_of_ids(ids: list[int]) -> int:
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


def nearest(vectors: list[tuple[int, list[float] | None]], queries: set[int], k: int = 10):
    """(query_id, rank, vec_id, score) by looking at every vector."""
    fine = [(i, np.array(v, dtype=np.float64)) for i, v in vectors if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)]
    out = []
    for q, v in fine:
        if q in queries:
            found = sorted((float(np.sqrt(((w - v) ** 2).sum())), i) for i, w in fine if i != q)[:k]
            out += [(q, n, i, s) for n, (s, i) in enumerate(found, 1)]
    return out
