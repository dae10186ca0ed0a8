"""Plain versions of the operators' contracts, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

SPACE = "\t\n\x0b\x0c\r "
WORD = re.compile(r"[^\x20\x09-\x0D]+")
BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def crc(ids) -> int:
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def token_rows(docs, path: str, end_id: int):
    """doc_id -> (start, n_tokens, crc)."""
    from tokenizers import Tokenizer

    tokenizer, start, out = Tokenizer.from_file(path), 0, {}
    for doc_id, text in sorted(docs):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, end_id]
        out[doc_id] = (start, len(ids), crc(ids))
        start += len(ids)
    return out


def document_ids(docs, path: str, end_id: int):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return {d: [*tokenizer.encode(t or "", add_special_tokens=False).ids, end_id] for d, t in docs}


def line_rows(docs):
    """doc_id -> (n_lines, n_dropped, digest)."""
    owners = defaultdict(set)
    for doc_id, text in docs:
        for line in (text or "").split("\n"):
            key = line.strip(SPACE).translate(UPPER)
            if len(key) >= 10:
                owners[key].add(doc_id)
    out = {}
    for doc_id, text in docs:
        lines = (text or "").split("\n")
        kept = []
        for line in lines:
            own = owners.get(line.strip(SPACE).translate(UPPER), ())
            if len(own) < 2 or min(own) == doc_id:
                kept.append(line)
        out[doc_id] = (len(lines), len(lines) - len(kept), sha("\n".join(kept)))
    return out


def repeat_rows(docs, window: int = 35):
    """doc_id -> (n_words, n_removed, digest) for repeated windows of words."""
    words = {d: WORD.findall(t or "") for d, t in docs}
    seen = Counter(tuple(w[i : i + window]) for w in words.values() for i in range(len(w) - window + 1))
    out = {}
    for d, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out[d] = (len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def contamination_rows(docs, items, window: int = 13):
    """doc_id -> (n_words, n_hit, n_items, digest, contaminated)."""
    patterns = defaultdict(set)
    for item_id, text in items:
        w = BENCH_WORD.findall((text or "").translate(UPPER))
        size = min(window, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            patterns[tuple(w[i : i + size])].add(item_id)
    sizes = {len(p) for p in patterns}
    out = {}
    for d, text in docs:
        w = BENCH_WORD.findall((text or "").translate(UPPER))
        hit, found = set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                if (own := patterns.get(tuple(w[i : i + size]))) is not None:
                    hit.update(range(i, i + size))
                    found |= own - {None}
        digest = sha(",".join(sorted(map(str, found))))
        out[d] = (len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w))
    return out


def base_rows(docs, window: int = 8):
    """doc_id -> (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    out = {}
    for d, text in docs:
        text = text or ""
        w = WORD.findall(text)
        seen, dup = set(), 0
        for line in text.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        count = Counter(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
        covered = set()
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                covered.update(range(i, i + window))
        failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
        out[d] = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed)
    return out


def shingles(text: str, size: int = 5) -> Counter:
    w = WORD.findall(text or "")
    return Counter(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else Counter()


def similarity(a: Counter, b: Counter) -> float:
    both = sum(min(n, b.get(k, 0)) for k, n in a.items())
    return both / (sum(a.values()) + sum(b.values()) - both) if both else 0.0


def near_classes(docs, threshold: float = 0.8):
    """doc_id -> smallest doc_id of its class, over all pairs."""
    have = {d: shingles(t) for d, t in docs}
    top = {d: d for d in have}

    def find(d):
        while top[d] != d:
            d = top[d]
        return d

    by_shingle = defaultdict(list)
    for d, c in have.items():
        for s in c:
            by_shingle[s].append(d)
    tried = set()
    for members in by_shingle.values():
        for a in members:
            for b in members:
                if a < b and (a, b) not in tried:
                    tried.add((a, b))
                    if similarity(have[a], have[b]) >= threshold:
                        x, y = sorted((find(a), find(b)))
                        top[y] = x
    return {d: find(d) for d in have}


def lower_words(text) -> list[str]:
    return BENCH_WORD.findall((text or "").translate(UPPER))


def search_rows(docs, items, top: int = 50):
    """(item_id, rank, doc_id, score) of every item's best documents."""
    terms = [Counter(lower_words(t)) for _, t in docs]
    sizes = [sum(c.values()) for c in terms]
    n_docs, n_terms = sum(n > 0 for n in sizes), sum(sizes)
    df = Counter(t for c in terms for t in c)
    queries = defaultdict(set)
    for item_id, text in items:
        queries[item_id].update(lower_words(text))
    out = []
    for item_id, query in queries.items():
        scored = []
        for (doc_id, _), own, n in zip(docs, terms, sizes, strict=True):
            score = 0
            for t in query & own.keys():
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += w * ((1000000000 * own[t]) // (1000 * own[t] + 20 * (100 - 50 + (50 * n * n_docs) // n_terms)))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, k, d, -s) for k, (s, _, _, d) in enumerate(sorted(scored)[:top], 1)]
    return out


def resampled_rows(docs, target, buckets: int = 10000, percent: int = 25, least: int = 20):
    """(doc_id, n_features, weight, score, rank) of every document, in any order."""

    def features(text):
        w = lower_words(text)
        return [zlib.crc32(f.encode()) % buckets for f in [*w, *map(" ".join, zip(w, w[1:], strict=False))]]

    found = [features(t) for _, t in docs]
    s, t = Counter(b for f in found for b in f), Counter(b for x in target for b in features(x))
    s_all, t_all = s.total(), t.total()
    gain = {
        b: math.floor(1000 * math.log(float(t[b] + 1) * float(s_all + buckets) / (float(s[b] + 1) * float(t_all + buckets))))
        for b in s
    }
    rows = []
    for (doc_id, text), own in zip(docs, found, strict=True):
        weight = sum(gain[b] for b in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc_id, len(own), weight, score, None, len(lower_words(text)) >= least])
    fit = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for rank, row in enumerate(fit[: len(fit) * percent // 100], 1):
        row[4] = rank
    return [tuple(r[:5]) for r in rows]


def simhash_rows(docs, distance: int = 3):
    """(doc_id, fingerprint, component_id) of every row."""
    import xxhash

    prints = []
    for _, text in docs:
        w = WORD.findall((text or "").translate(UPPER))
        n = min(3, len(w))
        hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + n]).encode(), 42) for i in range(len(w) - n + 1)] if w else []
        prints.append(sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64)) if hashes else 0)
    distinct = sorted(set(prints))
    top = {p: p for p in distinct}

    def find(p):
        while top[p] != p:
            p = top[p]
        return p

    for k, a in enumerate(distinct):
        for b in distinct[k + 1 :]:
            if (a ^ b).bit_count() <= distance:
                x, y = sorted((find(a), find(b)))
                top[y] = x
    first = {}
    for (doc_id, _), p in zip(docs, prints, strict=True):
        known = first.get(find(p))
        first[find(p)] = doc_id if known is None else known if doc_id is None else min(known, doc_id)
    return [(d, f"{p:016x}", first[find(p)]) for (d, _), p in zip(docs, prints, strict=True)]
