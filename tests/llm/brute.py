"""Plain versions of the operators' contracts, for comparison on small tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def quality(text: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    words = WORD.findall(text)
    places: dict[tuple, list[int]] = {}
    for i in range(len(words) - 4):
        places.setdefault(tuple(words[i : i + 5]), []).append(i)
    repeated = {j for v in places.values() if len(v) > 1 for i in v for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 10 or 100 * len(repeated) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated), failed


def covered_chars(text: str | None) -> int:
    """Code points of the words that lie in a repeat of five words or more."""
    words = WORD.findall(text or "")
    places: dict[tuple, list[int]] = {}
    for i in range(len(words) - 4):
        places.setdefault(tuple(words[i : i + 5]), []).append(i)
    return sum(len(words[j]) for j in {j for v in places.values() if len(v) > 1 for i in v for j in range(i, i + 5)})


def longest_repeat(words: list[str]) -> int:
    """Length of the longest run of words that starts at two places."""
    best = 0
    for length in range(1, len(words)):
        runs = Counter(tuple(words[i : i + length]) for i in range(len(words) - length + 1))
        if max(runs.values()) < 2:
            break
        best = length
    return best


def dedup(rows: list[tuple[int, str | None]]) -> dict[int, tuple]:
    groups: dict[str, list[int]] = {}
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t in rows}
    for i, t in norm.items():
        groups.setdefault(t, []).append(i)
    return {i: (min(groups[t]), len(groups[t]), min(groups[t]) == i, hashlib.sha256(t.encode()).hexdigest()) for i, t in norm.items()}


def shingles(text: str | None, k: int = 3) -> frozenset:
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lower)
    if not words:
        return frozenset()
    return frozenset([tuple(words)]) if len(words) < k else frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def jaccard_components(rows: list[tuple[int, str | None]], pct: int = 90, k: int = 3) -> dict[int, tuple]:
    """(set size, component), comparing all pairs that share a shingle."""
    sets = {i: shingles(t, k) for i, t in rows}
    inverted: dict[tuple, list[int]] = {}
    both: Counter = Counter()
    for i, s in sets.items():
        for x in s:
            for j in inverted.setdefault(x, []):
                both[j, i] += 1
            inverted[x].append(i)
    parent = {i: i for i in sets}

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for (i, j), n in both.items():
        if 100 * n >= pct * (len(sets[i]) + len(sets[j]) - n):
            a, b = sorted((root(i), root(j)))
            parent[b] = a
    return {i: (len(s), root(i)) for i, s in sets.items()}


def repeats(rows: list[tuple[int, str | None]], length: int = 400) -> dict[int, tuple]:
    """n_bytes, n_removed, n_spans, kept_sha256, from every string of the length."""
    data = {i: (t or "").encode() for i, t in rows}
    seen = Counter(hashlib.blake2b(b[s : s + length], digest_size=16).digest() for b in data.values() for s in range(len(b) - length + 1))
    out = {}
    for i, b in data.items():
        gone = np.zeros(len(b) + 1, np.int64)
        for s in range(len(b) - length + 1):
            if seen[hashlib.blake2b(b[s : s + length], digest_size=16).digest()] > 1:
                gone[s] += 1
                gone[s + length] -= 1
        mask = np.cumsum(gone[:-1]) > 0
        kept = bytes(np.frombuffer(b, np.uint8)[~mask])
        spans = int(mask[:1].sum() + (mask[1:] & ~mask[:-1]).sum())
        out[i] = (len(b), int(mask.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def without_repeated_words(rows: list[tuple[int, str | None]], length: int) -> dict[int, str]:
    """The texts without every run of ``length`` words that starts at two places or more."""
    words = {i: list(WORD.finditer(t or "")) for i, t in rows}
    runs = lambda w: [tuple(m.group() for m in w[s : s + length]) for s in range(len(w) - length + 1)]
    seen = Counter(r for w in words.values() for r in runs(w))
    out = {}
    for i, t in rows:
        t, w = t or "", words[i]
        gone = set()
        for s, r in enumerate(runs(w)):
            if seen[r] > 1:
                gone |= set(range(w[s].start(), w[s + length - 1].end()))
        out[i] = "".join(c for k, c in enumerate(t) if k not in gone)
    return out


def token_ids(texts: list[str | None], path: str) -> list[np.ndarray]:
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return [np.array([*e.ids, 1], "<u4") for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def letter_vector(point: int) -> list[int]:
    """1,024 times +1 or -1 from a code point, with whole numbers of Python."""
    out, m = [], (1 << 64) - 1
    for k in range(16):
        x = ((point * 16 + k) * 0x9E3779B97F4A7C15 + 20_001) & m
        for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            x = (x ^ x >> 33) * factor & m
        x ^= x >> 33
        out += [1 if x >> i & 1 else -1 for i in range(64)]
    return out


def languages(rows: list[tuple]) -> dict[int, tuple]:
    """held_out, language and score of each row, one trigram at a time."""
    known: dict[int, np.ndarray] = {}

    def vector(point: int) -> np.ndarray:
        if point not in known:
            known[point] = np.array(letter_vector(point), float)
        return known[point]

    def bundle(text: str | None) -> np.ndarray | None:
        symbols = [0]
        for c in (text or "").lower():
            s = ord(c) if c.isalpha() else 0
            if s or symbols[-1]:
                symbols.append(s)
        if not any(symbols):
            return None
        symbols += [0] if symbols[-1] else []
        out, n = np.zeros(1024), 0
        for a, b, c in zip(symbols, symbols[1:], symbols[2:], strict=False):
            out += np.roll(vector(a), 2) * np.roll(vector(b), 1) * vector(c)
            n += 1
        return out / max(n, 1)

    made = {i: bundle(t) for i, t, _ in rows}
    held = {i: zlib.crc32(str(i).encode()) % 3 == 1 for i, _, _ in rows}
    names = sorted({lang for i, _, lang in rows if lang is not None and not held[i] and made[i] is not None})
    prototypes = np.array([np.mean([made[i] for i, _, lang in rows if lang == name and not held[i] and made[i] is not None], axis=0) for name in names])
    mean = prototypes.mean(axis=0) if len(names) > 1 else 0
    out = {}
    for i, _, _ in rows:
        if made[i] is None or not names:
            out[i] = (held[i], "und", 0.0)
            continue
        own = made[i] - mean
        cosines = [(p - mean) @ own / np.linalg.norm(p - mean) / max(np.linalg.norm(own), 1e-12) for p in prototypes]
        best = int(np.argmax(cosines))
        out[i] = (held[i], names[best], min(1.0, max(0.0, (1 + cosines[best]) / 2)))
    return out


def weak_labels(rows: list[tuple[int, bytes]], order: dict[int, tuple], m) -> dict[int, tuple]:
    """votes_good, votes_bad, posterior and score of each row; ``m`` has the labellers, features and constants. The estimation, the sample
    and the training are written out here."""
    import math

    votes = {i: m.votes(m.statistics(t)) for i, t in rows}
    weight = Counter(map(tuple, votes.values()))
    total = sum(weight.values())
    good = {v: 1 / (1 + math.exp(2.5 * v.count(-1) - 0.5 * v.count(1))) for v in weight}
    for _ in range(100):
        share = sum(weight[v] * good[v] for v in weight) / total
        table = {}
        for c in (0, 1):
            for k in range(m.LABELLERS):
                cells = [1e-4 + sum(weight[v] / total * (good[v] if c else 1 - good[v]) for v in weight if v[k] == x) for x in (-1, 0, 1)]
                table[c, k] = [x / sum(cells) for x in cells]
        then = {}
        for v in weight:
            log = [sum(math.log(table[c, k][v[k] + 1]) for k in range(m.LABELLERS)) + math.log(max(share if c else 1 - share, 1e-6)) for c in (0, 1)]
            then[v] = 1 / (1 + math.exp(min(500, max(-500, log[0] - log[1]))))
        done = max(abs(then[v] - good[v]) for v in good) < 1e-9
        good = then
        if done:
            break
    sample = sorted({order[i]: (t, good[tuple(votes[i])]) for i, t in rows}.items())[: m.SAMPLE]
    labels = [y for _, (_, y) in sample]
    share = min(max(sum(labels) / len(labels), 0.02), 0.98)
    w, g = [0.0] * (m.DIMENSIONS + 1), [1e-3] * (m.DIMENSIONS + 1)

    def features(t: bytes) -> list[tuple[int, float]]:
        place, value = m.features(t, m.statistics(t))
        return [*zip(place.tolist(), value.tolist(), strict=True), (m.DIMENSIONS, 1.0)]

    made = [[(p, float(np.float32(x))) for p, x in features(t)] for _, (t, _) in sample]
    for _ in range(m.PASSES):
        for own, y in zip(made, labels, strict=True):
            p = 1 / (1 + math.exp(-min(30, max(-30, sum(w[i] * x for i, x in own)))))
            steps = [(i, (p - y) * x * (0.5 * y / share + 0.5 * (1 - y) / (1 - share))) for i, x in own]
            for i, s in steps:
                g[i] += s * s
            for i, s in steps:
                w[i] -= m.RATE * s / math.sqrt(g[i])
    out = {}
    for i, t in rows:
        z = sum(w[k] * x for k, x in features(t))
        out[i] = (votes[i].count(1), votes[i].count(-1), good[tuple(votes[i])], 1 / (1 + math.exp(-min(30, max(-30, z)))))
    return out


def cleaned(rows: list[tuple[int, str | None]], length: int, words: int) -> dict[int, str]:
    """The texts without strings of ``length`` bytes and runs of ``words`` words that start at two places or more."""
    data = {i: (t or "").encode() for i, t in rows}
    grams = Counter(b[s : s + length] for b in data.values() for s in range(len(b) - length + 1))
    places = {i: [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", b)] for i, b in data.items()}
    run = lambda i, s: tuple(data[i][a:z] for a, z in places[i][s : s + words])
    runs = Counter(run(i, s) for i in data for s in range(len(places[i]) - words + 1))
    out = {}
    for i, b in data.items():
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            if grams[b[s : s + length]] > 1:
                gone[s : s + length] = True
        for s in range(len(places[i]) - words + 1):
            if runs[run(i, s)] > 1:
                gone[places[i][s][0] : places[i][s + words - 1][1]] = True
        out[i] = bytes(np.frombuffer(b, np.uint8)[~gone]).decode("utf-8", "ignore")
    return out
