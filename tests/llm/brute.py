"""Plain Python versions of the contracts."""

import hashlib
import re
import struct
import zlib
from collections import Counter

import xxhash

BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
PII = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
       ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def low(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def alnum_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def license_base(text):
    words = alnum_words(text)
    places = [(k, label) for phrase, label in BASE.items() for k in range(len(words))
              if words[k:k + phrase.count(" ") + 1] == phrase.split()]
    starts = [k for k, _ in places]
    return (len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places})))


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


def passes(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(x) <= 255 for x in match.split("."))
    if kind == "phone":
        return 9 <= len(digits) <= 15
    if kind == "card":
        return 12 <= len(digits) <= 19 and sum(
            x if k % 2 == 0 else 2 * x - 9 * (x > 4) for k, x in enumerate(map(int, reversed(digits)))) % 10 == 0
    return True


def pii(text):
    spans = sorted((m.start(), n, m.end(), kind) for n, (kind, pattern) in enumerate(PII)
                   for m in re.finditer(pattern, text or "") if passes(kind, m.group()))
    listed = ",".join(f"{kind}:{start}:{end}" for start, _, end, kind in spans)
    return tuple(sum(s[3] == kind for s in spans) for kind, _ in PII), sha(listed), listed


def simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", low(text))
    shingles = [" ".join(words[k:k + 4]) for k in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def classes(fps, radius=4):
    parent = list(range(len(fps)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return [root(k) for k in range(len(fps))]


def rules(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = Counter(zip(words, words[1:], words[2:]))
    covered = {k + j for k in range(len(words) - 2) if seen[tuple(words[k:k + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def contamination(text, items):
    words, hit, named = alnum_words(text), set(), set()
    for item, body in items:
        own = alnum_words(body)
        n = min(10, len(own))
        for k in range(len(own) - n + 1 if own else 0):
            for at in range(len(words) - n + 1):
                if words[at:at + n] == own[k:k + n]:
                    hit |= set(range(at, at + n))
                    named.add(str(item))
    return len(words), len(hit), len(named), sha(",".join(sorted(named))), bool(hit)
