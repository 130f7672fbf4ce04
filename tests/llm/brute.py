"""Plain versions of the operators, for comparison."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base_rules(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = defaultdict(list)
    for i in range(len(words) - 7):
        windows[tuple(words[i : i + 8])].append(i)
    covered = {i + j for at in windows.values() if len(at) > 1 for i in at for j in range(8)}
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), len(words) < 20 or 100 * len(covered) > 30 * len(words)


def luhn(digits):
    total = 0
    for i, c in enumerate(map(int, reversed(digits))):
        total += c if i % 2 == 0 else sum(divmod(2 * c, 10))
    return total % 10 == 0


def personal(text):
    text = text or ""
    found = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            found.append(("phone", *m.span()))
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def covered(texts, size=35):
    """Positions of the words to remove, for each text."""
    split = [WORD.findall(t or "") for t in texts]
    count = Counter(tuple(w[i : i + size]) for w in split for i in range(len(w) - size + 1))
    return [{i + j for i in range(len(w) - size + 1) if count[tuple(w[i : i + size])] > 1 for j in range(size)} for w in split]


def repeated(texts, size=35):
    """(n_words, n_removed, kept) of each text."""
    out = []
    for text, gone in zip(texts, covered(texts, size)):
        words = WORD.findall(text or "")
        out.append((len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone)))
    return out


def without(text, gone):
    """The text without some words and the white space after them."""
    starts = [m.start() for m in WORD.finditer(text)] + [len(text)]
    return text[: starts[0]] + "".join(text[a:b] for i, (a, b) in enumerate(zip(starts, starts[1:])) if i not in gone)


def simhash(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    values = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


def groups(ids, fps):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = {}
    for i in range(len(fps)):
        r = find(i)
        if ids[i] is not None:
            least[r] = min(least.get(r, ids[i]), ids[i])
    return [least.get(find(i)) for i in range(len(fps))]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()
