"""Plain Python versions of the operators, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = r"[^\x20\x09-\x0D]+"


def words(text):
    return re.findall(WORD, text or "")


def substrings(docs, window=13):
    """[(doc_id, n_words, n_removed, sha256)] of [(doc_id, text)]."""
    first, tokens, out = {}, [words(t) for _, t in docs], []
    for (k, _), w in zip(docs, tokens):
        if k is not None:
            for j in range(len(w) - window + 1):
                x = tuple(w[j : j + window])
                first[x] = min(k, first.get(x, k))
    for (k, _), w in zip(docs, tokens):
        gone = set()
        if k is not None:
            for j in range(len(w) - window + 1):
                if first[tuple(w[j : j + window])] < k:
                    gone |= set(range(j, j + window))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((k, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def shingles(text, counts=True):
    w = words(text)
    c = Counter([tuple(w)] if len(w) < 5 else (tuple(w[i : i + 5]) for i in range(len(w) - 4))) if w else Counter()
    return c if counts else Counter(dict.fromkeys(c, 1))


def classes(docs, similarity=0.8, counts=True):
    """[(doc_id, class_id)] of [(doc_id, text)]."""
    parent, sets, holders = list(range(len(docs))), [shingles(t, counts) for _, t in docs], defaultdict(list)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        shared = Counter()
        for x, n in s.items():
            for j in holders[x]:
                shared[j] += min(n, sets[j][x])
            holders[x].append(i)
        for j, n in shared.items():
            if n >= similarity * (sum(s.values()) + sum(sets[j].values()) - n) - 1e-9:
                parent[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(docs):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return [(k, least.get(find(i)) if words(t) else k) for i, (k, t) in enumerate(docs)]


def quality(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    w = words(text)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    twice, covered = Counter(windows), set()
    for i, x in enumerate(windows):
        if twice[x] > 1:
            covered |= set(range(i, i + 8))
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def revisits(pages):
    """[(page_id, bytes, sha1, type, refers_to)] of [(page_id, html)] with distinct ids."""
    largest = {}
    for k, h in pages:
        largest[h or ""] = max(k, largest.get(h or "", k))
    out = []
    for k, h in pages:
        body = (h or "").encode()
        keeper = largest[h or ""] if len(body) >= 1000 else k
        out.append((k, len(body), hashlib.sha1(body).hexdigest(), "response" if keeper == k else "revisit", None if keeper == k else keeper))
    return out
