"""Plain Python versions of the operators, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def components(ids, links):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def near_classes(docs, n=5, least=0.8):
    """docs: {id: text}; classes by copies and Jaccard similarity of runs of n words."""
    sets = {}
    for i, t in docs.items():
        w = words(t)
        sets[i] = {tuple(w[k : k + n]) for k in range(max(len(w) - n + 1, min(len(w), 1)))}
    links, ids = [], sorted(docs)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            a, b = sets[i], sets[j]
            if (docs[i] or "") == (docs[j] or "") or (a and b and len(a & b) >= least * len(a | b)):
                links.append((i, j))
    return components(ids, links)


def substring(docs, window=35):
    """{id: (n_words, n_removed, kept words)}"""
    seen = Counter()
    split = {i: words(t) for i, t in docs.items()}
    for w in split.values():
        seen.update(tuple(w[k : k + window]) for k in range(len(w) - window + 1))
    out = {}
    for i, w in split.items():
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = True
        out[i] = (len(w), int(gone.sum()), [x for x, g in zip(w, gone) if not g])
    return out


def suffix(docs, window=100):
    """{id: (n_bytes, n_removed, n_spans, sha of the rest)}"""
    seen, out = set(), {}
    for i in sorted(docs):
        raw = (docs[i] or "").encode()
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - window + 1):
            part = raw[k : k + window]
            if part in seen:
                gone[k : k + window] = True
            seen.add(part)
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        out[i] = (len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def vector_links(vectors, least=0.93):
    """vectors: {id: (array, label)}"""
    groups = defaultdict(list)
    for i, (v, label) in vectors.items():
        if v is not None and label is not None and not any(x is None or not np.isfinite(x) for x in v) and any(v):
            groups[label].append(i)
    links = []
    for ids in groups.values():
        x = np.array([vectors[i][0] for i in ids], float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        a, b = np.nonzero(np.triu(x @ x.T >= least, 1))
        links += [(ids[p], ids[q]) for p, q in zip(a, b)]
    return links
