"""Slow, plain versions of the operators."""

import collections
import hashlib
import re
import zlib
from itertools import combinations

import numpy as np


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def order(doc):
    return 2**63 - 1 if doc is None else doc


def substring_cover(rows, span):
    """Per row the list of its words and whether each is removed."""
    words = [(t or "").encode().split() for _, t in rows]
    first = {}
    for (doc, _), w in zip(rows, words, strict=True):
        for p in range(len(w) - span + 1):
            key = tuple(w[p : p + span])
            first[key] = min(first.get(key, order(doc)), order(doc))
    out = []
    for (doc, _), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for p in range(len(w) - span + 1):
            if first[tuple(w[p : p + span])] < order(doc):
                gone[p : p + span] = [True] * span
        out.append((w, gone))
    return out


def op1(rows, span=50):
    return [(doc, len(w), sum(g), sha(b" ".join(x for x, y in zip(w, g, strict=True) if not y))) for (doc, _), (w, g) in zip(rows, substring_cover(rows, span), strict=True)]


def cut(text, gone):
    """The text without removed words; a removed word goes with what follows it."""
    data = (text or "").encode()
    spans = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", data)]
    starts = [a for a, _ in spans] + [len(data)]
    keep = [data[: starts[0]]] + [data[starts[i] : starts[i + 1]] for i in range(len(spans)) if not gone[i]]
    return b"".join(keep).decode()


def op9(rows, span=200):
    count = collections.Counter()
    texts = [(t or "").encode() for _, t in rows]
    for t in texts:
        count.update(t[p : p + span] for p in range(len(t) - span + 1))
    out = []
    for (doc, _), t in zip(rows, texts, strict=True):
        gone = np.zeros(len(t) + 1, bool)
        for p in range(len(t) - span + 1):
            if count[t[p : p + span]] > 1:
                gone[p : p + span] = True
        n_spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((doc, len(t), int(gone.sum()), n_spans, sha(bytes(x for x, g in zip(t, gone, strict=False) if not g))))
    return out


def fingerprint(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def op8(rows):
    fps = [fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))
    changed = True
    near = [[j for j in range(len(rows)) if bin(fps[i] ^ fps[j]).count("1") <= 2] for i in range(len(rows))]
    while changed:
        changed = False
        for i, js in enumerate(near):
            m = min(group[j] for j in js)
            changed, group[i] = changed or m < group[i], m
    least = {}
    for g, (doc, _) in zip(group, rows, strict=True):
        least[g] = min(least.get(g, 2**63 - 1), order(doc))
    return [(doc, f"{f:016x}", None if least[g] == 2**63 - 1 else least[g]) for (doc, _), f, g in zip(rows, fps, group, strict=True)]


def op7(rows, items):
    cut_ = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = collections.defaultdict(set)
    for item, text in items:
        w = cut_(text)
        n = min(10, len(w))
        for p in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[p : p + n])].add("null" if item is None else str(item))
    lengths = {len(k) for k in windows}
    out = []
    for doc, text in rows:
        w = cut_(text)
        hit, found = [False] * len(w), set()
        for n in lengths:
            for p in range(len(w) - n + 1):
                if (names := windows.get(tuple(w[p : p + n]))) is not None:
                    hit[p : p + n] = [True] * n
                    found |= names
        out.append((doc, len(w), sum(hit), len(found), sha(",".join(sorted(found)).encode()), any(hit)))
    return out


def op2_line(line):
    from evenstrand.llm.quality import BOILERPLATE

    words = re.findall(r"[^\x20\x09-\x0D]+", line)
    chars = len("".join(words))
    marks, symbols = sum(c in "|»›•·" for c in line), sum(c in "#*$%&|<>" for c in line)
    sentence = re.search(r"[.!?…。！？][\"'”’»)\]]*([\x20\x09-\x0D]|\Z)", line)
    return bool(sentence) and 10 * symbols <= chars and not (marks >= 2 and 3 * marks >= len(words)) and not any(b in lower(line) for b in BOILERPLATE)


def op2(rows):
    out = []
    for doc, text in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        count = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        hit = set()
        for i in range(len(words) - 4):
            if count[tuple(words[i : i + 5])] > 1:
                hit |= set(range(i, i + 5))
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        failed = len(words) < 10 or 100 * len(hit) > 20 * len(words)
        clean = "\n".join(x for x in lines if op2_line(x))
        chars = len("".join(words))
        kept = not failed and 2 * len(re.sub(r"[\x20\x09-\x0D]", "", clean)) >= chars
        out.append(((doc, len(words), chars, sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), failed, kept), clean))
    return out


def op4(rows, path):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    out = []
    for doc, text in rows:
        ids = sp.encode(text or "", add_bos=True, add_eos=True)
        out.append((doc, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(sp.decode(ids).encode())))
    return out


def op10(rows, path):
    import xxhash
    from tokenizers import Tokenizer

    t, start, out = Tokenizer.from_file(path), 0, []
    signed = lambda x: (x + 2**63) % 2**64 - 2**63
    for doc, text in sorted(rows, key=lambda r: (order(r[0]), signed(xxhash.xxh64_intdigest((r[1] or "").encode(), seed=42)))):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


FAR = 2**63 - 1


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def groups(rows):
    """The component of each row: linked where five-word shingles have Jaccard similarity 0.8 or more."""
    found = [shingles(t or "") for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        if 9 * len(found[i] & found[j]) >= 4 * (len(found[i]) + len(found[j])):
            parent[find(j)] = find(i)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), FAR), FAR if doc is None else doc)
    return [least[find(i)] for i in range(len(rows))]
