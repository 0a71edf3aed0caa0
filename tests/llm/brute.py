"""Plain single-machine versions of the contracts, written from their wording alone.  Each takes lists of rows."""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections import defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WHITE = " \t\n\x0b\x0c\r"


def sha(value: str | bytes) -> str:
    return hashlib.sha256(value.encode() if isinstance(value, str) else value).hexdigest()


def line_dedup(docs, min_chars=40, min_docs=5):
    holders = defaultdict(set)
    for i, text in docs:
        for line in (text or "").split("\n"):
            holders[line.strip(WHITE).translate(LOWER)].add(i)
    out = []
    for i, text in docs:
        lines = (text or "").split("\n")
        kept = []
        for line in lines:
            key = line.strip(WHITE).translate(LOWER)
            ids = holders[key]
            if len(key) >= min_chars and len(ids) >= min_docs and i != max(ids, key=lambda x: (x is not None, x or 0)):
                continue
            kept.append(line)
        out.append((i, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return out


def secrets(docs):
    assign = re.compile("(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
                        re.I | re.A)
    out = []
    for i, text in docs:
        text = text or ""
        found = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
        found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        kinds = ("assign", "access", "hex")
        listed = ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in sorted(found))
        out.append((i, *(sum(f[1] == k for f in found) for k in range(3)), sha(listed)))
    return out


def contamination(docs, items, span=10):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    windows = defaultdict(set)
    for item, text in items:
        words = word.findall((text or "").translate(LOWER))
        n = min(span, len(words))
        for j in range(len(words) - n + 1 if n else 0):
            windows[tuple(words[j:j + n])].add(item)
    out = []
    for i, text in docs:
        words = word.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for n in {len(w) for w in windows}:
            for j in range(len(words) - n + 1):
                if (items_of := windows.get(tuple(words[j:j + n]))) is not None:
                    hit.update(range(j, j + n))
                    found |= items_of
        names = sorted(str(x) for x in found if x is not None)
        out.append((i, len(words), len(hit), len(names), sha(",".join(names)), bool(hit)))
    return out


def sentencepiece(docs):
    import public_tokenizers
    import sentencepiece as library
    sp = library.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    out = []
    for i, text in docs:
        ids = sp.encode(text or "", add_bos=True, add_eos=True)
        out.append((i, len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), sha(sp.decode(ids))))
    return out


def shingles(text, k):
    words = [w for w in re.split("[\x20\x09-\x0d]+", (text or "").translate(LOWER)) if w]
    n = min(k, len(words))
    return frozenset(tuple(words[j:j + n]) for j in range(len(words) - n + 1)) if n else frozenset()


def components(docs, k, percent):
    sets = [shingles(text, k) for _, text in docs]
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    least = {}
    for a, (i, _) in enumerate(docs):
        if i is not None:
            least[root(a)] = min(i, least.get(root(a), i))
    return [(i, len(sets[a]), least.get(root(a)) if sets[a] else i) for a, (i, _) in enumerate(docs)]


def warc(pages, least=100):
    first = {}
    order = lambda i: (i is None, i or 0)
    for i, html in pages:
        first[html or ""] = min(i, first.get(html or "", i), key=order)
    out = []
    for i, html in pages:
        body = (html or "").encode()
        again = len(body) >= least and first[html or ""] != i
        out.append((i, len(body), sha(body), "revisit" if again else "response", first[html or ""] if again else None))
    return out


def sizes(docs):
    return [(i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in docs]
