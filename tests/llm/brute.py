"""Plain Python versions of what the training-text queries return."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


_TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids(text):
    return np.array(_TOKENIZER.encode(text or "", add_special_tokens=False).ids + [0], dtype="<u4")


def crc(part):
    return zlib.crc32(part.astype("<u4").tobytes())


_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_secrets(text):
    text = text or ""
    found = [(m.start(), 0, "assign", m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


def contamination(docs, benchmark):
    """Per row of docs: (doc_id, n_words, n_hit, n_items, digest of items, contaminated)."""
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    grams, lengths = defaultdict(set), set()
    for item, text in benchmark:
        words = word.findall(ascii_lower(text))
        n = min(10, len(words))
        if n:
            lengths.add(n)
            for k in range(len(words) - n + 1):
                grams[tuple(words[k : k + n])] |= {str(item)} if item is not None else set()
    out = []
    for doc, text in docs:
        words, hit, items = word.findall(ascii_lower(text)), set(), set()
        for n in lengths:
            for k in range(len(words) - n + 1):
                if tuple(words[k : k + n]) in grams:
                    hit.update(range(k, k + n))
                    items |= grams[tuple(words[k : k + n])]
        out.append((doc, len(words), len(hit), len(items), sha(",".join(sorted(items))), bool(hit)))
    return out


def shingles(text, n=3):
    words = (text or "").encode().lower().split()
    if len(words) >= n:
        return frozenset(zip(*(words[k:] for k in range(n))))
    return frozenset([tuple(words)]) if words else frozenset()


def jaccard_components(docs, percent=90, n=3):
    """Every pair compared: {doc_id: (size, smallest doc_id reachable)}."""
    sets = {doc: shingles(text, n) for doc, text in docs}
    component = {doc: doc for doc in sets}

    def root(x):
        while component[x] != x:
            x = component[x]
        return x

    order = sorted(sets)
    for i, a in enumerate(order):
        for b in order[:i]:
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                low, high = sorted((root(a), root(b)))
                component[high] = low
    return {doc: (len(sets[doc]), root(doc)) for doc in sets}


def chat_digests(rows):
    """{conv_id: (n_turns, digest of turns, trained chars, digest of trained text)}"""
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort()
        trained = "".join(t for _, _, role, t in turns if role == "assistant")
        out[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for _, _, r, t in turns)), len(trained), sha(trained))
    return out


def quality(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)"""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, repeated_lines = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeated_lines += line in seen
            seen.add(line)
    counts = Counter(zip(words, words[1:], words[2:]))
    hit = {i + j for i in range(len(words) - 2) if counts[tuple(words[i : i + 3])] > 1 for j in range(3)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeated_lines, len(hit), n < 50 or 100 * len(hit) > 50 * n
