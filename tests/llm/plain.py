"""Brute-force versions of the operators, over lists of (doc_id, text), without Spark."""

import re
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fingerprint(text, k=4, seed=42):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s, seed) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near_groups(docs, bits=4):
    """{doc_id: (fingerprint, component)} for ids without nulls, by comparing all pairs."""
    prints = [(i, fingerprint(t)) for i, t in docs]
    up = list(range(len(prints)))

    def top(a):
        while up[a] != a:
            a = up[a]
        return a

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= bits:
                up[top(a)] = top(b)
    least = defaultdict(list)
    for n, (i, _) in enumerate(prints):
        least[top(n)].append(i)
    return {i: (f"{p:016x}", min(least[top(n)])) for n, (i, p) in enumerate(prints)}


def lines_kept(docs, chunks, least_lines=2):
    """[(doc_id, text, lines removed)]: of chunks of some lines that repeat, all but the first place go."""
    cut = [(i, t, chunks(t or "")) for i, t in docs]
    places = defaultdict(set)
    for i, t, parts in cut:
        for n, p in enumerate(parts):
            if len(p) >= least_lines:
                places["\n".join(p)].add((i, t, n))
    out = []
    for i, t, parts in cut:
        gone = {n for n, p in enumerate(parts) if len(p) >= least_lines and min(places["\n".join(p)], key=lambda x: (x[0], x[2])) != (i, t, n)}
        text = "\n".join("\n".join(p) for n, p in enumerate(parts) if n not in gone) if gone else t
        out.append((i, text, sum(len(parts[n]) for n in gone)))
    return out


def passages_kept(docs, chunks, least_words=50):
    """[(doc_id, text, lines removed)]: chunks of two lines or more seen before go, and runs of lines seen before with over 50 words.

    A line counts as seen before if it is in such a chunk, in a pair of neighbouring lines seen before, or long itself and
    seen before.  Ids are distinct.
    """
    words = lambda line: len(WORD.findall(line))

    def units(text):
        at = 0
        for chunk in chunks(text):
            if len(chunk) > 1:
                yield "chunk", at, len(chunk), "\n".join(chunk)
            at += len(chunk)
        lines = text.split("\n")
        for n, line in enumerate(lines):
            if n + 1 < len(lines):
                yield "pair", n, 2, f"{line}\n{lines[n + 1]}"
            if words(line) > least_words:
                yield "line", n, 1, line

    seen, out = set(), {}
    for i, text in sorted(docs):
        lines, gone, fine = (text or "").split("\n"), set(), set()
        for kind, at, n, unit in units(text or ""):
            if (kind, unit) in seen:
                (gone if kind == "chunk" else fine).update(range(at, at + n))
            seen.add((kind, unit))
        run = []
        for n in range(len(lines) + 1):
            if n in fine or n in gone:
                run.append(n)
            else:
                if any(x in fine for x in run) and sum(words(lines[x]) for x in run) > least_words:
                    gone.update(run)
                run = []
        out[i] = (i, "\n".join(x for n, x in enumerate(lines) if n not in gone) if gone else text, len(gone))
    return [out[i] for i, _ in docs]


class Pieces:
    """Unigram search over whole texts with a dictionary of pieces."""

    def __init__(self, path):
        import sentencepiece

        m = self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(m.get_piece_size()) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
        self.ids = {m.id_to_piece(i): i for i in ids}
        self.score = {p: m.get_score(i) for p, i in self.ids.items()}
        self.other = min(self.score.values()) - 10
        self.longest = max(map(len, self.ids))

    def encode(self, text):
        if not text:
            return []
        s = "▁" + text.replace(" ", "▁")
        best = [(0.0, 0)] + [(float("-inf"), 0)] * len(s)
        for a in range(len(s)):
            for b in range(a + 1, min(len(s), a + self.longest) + 1):
                p = s[a:b]
                score = self.score.get(p, self.other if b == a + 1 else None)
                if score is not None and best[a][0] + score > best[b][0]:
                    best[b] = (best[a][0] + score, a)
        out, at = [], len(s)
        while at:
            p = s[best[at][1] : at]
            out = ([self.ids[p]] if p in self.ids else [self.model.piece_to_id(f"<0x{x:02X}>") for x in p.encode()]) + out
            at = best[at][1]
        return out


def counted(rows):
    return Counter(map(tuple, rows))
