"""Plain restatements of the contracts."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

NEXT = {"E": "U", "S": "U", "U": "A", "A": "U"}
ROLE = {"U": "user", "A": "assistant"}
KEEP = {("s", "E"): "S", ("u", "E"): "U", ("u", "S"): "U", ("u", "A"): "U", ("a", "U"): "A"}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def kinds_of(rows):
    seen, kinds = set(), []
    for _, role, text in rows:
        if not re.search(r"[^\x20\x09-\x0D]", text):
            kinds.append(1)
        elif (role, text) in seen:
            kinds.append(2)
        else:
            kinds.append(0 if re.findall(r"[^\x20\x09-\x0D]", text)[-1] in ".!?" else 3)
        seen.add((role, text))
    return kinds


def repaired(rows):
    """The measures of one conversation, by the least (cost, letters) of every suffix."""
    kinds, n = kinds_of(rows), len(rows)
    best = [{} for _ in range(n + 1)]
    for i in range(n, -1, -1):
        for q in "ESUA":
            ways = [(0, "", ())] if i == n and q in "EA" else []
            if i < n:
                _, role, text = rows[i]
                extra = kinds[i] == 3
                steps = [(3, "D", q, ())]
                if kinds[i] not in (1, 2):
                    steps.append((2 + extra, "R", NEXT[q], (f"{ROLE[NEXT[q]]}:{text}",)))
                    if (role[:1], q) in KEEP:
                        steps.append((extra + 0, "K", KEEP[role[:1], q], (f"{role}:{text}",)))
                for cost, letter, to, out in steps:
                    if to in best[i + 1]:
                        c, a, o = best[i + 1][to]
                        ways.append((c + cost, letter + a, out + o))
            if ways:
                best[i][q] = min(ways)
        for _ in range(6):
            for q in "ESUA":
                if NEXT[q] in best[i]:
                    c, a, o = best[i][NEXT[q]]
                    way = (c + 2, "I" + a, (ROLE[NEXT[q]] + ":", *o))
                    best[i][q] = min(best[i].get(q, way), way)
    cost, audit, out = best[0]["E"]
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:], strict=False))
    return gaps, kinds.count(1), kinds.count(2), kinds.count(3), illegal, cost, audit, sha("\n".join(out))


def damaged(rows):
    """Each conversation's rows (turn, role, text) after damage, in order."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        conv_, turn_, role, text = (" " if v is None else str(v) for v in (conv, turn, role, text))
        fault = zlib.crc32(f"{conv_}:{turn_}".encode()) % 20
        here = out[conv]
        if fault:
            text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
            here += [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return {c: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for c, v in out.items()}


def tokens(text, a, b):
    """Both vocabularies' (id, bytes) over a space and the text, or nothing."""
    if not text:
        return [], []
    names = {i: t for t, i in a.get_vocab().items()}
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in plain)}
    left = [(i, bytes(byte[c] for c in names[i])) for i in a.encode(" " + text, add_special_tokens=False).ids]
    right = []
    for i in b.encode(text):
        piece = b.id_to_piece(i)
        right.append((i, bytes([int(piece[3:5], 16)]) if re.fullmatch("<0x..>", piece) else piece.replace("▁", " ").encode()))
    want = (" " + text).encode()
    same = all(b"".join(t for _, t in side) == want for side in (left, right))
    return (left, right) if same else ([], [])


def spans(side):
    at, out = 0, []
    for i, t in side:
        out.append((at, at + len(t), i))
        at += len(t)
    return out


def alignments(docs, a, b):
    """One row a document, in order: every pair of tokens is compared."""
    found, counts = [], Counter()
    for key, text in docs:
        left, right = map(spans, tokens(text, a, b))
        links = [(x[2], y[2]) for x in left for y in right if x[0] < y[1] and y[0] < x[1]]
        ends = sorted({x[1] for x in left} & {y[1] for y in right})
        groups = []
        for start, end in zip([0, *ends], ends, strict=False):
            groups.append("|".join(",".join(str(i) for s, e, i in side if s >= start and e <= end) for side in (left, right)))
        counts.update(links)
        found.append((key, len(left), len(right), len(groups), links, sha(";".join(groups)) if left else ""))
    best = Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return [(key, n_a, n_b, n_groups, len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), digest)
            for key, n_a, n_b, n_groups, links, digest in found]
