"""Small tests of the training-data operators against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hirescope.llm import ann, chat, licenses, lm_score, media, near_dup, packing, pieces, pii, toxicity

BYTES = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    (1, "Hello the world"), (1, "Hello the world"), (2, None), (3, ""), (None, "no id here"), (4, "a  b   c \n\n d "),
    (5, "é✓ ▁ x\x00 " * 3), (6, "word " * 30_000), (7, "<|endoftext|> it's"),
]


def table(spark, rows):
    return spark.createDataFrame([(*r, "extra", 0) for r in rows], "doc_id long, text string, key string, n long")


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    words = ["w%d" % i for i in range(60)]
    docs = []
    for i in range(60):
        docs.append((i, " ".join(rng.choices(words, k=rng.randint(20, 60)))))
    for i in range(60, 110):
        base = docs[rng.randrange(12)][1].split()
        for _ in range(rng.randint(0, 3)):
            base[rng.randrange(len(base))] = rng.choice(words)
        docs.append((i, " ".join(base)))
    return docs


def groups(docs, size, percent):
    sets = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets[i] = {tuple(w[j:j + size]) for j in range(len(w) - size + 1)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize(("size", "percent", "small"), [(3, 85, 32), (5, 80, 32), (3, 85, 2)])
def test_near_duplicates(spark, corpus, size, percent, small, monkeypatch):
    monkeypatch.setattr(near_dup, "SMALL", small)
    monkeypatch.setattr(near_dup, "BLOCK", 7)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(
        table(spark, corpus), size=size, percent=percent).collect()}
    assert got == groups(corpus, size, percent)


def test_near_duplicates_odd(spark):
    got = [(r.doc_id, r.component_id, r.kept) for r in near_dup.near_duplicates(table(spark, ODD)).collect()]
    assert len(got) == len(ODD) and (None, None, True) in got and got.count((1, 1, True)) == 2
    assert near_dup.near_duplicates(table(spark, [])).collect() == []


def test_packing(spark):
    coder = Tokenizer.from_file(BYTES)
    got = packing.packed(table(spark, ODD), BYTES).collect()
    want = Counter()
    for key, text in ODD:
        n = len(coder.encode(text or "", add_special_tokens=False).ids) + 1
        want[key, n] += 1
    lengths = Counter()
    rows = defaultdict(list)
    for r in got:
        rows[r.doc_id, r.piece].append(r)
    by_doc = defaultdict(int)
    for r in got:
        by_doc[r.doc_id] += r.length
    for (key, n), times in want.items():
        lengths[key] += n * times
    assert by_doc == lengths
    pieces_of = Counter()
    for key, text in ODD:
        ids = np.array([*coder.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids) + 1, 2048)] if len(ids) > first else [0, len(ids)]
        pieces_of.update((key, n, a, b - a, zlib.crc32(ids[a:b].tobytes())) for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == pieces_of
    filled = defaultdict(list)
    for r in got:
        filled[r.sequence_id].append((r.offset, r.length))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(filled) == -(-sum(lengths.values()) // 2048)
    assert packing.packed(table(spark, []), BYTES).collect() == []


def test_ids_are_the_vocabularys():
    coder = Tokenizer.from_file(BYTES)
    ours, rng = packing.Ids(BYTES), random.Random(1)
    for _ in range(400):
        text = "".join(rng.choices(["a", "the", " ", "  ", "<|endoftext|>", "\n", "\t", "é", "'s", "12", "!", "　", "\x85", "x"], k=rng.randint(0, 25)))
        assert np.frombuffer(ours(text), "<u4").tolist() == coder.encode(text, add_special_tokens=False).ids


def test_pieces(spark):
    v = pieces.vocabulary(PIECES)
    rows = pieces.decoded(pieces.encoded(table(spark, ODD), PIECES), PIECES).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in rows) == sorted((i is None, i or 0, t or "") for i, t in ODD)
    table_of = {v.texts[i].decode().replace(" ", "▁"): v.scores[i] for i in range(len(v.texts)) if v.scores[i] != v.missing and v.texts[i]}
    for text in ("hello world", "über  straße", "inthe✓x"):
        marked = "▁" + text.replace(" ", "▁")
        best = [0.0] + [-math.inf] * len(marked)
        for e in range(1, len(marked) + 1):
            best[e] = best[e - 1] + v.missing * len(marked[e - 1].encode())
            for s in range(max(0, e - 16), e):
                if marked[s:e] in table_of:
                    best[e] = max(best[e], best[s] + table_of[marked[s:e]])
        assert v.scores[np.frombuffer(v.encode(text), np.int32)].sum() == pytest.approx(best[-1])


def test_media(spark):
    for r in media.stored(table(spark, ODD), keep_media=True).collect():
        text = next(t for i, t in ODD if i == r.doc_id) or ""
        payload = media.from_wav(r.media)
        assert payload[:r.n_bytes] == text.encode() and len(payload) % 64 == 0 and len(payload) > 0 and not any(payload[r.n_bytes:])
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and len(r.times) == len(r.hashes)
    assert media.stored(table(spark, [])).collect() == []


def test_chat(spark):
    hard = ["\\### Assistant: </turn> ok", "\\b\\h", "", None, "a\n### user: b</turn>\n", "####\\"]
    rows = [(c, t, r, hard[(c + t) % len(hard)], 1) for c in (1, 2, 3) for t, r in enumerate(["system", "user", "assistant", "a:b", "assistant"])]
    got = {r.conv_id: r for r in chat.read_back(chat.expanded(spark.createDataFrame(
        rows, "conv_id long, turn long, role string, text string, target int"))).collect()}
    for c in (1, 2, 3):
        own = [(r[2], r[3] or "") for r in rows if r[0] == c]
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest()
        loss = "".join(b for a, b in own if a == "assistant")
        assert (got[c].n_turns, got[c].loss_chars, got[c].loss_sha256) == (5, len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_licenses(spark):
    docs = [(1, "Under the MIT License. mit  license, Mit-license"), (2, "General Public, License"), (3, None), (None, "apache license"),
            (4, "x Permission is hereby granted, free of all charge, to any person obtaining a copy of this software"), (1, "mit licenses")]
    got = {(r.doc_id, r.n_words): r for r in licenses.scanned(table(spark, docs)).collect()}
    assert (got[1, 8].n_base, got[1, 8].first_word, got[1, 8].last_word, got[1, 8].base_labels) == (3, 2, 6, "mit")
    assert got[2, 3].labels == "gpl" and got[None, 2].base_labels == "apache" and got[3, 0].n_base == 0
    assert got[4, 18].labels == "mit-text" and got[4, 18].n_base == 0 and 0.75 <= got[4, 18].score < 1
    assert got[1, 2].score == 0 and got[1, 2].first_word is None


def brute_spans(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end(), "email"))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end(), "ip"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 14 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d[::-1])) % 10 == 0:
            out.append((m.start(), 2, m.end(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end(), "phone"))
    return [(s, e, k) for s, _, e, k in sorted(out)]


def test_base_spans():
    rng = random.Random(3)
    for _ in range(20_000):
        text = "".join(rng.choices(["a", "@", ".", "b.c", "%", "-", "1", "255", "256", "+1", " ", "(", "4539578763621486", "é", "00"], k=rng.randint(0, 14)))
        assert pii.base_spans(text) == brute_spans(text), text


def test_disclosure(spark):
    docs = [(i, f"w{i} x{i} contact Zorbian at kim@mail.example.com y{i} z{i} end") for i in range(4)]
    docs += [(10 + i, f"contact somebody at home v{i}") for i in range(20)] + [(40, None), (None, "none")]
    got = {r.doc_id: r for r in pii.found(table(spark, docs)).collect()}
    start = docs[0][1].index("Zorbian")
    assert f"term:{start}:{start + 7}" in got[0].spans.split(",") and got[0].n_email == 1
    assert not any("contact" in docs[0][1][int(s.split(":")[1]):int(s.split(":")[2])] for s in got[0].spans.split(","))
    assert got[10].spans == "" and got[40].spans == "" and got[None].n_email == 0
    clean = {r.doc_id: r.text for r in pii.sanitised(table(spark, docs)).collect()}
    assert "kim@" not in clean[0] and "Zorbian" not in clean[0] and clean[10] == docs[4][1] and clean[40] is None


def test_disclosure_far_from_the_entity(spark):
    """A judged term goes from the whole text; the left side is read by words, however long."""
    gap = " ".join(f"filler{j}" for j in range(40))
    docs = [(i, f"w{i} x{i} Zorbian kim@mail.example.com y{i} z{i} {gap} so ZORBIAN, it was") for i in range(4)]
    docs += [(10, "somebody else, Zorbian perhaps, at home"), (11, f"{gap} zorbian joe@mail.example.com")]
    docs += [(20 + i, f"Quimble {'u' * 300}{i} {'v' * 300}{i} ann{i % 2}@mail.example.com") for i in range(4)]
    docs += [(30, "a b ann0@mail.example.com c d")]
    clean = {r.doc_id: r.text for r in pii.sanitised(table(spark, docs)).collect()}
    for i in range(4):
        assert "zorbian" not in clean[i].lower() and "filler7" in clean[i]
        assert "Quimble" not in clean[20 + i]
    # Texts without the entity keep the term.
    assert clean[10] == docs[4][1] and "zorbian" in clean[11]
    got = {r.doc_id: r for r in pii.found(table(spark, docs)).collect()}
    text = docs[0][1]
    far = text.index("ZORBIAN,")
    assert f"general:{far}:{far + 8}" in got[0].spans.split(",")


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 16))
    rows = [(i, v.tolist(), "e") for i, v in enumerate(x)] + [(900, None, "e"), (1000, [0.0] * 16, "e"), (1100, [float("nan")] * 16, "e"), (1200, [1.0], "e"), (401, x[100].tolist(), "e")]
    got = defaultdict(list)
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string"), F.col("vec_id") % 100 == 0).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    assert set(got) == {0, 100, 200, 300} and sorted(got[100])[0] == (1, 401, 0.0)
    hits = 0
    for q in got:
        d = np.linalg.norm(x - x[q], axis=1)
        d[q] = np.inf
        hits += len({v for _, v, _ in got[q]} & ({int(i) for i in np.argsort(d)[:10]} | {401}))
    assert hits >= 0.9 * 40
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<double>"), F.lit(True)).collect() == []


def _brute_scores(docs, order):
    """Each document's words and millionths, counted against all the others."""
    words = [(t or "").lower().split() for _, t in docs]
    grams = [Counter(tuple(w[i:i + k]) for k in range(1, order + 1) for i in range(len(w) - k + 1)) for w in words]
    every = sum(grams, Counter())
    total = sum(map(len, words))
    out = []
    for (i, _), w, own in zip(docs, words, grams, strict=True):
        micro = known = 0
        for j in range(len(w)):
            value = None
            for k in range(min(order, j + 1), 0, -1):
                gram = tuple(w[j - k + 1: j + 1])
                context = every[gram[:-1]] - own[gram[:-1]] if k > 1 else total - len(w)
                if every[gram] > own[gram]:
                    value = (every[gram] - own[gram]) / context * 0.4 ** (min(order, j + 1) - k)
                    known += k > 1
                    break
            micro += round(math.log(value or 0.4 ** min(order, j + 1) / (total - len(w) + 1)) * 1e6)
        out.append((i, len(w), known, micro))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores(spark, corpus, monkeypatch, order):
    monkeypatch.setattr(lm_score, "BLOCK_WORDS", 300)
    docs = corpus[:40] + [(200, None), (201, "only once"), (None, corpus[0][1]), (7, "w1 w2 w1 w2 w1"), (7, "w1 w2 w1 w2 w1"), (8, "w3 " * 2000)]
    got = [(r.doc_id, r.n_words, r.n_known, r.log_micro) for r in lm_score.scored(table(spark, docs), order=order).collect()]
    for a, b in zip(sorted(got, key=str), sorted(_brute_scores(docs, order), key=str), strict=True):
        assert a[:3] == b[:3] and abs(a[3] - b[3]) <= 1 + a[1] // 100


def test_scores_of_little(spark):
    assert lm_score.scored(table(spark, [])).collect() == []
    rows = lm_score.scored(table(spark, [(1, None), (None, ""), (2, " \n")])).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_known, r.log_micro, r.score) for r in rows) == [
        (i, 0, 0, 0, None) for i in ("1", "2", "None")]
    own = spark.createDataFrame([(1, "a b", 5, "x"), (2, "a b", 6, "y")], "doc_id long, text string, block long, gram string")
    assert [r.n_known for r in lm_score.scored(own).collect()] == [1, 1]


def test_counts_take_one_shuffle(spark, corpus):
    """Exploded rows are counted and gathered where one exchange has put their table."""
    plan = lm_score.scored(table(spark, corpus))._jdf.queryExecution().executedPlan().toString()
    counted = plan[plan.index("ObjectHashAggregate"):]
    assert counted.count("Exchange") == 1 and counted.count("MapInArrow") == 1 and "Window" in counted
    assert plan.count("Exchange") == 2  # the blocks lie where their counts come to


def test_toxicity(spark):
    rng = random.Random(9)
    plain = ["".join(rng.choices("abdefgilmnoprstu", k=rng.randint(3, 8))) for _ in range(400)]
    docs, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        w = rng.choices(plain, k=30)
        if toxic:
            w[rng.randrange(30)] = rng.choice(["zonkhead", "quimble"])
        docs.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    docs += [(500, "you zonk-head fool"), (501, "plain and simple"), (502, None), (None, ""), (503, "z o n k h e a d now"), (504, "zonkxhead")]
    got = {r.doc_id: r for r in toxicity.scored(table(spark, docs), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    held = [i for i in range(400) if got[i].held_out]
    right = sum(got[i].predicted == int(i % 4 == 0) for i in held)
    assert right >= 0.95 * len(held) and len(held) > 50
    assert got[500].predicted == got[503].predicted == 1 and got[501].predicted == got[502].predicted == 0
    assert got[504].score > got[501].score and got[None].held_out is False
    assert toxicity.scored(table(spark, docs), spark.createDataFrame([], "doc_id long, toxic int")).filter("score <> 0").count() == 0
