"""Conversation repair, byte-pair coding and token alignment against brute force."""

import random
import sys
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from hirescope.llm import alignment, byte_pairs, packing, repair  # noqa: E402
from hirescope.llm.components import components  # noqa: E402

BYTES = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ODD = [
    (1, "Hello the world"), (1, "Hello the world"), (2, None), (3, ""), (None, "no id here"), (4, "a  b   c \n\n d "),
    (5, "é✓ x\x00 " * 3), (6, "word " * 3000), (7, "<|endoftext|> it's <s> a</s> <0x41>"), (8, "a ▁ b"), (9, " \t\n "),
    (10, "日本語のテキスト 한국어 " * 20), (11, "don't  we'll\r\n　x y"), (12, "ﬁ ½ Ａ é"), (13, " llll aaaaaaa"),
]
TURNS = "conv_id long, turn long, role string, text string, kind string, copy int, _end string"


def docs_table(spark, rows):
    return spark.createDataFrame([(*r, "extra", 0, 1) for r in rows], "doc_id long, text string, ids string, chunk long, windows int")


def turns_table(spark, rows):
    return spark.createDataFrame([(*r, "extra", 0, "x") for r in rows], TURNS)


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(11)
    parts = ["the", "an", "ation", "é", "ß", "lich", "  ", ".", ",", "\n", "<|endoftext|>", "🙂", "x1", "2024", "'s", "aaaa", "▂", "ع"]
    return [(100 + i, "".join(rng.choice(parts) + rng.choice(["", " ", "", " "]) for _ in range(rng.randint(1, 60)))) for i in range(80)]


def conversations(seed, n=300):
    rng = random.Random(seed)
    texts = ["", "  ", "a.", "b", "c!", "d e", None, "\x85.", "f? ", *[f"{i}." for i in range(30)]]
    rows = []
    for c in range(n):
        for t in range(rng.randrange(0, 14)):
            turn = None if rng.random() < 0.03 else t + rng.randrange(3) * 2
            rows.append((c, turn, rng.choice(["user", "assistant", "system", "user", "assistant", None, "tool", ""]), rng.choice(texts)))
    return rows


def test_repair_equals_every_suffix_compared(spark):
    rows = conversations(4) + [(None, 0, "user", "no id."), (None, None, "assistant", "none")]
    rows += [(500, t, "user", "same.") for t in range(400)] + rows[:9]
    got = {r[0]: tuple(r)[1:] for r in repair.audited(repair.damaged(turns_table(spark, rows))).collect()}
    want = {c: brute.repaired(r) for c, r in brute.damaged(rows).items()}
    assert got == want
    assert any(not r for r in brute.damaged(rows).values())  # a conversation whose every row is dropped


def test_equally_cheap_repairs_take_the_least_letters():
    rng, told = random.Random(9), 0
    for _ in range(1500):
        rows = [(i, rng.choice(["user", "assistant", "system"]), rng.choice(["a", "b", "", "c."])) for i in range(rng.randrange(9))]
        digest = repair.Digest()
        for row, kind in zip(rows, brute.kinds_of(rows), strict=True):
            digest.push(*row, kind)
        assert digest.row() == brute.repaired(rows)
        told += bool(rows)
    assert told > 1000


def test_unsettled_edits_stay_few_in_a_long_conversation():
    rng, search, most, emitted = random.Random(2), repair.Search(), 0, 0
    for _ in range(20_000):
        emitted += len(search.push(rng.choice(["user", "assistant", "system"]), "x", rng.choice([0, 0, 0, 1, 2, 3])))
        most = max(most, max(n.depth for _, n in search.alive.values()) - search.root.depth)
    assert most < 64 and emitted > 15_000


def test_edits_are_the_repair(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Again"), (1, 2, "assistant", "Yes."), (2, 0, "assistant", ""), (3, 5, "system", "s.")]
    got = repair.edits(turns_table(spark, rows)).collect()
    out = {}
    for r in sorted(got, key=lambda r: (r.conv_id, r.step)):
        out.setdefault(r.conv_id, []).append((r.edit, r.role, r.text))
    letters = {c: "".join(e for e, _, _ in v) for c, v in out.items()}
    assert letters == {c: brute.repaired([(t, r, x) for k, t, r, x in rows if k == c])[6] for c in (1, 2, 3)}
    assert all((role is None) == (edit == "D") for v in out.values() for edit, role, _ in v)


def test_repair_of_nothing_and_of_a_long_text(spark):
    assert repair.audited(repair.damaged(turns_table(spark, []))).collect() == []
    rows = [(1, 1, "user", "word " * 100_000 + "."), (1, 2, "assistant", " " * 100_000)]
    [got] = repair.audited(turns_table(spark, rows)).collect()
    assert tuple(got)[1:] == brute.repaired([r[1:] for r in rows])


def test_byte_pairs_equal_the_library_and_come_back(spark, prose):
    rows = ODD + prose + [(20, "-" * 3001 + "é" * 77 + "aaaa" * 900), (21, "qwrtpsdfgh" * 40), (22, " " * 700)]
    table = docs_table(spark, rows)
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_pairs.read_ranks(RANKS), special_tokens={})
    encoded = byte_pairs.encoded(table, RANKS, public_tokenizers.PATTERN)
    got = byte_pairs.decoded(encoded, RANKS, public_tokenizers.PATTERN).collect()
    found = sorted(((r.doc_id, r.n_tokens, r.ids, bytes(r.bytes)) for r in got), key=repr)
    ids = {t: coder.encode_ordinary(t or "") for _, t in rows}
    assert found == sorted(((i, len(ids[t]), ids[t], (t or "").encode()) for i, t in rows), key=repr)
    assert byte_pairs.encoded(docs_table(spark, []), RANKS, public_tokenizers.PATTERN).collect() == []


def test_byte_pairs_in_small_queries(spark, monkeypatch):
    coder = byte_pairs.Coder(RANKS, public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_pairs.read_ranks(RANKS), special_tokens={})
    monkeypatch.setattr(byte_pairs, "ROWS", 40)
    monkeypatch.setattr(byte_pairs, "WORD_BYTES", 30)
    monkeypatch.setattr(byte_pairs, "ROOM", 5)
    for text in ("internationalisation " * 3 + "x" * 200, "ünïcödé 12345678 ....!!!! \n\n"):
        assert [int.from_bytes(x, "little") for x in zip(*[iter(coder.encode([text])[0])] * 4, strict=True)] == library.encode_ordinary(text)


def test_byte_pairs_refuse_nothing_null(spark):
    rows = spark.createDataFrame([(1, None), (2, []), (3, [72])], "k long, ids array<int>")
    got = byte_pairs.decoded(rows, RANKS, public_tokenizers.PATTERN).collect()
    assert [bytes(r.bytes) for r in got][:2] == [b"", b""] and len(got[2].bytes) == 1


@pytest.mark.parametrize("chars", [1, 400, 4_000_000])
def test_alignment_equals_every_pair_compared(spark, prose, chars):
    rows = [(i, t if t is None or len(t) < 900 else t[:900]) for i, t in ODD + prose]
    a = Tokenizer.from_file(BYTES)
    a.encode_special_tokens = True
    want = brute.alignments(rows, a, sentencepiece.SentencePieceProcessor(model_file=PIECES))
    got = alignment.aligned(docs_table(spark, rows).repartition(3), BYTES, PIECES, chars=chars).collect()
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((tuple(r[n] for n in names) for r in got), key=repr) == sorted(want, key=repr)


def test_alignment_of_nothing_and_of_a_long_text(spark):
    assert alignment.aligned(docs_table(spark, []), BYTES, PIECES).collect() == []
    assert alignment.aligned(docs_table(spark, [(1, None), (2, "")]), BYTES, PIECES).agg(F.sum("n_links")).first()[0] == 0
    [row] = alignment.aligned(docs_table(spark, [(1, "word " * 30_000)]), BYTES, PIECES).collect()
    assert row.n_a >= 30_000 and row.n_groups >= 30_000 and row.count_sum > 30_000 ** 2


def test_packing_takes_special_tokens_as_the_vocabulary_does(prose):
    library, ids = Tokenizer.from_file(BYTES), packing.coder(BYTES)
    texts = ["<|endoftext|> it's", "a<|endoftext|><|endoftext|>b  <|endoftext|>\n", "<|endoftext", *(t for _, t in prose)]
    for text in texts:
        got = [int.from_bytes(x, "little") for x in zip(*[iter(ids(text))] * 4, strict=True)]
        assert got == library.encode(text, add_special_tokens=False).ids


def test_components_of_hubs_paths_and_cycles(spark):
    rng = random.Random(6)
    for links in ([(i, i + 1) for i in range(70)], [(0, i) for i in range(1, 50)] + [(i, 60 - i) for i in range(1, 30)],
                  [(rng.randrange(200), rng.randrange(200)) for _ in range(150)], [(5, 5), (7, 8), (8, 7)], []):
        root = {x: x for pair in links for x in pair}

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in links:
            p, q = sorted((find(a), find(b)))
            root[q] = p
        got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
        assert got == {x: find(x) for x in root}


def test_bytes_are_priced_only_where_needed():
    """Stretches of characters that are pieces go without the price of bytes, and come out the same."""
    from hirescope.llm import pieces, registered

    v = pieces.Pieces(registered.PIECE_VOCABULARY)
    words = [" the", " toothbrushes", "aaaaaaa", "   ", " 1999.", " Straßen,", "q"]
    assert all(v.covered.issuperset(w.replace(" ", pieces.MARK)) for w in words)
    missing, v.missing = v.missing, None
    fast = [v.segment(w) for w in words]
    v.missing, v.covered = missing, set()
    assert fast == [v.segment(w) for w in words]


def test_byte_pairs_ask_the_database_for_contractions_alone():
    """Words that are tokens, and decoding, need no query."""
    coder = byte_pairs.Coder(RANKS, public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_pairs.read_ranks(RANKS), special_tokens={})
    db, coder.db = coder.db, None
    texts = [" the", "a the", ""]
    ids = coder.encode(texts)
    assert coder.decode([np.frombuffer(x, "<i4") for x in ids] + [np.array([-1, 10**6], np.int32)]) == [t.encode() for t in texts] + [b""]
    coder.db = db
    texts = [" thequickbrown ퟿ é", "zqxjkv  \n the 12345"]
    ids += coder.encode(texts)
    assert [np.frombuffer(x, "<i4").tolist() for x in ids[-2:]] == [library.encode(t) for t in texts]
