import random
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from plyforge.llm import sentencepiece_nbest as P

from .fixtures import awkward_texts, docs

PIECES = [("<unk>", 0.0), ("▁", -3.0), ("a", -4.0), ("b", -4.0), ("ab", -2.0), ("▁a", -2.5), ("ba", -2.0), ("▁ab", -5.0), ("bab", -2.0), ("▁▁", -1.0)]
BYTES = {b: len(PIECES) + b for b in range(256)}
SMALL = P.Vocabulary([*PIECES, *((f"<0x{b:02X}>", 0.0) for b in range(256))], BYTES, {0})


def every_path(text):
    """All segmentations of the marked text, best first."""
    marked = P.BLANK + text.replace(" ", P.BLANK) if text else ""
    table = {p: (i, s) for i, (p, s) in enumerate(PIECES) if i}

    def walk(at):
        if at == len(marked):
            yield 0.0, ()
            return
        if marked[at] not in table:
            raw = marked[at].encode()
            for s, ids in walk(at + 1):
                yield s + SMALL.worst, (*(BYTES[b] for b in raw), *ids)
        for p, (i, score) in table.items():
            if marked.startswith(p, at):
                for s, ids in walk(at + len(p)):
                    yield s + score, (i, *ids)

    return sorted(walk(0), key=lambda x: -x[0])


@settings(max_examples=120, deadline=None)
@given(st.text(st.sampled_from("ab é"), max_size=8), st.integers(1, 6))
def test_nbest_equals_brute_force(text, n):
    want = every_path(text)
    got = SMALL.encode(text, n)
    assert [s for s, _ in got] == [s for s, _ in want[:n]]
    assert len({ids for _, ids in got}) == len(got) and {ids for _, ids in got} <= {ids for _, ids in want}
    assert dict((ids, s) for s, ids in want).items() >= dict((ids, s) for s, ids in got).items()
    assert all(SMALL.decode(ids) == text for _, ids in got)


def test_a_full_table_of_units_starts_anew():
    small = P.Vocabulary([*PIECES, *((f"<0x{b:02X}>", 0.0) for b in range(256))], BYTES, {0}, most=2)
    for text in ("a b ab ba bab", "a", "ab ab", "b a b"):
        assert small.encode(text, 3) == SMALL.encode(text, 3)


def test_long_unit_without_blanks():
    rng = random.Random(0)
    text = "".join(rng.choice("abé") for _ in range(20_000))
    found = SMALL.encode(text, 4)
    assert len(found) == 4 and found[0][0] >= found[1][0] >= found[3][0] and SMALL.decode(found[3][1]) == text


def test_every_row_comes_back(spark):
    got = P.digest(docs(spark), P.model_path()).collect()
    rows = awkward_texts()
    assert len(got) == len(rows) and all(r["round_trip"] for r in got)
    vocab = P.vocabulary(P.model_path())
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    for i, t in rows[:20]:
        score, ids = vocab.encode(t, 1)[0]
        assert by[i]["score"] == score and by[i]["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
    assert by[300]["n_pieces"] == 0 and by[300]["n_best"] == 1 and by[301]["score"] == 0
    best = P.segment(docs(spark, rows[:3]), P.model_path(), 2).collect()
    assert all(vocab.decode(b["ids"]) == r["text"] for r in best for b in r["best"])


def test_best_path_of_the_library_model_is_no_worse_than_its_own():
    import sentencepiece

    sp, vocab = sentencepiece.SentencePieceProcessor(model_file=P.model_path()), P.vocabulary(P.model_path())
    for text in ("hello world", "the quick brown fox", "números y señales"):
        own = sum(sp.get_score(i) for i in sp.encode(text))
        assert vocab.encode(text)[0][0] >= own


def test_long_units_and_a_full_memo(spark):
    vocab = P.vocabulary(P.model_path())
    small = P.Vocabulary.load(P.model_path())
    small.most = 5
    for text in ("one two three four five six seven", "x" * 500 + " y" * 50, "one two"):
        assert small.encode(text, 3) == vocab.encode(text, 3)
    assert len(small.pairs) <= 5 and all(len(u) <= P.LONGEST for u in vocab.pairs)
    assert P.digest(docs(spark, []), P.model_path()).count() == 0
    twice = P.digest(docs(spark, [(1, "same text"), (1, "same text")]), P.model_path()).collect()
    assert len(twice) == 2 and twice[0] == twice[1]


class Counted(dict):
    looked = 0

    def get(self, *args):
        self.looked += 1
        return super().get(*args)


def test_repeated_units_are_looked_up_once():
    small = P.Vocabulary([*PIECES, *((f"<0x{b:02X}>", 0.0) for b in range(256))], BYTES, {0})
    small.pairs = Counted()
    text = "ab ba " * 500
    assert small.encode(text, 4) == SMALL.encode(text, 4)
    assert small.pairs.looked <= len(small.pairs) == 3  # " ab", " ba" and the last blank


def test_units_searched_abreast_equal_units_searched_alone():
    rng = random.Random(1)
    letters = [*"abthe .,!19", "\n", "\0", "é", "日", "😀", "\u0301", "\ud800", "\U0010ffff"]
    units = list(dict.fromkeys("".join(rng.choice(letters) for _ in range(rng.randint(1, 70))) for _ in range(800)))
    bare = P.Vocabulary(PIECES, {}, {0})  # nothing spells what no piece holds
    for vocab in (SMALL, bare, P.vocabulary(P.model_path())):
        ids, sizes, costs = vocab._pairs(units)
        alone = [vocab._pair(u) for u in units]
        assert ids.tolist() == [i for parts, _ in alone for part in parts for i in part]
        assert sizes.tolist() == [sum(map(len, parts)) for parts, _ in alone]
        assert costs.tolist() == [cost for _, cost in alone]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.none() | st.text(st.sampled_from("ab é.!▁\n"), max_size=9), max_size=8), st.integers(1, 5))
def test_groups_of_texts_equal_single_texts(texts, n):
    group, abreast = P.GROUP, P.ABREAST
    try:
        P.GROUP, P.ABREAST = 12, 3
        assert list(SMALL.encode_all(texts, n)) == [SMALL.encode(t, n) for t in texts]
    finally:
        P.GROUP, P.ABREAST = group, abreast
    units, which, begins = SMALL.units([t or "" for t in texts])
    assert len(set(units)) == len(units)
    for t, a, b in zip(texts, begins[:-1], begins[1:], strict=True):
        marked = " " + t.replace(P.BLANK, " ") if t else ""
        assert [units[i] for i in which[a:b]] == re.findall(r" *[^ .!\n]+| *[.!\n]+| +", marked)
