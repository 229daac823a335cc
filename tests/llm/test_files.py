import base64
import hashlib
import random
import uuid

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plyforge.llm import simple8b_tokens as T
from plyforge.llm import warc_revisit as W
from plyforge.llm.store import shared_dir

from .fixtures import awkward_texts, docs


def pages(spark):
    rows = [
        (1, "http://a.example/x", "<p>one</p>"), (2, "http://a.example/y\n z", "<p>one</p>"), (3, None, None), (4, "u", ""),
        (5, "http://b.example/", "WARC/1.1\r\nContent-Length: 5\r\n\r\nabc\r\n\r\nWARC/1.1\r\n"), (6, "v", "é" * 1000),
        (None, "w", "<p>one</p>"), (7, "x", "<p>one</p>"), (7, "x", "<p>one</p>"), (None, "n", "alone"), (8, "big", "ab" * 200_000),
    ]
    return spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, digest string"), rows


def test_archives_round_trip(spark):
    frame, rows = pages(spark)
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    W.write_archives(frame, path, file_bytes=5000)
    got = W.resolve(W.read_archives(spark, path)).collect()
    assert len(got) == len(rows)
    largest = {}
    for i, _, html in rows:
        largest[html or ""] = max(largest.get(html or "", -1), -1 if i is None else i)
    want = []
    for i, _, html in rows:
        raw = (html or "").encode()
        first = largest[html or ""]
        back = first >= 0 and i != first
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if back else "response", first if back else None))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_page"]) for r in got), key=key) == sorted(want, key=key)
    bodies = {bytes(r["payload"]).decode() for r in W.read_archives(spark, path, payloads=True).filter("payload is not null").collect()}
    assert bodies == {h or "" for _, _, h in rows}


def test_small_payloads_stay_responses(spark):
    frame, _ = pages(spark)
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    W.write_archives(frame, path, min_bytes=100)
    assert {r["record_type"] for r in W.read_archives(spark, path).collect()} == {"response"}


def test_damaged_streams_raise():
    good = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert [b for _, b in W.records([good[:9], good[9:], good])] == [b"abc", b"abc"]
    for bad in (good[:-2], good[:30], b"junk\r\n\r\n", good + b"x"):
        with pytest.raises((ValueError, KeyError)):
            list(W.records([bad]))


def test_empty_pages(spark):
    frame, _ = pages(spark)
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    W.write_archives(frame.limit(0), path)
    assert W.resolve(W.read_archives(spark, path)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 70_000), st.integers(0, 2**64 - 1)), max_size=700), st.sampled_from([7, 64, 4096]))
def test_packing_round_trip(ids, block):
    v = np.array(ids, dtype=np.uint64)
    words, firsts = T.pack(v, block)
    assert (T.unpack(words, firsts, len(v), block) == v).all()
    for b in range(len(firsts)):  # each block on its own
        own = words[int(firsts[b]) : int(firsts[b + 1]) if b + 1 < len(firsts) else len(words)]
        part = v[b * block : (b + 1) * block]
        assert (T.unpack(own, np.zeros(1, np.uint64), len(part), block) == part).all()


def test_long_runs_take_few_words():
    assert len(T.pack(np.zeros(4096, np.uint64))[0]) == -(-4096 // 120)
    assert len(T.pack(np.ones(4096, np.uint64))[0]) == -(-4096 // 60)


def test_documents_go_on_in_the_next_segment():
    rng = np.random.default_rng(0)
    rows = [(None, rng.integers(0, 50, 3)), (-5, rng.integers(0, 50, 25)), (2, np.zeros(0, np.uint64)), (3, rng.integers(0, 50, 10))]
    data = b"".join(s + T.TRAILER.encode() for s in T.segments(iter(rows), limit=10))
    back = []
    for key, goes_on, ids in T.read_file(data):
        if goes_on:
            back[-1][1].extend(ids.tolist())
        else:
            back.append((key, ids.tolist()))
    assert back == [(k, v.tolist()) for k, v in rows]
    with pytest.raises(ValueError):
        list(T.read_file(data[: len(data) // 2] + b"S8B0" + data[len(data) // 2 :]))


TEXTS = st.text(st.sampled_from("aAbEéÉßñ'sStT 12²½.,!-_<|>\n\t ́İσΣ日​"), max_size=60)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_word_table_gives_the_library_s_ids(text):
    import public_tokenizers

    encoder = T.encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert encoder.encode(text).tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_a_full_word_table_starts_anew():
    import public_tokenizers

    small = T.WordEncoder(public_tokenizers.path("word_bpe_49k.json"), most=3)
    text = "one two three four five one two"
    assert small.encode(text).tolist() == small.tokenizer.encode(text, add_special_tokens=False).ids


def test_a_word_is_merged_once_whatever_stands_beside_it():
    import public_tokenizers

    encoder, merged = T.WordEncoder(public_tokenizers.path("word_bpe_49k.json")), []
    merge = encoder._merge
    encoder._merge = lambda words: merge(merged.extend(words) or words)
    texts = ["(Doosque) doosque, doosque.", "doosque; it's 12 DOOSQUE!", "", None, "doosque\n\"doosque\""]
    for _ in range(2):  # the second time everything is known
        assert [ids.tolist() for ids in encoder.encode_all(texts, 1)] == [[*encoder.tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]
    assert sorted(merged) == sorted([b"doosque", b"(", b")", b",", b".", b";", b"it", b"'s", b"1", b"2", b"!", b'"'])


def test_words_that_are_met_again_outlast_a_full_table():
    import public_tokenizers

    encoder, merged = T.WordEncoder(public_tokenizers.path("word_bpe_49k.json"), most=20), []
    merge = encoder._merge
    encoder._merge = lambda words: merge(merged.extend(words) or words)
    for i in range(26):
        text = "often " + " ".join(chr(97 + i) + c for c in "abc")
        assert encoder.encode(text).tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids
        assert len(encoder.known) <= 20
    assert merged.count(b"often") == 1


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("abdelmrstvéßªµ''''12².,!- \t\n"), max_size=20), max_size=4))
def test_units_are_those_of_the_pattern(texts):
    want = [u.encode("latin-1") for t in texts for u in [*T._SPLIT.findall(t), "\0"]]
    assert T.split_units("".join(t + "\0" for t in texts).encode("latin-1")).to_pylist() == want


def test_every_latin_1_character_and_texts_over_several_parts():
    import public_tokenizers

    encoder = T.encoder(public_tokenizers.path("word_bpe_49k.json"))
    library = lambda t: encoder.tokenizer.encode(t, add_special_tokens=False).ids
    texts = [c for i in range(256) for c in (chr(i), f"x{chr(i)}y", f"'{chr(i)}")] + ["日本 <|x", "l'eau 's"]
    assert [ids.tolist() for ids in encoder.encode_all(texts)] == [library(t) for t in texts]
    plain = ["First one's", "", "x" * 30, "second two, one", "third"]
    assert [ids.tolist() for ids in encoder._plain(plain, 7, size=8)] == [[*library(t), 7] for t in plain]


def test_a_vocabulary_without_a_mark_for_the_end_of_words(tmp_path):
    import json

    import public_tokenizers

    spec = json.loads(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read())
    spec["model"]["end_of_word_suffix"] = None
    (tmp_path / "open.json").write_text(json.dumps(spec))
    encoder = T.WordEncoder(str(tmp_path / "open.json"))
    assert encoder.split and not encoder.last.any()
    for text in ("Hello, it's a test of 12 words", "", "é!"):
        assert encoder.encode(text).tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_the_way_of_encoding_follows_from_the_file_s_content(tmp_path):
    import json
    import shutil

    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    renamed = tmp_path / "other.json"
    shutil.copy(path, renamed)
    assert T.splits_words(path) and T.splits_words(str(renamed))
    spec = json.loads(renamed.read_text())
    spec["normalizer"]["normalizers"].pop()  # no lower case
    (tmp_path / "word_bpe_49k.json").write_text(json.dumps(spec))
    cased = T.WordEncoder(str(tmp_path / "word_bpe_49k.json"))
    assert not cased.split
    for text in ("Hello World", "It's A TEST"):
        assert cased.encode(text).tolist() == cased.tokenizer.encode(text, add_special_tokens=False).ids


def test_token_files(spark):
    import zlib

    import public_tokenizers

    path, vocabulary = f"{shared_dir(spark)}/{uuid.uuid4().hex}", public_tokenizers.path("word_bpe_49k.json")
    T.write_tokens(docs(spark), path, vocabulary, file_bytes=40_000)
    got = T.with_global_start(T.read_tokens(spark, path), T.file_totals(spark, path)).orderBy("start").collect()
    library = T.encoder(vocabulary).tokenizer
    rows = awkward_texts()
    assert [r["doc_id"] for r in got] == sorted((i for i, _ in rows), key=lambda i: -1 if i is None else i)
    want = {}
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        want.setdefault(i, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    seen, at = {}, 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
        seen.setdefault(r["doc_id"], []).append((r["n_tokens"], r["ids_crc32"]))
    assert {k: sorted(v) for k, v in seen.items()} == {k: sorted(v) for k, v in want.items()}


def test_no_documents(spark):
    import public_tokenizers

    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    T.write_tokens(docs(spark, []), path, public_tokenizers.path("word_bpe_49k.json"))
    assert T.with_global_start(T.read_tokens(spark, path), T.file_totals(spark, path)).count() == 0


def test_base32_digest(spark):
    rng = random.Random(0)
    values = ["", "abc", *("".join(chr(rng.randint(32, 900)) for _ in range(50)) for _ in range(20))]
    got = spark.createDataFrame([(v,) for v in values], "v string").select("v", W.base32_sha1(F.col("v")).alias("d")).collect()
    assert all(r["d"] == base64.b32encode(hashlib.sha1(r["v"].encode()).digest()).decode() for r in got)
