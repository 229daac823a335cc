"""Token ids in Simple-8b files.

Texts are dealt to ranges of doc_id, sorted and encoded; each range becomes one
file, so file order is document order. A file is a run of segments; a segment
has a table of its documents' pieces and its ids in blocks of 4096. A block is
packed on its own into 64-bit words: four bits of selector, then 60 bits that
hold as many ids as their width allows; an id beyond 60 bits is an escape word
followed by the id itself. The word offset of each block is stored, so blocks are
decoded alone, and a segment in a few array operations per selector.

Files are written by Spark's text sink (a segment is a line of raw bytes, closed
by ``TRAILER``), which commits a task's file once whatever happens to executors.

Layout of a segment, little-endian: magic ``S8B1``, uint32 pieces, uint32 blocks,
uint64 ids, uint64 words; int64 doc_id[pieces], uint8 flags[pieces] (1: doc_id is
null, 2: goes on from the piece before), uint32 length[pieces]; uint64 first
word[blocks]; uint64 words. All blocks but the last hold 4096 ids.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..ship import ship
from .store import fresh_path, stash

MAGIC, HEAD = b"S8B1", struct.Struct("<4sIIQQ")
TRAILER = "\n8S8B\n"
BLOCK, SEGMENT_IDS = 4096, 1 << 20
#: (ids, bits) of selectors 1 to 15; selector 0 is the escape, 1 a run of zeros.
PACKINGS = ((120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))


#: Ids that a selector's word holds.
_COUNTS = np.array([1, *(c for c, _ in PACKINGS)], dtype=np.uint8)


#: The selector, by how many fit.
_CHOICE = np.array([0, *range(len(PACKINGS), 0, -1)], dtype=np.uint8)


#: Bits of numbers below 65536.
_SHORT = np.ceil(np.log2(np.arange(65536) + 1)).astype(np.uint8)


def _widths(v: np.ndarray) -> np.ndarray:
    """Bits that each number needs; 64 for those that only an escape can hold."""
    out = _SHORT[np.minimum(v, 65535).astype(np.int32)]
    long = np.flatnonzero(v > 65535)
    if len(long):
        w = v[long]
        at = np.full(len(long), 17, np.uint8)
        for bits in (20, 30, 60):
            at[w >> np.uint64(bits) != 0] = bits + 1 if bits < 60 else 64
        out[long] = at
    return out


def pack(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """(words, first word of each block) of unsigned ids: greedy, each word taking
    the selector that holds most of the ids that are left in the block.

    Blocks are laid out with zeros behind them, so a selector fits wherever the
    widest of the next ``count`` numbers fits; those maxima come from two windows of
    a power of two."""
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    blocks, room = -(-n // block), max(c for c, _ in PACKINGS)
    v = np.zeros((blocks, block + room), np.uint64)
    whole = n // block * block
    v[: n // block, :block] = np.reshape(ids[:whole], (-1, block))
    if whole < n:
        v[-1, : n - whole] = ids[whole:]
    v = v.ravel()
    widest = {1: _widths(v)}  # by window length
    fits = np.zeros(len(v), np.uint8)  # selectors: where one fits, so do those of fewer and wider ids
    size = 1
    for count, bits in reversed(PACKINGS):  # from few wide ids to many narrow ones
        while 2 * size <= count:
            w = widest[size]
            widest[2 * size] = np.maximum(w, np.r_[w[size:], np.zeros(size, np.uint8)])
            size *= 2
        w, lag = widest[size], count - size
        top = np.maximum(w, np.r_[w[lag:], np.zeros(lag, np.uint8)]) if lag else w
        fits += (top <= bits).view(np.uint8)
    choice = _CHOICE[fits]
    jumps = _COUNTS[choice]
    # all blocks step by step, side by side; one that is through stays at its end
    at = np.arange(blocks, dtype=np.int64) * (block + room)
    end = at + np.minimum(block, n - np.arange(blocks) * block)
    steps = []
    while True:
        steps.append(at)
        at = np.minimum(at + jumps[at], end)
        if (at == end).all():
            break
    steps = np.stack(steps, axis=1)
    within = steps < end[:, None]
    starts = steps[within]
    firsts = np.cumsum(within.sum(axis=1))
    firsts = np.r_[0, firsts[:-1]]
    chosen = choice[starts]
    place = np.cumsum(np.where(chosen == 0, 2, 1))
    place -= np.where(chosen == 0, 2, 1)
    words = np.zeros(int(place[-1]) + (2 if chosen[-1] == 0 else 1), np.uint64)
    for selector, (count, bits) in enumerate(PACKINGS, 1):
        own = np.flatnonzero(chosen == selector)
        if not len(own):
            continue
        first = starts[own]
        word = np.full(len(own), selector << 60, dtype=np.uint64)
        if bits:
            for k in range(count):
                word |= v[first + k] << np.uint64(k * bits)
        words[place[own]] = word
    raw = np.flatnonzero(chosen == 0)
    words[place[raw] + 1] = v[starts[raw]]
    return words, place[firsts].astype(np.uint64)


def unpack(words: np.ndarray, firsts: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
    """The n ids of packed words; with the words and first words of some blocks
    only, the ids of those blocks."""
    out = np.zeros(n, np.uint64)
    if not n:
        return out
    selector = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    for i in np.flatnonzero(selector == 0):  # rare: ids of over 60 bits
        if not raw[i] and i + 1 < len(words):
            raw[i + 1] = True
    counts = np.array([1, *(c for c, _ in PACKINGS)])[selector]
    counts[raw] = 0
    firsts = firsts.astype(np.int64)
    of = np.searchsorted(firsts, np.arange(len(words)), "right") - 1
    before = np.cumsum(counts) - counts
    # a block's last word may be padded: count from the block's own first word
    inside = before - before[firsts[of]]
    room = np.minimum(block, n - of * block) - inside
    start = of * block + inside
    for s, (count, bits) in enumerate(PACKINGS, 1):
        own = np.flatnonzero((selector == s) & ~raw)
        if not len(own) or not bits:
            continue
        mask = np.uint64((1 << bits) - 1)
        for k in range(count):
            sure = own[room[own] > k]
            out[start[sure] + k] = (words[sure] >> np.uint64(k * bits)) & mask
    escapes = np.flatnonzero((selector == 0) & ~raw)
    out[start[escapes]] = words[escapes + 1]
    return out


def segments(docs: Iterator[tuple[int | None, np.ndarray]], limit: int = SEGMENT_IDS) -> Iterator[bytes]:
    """Segments of (doc_id, ids) in the order given; a document that doesn't fit in
    one goes on in the next."""
    keys: list[int] = []
    flags: list[int] = []
    parts: list[np.ndarray] = []
    held = 0

    def close() -> bytes:
        ids = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        words, firsts = pack(ids)
        return b"".join((
            HEAD.pack(MAGIC, len(keys), len(firsts), len(ids), len(words)), np.array(keys, "<i8").tobytes(),
            np.array(flags, "u1").tobytes(), np.array([len(p) for p in parts], "<u4").tobytes(),
            firsts.astype("<u8").tobytes(), words.astype("<u8").tobytes(),
        ))

    for key, ids in docs:
        done = 0
        while True:
            piece = ids[done : done + limit - held]
            keys.append(key or 0)
            flags.append((key is None) + 2 * (done > 0))
            parts.append(piece)
            done, held = done + len(piece), held + len(piece)
            if held >= limit:
                yield close()
                keys, flags, parts, held = [], [], [], 0
            if done >= len(ids):
                break
    if parts:
        yield close()


def read_file(data: bytes) -> Iterator[tuple[int | None, bool, np.ndarray]]:
    """(doc_id, goes on, ids) of each piece of a file; raises where it is damaged."""
    at, end = 0, TRAILER.encode()
    while at < len(data):
        magic, n_pieces, n_blocks, n_ids, n_words = HEAD.unpack_from(data, at)
        at += HEAD.size
        if magic != MAGIC:
            raise ValueError("a segment doesn't begin with its magic")
        fields = []
        for kind, n in (("<i8", n_pieces), ("u1", n_pieces), ("<u4", n_pieces), ("<u8", n_blocks), ("<u8", n_words)):
            fields.append(np.frombuffer(data, kind, n, at))
            at += fields[-1].nbytes
        if data[at : at + len(end)] != end:
            raise ValueError("a segment doesn't end with its trailer")
        at += len(end)
        keys, flags, lengths, firsts, words = fields
        ids = unpack(words, firsts, n_ids)
        stop = np.cumsum(lengths, dtype=np.int64)
        for key, flag, a, b in zip(keys.tolist(), flags.tolist(), (stop - lengths).tolist(), stop.tolist(), strict=True):
            yield (None if flag & 1 else key), bool(flag & 2), ids[a:b]


def count_ids(data: bytes) -> int:
    """The ids of a file, by the heads of its segments alone."""
    at = n = 0
    while at < len(data):
        _, n_pieces, n_blocks, n_ids, n_words = HEAD.unpack_from(data, at)
        at += HEAD.size + n_pieces * (8 + 1 + 4) + 8 * (n_blocks + n_words) + len(TRAILER)
        n += n_ids
    return n


#: Texts of these characters only: no letter composes, and case folds one by one.
_PLAIN = re.compile(r"[\t\n\r -~\xa1-\xff]*")
_LETTER, _NUMBER = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
# What a vocabulary file says whose words the encoder may merge one by one.
_WORD_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_WORD_SPLITTER = [
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]
# Fixed values end.
#: How such a file splits lower-cased plain texts; what lies between is dropped.
_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^\t\n\r {_LETTER}{_NUMBER}]+")


def splits_words(path: str) -> bool:
    """Whether a vocabulary file cuts texts as _SPLIT does and merges within words: by
    what it says, whatever it is called. Its added tokens must begin with "<|"."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    steps = lambda part, name: (part or {}).get(name)
    model = spec.get("model") or {}
    return (
        steps(spec.get("normalizer"), "normalizers") == _WORD_NORMALIZER and steps(spec.get("pre_tokenizer"), "pretokenizers") == _WORD_SPLITTER
        and spec.get("post_processor") is None and model.get("type") == "BPE" and not model.get("dropout") and not model.get("continuing_subword_prefix")
        and all(t["content"].startswith("<|") for t in spec.get("added_tokens") or [])
    )


def _byte_marks() -> dict[int, str]:
    """The printable character by which byte-level vocabularies write each byte:
    printable ones stand for themselves, the others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


#: Kinds of bytes; those from _NUMBER_KIND on are units of their own.
_BLANK_KIND, _LETTER_KIND, _OTHER_KIND, _NUMBER_KIND, _END_KIND = range(5)


def _tables() -> tuple[bytes, bytes]:
    """(lower case, kind) of each byte of a plain text in Latin-1; byte 0 ends a text."""
    lower, kind = bytearray(range(256)), bytearray([_OTHER_KIND]) * 256
    for i, c in enumerate(map(chr, range(256))):
        if _PLAIN.fullmatch(c):
            lower[i] = ord(c.lower())
            kind[i] = _BLANK_KIND if c in "\t\n\r " else _LETTER_KIND if re.match(f"[{_LETTER}]", c) else _NUMBER_KIND if re.match(f"[{_NUMBER}]", c) else _OTHER_KIND
    kind[0] = _END_KIND
    return bytes(lower), bytes(kind)


_LOWER_BYTES, _KIND_BYTES = _tables()


def split_units(data: bytes) -> pa.BinaryArray:
    """The units that _SPLIT finds in lower-cased plain texts in Latin-1, each closed
    by a byte 0, which is a unit as well."""
    raw, kind = np.frombuffer(data, np.uint8), np.frombuffer(data.translate(_KIND_BYTES), np.uint8)
    begins = kind >= _NUMBER_KIND
    begins[:1] = True
    begins[1:] |= kind[1:] != kind[:-1]
    marks = np.flatnonzero(raw == ord("'"))
    marks = marks[begins[marks] & (kind[marks + 1] == _LETTER_KIND)]  # 's and the like begin with a unit, never within one
    first, second = raw[marks + 1], raw[marks + 2]
    short = np.isin(first, list(b"stmd"))
    long = ((first == ord("r")) | (first == ord("v"))) & (second == ord("e")) | (first == ord("l")) & (second == ord("l"))
    begins[marks[short | long] + 1] = False
    begins[marks[short] + 2] = True
    begins[marks[long] + 3] = True
    solid = kind != _BLANK_KIND
    text = raw[solid]
    offsets = np.append(np.flatnonzero(begins[solid]), len(text)).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(text)])


class WordEncoder:
    """Encodes whole texts as the tokenizers library does. In a vocabulary file
    that splits texts into words first and merges within each, a word's ids don't
    depend on its neighbours: plain texts are cut into words in arrays, and distinct
    words are merged by the library's model once and kept; any other text, and any
    other kind of file, goes to the library whole.

    Words are kept in arrays, with the group of texts that had them last: of more than
    ``most`` only half as many stay, those met last."""

    def __init__(self, path: str, most: int = 700_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.split = splits_words(path)
        self.merger = Tokenizer(self.tokenizer.model)  # the model alone, for words in byte marks
        self.merger.pre_tokenizer = WhitespaceSplit()
        self.marks, self.most = {b: c for b, c in _byte_marks().items() if b != ord("\n")}, most
        self.known, self.ids = pa.array([], pa.binary()), np.zeros(0, "<u4")
        self.lengths, self.met, self.groups = np.zeros(0, np.int32), np.zeros(0, np.int32), 0
        suffix, vocab = self.split and self.tokenizer.model.end_of_word_suffix, self.tokenizer.get_vocab(with_added_tokens=False)
        self.last = np.zeros(max(vocab.values(), default=0) + 1, bool)  # ids that only a word's last piece has
        if suffix:
            self.last[[i for piece, i in vocab.items() if piece.endswith(suffix)]] = True

    def encode(self, text: str | None) -> np.ndarray:
        return next(self.encode_all([text]))

    def encode_all(self, texts: list[str | None], end: int | None = None) -> Iterator[np.ndarray]:
        """The ids of each text, closed by ``end`` if it is given."""
        texts = [text or "" for text in texts]
        plain = [self.split and "<|" not in text and _PLAIN.fullmatch(text) is not None for text in texts]
        pieces = self._plain([text for text, p in zip(texts, plain, strict=True) if p], end or 0)
        close = [] if end is None else [end]
        for text, p in zip(texts, plain, strict=True):
            if p:
                yield next(pieces)[: None if close else -1]
            else:
                yield np.array([*self.tokenizer.encode(text, add_special_tokens=False).ids, *close], "<u4")

    def _plain(self, texts: list[str], end: int, size: int = 1 << 20) -> Iterator[np.ndarray]:
        """The ids of plain texts, each closed by end. Units are told apart over all
        texts and put together for about ``size`` characters at a time."""
        if not texts:
            return
        ends = np.cumsum([len(text) + 1 for text in texts])
        cuts = [0, *(np.flatnonzero(np.diff(ends // size)) + 1).tolist(), len(texts)]
        parts = (texts[a:b] for a, b in zip(cuts, cuts[1:]))
        units = pa.chunked_array([split_units(("\0".join(p) + "\0").encode("latin-1").translate(_LOWER_BYTES)) for p in parts]).dictionary_encode()
        # the last chunk's dictionary has all units; earlier ones may lack some
        distinct = units.chunk(units.num_chunks - 1).dictionary
        stop = pc.index(distinct, b"\0").as_py()
        flat, firsts, lengths = self._ids(distinct, stop, end)
        for chunk in units.chunks:
            codes = chunk.indices.to_numpy()
            n = lengths[codes]
            after = np.cumsum(n, dtype=np.int32)
            at = np.repeat(firsts[codes] - after + n, n)
            at += np.arange(len(at), dtype=np.int32)
            yield from np.split(flat[at], after[codes == stop][:-1])

    def _ids(self, distinct: pa.BinaryArray, stop: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, firsts, lengths): where among ids those of each word begin, and how many
        there are. The word at ``stop`` has the id end. New words are merged and kept."""
        at = pc.fill_null(pc.index_in(distinct, value_set=self.known), -1).to_numpy()
        old, new = np.flatnonzero(at >= 0), np.flatnonzero(at < 0)
        new = new[new != stop]
        words = distinct.take(pa.array(new))
        parts = [*self._merge(words.to_numpy(zero_copy_only=False).tolist()), (np.zeros(0, "<u4"), np.zeros(0, np.int32))]
        merged, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
        lengths, firsts = np.ones(len(distinct), np.int32), np.zeros(len(distinct), np.int32)
        lengths[old], lengths[new] = self.lengths[at[old]], counts
        firsts[old] = (np.cumsum(self.lengths, dtype=np.int32) - self.lengths)[at[old]]
        firsts[new] = len(self.ids) + np.cumsum(counts, dtype=np.int32) - counts
        firsts[stop] = len(self.ids) + len(merged)
        flat = np.concatenate((self.ids, merged, np.array([end], "<u4")))

        self.groups += 1
        self.met[at[old]] = self.groups
        short = pc.binary_length(words).to_numpy() <= 64
        self.known = pa.concat_arrays([self.known, words.filter(pa.array(short))])
        self.ids = np.concatenate((self.ids, merged[np.repeat(short, counts)]))
        self.lengths = np.concatenate((self.lengths, counts[short]))
        self.met = np.concatenate((self.met, np.full(short.sum(), self.groups, np.int32)))
        if len(self.known) > self.most:
            keep = np.zeros(len(self.known), bool)
            keep[np.argsort(-self.met, kind="stable")[: self.most // 2]] = True
            self.known, self.ids = self.known.filter(pa.array(keep)), self.ids[np.repeat(keep, self.lengths)]
            self.lengths, self.met = self.lengths[keep], self.met[keep]
        return flat, firsts, lengths

    def _merge(self, words: list[bytes], size: int = 1000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, how many each has) of lower-cased words, by the library, some at a time. Its fast
        way doesn't say which word an id is of: where not every word ends in an id of
        ``last`` the other way does."""
        for at in range(0, len(words), size):
            some = words[at : at + size]
            marked = b"\n".join(some).decode("latin-1").encode("utf-8").decode("latin-1").translate(self.marks)
            ids = np.array(self.merger.encode_batch_fast([marked], add_special_tokens=False)[0].ids, "<u4")
            stops = np.flatnonzero(self.last[ids]) + 1
            if len(stops) != len(some):
                merged = self.merger.encode(marked, add_special_tokens=False)
                ids, stops = np.array(merged.ids, "<u4"), np.cumsum(np.bincount(merged.word_ids, minlength=len(some)))
            yield ids, np.diff(stops, prepend=0).astype(np.int32)


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One per Python worker: words stay known from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int = 1, file_bytes: int = 24 << 20, group_bytes: int = 12 << 20) -> None:
    """Encodes docs(doc_id, text) whole, ends each with end_id, and writes files of
    the ids in ascending order of doc_id (null ids first; rows with one id in any
    order), each from about file_bytes of text. Null texts count as empty. Texts are
    encoded in groups of about group_bytes."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ship(docs.sparkSession)
    total = rows.agg(F.sum(F.octet_length("text") + 16).alias("b")).first()["b"] or 0

    def run(batches):
        encode_all = encoder(vocabulary).encode_all

        def each():
            keys, texts, held = [], [], 0
            for batch in batches:
                keys += batch.column(0).to_pylist()
                texts += batch.column(1).to_pylist()
                held += batch.nbytes
                if held >= group_bytes:
                    yield from zip(keys, encode_all(texts, end_id), strict=True)
                    keys, texts, held = [], [], 0
            yield from zip(keys, encode_all(texts, end_id), strict=True)

        for segment in segments(each()):
            yield pa.RecordBatch.from_arrays([pa.array([segment], pa.binary())], ["value"])

    (
        rows.repartitionByRange(max(1, -(-total // file_bytes)), "doc_id").sortWithinPartitions("doc_id")
        .mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
        .write.option("lineSep", TRAILER).text(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(file, place, doc_id, start, n_tokens, ids_crc32) of each document of the
    files: start counts the ids before it within its file."""

    def run(batches):
        for pdf in batches:
            for name, data in zip(pdf["path"], pdf["content"], strict=True):
                rows: list[list] = []
                start = 0
                for key, goes_on, ids in read_file(data):
                    raw = ids.astype("<u4").tobytes()
                    if goes_on:
                        rows[-1][4] += len(ids)
                        rows[-1][5] = zlib.crc32(raw, rows[-1][5])
                    else:
                        rows.append([name, len(rows), key, start, len(ids), zlib.crc32(raw)])
                    start += len(ids)
                out = pd.DataFrame(rows, columns=["file", "place", "doc_id", "start", "n_tokens", "ids_crc32"], dtype=object)
                yield out.astype({"place": "int64", "doc_id": "Int64", "start": "int64", "n_tokens": "int64", "ids_crc32": "int64"})

    ship(spark)
    found = spark.read.format("binaryFile").load(path).select("path", "content")
    return found.mapInPandas(run, "file string, place long, doc_id long, start long, n_tokens long, ids_crc32 long")


def file_totals(spark: SparkSession, path: str) -> DataFrame:
    """(file, n) of each file: how many ids it has."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"file": pdf["path"], "n": [count_ids(d) for d in pdf["content"]]}).astype({"n": "int64"})

    ship(spark)
    found = spark.read.format("binaryFile").load(path).select("path", "content")
    return found.mapInPandas(run, "file string, n long")


def with_global_start(found: DataFrame, totals: DataFrame) -> DataFrame:
    """read_tokens with start counted over all files: file_totals, one row a file,
    are summed up in file order and joined."""
    number = F.regexp_extract("file", r"part-(\d+)", 1).cast("long")
    before = F.sum("n").over(Window.orderBy(number, "file").rowsBetween(Window.unboundedPreceding, -1))
    bases = stash(totals.select("file", F.coalesce(before, F.lit(0)).alias("base")), "bases")
    return found.join(bases, "file").withColumn("start", F.col("start") + F.col("base")).drop("base")


def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = fresh_path(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("word_bpe_49k.json"))
    return with_global_start(read_tokens(spark, path), file_totals(spark, path)).select("doc_id", "start", "n_tokens", "ids_crc32")


QUERIES = {"op6_token_ids": op6_token_ids}
#: SQL can't tokenize: tested against the library and a plain round trip.
ORACLE_SQL: dict[str, str] = {}
