"""Encoding a whole corpus with a public byte-level BPE tokenizer by corpus-level merge replay."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.session import materialize, slices

#: Characters of text a chunk holds, unless a single text is longer. A chunk has one dictionary of its words.
CHUNK_CHARS = 2_000_000
#: Chunks of a block; each block has its own index of words.
BLOCK_CHUNKS = 1000
#: Distinct words whose merges are replayed together.
REPLAY_WORDS = 400_000
_LETTER, _NUMBER, _SPACE, _OTHER, _STOP = range(5)


def default_vocabulary() -> str:
    """The path of byte_bpe_50k; the package of the files is only looked up here."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@cache
def char_classes() -> np.ndarray:
    """The class of each code point: letter, number, white space or other."""
    import regex

    points = "".join(map(chr, [*range(0xD800), *[0] * 0x800, *range(0xE000, 0x110000)]))
    out = np.full(0x110000, _OTHER, np.uint8)
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
        for m in regex.finditer(pattern, points):
            out[m.start() : m.end()] = kind
    return out


class Merges:
    """A vocabulary's merges as arrays: byte -> id, and sorted pair keys -> rank; merge r makes the id made[r]."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, merges = model["vocab"], [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        # byte-level vocabularies write printable bytes as they are and the others as the code points from 256
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        signs = dict(zip(plain, plain)) | {b: 256 + i for i, b in enumerate(sorted({*range(256)} - {*plain}))}
        self.bytes = np.array([vocab[chr(signs[b])] for b in range(256)], np.int32)
        self.pairs = np.array([(vocab[a], vocab[b]) for a, b in merges], np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int32)
        keys = self.pairs[:, 0] << 32 | self.pairs[:, 1]
        self.order = np.argsort(keys)
        self.keys = keys[self.order]

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, or the number of merges if there is none."""
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], len(self.keys))


def replay(data: np.ndarray, offsets: np.ndarray, merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """Ids of many words by replaying all merges in rank order; returns the ids and each word's offset in them.

    data: the words' bytes, offsets: where each begins, and the end. An inverted index holds, for each rank,
    the positions whose pair has it; applying a merge only touches those positions and their two neighbours, and puts the pairs that it makes
    into the index, whose ranks are always higher.
    """
    n = len(data)
    sym = merges.bytes[data]
    nxt, prv = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
    full = offsets[:-1][np.diff(offsets) > 0]
    prv[full] = -1
    nxt[offsets[1:][np.diff(offsets) > 0] - 1] = -1
    at = np.flatnonzero(nxt >= 0).astype(np.int32)
    rank = merges.ranks(sym[at], sym[at + 1])
    at, rank = at[(known := rank < len(merges.made))], rank[known]
    order = np.argsort(rank, kind="stable")
    at, rank = at[order], rank[order]
    begin = np.searchsorted(rank, np.arange(len(merges.made) + 1)).tolist()
    later: dict[int, list[np.ndarray]] = {}
    pairs, made = merges.pairs.tolist(), merges.made.tolist()
    for r in range(len(made)):
        more = later.pop(r, None)
        if begin[r] == begin[r + 1] and more is None:
            continue
        pos = at[begin[r] : begin[r + 1]]
        if more:
            pos = np.unique(np.concatenate([pos, *more]))
        a, b = pairs[r]
        after = nxt[pos]
        ok = (sym[pos] == a) & (after >= 0)
        ok &= sym[after] == b
        pos, after = pos[ok], after[ok]
        if a == b and len(pos) > 1:  # in a chain of overlapping pairs every other one merges, from the left
            chain = np.r_[False, after[:-1] == pos[1:]]
            i = np.arange(len(pos))
            even = (i - np.maximum.accumulate(np.where(chain, 0, i))) % 2 == 0
            pos, after = pos[even], after[even]
        if not len(pos):
            continue
        sym[pos], sym[after] = made[r], -1
        nxt[pos] = end = nxt[after]
        prv[end[end >= 0]] = pos[end >= 0]
        left, right = prv[pos], pos[end >= 0]
        touched = np.concatenate([left[left >= 0], right])
        if len(touched):
            found = merges.ranks(sym[touched], sym[nxt[touched]])
            touched, found = touched[(known := found < len(made))], found[known]
            if len(touched):
                order = np.argsort(found, kind="stable")
                touched, found = touched[order], found[order]
                cut = np.flatnonzero(np.r_[True, found[1:] != found[:-1], True]).tolist()
                for f, t in zip(cut, cut[1:]):
                    later.setdefault(int(found[f]), []).append(touched[f:t])
    alive = sym >= 0
    return sym[alive], np.r_[0, np.cumsum(alive)][offsets]


def split_words(texts: list[str], classes: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words of texts as one BINARY array, and how many each text has, by the pattern of the tokenizer family.

    The rules: a contraction ('s 't 'm 'd 're 've 'll) that begins with an apostrophe of its own is a word; runs
    of letters, of numbers and of other signs are words and take one space (U+0020) before them; of white space
    before a sign only the last character is left out of the run.
    """
    joined = "\n".join([*texts, ""])  # a line feed ends each text; it is a class of its own here
    c = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    n = len(c)
    if not n:
        return pa.array([], pa.binary()), np.zeros(len(texts), np.int64)
    kind = classes[c]
    stop = np.cumsum([len(t) + 1 for t in texts]) - 1
    kind[stop] = _STOP
    cut = np.ones(n, bool)
    cut[1:] = kind[1:] != kind[:-1]
    # two ends of text in a row are two words
    cut[stop] = True
    # the last character of white space before something else stands alone, or joins it if it is U+0020
    last = np.flatnonzero((kind[:-1] == _SPACE) & (kind[1:] != _SPACE) & (kind[1:] != _STOP))
    cut[last] = True
    cut[last[c[last] == 32] + 1] = False
    # contractions: the apostrophe begins a word and a letter follows; the text's end stops it
    q = np.flatnonzero((c == 39) & cut)
    padded = np.r_[c, 0, 0]
    one, two = padded[q + 1], padded[q + 2]
    short = np.isin(one, [ord(x) for x in "stmd"])
    long = ((two == ord("e")) & np.isin(one, [ord("r"), ord("v")])) | ((one == ord("l")) & (two == ord("l")))
    cut[q[short | long] + 1] = False
    cut[q[short] + 2] = True
    cut[q[long] + 3] = True
    starts = np.flatnonzero(cut)
    own = kind[starts] != _STOP
    counts = np.diff(np.r_[0, np.cumsum(own)[np.searchsorted(starts, stop)]])
    data = joined.encode()
    if len(data) != n:  # from code points to bytes
        starts = (np.cumsum(1 + (c >= 0x80).astype(np.int32) + (c >= 0x800) + (c >= 0x10000)) - 1 - (c >= 0x80) - (c >= 0x800) - (c >= 0x10000))[starts]
    offsets = np.r_[starts, len(data)].astype(np.int32)
    words = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    return words.filter(pa.array(own)), counts


def _chunker(classes, chunk_chars: int):
    def chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        table = classes.value
        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
            for a, b in slices(lengths, chunk_chars):
                texts = [t or "" for t in batch.column(1).slice(a, b - a).to_pylist()]
                words, counts = split_words(texts, table)
                coded = words.dictionary_encode()
                row = {"chunk": number, "ids": batch.column(0).slice(a, b - a).to_pylist(), "counts": counts.tolist(), "codes": coded.indices.to_numpy().astype(_width(len(coded.dictionary))).tobytes(), "words": coded.dictionary.to_pylist()}
                yield pa.RecordBatch.from_pylist([row], schema=_CHUNKS)
                number += 1

    return chunk


def _width(n_words: int) -> type:
    return np.uint16 if n_words <= 1 << 16 else np.uint32


_CHUNKS = pa.schema([("chunk", pa.int64()), ("ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())), ("codes", pa.binary()), ("words", pa.list_(pa.binary()))])


_FOUND = pa.schema([("part", pa.int64()), ("places", pa.binary()), ("sizes", pa.binary()), ("out", pa.binary())])


def _replayer(merges, counts_only: bool):
    """(part, place, word) rows to one row a part: its places, their numbers of ids and, unless only counted, the ids."""

    def run(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        coded = t["word"].chunk(0).dictionary_encode()
        w, code = coded.dictionary, coded.indices.to_numpy()
        offsets = np.frombuffer(w.buffers()[1], np.int32)[w.offset : w.offset + len(w) + 1].astype(np.int64)
        ids, at = replay(np.frombuffer(w.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0], merges.value)
        part = t["part"].to_numpy()
        order = np.argsort(part, kind="stable")
        part, place, code = part[order], t["place"].to_numpy()[order].astype(np.int32), code[order]
        sizes = np.diff(at)[code]
        flat = None if counts_only else ids[_ranges(at[:-1][code], sizes)].astype(np.uint32 if len(merges.value.made) > 65_000 else np.uint16)
        cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True])
        ends = np.r_[0, np.cumsum(sizes)]
        rows = [(int(part[a]), place[a:b].tobytes(), sizes[a:b].astype(np.int32).tobytes(), None if counts_only else flat[ends[a] : ends[b]].tobytes()) for a, b in zip(cut, cut[1:])]
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), _FOUND)], schema=_FOUND)

    def replay_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= REPLAY_WORDS:
                yield run(held)
                held, n = [], 0
        if n:
            yield run(held)

    return replay_all


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers start[i] ... start[i] + size[i] - 1 of all i, one after the other."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + size, size)


def _broadcasts(spark: SparkSession, vocabulary: str | None):
    """The merges and the classes: a vocabulary's size and 1.1 MB, whatever the data."""
    return spark.sparkContext.broadcast(Merges(vocabulary or default_vocabulary())), spark.sparkContext.broadcast(char_classes())


def _encode(df: DataFrame, doc_id: str, text: str, vocabulary: str | None, counts_only: bool, chunk_chars: int, block_chunks: int = BLOCK_CHUNKS) -> tuple[DataFrame, DataFrame]:
    """The chunks, and for each of them rows with the encoded words of its dictionary."""
    merges, classes = _broadcasts(df.sparkSession, vocabulary)
    rows = df.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    chunks = materialize(rows.mapInArrow(_chunker(classes, chunk_chars), "chunk bigint, ids array<bigint>, counts array<int>, codes binary, words array<binary>"))
    places = chunks.select(F.col("chunk").alias("part"), F.posexplode("words").alias("place", "word"))
    # the places of a word within a block of chunks meet in one task; a word has one place a chunk at most, so no word brings a task more than about BLOCK_CHUNKS
    n_blocks = max(1, -(-chunks.count() // block_chunks))
    block = F.pmod(F.xxhash64("part"), F.lit(n_blocks))
    found = places.repartition(block, "word").mapInArrow(_replayer(merges, counts_only), "part bigint, places binary, sizes binary, out binary")
    return chunks.select("chunk", "ids", "counts", "codes", F.size("words").alias("n_words")), found


def encode_corpus(df: DataFrame, doc_id: str, text: str, *, vocabulary: str | None = None, chunk_chars: int = CHUNK_CHARS, block_chunks: int = BLOCK_CHUNKS) -> DataFrame:
    """doc_id and ids ARRAY<INT>, one row a row of df: the token ids of each text, without special tokens.

    Null and empty texts give an empty list; strings of special tokens are ordinary text; a row given twice
    comes out twice; other columns are ignored. vocabulary: path of a byte-level BPE file, byte_bpe_50k by default.

    Texts are cut into words, in chunks that keep each distinct word once. One shuffle brings the places
    of a word together, within blocks of block_chunks chunks (2 GB of text by default); there all merges are replayed in rank order over an inverted
    index of pairs, once for each distinct word. A second one brings the ids back to the chunks. A word has one place a
    chunk and is replayed once a block, so even one that every chunk has costs a task no more than block_chunks places.
    """
    chunks, found = _encode(df, doc_id, text, vocabulary, False, chunk_chars, block_chunks)
    out = chunks.groupBy("chunk").cogroup(found.groupBy("part")).applyInArrow(_decode, "doc_id bigint, ids array<int>")
    return out.select(F.col("doc_id").alias(doc_id), "ids")


def _decode(chunk: pa.Table, found: pa.Table) -> pa.Table:
    parts = []
    for ids, counts, code, sizes, flat in _chunk_codes(chunk, found):
        at = np.r_[0, np.cumsum(sizes)]
        out = flat[_ranges(at[:-1][code], sizes[code])]
        ends = np.r_[0, np.cumsum(sizes[code])][np.r_[0, np.cumsum(counts)]]
        parts.append(pa.table({"doc_id": pa.array(ids, pa.int64()), "ids": pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(out.astype(np.int32)))}))
    return pa.concat_tables(parts) if parts else pa.table({"doc_id": pa.array([], pa.int64()), "ids": pa.array([], pa.list_(pa.int32()))})


def _chunk_codes(chunk: pa.Table, found: pa.Table) -> Iterator[tuple]:
    """Of a chunk: document ids, words a document, the words' codes, ids a code, and the ids of all codes."""
    for row in chunk.to_pylist():
        join = lambda c, kind: np.frombuffer(b"".join(x or b"" for x in found[c].to_pylist()), kind)
        place, given = join("places", np.int32), join("sizes", np.int32)
        sizes = np.zeros(row["n_words"], np.int64)
        sizes[place] = given
        out = join("out", np.uint8)
        if len(out):
            out = out.view(np.uint16 if len(out) == 2 * given.sum() else np.uint32)
            order = np.argsort(place)
            at = np.r_[0, np.cumsum(given.astype(np.int64))]
            out = out[_ranges(at[:-1][order], given[order].astype(np.int64))]
        yield row["ids"], np.array(row["counts"], np.int64), np.frombuffer(row["codes"], _width(row["n_words"])).astype(np.int64), sizes, out


def count_tokens(df: DataFrame, doc_id: str, text: str, *, vocabulary: str | None = None, chunk_chars: int = CHUNK_CHARS, block_chunks: int = BLOCK_CHUNKS) -> DataFrame:
    """doc_id and n_tokens: the sizes of encode_corpus's lists, without making them."""
    chunks, found = _encode(df, doc_id, text, vocabulary, True, chunk_chars, block_chunks)
    out = chunks.groupBy("chunk").cogroup(found.groupBy("part")).applyInArrow(_count, "doc_id bigint, n_tokens bigint")
    return out.select(F.col("doc_id").alias(doc_id), "n_tokens")


def _count(chunk: pa.Table, found: pa.Table) -> pa.Table:
    parts = []
    for ids, counts, code, sizes, _ in _chunk_codes(chunk, found):
        total, ends = np.r_[0, np.cumsum(sizes[code])], np.r_[0, np.cumsum(counts)]
        parts.append(pa.table({"doc_id": pa.array(ids, pa.int64()), "n_tokens": pa.array(total[ends[1:]] - total[ends[:-1]])}))
    return pa.concat_tables(parts) if parts else pa.table({"doc_id": pa.array([], pa.int64()), "n_tokens": pa.array([], pa.int64())})
