"""Token-ID output: shards of token ids under Re-Pair grammar compression.

Texts are dealt to shards by range of id, so that shard order is document order. A task tokenises its shard, cuts it into blocks of about
`BLOCK_TOKENS` ids at document ends, and compresses each block: the most frequent pairs of ids become nonterminals, round after round, until no pair
occurs `LEAST` times; a pair never crosses a document's end. A block is a row of a Parquet table with the rules (left and right symbol), the
expansion length of each nonterminal and each document's offset in the symbols, so that any document, or any position in it, is decoded on its own.

Defined results: a null text is an empty one and has the end id alone; null ids come first; repeated ids are all kept, ordered by a hash of the text, then
by text, so that rows of one id can be dealt to several shards; an empty table
gives an empty file; other columns are not written.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.models import BPE

from .common import portions_of
from .common import write as save

END, PORTION, BLOCK_TOKENS, LEAST = 1, 3_000_000, 600_000, 8
FILE = "shard int, block int, start long, n_tokens long, base int, doc_ids array<long>, lengths binary, offsets binary, left binary, right binary, spans binary, symbols binary"
CACHED_PARTS = 250_000
#: Letters whose lower case is a letter of the same kind, and marks that form one part together; an apostrophe parts otherwise, and < may begin a special
#: token.
LETTERS = "".join(map(chr, [*range(65, 91), *range(97, 123), *(c for c in range(0xC0, 0x180) if c not in (0xD7, 0xF7, 0x130))]))
MARKS = "!\"#$%&()*+,-./:;=?@[\\]^_`{|}~"
PLAIN = "^[" + LETTERS + "]*[" + re.escape(MARKS) + "]*$"


class Parts:
    """Parts of texts that were encoded before, and their ids: all in arrays. The empty part has place 0 and no ids."""

    def __init__(self, learn):
        self.learn = learn
        self.clear()

    def clear(self) -> None:
        self.known, self.ids, self.first, self.count = pa.array([""], pa.large_string()), np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(1, np.int64)

    def places(self, strings: pa.Array) -> np.ndarray:
        """The place of each string; what isn't known is learnt together."""
        coded = strings.dictionary_encode()
        at = pc.fill_null(pc.index_in(coded.dictionary, value_set=self.known), -1).to_numpy().astype(np.int64)
        new = coded.dictionary.filter(pa.array(at < 0))
        if len(new):
            ids, count = self.learn(new)
            ends = np.cumsum(count)
            at[at < 0] = len(self.known) + np.arange(len(new))
            self.first, self.count = np.concatenate((self.first, len(self.ids) + ends - count)), np.concatenate((self.count, count))
            self.ids, self.known = np.concatenate((self.ids, ids)), pa.concat_arrays([self.known, new])
        return at[coded.indices.to_numpy()]


def _gathered(flat: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces of flat that begin at first, joined, and where each ends."""
    upto = np.cumsum(count)
    return flat[np.repeat(first - upto + count, count) + np.arange(int(upto[-1]) if len(upto) else 0)], upto


class Encoder:
    """Whole texts to ids. White space always ends a token of this tokenizer, so texts are split at it, and each different word is encoded once.

    A plain word is letters, then marks: two parts by the tokenizer's own pattern. Its letters are lower-cased here, and the library's model encodes
    the parts that aren't remembered. All other words go through the whole tokenizer.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        # The file's model again without its cache of words: each part is asked for once while it is remembered here.
        with open(path, encoding="utf-8") as file:
            own = json.load(file)["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in own.pop("merges")]
        options = {k: v for k, v in own.items() if v is not None and k not in ("type", "vocab")}
        self.model = BPE(vocab=own["vocab"], merges=merges, cache_capacity=0, **options)
        del own, merges
        # The model sees bytes as printable characters: those of Latin-1 stand for themselves, the others for 256 and up.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.table = {b: b for b in shown} | {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in set(shown))}
        self.parts, self.wholes = Parts(self._part), Parts(self._whole)

    def _part(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        split, table = self.model.tokenize, self.table
        found = [split(p if p.isascii() else p.encode().decode("latin-1").translate(table)) for p in parts.to_pylist()]
        return np.fromiter((t.id for tokens in found for t in tokens), np.int32), np.fromiter(map(len, found), np.int64, len(found))

    def _whole(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found = [self.tokenizer.encode(w, add_special_tokens=False).ids for w in words.to_pylist()]
        return np.array([i for ids in found for i in ids], np.int32), np.array([len(ids) for ids in found], np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with the end id, and how many each has. A null text is an empty one."""
        for memory in (self.parts, self.wholes):
            if len(memory.known) > CACHED_PARTS:
                memory.clear()
        split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        ends = np.asarray(split.offsets)[1:] - split.offsets[0].as_py()
        coded = split.flatten().dictionary_encode()
        words, occurs = coded.dictionary, coded.indices.to_numpy()
        plain = pc.match_substring_regex(words, PLAIN)
        simple, other = words.filter(plain), words.filter(pc.invert(plain))
        letters, marks = np.split(self.parts.places(pa.concat_arrays([pc.utf8_lower(pc.utf8_rtrim(simple, MARKS)), pc.utf8_ltrim(simple, LETTERS)])), 2)
        wholes, plain = self.wholes.places(other), plain.to_numpy(zero_copy_only=False)
        flat = np.concatenate((self.parts.ids, self.wholes.ids))
        first, count = np.zeros((len(words), 2), np.int64), np.zeros((len(words), 2), np.int64)
        for column, places in enumerate((letters, marks)):
            first[plain, column], count[plain, column] = self.parts.first[places], self.parts.count[places]
        first[~plain, 0], count[~plain, 0] = len(self.parts.ids) + self.wholes.first[wholes], self.wholes.count[wholes]
        ids, _ = _gathered(flat, first.ravel(), count.ravel())
        count = count.sum(axis=1)
        ids, upto = _gathered(ids, (np.cumsum(count) - count)[occurs], count[occurs])
        done = np.concatenate(([0], upto))[ends]
        return np.insert(ids, done, END), np.diff(done, prepend=0) + 1


@lru_cache(1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _sorted(left: np.ndarray, right: np.ndarray, packed: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs in order (left and right symbols), and the places that they come from. Small symbols and places share a word, which sorts much faster."""
    if packed:
        key = np.sort((left << 44 | right << 24 | np.arange(len(left))).view(np.uint64))
        return (key >> np.uint64(44)).view(np.int64), (key >> np.uint64(24)).view(np.int64) & 0xFFFFF, (key & np.uint64(0xFFFFFF)).view(np.int64)
    order = np.lexsort((right, left))
    return left[order], right[order], order


def repair(ids: np.ndarray, lengths: np.ndarray, base: int, least: int = LEAST) -> dict[str, np.ndarray]:
    """Symbols and rules of ids. Symbols from `base` on are nonterminals; spans are their expansion lengths. No pair of symbols is left that occurs
    `least` times within documents, without overlap.

    A round counts the pairs and takes those that occur so often, most frequent first where occurrences overlap; a pair that keeps fewer than `least`
    occurrences waits for the next round. A pair of given symbols never becomes more frequent, so only pairs that were frequent, and those with a new
    symbol, are looked at again; and only those whose hash bin is that full are counted one by one.
    """
    seq, last, packed = ids.astype(np.int64), np.zeros(len(ids), bool), len(ids) < 1 << 24 and base + len(ids) // least < 1 << 20
    last[np.cumsum(lengths)[lengths > 0] - 1] = True
    left, right, made, live = [], [], 0, ~last
    while len(at := np.flatnonzero(live)):
        a, b = seq[at], seq[at + 1]
        same = np.flatnonzero(a == b)
        if len(same):  # in a run of one symbol every other pair counts
            run = np.flatnonzero(np.diff(at[same], prepend=-2) != 1)
            counted = np.ones(len(at), bool)
            counted[same[(at[same] - np.repeat(at[same[run]], np.diff(run, append=len(same)))) % 2 == 1]] = False
            at, a, b = at[counted], a[counted], b[counted]
        bits = min(22, max(12, len(at).bit_length() + 1))
        place = (((a << 31 | b).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).view(np.int64)
        full = (np.bincount(place, minlength=1 << bits) >= least)[place]
        live[at[~full]] = False
        at = at[full]
        a, b, source = _sorted(a[full], b[full], packed)
        cut = np.flatnonzero(np.concatenate(([len(a) > 0], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
        count = np.diff(cut, append=len(a))
        live[at[source[np.repeat(count < least, count)]]] = False
        taken = np.flatnonzero(count >= least)
        if not len(taken):
            break
        taken = taken[np.argsort(-count[taken], kind="stable")]
        rank = np.full(len(cut), len(taken))
        rank[taken] = np.arange(len(taken))
        own = np.empty(len(at), np.int64)
        own[source] = np.repeat(rank, count)
        at, own = at[own < len(taken)], own[own < len(taken)]
        touch, clear = np.diff(at) == 1, np.ones(len(at), bool)
        clear[1:] &= ~(touch & (own[:-1] < own[1:]))
        clear[:-1] &= ~(touch & (own[1:] < own[:-1]))
        at, own = at[clear], own[clear]
        use = np.bincount(own, minlength=len(taken)) >= least
        at, own = at[use[own]], own[use[own]]
        left.append(a[cut[taken[use]]]), right.append(b[cut[taken[use]]])
        seq[at] = base + made + (np.cumsum(use) - 1)[own]
        made += int(use.sum())
        last[at] = last[at + 1]
        live[at] = ~last[at]
        before = at[at > 0] - 1
        live[before] = ~last[before]
        stay = np.ones(len(seq), bool)
        stay[at + 1] = False
        seq, last, live = seq[stay], last[stay], live[stay]
    spans = np.ones(base + made, np.int64)
    for x, y, first in zip(left, right, base + np.cumsum([0, *map(len, left)]), strict=False):
        spans[first : first + len(x)] = spans[x] + spans[y]
    offsets = np.zeros(len(lengths) + 1, np.int64)
    offsets[1:][lengths > 0] = np.flatnonzero(last) + 1
    rules = [np.concatenate([np.zeros(0, np.int64), *x]) for x in (left, right)]
    return {"symbols": seq, "left": rules[0], "right": rules[1], "spans": spans[base:], "offsets": np.maximum.accumulate(offsets)}


def expand(symbols: np.ndarray, base: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The ids that symbols stand for, one level of rules after another."""
    while (inner := symbols >= base).any():
        place = np.cumsum(1 + inner) - 1 - inner
        out = np.empty(len(symbols) + int(inner.sum()), symbols.dtype)
        out[place] = symbols
        rule = symbols[inner] - base
        out[place[inner]], out[place[inner] + 1] = left[rule], right[rule]
        symbols = out
    return symbols


def expand_all(symbols: np.ndarray, base: int, left: np.ndarray, right: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """As `expand`, for a whole block: each rule is expanded once, and symbols are copied from there."""
    if spans.sum() > 4 * len(symbols):
        return expand(symbols, base, left, right)
    flat = expand(np.arange(base, base + len(left)), base, left, right)
    inner = symbols >= base
    rule = symbols[inner] - base
    count = np.ones(len(symbols), np.int64)
    count[inner] = spans[rule]
    first = np.cumsum(spans) - spans
    ends = np.cumsum(count)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.int64)
    out[ends[~inner] - 1] = symbols[~inner]
    sizes = count[inner]
    within = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(ends[inner] - sizes, sizes) + within] = flat[np.repeat(first[rule], sizes) + within]
    return out


def _narrow(x: np.ndarray) -> bytes:
    """Little-endian unsigned integers: 16 bits with a leading 2, or 32 with a leading 4."""
    return b"\x02" + x.astype("<u2").tobytes() if not len(x) or x.max() < 65536 else b"\x04" + x.astype("<u4").tobytes()


def _wide(x: bytes) -> np.ndarray:
    return np.frombuffer(x, f"<u{x[0]}", offset=1).astype(np.int64)


def decode_document(row, k: int, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids [first, last) of the k-th document of a block, from the symbols that cover them alone."""
    base, left, right, spans = row["base"], *(_wide(row[c]) for c in ("left", "right", "spans"))
    offsets = _wide(row["offsets"])
    symbols = _wide(row["symbols"])[offsets[k] : offsets[k + 1]]
    size = np.where(symbols >= base, spans[np.maximum(symbols - base, 0)] if len(spans) else 1, 1)
    ends = np.cumsum(size)
    last = int(ends[-1]) if last is None else last
    a, b = np.searchsorted(ends, first, side="right"), np.searchsorted(ends, last, side="left") + 1
    skipped = int(ends[a - 1]) if a else 0
    return expand(symbols[a:b], base, left, right)[first - skipped : last - skipped]


def _pack(path: str, block_tokens: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, shard, block, start = encoder(path), TaskContext.get().partitionId(), 0, 0
        base = own.tokenizer.get_vocab_size()
        ids, parts, held = [], [], 0

        def row() -> pa.RecordBatch:
            lengths = np.concatenate([n for _, n in parts])
            found = repair(np.concatenate([p for p, _ in parts]), lengths, base)
            values = [shard, block, start, held, base, ids, *(_narrow(x) for x in (lengths, *(found[c] for c in ("offsets", "left", "right", "spans", "symbols"))))]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), *[pa.binary()] * 6]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], [c.split()[0] for c in FILE.split(", ")])

        for batch in batches:
            texts = batch.column(1)
            for a, b in portions_of(pc.fill_null(pc.binary_length(texts), 0).to_pylist(), PORTION):
                found, lengths = own.encode(texts[a:b])
                ids += batch.column(0)[a:b].to_pylist()
                parts.append((found.astype(np.int32), lengths))
                held += len(found)
                pa.default_memory_pool().release_unused()
                if held >= block_tokens:
                    yield row()
                    start, block, ids, parts, held = start + held, block + 1, [], [], 0
        if parts:
            yield row()

    return pack


def write(docs: DataFrame, path: str, tokenizer: str, id: str = "doc_id", text: str = "text", block_tokens: int = BLOCK_TOKENS) -> None:
    """Write the token file of docs to path, in ascending order of id. The last two columns of the order only deal rows of one id; equal rows are alike."""
    rows = docs.select(docs[id].cast("long").alias("id"), docs[text].alias("text"), F.xxhash64(docs[text]).alias("hash"), F.monotonically_increasing_id().alias("at"))
    dealt = rows.repartitionByRange("id", "hash", "at").sortWithinPartitions("id", "hash", "text").select("id", "text")
    blocks = dealt.mapInArrow(_pack(tokenizer, block_tokens), FILE)
    save(blocks, path)


def read(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """(id, start, n_tokens, ids_crc32 and, if asked for, ids) of each document of a token file. The prefix sums have one row for each shard, of which
    there are as many as the writing job had tasks, so they are broadcast."""
    blocks = spark.read.schema(FILE).parquet(path)
    order = Window.partitionBy(F.lit(0)).orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n")).select("shard", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))
    rows = blocks.join(F.broadcast(before), "shard").withColumn("start", F.col("start") + F.col("before")).drop("before", "shard", "block", "n_tokens", "offsets")
    return rows.mapInArrow(_unpack(with_ids), "id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def _unpack(with_ids: bool):
    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lengths = _wide(row["lengths"])
                ids = expand_all(_wide(row["symbols"]), row["base"], *(_wide(row[c]) for c in ("left", "right", "spans"))).astype("<u4")
                ends = np.cumsum(lengths)
                buffer = memoryview(ids).cast("B")
                sums = [zlib.crc32(buffer[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                for a in range(0, len(lengths), 2000):
                    b = min(a + 2000, len(lengths))
                    columns = [pa.array(row["doc_ids"][a:b], pa.int64()), pa.array(row["start"] + ends[a:b] - lengths[a:b]), pa.array(lengths[a:b]), pa.array(sums[a:b], pa.int64())]
                    if with_ids:
                        columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths[a:b]))), pa.int32()), pa.array(ids[ends[a] - lengths[a] : ends[b - 1]].astype(np.int32))))
                    yield pa.RecordBatch.from_arrays(columns, ["id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    return unpack
