"""Token ids in a compact binary file format: canonical length-limited Huffman codes."""

from __future__ import annotations

import itertools
import os
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ternweave.llm.common import discard, folder, kept_by, portions, slices, store

END = 1
MAX_BITS = 18
#: Tokens of a block (a longer document is a block of its own) and between two bit-offset checkpoints.
BLOCK, STEP = 131_072, 256
MAGIC = b"HUF1"
#: Number of the range of the rows that hold a task's counts of ids.
COUNTS = -1
CHARS = 2_000_000

#: The pre-tokens of the word tokenizer in text without the characters below, on which Unicode tables might differ.
PIECES = re.compile(r"[^\W\d_]+|'(?:s|t|re|ve|m|ll|d)|\d|(?:[^\s\w]|_)+")
UNSURE = re.compile("[^\t\n\r -~À-ɏ]")
ASCII_OK = bytes([9, 10, 13, *range(32, 127)])
#: Bytes of words and ids that a Python worker remembers.
REMEMBERED = 96 * 2 ** 20


def unsure(text: str) -> bool:
    """Whether UNSURE is found in the text."""
    left = text.encode().translate(None, ASCII_OK)
    return bool(left) and (text.isascii() or UNSURE.search(left.decode()) is not None)


class Ragged:
    """Arrays of ids by name, in one flat array."""

    def __init__(self):
        self.index: dict[str, int] = {}
        self.flat, self.start, self.size, self.used = np.zeros(1024, np.uint32), np.zeros(256, np.int64), np.zeros(256, np.int64), 0

    def add(self, names: list[str], flat: np.ndarray, sizes: np.ndarray) -> None:
        n, m = len(self.index), len(names)
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + m > len(self.start):
            self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
        self.flat[self.used:self.used + len(flat)] = flat
        self.start[n:n + m], self.size[n:n + m] = self.used + np.cumsum(sizes) - sizes, sizes
        self.index.update(zip(names, range(n, n + m), strict=True))
        self.used += len(flat)

    def numbers(self, names: list[str]) -> np.ndarray:
        return np.fromiter(map(self.index.__getitem__, names), np.int64, len(names))

    def get(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all, sizes)."""
        size = self.size[numbers]
        end = np.cumsum(size)
        total = int(end[-1]) if len(end) else 0
        return self.flat[np.repeat(self.start[numbers] - end + size, size) + np.arange(total)], size


class Encoder:
    """Ids of whole texts as the tokenizers library gives them for a word-level file.

    White space always parts pre-tokens, and merges stay within a pre-token.  So the library encodes
    each pre-token once, and the ids of words are remembered.  Words with
    characters on which Unicode tables might differ go to the library as they stand, and so
    does every text that may hold a special token."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.special = {t.content[:2] for t in self.tokenizer.get_added_tokens_decoder().values()}
        n = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.ends = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(n)])
        self.words, self.bytes, self.again = Ragged(), 0, np.zeros(256, bool)

    def _forget(self) -> None:
        """Forget the words that have not been met again since they were learned or kept; all, if the others take more than half of the space."""
        old, keep = self.words, np.flatnonzero(self.again[:len(self.words.index)])
        names = list(old.index)
        self.words, self.bytes, self.again = Ragged(), 0, np.zeros(256, bool)
        self._keep([names[i] for i in keep.tolist()], *old.get(keep))
        if self.bytes > REMEMBERED // 2:
            self.words, self.bytes = Ragged(), 0

    def _keep(self, names: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        self.words.add(names, ids, sizes)
        self.bytes += sum(map(len, names)) + 170 * len(names) + 4 * len(ids)       # a string, its hash entry, its place

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn_pieces(self, new: list[str]) -> None:
        for i in range(0, len(new), 5000):
            part = new[i:i + 5000]
            ids = np.array(self._library([" ".join(part)])[0], np.uint32)
            last = np.flatnonzero(self.ends[ids])
            if len(last) == len(part) and (not len(ids) or last[-1] == len(ids) - 1):
                sizes = np.diff(np.append(-1, last))
            else:
                each = self._library(part)
                ids, sizes = np.array([x for e in each for x in e], np.uint32), np.array([len(e) for e in each], np.int64)
            self._keep(part, ids, sizes)

    def _learn(self, new: list[str]) -> None:
        """A piece is a word of its own; other words are put together from theirs."""
        plain = [w for w in new if w.isalpha() and not UNSURE.search(w)]
        rest = set(new).difference(plain)
        other = [w for w in rest if UNSURE.search(w)]
        mixed = list(rest.difference(other))
        split = [PIECES.findall(w) for w in mixed]
        self._learn_pieces(list(set().union(plain, *split).difference(self.words.index)))
        more = [i for i, w in enumerate(mixed) if w not in self.words.index]
        split = [split[i] for i in more]
        ids, sizes = self.words.get(self.words.numbers([p for s in split for p in s]))
        owner = np.repeat(np.arange(len(split)), [len(s) for s in split])
        self._keep([mixed[i] for i in more], ids, np.bincount(owner, sizes, minlength=len(more)).astype(np.int64))
        each = self._library(other)
        self._keep(other, np.array([x for e in each for x in e], np.uint32), np.array([len(e) for e in each], np.int64))

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        if self.bytes > REMEMBERED:
            self._forget()
        whole = [any(s in t for s in self.special) for t in texts]
        odd = [not w and unsure(t) for t, w in zip(texts, whole, strict=True)]
        split = [[c for x in t.split(" ") for c in ([x] if UNSURE.search(x) else x.lower().split())] if o else [] for t, o in zip(texts, odd, strict=True)]
        plain = pc.ascii_split_whitespace(pa.array(["" if w or o else t.lower() for t, w, o in zip(texts, whole, odd, strict=True)], pa.large_string()))
        names = pc.list_flatten(plain).dictionary_encode()
        n, distinct = pc.list_value_length(plain).to_numpy(), names.dictionary.to_numpy(zero_copy_only=False).tolist()
        number = self._numbers(distinct + list(itertools.chain.from_iterable(split)))
        number, other = number[:len(distinct)][names.indices.to_numpy()], number[len(distinct):]
        if len(other):
            more = np.array([len(s) for s in split], np.int64)
            number = np.insert(number, np.repeat(np.cumsum(n), more), other)
            n = n + more
        ids, sizes = self.words.get(number)
        edge = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum(n, dtype=np.int64)]
        out = np.split(ids, edge[:-1]) if len(edge) else []
        return [np.array(self._library([t])[0], np.uint32) if w else x for t, w, x in zip(texts, whole, out, strict=True)]

    def _numbers(self, names: list[str]) -> np.ndarray:
        """Places of the words, which are learned if they are new; an empty one has no ids."""
        number = np.fromiter(map(self.words.index.get, names, itertools.repeat(-1)), np.int64, len(names))
        if len(self.again) < len(self.words.index):
            self.again = np.concatenate([self.again, np.zeros(len(self.words.start) - len(self.again), bool)])
        self.again[number[number >= 0]] = True
        if len(missing := np.flatnonzero(number < 0)):
            unknown = [names[i] for i in missing.tolist()]
            self._learn(list(set(unknown)))
            number[missing] = self.words.numbers(unknown)
        return number


def encoder_of(path: str) -> Encoder:
    """The encoder of a file; a Python worker keeps it from task to task."""
    kept = kept_by("token_binary")
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


# ---- code ------------------------------------------------------------------------------------

def code_lengths(counts: np.ndarray, most: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``most`` bits (package-merge); 0 for ids that don't occur."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        out[used] = 1
        return out
    if len(used) > 2 ** most:
        raise ValueError(f"{len(used)} ids do not fit codes of {most} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.float64)
    levels, now = [], weight
    for _ in range(most - 1):
        pairs = now[: len(now) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([weight, pairs])
        rank = np.argsort(both, kind="stable")
        levels.append(rank < len(weight))
        now = both[rank]
    take = 2 * len(used) - 2
    lengths = np.zeros(len(used), np.int64)
    for single in reversed(levels):
        n = int(single[:take].sum())
        lengths[:n] += 1
        take = 2 * (take - n)
    lengths[:take] += 1
    out[order] = lengths
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes: shorter first, then by id."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    left = np.concatenate([[0], np.cumsum(2.0 ** -lengths[order].astype(np.float64))[:-1]])
    codes = np.zeros(len(lengths), np.uint64)
    codes[order] = (left * 2.0 ** lengths[order]).astype(np.uint64)
    return codes


class Code:
    """Encoding and decoding with one canonical code, given by its lengths alone."""

    def __init__(self, lengths: np.ndarray):
        self.lengths, self.codes = lengths, canonical(lengths)
        self.bits = max(1, int(lengths.max(initial=1)))
        order = np.lexsort((np.arange(len(lengths)), lengths))
        order = order[lengths[order] > 0]
        spans = 2 ** (self.bits - lengths[order].astype(np.int64))
        fill = 2 ** self.bits - int(spans.sum())
        self.table_id = np.append(np.repeat(order, spans), np.zeros(fill, np.int64)).astype(np.uint32)
        self.table_len = np.append(np.repeat(lengths[order], spans), np.ones(fill, np.uint8)).astype(np.int64)

    def pack(self, ids: np.ndarray, sizes: list[int]) -> bytes:
        """One block: magic, numbers of documents, ids and checkpoints, sizes of the documents, bit
        offset of every STEP-th id, bits."""
        n = self.lengths[ids].astype(np.int64)
        end = np.cumsum(n)
        at = end - n
        total = int(end[-1]) if len(ids) else 0
        word, shift = at >> 5, (64 - (at & 31) - n).astype(np.uint64)
        value = self.codes[ids] << shift
        words = np.zeros((total + 31) // 32 + 1, np.float64)
        for part, off in ((value >> np.uint64(32), 0), (value & np.uint64(0xFFFFFFFF), 1)):
            words += np.bincount(word + off, part.astype(np.float64), minlength=len(words))[: len(words)]
        marks = at[::STEP].astype("<u4") if total < 2 ** 32 else None
        if marks is None:
            raise ValueError("a block of more than 2^32 bits")
        head = MAGIC + struct.pack("<III", len(sizes), len(ids), len(marks))
        return head + np.array(sizes, "<u4").tobytes() + marks.tobytes() + words.astype(">u4").tobytes()

    def unpack(self, blocks: list[bytes]) -> tuple[np.ndarray, list[np.ndarray]]:
        """(ids of all blocks, sizes of the documents of each block).

        The spans between checkpoints are decoded side by side: a table look-up gives the next id of
        every span at once."""
        sizes, lanes, counts, data, base = [], [], [], [], 0
        for b in blocks:
            if b[:4] != MAGIC:
                raise ValueError("not a block of token ids")
            docs, ids, marks = struct.unpack_from("<III", b, 4)
            sizes.append(np.frombuffer(b, "<u4", docs, 16))
            lanes.append(np.frombuffer(b, "<u4", marks, 16 + 4 * docs).astype(np.int64) + base)
            left = np.full(marks, STEP, np.int64)
            if marks:
                left[-1] = ids - STEP * (marks - 1)
            counts.append(left)
            body = np.frombuffer(b, np.uint8, offset=16 + 4 * (docs + marks))
            data.append(body)
            base += 8 * len(body)
        at, left = np.concatenate(lanes), np.concatenate(counts)
        raw = np.concatenate([*data, np.zeros(8, np.uint8)]).astype(np.uint32)
        window = (raw[:-3] << np.uint32(24)) | (raw[1:-2] << np.uint32(16)) | (raw[2:-1] << np.uint32(8)) | raw[3:]
        start = np.cumsum(left) - left
        out = np.zeros(int(left.sum()), np.uint32)
        drop = np.uint32(32 - self.bits)
        lane = np.arange(len(at))
        for k in range(STEP):
            if k == int(left.min(initial=STEP)) or k and len(lane) and k >= int(left[lane].min()):
                lane = lane[left[lane] > k]
            if not len(lane):
                break
            p = at[lane]
            look = (window[p >> 3] << (p & 7).astype(np.uint32)) >> drop
            out[start[lane] + k] = self.table_id[look]
            at[lane] = p + self.table_len[look]
        return out, sizes


# ---- files -----------------------------------------------------------------------------------

def dealt(docs: DataFrame, order: list[str], n: int) -> DataFrame:
    """``docs`` in ``n`` ranges of the columns ``order``, sorted, with the number of the range in ``part``.

    The ends of the ranges come from the order's columns alone, so that texts are read and shuffled once."""
    first = (docs.select(*order).repartitionByRange(n, *order).select(F.spark_partition_id().alias("part"), F.struct(*order).alias("first"))
             .groupBy("part").agg(F.min("first").alias("first")).orderBy("part").collect())              # n rows at most
    kinds = [docs.schema[c].dataType for c in order]
    ends = [F.struct(*[F.lit(v).cast(k).alias(c) for v, k, c in zip(r.first, kinds, order, strict=True)]) for r in first[1:]]
    part = F.size(F.filter(F.array(*ends), lambda end: end <= F.struct(*order))) if ends else F.lit(0)
    return docs.withColumn("part", part).repartitionById(n, F.col("part")).sortWithinPartitions("part", *order)


def encode_documents(docs: DataFrame, tokenizer: str, order: list[str], id_col: str = "doc_id", text_col: str = "text",
                     path: str | None = None, partitions: int | None = None) -> str:
    """Write the ids of all documents, in the order of the columns ``order``, and return the path.

    ``path/code`` holds one row, the code lengths; ``path/blocks`` the blocks: part,
    ids before it in the part, ids, document ids, and the block itself.  Texts are dealt
    out by range of the order and tokenized once; their plain ids are kept for the packing, beside each task's counts of the
    ids.  No task holds more than a batch and a block, and a lost task is written again as it was.  Each document's ids end with
    END.  Null is an empty text.  Rows of equal order stand in any order."""
    spark = docs.sparkSession
    path = path or folder(spark, "token-ids")
    kind = docs.schema[id_col].dataType.simpleString()
    id_type = to_arrow_type(docs.schema[id_col].dataType)
    vocabulary = _vocabulary(tokenizer)
    width = np.dtype("<u2" if vocabulary <= 2 ** 16 else "<u4")

    def tokenize(batches):
        encoder, part, before, total = encoder_of(tokenizer), None, 0, np.zeros(vocabulary, np.int64)
        for batch in slices(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            where = batch.column("part").to_numpy()
            for a, b in portions(map(len, texts), CHARS):
                for x, y in zip(*_runs(where[a:b]), strict=True):
                    if where[a + x] != part:
                        part, before = where[a + x], 0
                    ids = encoder(texts[a + x:a + y])
                    n = np.array([len(d) + 1 for d in ids], np.int64)
                    flat = np.concatenate([z for d in ids for z in (d, [END])]).astype(width)
                    total += np.bincount(flat, minlength=vocabulary)
                    data = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(np.append(0, np.cumsum(n) * width.itemsize)), pa.py_buffer(flat)])
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("part").slice(a + x, y - x), batch.column("doc_id").slice(a + x, y - x),
                         pa.array(before + np.cumsum(n) - n, pa.int64()), data.cast(pa.binary())], names=["part", "doc_id", "before", "ids"])
                    before += int(n.sum())
        yield pa.RecordBatch.from_arrays([pa.array([COUNTS], pa.int32()), pa.array([None], id_type), pa.array([0], pa.int64()),
                                          pa.array([total.tobytes()], pa.binary())], names=["part", "doc_id", "before", "ids"])

    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c).alias(f"o{i}") for i, c in enumerate(order)]
    names = [f"o{i}" for i in range(len(order))]
    plain = store(dealt(docs.select(*keys, F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), names, n)
                  .select("part", "doc_id", "text").mapInArrow(tokenize, f"part int, doc_id {kind}, before long, ids binary"), "plain-ids", "zstd")

    def count(batches):
        for batch in batches:
            for x in batch.column("ids"):
                total = np.frombuffer(x.as_buffer(), np.int64)
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["id", "n"])

    counts = np.zeros(vocabulary, np.int64)
    for r in plain.where(F.col("part") == COUNTS).select("ids").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[r.id] = r.n                                                # as many rows as the vocabulary at most
    lengths = code_lengths(counts)
    spark.createDataFrame([(bytearray(lengths.tobytes()),)], "lengths binary").coalesce(1).write.parquet(f"{path}/code")
    schema = pa.schema([("part", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(id_type)),
                        ("data", pa.binary())])

    def pack(batches):
        code, at, size, names, data = Code(lengths), None, 0, [], []

        def close():
            n = [len(d) // width.itemsize for d in data]
            return pa.RecordBatch.from_pydict({"part": [at[0]], "before": [at[1]], "n_ids": [size], "doc_ids": [names],
                                               "data": [code.pack(np.frombuffer(b"".join(data), width), n)]}, schema=schema)
        for batch in batches:
            for part, name, before, ids in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "before", "ids")), strict=True):
                if part == COUNTS:
                    continue
                more = len(ids) // width.itemsize
                if size and (at[0] != part or at[1] + size != before or size + more > BLOCK):
                    yield close()
                    size, names, data = 0, [], []
                if not size:
                    at = (part, before)
                names.append(name)
                data.append(ids)
                size += more
        if size:
            yield close()

    (plain.mapInArrow(pack, f"part int, before long, n_ids long, doc_ids array<{kind}>, data binary").write.parquet(f"{path}/blocks"))
    discard(plain)
    return path


def _runs(x: np.ndarray) -> tuple[list[int], list[int]]:
    """Beginnings and ends of the runs of equal values."""
    edge = np.flatnonzero(np.diff(x, prepend=x[0] - 1)).tolist()
    return edge, [*edge[1:], len(x)]


def _vocabulary(tokenizer: str) -> int:
    from tokenizers import Tokenizer
    return max(Tokenizer.from_file(tokenizer).get_vocab_size(with_added_tokens=True), END + 1)


def decode_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files; ``start`` counts the ids
    of all documents before it.  Only one total per part passes through the driver."""
    blocks = spark.read.parquet(f"{path}/blocks")
    lengths = np.frombuffer(bytes(spark.read.parquet(f"{path}/code").first().lengths), np.uint8)
    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()
    first = dict(zip([r.part for r in totals], np.cumsum([0] + [r.n for r in totals])[:-1].tolist(), strict=False))
    field = blocks.schema["doc_ids"].dataType.elementType
    id_type = to_arrow_type(field)

    def unpack(batches):
        code = Code(lengths)
        for batch in batches:
            parts, before, n, names, data = (batch.column(c).to_pylist() for c in ("part", "before", "n_ids", "doc_ids", "data"))
            for a, b in portions(n, 2_000_000):
                ids, sizes = code.unpack(data[a:b])
                raw = ids.astype("<u4")
                start, size, crc, place = [], [], [], 0
                for i, own in zip(range(a, b), sizes, strict=True):
                    own = own.astype(np.int64)
                    edge = np.concatenate([[0], np.cumsum(own)])
                    start += (first[parts[i]] + before[i] + edge[:-1]).tolist()
                    size += own.tolist()
                    crc += [zlib.crc32(raw[place + x:place + y].data) for x, y in zip(edge[:-1], edge[1:], strict=True)]
                    place += n[i]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x for i in range(a, b) for x in names[i]], id_type), pa.array(start, pa.int64()),
                     pa.array(size, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return blocks.select("part", "before", "n_ids", "doc_ids", "data").mapInArrow(
        unpack, f"doc_id {field.simpleString()}, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str, order: list[str] | None = None, id_col: str = "doc_id",
                text_col: str = "text", path: str | None = None) -> DataFrame:
    """Write the documents' ids to files (see :func:`encode_documents`) and read them back: one row per
    document.  By default in ascending order of ids, null first.  An empty table gives no rows."""
    return decode_documents(docs.sparkSession, encode_documents(docs, tokenizer, order or [id_col], id_col, text_col, path))
