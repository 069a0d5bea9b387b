"""Documents packed into sequences of a fixed number of tokens, with certified counts (operator 11).

1. Every text is tokenised whole (``TOKENIZER``), the end id is appended, and only documents longer
   than ``CAPACITY`` are cut into pieces. The tokenizer never joins across ASCII white space (its
   pattern matches none, and neither composition nor lower-casing reaches over it), so a text's
   ids are the ids of its white-space separated parts; a part is encoded once and remembered.
2. The pieces are dealt by hash into partitions of about ``GROUP``. Each is packed by best-fit
   decreasing and gets a lower bound of its sequences from dual feasible functions
   (Martello-Toth thresholds, alone and composed with Fekete-Schepers rounding). A partition
   whose count equals its bound is certified: nothing inside it can be packed better.
3. Partitions with a gap give up all sequences with room; certified ones give up their emptiest
   (their own rounding). The documents given up are dealt anew, so that partitions exchange
   them, and packed again; rounds go on while they save sequences.

Only lengths and checksums move, never texts. The driver sees sums over partitions.

Edge cases: a null or empty text is the end id alone; repeated rows are packed each; a null
doc_id is a document like others; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import cache, partial, reduce
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millwright.llm.common import written

TOKENIZER = "word_bpe_49k.json"     # a path, or the name of a public tokenizer
END_ID = 1
CAPACITY = 4096
GROUP = 16_384                      # pieces of a partition, about
REMEMBERED = 1_500_000              # parts of texts whose ids a worker remembers (some 160 bytes each)
ROUNDING = range(1, 21)             # parameters of the rounding functions
_SIGNS = ".,!?;:*&%$#@+-=/()[]{}|~^_"        # no letter, digit or space to the tokenizer's pattern, nor the apostrophe it treats apart
_PIECES = "doc_id long, has_id boolean, piece int, start long, length long, ids_crc32 long"     # a null id would make pandas' longs floats
_PACKED = "uid long, " + _PIECES + ", sequence_id long, offset long, certified boolean, open boolean"


# ---- tokens -----------------------------------------------------------------------------------

@cache
def _encoder(path: str):
    """The tokenizer of a file (or public name), which of its ids end a word, and this worker's memory of encoded parts."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"       # Spark's tasks share out the cores
    from tokenizers import Tokenizer

    if not os.path.exists(path):
        import public_tokenizers

        path = public_tokenizers.path(path)
    model = Tokenizer.from_file(path)
    vocabulary, suffix = model.get_vocab(), getattr(model.model, "end_of_word_suffix", None)
    ends = np.zeros(max(vocabulary.values()) + 1, bool)
    if suffix:
        ends[[k for token, k in vocabulary.items() if token.endswith(suffix)]] = True
    return model, ends, {b"": b""}


def _stem(part: bytes) -> tuple[bytes, bytes]:
    """A part as what the tokenizer sees of it: a stem, and the run of signs behind a last letter, which is a word of its own.

    Only for parts of Latin letters without the bracket of special tokens; others stay whole.
    """
    if part.isalpha():
        return part.lower(), b""
    text = part.decode()
    if "<" in text or not (text.isascii() or max(text) < "\u0100"):
        return part, b""
    text = text.lower()
    stem = text.rstrip(_SIGNS)
    if stem and stem[-1].isalpha():
        return stem.encode(), text[len(stem):].encode()
    return text.encode(), b""


def _learn(model, ends: np.ndarray, known: dict[bytes, bytes], new: list[bytes]) -> None:
    """Adds the ids of ``new`` parts: a plain word is encoded once, whatever its case and the signs behind it."""
    cut = [_stem(part) for part in new]
    wanted = [w.decode() for w in {w for pair in cut for w in pair} if w not in known]
    plain = [w for w in wanted if w.isalpha() and max(w) < "\u0100"] if ends.any() else []
    for k in range(0, len(plain), 8192):
        some = plain[k:k + 8192]
        ids = np.array(model.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
        last = np.flatnonzero(ends[ids])                    # letters only: a word each, and only its last id ends a word
        _keep(known, some, ids, np.diff(last, prepend=-1).tolist())
    other = list(set(wanted).difference(plain))
    for k in range(0, len(other), 8192):
        found = [e.ids for e in model.encode_batch_fast(other[k:k + 8192], add_special_tokens=False)]
        _keep(known, other[k:k + 8192], np.fromiter(chain.from_iterable(found), "<u4"), [len(f) for f in found])
    for part, (stem, run) in zip(new, cut, strict=True):
        known[part] = known[stem] + known[run]


def _keep(known: dict[bytes, bytes], words: list[str], ids: np.ndarray, sizes: list[int]) -> None:
    flat, at = ids.tobytes(), 0
    for w, n in zip(words, sizes, strict=True):
        known[w.encode()] = flat[at:at + 4 * n]
        at += 4 * n


def token_bytes(texts: list[str], tokenizer: str = TOKENIZER) -> Iterator[bytes]:
    """Each text's ids as little-endian unsigned 32-bit numbers, without the end id."""
    model, ends, known = _encoder(tokenizer)
    for at in range(0, len(texts), 256):
        split = [t.encode().split() for t in texts[at:at + 256]]
        if len(known) > REMEMBERED:
            known.clear()
            known[b""] = b""
        new = [part for part in set().union(*split) if part not in known]
        if new:
            _learn(model, ends, known, new)
        for parts in split:
            yield b"".join(map(known.__getitem__, parts))


def _cut(batches: Iterator[pd.DataFrame], tokenizer: str, capacity: int) -> Iterator[pd.DataFrame]:
    end = np.array([END_ID], "<u4").tobytes()
    for pdf in batches:
        rows = []
        for doc, has, ids in zip(pdf["doc_id"].tolist(), pdf["has_id"].tolist(), token_bytes(pdf["text"].tolist(), tokenizer), strict=True):
            ids += end
            for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                some = ids[at:at + 4 * capacity]
                rows.append((doc, has, piece, at // 4, len(some) // 4, zlib.crc32(some)))
        yield pd.DataFrame(rows, columns=["doc_id", "has_id", "piece", "start", "length", "ids_crc32"])


def pieces(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY) -> DataFrame:
    """(uid, doc_id, has_id, piece, start, length, ids_crc32) of every piece, written once."""
    doc = F.col("doc_id").cast("long")
    texts = docs.select(F.coalesce(doc, F.lit(0)).alias("doc_id"), doc.isNotNull().alias("has_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = texts.mapInPandas(partial(_cut, tokenizer=tokenizer, capacity=capacity), _PIECES)
    return written(found.withColumn("uid", F.monotonically_increasing_id()), "pieces")


# ---- packing one partition --------------------------------------------------------------------

def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, int]:
    """(sequence, offset) of lengths that come in descending order, and the number of sequences.

    The open sequences are kept by their room; a bit mask of the rooms in use finds the smallest that fits.
    """
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, n = 0, 0
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, need in enumerate(lengths.tolist()):
        fits = mask >> need
        if fits:
            free = need + (fits & -fits).bit_length() - 1
            seq = room[free].pop()
            if not room[free]:
                mask ^= 1 << free
        else:
            free, seq, n = capacity, n, n + 1
        where[i], offset[i] = seq, capacity - free
        left = free - need
        if left:
            room[left].append(seq)
            mask |= 1 << left
    return where, offset, n


def lower_bound(count: np.ndarray) -> int:
    """Sequences that any packing needs of ``count[x]`` pieces of x tokens: the best of a family of dual feasible functions.

    Threshold t: lengths above capacity - t count as full, those below t as nothing; between
    them the length itself, or its rounding floor((k+1)x)/k (x itself where (k+1)x is whole).
    """
    capacity = len(count) - 1
    x = np.arange(capacity + 1, dtype=np.int64)
    t = np.arange(0, capacity // 2 + 1)
    big = count.sum() - np.cumsum(count)[capacity - t]
    best = 0
    for k in (0, *ROUNDING):
        unit = capacity * max(k, 1)
        value = x if k == 0 else np.where((k + 1) * x % capacity == 0, k * x, capacity * ((k + 1) * x // capacity))
        mass = np.concatenate(([0], np.cumsum(count * value)))
        between = mass[capacity - t + 1] - mass[t]
        best = max(best, -int((-(big * unit + between) // unit).min()))
    return best


def _pack(pdf: pd.DataFrame, turn: int, capacity: int) -> pd.DataFrame:
    pdf = pdf.sort_values(["length", "uid"], ascending=[False, True], ignore_index=True)
    lengths = pdf["length"].to_numpy(np.int64)
    where, offset, n = best_fit_decreasing(lengths, capacity)
    fill = np.bincount(where, weights=lengths, minlength=n).astype(np.int64)
    certified = n == lower_bound(np.bincount(lengths, minlength=capacity + 1))
    gives = fill < capacity if not certified else (np.arange(n) == fill.argmin()) & (fill < capacity)
    group = int(pdf["_group"].iloc[0])
    return pdf.drop(columns="_group").assign(sequence_id=(turn << 48) + (group << 24) + where, offset=offset, certified=certified, open=gives[where])


def _packer(turn: int, capacity: int):
    return lambda pdf: _pack(pdf, turn, capacity)


# ---- all partitions ---------------------------------------------------------------------------

def pack(found: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """``pieces`` with their sequence_id, offset and whether their partition is certified."""
    names = [c for c in _PACKED.replace(",", "").split() if c in found.columns]
    settled: list[DataFrame] = []
    todo, n, before, turn = found.select(*names), found.count(), None, 0
    while True:
        groups = max(1, -(-n // group))
        dealt = todo.withColumn("_group", F.pmod(F.xxhash64("uid", F.lit(turn)), F.lit(groups)))
        got = written(dealt.groupBy("_group").applyInPandas(_packer(turn, capacity), _PACKED), "packed")
        sums = got.agg(F.expr("count_if(offset = 0) n"), F.expr("count_if(open and offset = 0) open"), F.expr("count_if(open) pieces")).first()
        if before is not None:
            last, gave = before
            if sums["n"] >= gave:                 # the exchange saved nothing: the former packing stays
                settled.append(last)
                break
            settled.append(last.filter("not open"))
        if groups == 1 or sums["open"] <= 1:
            settled.append(got)
            break
        before = (got, sums["open"])
        todo, n, turn = got.filter("open").select(*names), sums["pieces"], turn + 1
    rows = reduce(DataFrame.unionByName, settled)
    return rows.withColumn("doc_id", F.when(F.col("has_id"), F.col("doc_id"))).drop("uid", "has_id", "open")


def certificate(packed: DataFrame, capacity: int = CAPACITY) -> tuple[int, int]:
    """(sequences, lower bound of any packing) of a whole packing; at most ``capacity`` sums reach the driver."""
    sizes = packed.groupBy("length").agg(F.count(F.lit(1)).alias("n"), F.expr("count_if(offset = 0) first")).collect()
    count = np.zeros(capacity + 1, np.int64)
    for r in sizes:
        count[r["length"]] = r["n"]
    return sum(r["first"] for r in sizes), lower_bound(count)


def sequences(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, certified."""
    return pack(pieces(docs, tokenizer, capacity), capacity)


def token_ids(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, ids) with the end id: the tokens that the packing's rows point into."""
    @F.pandas_udf("array<long>")
    def encode(texts: pd.Series) -> pd.Series:
        return pd.Series([[*np.frombuffer(b, "<u4").tolist(), END_ID] for b in token_bytes(texts.tolist(), tokenizer)], dtype=object)

    return docs.select("doc_id", encode(F.coalesce("text", F.lit(""))).alias("ids"))


def filled(spark: SparkSession, packed: DataFrame, ids: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed sequences themselves, for documents whose doc_id is unique."""
    parts = packed.join(ids, "doc_id").select("sequence_id", "offset", F.slice("ids", F.col("start").cast("int") + 1, F.col("length").cast("int")).alias("part"))
    return parts.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "part"))), lambda p: p["part"])).alias("ids"))
