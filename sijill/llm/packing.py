"""Best-fit packing of tokenised documents into sequences, with certified bin counts.

Pieces (documents; only longer ones are cut) are dealt to groups of bounded size. Each group runs best-fit decreasing and
computes lower bounds by dual feasible functions. Where the bound equals the bin count the group is certified: no packing
of these pieces needs fewer bins. A group with a gap gives up the documents of all bins that are not full, a certified one
those of its emptiest bin; what was given up is exchanged, grouped anew and packed again, as long as an exchange saves a
``GAIN`` of the bins that went into it. ``certified`` says of a piece's last group that its bins are
as few as its bound; ``certificate`` sums bins and bounds up.

Defined cases: a null text is empty and has just the end token; an empty table gives an empty result; repeated rows are
packed each on its own; the id may be null or repeat (pieces are dealt by their place, not by the id).
"""

from __future__ import annotations

import itertools
import json
import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE, arrow_schema, read_table, write_table

CAPACITY = 1024
END_ID = 2
GROUP = 4000
#: The share of the exchanged bins that an exchange must save for another to follow.
GAIN = 0.001

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, place long"
PACKED = f"{PIECES}, sequence_id long, offset long, final boolean, bins long, bound long"


class Encoder:
    """The ids of the tokenizer at ``path`` (a file of the tokenizers library), as little-endian 32-bit bytes.

    A byte-level BPE whose ids follow its merges is run by tiktoken on the vocabulary in that file, which gives the same ids
    sooner; its splitting pattern without the look-ahead serves where no two white-space characters meet, as there it splits
    alike. Texts that may hold a special token, and tokenizers of other kinds, go through the tokenizers library itself.
    """

    #: Fixed value: the splitting pattern of byte-level BPE.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        self.special = sorted(t["content"] for t in told.get("added_tokens") or ())
        self.full = self.plain = None
        if ranks := self._ranks(told):
            import tiktoken

            make = lambda name, pattern: tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            self.full, self.plain = make("full", self.PATTERN), make("plain", self.PATTERN.replace(r"|\s+(?!\S)", ""))
        self.gap = re.compile(r"\s\s")

    def _ranks(self, told: dict) -> dict[bytes, int] | None:
        """Byte sequences to ids, if the file is a plain byte-level BPE whose merges are in the order of their ids."""
        model, split = told["model"], told.get("pre_tokenizer") or {}
        plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if not plain or told.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
            return None
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
        vocab = model["vocab"]
        merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        if any(x >= y for x, y in zip(merged, merged[1:], strict=False)):
            return None
        return {bytes(byte_of[c] for c in t): i for t, i in vocab.items() if t not in self.special}

    def encode(self, text: str | None) -> bytes:
        t = text or ""
        if self.full is None or any(s in t for s in self.special):
            return array("I", self.tokenizer.encode(t, add_special_tokens=False).ids).tobytes()
        return array("I", (self.full if self.gap.search(t) else self.plain).encode_ordinary(t)).tobytes()


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each worker process."""
    return Encoder(path)


def tokenize(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of each document, without their places; with_ids: and their ids (array<int>). The first piece is the short one."""
    schema = PIECES + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, place, end = encoder(path), TaskContext.get().partitionId() << 40, array("I", [END_ID]).tobytes()
        out = arrow_schema(schema)
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE):
                ids, texts = (c.to_pylist() for c in batch.slice(k, SLICE).columns)
                rows = []
                for d, t in zip(ids, texts, strict=True):
                    b = own.encode(t) + end
                    n = len(b) // 4
                    first = n % capacity or capacity
                    cuts = [0, *range(first, n + 1, capacity)]
                    for j in range(len(cuts) - 1):
                        x = b[4 * cuts[j] : 4 * cuts[j + 1]]
                        rows.append((d, j, cuts[j], len(x) // 4, zlib.crc32(x), place, *([np.frombuffer(x, dtype="<u4").astype(np.int32)] if with_ids else [])))
                        place += 1
                cols = list(zip(*rows, strict=True)) or [[]] * len(out)
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, out.types, strict=True)], schema=out)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """The best of two families of dual feasible functions over counts[w], the number of pieces of w tokens."""
    w = np.arange(capacity + 1)
    best = -(-int((counts * w).sum()) // capacity)
    for k in range(1, 33):
        scaled = np.where((k + 1) * w % capacity == 0, w * k, (k + 1) * w // capacity * capacity)
        best = max(best, -(-int((counts * scaled).sum()) // (k * capacity)))
    many, mass = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(counts * w)])
    for p in range(1, capacity // 2 + 1):
        large = many[capacity + 1] - many[capacity - p + 1]
        best = max(best, -(-int(large * capacity + mass[capacity - p + 1] - mass[p]) // capacity))
    return best


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each piece, by best-fit decreasing. One bit for each gap that some bin has finds the tightest at once."""
    bins, offsets = [0] * len(lengths), [0] * len(lengths)
    gaps: dict[int, list[int]] = defaultdict(list)
    mask, n = 0, 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        w = lengths[i]
        fit = mask >> w
        if fit:
            gap = (fit & -fit).bit_length() - 1 + w
            b = gaps[gap].pop()
            if not gaps[gap]:
                mask &= ~(1 << gap)
        else:
            gap, b = capacity, n
            n += 1
        bins[i], offsets[i] = b, capacity - gap
        if left := gap - w:
            gaps[left].append(b)
            mask |= 1 << left
    return bins, offsets


def pack_group(lengths: list[int], capacity: int) -> tuple[list[int], list[int], list[bool], int, int]:
    """Bins, offsets, whether the bin stays, the number of bins and its lower bound."""
    bins, offsets = best_fit(lengths, capacity)
    n = max(bins, default=-1) + 1
    bound = lower_bound(np.bincount(np.array(lengths, dtype=np.int64), minlength=capacity + 1), capacity)
    fill = [0] * n
    for b, w in zip(bins, lengths, strict=True):
        fill[b] += w
    emptiest = min(range(n), key=lambda b: (fill[b], b), default=-1)
    given = {b for b in range(n) if fill[b] < capacity and (n > bound or b == emptiest)}
    return bins, offsets, [b not in given for b in bins], n, bound


def pack(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """The pieces with sequence_id and offset, and of their last group the bins, their lower bound and whether they meet."""

    def run(key, table):
        g, turn = key[0].as_py(), key[1].as_py()
        bins, offsets, final, n, bound = pack_group(table["length"].to_pylist(), capacity)
        base = (turn << 48) + (g << 16)
        cols = [table[c] for c in table.column_names if c in PIECES.replace(",", "").split()]
        return pa.Table.from_arrays([*cols, pa.array([base + b for b in bins], pa.int64()), pa.array(offsets, pa.int64()), pa.array(final), pa.array([n] * len(bins), pa.int64()), pa.array([bound] * len(bins), pa.int64())], schema=arrow_schema(PACKED))

    done: list[DataFrame] = []
    left, rows, before = pieces, pieces.count(), None
    for turn in itertools.count():
        groups = max(1, -(-rows // group))
        dealt = left.withColumns({"g": F.pmod(F.xxhash64(F.lit(turn), "place", "ids_crc32", "doc_id", "piece"), F.lit(groups)), "turn": F.lit(turn)})
        packed = write_table(dealt.groupBy("g", "turn").applyInArrow(run, PACKED), "packed")
        each = packed.groupBy("sequence_id").agg(F.bool_and("final").alias("final"), F.count("*").alias("rows"))
        got = each.agg(F.count("*").alias("bins"), F.count_if(~F.col("final")).alias("open"), F.sum(F.when(~F.col("final"), F.col("rows"))).alias("rows")).first()
        if got["open"] <= 1 or groups == 1 or before is not None and before - got["bins"] < GAIN * before:
            done.append(packed)
            break
        done.append(packed.where("final"))
        left, rows, before = packed.where("not final").select(*pieces.columns), got["rows"], got["open"]
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.drop("final").withColumn("certified", F.col("bins") == F.col("bound"))


def certificate(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: the sequences that packed has, the least that any packing of its pieces needs by their total length, and the gap."""
    total = packed.agg(F.countDistinct("sequence_id").alias("sequences"), F.coalesce(F.sum("length"), F.lit(0)).alias("tokens"))
    least = F.ceil(F.col("tokens") / capacity).cast("long")
    return total.select("sequences", least.alias("least"), (F.col("sequences") - least).alias("gap"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    return pack(write_table(tokenize(docs, path, capacity), "pieces"), capacity)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_documents(read_table(spark, sf_dir, "documents"), tokenizer_path())
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "bins", "bound", "certified")
