"""Packing: mixture-controlled, deficit round-robin over source queues (operator 4).

Each source is a queue of documents. A window of ``window`` tokens gives each
queue a quantum of its share (``targets``, or by default the source's share of
the corpus, so that all queues last to the end); a document is served in the first window in
which the quanta so far cover it, and what a queue is still due is carried over
to the next window. For a queue that is never empty this is a closed form of
the tokens queued before a document, so windows and deficits come from prefix
sums and no partition waits for another: queues are cut into hashed buckets
(a hot source into as many as the rows ask for), the buckets' sums carry the
deficits across partitions. With targets the time a queue takes is its tokens by
its weight, and windows follow the tokens that all queues have got by a time, a
sum of one bounded line for each target: so queues that run dry need no rounds
of their own either. Windows follow each other in one stream of tokens,
cut into sequences of ``length``; only the last sequence is padded.

Documents are encoded once; ids travel compressed, through a written table that
also fixes the queue for recomputed tasks.

Defined results
* null or empty text: a document of the end id alone; null source: a queue too,
  apart from that of the source ""
* rows that repeat are documents of their own
* a text's control strings are ordinary text; empty table: empty result
* other columns are never read
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiweave.llm.common import small_batches, stored

LENGTH = 2048
END_ID = 1
WINDOW = 64 * LENGTH
CACHED = 100_000
LONGEST_KEPT = 64
#: The faster engine puts each white space of a run on a stack that holds a million.
LONGEST_RUN = 500_000
SAFE = re.compile(r"(?<![\s᠎​⁠﻿]) (?![\s᠎​⁠﻿])")
#: White space other than space and line feed, and what some count as such.
ODD = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0 ᠎           ​    ⁠　﻿"


def default_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def load_tokenizer(path: str, control: bool = False):
    """control: whether control strings in a text become control ids."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.encode_special_tokens = not control
    return out


#: The pattern by which byte-level vocabularies cut texts, a fixed value.
CUTS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def ranked(path: str, load=None):
    """A faster engine for a tokenizer file that is plain byte-level BPE with ids in the order of its merges; else None.

    Such a file's ids are the ranks that the engine needs, and both give the same ids.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, cutter = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and not spec.get("normalizer") and cutter.get("type") == "ByteLevel" and cutter.get("use_regex", True) and not cutter.get("add_prefix_space")
    if not plain or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return None
    vocab = model["vocab"]
    order = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["merges"]]
    if any(b <= a for a, b in zip(order, order[1:], strict=False)):
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in shown)}
    import tiktoken

    ranks = {bytes(byte_of[c] for c in token): i for token, i in vocab.items()}
    control = {x["content"]: x["id"] for x in spec.get("added_tokens") or []}
    return tiktoken.Encoding(os.path.basename(path), pat_str=CUTS, mergeable_ranks=ranks, special_tokens=control)


class Encoder:
    """ids of whole texts. A plain byte-level file is run by a faster engine,
    which takes each text whole and keeps nothing; tests hold the ids against
    the tokenizer's own. With other files pieces are kept: the tokenizer's own
    cuts always fall at a space between two other than white space, so pieces
    between such spaces are encoded apart, up to CACHED of them and none longer
    than LONGEST_KEPT characters kept for the next texts."""

    def __init__(self, path: str):
        self.tokenizer = load_tokenizer(path)
        self.engine = ranked(path)
        self.kept: dict[str, bytes] = {}
        self.type = "<u2" if self.tokenizer.get_vocab_size() <= 65536 else "<u4"
        self.opens = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.opens[i] = token.startswith("\u0120")  # a space, in byte-level vocabularies

    def one(self, text: str) -> np.ndarray:
        if self.engine and not (len(text) >= LONGEST_RUN and any(m.end() - m.start() >= LONGEST_RUN for m in re.finditer(r"\s+", text))):
            return self.engine.encode_to_numpy(text, disallowed_special=()).astype(self.type)
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.type)

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [self.one(x).tobytes() for x in texts]

    def _keep(self, pieces: list[str]) -> None:
        """Encode pieces that follow a space. Many are put in one text, which is
        cut again where a token opens with a space; odd ones go by themselves."""
        plain = [x for x in pieces if " " not in x and not x[:1].isspace() and not x[-1:].isspace() and x]
        for lo in range(0, len(plain), 1000):
            some = plain[lo : lo + 1000]
            ids = self.one(" " + " ".join(some))
            cuts = np.flatnonzero(self.opens[ids])
            if len(cuts) != len(some) or (len(cuts) and cuts[0]):
                self.kept.update(zip(some, self._ids([" " + x for x in some]), strict=True))
                continue
            data, width = ids.tobytes(), ids.itemsize
            ends = [*(cuts[1:] * width).tolist(), len(data)]
            self.kept.update({x: data[a:b] for x, a, b in zip(some, (cuts * width).tolist(), ends, strict=True)})
        if len(plain) < len(pieces):
            rest = list(set(pieces) - set(plain))
            self.kept.update(zip(rest, self._ids([" " + x for x in rest]), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian ids of each text, of the width of self.type."""
        if self.engine:
            return self._ids(texts)
        if len(self.kept) > CACHED:
            self.kept.clear()
        get = self.kept.get
        split = [self.pieces(x) for x in texts]
        found = [list(map(get, parts[1:])) for parts in split]
        missing = {p for parts, got in zip(split, found, strict=True) if None in got for p, g in zip(parts[1:], got, strict=True) if g is None}
        self._keep(list(missing))
        heads = self._ids([parts[0] for parts in split])
        out = [h + b"".join(got if None not in got else [g if g is not None else get(p) for p, g in zip(parts[1:], got, strict=True)]) for h, parts, got in zip(heads, split, found, strict=True)]
        for p in missing:
            if len(p) > LONGEST_KEPT:
                del self.kept[p]
        return out

    @staticmethod
    def pieces(text: str) -> list[str]:
        odd = "  " in text or " \n" in text or "\n " in text or text[:1] == " " or text[-1:] == " " or any(c in text for c in ODD)
        return SAFE.split(text) if odd else text.split(" ")


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each Python worker, which serves many tasks."""
    return _encoders.get(path) or _encoders.setdefault(path, Encoder(path))


def forget_pieces() -> None:
    """Give back what the encoders of this worker keep: workers outlive their stage, and the next ones need the memory."""
    for coder in _encoders.values():
        coder.kept = {}


def _tokenizing(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        coder, press = encoder(path), zstandard.ZstdCompressor(level=1)
        width, end = int(coder.type[-1]), np.array([end_id], coder.type).tobytes()
        for batch in batches:
            ids = [x + end for x in coder.encode([x or "" for x in batch.column(3).to_pylist()])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array([len(x) // width for x in ids], pa.int64()), pa.array([press.compress(x) for x in ids], pa.binary())],
                ["rid", "k", "source", "n", "ids"],
            )

    return run


def _cutting(length: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        forget_pieces()
        unpress = zstandard.ZstdDecompressor()
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
        for batch in batches:
            rows: list[list] = [[] for _ in schema]
            for k, n, at, packed in zip(*(batch.column(c).to_pylist() for c in ("k", "n", "at", "ids")), strict=True):
                ids = np.frombuffer(unpress.decompress(packed, max_output_size=n * width), f"<u{width}").astype("<u4").tobytes()
                start = 0
                while start < n:
                    sequence, offset = divmod(at + start, length)
                    size = min(n - start, length - offset)
                    for column, x in zip(rows, (k, start, size, ids[4 * start : 4 * (start + size)], n, sequence, offset), strict=True):
                        column.append(x)
                    start += size
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(rows, schema, strict=True)], schema=schema)

    return run


def tokenize(docs: DataFrame, path: str, id_col: str, text_col: str, source_col: str, end_id: int) -> DataFrame:
    """rid (of the row), k, source, n, ids; written to the shared folder."""
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("k"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"))
    return stored(rows.mapInArrow(_tokenizing(path, end_id), "rid bigint, k bigint, source string, n bigint, ids binary"), "tokens")


def queue_of(source) -> str:
    """The name of a source's queue; no source is a queue of its own."""
    return "-" if source is None else f"+{source}"


def turns(totals: dict[str, int], unlisted: int, targets: dict[str | None, float]) -> tuple[list[tuple[str | None, float, int]], dict]:
    """How targets share out windows: (queue, or None for all unlisted ones, weight, tokens) of those that have tokens, and
    the token at which each of them runs dry, by name. Weights add up to 1; what a dry queue would get goes to the others in proportion."""
    if not targets or any(x <= 0 for x in targets.values()):
        raise ValueError("targets have to be positive")
    whole = sum(targets.values())
    rest = 1 - whole if unlisted else 0.0
    if unlisted and rest <= 1e-9:
        raise ValueError("targets that add up to 1 or more leave nothing for sources without one")
    weights = [(queue_of(k), x / (whole + rest), totals.get(queue_of(k), 0)) for k, x in targets.items()] + ([(None, rest / (whole + rest), unlisted)] if unlisted else [])
    queues = [q for q in weights if q[2]]
    dry = {q: round(sum(min(w * t / weight, n) for _, w, n in queues)) for q, weight, t in queues}
    return queues, dry


def schedule(queued: DataFrame, window: int, targets: dict[str | None, float] | None = None, rows_per_bucket: int = 2000) -> DataFrame:
    """rid and at: the place of each document's first token in the stream. queued: rid, k, source, n."""
    sums = queued.agg(F.count("*").alias("rows"), F.sum("n").alias("tokens")).first()
    if not sums["rows"]:
        return queued.select("rid", F.lit(0).cast("long").alias("at"))
    buckets = max(1, min(65536, sums["rows"] // rows_per_bucket))
    name = F.coalesce(F.concat(F.lit("+"), "source"), F.lit("-"))
    rows = queued.select("rid", name.alias("s"), "n", F.pmod(F.xxhash64("rid", "k"), F.lit(buckets)).alias("b"))
    order = Window.partitionBy("s").orderBy("b")
    carried = rows.groupBy("s", "b").agg(F.sum("n").alias("sum"))
    carried = carried.select("s", "b", (F.sum("sum").over(order) - F.col("sum")).alias("carry"), F.sum("sum").over(Window.partitionBy("s")).alias("total"))
    inside = Window.partitionBy("s", "b").orderBy("rid")
    rows = rows.withColumn("upto", F.sum("n").over(inside)).join(carried, ["s", "b"])
    if targets is None:
        quantum = F.lit(float(window)) * F.col("total") / F.lit(float(sums["tokens"]))
        turn = (F.col("carry") + F.col("upto") - 1) / quantum
    else:
        listed = [queue_of(x) for x in targets]
        totals = {r["s"]: r["n"] for r in queued.select(name.alias("s"), "n").where(F.col("s").isin(listed)).groupBy("s").agg(F.sum("n").alias("n")).collect()}
        queues, _ = turns(totals, sums["tokens"] - sum(totals.values()), targets)
        # Time runs so that each queue with tokens left gets its weight of them; what all have got by then fills the windows.
        share, size = F.lit(None).cast("double"), F.lit(None).cast("double")
        for q, weight, n in queues:
            here = ~F.col("s").isin(listed) if q is None else F.col("s") == q
            share, size = F.when(here, F.lit(weight)).otherwise(share), F.when(here, F.lit(float(n))).otherwise(size)
        # Queues without a target share one weight by their tokens, so that they end together.
        part = F.when(F.col("s").isin(listed), F.lit(1.0)).otherwise(F.col("total") / size)
        time = (F.col("carry") + F.col("upto") - 1) / (share * part)
        turn = sum((F.least(F.lit(weight) * time, F.lit(float(n))) for _, weight, n in queues), F.lit(0.0)) / window
    rows = rows.select("rid", "s", "n", (F.col("carry") + F.col("upto")).alias("upto"), F.floor(turn + 1e-9).cast("long").alias("round"))
    served = rows.groupBy("round", "s").agg(F.sum("n").alias("sum"), F.min(F.col("upto") - F.col("n")).alias("first"))
    wide = max(1, -(-sums["tokens"] // window) // 256)
    served = served.withColumn("part", F.floor(F.col("round") / wide))
    parts = served.groupBy("part").agg(F.sum("sum").alias("all"))
    parts = parts.select("part", (F.sum("all").over(Window.orderBy("part")) - F.col("all")).alias("before"))
    served = served.join(parts, "part").select("round", "s", (F.col("before") + F.sum("sum").over(Window.partitionBy("part").orderBy("round", "s")) - F.col("sum") - F.col("first")).alias("base"))
    return rows.join(served, ["round", "s"]).select("rid", (F.col("base") + F.col("upto") - F.col("n")).alias("at"))


def pack(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", length: int = LENGTH, window: int = WINDOW, end_id: int = END_ID, targets: dict[str | None, float] | None = None) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    targets: shares by source. Sources without one share what the targets leave
    of 1, by their tokens; if that is nothing, they are refused (ValueError).
    A queue that runs dry leaves its share to the others in proportion; ``turns``
    tells at which token of the stream that is.
    """
    small_batches(docs.sparkSession)
    path = path or default_path()
    tokens = tokenize(docs, path, id_col, text_col, source_col, end_id)
    at = schedule(tokens.select("rid", "k", "source", "n"), window, targets)
    rows = tokens.select("rid", "k", "n", "ids").join(at, "rid").select("k", "n", "at", "ids")
    return rows.mapInArrow(_cutting(length, width_of(path)), "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint")


def width_of(path: str) -> int:
    return 2 if load_tokenizer(path).get_vocab_size() <= 65536 else 4
