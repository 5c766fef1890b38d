"""Best-fit packing planned on the length histogram.

Documents are tokenised where they lie and leave only (length, checksum) rows. The plan
runs best-fit-decreasing over the counts of the histogram: groups of equally filled
sequences instead of single ones, so it takes steps in the order of the number of lengths
and not of the documents. Documents then take the planned slots by joining on their rank
within their length; ranks come from (length, salt) groups whose number grows with the
root of a length's count, so no length is ranked in one task.

Ids are those of the `tokenizers` file byte_bpe_50k.json; the same vocabulary is run by
the faster of the two libraries that ship it (tests hold both against each other). Texts
that the faster one refuses (its pattern gives up on some 900,000 blanks in a row) are
encoded by `tokenizers` itself.
The query and the pipeline take `<|endoftext|>` in a text for the file's added token, as
that file does by default; without `special` the string is ordinary text.

Defined results: a null or empty text is one piece of length 1 (the end id); only longer
documents than `capacity` are cut, and then the first piece is the shorter one; repeated
rows are packed each; an empty table gives no rows. Input columns other than id and text
are not read.
"""

from __future__ import annotations

import base64
import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quakeframe.llm import common

CAPACITY, END = 1024, 2
#: The added tokens of byte_bpe_50k.json.
ADDED = {"<|endoftext|>": 50256}
#: Plans of more runs than this are joined without a broadcast; best-fit over 1024 lengths makes some thousands.
MAX_BROADCAST_RUNS = 100_000
PIECES = "piece int, start long, length long, ids_crc32 long"
_ENCODINGS: dict[str, object] = {}


def encoding(name: str = "byte_bpe_50k.tiktoken"):
    """The byte-level BPE of a vocabulary file, loaded once per process."""
    if name not in _ENCODINGS:
        import public_tokenizers as files
        import tiktoken

        with open(files.path(name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODINGS[name] = tiktoken.Encoding("own", pat_str=files.PATTERN, mergeable_ranks=ranks, special_tokens=ADDED)
    return _ENCODINGS[name]


def reference(special: bool):
    """The tokenizer of byte_bpe_50k.json itself, loaded once per process; `special` as in `pieces`."""
    name = f"tokenizers-{special}"
    if name not in _ENCODINGS:
        import public_tokenizers as files
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(files.path("byte_bpe_50k.json"))
        t.encode_special_tokens = not special
        _ENCODINGS[name] = t
    return _ENCODINGS[name]


def token_ids(text: str, vocabulary: str, special: bool) -> np.ndarray:
    """The ids of a text."""
    try:
        return encoding(vocabulary).encode_to_numpy(text, allowed_special=set(ADDED) if special else set(), disallowed_special=())
    except ValueError:
        return np.array(reference(special).encode(text, add_special_tokens=False).ids, np.uint32)


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids."""
    first = n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def _pieces(name: str, capacity: int, special: bool, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            row, out = [], [[], [], [], []]
            for k in range(batch.num_rows):
                text = texts[k].as_py() or ""
                tokens = np.append(token_ids(text, name, special), END).astype("<u4")
                for piece, (start, length) in enumerate(cut(len(tokens), capacity)):
                    row.append(k)
                    for column, x in zip(out, (piece, start, length, zlib.crc32(tokens[start : start + length].tobytes())), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(row, pa.int64())), pa.array(out[0], pa.int32()), *[pa.array(x, pa.int64()) for x in out[1:]]], schema=schema)

    return run


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k.tiktoken", capacity: int = CAPACITY, special: bool = False) -> DataFrame:
    """One row per piece: the id, piece, start, length and ids_crc32. `special`: strings of ADDED are their tokens, not text."""
    from pyspark.sql.pandas.types import to_arrow_type

    common.ship(docs.sparkSession)
    df = docs.select(doc_id, F.col(text).cast("string").alias("_pack_text"))
    kind = df.schema[0].dataType
    schema = pa.schema([("_id", to_arrow_type(kind)), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
    made = df.mapInArrow(_pieces(vocabulary, capacity, special, schema), f"_id {kind.simpleString()}, {PIECES}")
    return made.withColumnRenamed("_id", doc_id)


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best-fit-decreasing over counts: runs (length, first rank, end rank, first sequence, offset) and the number of sequences.

    The ranks of a run take consecutive sequences at the same offset.
    """
    runs: list[tuple[int, int, int, int, int]] = []
    free: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []  # the free rooms that have groups, ascending
    sequences = 0

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in free:
                free[room] = []
                bisect.insort(rooms, room)
            free[room].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            k = bisect.bisect_left(rooms, length)
            if k < len(rooms):
                room = rooms[k]
                first, n = free[room].pop()
                if not free[room]:
                    del free[room], rooms[k]
                used = min(n, left)
                runs.append((length, rank, rank + used, first, capacity - room))
                put(room, first + used, n - used)
                put(room - length, first, used)
                rank, left = rank + used, left - used
                continue
            each = capacity // length
            whole, rest = divmod(left, each)
            for first, n, deep in ((sequences, whole, each), (sequences + whole, 1 if rest else 0, rest)):
                for level in range(deep if n else 0):
                    runs.append((length, rank, rank + n, first, level * length))
                    rank += n
                put(capacity - deep * length, first, n)
            sequences += whole + (1 if rest else 0)
            left = 0
    return runs, sequences


def pack(cut_pieces: DataFrame, order: list[str], capacity: int = CAPACITY) -> DataFrame:
    """A written table of pieces with sequence_id and offset. `order` ranks pieces of one length."""
    spark = cut_pieces.sparkSession
    counts = {r["length"]: r["n"] for r in cut_pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # `capacity` rows at most
    runs, _ = best_fit(counts, capacity)
    salts = spark.createDataFrame([(k, int(n**0.5) + 1) for k, n in counts.items()], "_len long, _salts int")
    df = cut_pieces.join(F.broadcast(salts), cut_pieces["length"] == salts["_len"]).drop("_len")  # `capacity` rows at most
    df = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.col("_salts")).cast("int")).drop("_salts")
    groups = df.groupBy(F.col("length").alias("_l"), F.col("_salt").alias("_s")).agg(F.count(F.lit(1)).alias("_n"))
    groups = groups.withColumn("_before", F.sum("_n").over(W.partitionBy("_l").orderBy("_s")) - F.col("_n")).drop("_n")
    df = df.withColumn("_in", F.row_number().over(W.partitionBy("length", "_salt").orderBy(*order)) - 1)
    df = df.join(groups, (df["length"] == groups["_l"]) & (df["_salt"] == groups["_s"])).withColumn("_rank", F.col("_before") + F.col("_in"))
    slots = spark.createDataFrame(runs, "_len long, _from long, _to long, _first long, _at long")
    if len(runs) <= MAX_BROADCAST_RUNS:
        slots = F.broadcast(slots)
    df = df.join(slots, (df["length"] == F.col("_len")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
    df = df.withColumns({"sequence_id": F.col("_first") + F.col("_rank") - F.col("_from"), "offset": F.col("_at")})
    return df.drop("_salt", "_l", "_s", "_before", "_in", "_rank", "_len", "_from", "_to", "_first", "_at")


def pack_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", special: bool = False) -> DataFrame:
    """Documents cut, checked and packed: id, piece, start, length, ids_crc32, sequence_id and offset."""
    return pack(common.written(pieces(docs, doc_id, text, special=special), "op7-pieces"), [doc_id, "piece", "ids_crc32"])


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 ids."""
    return pack_documents(common.table(spark, sf_dir, "documents"), special=True)


SQL = None
