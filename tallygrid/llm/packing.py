"""Mixture-controlled packing: deficit round-robin over source queues into windows of fixed size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from tallygrid.llm.encoding import encoder
from tallygrid.llm.shared import reach_workers, text_key, written

WINDOW = 2048
#: Numbers (rounds x queues) that :meth:`Schedule.place` holds at once, about.
BLOCK = 1 << 18


def service_phases(totals: list[int], weights: list[float] | None = None) -> list[dict]:
    """How round-robin service drains queues of ``totals`` tokens at ``weights`` (default: the totals themselves).

    A phase ends when a queue runs dry; the others go on with the weights left to them. Each phase:
    start (tokens of the mix before it), total, and per queue done (its tokens served before) and n (in the phase).
    """
    left, done, start, phases = [int(x) for x in totals], [0] * len(totals), 0, []
    weights = [float(x) for x in (weights or totals)]
    while any(left):
        active = [i for i, n in enumerate(left) if n]
        if weights is not None and any(weights[i] > 0 for i in active):
            active = [i for i in active if weights[i] > 0]
            first = min(active, key=lambda i: (left[i] / weights[i], i))
            n = [0] * len(left)
            for i in active:
                exact = left[i] == left[first] and weights[i] == weights[first] or weights[i] * left[first] >= weights[first] * left[i]
                n[i] = left[i] if exact else min(left[i], int(left[first] * weights[i] / weights[first]))
        else:  # queues of weight zero come last, in proportion to what they hold
            n = [left[i] if i in active else 0 for i in range(len(left))]
        phases.append({"start": start, "total": sum(n), "done": list(done), "n": n})
        start += sum(n)
        left = [a - b for a, b in zip(left, n, strict=True)]
        done = [a + b for a, b in zip(done, n, strict=True)]
    return phases


class Schedule:
    """Closed form of deficit round-robin with token-sized service.

    In each round a queue's deficit grows by its quantum (``round_tokens`` x its share of the phase) and
    whole tokens are served from it, the fraction being carried on. After k rounds it has been served
    floor(k x quantum) tokens, so any task can place any token without the state of the rounds before.
    """

    def __init__(self, phases: list[dict], round_tokens: int = WINDOW) -> None:
        self.round = round_tokens
        self.phases = [p | {"n": np.array(p["n"], np.int64), "done": np.array(p["done"], np.int64)} for p in phases]
        for p in self.phases:  # a round's quantum of each queue: whole tokens, and its fraction's numerator over total
            parts = [divmod(int(x) * round_tokens, p["total"]) for x in p["n"]]
            p["whole"], p["rest"] = np.array([x for x, _ in parts], np.int64), np.array([x for _, x in parts], np.int64)

    def served(self, phase: dict, k: np.ndarray) -> np.ndarray:
        """Tokens of each queue served in the phase before round k: a row per k."""
        total, rest, k = phase["total"], phase["rest"], k.astype(np.int64)[:, None]
        if total < 1 << 31:  # products of tokens fit
            return np.minimum(k * self.round, total) * phase["n"] // total
        # floor(k x rest / total) where the product may not fit: a quotient in floating point, off by one at most, set right by its remainder, which fits
        quotient = (k * (rest / total)).astype(np.int64)
        remainder = k * rest - quotient * total
        quotient += (remainder >= total).astype(np.int64) - (remainder < 0)
        return np.where(k >= -(-total // self.round), phase["n"], k * phase["whole"] + quotient)

    def _rounds(self, share: int, total: int, a: int, b: int, step: int) -> Iterator[tuple[np.ndarray, bool]]:
        """The rounds that may serve a queue's tokens [a, b) of a phase, at most ``step`` at a time; True: each up to the last is there, else one per token."""
        if share * self.round >= total:
            k0 = max(0, a * total // (share * self.round) - 1)
            k1 = min(b * total // (share * self.round) + 2, -(-total // self.round))
            for k in range(k0, k1, step):
                yield np.arange(k, min(k + step, k1) + 1), True
        else:  # less than a token a round: the round of each token
            for x in range(a, b, step):
                yield np.array([-(-(-(-(i + 1) * total // share)) // self.round) - 1 for i in range(x, min(x + step, b))], np.int64), False

    def place(self, queue: int, first: int, n: int) -> list[tuple[int, int, int]]:
        """Where the queue's tokens [first, first + n) come in the mix: (offset from first, position, length) runs.

        Rounds that serve the queue are taken in blocks of about ``BLOCK`` numbers, however many rounds lie between.
        """
        runs, last = [], first + n
        for phase in self.phases:
            done, share, total = int(phase["done"][queue]), int(phase["n"][queue]), phase["total"]
            a, b = max(first, done) - done, min(last, done + share) - done
            if a >= b:
                continue
            for k, each in self._rounds(share, total, a, b, max(1, BLOCK // len(phase["n"]))):
                cum = self.served(phase, k)
                before, after = (cum[:-1], cum[1:]) if each else (cum, self.served(phase, k + 1))
                starts = before.sum(axis=1) + (after[:, :queue] - before[:, :queue]).sum(axis=1) + phase["start"]
                own = before[:, queue]
                lo, hi = np.maximum(own, a), np.minimum(after[:, queue], b)
                for i in np.flatnonzero(hi > lo):
                    runs.append((int(lo[i]) + done - first, int(starts[i] + lo[i] - own[i]), int(hi[i] - lo[i])))
        return runs


def pack(docs: DataFrame, tokenizer: str, end_id: int, window: int = WINDOW, weights: dict[str, float] | None = None, rest_weight: float = 1.0, round_tokens: int | None = None) -> DataFrame:
    """Pack the whole documents (doc_id, text, source) into sequences of ``window`` tokens at target source proportions.

    Each source is a queue of its documents in doc_id order. By default a queue's target is its share of
    all tokens, the only target that every window can meet when each token is used once; ``weights`` sets
    others: sources that it leaves out share a queue of ``rest_weight``, and when a queue is empty the rest go on.
    Deficit round-robin (:class:`Schedule`) serves the queues; the stream that it makes is cut into sequences, so
    all are full but the last. Documents are cut wherever service or a sequence ends.

    Returns a row per piece: doc_id, source, start, length, ids (binary, unsigned 32-bit), doc_tokens, sequence_id, offset.
    Null text is empty (its end id stays), null source a queue of its own, repeated rows are packed each; an empty table gives no rows. Other columns, whatever their names, are ignored.

    Memory of a task: a document, an Arrow batch, ``BLOCK`` numbers, and four numbers for each source: however many there are, each keeps its own target.
    """
    reach_workers(docs.sparkSession)
    src = F.col("source").cast("string")
    if weights is not None:
        names = sorted(weights)
        queue = F.when(src.isin(names), F.concat(F.lit("s"), src)).otherwise(F.lit("r"))
    else:
        queue = F.concat(F.lit("s"), F.coalesce(F.concat(F.lit("="), src), F.lit("")))
    order = ("queue", "doc_id", "tie")
    ranged = (
        docs.select("doc_id", src.alias("source"), queue.alias("queue"), F.coalesce("text", F.lit("")).alias("text"))
        .withColumn("tie", text_key()).repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "source", "queue", "text")
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, tool = TaskContext.get().partitionId(), encoder(tokenizer)
        end, own, last = np.array([end_id], tool.dtype).tobytes(), 0, None
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [x + end for x in tool.encode(part.column(3).to_pylist())]
                counts, before = [len(x) // tool.dtype.itemsize for x in ids], []
                for q, n in zip(part.column(2).to_pylist(), counts, strict=True):
                    own, last = (own if q == last else 0), q
                    before.append(own)
                    own += n
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(pa.int64()), part.column(1), part.column(2), pa.array([number] * len(ids), pa.int64()), pa.array(before, pa.int64()), pa.array(counts, pa.int64()), pa.array(ids, pa.binary())],
                    names=["doc_id", "source", "queue", "part", "before", "n", "ids"],
                )

    wide = "<u2" if _vocabulary(tokenizer) <= 1 << 16 else "<u4"
    encoded = written(ranged.mapInArrow(encode, "doc_id long, source string, queue string, part long, before long, n long, ids binary"), "encoded")
    # a row per (partition, queue): at most partitions + queues rows, however many documents there are
    parts = encoded.groupBy("queue", "part").agg(F.sum("n").alias("n"))
    bases = parts.select("queue", "part", F.coalesce(F.sum("n").over(Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    sums = parts.groupBy("queue").agg(F.sum("n").alias("n")).toArrow()  # a row per source
    totals = dict(zip(sums["queue"].to_pylist(), sums["n"].to_pylist(), strict=True))
    queues = sorted(totals)
    given = None if weights is None else [float(weights[q[1:]]) if q[0] == "s" else float(rest_weight) for q in queues]
    schedule = Schedule(service_phases([totals[q] for q in queues], given), round_tokens or window)
    number = {q: i for i, q in enumerate(queues)}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [("doc_id", pa.int64()), ("source", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(col, kind) for col, (_, kind) in zip(zip(*rows, strict=True), fields, strict=True)], names=[x for x, _ in fields])

        rows, held = [], 0
        for batch in batches:
            for doc_id, source, queue, first, n, raw in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                ids = np.frombuffer(raw, wide).astype("<u4")
                for start, position, length in schedule.place(number[queue], first, n):
                    while length:
                        step = min(length, window - position % window)
                        rows.append((doc_id, source, start, step, ids[start : start + step].tobytes(), n, position // window, position % window))
                        start, position, length, held = start + step, position + step, length - step, held + step
                if held >= 1 << 19:
                    yield out(rows)
                    rows, held = [], 0
        if rows:
            yield out(rows)

    # the base of each (partition, queue): a table of that proven size, so it may be broadcast
    placed = encoded.join(F.broadcast(bases), ["queue", "part"]).select("doc_id", "source", "queue", (F.col("base") + F.col("before")).alias("first"), "n", "ids")
    return placed.mapInArrow(cut, "doc_id long, source string, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def _vocabulary(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size()


def digest(pieces: DataFrame) -> DataFrame:
    ids: Column = F.crc32("ids").alias("ids_crc32")
    return pieces.select("doc_id", "start", "length", ids, "doc_tokens", "sequence_id", "offset", "source")


def op2_mixture_packing(spark, sf_dir: str) -> DataFrame:
    """``documents`` packed into sequences of at most 2048 tokens, every window at the sources' own proportions."""
    import public_tokenizers

    from tallygrid.llm.shared import read_table

    return digest(pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1))
