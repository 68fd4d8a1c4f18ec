"""Vector bin packing of token runs into fixed-length sequences.

Each piece has a demand in three dimensions: tokens, segments (one) and loss-bearing
tokens.  A sequence is filled by the dot-product heuristic: of the pieces that fit in
every dimension, the one with the largest weighted product of remaining capacity and
demand goes in next, each scaled by its limit and weighted by what the waiting pieces
ask of that dimension on the average, so that the scarce dimension counts most.  When
none fits whole, the piece that fills most of the gap is cut.  Every partition packs its
own pieces from a bounded pool, so nothing is shuffled and no hot source meets in one
task; of a long document only the ids that still wait are held.  What a partition has left at its end is cut into power-of-two sequences, which
need no padding as long as the limits let them fill; so is a sequence that the limits
would leave with more than SLACK of padding, whose rest goes back to the pool.

Loss-bearing tokens: in a document all but its prompt, which is its first line and line
end if other lines follow; in a conversation those of the assistant's turns.  The end
id bears loss where what it ends does.

Cases: null and empty text are the end id alone; a turn without a role bears no loss;
turns are in order of turn, then role and text; repeated rows are packed each by itself;
rows with a null doc_id or conv_id are kept, turns with none as one conversation; an
empty table gives no rows; extra columns are ignored; texts of any length are cut, never
dropped.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, ids_of, keyed_texts, longs, tidy

SEQUENCE = 2048
SEGMENTS = 24
#: A sixteenth of a sequence's places are left to prompts.
LOSS = 1920
POOL = 1024
#: Padding that a sequence may have; one that the limits leave emptier is cut to a power of two.
SLACK = 16
MIN_CUT = 16
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long, sequence_tokens long, padded_to long"


class Loss:
    """The loss-bearing spans [a, b) of one document, in order."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.spans = [(a, b) for a, b in spans if a < b]

    def within(self, start: int, stop: int) -> int:
        """Loss-bearing tokens in [start, stop)."""
        return sum(max(0, min(b, stop) - max(a, start)) for a, b in self.spans)

    def reach(self, start: int, most: int) -> int:
        """The furthest place up to which there are at most ``most`` of them; far out if there are no more."""
        for a, b in self.spans:
            if b > start:
                own = b - max(a, start)
                if own > most:
                    return max(a, start) + most
                most -= own
        return 1 << 60


class Packer:
    """Packs documents' pieces (key, start, length, loss) of one partition; yields lists of placed pieces."""

    def __init__(self, tokens: int = SEQUENCE, segments: int = SEGMENTS, loss: int = LOSS, pool: int = POOL, min_cut: int = MIN_CUT):
        self.cap = (tokens, segments, loss)
        self.pool_size, self.min_cut = pool, min_cut
        self.pool: list[tuple] = []  # (length, loss, key, start)
        self.of: dict = {}  # key -> Loss, while pieces of it wait

    def add(self, key, length: int, loss: Loss) -> list[list[tuple]]:
        tokens, _, most = self.cap
        start, done = 0, []
        self.of[key] = loss
        while start < length:
            stop = min(length, start + tokens, loss.reach(start, most))
            piece = (stop - start, loss.within(start, stop), key, start)
            if piece[0] == tokens:
                done.append([(key, start, *piece[:2])])
            else:
                self.pool.append(piece)
            start = stop
        while len(self.pool) >= self.pool_size:
            done += self._fill(until=self.pool_size // 2)
        return done

    def _fill(self, until: int = 0) -> list[list[tuple]]:
        """Close sequences till at most ``until`` pieces are left; the last one stays open if not full."""
        import numpy as np

        tokens, segments, most = self.cap
        items = sorted(self.pool, key=lambda x: (-x[0], -x[1], x[2], x[3]))
        size = np.array([x[0] for x in items], "float64")
        loss = np.array([x[1] for x in items], "float64")
        free = np.array([self.of[k].reach(a, 0) - a for _, _, k, a in items], "float64")  # tokens before the first that bears loss
        live = np.ones(len(items), bool)
        weight = (size.mean() / tokens, 1 / segments, loss.mean() / most) if items else (0, 0, 0)
        left, done, extra = len(items), [], []
        while left > until:
            room, seg, bear, placed = tokens, segments, most, []
            while room and seg and left:
                fits = live & (size <= room) & (loss <= bear)
                i = -1
                if fits.any():
                    score = weight[0] * (size / tokens) * (room / tokens) + weight[1] * (1 / segments) * (seg / segments) + weight[2] * (loss / most) * (bear / most)
                    i = int(np.where(fits, score, -1.0).argmax())
                # the last segment, or no whole piece: cut the piece that fills most of the gap
                whole = size[i] if i >= 0 else 0
                if whole < room and (seg == 1 or i < 0):
                    head = np.where(live, np.minimum(np.minimum(size, room), free + bear), -1.0)
                    j = int(head.argmax())
                    if head[j] > whole and (head[j] == size[j] or room >= self.min_cut):
                        i = j
                if i < 0:
                    break
                length, bears, key, start = items[i]
                spans = self.of[key]
                take = int(min(length, room, spans.reach(start, bear) - start))
                if take <= 0:
                    break
                if take < length:
                    head = spans.within(start, start + take)
                    items[i] = (length - take, bears - head, key, start + take)
                    size[i], loss[i], free[i] = items[i][0], items[i][1], spans.reach(start + take, 0) - start - take
                    length, bears = take, head
                else:
                    live[i] = False
                    left -= 1
                placed.append((key, start, length, bears))
                room, seg, bear = room - length, seg - 1, bear - bears
            if not left and room:
                extra += placed  # the open sequence: its pieces go back
                break
            if room > SLACK:
                placed, over = self._trim(placed, 1 << ((tokens - room).bit_length() - 1))
                extra += over
            done.append(placed)
        self.pool = [x for x, alive in zip(items, live, strict=True) if alive] + [(n, b, k, s) for k, s, n, b in extra]
        return done

    def _trim(self, placed: list[tuple], keep: int) -> tuple[list[tuple], list[tuple]]:
        """The first ``keep`` tokens of a sequence, and the pieces of the rest."""
        head, over = [], []
        for key, start, length, loss in placed:
            take = min(length, keep)
            own = self.of[key].within(start, start + take)
            keep -= take
            if take:
                head.append((key, start, take, own))
            if take < length:
                over.append((key, start + take, length - take, loss - own))
        return head, over

    def finish(self) -> list[list[tuple]]:
        """The rest: full sequences as long as there are any, then powers of two."""
        done = self._fill()
        rest, self.pool = [(k, s, n, b) for n, b, k, s in reversed(self.pool)], []
        tokens, segments, most = self.cap
        while rest:
            total = sum(x[2] for x in rest)
            room, bear, placed = min(tokens, 1 << (total.bit_length() - 1)), most, []
            while rest and room and len(placed) < segments:
                key, start, length, loss = rest[-1]
                spans = self.of[key]
                take = min(length, room, spans.reach(start, bear) - start)
                if take <= 0:
                    break
                own = spans.within(start, start + take)
                rest.pop()
                if take < length:
                    rest.append((key, start + take, length - take, loss - own))
                placed.append((key, start, take, own))
                room, bear = room - take, bear - own
            used = sum(x[2] for x in placed)
            placed, over = self._trim(placed, 1 << (used.bit_length() - 1))
            rest += reversed(over)
            done.append(placed)
        return done


class Parts:
    """A long document's ids in parts, each of which is let go once all its ids are taken."""

    def __init__(self, ids: bytes, size: int):
        self.size = size
        self.parts = {i: ids[i * size : (i + 1) * size] for i in range(-(-len(ids) // size))}
        self.left = {i: len(p) for i, p in self.parts.items()}

    def take(self, start: int, length: int) -> bytes:
        """Bytes [start, start + length), which nobody takes again."""
        out = []
        while length:
            i, at = divmod(start, self.size)
            own = self.parts[i][at : at + length]
            out.append(own)
            self.left[i] -= len(own)
            if not self.left[i]:
                del self.parts[i], self.left[i]
            start, length = start + len(own), length - len(own)
        return b"".join(out)


def _pack(tokenizer: str, end_id: int, limits: tuple, read):
    """A task's step; ``read(codec, end, batch)`` gives (id, token ids, loss) of a batch's documents."""

    def pack(batches):
        import os

        import numpy as np
        import pandas as pd
        from pyspark import TaskContext

        from .tokens import codec

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        enc = codec(tokenizer)
        end = int(end_id).to_bytes(enc.width, "little")
        packer = Packer(*limits)
        base = TaskContext.get().partitionId() << 36
        held: dict[int, list] = {}  # row -> [doc_id, tokens, ids or Parts, tokens still to place]
        row = n = 0
        out: list[tuple] = []
        size = limits[0] * enc.width  # bytes of a full sequence's ids

        def place(sequences):
            nonlocal n
            for pieces in sequences:
                at, total = 0, sum(x[2] for x in pieces)
                padded = total if total & (total - 1) == 0 else limits[0]
                for key, start, length, loss in pieces:
                    doc = held[key]
                    own = doc[2].take(start * enc.width, length * enc.width) if isinstance(doc[2], Parts) else memoryview(doc[2])[start * enc.width : (start + length) * enc.width]
                    ids = np.frombuffer(own, enc.dtype).astype("<u4")
                    out.append((doc[0], start, length, zlib.crc32(ids.tobytes()), doc[1], base + n, at, loss, total, padded))
                    at += length
                    doc[3] -= length
                    if not doc[3]:
                        del held[key], packer.of[key]
                n += 1

        def frame():
            pdf = pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens", "sequence_tokens", "padded_to"])
            pdf["doc_id"] = longs([r[0] for r in out])
            out.clear()
            return pdf

        for pdf in batches:
            for doc, ids, loss in read(enc, end, pdf):
                tokens = len(ids) // enc.width
                held[row] = [doc, tokens, Parts(ids, size) if len(ids) > 2 * size else ids, tokens]
                place(packer.add(row, tokens, loss))
                row += 1
            if out:
                yield frame()
        place(packer.finish())
        if out:
            yield frame()

    return pack


def _documents(enc, end: bytes, pdf):
    for doc, text in zip(ids_of(pdf), pdf["text"], strict=True):
        ids, prompt = enc.encode_from(text or "")
        yield doc, ids + end, Loss([(prompt, len(ids) // enc.width + 1)])


def _conversations(enc, end: bytes, pdf):
    for doc, turns in zip(ids_of(pdf), pdf["turns"], strict=True):
        ids, spans, at = [], [], 0
        for turn in turns:
            own = enc.encode(turn["text"] or "") + end
            n = len(own) // enc.width
            ids.append(own)
            if turn["role"] == "assistant":
                spans.append((at, at + n))
            at += n
        yield doc, b"".join(ids), Loss(spans)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, tokens: int = SEQUENCE, segments: int = SEGMENTS, loss: int = LOSS) -> DataFrame:
    """Pieces of all documents placed in sequences; see SCHEMA."""
    bounded_batches(docs.sparkSession)
    return keyed_texts(docs).mapInPandas(tidy(_pack(tokenizer, end_id, (tokens, segments, loss), _documents)), SCHEMA)


def pack_conversations(turns: DataFrame, tokenizer: str, end_id: int = 1, tokens: int = SEQUENCE, segments: int = SEGMENTS, loss: int = SEQUENCE * 3 // 4) -> DataFrame:
    """Instruction data: (conv_id, turn, role, text) as whole conversations; ``doc_id`` of the result is the conv_id.

    Turns of a conversation meet by key, as one conversation is one document.
    """
    bounded_batches(turns.sparkSession)
    said = F.struct(F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    rows = turns.groupBy(F.col("conv_id").cast("long").alias("doc_id")).agg(F.array_sort(F.collect_list(said)).alias("turns"))
    rows = rows.select(F.coalesce("doc_id", F.lit(0).cast("long")).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), "turns")
    return rows.mapInPandas(tidy(_pack(tokenizer, end_id, (tokens, segments, loss), _conversations)), SCHEMA)
