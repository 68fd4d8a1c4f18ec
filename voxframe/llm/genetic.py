"""Documents in as few fixed-length sequences as can be, by a grouping genetic algorithm on islands.

Only documents longer than a sequence are cut; their full pieces are sequences of their
own, and what is left of every document is a piece to be packed.  Pieces wait in groups of
bounded size, made by each task of its own documents.  For each group several islands
evolve populations of packings: crossover injects whole well-filled bins of one parent into
the other, removes the bins that held the same pieces, and best-fits the pieces so
displaced; mutation dissolves the emptiest bins and a few others.  After each epoch an
island's best packing migrates to the next one, by a shuffle on (group, island).  An island
rests once a packing has as few bins as the tokens need.

A group's best packing keeps its well-filled bins.  The pieces of the emptiest ones, a
quarter at most, are dealt to fewer groups and packed again, until one group is left; so
there is one open sequence in the end and not one for each group, and rounds shrink by four.

Randomness is drawn from (group, island, epoch), so a task that runs again gives the same.

Cases: null and empty texts are the end id alone; a null doc_id is kept; repeated rows are
packed each by itself; ties go to the earlier piece, bin or island; texts of any length are
cut whole; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, ids_of, keyed_texts, longs, materialize, tidy

SEQUENCE = 4096
#: Pieces that are packed together, islands of a group, packings of an island.
GROUP, ISLANDS, POPULATION = 2048, 3, 5
EPOCHS, GENERATIONS = 4, 4
#: Tokens that a bin may lack and still be kept; a group under SMALL pieces hands all on.
SLACK, SMALL = 8, 256
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, home long, slot int"


class Packing:
    """Bins of pieces: each piece's bin, and what each bin holds."""

    def __init__(self, of, fill):
        self.of, self.fill = of, fill

    def score(self, room: int) -> tuple:
        """Fewer bins are better, then fuller ones beside emptier ones."""
        f = self.fill.astype("float64") / room
        return len(f), -round(float((f * f).sum()), 9)


def best_fit(sizes, room: int, of, fill: list[int], loose) -> Packing:
    """Put the loose pieces, in the given order, into the fullest bins that take them, or into new ones."""
    import numpy as np

    gaps = sorted((room - f, b) for b, f in enumerate(fill))
    for i, size in zip(loose.tolist(), sizes[loose].tolist(), strict=True):
        at = bisect.bisect_left(gaps, (size, -1))
        if at < len(gaps):
            gap, b = gaps.pop(at)
        else:
            gap, b = room, len(fill)
            fill.append(0)
        of[i] = b
        fill[b] += size
        if gap > size:
            bisect.insort(gaps, (gap - size, b))
    return Packing(of, np.array(fill, "int64"))


def seed_packing(sizes, room: int, rng, spread: float) -> Packing:
    """Best fit by falling size, the sizes blurred by ``spread``."""
    import numpy as np

    order = np.argsort(-sizes * (1 + spread * rng.random(len(sizes))), kind="stable")
    return best_fit(sizes, room, np.zeros(len(sizes), "int32"), [], order)


def _rebuilt(sizes, room: int, of, fill, keep, rng) -> Packing:
    """The kept bins, with all pieces of the others (of[i] < 0 or bin not kept) exchanged in and best-fitted."""
    import numpy as np

    number = np.where(keep, np.cumsum(keep) - 1, -1).astype("int32")
    new = np.where(of >= 0, number[of], -1).astype("int32")
    held = fill[keep].tolist()
    loose = np.flatnonzero(new < 0)
    loose = loose[np.argsort(-sizes[loose], kind="stable")]
    # exchange: one piece for a larger loose one, or for two, so that bins get fuller and loose pieces smaller
    if len(loose) and len(held):
        loose = loose[::-1]
        waiting = sizes[loose]  # rising
        inside = np.flatnonzero(new >= 0)
        for i in rng.permutation(inside)[: 2 * len(loose)].tolist():
            size, b = int(sizes[i]), int(new[i])
            most = size + room - held[b]
            if most == size:
                continue
            other = np.searchsorted(waiting, most - waiting, "right") - 1  # the largest partner of each loose piece
            other = np.where(other == np.arange(len(waiting)), other - 1, other)
            pair = np.where(other >= 0, waiting + waiting[other], 0)
            pair[pair > most] = 0
            at = int(pair.argmax())
            out = [at, int(other[at])] if pair[at] else []
            one = int(np.searchsorted(waiting, most, "right")) - 1
            if one >= 0 and waiting[one] >= pair[at]:
                out = [one]
            larger = int(waiting[out].sum())
            if larger > size:
                new[loose[out]], new[i] = b, -1
                held[b] += larger - size
                loose, waiting = np.delete(loose, out), np.delete(waiting, out)
                back = int(np.searchsorted(waiting, size))
                loose, waiting = np.insert(loose, back, i), np.insert(waiting, back, size)
        loose = loose[::-1]
    return best_fit(sizes, room, new, held, loose)


def crossover(sizes, room: int, a: Packing, b: Packing, rng) -> Packing:
    """Well-filled bins of ``b`` go whole into ``a``; bins of ``a`` that held their pieces go, the rest is best-fitted."""
    import numpy as np

    order = np.argsort(-b.fill, kind="stable")
    good = order[: max(1, len(order) // 2)]
    chosen = rng.permutation(good)[: int(rng.integers(1, max(2, len(order) // 4 + 1)))]
    number = np.full(len(b.fill), -1, "int32")
    number[chosen] = np.arange(len(chosen))
    guest = number[b.of]  # piece -> injected bin
    hit = np.bincount(a.of[guest >= 0], minlength=len(a.fill)) > 0
    keep = np.concatenate([~hit, np.ones(len(chosen), bool)])
    of = np.where(guest >= 0, guest + len(a.fill), a.of)
    of[(guest < 0) & hit[a.of]] = -1
    return _rebuilt(sizes, room, of, np.concatenate([a.fill, b.fill[chosen]]), keep, rng)


def mutation(sizes, room: int, a: Packing, rng) -> Packing:
    """The emptiest bins and some others are dissolved."""
    import numpy as np

    n = len(a.fill)
    keep = np.ones(n, bool)
    keep[np.argsort(a.fill, kind="stable")[: max(1, n // 50)]] = False
    keep[rng.integers(0, n, max(2, n // 20))] = False
    return _rebuilt(sizes, room, a.of, a.fill, keep, rng)


def evolve(sizes, room: int, population: list[Packing], rng, generations: int = GENERATIONS) -> list[Packing]:
    """The population after some generations, best first; it stops at as few bins as the tokens need."""
    least = -(-int(sizes.sum()) // room)
    key = lambda p: p.score(room)
    population = sorted(population, key=key)
    for _ in range(generations):
        if len(population[0].fill) <= least:
            break
        made = []
        for _ in range(max(1, len(population) // 2)):
            a, b = (population[int(min(rng.integers(0, len(population), 2)))] for _ in range(2))
            child = crossover(sizes, room, a, b, rng)
            made.append(mutation(sizes, room, child, rng) if rng.random() < 0.5 else child)
        made.append(mutation(sizes, room, population[0], rng))
        seen, kept = set(), []
        for p in sorted([*population, *made], key=key):
            if key(p) not in seen and len(kept) < len(population):
                seen.add(key(p))
                kept.append(p)
        population = kept
    return population


def _rng(*of: int):
    import numpy as np

    return np.random.default_rng([x & (1 << 62) - 1 for x in of])


def _packing(sizes, of) -> Packing:
    import numpy as np

    of = np.array(of, "int32")
    return Packing(of, np.bincount(of, weights=sizes).astype("int64"))


STATE = "group_id long, island int, sizes array<int>, population array<binary>, guest binary"


def _epoch(epoch: int, room: int, islands: int, size: int, generations: int):
    """A task's step: each island's population after an epoch, and its best as a guest of the next island."""

    def run(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            rows = []
            for row in pdf.itertuples():
                sizes, rng = np.array(row.sizes, "int64"), _rng(row.group_id, row.island, epoch)
                known = [] if row.population is None else [_packing(sizes, np.frombuffer(x, "<i2")) for x in row.population]
                if row.guest is not None:
                    known.append(_packing(sizes, np.frombuffer(row.guest, "<i2")))
                if not known:
                    known = [seed_packing(sizes, room, rng, 0.02 * row.island)]
                    while len(known) < size and len(known[0].fill) > -(-int(sizes.sum()) // room):
                        known.append(seed_packing(sizes, room, rng, 0.05 * len(known)))
                found = [p.of.astype("<i2").tobytes() for p in evolve(sizes, room, known, rng, generations)[:size]]
                rows.append((row.group_id, row.island, row.sizes, found, None))
                rows.append((row.group_id, (row.island + 1) % islands, None, None, found[0]))
            yield pd.DataFrame(rows, columns=["group_id", "island", "sizes", "population", "guest"])

    return run


def _place(level: int, room: int, last: bool):
    """A task's step: the best of a group's islands; its pieces with sequence and offset, or handed on."""

    def run(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            for row in pdf.itertuples():
                sizes = np.array([p["length"] for p in row.pieces], "int64")
                best = min((_packing(sizes, np.frombuffer(x, "<i2")) for x in row.found), key=lambda p: p.score(room))
                n, waste = len(sizes), room - best.fill
                held = np.bincount(best.of, minlength=len(best.fill))
                emptiest = np.argsort(best.fill, kind="stable")
                go = np.zeros(len(best.fill), bool)
                if not last:
                    fits = np.cumsum(held[emptiest]) <= (n if n < SMALL else n // 4)
                    go[emptiest[fits & (waste[emptiest] > SLACK)]] = True
                order = np.argsort(best.of, kind="stable")
                before = np.cumsum(sizes[order]) - sizes[order]
                first = np.concatenate([[True], np.diff(best.of[order]) > 0])
                offset = np.empty(n, "int64")
                offset[order] = before - np.repeat(before[first], held)
                on = go[best.of]
                sequence = (level << 56) + (row.group_id << 14) + best.of.astype("int64")
                yield pd.DataFrame({
                    "home": [p["home"] for p in row.pieces], "slot": [p["slot"] for p in row.pieces], "length": sizes,
                    "sequence_id": longs([None if x else int(s) for x, s in zip(on, sequence, strict=True)]), "offset": offset,
                })

    return run


def pack_groups(pieces: DataFrame, room: int, level: int, last: bool, islands: int = ISLANDS, size: int = POPULATION, epochs: int = EPOCHS, generations: int = GENERATIONS) -> DataFrame:
    """(home, slot, length, sequence_id, offset) of pieces (group_id, home, slot, length); no sequence_id for what is handed on."""
    piece = F.struct("home", "slot", "length")
    groups = materialize(pieces.groupBy("group_id").agg(F.array_sort(F.collect_list(piece)).alias("pieces")), "groups")
    sizes = F.transform("pieces", lambda p: p["length"].cast("int"))
    state = groups.select("group_id", F.explode(F.array(*map(F.lit, range(islands)))).alias("island"), sizes.alias("sizes"), F.lit(None).cast("array<binary>").alias("population"), F.lit(None).cast("binary").alias("guest"))
    state = state.repartition("group_id", "island")
    for epoch in range(epochs):
        state = state.mapInPandas(tidy(_epoch(epoch, room, islands, size, generations)), STATE)
        if epoch + 1 < epochs:
            one = lambda c: F.first(c, ignorenulls=True).alias(c)
            state = state.groupBy("group_id", "island").agg(one("sizes"), one("population"), one("guest"))
    found = state.where("guest IS NOT NULL").groupBy("group_id").agg(F.sort_array(F.collect_list("guest")).alias("found"))  # one for each island
    return groups.join(found, "group_id").mapInPandas(tidy(_place(level, room, last)), "home long, slot int, length long, sequence_id long, offset long")


def _cut(tokenizer: str, end_id: int, room: int, group: int):
    """A task's step: its documents' full pieces as sequences, and the rest in groups of its own."""

    def run(batches):
        import os

        import numpy as np
        import pandas as pd
        from pyspark import TaskContext

        from .tokens import word_codec

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        enc = word_codec(tokenizer)
        end = int(end_id).to_bytes(enc.width, "little")
        base, full, rest = TaskContext.get().partitionId(), 0, 0
        columns = [c.split()[0] for c in PIECES.split(", ")]
        for pdf in batches:
            rows = []
            for doc, text in zip(ids_of(pdf), pdf["text"], strict=True):
                ids = np.frombuffer(enc.encode(text or "") + end, enc.dtype).astype("<u4")
                for piece, start in enumerate(range(0, len(ids), room)):
                    own = ids[start : start + room]
                    row = (doc, piece, start, len(own), zlib.crc32(own.tobytes()))
                    if len(own) == room:
                        rows.append((*row, (base << 36) + full, 0, None, None))
                        full += 1
                    else:
                        rows.append((*row, None, None, (base << 22) + rest // group, rest % group))
                        rest += 1
            if rows:
                out = dict(zip(columns, map(list, zip(*rows, strict=True)), strict=True))
                for c in ("doc_id", "sequence_id", "offset", "home", "slot"):
                    out[c] = longs(out[c])
                yield pd.DataFrame(out)

    return run


def pack_whole(docs: DataFrame, tokenizer: str, end_id: int = 1, room: int = SEQUENCE, group: int = GROUP, **search) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of all pieces of all documents."""
    spark = docs.sparkSession
    bounded_batches(spark)
    cut = materialize(keyed_texts(docs).mapInPandas(tidy(_cut(tokenizer, end_id, room, group)), PIECES), "pieces")
    left = cut.where("home IS NOT NULL").select(F.col("home").alias("group_id"), "home", "slot", "length")
    done, level = [], 1
    while True:
        n, least, most = left.agg(F.count("*"), F.min("group_id"), F.max("group_id")).first()
        if not n:
            break
        last = least == most
        done.append(materialize(pack_groups(left, room, level, last, **search), "placed"))
        if last:
            break
        left = done[-1].where("sequence_id IS NULL").select("home", "slot", "length")
        groups = -(-left.count() // group)
        left = left.select(F.pmod(F.xxhash64("home", "slot", F.lit(level)), F.lit(max(1, groups))).alias("group_id"), "home", "slot", "length")
        level += 1
    whole = cut.where("home IS NULL").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
    if not done:
        return whole
    placed = spark.read.schema(done[0].schema).parquet(*[d._scratch for d in done]).where("sequence_id IS NOT NULL")
    rest = cut.where("home IS NOT NULL").drop("sequence_id", "offset", "length").join(placed, ["home", "slot"])
    return whole.unionByName(rest.select(*whole.columns))
