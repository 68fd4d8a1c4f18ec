"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point alone.
A trigram's vector binds its letters by product after permuting (rotating) them
twice, once and not at all; a text's vector bundles (adds) its trigrams' vectors.
A language's prototype bundles its training texts, each scaled to unit length; a
text takes the language of the largest cosine.

Texts are lower-cased, all but letters become a space, runs of spaces one space.
Prototypes come from all training rows: each task adds up its own, sums of tasks
meet in two steps.  What reaches the driver is one vector a language.

Cases: null text or text without a letter: ``und``, score 0, never trained on;
null lang: not trained on; no training rows at all: ``und``; ties go to the first
language in order; repeated rows count each; a null doc_id is kept; texts of any length
are read whole, as running sums of trigrams; an empty table gives no rows.  Extra columns
are kept, but ``predict`` puts its own lang_pred and score in the place of any so named, in
whatever case of letters.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, claim, fresh, give_back

DIM = 1024
SEED = 20
#: Letters of text encoded together, and trigrams multiplied together.
CHUNK_LETTERS, CHUNK_GRAMS = 200_000, 2048
#: Texts whose vectors are held together.
SLICE = 512
#: Languages that prototypes may have, as these go to every task.
MAX_LANGUAGES = 2000


class Encoder:
    def __init__(self, dim: int = DIM, seed: int = SEED):
        import numpy as np

        self.dim, self.seed = dim, seed
        self.letters: dict[int, object] = {}
        self.kept = np.zeros(0x110000, "uint32")
        for c in range(0x110000):
            if chr(c).isalpha():
                self.kept[c] = c
        self.kept[self.kept == 0] = 32

    def _letter(self, code: int):
        import numpy as np

        if code not in self.letters:
            if len(self.letters) > 20_000:
                self.letters.clear()
            bits = np.random.Generator(np.random.PCG64([self.seed, code])).integers(0, 2, self.dim, "int8")
            self.letters[code] = bits * 2 - 1
        return self.letters[code]

    def _grams(self, codes):
        """Vectors of trigram codes, float32."""
        import numpy as np

        out = None
        for shift, turn in ((42, 2), (21, 1), (0, 0)):
            own, where = np.unique((codes >> np.uint64(shift)) & np.uint64((1 << 21) - 1), return_inverse=True)
            table = np.stack([np.roll(self._letter(int(c)), turn) for c in own])
            out = table[where] if out is None else out * table[where]
        return out.astype("float32")

    def codes(self, text: str):
        """Trigram codes of one text; none if it has no letter."""
        import numpy as np

        raw = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "uint32")
        x = self.kept[raw]
        if not (x != 32).any():
            return np.zeros(0, "uint64")
        x = np.concatenate(([32], x, [32])).astype("uint64")
        x = x[np.concatenate(([True], (x[1:] != 32) | (x[:-1] != 32)))]
        return x[:-2] << np.uint64(42) | x[1:-1] << np.uint64(21) | x[2:]

    def encode(self, texts: list[str | None]):
        """(rows, dim) bundled vectors; a zero row where there is no letter."""
        import numpy as np

        out = np.zeros((len(texts), self.dim), "float32")
        at = 0
        while at < len(texts):
            first, held, all_codes, owners = at, 0, [], []
            while at < len(texts) and held < CHUNK_LETTERS and at - first < 128:
                codes = self.codes(texts[at] or "")
                all_codes.append(codes)
                owners.append(np.full(len(codes), at - first))
                held += len(codes)
                at += 1
            own, where = np.unique(np.concatenate(all_codes), return_inverse=True)
            owner = np.concatenate(owners)
            order = np.argsort(where, kind="stable") if len(own) > CHUNK_GRAMS else None
            if order is not None:
                where, owner = where[order], owner[order]
            for low in range(0, len(own), CHUNK_GRAMS):
                high = min(len(own), low + CHUNK_GRAMS)
                a, b = (np.searchsorted(where, low), np.searchsorted(where, high)) if order is not None else (0, len(where))
                counts = np.bincount(owner[a:b] * (high - low) + where[a:b] - low, minlength=(at - first) * (high - low))
                out[first:at] += counts.reshape(at - first, high - low).astype("float32") @ self._grams(own[low:high])
        return out


_made: dict[tuple, Encoder] = {}


def encoder(dim: int, seed: int) -> Encoder:
    claim("letters", _made.clear)
    if (dim, seed) not in _made:
        _made[dim, seed] = Encoder(dim, seed)
    return _made[dim, seed]


def _unit(x):
    import numpy as np

    norm = np.sqrt((x.astype("float64") ** 2).sum(1, keepdims=True))
    return x / np.where(norm == 0, 1, norm)


def fit(train: DataFrame, text: str = "text", lang: str = "lang", dim: int = DIM, seed: int = SEED) -> dict[str, list[float]]:
    """Prototype of each language, from all rows of ``train`` that have both."""
    bounded_batches(train.sparkSession)

    def partial(batches):
        import numpy as np
        from pyspark import TaskContext

        enc, sums = encoder(dim, seed), {}
        for pdf in batches:
            for low in range(0, len(pdf), SLICE):
                own = pdf.iloc[low : low + SLICE]
                vectors, langs = _unit(enc.encode(own["text"].tolist())), own["lang"].to_numpy()
                for name in set(langs):
                    sums[name] = sums.get(name, np.zeros(dim)) + vectors[langs == name].sum(0)
        part = TaskContext.get().partitionId()
        if sums:  # an empty frame has no type for vectors
            yield pd.DataFrame({"lang": list(sums), "salt": part % 64, "part": part, "v": [x.tolist() for x in sums.values()]}, columns=["lang", "salt", "part", "v"])
        give_back()

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        pdf = pdf.sort_values("part")
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "salt": [0], "part": [int(pdf["salt"].iloc[0])], "v": [np.stack(pdf["v"].tolist()).sum(0).tolist()]})

    schema = "lang string, salt long, part long, v array<double>"
    rows = train.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).where("text is not null and lang is not null")
    sums = rows.mapInPandas(partial, schema).groupBy("lang", "salt").applyInPandas(total, schema).groupBy("lang").applyInPandas(total, schema)
    found = sums.limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    return {r["lang"]: r["v"] for r in sorted(found, key=lambda r: r["lang"]) if any(r["v"])}


def predict(docs: DataFrame, prototypes: dict[str, list[float]], text: str = "text", dim: int = DIM, seed: int = SEED) -> DataFrame:
    """All columns but those named so, and lang_pred and score: the best cosine, not below 0."""
    (made,) = fresh(docs, "_guess")
    columns = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    return with_guess(docs, prototypes, made, text, dim, seed).select(*columns, f"{made}.*")


def with_guess(docs: DataFrame, prototypes: dict[str, list[float]], made: str, text: str = "text", dim: int = DIM, seed: int = SEED) -> DataFrame:
    """All columns and ``made``, a struct of lang_pred and score."""
    spark: SparkSession = docs.sparkSession
    bounded_batches(spark)
    names = list(prototypes)
    shared = spark.sparkContext.broadcast([prototypes[n] for n in names])  # one vector a language

    def best_of(texts: list) -> pd.DataFrame:
        import numpy as np

        out = pd.DataFrame({"lang_pred": ["und"] * len(texts), "score": 0.0})
        if names and texts:
            vectors = encoder(dim, seed).encode(texts)
            cos = _unit(vectors) @ _unit(np.array(shared.value)).T
            best, some = cos.argmax(1), (vectors != 0).any(1)
            has = np.array([x is not None and any(map(str.isalpha, x)) for x in texts])
            out["lang_pred"] = np.where(has, np.array(names, object)[best], "und")
            out["score"] = np.where(has & some, np.clip(cos[np.arange(len(best)), best], 0, 1), 0.0)
        return out

    @F.pandas_udf("struct<lang_pred:string,score:double>")
    def guess(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for col in batches:
            texts = [x if isinstance(x, str) else None for x in col]
            yield pd.concat([best_of(texts[low : low + SLICE]) for low in range(0, max(len(texts), 1), SLICE)], ignore_index=True)
        give_back()

    return docs.withColumn(made, guess(F.col(text).cast("string")))
