"""Toxicity scores from a weighted lexicon matched by Aho-Corasick.

Texts are folded (case, look-alike letters of other scripts, digits and signs that
stand for letters) and matched against word beginnings and whole words in one pass.
A text's score is the logistic of its summed weights and of the same sum normalised
by length; exception phrases ("trash can") take back what their words add.

The lexicon is a short fixed list of insults with a default weight, and what
labelled rows teach: word beginnings of 4 to 7 letters and whole words with their log
odds between toxic and clean documents. Fitting uses at most ``sample`` labelled rows
(the first by a hash of their id, one text of each id), and keeps at most ``entries`` of them, so the model is
small and is the only thing that is sent to the executors. Scoring covers every whole text.

Edge cases: null and empty texts score as a text without any match; unlabelled or null labels are not
learned from, an id with several labels counts as toxic if any is; without labels (or with one class only) the fixed
list scores with default coefficients; repeated rows score alike; an empty table gives no rows; a very long text is
folded and matched in one pass, in memory of a few times its size, and its matches count less by the root of its words.
Only the text is an input of a score.
"""

import math
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.llm.memory import frugal, give_back

# Insults and their default weight; phrases in which a listed word is no insult.
INSULTS = ["idiot", "moron", "stupid", "imbecile", "dumbass", "asshole", "bastard", "scum", "loser", "pathetic", "worthless", "disgusting", "trash", "clown", "retard", "cretin", "scumbag", "vermin", "degenerate", "shithead", "fuckwit", "dickhead", "bitch", "whore", "wichser", "arschloch", "hurensohn", "connard", "salope", "encule", "gilipollas", "cabron", "pendejo"]
DEFAULT_WEIGHT = 3.0
EXCEPTIONS = ["trash can", "trash cans", "trash bin", "trash collection", "clown fish", "clownfish", "class clown", "sore loser"]
# What reads like a letter. Look-alikes first, then digits and signs.
LOOK_ALIKE = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ѕ": "s", "ԁ": "d", "ɡ": "g", "ո": "n", "т": "t", "м": "m", "к": "k", "в": "b", "н": "h", "α": "a", "ο": "o", "ε": "e", "ι": "i", "ρ": "p", "τ": "t", "ν": "v", "κ": "k", "ı": "i", "ł": "l"}
STANDS_FOR = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
_MARKS = "\t\n\r\x0b\x0c!\"#%&'()*+,-./:;<=>?[\\]^_`{|}~«»“”„‘’¡¿…–—"
#: Zero-width characters vanish.
_FOLD = str.maketrans(LOOK_ALIKE | STANDS_FOR | dict.fromkeys(_MARKS, " ") | dict.fromkeys("​‌‍⁠﻿­", ""))
#: Full-width letters fold to ASCII.
_FOLD |= {0xFF41 + k: chr(97 + k) for k in range(26)}


def fold(text: str | None) -> str:
    """The folded text, a space at each end; marks are spaces."""
    return " " + (text or "").lower().translate(_FOLD) + " "


def held_out(doc_id: Column) -> Column:
    """Whether a row is never learned from: crc32 of its id as text leaves 0 by 5 (a null id as the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _features(texts: list[str | None], lexicon: tuple[tuple[str, float], ...]) -> np.ndarray:
    machine = _machine(lexicon)
    out = np.zeros((len(texts), 2))
    for k, text in enumerate(texts):
        folded = fold(text)
        total = sum(w for _, w in machine.iter(folded)) if len(machine) else 0.0
        if total:
            out[k] = total, total / math.sqrt(1 + folded.count(" ") / 100)
    return out


@lru_cache(maxsize=2)
def _machine(lexicon: tuple[tuple[str, float], ...]):
    import ahocorasick

    machine = ahocorasick.Automaton()
    for entry, weight in lexicon:
        machine.add_word(entry, weight)
    if len(machine):
        machine.make_automaton()
    return machine


def _chosen(rows: list, bad: int, good: int, least: int, margin: float) -> dict[str, float]:
    """Entries with at least ``margin`` log odds, the shortest first; one that begins with a chosen entry is left out, as that one matches with it."""
    odds = {r["entry"]: math.log((r["bad"] + 0.5) / (bad + 1)) - math.log((r["good"] + 0.5) / (good + 1)) for r in rows if r["bad"] >= least}
    out: dict[str, float] = {}
    for entry in sorted((e for e, w in odds.items() if w >= margin), key=lambda e: (len(e), e)):
        shorter = [out[entry[:n]] for n in range(5, len(entry)) if entry[:n] in out]
        if not shorter:
            out[entry] = odds[entry]
    return out


def excepted(lexicon: dict[str, float]) -> dict[str, float]:
    """The exception phrases with what takes back every entry that matches inside them, as often as it does."""
    machine = _machine(tuple(sorted(lexicon.items())))
    inside = {f" {p} ": sum(w for _, w in machine.iter(f" {p} ")) for p in EXCEPTIONS}
    return {phrase: -total for phrase, total in inside.items() if total}


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton's method, in a fixed number of steps."""
    a = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(a.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + 0.1 * np.eye(a.shape[1])
        beta += np.linalg.solve(h, a.T @ (y - p) - 0.1 * beta)
    return beta


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = 8192, entries: int = 4000, least: int = 8, margin: float = 2.0) -> dict:
    """The model: {"lexicon": ((entry, weight), ...), "beta": [bias, sum, normalised sum]}, from rows that are not held out."""
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("bad"))
    marked = marked.orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(marked), "id")
    # one text of an id, so that the bound on labelled ids bounds the rows too
    rows = rows.groupBy("id", "bad").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("id", "text", "bad")

    def count(batches):
        seen: dict[str, list[int]] = {}
        for batch in batches:
            for text, bad in zip(batch.column("text").to_pylist(), batch.column("bad").to_pylist(), strict=True):
                words = {w for w in fold(text).split() if w.isalpha()}
                found = {f" {w} " for w in words}
                for n in (4, 5, 6, 7):
                    found.update([" " + w[:n] for w in words if len(w) >= n])
                for e in found:
                    seen.setdefault(e, [0, 0])[bad] += 1
        items = list(seen.items())
        for at in range(0, len(items), 50_000):
            part = items[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([e for e, _ in part]), pa.array([c[1] for _, c in part], pa.int64()), pa.array([c[0] for _, c in part], pa.int64())], ["entry", "bad", "good"])

    totals = marked.agg(F.sum("bad").alias("bad"), F.sum(1 - F.col("bad")).alias("good")).first()
    bad, good = totals["bad"] or 0, totals["good"] or 0
    lexicon = {f" {w}": DEFAULT_WEIGHT for w in INSULTS}
    beta = [-3.0, 1.0, 1.0]
    if bad and good:
        table = rows.select("text", "bad").mapInArrow(frugal(count), "entry string, bad long, good long").groupBy("entry").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
        odds = F.log((F.col("bad") + 0.5) / (bad + 1)) - F.log((F.col("good") + 0.5) / (good + 1))
        best = table.where((F.col("bad") >= least) & (odds >= margin)).orderBy(odds.desc(), "entry").limit(entries).collect()
        lexicon |= _chosen(best, bad, good, least, margin)
    lexicon |= excepted(lexicon)
    model = {"lexicon": tuple(sorted(lexicon.items())), "beta": beta}
    if bad and good:
        entries_now = model["lexicon"]

        def measure(batches):
            for batch in batches:
                x = _features(batch.column("text").to_pylist(), entries_now)
                yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1]), batch.column("bad")], ["sum", "rate", "bad"])

        seen = np.array([[r["sum"], r["rate"], r["bad"]] for r in rows.select("text", "bad").mapInArrow(frugal(measure), "sum double, rate double, bad int").collect()])
        if len(seen):
            seen = seen[np.lexsort(seen.T)]  # the same order, and so the same sums, on every run
            model["beta"] = _logistic(seen[:, :2], seen[:, 2]).tolist()
    return model


def score(docs: DataFrame, model: dict, text_col: str = "text", out_col: str = "toxicity") -> DataFrame:
    """``docs`` with a column ``out_col`` (0 to 1) beside its own."""
    lexicon, beta = model["lexicon"], model["beta"]

    @F.pandas_udf("double")
    def toxicity(texts: pd.Series) -> pd.Series:
        x = _features(texts.tolist(), lexicon)
        give_back()
        return pd.Series(1 / (1 + np.exp(-np.clip(beta[0] + x @ np.array(beta[1:]), -30, 30))))

    return docs.withColumn(out_col, toxicity(F.coalesce(F.col(text_col), F.lit(""))))


def reject(docs: DataFrame, model: dict, bound: float = 0.5, text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that score ``bound`` or more; its columns stay as they were."""
    return score(docs, model, text_col, "__toxicity").where(F.col("__toxicity") < bound).select(*docs.columns)
