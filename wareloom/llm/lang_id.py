"""Language identification by cross-parsing entropy.

For every language a suffix automaton holds all substrings of some labelled
text. A text is parsed greedily into the longest phrases that occur in that
text; log2(labelled length) times the phrases per character estimates the
cross entropy, and the language with the least wins. The automata are laid
out as dense tables, so that all texts of a batch walk in step: a text is cut
into blocks of 512 bytes, every block is a lane, and phrases end at a
block's end at the latest.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wareloom.llm.common import fold

#: Labelled rows per language, whole, at most; none is added to so many bytes or more.
LEARN_ROWS = 60
LEARN_BYTES = 16_384
#: Bytes of each text that are read at once, and texts.
BLOCK = 512
LANES = 16_384
FOLDS = 5
HELD = 0
UNKNOWN = "und"

_LETTER = re.compile(r"[^\W\d_]")
#: a-z are 1 to 26, other ASCII is 0, every byte beyond has its own number.
_SYMBOL = bytes(b - 96 if 97 <= b <= 122 else 0 if b < 128 else b - 101 for b in range(256))
_SYMBOLS = 27 + 128


def symbols(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace").translate(_SYMBOL)


def automaton(data: bytes) -> list[dict[int, int]]:
    """Transitions of the suffix automaton; state 0 is the start."""
    goto: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in data:
        new = len(goto)
        goto.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in goto[p]:
            goto[p][c] = new
            p = link[p]
        if p >= 0:
            q = goto[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(goto)
                goto.append(dict(goto[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and goto[p].get(c) == q:
                    goto[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return goto


class Languages:
    """Labelled text per language; the tables are made where they are used."""

    def __init__(self, texts: dict[str, bytes]) -> None:
        self.names = sorted(texts)
        self.texts = [texts[n] for n in self.names]
        self._tables: list[np.ndarray] | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_tables": None}

    def tables(self) -> list[np.ndarray]:
        """Per language: state * width + symbol -> 2 * (next state * width) + phrase ended.

        Symbols that no language has share a column, and so does the padding,
        which ends nothing.
        """
        if self._tables is None:
            seen = sorted({c for t in self.texts for c in t})
            self.width = len(seen) + 2
            self.column = np.full(_SYMBOLS + 1, len(seen), np.uint8)
            self.column[seen] = np.arange(len(seen))
            self.column[_SYMBOLS] = len(seen) + 1
            self._tables = []
            for text in self.texts:
                goto = automaton(text)
                start = np.zeros(self.width, np.int64)
                for c, s in goto[0].items():
                    start[self.column[c]] = s
                table = np.tile(2 * self.width * start + 1, (len(goto), 1))
                for s, moves in enumerate(goto):
                    for c, to in moves.items():
                        table[s, self.column[c]] = 2 * self.width * to
                table[0] = 2 * self.width * start + (start == 0)  # at the start only an unknown symbol is a phrase
                table[:, -1] = 2 * self.width * np.arange(len(goto))
                self._tables.append(table.ravel().astype(np.int32))
        return self._tables

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """Phrases of each text (rows) in each language (columns); an unfinished one counts.

        Texts are read side by side, the longest first, block after block; each
        keeps its state from block to block, so a phrase may be of any length.
        """
        tables = self.tables()
        counts = np.zeros((len(texts), len(tables)))
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        for first in range(0, len(order), LANES):
            group = order[first : first + LANES]
            lengths = np.array([len(texts[i]) for i in group])
            state, ended = np.zeros((2, len(tables), len(group)), np.int32)
            for at in range(0, int(lengths[0]), BLOCK):
                m = int(np.searchsorted(-lengths, -at))  # texts that go on
                flat = b"".join([texts[i][at : at + BLOCK].ljust(BLOCK, bytes([_SYMBOLS])) for i in group[:m]])
                steps = self.column[np.frombuffer(flat, np.uint8).reshape(m, BLOCK)].T
                steps = np.ascontiguousarray(steps[: int(lengths[0]) - at]).astype(np.int32)
                for table, now, done in zip(tables, state[:, :m], ended[:, :m]):
                    for step in steps:
                        now += step
                        np.take(table, now, out=now, mode="clip")
                        done += now & 1
                        now >>= 1
            counts[group] = (ended + (state > 0)).T
        return counts

    def predict(self, texts: list) -> tuple[list[str], list[float]]:
        known = [i for i, t in enumerate(texts) if self.names and t and _LETTER.search(t)]
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if known:
            data = [symbols(texts[i]) for i in known]
            cost = self.phrases(data) * np.log2([max(2, len(t)) for t in self.texts])
            order = np.argsort(cost, axis=1, kind="stable")
            for row, i in enumerate(known):
                best = cost[row, order[row, 0]]
                second = cost[row, order[row, 1]] if len(self.names) > 1 else np.inf
                names[i] = self.names[order[row, 0]]
                scores[i] = 1.0 if np.isinf(second) else float(second / (best + second))
        return names, scores


def learn(docs: DataFrame, rows: int = LEARN_ROWS, size: int = LEARN_BYTES) -> Languages:
    """Labelled text of each language from at most `rows` documents outside the held-out fold.

    Documents are taken whole, in the order of a hash of the id, until they
    have `size` bytes together; those longer than that by themselves come
    after all others, so a language of long documents only learns from one.
    Null and empty texts, and rows without an id or a language, are left out;
    of rows that share id and language all are taken.
    """
    text = F.col("text").cast("string")
    usable = docs.select(F.col("doc_id").cast("long").alias("i"), F.col("lang").cast("string").alias("l"), F.octet_length(text).alias("n"))
    usable = usable.where(F.col("i").isNotNull() & F.col("l").isNotNull() & (F.col("n") > 0) & (fold(F.col("i"), FOLDS) != HELD))
    order = W.partitionBy("l").orderBy(F.col("n") > size, F.xxhash64("i"), "i")
    ranked = usable.withColumn("r", F.row_number().over(order)).where(F.col("r") <= rows).orderBy("l", "r")
    chosen: dict[tuple[int, str], int] = {}
    total: dict[str, int] = {}
    for r in ranked.collect():  # rows * languages at most
        if total.get(r["l"], 0) < size:
            total[r["l"]] = total.get(r["l"], 0) + r["n"]
            chosen.setdefault((r["i"], r["l"]), r["r"])
    if not chosen:
        return Languages({})
    some = docs.sparkSession.createDataFrame([(i, name) for i, name in chosen], "i long, l string")
    texts = (
        docs.select(F.col("doc_id").cast("long").alias("i"), F.col("lang").cast("string").alias("l"), text.alias("t"))
        .where(F.col("t").isNotNull() & (F.col("t") != ""))
        .join(F.broadcast(some), ["i", "l"], "left_semi")
    )
    parts: dict[str, list[tuple[int, bytes]]] = {}
    for r in texts.toLocalIterator():
        parts.setdefault(r["l"], []).append((chosen[r["i"], r["l"]], symbols(r["t"])))
    joined = {name: b"\x00".join(t for _, t in sorted(found)) for name, found in parts.items()}
    return Languages({name: text for name, text in joined.items() if text.strip(b"\x00")})


def predictions(docs: DataFrame, languages: Languages) -> DataFrame:
    """doc_id, text -> doc_id, held_out, lang_pred, score.

    A null text, one without any letter, and every text where nothing was
    learned give `und` with score 0. The score is second / (best + second) of
    the two least costs: 0.5 is a tie, which the first name wins. Rows with the
    same doc_id are predicted each for itself; an empty table gives no row;
    columns other than doc_id and text are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(languages)  # the learned text of each language

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            names, scores = sent.value.predict(list(frame["text"]))
            yield pd.DataFrame({"doc_id": frame["doc_id"], "lang_pred": names, "score": scores})

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", F.col("text").cast("string")).mapInPandas(work, f"doc_id {kind}, lang_pred string, score double")
    return out.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD).alias("held_out"), "lang_pred", "score")
