"""Language of a text by cross-parsing entropy against suffix automata."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adtide.llm.staging import hold, settle, ship

#: Bound of the fitted sample: of each language at most so many texts (one per cell of their hash), together
#: at most so many characters.  Prediction reads whole texts, and every row.
SAMPLE_TEXTS = 64
SAMPLE_CHARS = 24_000
#: Symbols: 0 is anything that is not a letter, the most frequent letters have their own, the rest share by code block.
OWN_LETTERS = 79
SHARED = 16
SYMBOLS = 1 + OWN_LETTERS + SHARED
#: A parse starts anew after so many symbols, which adds at most one phrase per piece for each language alike.
PIECE = 1024
UNKNOWN = "und"


def sample(labelled: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """``(lang, text)``: per language one text of each of ``SAMPLE_TEXTS`` hash cells, texts of up to
    4,000 characters first.  A partially aggregated minimum, so a language with most rows is no hot group."""
    h = F.xxhash64(text)
    rows = labelled.filter(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(
        F.col(lang).alias("lang"), F.pmod(h, F.lit(SAMPLE_TEXTS)).alias("cell"), F.struct((F.length(text) > 4000).alias("long"), h.alias("h")).alias("o"), F.col(text).alias("text")
    )
    return rows.groupBy("lang", "cell").agg(F.min_by("text", "o").alias("text"), F.min("o").alias("o")).select("lang", "text", "o")


class Model:
    """One automaton per language, as a table from (state, symbol) to the next state.

    A state is one of the suffix automaton of the language's sample.  Where the
    automaton has no such step the phrase ends, and the entry is the step from
    the start.  The lowest two bits count the phrases that end at a step: the
    open one, and a symbol that the sample lacks, which is one of its own.
    """

    def __init__(self, texts: dict[str, str]) -> None:
        self.langs = sorted(texts)
        letters = Counter(c for t in texts.values() for c in t.lower() if c.isalpha())
        own = sorted(letters, key=lambda c: (-letters[c], c))[:OWN_LETTERS]
        codes = np.zeros(0x110000, np.uint8)
        for block in range(0, 0x110000, 128):
            codes[block : block + 128] = 1 + OWN_LETTERS + (block >> 7) % SHARED
        is_letter = np.zeros(0x110000, bool)
        for point in range(0x110000):
            is_letter[point] = not 0xD800 <= point < 0xE000 and chr(point).isalpha()
        codes[~is_letter] = 0
        for n, c in enumerate(own):
            codes[ord(c)] = n + 1
        self.codes = codes
        coded = [self.encode(texts[lang].lower()) for lang in self.langs]
        # an automaton has at most twice as many states as symbols; pages that stay empty take no memory
        table = np.empty((sum(2 * len(c) + 1 for c in coded), SYMBOLS), np.int32)
        self.starts, at = [], 0
        for codes in coded:
            self.starts.append(at)
            at += _automaton(codes, at, table)
        self.table = table[:at].ravel()

    def encode(self, text: str) -> np.ndarray:
        """Symbols of a text, runs of non-letters as one."""
        out = self.codes[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        return out[(out != 0) | np.concatenate(([True], out[:-1] != 0))] if len(out) else out

    def phrases(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of each text in each language, and symbols of each text (0: no letter in it)."""
        coded = [self.encode(t.lower()) if t else np.zeros(0, np.uint8) for t in texts]
        sizes = np.array([len(c) if c.any() else 0 for c in coded], np.int64)
        pieces = [(len(c[i : i + PIECE]), n, c[i : i + PIECE]) for n, c in enumerate(coded) if sizes[n] for i in range(0, len(c), PIECE)]
        pieces.sort(key=lambda p: (-p[0], p[1]))
        counts = np.zeros((len(self.langs), len(texts)), np.int64)
        for at in range(0, len(pieces), 8192):  # so much is held at a time, however long a text is
            counts += self._parse(pieces[at : at + 8192], len(texts))
        return counts, sizes

    def _parse(self, pieces: list[tuple[int, int, np.ndarray]], texts: int) -> np.ndarray:
        """Phrases per language and text of pieces sorted by falling length, all parsed side by side."""
        counts = np.zeros((len(self.langs), texts), np.int64)
        length = np.array([p[0] for p in pieces])
        owner = np.array([p[1] for p in pieces])
        grid = np.zeros((length[0], len(pieces)), np.uint8)
        for n, (size, _, codes) in enumerate(pieces):
            grid[:size, n] = codes
        live = np.searchsorted(-length, -np.arange(1, length[0] + 1), side="right")
        for n, start in enumerate(self.starts):
            state = np.full(len(pieces), start * SYMBOLS, np.int32)
            ends = np.zeros(len(pieces), np.int64)
            for i in range(length[0]):
                k = live[i]
                step = self.table[state[:k] + grid[i, :k]]
                ends[:k] += step & 3
                state[:k] = (step >> 2) * SYMBOLS
            ends += state != start * SYMBOLS  # the phrase still open
            counts[n] = np.bincount(owner, ends, texts).astype(np.int64)
        return counts

    def predict(self, texts: list[str | None]) -> pd.DataFrame:
        """Language and score (0 to 1): how many phrases fewer the winner needs than the next, as a share."""
        counts, sizes = self.phrases(texts)
        if not self.langs:
            return pd.DataFrame({"lang_pred": [UNKNOWN] * len(texts), "score": 0.0})
        best = counts.argmin(0)  # of equals the first by name
        rest = np.sort(counts, 0)[1] if len(self.langs) > 1 else counts[0] * 2
        low = counts.min(0)
        score = np.where(sizes > 0, (rest - low) / np.maximum(rest, 1), 0.0)
        names = [self.langs[b] if s else UNKNOWN for b, s in zip(best, sizes, strict=True)]
        return pd.DataFrame({"lang_pred": names, "score": score})


def _automaton(codes: np.ndarray, offset: int, tables: np.ndarray) -> int:
    """Write the suffix automaton of ``codes`` to the rows of ``tables`` from ``offset`` on, as steps
    (state * 4 + phrases ended); returns its number of states."""
    nexts: list[dict[int, int]] = [{}]
    link, size, last = [-1], [0], 0
    for c in codes.tolist():
        new = len(nexts)
        nexts.append({})
        size.append(size[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nexts[p]:
            nexts[p][c] = new
            p = link[p]
        if p >= 0:
            q = nexts[p][c]
            if size[p] + 1 == size[q]:
                link[new] = q
            else:
                twin = len(nexts)
                nexts.append(dict(nexts[q]))
                size.append(size[p] + 1)
                link.append(link[q])
                while p >= 0 and nexts[p].get(c) == q:
                    nexts[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    table = tables[offset : offset + len(nexts)]
    known = [*nexts[0].items()]
    table[:] = offset * 4 + 2  # a symbol the sample lacks ends the open phrase and is one itself
    table[0] = offset * 4 + 1
    for c, q in known:
        table[1:, c] = (q + offset) * 4 + 1
    for s, steps in enumerate(nexts):
        for c, q in steps.items():
            table[s, c] = (q + offset) * 4
    return len(nexts)


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, str]:
    """The sample text of each language; at most ``SAMPLE_CHARS`` characters each (the fitted bound)."""
    chosen = settle(sample(labelled, text, lang), "language-sample").orderBy("lang", "o").toLocalIterator()
    out: dict[str, str] = {}
    for row in chosen:
        have = out.get(row.lang, "")
        if len(have) < SAMPLE_CHARS:
            out[row.lang] = (have + "\n" + row.text)[:SAMPLE_CHARS]
    return {k: v for k, v in out.items() if any(c.isalpha() for c in v)}


def _model(key: int, texts: dict[str, str]) -> Model:
    """The automata are built once per worker process from the sample texts."""
    return hold(("language", key), lambda: Model(texts))


def identify(docs: DataFrame, labelled: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """Add ``lang_pred`` and ``score`` to ``docs``, learned from ``labelled``.

    Each language's sample gives a suffix automaton.  A text is cut greedily
    into the longest phrases that the sample of a language holds (cross-parsing);
    the language that needs fewest phrases wins, ties go to the first name.  All
    languages parse the same symbols, so the phrases per symbol rank alike.  The
    score is the share by which the winner's phrases fall short of the next
    language's.  A text that is null, empty or without a letter gets ``und``
    and 0, as does every text if nothing was learned.

    Texts are whole and go through no shuffle.  Columns of ``docs`` with the
    names of the results are replaced; repeated rows get equal results.
    """
    ship(docs.sparkSession)
    texts = fit(labelled, text, lang)
    key = hash(tuple(sorted(texts.items())))
    shared = docs.sparkSession.sparkContext.broadcast(texts)  # bounded by SAMPLE_CHARS per language
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept])
    place = kept.index(text)  # the text goes to the workers once

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(key, shared.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                found = model.predict(batch.column(place).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(found.lang_pred, pa.string()), pa.array(found.score, pa.float64())],
                    names=[*batch.schema.names, "lang_pred", "score"],
                )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{fields}, lang_pred string, score double")
