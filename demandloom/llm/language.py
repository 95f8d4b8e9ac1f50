"""Language of a text by known words, backing off to shorter and shorter character n-grams."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from .arrays import NO_LETTER, slices, span_hashes, text_arrays, word_borders, BYTE_VALUE

UNDETERMINED = "und"
LONGEST_GRAM = 5
CACHED_WORDS = 400_000


@dataclass
class LanguageModel:
    """Log frequencies by language: of words, and of n-grams of padded words by length.

    N-grams are Arrow strings; their places are looked up in dictionaries that each task builds for itself.
    """

    languages: list[str]
    words: np.ndarray
    word_logs: np.ndarray
    grams: list[pa.Array]
    gram_logs: list[np.ndarray]
    seen: dict[int, np.ndarray] = field(default_factory=dict)

    @cached_property
    def places(self) -> list[dict[str, int]]:
        return [{g: i for i, g in enumerate(x.to_pylist())} for x in self.grams]

    def unseen(self, word: str) -> np.ndarray:
        """Mean log frequency of the longest n-grams of the word that are known in any language."""
        padded = f"_{word}_"
        for n in range(LONGEST_GRAM, 0, -1):
            known = self.places[n - 1]
            rows = [r for i in range(len(padded) - n + 1) if (r := known.get(padded[i : i + n])) is not None]
            if rows:
                return self.gram_logs[n - 1][rows].mean(0)
        return np.zeros(len(self.languages))

    def scores(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Index of the best language and its posterior probability for each text."""
        data, bounds = text_arrays(pc.utf8_lower(column))
        start, end, row = word_borders(data, bounds, NO_LETTER)
        hashes = span_hashes(BYTE_VALUE[data], start, end)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        known = self.words[at] == hashes
        new, first, back = np.unique(hashes[~known], return_index=True, return_inverse=True)
        place = np.flatnonzero(~known)[first]
        if len(self.seen) > CACHED_WORDS:
            self.seen.clear()
        logs = np.empty((len(new), len(self.languages)))
        for i, h in enumerate(new.tolist()):
            got = self.seen.get(h)
            if got is None:
                w = data[start[place[i]] : end[place[i]]].tobytes().decode("utf-8", "replace")
                got = self.seen[h] = self.unseen(w)
            logs[i] = got
        total = np.zeros((len(bounds) - 1, len(self.languages)))
        for k in range(len(self.languages)):
            value = np.empty(len(hashes))
            value[known] = self.word_logs[at[known], k]
            value[~known] = logs[back, k]
            total[:, k] = np.bincount(row, value, len(bounds) - 1)
        best = total.argmax(1)
        odds = np.exp(total - total.max(1, keepdims=True))
        return best, 1 / odds.sum(1)


def _logs(table: np.ndarray) -> np.ndarray:
    return np.log((table + 0.1) / (table.sum(0) + 0.1 * (len(table) + 1)))


PIECE = "l string, size int, piece string, n long"
#: Pieces counted in a task before they are handed on.
HELD_PIECES = 100_000


def counted_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words (size 0) and of n-grams of padded words (size n) by language, added up over what a task holds."""
    held: Counter[tuple] = Counter()

    def flush():
        lang, size, piece = zip(*held)
        columns = [pa.array(lang, pa.string()), pa.array(size, pa.int32()), pa.array(piece, pa.string()), pa.array(held.values(), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["l", "size", "piece", "n"])
        held.clear()

    for batch in batches:
        for lang, word, k in zip(*(batch.column(c).to_pylist() for c in ("l", "w", "n"))):
            padded = f"_{word}_"
            held[lang, 0, word] += k
            for n in range(1, LONGEST_GRAM + 1):
                for i in range(len(padded) - n + 1):
                    held[lang, n, padded[i : i + n]] += k
            if len(held) >= HELD_PIECES:
                yield from flush()
    if held:
        yield from flush()


def fit_language_model(records: DataFrame, text: str, language: str, labelled_rows: int = 1_500) -> LanguageModel | None:
    """Learn word and n-gram frequencies from labelled texts; None without any.

    The fit reads a bounded sample: about ``labelled_rows`` rows of every language, chosen by a hash of the text (all of them
    if there are fewer), so a rare language is learned as well as a common one. Every word of it counts, at any size.
    """
    rows = records.select(F.col(text).alias("t"), F.col(language).alias("l")).where("l IS NOT NULL AND t IS NOT NULL")
    spread = 1 << 30
    shares = rows.groupBy("l").agg(F.least(F.lit(spread), F.ceil(F.lit(labelled_rows * spread) / F.count(F.lit(1)))).alias("share"))
    # One row per language, as many as the model itself sends to every task; else all texts would meet in one task per language.
    rows = rows.join(F.broadcast(shares), "l").where(F.pmod(F.xxhash64("t"), F.lit(spread)) < F.col("share"))
    words = rows.select("l", F.explode(F.split(F.lower("t"), "[\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+")).alias("w")).where("w <> ''")
    counts = words.groupBy("l", "w").agg(F.count(F.lit(1)).alias("n")).mapInArrow(counted_pieces, PIECE)
    # Counts of the bounded sample; as Arrow columns they take a few bytes an n-gram on the driver.
    found = counts.groupBy("l", "size", "piece").agg(F.sum("n").alias("n")).toArrow()
    if not found.num_rows:
        return None
    names = sorted(pc.unique(found["l"]).to_pylist())
    tables = []
    for size in range(LONGEST_GRAM + 1):
        part = found.filter(pc.equal(found["size"], size))
        piece = part["piece"].combine_chunks().dictionary_encode()
        table = np.zeros((len(piece.dictionary), len(names)))
        at = pc.index_in(part["l"], pa.array(names, part.schema.field("l").type)).to_numpy()
        table[piece.indices.to_numpy(), at] = part["n"].to_numpy()
        tables.append((piece.dictionary, _logs(table)))
    (column, word_logs), *grams = tables
    data, bounds = text_arrays(column)
    hashes = span_hashes(BYTE_VALUE[data], bounds[:-1], bounds[1:])
    order = np.argsort(hashes)
    return LanguageModel(names, hashes[order], word_logs[order], [g for g, _ in grams], [x for _, x in grams])


def identify_language(
    records: DataFrame, training: DataFrame, key: str = "SKU", text: str = "Product_Name", language: str = "language", labelled_rows: int = 1_500,
) -> DataFrame:
    """Predicted language of every item text: (key, ``lang_pred``, ``score``).

    The item master has no language field, so ``training`` brings one (``language``) beside the text; neither it nor the key is
    used to predict. A word known from training adds its log frequency in each language, an unknown word the mean log frequency
    of its longest known character n-grams (length 5 down to 1, word borders included). The score is the posterior probability
    of the winner under equal priors. A null text, a text without a letter, or training without labels gives ``und`` and 0.
    Ties go to the first language by name. Rows with a null key and repeated rows are predicted like any other. Other columns
    are dropped. The model holds what a sample of about ``labelled_rows`` labelled rows of each language shows, so its size is bounded.
    """
    schema = T.StructType(
        [T.StructField(key, records.schema[key].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    )
    model = fit_language_model(training, text, language, labelled_rows)
    if model is None:
        # Nothing was learned, so nothing can be told apart.
        return records.select(key, F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    sent = records.sparkSession.sparkContext.broadcast(vars(model))

    def predict(batches):
        m = LanguageModel(**sent.value)
        labels = pa.array([*m.languages, UNDETERMINED])
        for batch in slices(batches, text):
            column = batch.column(text)
            best, score = m.scores(column)
            blank = ~pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            picked = labels.take(pa.array(np.where(blank, len(m.languages), best)))
            yield pa.RecordBatch.from_arrays([batch.column(key), picked, pa.array(np.where(blank, 0.0, score))], names=schema.names)

    return records.select(key, text).mapInArrow(predict, schema)
