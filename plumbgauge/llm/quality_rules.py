"""Quality rules with n-gram perplexity.

The model is an interpolated modified Kneser-Ney bigram model per language, with three discounts, over all words and all pairs of neighbours: counts of pairs above, numbers of
different words before a word below. Words are 32-bit hashes, a pair is two of them. Tasks send the pairs of some thousand texts at a time as sorted arrays, cut by hash into ranges, together with the texts
they stand in. A range's task merges them to the sorted array of its pairs and their counts. What it knows of its words goes, as sorted arrays again, to ranges of words, and comes back as the totals, weights and
probabilities of exactly these words; then each pair has its log probability, and each text of the range its sum: these go back in arrays, a row per block of texts and range, and are added per block. Nothing is capped, broadcast or collected, and the tables grow with the
texts. Equal texts of a language count once. A pair found in every text costs its range's task a few bytes a text.

A document's score is the mean log probability of its words. Per language the median and the median deviation over all documents that pass the
fixed rules give a lower and an upper band; short texts vary more and get wider bands. Outside the bands a document is rejected.

Defined results: a null text has no words; a null language is a language of its own; documents that fail the fixed rules have no verdict of the model, and
kept is false; repeated rows are judged alike; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import gc
import math
import uuid
import zlib
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbgauge.llm.common import cut, ensure_checkpoint_dir, maybe_among, ship

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
LEAST_WORDS, MOST_REPEATED = 50, 0.5
#: Characters of all texts for each range of pairs; a range is held by one task.
RANGE_CHARS = 36_000_000
_AT_ONCE, _TEXTS = 3 << 20, 4096
_KEPT = 400_000
_LOW = np.uint64(0xFFFFFFFF)


def base_counts(text: str, words: list[bytes]) -> tuple[int, int, int, int]:
    """word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    chars = len(text) - sum(map(text.count, BLANKS))
    symbols = sum(map(text.count, SYMBOLS))
    seen, dups = set(), 0
    for line in text.split("\n"):
        if line in seen:
            dups += 1
        elif line.strip(BLANKS):
            seen.add(line)
    return chars, symbols, dups, repeated_words(words)


def repeated_words(words: list[bytes], size: int = 3) -> int:
    """Words inside a window of ``size`` that occurs at least twice."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)
    mixed = np.zeros(n, dtype=np.uint64)
    for i in range(size):
        mixed = _mix(mixed ^ h[i:i + n])
    order = np.argsort(mixed, kind="stable")
    ranked = mixed[order]
    same = ranked[1:] == ranked[:-1]
    again = np.zeros(n, dtype=bool)
    again[order[1:]] |= same
    again[order[:-1]] |= same
    inside = np.zeros(len(words), dtype=bool)
    for i in range(size):
        inside[i:i + n] |= again
    return int(inside.sum())


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Hashes(dict):
    """32-bit hashes of words, the same on every machine."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = int.from_bytes(blake2b(word, digest_size=4).digest(), "little")
        return value

    def of(self, text: bytes | None) -> np.ndarray:
        words = (text or b"").split()
        out = np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))
        if len(self) > _KEPT:
            self.clear()
        return out


def different_texts(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """(_key, lang, text as bytes): equal texts of a language once. Only texts that may have a copy are shuffled."""
    keyed = docs.select(text_key(lang_col, text_col).alias("_key"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("binary").alias("text"))
    copied = cut(keyed.groupBy("_key").count().where("count > 1").select(F.col("_key").alias("lid")))
    marked = maybe_among(keyed, "_key", copied)
    once = marked.where("_maybe").groupBy("_key").agg(F.first("lang").alias("lang"), F.first("text").alias("text"))
    once = once.sortWithinPartitions("_key")  # a task that is run again makes the same blocks
    return marked.where("not _maybe").select("_key", "lang", "text").unionByName(once)


def text_key(lang_col: str, text_col: str):
    lang = F.col(lang_col).cast("string")
    return F.xxhash64(lang.isNull(), lang, F.col(text_col))


def _spread(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Range of each pair, by its first word's hash and a step by its second's: a word that begins a sixteenth of all pairs adds to no range more than its usual size."""
    slices = np.uint64(1 + ranges // 16)
    return ((_mix(keys >> np.uint64(32)) % np.uint64(ranges) + _mix(keys & _LOW) % slices) % np.uint64(ranges)).astype(np.int64)


def _planes(numbers: np.ndarray) -> bytes:
    """32-bit numbers by byte, all first bytes first: those of small numbers are zero, which the shuffle's compression removes."""
    return numbers.view(np.uint8).reshape(-1, 4).T.tobytes()


def _unplaned(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype=np.uint8).reshape(4, -1).T.copy().view(np.uint32).ravel()


def _steps(numbers: np.ndarray) -> bytes:
    """Sorted 32-bit numbers as differences."""
    return _planes(np.diff(numbers, prepend=numbers.dtype.type(0)))


def _unstepped(raw: bytes) -> np.ndarray:
    return np.cumsum(_unplaned(raw), dtype=np.uint32)


def _ranked(numbers: np.ndarray) -> bytes:
    """32-bit numbers as steps of their places among the different ones, after these: many texts repeat few words."""
    kinds = np.unique(numbers)
    return len(kinds).to_bytes(4, "little") + _steps(kinds) + _steps(np.searchsorted(kinds, numbers).astype(np.uint32))


def _unranked(raw: bytes) -> np.ndarray:
    end = 4 + 4 * int.from_bytes(raw[:4], "little")
    return _unstepped(raw[4:end])[_unstepped(raw[end:])]


def _squeezed(words: np.ndarray, numbers: np.ndarray) -> tuple[bytes, bytes]:
    """Sorted words and five numbers for each, compressed: they are written to checkpoints, which are not."""
    planes = numbers.astype(np.uint64, order="C").view(np.uint8).reshape(-1, 8).T
    return zlib.compress(_steps(words), 1), zlib.compress(planes.tobytes(), 1)


def _words_of(raw: bytes) -> np.ndarray:
    return _unstepped(zlib.decompress(raw))


def _numbers_of(raw: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(raw), dtype=np.uint8).reshape(8, -1).T.copy().view(np.uint64).reshape(5, -1).astype(np.float64)


def _twelve(places: np.ndarray) -> bytes:
    """Numbers below 4096 in a byte and a half each."""
    high = (places >> 8).astype(np.uint8)
    high = np.append(high, np.zeros(len(high) % 2, dtype=np.uint8))
    return places.astype(np.uint8).tobytes() + (high[::2] << 4 | high[1::2]).tobytes()


def _untwelve(raw: bytes, n: int) -> np.ndarray:
    both = np.frombuffer(raw, dtype=np.uint8)
    high = np.stack([both[n:] >> 4, both[n:] & 15], axis=1).ravel()[:n]
    return both[:n].astype(np.int64) | high.astype(np.int64) << 8


def _pressed(raw: bytes) -> bytes:
    """Compressed in the task that makes them, so that no process holds or sends the empty planes."""
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True)


def _unpressed(raw: bytes) -> bytes:
    return pa.Codec("zstd").decompress(raw[8:], int.from_bytes(raw[:8], "little"), asbytes=True)


def packed_pairs(texts: DataFrame, ranges: int, scored: bool = True) -> DataFrame:
    """The pairs of neighbours of some thousand texts at a time, by range: what is counted and what is scored, in arrays.

    ``firsts`` and ``sizes`` are the first words in order and how many pairs each begins, ``seconds`` the second words in order within these: a sorted array of pairs in
    half the space. ``spans`` says in how many texts a pair stands, ``places`` in which, as places among the texts of its ``block``, and ``times`` how often. ``docs``, these texts, goes with
    the block's first range only. Where nothing is ``scored`` the texts are left out, as if all were one.
    """
    names = ["range", "g", "block", "firsts", "sizes", "seconds", "spans", "times", "docs", "places"]

    def taken(held):
        for g, parts in held.items():
            docs = np.array([key for key, _ in parts if scored], dtype=np.int64).tobytes()
            block = int.from_bytes(blake2b(docs, digest_size=8).digest(), "little", signed=True)
            keys = np.concatenate([k for _, k in parts])
            place = np.repeat(np.arange(len(parts), dtype=np.uint16) * np.uint16(scored), [len(k) for _, k in parts])
            order = np.lexsort((place, keys))
            keys, place = keys[order], place[order]
            new = np.ones(len(keys), dtype=bool)
            new[1:] = (keys[1:] != keys[:-1]) | (place[1:] != place[:-1])
            at = np.nonzero(new)[0]
            times, keys, place = np.diff(np.append(at, len(keys))).astype(np.uint32), keys[at], place[at]
            del order, new, at
            where = _spread(keys, ranges)
            order = np.argsort(where, kind="stable")
            ends = np.searchsorted(where[order], np.arange(ranges + 1))
            for r in range(ranges):
                mine = order[ends[r]:ends[r + 1]]
                if len(mine):
                    k = keys[mine]
                    starts = np.nonzero(np.append(True, k[1:] != k[:-1]))[0]
                    pairs, spans = k[starts], np.diff(np.append(starts, len(k))).astype(np.uint32)
                    first = pairs >> np.uint64(32)
                    heads = np.nonzero(np.append(True, first[1:] != first[:-1]))[0]
                    arrays = [_steps(first[heads].astype(np.uint32)), _planes(np.diff(np.append(heads, len(pairs))).astype(np.uint32)), _ranked((pairs & _LOW).astype(np.uint32)),
                              _planes(spans), _planes(times[mine]), docs, _twelve(place[mine]) if scored else b""]
                    yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([g], pa.int64()), pa.array([block], pa.int64()), *(pa.array([_pressed(x)], pa.binary()) for x in arrays)], names=names)
                    docs = b""

    def run(batches):
        known, held, size = _Hashes(), {}, 0
        for batch in batches:
            for key, g, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                words = known.of(text.as_py())
                for at in range(0, max(len(words) - 1, 0), _AT_ONCE):  # a very long text in parts
                    part = words[at:at + _AT_ONCE + 1]
                    mine = held.setdefault(g, [])
                    mine.append((key, part[:-1] << np.uint64(32) | part[1:]))
                    size += len(part)
                    if size > _AT_ONCE:
                        yield from taken(held)
                        held, size = {}, 0
                    elif len(mine) == _TEXTS:
                        yield from taken({g: held.pop(g)})
                        size -= sum(len(k) + 1 for _, k in mine)
        yield from taken(held)

    return texts.select("_key", language_key("lang").alias("g"), "text").mapInArrow(
        run, "range int, g long, block long, firsts binary, sizes binary, seconds binary, spans binary, times binary, docs binary, places binary")


class _Row:
    """Arrays of a row of ``packed_pairs``."""

    def __init__(self, table: pa.Table, i: int):
        def of(name):
            return _unpressed(table.column(name)[i].as_py())
        self.g, self.block = table.column("g")[i].as_py(), table.column("block")[i].as_py()
        self.pairs = np.repeat(_unstepped(of("firsts")).astype(np.uint64) << np.uint64(32), _unplaned(of("sizes"))) | _unranked(of("seconds"))
        self.spans, self.times = _unplaned(of("spans")), _unplaned(of("times"))
        self.docs, self._placed = table.column("docs")[i].as_py(), table.column("places")[i]

    @property
    def places(self) -> np.ndarray:
        return _untwelve(_unpressed(self._placed.as_py()), len(self.times))

    def counts(self) -> np.ndarray:
        return np.add.reduceat(self.times.astype(np.int64), np.append(0, np.cumsum(self.spans)[:-1]).astype(np.int64)) if len(self.pairs) else np.zeros(0, dtype=np.int64)


def counted_range(table: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per language the sorted pairs of a range and their numbers over all texts."""
    parts: dict[int, list] = {}
    for i in range(table.num_rows):
        row = _Row(table, i)
        parts.setdefault(row.g, []).append((row.pairs, row.counts()))
        if len(parts[row.g]) >= 64:
            parts[row.g] = [_summed(parts[row.g])]
    return {g: _summed(p) for g, p in parts.items()}


def _summed(parts: list) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.nonzero(np.append(True, keys[1:] != keys[:-1]))[0]
    return keys[starts], np.add.reduceat(counts[order], starts)


def word_numbers(pairs: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of some pairs in order and, a row each: how often it is first, with how many different seconds once, twice and more, and after how many different firsts."""
    first, second = (pairs >> np.uint64(32)).astype(np.uint32), (pairs & _LOW).astype(np.uint32)
    words = np.union1d(first, second)
    at, n = np.searchsorted(words, first), len(words)
    rows = [np.bincount(at, counts, n), *(np.bincount(at[c], minlength=n) for c in (counts == 1, counts == 2, counts > 2)), np.bincount(np.searchsorted(words, second), minlength=n)]
    return words, np.array(rows).astype(np.int64)


def range_words(packed: DataFrame, ranges: int) -> DataFrame:
    """What each range of pairs knows of its words, by range of words, with the language's numbers of pairs that occur once to four times."""
    def run(key, table):
        out = []
        for g, (pairs, counts) in counted_range(table).items():
            words, numbers = word_numbers(pairs, counts)
            part = (words.astype(np.int64) * ranges) >> 32
            ends = np.searchsorted(part, np.arange(ranges + 1))
            classes = [len(pairs), *(int((counts == i).sum()) for i in (1, 2, 3, 4))]
            for p in np.unique(part).tolist():
                s = slice(ends[p], ends[p + 1])
                out.append((p, g, key[0].as_py(), *_squeezed(words[s], numbers[:, s]), *classes))
                classes = [0] * 5  # once per range and language
        return pa.table([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 10, _WORD_TYPES)], names=_WORD_NAMES)

    return packed.groupBy("range").applyInArrow(run, "part int, g long, range int, words binary, numbers binary, kinds long, n1 long, n2 long, n3 long, n4 long")


_WORD_NAMES = ["part", "g", "range", "words", "numbers", "kinds", "n1", "n2", "n3", "n4"]
_WORD_TYPES = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), *[pa.int64()] * 5]
_LAW = ["d1", "d2", "d3", "kinds"]


def word_laws(numbers: DataFrame) -> DataFrame:
    """For each range of pairs its words with what the model needs of them: how often first, the weight left to single words after it, and its own as a single word."""
    law = numbers.groupBy("g").agg(*[F.sum(c).alias(c) for c in ("kinds", "n1", "n2", "n3", "n4")])
    n1, n2, n3 = (F.nullif(F.col(f"n{i}"), F.lit(0)) for i in (1, 2, 3))
    usual, known = [0.5, 0.75, 0.9], n1.isNotNull() & n2.isNotNull()
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * F.col("n3") / n2, F.coalesce(3 - 4 * y * F.col("n4") / n3, F.lit(1.5))]
    most, least = [0.95, 1.9, 2.9], [0.05, 0.1, 0.1]
    law = law.select("g", "kinds", *[F.when(known, F.least(F.greatest(d[i], F.lit(least[i])), F.lit(most[i]))).otherwise(usual[i]).alias(f"d{i + 1}") for i in range(3)])

    def run(table):
        words = [_words_of(b) for b in table.column("words").to_pylist()]
        every = np.unique(np.concatenate(words))
        total = np.zeros((5, len(every)))
        for w, b in zip(words, table.column("numbers").to_pylist()):
            total[:, np.searchsorted(every, w)] += _numbers_of(b)
        told = [_squeezed(w, total[:, np.searchsorted(every, w)])[1] for w in words]
        return pa.table([table.column("range"), table.column("g"), table.column("part"), pa.array(told, pa.binary()), *(table.column(c) for c in _LAW)], names=["range", "g", "part", "numbers", *_LAW])

    # groups are (range of words, language): a word's numbers of every range of pairs
    return numbers.drop("kinds", "n1", "n2", "n3", "n4").join(law, "g").groupBy("part", "g").applyInArrow(
        run, "range int, g long, part int, numbers binary, d1 double, d2 double, d3 double, kinds long")


def logs_of(pairs: np.ndarray, counts: np.ndarray, words: np.ndarray, numbers: np.ndarray, discounts: np.ndarray, kinds: float) -> np.ndarray:
    """Log probability of the second word after the first: modified Kneser-Ney, two levels, from the numbers of ``word_numbers`` over all ranges."""
    total = np.maximum(numbers[0], 1)
    left, lower = discounts @ numbers[1:4] / total, numbers[4] / kinds
    a, b = np.searchsorted(words, (pairs >> np.uint64(32)).astype(np.uint32)), np.searchsorted(words, (pairs & _LOW).astype(np.uint32))
    own = (counts - discounts[np.minimum(counts, 3) - 1]) / total[a]
    return np.log(own + left[a] * lower[b])


def range_scores(packed: DataFrame, laws: DataFrame) -> DataFrame:
    """(block, range, docs, places, n, logs): of each block's texts in a range the number of their pairs there and the sum of their logs, in arrays."""
    def run(left, right):
        told: dict[int, list] = {}
        for g, part, numbers, *law in zip(*(right.column(c).to_pylist() for c in ("g", "part", "numbers", *_LAW))):
            told.setdefault(g, []).append((part, numbers, law))
        model = {}  # sorted arrays: pairs and their logs
        for g, (pairs, counts) in counted_range(left).items():
            parts = sorted(told[g])
            *d, kinds = parts[0][2]
            # the words are those this range sent out, in their order
            words = np.union1d((pairs >> np.uint64(32)).astype(np.uint32), (pairs & _LOW).astype(np.uint32))
            model[g] = pairs, logs_of(pairs, counts, words, np.concatenate([_numbers_of(p[1]) for p in parts], axis=1), np.array(d), kinds)
        out = []
        for i in range(left.num_rows):
            row = _Row(left, i)
            pairs, logs = model[row.g]
            each = np.repeat(logs[np.searchsorted(pairs, row.pairs)], row.spans) * row.times
            places = row.places
            n, log = np.bincount(places, row.times).astype(np.uint32), np.bincount(places, each).astype(np.float32)
            met = np.nonzero(n)[0]
            arrays = [_steps(met.astype(np.uint32)), _planes(n[met]), _planes(log[met].view(np.uint32))]
            out.append((row.block, left.column("range")[i].as_py(), row.docs, *map(_pressed, arrays)))
        return pa.table([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 6, [pa.int64(), pa.int32(), *[pa.binary()] * 4])], names=["block", "range", "docs", "places", "n", "logs"])

    return packed.groupBy("range").cogroup(laws.groupBy("range")).applyInArrow(run, "block long, range int, docs binary, places binary, n binary, logs binary")


def text_sums(scored: DataFrame) -> DataFrame:
    """(_key, n, log) of every text of a block over all ranges."""
    def run(table):
        table = table.sort_by("range")
        told = {c: [_unpressed(raw) for raw in table.column(c).to_pylist()] for c in ("docs", "places", "n", "logs")}
        docs = np.frombuffer(next(filter(None, told["docs"])), dtype=np.int64)
        n, log = np.zeros(len(docs), dtype=np.int64), np.zeros(len(docs))
        for places, numbers, logs in zip(told["places"], told["n"], told["logs"]):
            at = _unstepped(places)
            n[at] += _unplaned(numbers)
            log[at] += _unplaned(logs).view(np.float32)
        return pa.table([pa.array(docs), pa.array(n), pa.array(log)], names=["_key", "n", "log"])

    return scored.groupBy("block").applyInArrow(run, "_key long, n long, log double")


def _written(df: DataFrame) -> str:
    """``df`` as Parquet in the shared checkpoint folder. Spark drops the shuffle that made it when the plan is collected."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/words-{uuid.uuid4().hex}"
    df.write.parquet(path)
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return path


def _deleted(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def language_key(lang_col: str):
    lang = F.col(lang_col).cast("string")
    return F.xxhash64(lang.isNull(), lang)


def scores(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(_key, log_perplexity) of every text with two words."""
    ship(docs.sparkSession)
    texts = different_texts(docs, lang_col, text_col)
    size = docs.agg(F.sum(F.length(F.col(text_col)))).first()[0] or 0
    ranges = max(1, math.ceil(size / RANGE_CHARS))
    folder = _written(range_words(packed_pairs(texts, ranges, scored=False), ranges))
    laws = cut(word_laws(docs.sparkSession.read.parquet(folder)))
    _deleted(docs.sparkSession, folder)
    return text_sums(range_scores(packed_pairs(texts, ranges), laws)).groupBy("_key").agg((-F.sum("log") / F.sum("n")).alias("log_perplexity"))


def judged(docs: DataFrame, width: float = 4.0, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: the fixed counts, base_failed, log_perplexity, its language's bands, and kept."""
    kind = docs.schema[id_col].dataType.simpleString()
    ship(docs.sparkSession)
    names = ["_key", "doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches):
        for batch in batches:
            rows = []
            for value in batch.column(3):
                text = value.as_py() or ""
                words = text.encode().split()
                rows.append((len(words), *base_counts(text, words)))
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(c, pa.int64()) for c in columns)], names=names)

    counted = docs.select(text_key(lang_col, text_col).alias("_key"), F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).mapInArrow(
        run, f"_key long, doc_id {kind}, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long")
    told = cut(counted.join(scores(docs, lang_col, text_col), "_key", "left").drop("_key"))
    failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    told = told.withColumn("base_failed", failed)
    sound = told.where(~F.col("base_failed") & F.col("log_perplexity").isNotNull())
    middle = sound.groupBy("lang").agg(F.percentile_approx("log_perplexity", 0.5, 10_000).alias("center"))
    middle = F.broadcast(middle.withColumnRenamed("lang", "_lang"))  # a row per language
    off = F.abs(F.col("log_perplexity") - F.col("center"))
    spread = sound.join(middle, F.col("lang").eqNullSafe(F.col("_lang"))).groupBy("_lang", "center").agg(
        F.percentile_approx(off, 0.5, 10_000).alias("spread"), F.percentile_approx("n_words", 0.5, 10_000).alias("usual"))
    # texts shorter than usual vary more, with the square root of their length
    short = F.sqrt(F.greatest(F.lit(1.0), F.try_divide(F.col("usual"), F.col("n_words"))))
    reach = width * 1.4826 * F.greatest("spread", F.lit(1e-6)) * short
    spread = F.broadcast(cut(spread))
    return told.join(spread, F.col("lang").eqNullSafe(F.col("_lang")), "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.coalesce(off <= reach, F.lit(True))).alias("kept"), "log_perplexity",
        (F.col("center") - reach).alias("lower_band"), (F.col("center") + reach).alias("upper_band"))
