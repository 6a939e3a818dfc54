"""Records of evaluation splits whose text is in the training split too, exactly or almost.

Texts are reduced to words, and equal word sequences to one text; equal texts of both sides are joined by their keys. For the
near-equal ones, every block of training texts meets every shard of evaluation texts. A text of which SHARE of the words of the longer
one are common in order has that many words in common in any order, so of their rarest words, 1 - SHARE of each and FEW more, they share FEW.
These leading words are counted for all texts of a shard at once; of texts that reach FEW all words are counted, and those that
reach SHARE of the longer text get the exact check, the longest common subsequence; the merged intervals of longer passages tell
the coverage. No bar is guessed and nothing is dropped, however many texts hold a word and however often a text repeats it.

Shards and slices are stored once, as compressed rows. Tasks read the rows they pair from there, so nothing is copied for the pairing:
disk stays in proportion to the texts, while the work grows with the product of both sides.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.functions import arrow_udf

from kelk.llm.confusables import key_of, skeleton
from kelk.session import cut, spill

_WORD = re.compile(r"[^\W_]+")
#: Share of the longer text's words that must occur in the other in the same order, as a fraction.
SHARE = (7, 10)
#: Words of a passage by the length of its text: (longest text, words). These passages measure the coverage, they decide nothing.
PASSAGE = ((10, 1), (20, 2), (10**9, 3))
#: Leading words that two texts must share, a power of two; with more, more words are counted but fewer texts are left.
FEW = 16
#: Words of the evaluation texts that one task meets, of one shard, and of one slice of training texts; and the slices of one task.
BUCKET_WORDS, SHARD_WORDS, SLICE_WORDS, SLICES = 4_000_000, 4_000_000, 500_000, 8


def plain_words(text: str | None) -> list[str]:
    """Words of a text, look-alike characters, case, blanks, punctuation and emoji left aside."""
    return _WORD.findall(skeleton(text).casefold()) if text else []


@arrow_udf(T.StringType())
def plain_text_of(texts: pa.Array) -> pa.Array:
    """Column function: the words of each text, one blank between them; null if there are none."""
    return pa.array([" ".join(plain_words(t)) or None for t in texts.to_pylist()], pa.string())


def lcs_length(a: Iterable, b: Iterable) -> int:
    """Length of the longest common subsequence of two sequences, one machine word of the first one's rows at a time."""
    masks: dict = {}
    size = 0
    for symbol in a:
        masks[symbol] = masks.get(symbol, 0) | 1 << size
        size += 1
    full = (1 << size) - 1
    row = full
    for symbol in b:
        if mask := masks.get(symbol):
            both = row & mask
            row = ((row + both) | (row - both)) & full
    return size - row.bit_count()


def _numbered(words: Iterable[str]) -> list[str]:
    """Each word, from its second time on with its number before it, so that common words count as often as both texts hold them."""
    seen: dict[str, int] = {}
    out = []
    for word in words:
        n = seen.get(word, 0)
        seen[word] = n + 1
        out.append(f"{n} {word}" if n else word)
    return out


def _least(words: np.ndarray) -> np.ndarray:
    """How many words a text must have in common with another of at most its length."""
    return -(-SHARE[0] * words // SHARE[1])


class _Record:
    """The passages of one evaluation text, in an automaton with all the places of each."""

    def __init__(self, words: list[str]) -> None:
        self.n = len(words)
        self.size = next(size for longest, size in PASSAGE if self.n <= longest)
        self.automaton = ahocorasick.Automaton()
        places: dict[str, list[int]] = {}
        for start in range(self.n - self.size + 1):
            places.setdefault(f" {' '.join(words[start : start + self.size])} ", []).append(start)
        for passage, starts in places.items():
            self.automaton.add_word(passage, starts)
        self.automaton.make_automaton()

    def covered(self, text: str) -> int:
        """Words of the record in passages that the text holds too: the length of the merged intervals."""
        starts = sorted({s for _, found in self.automaton.iter(f" {text} ") for s in found})
        total = end = 0
        for start in starts:
            total += start + self.size - max(start, end)
            end = start + self.size
        return total


class _Texts:
    """Texts and the codes of their words, one text after the other. Words of one code count as equal here; the exact check tells them apart."""

    _codes: dict[str, int] = {}

    def __init__(self, texts: list[str], codes: np.ndarray | None = None) -> None:
        self.texts = texts
        self.codes = self._coded(texts) if codes is None else codes
        self.sizes = np.array([t.count(" ") + 1 for t in texts], np.int64)
        self.rows = np.repeat(np.arange(len(texts)), self.sizes)
        self.starts = np.cumsum(self.sizes) - self.sizes

    @classmethod
    def _coded(cls, texts: list[str]) -> np.ndarray:
        codes, out = cls._codes, []
        if len(codes) > 500_000:
            codes.clear()
        for text in texts:
            for word in _numbered(text.split(" ")):
                code = codes.get(word)
                if code is None:
                    code = codes[word] = zlib.crc32(word.encode())
                out.append(code)
        return np.array(out, np.uint32)

    def stored(self) -> tuple[bytes, bytes]:
        return zlib.compress("\n".join(self.texts).encode()), zlib.compress(self.codes.tobytes(), 1)

    @classmethod
    def of(cls, texts: bytes, codes: bytes) -> _Texts:
        return cls(zlib.decompress(texts).decode().split("\n"), np.frombuffer(zlib.decompress(codes), np.uint32))

    def ordered(self, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words' ranks, rising within each text, and whether each is one of its text's leading words."""
        ranks = ranks[np.lexsort((ranks, self.rows))]
        place = np.arange(len(ranks)) - np.repeat(self.starts, self.sizes)
        return ranks, place < np.repeat(self.sizes - _least(self.sizes) + FEW, self.sizes)


#: Bytes of the rows of bits of one shard.
BITS_BYTES = 1 << 26
#: Numbers of 64 bits that are summed up at once.
_BATCH = 1 << 17
_FEW_BITS = FEW.bit_length() - 1


def _as_bits(rows: np.ndarray, size: int) -> np.ndarray:
    """So many bytes with the bits of the rows set."""
    flags = np.zeros(size * 8, bool)
    flags[rows] = True
    return np.packbits(flags, bitorder="little")


def _added(rows: np.ndarray) -> list[np.ndarray]:
    """The bits of the number of rows that have each bit, the lowest first: three rows make one of their sums and one of their carries. Rows are overwritten."""
    planes = []
    spare = np.empty_like(rows[: max(1, len(rows) // 3)])
    while len(rows):
        carries = []
        while len(rows) > 1:
            k = max(1, len(rows) // 3)
            a, b, c, either = rows[:k], rows[k : 2 * k], rows[2 * k : 3 * k], spare[:k]
            np.bitwise_xor(a, b, out=either)
            a &= b
            if len(c):
                np.bitwise_and(either, c, out=b)
                a |= b
                c ^= either
                rows = rows[2 * k :]
            else:
                b[:] = either
                rows = rows[k:]
            carries.append(a)
        planes.append(rows[0])
        rows = np.concatenate(carries) if carries else rows[:0]
    return planes


class _Shard:
    """Evaluation texts, their words by rank from the rarest on, and which texts each word leads."""

    def __init__(self, texts: list[str] | _Texts) -> None:
        held = texts if isinstance(texts, _Texts) else _Texts(texts)
        self.texts = texts = held.texts
        self.sizes, self.starts = held.sizes, held.starts
        self.least = _least(self.sizes)
        self.codes, which, n = np.unique(held.codes, return_inverse=True, return_counts=True)
        self.rank = np.empty(len(n), np.int64)
        self.rank[np.argsort(n, kind="stable")] = np.arange(len(n))
        ordered, leads = held.ordered(self.rank[which])
        self.words = ordered.astype(np.int32)
        words, rows = ordered[leads], held.rows[leads]
        order = np.argsort(words, kind="stable")
        self.led = rows[order]
        self.ends = np.searchsorted(words[order], np.arange(len(n) + 1))
        # Words that lead many of the texts have a row of bits, a bit a text, all others the list of their texts.
        leading = np.diff(self.ends)
        often = np.argsort(-leading, kind="stable")[: BITS_BYTES // (-(-len(texts) // 64) * 8) if len(texts) else 0]
        often = np.sort(often[leading[often] > 0])
        self.place = np.full(len(n), -1)
        self.place[often] = np.arange(len(often))
        self.bits = np.zeros((len(often) + 1, -(-len(texts) // 64) * 8), np.uint8)  # the last row is of no word
        for place, word in enumerate(often.tolist()):
            self.bits[place] = _as_bits(self.led[self.ends[word] : self.ends[word + 1]], self.bits.shape[1])
        self.bits = self.bits.view(np.uint64)
        self.present = np.zeros(len(n), bool)
        self.records: dict[int, _Record] = {}

    def _sharing(self, lead: np.ndarray, planes: list[np.ndarray], least: int) -> np.ndarray:
        """The texts that share as many leading words with these as they must with a text that needs so many common words; planes count those of bits."""
        listed = [self.led[self.ends[word] : self.ends[word + 1]] for word in lead[self.place[lead] < 0].tolist()]
        if least < FEW:
            shared = np.zeros(len(self.texts), np.int64)
            for k, plane in enumerate(planes):
                shared += np.unpackbits(plane.view(np.uint8), count=len(shared), bitorder="little").astype(np.int64) << k
            for rows in listed:
                shared[rows] += 1
            return np.flatnonzero(shared >= np.minimum(np.maximum(self.least, least), FEW))
        # FEW is a power of two: what has reached it has one of the higher bits of its count.
        out = np.zeros(0, np.int64)
        if len(planes) > _FEW_BITS and (high := np.bitwise_or.reduce(planes[_FEW_BITS:], axis=0)).any():
            words = np.flatnonzero(high)
            at = np.flatnonzero(np.unpackbits(high[words].view(np.uint8), bitorder="little"))
            out = words[at >> 6] * 64 + (at & 63)
        if listed:
            rows = np.concatenate(listed)
            bit = (rows & 63).astype(np.uint64)
            if len(listed) <= FEW // 2:
                # Half of FEW must come from the bits then.
                if len(planes) < _FEW_BITS:
                    return out
                half = np.bitwise_or.reduce(planes[_FEW_BITS - 1 :], axis=0)[rows >> 6] >> bit & np.uint64(1)
                rows = rows[half.astype(bool)]
            if len(rows):
                rows, shared = np.unique(rows, return_counts=True)
                for k, plane in enumerate(planes):
                    shared = shared + ((plane[rows >> 6] >> (rows & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64) << k)
                out = np.union1d(out, rows[shared >= FEW])
        return out

    def near_all(self, training: _Texts) -> Iterator[tuple[int, int, int, int]]:
        """(text, row of training, covered words, common words) of the texts that are nearly equal to one of training, but not equal."""
        if not len(self.codes) or not len(training.texts):
            return
        at = np.minimum(np.searchsorted(self.codes, training.codes), len(self.codes) - 1)
        # Words that no text here holds are the rarest.
        ranks, leads = training.ordered(np.where(self.codes[at] == training.codes, self.rank[at], -1))
        leads &= ranks >= 0
        led, counts = ranks[leads], np.bincount(training.rows[leads], minlength=len(training.texts))
        ends = np.cumsum(counts)
        # Texts of about as many leading words are counted together, as many as fit the cache.
        order = np.argsort(counts, kind="stable")
        order = order[counts[order] > 0]
        first = 0
        while first < len(order):
            together = order[first : first + max(1, _BATCH // (self.bits.shape[1] * max(1, int(counts[order[first]]))))]
            first += len(together)
            most = int(counts[together].max())
            held = np.arange(most) < counts[together, None]
            place = np.full(held.shape, -1)
            place[held] = self.place[led[((ends - counts)[together, None] + np.arange(most))[held]]]
            planes = _added(self.bits[place.T])
            live = (_least(training.sizes[together]) < FEW) | ((place < 0) & held).any(axis=1)
            for plane in planes[_FEW_BITS:]:
                live |= plane.any(axis=1)
            for i in np.flatnonzero(live).tolist():
                row = int(together[i])
                start, size = int(training.starts[row]), int(training.sizes[row])
                lead = led[ends[row] - counts[row] : ends[row]]
                near = self._sharing(lead, [p[i] for p in planes], int(_least(size)))
                if len(near):
                    yield from self._exact(near, training.texts[row], ranks[start : start + size], row)

    def _exact(self, near: np.ndarray, text: str, words: np.ndarray, row: int) -> Iterator[tuple[int, int, int, int]]:
        """What near_all gives, of one text with these ranks of words and the texts that may be nearly equal to it."""
        size = len(words)
        longer = np.maximum(self.sizes[near], size)
        alike = np.minimum(self.sizes[near], size) * SHARE[1] >= longer * SHARE[0]
        near, longer = near[alike], longer[alike]
        if not len(near):
            return
        known = words[words >= 0]
        self.present[known] = True
        sizes = self.sizes[near]
        offsets = np.cumsum(sizes) - sizes
        places = np.repeat(self.starts[near] - offsets, sizes) + np.arange(sizes.sum())
        shared = np.add.reduceat(self.present[self.words[places]], offsets, dtype=np.int64)
        self.present[known] = False
        enough = shared * SHARE[1] >= longer * SHARE[0]
        for k, most in zip(near[enough].tolist(), longer[enough].tolist()):
            if self.texts[k] == text:
                continue
            other = self.texts[k].split(" ")
            common = lcs_length(other, text.split(" "))
            if common * SHARE[1] >= SHARE[0] * most:
                if len(self.records) > 10_000:
                    self.records.clear()
                if k not in self.records:
                    self.records[k] = _Record(other)
                yield k, row, self.records[k].covered(text), common

    def near(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(text, covered words, common words) of the other texts that are nearly equal to this one."""
        for k, _, covered, common in self.near_all(_Texts([text])):
            yield k, covered, common


def _packed(texts: DataFrame, partitions: int, words: int) -> DataFrame:
    """k1, k2 (raw), texts and codes (compressed) of so many words or one text, a row each."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, lines, size = ([], []), [], 0

        def out() -> pa.RecordBatch:
            k1, k2 = (np.array(k, np.int64).tobytes() for k in keys)
            return pa.RecordBatch.from_pydict({"k1": pa.array([k1], pa.binary()), "k2": pa.array([k2], pa.binary()), **{c: pa.array([x], pa.binary()) for c, x in zip(("texts", "codes"), _Texts(lines).stored())}})

        for batch in batches:
            for k1, k2, plain, n in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "plain", "n"))):
                if lines and size + n > words:
                    yield out()
                    keys, lines, size = ([], []), [], 0
                keys[0].append(k1)
                keys[1].append(k2)
                lines.append(plain)
                size += n
        if lines:
            yield out()

    return cut(texts.select("k1", "k2", "plain", "n").coalesce(partitions).mapInArrow(pack, "k1 binary, k2 binary, texts binary, codes binary"))


#: The shard that this worker met last, by its stored form: several tasks of a worker meet the same.
_shards: dict[bytes, _Shard] = {}


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of the shard and the slice of each row."""
    slices: dict[bytes, _Texts] = {}
    for batch in batches:
        for row in range(batch.num_rows):
            e1, e2, stored, codes, t1, t2, training, t_codes = (batch.column(c)[row].as_py() for c in ("k1", "k2", "texts", "codes", "t_k1", "t_k2", "t_texts", "t_codes"))
            if stored not in _shards:
                _shards.clear()
                _shards[stored] = _Shard(_Texts.of(stored, codes))
            if training not in slices:
                if len(slices) >= 2 * SLICES:
                    slices.clear()
                slices[training] = _Texts.of(training, t_codes)
            shard, texts = _shards[stored], slices[training]
            out = np.array(list(shard.near_all(texts)), np.int64).reshape(-1, 4)
            k, t = out[:, 0], out[:, 1]
            columns = [np.frombuffer(e1, np.int64)[k], np.frombuffer(e2, np.int64)[k], np.frombuffer(t1, np.int64)[t], np.frombuffer(t2, np.int64)[t], out[:, 2], out[:, 3], shard.sizes[k], texts.sizes[t]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[c.split()[0] for c in _PAIR.split(", ")])


_PAIR = "e1 long, e2 long, t1 long, t2 long, covered long, common long, eval_words long, train_words long"


def near_texts(evaluation: DataFrame, training: DataFrame, bucket_words: int = BUCKET_WORDS, shard_words: int = SHARD_WORDS, slice_words: int = SLICE_WORDS) -> DataFrame:
    """Pairs of different texts (k1, k2, plain, n each) of which SHARE of the longer one's words are common in order, each once.

    Every shard meets every slice; both are of bounded size in words, and a task has a bucket of shards and SLICES slices.
    """
    words = lambda df: df.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = lambda n, size: max(1, -(-n // size))
    cores = evaluation.sparkSession.sparkContext.defaultParallelism
    total, scanned = words(evaluation), words(training)
    buckets = parts(total, bucket_words)
    left = _packed(evaluation, buckets, shard_words)
    right = _packed(training, max(parts(scanned, SLICES * slice_words), parts(2 * cores, buckets)), slice_words)
    right = right.select(*[F.col(c).alias(f"t_{c}") for c in right.columns])
    # The pairing of stored partitions, without a shuffle or a broadcast; the shard is the outer loop. Rows are large: a batch for Python has a shard once a slice.
    return left.crossJoin(right.hint("shuffle_replicate_nl")).mapInArrow(_scanned, _PAIR)


def overlapping_texts(manifest: DataFrame, contents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, links): the records of both sides with their text's key k1, k2, and the links between texts.

    records: unique_post_id, model_role, label_source, content_hash, k1, k2 (null where no content has a word), trains. links: e1, e2, t1,
    t2, covered, common, eval_words, train_words, one row a pair of an evaluation and a training text, equal texts included.
    """
    roles = manifest.where("unique_post_id IS NOT NULL AND model_role IN ('train', 'validation', 'test')").select("unique_post_id", "model_role").distinct()
    coded = contents.where("unique_post_id IS NOT NULL").select("unique_post_id", plain_text_of(F.col("content")).alias("plain"), F.trim("content_hash").alias("content_hash"), "label_source")
    coded = spill(coded.withColumns({n: F.when(F.col("plain").isNotNull(), h) for n, h in zip(("k1", "k2"), key_of(F.col("plain")))}), "zstd")
    # One shuffle by the id serves both the repeats and the join; the texts take no part in it.
    rows = coded.drop("plain").repartition("unique_post_id").distinct()
    records = spill(roles.join(rows, "unique_post_id").withColumn("trains", F.col("model_role") == "train"), "zstd")
    sides = records.where("k1 IS NOT NULL").groupBy("k1", "k2").agg(F.max("trains").alias("in_train"), F.max(~F.col("trains")).alias("in_eval"))
    plains = coded.where("k1 IS NOT NULL").groupBy("k1", "k2").agg(F.first("plain").alias("plain"))
    texts = spill(plains.join(sides, ["k1", "k2"]).withColumn("n", F.size(F.split("plain", " ")).cast("long")), "zstd")
    near = near_texts(texts.where("in_eval"), texts.where("in_train"))
    equal = texts.where("in_eval AND in_train").select(F.col("k1").alias("e1"), F.col("k2").alias("e2"), F.col("k1").alias("t1"), F.col("k2").alias("t2"), *[F.col("n").alias(c) for c in ("covered", "common", "eval_words", "train_words")])
    return records, cut(near.unionByName(equal))


def cross_split_overlaps(manifest: DataFrame, contents: DataFrame) -> DataFrame:
    """eval_id, train_id, model_role, label_source, method, coverage, share of each overlap of an evaluation with a training record.

    manifest: unique_post_id and model_role (train, validation, test; rows of any other or a null role take no part).
    contents: unique_post_id, content, content_hash, label_source. method is 'text' where SHARE of the words of the longer content
    are common in the same order; coverage is the share of the evaluation record's words in passages that both hold and share the common
    words' share of the longer text. It is 'hash' where a content is missing (null or without any word) and the hashes are equal
    and not blank; coverage and share are null then. Repeated rows count once, a record with several contents by each of them.
    A null id takes no part; tables may be empty; extra columns are ignored. Copies are expanded into pairs of records here;
    overlapping_texts has the links between texts and the membership, overlap_report counts from these.
    """
    records, links = overlapping_texts(manifest, contents)
    evaluation, training = records.where("NOT trains"), records.where("trains")
    by_text = (
        links.join(evaluation.select(F.col("k1").alias("e1"), F.col("k2").alias("e2"), F.col("unique_post_id").alias("eval_id"), "model_role", "label_source"), ["e1", "e2"])
        .join(training.select(F.col("k1").alias("t1"), F.col("k2").alias("t2"), F.col("unique_post_id").alias("train_id")), ["t1", "t2"])
        .select("eval_id", "train_id", "model_role", "label_source", F.lit("text").alias("method"), (F.col("covered") / F.col("eval_words")).alias("coverage"), (F.col("common") / F.greatest("eval_words", "train_words")).alias("share"))
    )
    # Only where one content is missing: the side without content leads, so that no pair of two texts is ever made.
    hashed = lambda df: df.where("content_hash <> ''")
    right = hashed(training).select("content_hash", F.col("unique_post_id").alias("train_id"), F.col("k1").alias("train_k1"))
    by_hash = (
        hashed(evaluation).select("content_hash", F.col("unique_post_id").alias("eval_id"), "model_role", "label_source", "k1").join(right, "content_hash")
        .where("k1 IS NULL OR train_k1 IS NULL")
        .select("eval_id", "train_id", "model_role", "label_source", F.lit("hash").alias("method"), F.lit(None).cast("double").alias("coverage"), F.lit(None).cast("double").alias("share"))
    )
    return by_text.unionByName(by_hash).where("eval_id <> train_id")


def overlap_report(manifest: DataFrame, contents: DataFrame) -> DataFrame:
    """Records, overlapping records, their links and mean coverage per model_role and label_source of the evaluation splits.

    A link is a training text, or a content hash, that a record overlaps with; copies of a text are never expanded into pairs.
    """
    records, links = overlapping_texts(manifest, contents)
    evaluation, training = records.where("NOT trains"), records.where("trains")
    group = ["model_role", "label_source"]
    every = evaluation.select("unique_post_id", *group).distinct().groupBy(*group).agg(F.count("*").alias("records"))
    # A text or hash held by one training record alone is no overlap of that record with itself.
    ends = [F.min("unique_post_id").alias("least"), F.max("unique_post_id").alias("most")]
    other = ~((F.col("least") == F.col("most")) & (F.col("least") == F.col("unique_post_id")))
    holders = training.where("k1 IS NOT NULL").groupBy(F.col("k1").alias("t1"), F.col("k2").alias("t2")).agg(*ends)
    texts = links.join(holders, ["t1", "t2"]).select(F.col("e1").alias("k1"), F.col("e2").alias("k2"), "t1", "t2", "least", "most", (F.col("covered") / F.col("eval_words")).alias("coverage"))
    by_text = evaluation.join(texts, ["k1", "k2"]).where(other).groupBy("unique_post_id", *group).agg(F.countDistinct("t1", "t2").alias("links"), F.max("coverage").alias("coverage"))
    hashed = training.where("content_hash <> ''").select("content_hash", "unique_post_id", F.col("k1").isNull().alias("textless"))
    holders = hashed.groupBy("content_hash").agg(*ends, F.max("textless").alias("textless"))
    by_hash = evaluation.join(holders, "content_hash").where((F.col("k1").isNull() | F.col("textless")) & other)
    by_hash = by_hash.groupBy("unique_post_id", *group).agg(F.countDistinct("content_hash").alias("links"), F.lit(None).cast("double").alias("coverage"))
    by_record = by_text.unionByName(by_hash).groupBy("unique_post_id", *group).agg(F.sum("links").alias("links"), F.max("coverage").alias("coverage"))
    found = by_record.groupBy(*group).agg(F.count("*").alias("overlapping"), F.sum("links").alias("links"), F.avg("coverage").alias("mean_coverage"))
    both = every.alias("a").join(found.alias("b"), F.col("a.model_role").eqNullSafe(F.col("b.model_role")) & F.col("a.label_source").eqNullSafe(F.col("b.label_source")), "left")
    return both.select("a.model_role", "a.label_source", "records", F.coalesce("overlapping", F.lit(0)).alias("overlapping"), F.coalesce("links", F.lit(0)).alias("links"), "mean_coverage")
