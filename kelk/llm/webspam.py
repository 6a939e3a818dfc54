"""Pages of repeated keywords, link lists and product tags instead of sentences.

Links with their titles, hash tags, and goods with code and price are known by their form, excessively repeated collocations by pairs
of neighbouring words that come again within a few words. Pages made of these are the first suspects. All else is decided by
the pointwise mutual information of neighbouring words, log (pages with the pair x pages / (pages with one x pages with the other)). It is
taken from the counts of all pages and from those of the pages that aren't suspected, against the same expectation for the
words. In language, both agree; where keywords or places are strung together, the pair hardly occurs outside of suspects and its
information falls. A segment of neighbouring words whose mean information falls by more than LOSS is no language. The suspects are chosen
anew by that, and so on. A page whose words' mean information, its own counts taken out, is that of words drawn at random is word salad as a whole.

The counts are document frequencies of all words and pairs of all pages, grouped by a 52-bit key. Only the pairs that have lost information
are needed to judge a page: as long as these are BROADCAST_ROWS at most they are sent to every task, else joined to the pages.
The pairs of the COMMON commonest words have a table of fixed size; all other pairs that are expected often enough are looked up by their key,
sent or joined in the same way.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kelk.llm.confusables import skeleton
from kelk.session import spill

#: A pair that comes again within so many words is a repeated collocation.
NEAR = 8
#: Times in a row that a collocation is repeated, each within NEAR words of the last, from which it counts whatever the corpus says of it.
#: Sentences alike and refrains repeat theirs, too, but hardly so often, and in less than a third of their page.
LONG = 3
#: Share of a page's words from which it is suspected, at first and in the end; spam has more than half, all else less than a third.
SUSPECT, SPAM = 0.5, 0.42
ROUNDS = 2
#: Pairs of a segment, the mean loss of information from which it is no language, and the loss of a pair below which it counts as none.
SEGMENT, LOSS, LEAST_LOSS = 6, float(np.log(2)), float(np.log(1.25))
#: Pairs that are sent to every task; more are joined to the pages.
BROADCAST_ROWS = 2_000_000
#: Word salad: mean information below this over at least so many pairs of words that are expected together so often. COMMON words have a table of all their pairs.
COMMON, SALAD, SALAD_PAIRS, EXPECTED = 1024, -2.0, 20, 3.0

_LINK = r"(?:(?:https?|hxxps?|ftp)://|www\.)[^\s\"'<>()\[\]،]+|(?<![\w@.])[a-zA-Z0-9-]+(?:\.[a-zA-Z0-9-]+)*\.[a-zA-Z]{2,}/[^\s\"'<>()\[\]،]*"
_TOKEN = re.compile(_LINK + r"|#\w+|\w+")
_WORD = re.compile(r"\w+")
_IS_LINK = re.compile(_LINK)
_MAY_LINK = re.compile(r"://|www\.|\.[a-zA-Z]{2,}/|#\w")
_ANCHOR = re.compile(r"<a\b[^<>]*?href\s*=\s*[\"']?([^\"'\s>]*)[\"']?[^<>]*>|</a>", re.I)
_SEGMENT = re.compile(r"[\n;؛|]")
_CODE, _PRICE = r"(?:کد|code|sku)\s*:?\s*[\w-]*\d[\w-]*", r"(?:قیمت|price|تومان|تومن|ریال|\$|€)"
_GOODS = re.compile(rf"{_CODE}.{{0,40}}?{_PRICE}|{_PRICE}.{{0,40}}?{_CODE}", re.I)
#: Words that a link's title may have, for each link of a segment.
TITLE = 5


def words_of(text: str | None) -> tuple[list[str], list[bool]]:
    """The words of a page in lower case, links and tags as one each, and whether each is of a link, a tag or goods."""
    if not text:
        return [], []
    text = skeleton(text)
    linked = _MAY_LINK.search(text) is not None
    lower = text.lower()
    goods = ("کد" in text or "code" in lower or "sku" in lower) and _GOODS.search(text) is not None
    if not linked and not goods:
        words = _WORD.findall(lower)
        return words, [False] * len(words)
    if linked:
        text = _ANCHOR.sub(lambda m: f" {m.group(1) or ''} ", text)
    words: list[str] = []
    formed: list[bool] = []
    for segment in _SEGMENT.split(text):
        tokens = _TOKEN.findall(segment)
        links = [_IS_LINK.fullmatch(t) is not None for t in tokens]
        tags = [t[0] == "#" for t in tokens]
        n = sum(links)
        whole = bool(n) and len(tokens) - n - sum(tags) <= TITLE * n or _GOODS.search(segment) is not None
        words += [t.lower() for t in tokens]
        formed += [whole or a or b for a, b in zip(links, tags)]
    return words, formed


#: Bits of a word's or pair's key; the number of a page within a step has the upper ones.
_BITS = 52


def _mixed(keys: np.ndarray) -> np.ndarray:
    """_BITS well-mixed bits of each 64-bit key."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(64 - _BITS)).astype(np.int64)


class Losses:
    """Loss of information of pairs, sorted by key. With pages, each key belongs to one of them and has its number in the upper bits."""

    def __init__(self, keys: np.ndarray, losses: np.ndarray, by_page: bool = False) -> None:
        order = np.argsort(keys, kind="stable")
        self.keys, self.losses, self.by_page = keys[order], losses[order].astype(np.float32), by_page

    def of(self, keys: np.ndarray, page: np.ndarray, missing: float = 0) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), missing, np.float32)
        keys = (page << _BITS) | keys if self.by_page else keys
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.losses[at], np.float32(missing))


class Common:
    """The commonest words' codes, rising, the pages that hold each, and a table of the pages that hold each pair of them."""

    def __init__(self, codes: np.ndarray, pages_with: np.ndarray, pages: int) -> None:
        self.codes, self.pages_with, self.pages = codes, pages_with, pages
        self.pairs = np.zeros(0, np.int32)

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys of all pairs of the words, rising, and the number of each."""
        first, second = np.divmod(np.arange(len(self.codes) ** 2), max(len(self.codes), 1))
        keys = _mixed((self.codes[first] << 32) | self.codes[second])
        order = np.argsort(keys)
        return keys[order], (first * COMMON + second)[order]

    def of(self, codes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place among at, number of the pair) of the pairs of two common words; at are the pairs' first words."""
        if not len(self.codes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        place = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        known = self.codes[place] == codes
        both = np.flatnonzero(known[at] & known[at + 1])
        return both, place[at[both]] * COMMON + place[at[both] + 1]


class Pages:
    """The words of a batch of pages, one after the other."""

    def __init__(self, words: np.ndarray, formed: np.ndarray, offsets: np.ndarray) -> None:
        self.formed, self.n = formed, len(offsets) - 1
        self.sizes = np.diff(offsets)
        self.page = np.repeat(np.arange(self.n), self.sizes)
        self.codes = words.astype(np.int64) & 0xFFFFFFFF
        #: Places of the pairs, each at its first word; a pair lies within one page.
        self.at = np.flatnonzero(self.page[1:] == self.page[:-1]) if len(words) > 1 else np.zeros(0, np.int64)
        self.pairs = _mixed((self.codes[self.at] << 32) | self.codes[self.at + 1])

    @classmethod
    def of(cls, batch: pa.RecordBatch) -> Pages:
        column = batch.column("words")
        offsets = column.offsets.to_numpy()
        words = column.values.to_numpy()[offsets[0] : offsets[-1]] if len(batch) else np.zeros(0, np.int32)
        formed = np.frombuffer(b"".join(batch.column("formed").to_pylist()), np.uint8).astype(bool)
        return cls(words, formed, offsets - (offsets[0] if len(offsets) else 0))

    def _mark(self, which: np.ndarray) -> np.ndarray:
        """Whether each word belongs to one of the marked pairs."""
        out = np.zeros(len(self.codes), bool)
        places = self.at[which]
        out[places] = True
        out[places + 1] = True
        return out

    def repeated(self, times: int = 2) -> np.ndarray:
        """Whether each word belongs to a pair that comes so many times in a row, each within NEAR words of the last in its page."""
        n = len(self.at)
        page = self.page[self.at]
        again = np.zeros(n, bool)
        for distance in range(1, min(NEAR, n - 1) + 1):
            same = (self.pairs[distance:] == self.pairs[:-distance]) & (page[distance:] == page[:-distance])
            again[distance:] |= same
            again[:-distance] |= same
        # Only pairs that come again are put in order; a row of equal ones ends where the next is another or too far away.
        held = np.flatnonzero(again)
        which = np.zeros(n, bool)
        if len(held):
            order = held[np.lexsort((held, self.pairs[held], page[held]))]
            goes_on = (self.pairs[order][1:] == self.pairs[order][:-1]) & (page[order][1:] == page[order][:-1]) & (np.diff(order) <= NEAR)
            row = np.concatenate([[0], np.cumsum(~goes_on)])
            which[order] = np.bincount(row)[row] >= times
        return self._mark(which)

    def lossy(self, losses: Losses) -> np.ndarray:
        """Whether each word belongs to a segment whose pairs' mean loss of information is more than LOSS."""
        out = np.zeros(len(self.codes), bool)
        if not len(self.at):
            return out
        loss = losses.of(self.pairs, self.page[self.at]).astype(float)
        total = np.concatenate([[0.0], np.cumsum(loss)])
        # A page of fewer pairs is one segment; segments never reach over the end of a page.
        per_page = np.maximum(self.sizes - 1, 0)
        end = np.cumsum(per_page)
        size = np.minimum(per_page, SEGMENT)
        page = self.page[self.at]
        i = np.arange(len(self.at))
        starts = i[i + size[page] <= end[page]]
        mean = (total[starts + size[page[starts]]] - total[starts]) / size[page[starts]]
        bad = starts[mean > LOSS + 1e-9]
        # The pairs of all bad segments, by adding one at each start and taking it away after its end.
        step = np.zeros(len(self.at) + 1, np.int64)
        np.add.at(step, bad, 1)
        np.add.at(step, bad + size[page[bad]], -1)
        return self._mark(np.cumsum(step[:-1]) > 0)

    def share(self, marks: np.ndarray) -> np.ndarray:
        """Share of the words of each page that are marked."""
        return np.bincount(self.page, marks, self.n) / np.maximum(self.sizes, 1)

    def judge(self, losses: Losses) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Shares of the words of each page: all that are spam, those of links, tags and goods, those of segments that lost their information."""
        lossy = self.lossy(losses)
        # Long repeats count for themselves: ordinary pages that hold the pair too take nothing from them.
        return self.share(self.formed | lossy | self.repeated(LONG)), self.share(self.formed), self.share(lossy)

    def suspects(self, losses: Losses | None) -> np.ndarray:
        if losses is None:
            return (self.sizes > 0) & (self.share(self.formed | self.repeated()) >= SUSPECT)
        return (self.sizes > 0) & (self.judge(losses)[0] >= SPAM)

    def information(self, common: Common, rest: Losses | None = None) -> np.ndarray:
        """Mean pointwise mutual information of neighbours that are expected often enough, the page's own count taken out; NaN where too few can tell.

        rest has the information of the pairs of which a word is none of the commonest.
        """
        out = np.full(self.n, np.nan)
        at, pair = common.of(self.codes, self.at)
        expected = common.pages_with[pair // COMMON] * common.pages_with[pair % COMMON] / max(common.pages, 1) if len(pair) else np.zeros(0)
        enough = expected >= EXPECTED
        page = self.page[self.at[at[enough]]]
        n = np.bincount(page, minlength=self.n)
        total = np.bincount(page, np.log((np.maximum(common.pairs[pair[enough]] - 1, 0) + 0.1) / expected[enough]), self.n)
        if rest is not None:
            other = np.ones(len(self.at), bool)
            other[at] = False
            page = self.page[self.at[other]]
            value = rest.of(self.pairs[other], page, np.nan)
            told = ~np.isnan(value)
            n = n + np.bincount(page[told], minlength=self.n)
            total = total + np.bincount(page[told], value[told], self.n)
        told = n >= SALAD_PAIRS
        out[told] = total[told] / n[told]
        return out

    def beyond(self, common: Common, words: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
        """(places among at, expected pages) of the pairs of which a word is none of the commonest. words: codes, rising, and pages of all words
        that can be expected often enough; only pairs that are come out then, else all do and their expectation is NaN."""
        other = np.ones(len(self.at), bool)
        other[common.of(self.codes, self.at)[0]] = False
        if words is None:
            return np.flatnonzero(other), np.full(int(other.sum()), np.nan)
        codes, pages_with = words
        place = np.minimum(np.searchsorted(codes, self.codes), len(codes) - 1)
        n = np.where(codes[place] == self.codes, pages_with[place], 0.0)
        expected = n[self.at] * n[self.at + 1] / max(common.pages, 1)
        other &= expected >= EXPECTED
        return np.flatnonzero(other), expected[other]

    def distinct_pairs(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(key, page) of the distinct pairs of the pages marked."""
        pairs = which[self.page[self.at]]
        keys = np.unique((self.page[self.at[pairs]] << _BITS) | self.pairs[pairs])
        return keys & ((1 << _BITS) - 1), keys >> _BITS

    def distinct_words(self) -> np.ndarray:
        """The codes of each page's distinct words, page after page."""
        return np.unique((self.page << 32) | self.codes) & 0xFFFFFFFF


def _tokenised(pages: DataFrame, id: str, text: str) -> DataFrame:
    """id, words (32-bit hashes), formed (a byte a word) of each page."""
    arrow = pa.schema([("id", pa.int64()), ("words", pa.list_(pa.int32())), ("formed", pa.binary())])

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            lists, forms = [], []
            for page in batch.column("text").to_pylist():
                words, formed = words_of(page)
                if len(known) > 500_000:
                    known.clear()
                codes = []
                for w in words:
                    code = known.get(w)
                    if code is None:
                        code = known[w] = zlib.crc32(w.encode()) - (1 << 31)
                    codes.append(code)
                lists.append(np.array(codes, np.int32))
                forms.append(bytes(formed))
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
            flat = np.concatenate(lists) if lists else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(forms, pa.binary())], schema=arrow)

    return pages.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(tokens, "id long, words array<int>, formed binary")


#: Pages of one step; the number of a page has the twelve bits that a key leaves.
STEP = 4_000


def _steps(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for start in range(0, batch.num_rows, STEP):
        yield batch.slice(start, STEP)


class _Sums:
    """Counts of keys that a task hands on from time to time."""

    def __init__(self, kind: str) -> None:
        self.kind, self.keys, self.size = kind, [], 0

    def add(self, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.keys.append(keys)
        self.size += len(keys)
        if self.size > 4_000_000:
            yield self.out()

    def out(self) -> pa.RecordBatch:
        keys, n = np.unique(np.concatenate(self.keys), return_counts=True) if self.keys else (np.zeros(0, np.int64),) * 2
        self.keys, self.size = [], 0
        return pa.RecordBatch.from_pydict({"kind": pa.array([self.kind] * len(keys), pa.string()), "key": pa.array(keys, pa.int64()), "n": pa.array(n, pa.int64())})


_SUMS = "kind string, key long, n long"


def _corpus_counts(tokens: DataFrame) -> DataFrame:
    """kind, key, n: the pages that hold each word ('word') and pair ('pair'), and the number of pages ('pages')."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pairs, pages = _Sums("word"), _Sums("pair"), 0
        for whole in batches:
            for batch in _steps(whole):
                found = Pages.of(batch)
                pages += found.n
                yield from words.add(found.distinct_words())
                yield from pairs.add(found.distinct_pairs(np.ones(found.n, bool))[0])
        yield words.out()
        yield pairs.out()
        yield pa.RecordBatch.from_pydict({"kind": ["pages"], "key": [0], "n": [pages]})

    return tokens.mapInArrow(partial, _SUMS).groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _page_losses(batch: pa.RecordBatch, sent: Losses | None, name: str = "lost") -> Losses:
    """The losses that count for the pages of a batch: those sent to all tasks, else those joined to the pages."""
    if sent is not None:
        return sent
    lists = batch.column(name).to_pylist()
    page = np.repeat(np.arange(batch.num_rows), [len(x or ()) for x in lists])
    lost = [y for x in lists for y in x or ()]
    return Losses((page << _BITS) | np.array([y["key"] for y in lost], np.int64), np.array([y["loss"] for y in lost], float), True)


def _suspect_counts(tokens: DataFrame, sent: Losses | None, first: bool) -> DataFrame:
    """key, s: the suspects that hold each pair."""
    broadcast = tokens.sparkSession.sparkContext.broadcast(sent)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = _Sums("pair")
        for whole in batches:
            for batch in _steps(whole):
                found = Pages.of(batch)
                yield from pairs.add(found.distinct_pairs(found.suspects(None if first else _page_losses(batch, broadcast.value)))[0])
        yield pairs.out()

    return tokens.mapInArrow(partial, _SUMS).groupBy("key").agg(F.sum("n").alias("s"))


def _commonest(counts: DataFrame) -> Common:
    """The commonest words of the counts and the pages that hold each pair of them."""
    total = counts.where("kind = 'pages'").agg(F.sum("n")).first()[0] or 0
    often = counts.where("kind = 'word'").orderBy(F.desc("n"), "key").limit(COMMON).toPandas().sort_values("key")
    common = Common(often["key"].to_numpy(np.int64), often["n"].to_numpy(float), total)
    broadcast = counts.sparkSession.sparkContext.broadcast(common.keys())

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, numbers = broadcast.value
        for batch in batches:
            key = batch.column("key").to_numpy()
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            held = np.flatnonzero(keys[at] == key) if len(keys) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(numbers[at[held]] if len(held) else held), batch.column("n").take(pa.array(held))], names=["pair", "n"])

    table = counts.where("kind = 'pair'").select("key", "n").mapInArrow(known, "pair long, n long").toPandas()  # COMMON x COMMON rows at most
    common.pairs = np.bincount(table["pair"].to_numpy(np.int64), table["n"].to_numpy(float), COMMON * COMMON).astype(np.int32)
    return common


def _with_losses(tokens: DataFrame, lost: DataFrame, name: str = "lost", beyond: tuple | None = None) -> DataFrame:
    """tokens with the lost pairs of each page as a column of their own; pages of the same words are one. beyond: common words and
    others as in Pages.beyond, which tells the pairs that are asked for then."""
    broadcast = tokens.sparkSession.sparkContext.broadcast(beyond)

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _steps(whole):
                found = Pages.of(batch)
                if broadcast.value is None:
                    keys, page = found.distinct_pairs(np.ones(batch.num_rows, bool))
                else:
                    at = found.beyond(*broadcast.value)[0]
                    both = np.unique((found.page[found.at[at]] << _BITS) | found.pairs[at])
                    keys, page = both & ((1 << _BITS) - 1), both >> _BITS
                yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(page)) for c in ("h1", "h2")] + [pa.array(keys)], names=["h1", "h2", "key"])

    coded = tokens.withColumns({"h1": F.xxhash64("words"), "h2": F.xxhash64(F.lit(7), "words")})
    pairs = coded.mapInArrow(held, "h1 long, h2 long, key long").distinct().join(lost, "key")
    return coded.join(pairs.groupBy("h1", "h2").agg(F.collect_list(F.struct("key", "loss")).alias(name)), ["h1", "h2"], "left").drop("h1", "h2")


def _beyond_common(tokens: DataFrame, counts: DataFrame, common: Common, broadcast_rows: int) -> tuple[DataFrame | None, tuple[np.ndarray, np.ndarray] | None]:
    """(key and information, as loss, of every pair of which a word is none of the commonest and that is expected often enough; the words
    that were sent to find them). The first is None if there is no such word, the second if the words are joined instead."""
    if len(common.codes) < COMMON:
        return None, None
    # With any word, even the commonest, a rarer one is never expected often enough.
    words = counts.where("kind = 'word'").where(F.col("n") >= EXPECTED * common.pages / common.pages_with.max() * (1 - 1e-9)).select("key", F.col("n").cast("double").alias("n"))
    n = words.count()
    if n <= (common.pages_with >= EXPECTED * common.pages / common.pages_with.max() * (1 - 1e-9)).sum():
        return None, None
    sent = None
    if n <= broadcast_rows:
        rows = words.toPandas().sort_values("key")
        sent = rows["key"].to_numpy(np.int64), rows["n"].to_numpy(float)
    few = Common(common.codes, common.pages_with, common.pages)  # without the table of pairs
    broadcast = tokens.sparkSession.sparkContext.broadcast((few, sent))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            whole = np.concatenate(held) if held else np.zeros((0, 4))
            whole = whole[np.unique(whole[:, 0].astype(np.int64), return_index=True)[1]]
            return pa.RecordBatch.from_arrays([*(pa.array(whole[:, i].astype(np.int64)) for i in range(3)), pa.array(whole[:, 3])], names=["key", "first", "second", "expected"])

        for whole in batches:
            for batch in _steps(whole):
                found = Pages.of(batch)
                at, expected = found.beyond(*broadcast.value)
                keys, first = np.unique(found.pairs[at], return_index=True)
                place = found.at[at[first]]
                # Keys and codes have 52 bits at most, as a double holds.
                held.append(np.column_stack([keys, found.codes[place], found.codes[place + 1], expected[first]]))
                if sum(map(len, held)) > 1_000_000:
                    yield out()
                    held.clear()
        yield out()

    found = tokens.mapInArrow(pairs, "key long, first long, second long, expected double")
    if sent is None:
        found = found.select("key", "first", "second").distinct()
        for side in ("first", "second"):
            found = found.join(words.select(F.col("key").alias(side), F.col("n").alias(f"n_{side}")), side)
        found = found.withColumn("expected", F.col("n_first") * F.col("n_second") / F.lit(float(max(common.pages, 1)))).where(F.col("expected") >= EXPECTED)
    # Two pairs of one key are counted as one, as everywhere.
    found = found.groupBy("key").agg(F.max("expected").alias("expected"))
    loss = F.log((F.greatest(F.col("n") - 1, F.lit(0)) + 0.1) / F.col("expected"))
    return spill(counts.where("kind = 'pair'").select("key", "n").join(found, "key").select("key", loss.alias("loss"))), sent


def spam_scores(pages: DataFrame, id: str = "doc_id", text: str = "text", rounds: int = ROUNDS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """id, n_words, spam_share, form_share, loss_share, information, is_spam of every page.

    is_spam: SPAM of the page's words are links with titles, tags, goods (form_share), words of segments that have lost their
    information (loss_share) or long repeats, or its information is below SALAD. information is the mean pointwise mutual information of
    the neighbours that are expected together often enough, without the page's own count, where enough of them can tell it. A page with null or
    empty text has no words and is no spam; repeated pages each count; an empty table gives no rows; extra columns are ignored.
    """
    spark = pages.sparkSession
    tokens = spill(_tokenised(pages, id, text))
    counts = spill(_corpus_counts(tokens))
    common = _commonest(counts)
    sent, judged = None, tokens
    for turn in range(rounds):
        suspected = _suspect_counts(judged, sent, not turn)
        # Against the same expectation for the words, information falls by the logarithm of the ratio of the counts.
        loss = F.log((F.col("n") + 0.1) / (F.col("n") - F.col("s") + 0.1))
        lost = spill(counts.where("kind = 'pair'").join(suspected, "key").select("key", loss.alias("loss")).where(F.col("loss") >= LEAST_LOSS))
        if lost.count() <= broadcast_rows:
            rows = lost.toPandas()
            sent, judged = Losses(rows["key"].to_numpy(np.int64), rows["loss"].to_numpy(float)), tokens
        else:
            sent, judged = None, spill(_with_losses(tokens, lost))
    # The information of pairs beyond the table of the commonest words goes the same ways.
    rest, words = _beyond_common(tokens, counts, common, broadcast_rows)
    others = Losses(np.zeros(0, np.int64), np.zeros(0))
    if rest is not None:
        if rest.count() <= broadcast_rows:
            rows = rest.toPandas()
            others = Losses(rows["key"].to_numpy(np.int64), rows["loss"].to_numpy(float))
        else:
            others, judged = None, spill(_with_losses(judged, rest, "rest", (Common(common.codes, common.pages_with, common.pages), words)))
    broadcast = spark.sparkContext.broadcast((sent, others, common))

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent, others, common = broadcast.value
        for whole in batches:
            for batch in _steps(whole):
                found = Pages.of(batch)
                shares, formed, lossy = found.judge(_page_losses(batch, sent))
                information = found.information(common, _page_losses(batch, others, "rest"))
                salad = information < SALAD
                shares[salad] = 1.0
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.array(found.sizes.astype(np.int64)), pa.array(shares), pa.array(formed), pa.array(lossy), pa.array(information, from_pandas=True), pa.array((found.sizes > 0) & (shares >= SPAM))],
                    names=["id", "n_words", "spam_share", "form_share", "loss_share", "information", "is_spam"],
                )

    return judged.mapInArrow(scores, "id long, n_words long, spam_share double, form_share double, loss_share double, information double, is_spam boolean").withColumnRenamed("id", id)
