"""Personal information in free text: found by type and replaced with typed placeholders.

Everything is found by bootstrapping: seed entities induce lexical patterns (the words around them), patterns and instances form a
graph, and Spark scores it in rounds: a pattern is as good as the instances it holds, an instance as good as the patterns it
stands in. Patterns of high confidence discover what no seed and no grammar knows.

The seeds of mail addresses, numbers and street addresses are those whose form says what they are, over the text's skeleton, so that
look-alike, full-width and spaced-out spellings are one; numbers may be spelled in words too. What looks like one of them
but has no such form is a candidate, which the patterns around it decide. The seeds of names are a few given names, and those that
are stated as such. A name is a trusted given name with the word after it, where several trusted names lead that word or a trusted
pattern holds the two, or any two words in a pattern that hardly holds anything but trusted names.

However common words are, all their windows are counted: a task turns words into numbers, makes the windows of a batch of texts at once
and hands on counts; a second pass finds the windows of the trusted names and patterns.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.functions import arrow_udf

from kelk.functions.text import ARABIC_DIGITS, PERSIAN_DIGITS
from kelk.llm.confusables import skeleton
from kelk.session import cut, spill

TYPES = ("email", "phone", "id_number", "address", "name")
#: Common given names, the seeds of the name search; any of them may be missing from a corpus.
SEED_NAMES = tuple(
    "آرمان آرزو آزاده آیدا ابراهیم احمد ارسلان اعظم افسانه اکرم الهام الهه امیر اکبر بابک بهاره بهرام بهزاد بهنام پروانه پروین پریسا پریوش پژمان پوریا پویا پیمان ترانه ثریا جواد "
    "حامد حسن حسین حمید خدیجه داوود رامین رضا رعنا رقیه روزبه زهرا زهره زینب ژاله سارا ساسان سامان سپیده سعید سمیرا سمیه سهراب سهیلا سودابه سیاوش سیمین شاهین شبنم "
    "شقایق شهرام شهره شهلا شیرین شیما شیوا صادق صغری طاهره عباس عرفان علی فاطمه فرزانه فرهاد فریبا فرید فیروزه کاظم کامران کاوه کبری کوروش کیانا کیوان گلناز لادن لیلا ماهرخ مجید محسن محمد "
    "محمود مرتضی مریم مسعود مصطفی معصومه منصور منیژه مهدی مهتاب مهسا مهشید مهناز میترا مینا نادر ناهید نازنین نسترن نسرین نگار نگین نوشین نیلوفر هانیه هاشم وحید یاسمن یاسر یلدا "
    "Ali Sara Mina Leila Maryam Reza Zahra Shiva Rana Negar Ladan Mahtab".split()
)

_DIGITS = str.maketrans(PERSIAN_DIGITS + ARABIC_DIGITS, "0123456789" * 2)

# --- what has a form of its own -------------------------------------------------------------------------------------------

_AT = r"(?:\s*@\s*|\s*[\[({]\s*(?:at|ات|ات\s?ساین)\s*[\])}]\s*|\s+(?:at|ات\s?ساین|ادساین|اتساین)\s+)"
_DOT = r"(?:\.|\s*[\[({]\s*(?:dot|نقطه|دات)\s*[\])}]\s*|\s+(?:dot|نقطه|دات)\s+)"
_EMAIL = re.compile(rf"[A-Za-z0-9_%+-]+(?:\.[A-Za-z0-9_%+-]+)*{_AT}[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)*{_DOT}[A-Za-z]{{2,}}", re.I)
#: Digits with few separators between any two, which end no sentence, not part of a longer run.
_NUMBER = re.compile(r"(?<![\w@./-])(?<!\d[ ])[+(]{0,2}\d(?:(?:[ ()/-]{0,2}|\.)\d){7,17}(?![\d\w]|[-./]\d)")
#: Numerals in words with their values.
_NUMERALS = {
    skeleton(word): value
    for words in (
        "صفر یک دو سه چهار پنج شش هفت هشت نه ده یازده دوازده سیزده چهارده پانزده شانزده هفده هجده نوزده",
        "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen",
    )
    for value, word in enumerate(words.split())
} | {
    skeleton(word): value
    for word, value in zip(
        "یه چار شیش پونزده شونزده هیفده هیجده بیست سی چهل پنجاه شصت هفتاد هشتاد نود صد یکصد دویست سیصد چهارصد پانصد پونصد ششصد شیشصد هفتصد هشتصد نهصد".split(),
        (1, 4, 6, 15, 16, 17, 18, *range(20, 100, 10), 100, 100, 200, 300, 400, 500, 500, 600, 600, 700, 800, 900),
    )
}
_NUMERAL = re.compile(rf"(?>{'|'.join(sorted(map(re.escape, _NUMERALS), key=len, reverse=True))}|\d)", re.I)
_AND = re.compile(r" ?و ?")
#: A run of numerals in words, or words and digits, between which stand at most an 'and' or some separators.
_SPELLED = re.compile(rf"(?<![\w@])(?:[+(]{{1,2}})?{_NUMERAL.pattern}(?:(?: ?و ?|[ .،,()/-]{{0,3}}){_NUMERAL.pattern}){{3,}}(?!\w)", re.I)
_PASSPORT = re.compile(r"(?<![A-Za-z0-9])[A-Z] ?\d{8}(?!\d|\w)")
_ID_WORD = re.compile(r"(?:کد\s?ملی|شماره\s?ملی|کدملی|ملی|شناسنامه|national)")
_NOT_ID = re.compile(r"(?:پیگیری|رهگیری|فاکتور|سفارش|تاپیک|مرسوله|تراکنش|ارجاع|پرونده|تومن|تومان|ریال)")
#: Given and family name, each announced by its word.
_STATED_NAME = re.compile(
    r"(?<!\w)(?:اسم|نام)(?:م|\s*:)\s*([^\W\d_]+)\s*[،,]?\s*(?:و\s+)?(?:فامیلی?|نام\s?خانوادگی)(?:م|\s*:)\s*:?\s*([^\W\d_]+)"
)
#: A Jalali date in digits.
_DATE = re.compile(r"1[2-5]\d\d([/.-])\d{1,2}\1\d{1,2}")
_PASSPORT_WORD = re.compile(r"(?:پاسپورت|گذرنامه|passport)", re.I)

_STREET = r"(?:خیابان|خیابون|بلوار|کوچه|بن\s?بست|میدان|بزرگراه|شهرک|خ|ک)"
_HOUSE = r"(?:پلاک|واحد|ساختمان|بلوک|شماره|طبقه|زنگ|منزل|پ|ط)"
#: From a street word over at most some words to a house word with its number, and on over further such parts.
_ADDRESS = re.compile(
    rf"(?<!\w){_STREET}(?!\w)[ :]*(?:(?!\n)[^.!؟?]){{1,60}}?(?<!\w){_HOUSE}[ :]*\d{{1,4}}(?!\d)(?:(?:\s*[،,-]\s*|\s+){_HOUSE}[ :]*\d{{1,4}}\w?(?!\d))*"
    rf"|(?<!\w)\d{{1,4}},? [^\n.!؟?,،]{{2,40}} (?:St|Ave|Street|Avenue|Blvd|Road)\b\.?(?:,? (?:Unit|Apt|No)\.? ?\d+)?(?:, ?[^\s.,،!؟?]+(?: (?:بالا|پایین|نو|کوه))?)?",
)


def _check_digit(digits: str) -> bool:
    """Whether ten digits are a valid national code: its last digit follows from the others."""
    if len(digits) != 10 or len(set(digits)) == 1:
        return False
    rest = sum(int(d) * (10 - i) for i, d in enumerate(digits[:9])) % 11
    return int(digits[9]) == (rest if rest < 2 else 11 - rest)


#: A number that its words tell to be something else.
OTHER = "other"


def _number_type(text: str, start: int, stop: int, shown: str | None = None) -> str | None:
    """Whether a number is a phone number, a national code, OTHER or unknown, by its form and the words around it; shown: in digits, if it is spelled."""
    shown = shown or text[start:stop].lstrip("(")
    digits = "".join(str(int(c)) for c in shown if c.isdigit())
    near = re.split(r"[\n.!؟?،]", text[max(0, start - 18) : start])[-1]
    unit = text[stop : stop + 8]
    if _NOT_ID.search(near) or _NOT_ID.search(unit) or _DATE.fullmatch(shown):
        return OTHER
    if re.fullmatch(r"(?:\+|00)", shown[: 1 if shown[0] == "+" else 2].translate(_DIGITS)) or len(digits) == 12:
        digits = re.sub(r"^(?:00)?98(?=[1-9]\d{9}$)", "0", digits)
    if re.fullmatch(r"0\d{10}", digits):
        return "phone"
    if len(digits) != 10:
        return None
    before, after = re.split(r"[\n.!؟?]", text[max(0, start - 30) : start])[-1], re.split(r"[\n.!؟?]", text[stop : stop + 40])[0]
    return "id_number" if _ID_WORD.search(before) or _ID_WORD.search(after) or _check_digit(digits) else None


def _spelled(flat: str) -> Iterator[tuple[int, int, str]]:
    """(start, stop, type) of the numbers spelled in words."""
    for run in _SPELLED.finditer(flat):
        groups: list[tuple[int, int, str]] = []
        last = 0  # what may still be added to: the value of the numeral before, if it is a round one
        for m in _NUMERAL.finditer(flat, *run.span()):
            value = int(m.group()) if m.group().isdigit() else _NUMERALS[m.group().lower()]
            if last and value and not m.group().isdigit() and _AND.fullmatch(flat, groups[-1][1], m.start()) and value < (100 if last >= 100 else 10):
                groups[-1] = (groups[-1][0], m.end(), str(int(groups[-1][2]) + value))
                last = value if value >= 20 else 0
            else:
                groups.append((m.start(), m.end(), str(value)))
                last = value if value >= 20 and value % 10 == 0 else 0
        if all(flat[start:stop].isdigit() for start, stop, _ in groups):
            continue
        digits = "".join(g[2] for g in groups)
        if (kind := _number_type(flat, groups[0][0], groups[-1][1], digits)) == OTHER:
            continue
        if kind:
            yield run.start() if flat[run.start()] == "+" else groups[0][0], groups[-1][1], kind
            continue
        # Another number may stand next to it: the phone numbers are told by their length then.
        first = 0
        while first < len(groups):
            size, end = 0, first
            while end < len(groups) and size < 11:
                size += len(groups[end][2])
                end += 1
            shown = "".join(g[2] for g in groups[first:end])
            if re.fullmatch(r"0[1-9]\d{9}", shown) and not all(flat[a:b].isdigit() for a, b, _ in groups[first:end]) and _number_type(flat, groups[first][0], groups[end - 1][1], shown) not in (None, OTHER):
                yield groups[first][0], groups[end - 1][1], "phone"
                first = end
            else:
                first += 1


def original_places(text: str) -> list[int]:
    """For each character of skeleton(text) its place in the text, and the text's length at the end."""
    places: list[int] = []
    done = 0
    # Equal lengths need no work; else the skeleton of every beginning tells how far it has come.
    if len(skeleton(text)) == len(text):
        return list(range(len(text) + 1))
    for i in range(len(text)):
        # A character's accents belong to it, so a beginning ends before a character that joins nothing.
        if i and unicodedata.combining(text[i]):
            continue
        stop = i + 1
        while stop < len(text) and unicodedata.combining(text[stop]):
            stop += 1
        made = len(skeleton(text[i:stop]))
        places += [i] * made
        done += made
    return [*places, len(text)]


_MAIL_SIGN = re.compile(r"@|[\[({]\s*(?:at|ات)|ات\s?ساین|\sat\s", re.I)
_LONG_NUMBER = re.compile(r"\d(?:[ .()/-]{0,2}\d){7}")
_STREET_SIGNS = ("خیابان", "خیابون", "بلوار", "کوچه", "بست", "میدان", "بزرگراه", "شهرک", " خ ", "خ ", " ک ", "St", "Ave", "Blvd", "Road")
_DIGIT = re.compile(r"\d")
#: Looks like an address of mail, or like a place with a number, but lacks a part.
_MAY_MAIL = re.compile(rf"(?<![\w@])[A-Za-z0-9_.+-]{{3,}}{_AT}[A-Za-z0-9.-]{{3,}}", re.I)
_PLACE = re.compile(rf"(?<!\w)(?:{_STREET}|{_HOUSE})(?!\w)(?:(?!\n)[^.!؟?،,\d]){{1,40}}\d{{1,4}}(?!\d)")
#: Four numerals near each other; a text without them has no spelled number.
_MAY_SPELL = re.compile(rf"(?<![\w@])(?:[+(]{{1,2}})?(?:{_NUMERAL.pattern}(?: ?و ?|[ .،,()/-]{{0,3}})){{3}}{_NUMERAL.pattern}", re.I)


def candidates(flat: str) -> list[tuple[int, int, str]]:
    """(start, stop, type) of what has a form of its own and, with the types ?mail, ?number, ?place or OTHER, of what only looks like it.

    In order, without overlaps; what is sure comes before what is not.
    """
    found: list[tuple[int, int, str]] = []
    if _MAIL_SIGN.search(flat):
        found += [(m.start(), m.end(), "email") for m in _EMAIL.finditer(flat)]
        found += [(m.start(), m.end(), "?mail") for m in _MAY_MAIL.finditer(flat)]
    if _DIGIT.search(flat):
        if any(sign in flat for sign in _STREET_SIGNS):
            found += [(m.start(), m.end(), "address") for m in _ADDRESS.finditer(flat)]
            found += [(m.start(), m.end(), "?place") for m in _PLACE.finditer(flat)]
        if _PASSPORT_WORD.search(flat):
            for m in _PASSPORT.finditer(flat):
                if _PASSPORT_WORD.search(flat[max(0, m.start() - 30) : m.start()]) or _PASSPORT_WORD.search(flat[m.end() : m.end() + 30]):
                    found.append((m.start(), m.end(), "id_number"))
        if _LONG_NUMBER.search(flat):
            found += [(m.start(), m.end(), _number_type(flat, m.start(), m.end()) or "?number") for m in _NUMBER.finditer(flat)]
    if _MAY_SPELL.search(flat):
        found += _spelled(flat)
    for m in _STATED_NAME.finditer(flat) if "فامیل" in flat else ():
        found.append((*m.span(1), "name"))
        found.append((*m.span(2), "name"))
    out: list[tuple[int, int, str]] = []
    for start, stop, kind in sorted(found, key=lambda x: (x[2] not in TYPES, x[0], -x[1])):
        if all(stop <= a or start >= b for a, b, _ in out):
            out.append((start, stop, kind))
    return sorted(out)


def structured(flat: str) -> list[tuple[int, int, str]]:
    """(start, stop, type) of what has a form of its own, in order, without overlaps."""
    return [x for x in candidates(flat) if x[2] in TYPES]


# --- names ----------------------------------------------------------------------------------------------------------------

ROUNDS = 4
#: Confidence from which a given name is trusted, and a pattern, in the first round and later; trusted names a pattern needs.
TRUST, FIRST_PATTERN, PATTERN, SUPPORT = 0.9, 0.25, 0.6, 2
#: Confidence of a pattern and share of its windows that have a trusted name, and trusted names in it, from which any two words in it are a name.
ALONE, ALONE_SUPPORT = 0.95, 5
#: The same for the patterns of other types, and the confidence from which a candidate has their type.
CONTEXT, CONTEXT_SUPPORT, CANDIDATE = 0.6, 3, 0.75
CONTEXT_ROUNDS = 3
#: Windows after which a task hands on its counts; trusted names and patterns that are sent to all tasks, more are joined.
FLUSH, SENT = 1_000_000, 2_000_000

_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|\n")
#: The same and the space between.
_PIECE = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|\n|[^\S\n]+|_+")
_STOP = frozenset("\n.!؟?،,؛;:")


def _texts(df: DataFrame, row: str, content: str) -> DataFrame:
    return df.select(F.col(row).cast("long").alias("row"), F.col(content).alias("text")).where("text IS NOT NULL").withColumn("hash", F.xxhash64("text"))


def code_of(word: str) -> int:
    """A word's number, of 64 bits."""
    return xxhash.xxh64_intdigest(word) - (1 << 63)


#: Codes of the end of a sentence, one blank, any other space, and any number.
_END, _BLANK, _SPACE, _NUMBER_CODE = 1, 2, 3, 8


def _mixed(*parts: np.ndarray) -> np.ndarray:
    """64 well-mixed bits of columns of codes."""
    with np.errstate(over="ignore"):
        x = np.zeros(len(parts[-1]), np.uint64)
        for part in parts:
            x = (x ^ np.asarray(part).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            x ^= x >> np.uint64(29)
            x *= np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(32)
    return x.astype(np.int64)


class _Windows:
    """All windows of two adjacent words of some texts: first and second word and three patterns, each as a code.

    A pattern is what stands around: the two words before, one before and one after, or the two after; all numbers are one word in
    it. A pattern made of the ends of a sentence alone says nothing and is 0.
    """

    def __init__(self, known: dict[str, int], texts: Iterable[str]) -> None:
        codes: list[int] = []
        sizes: list[int] = []
        for flat in texts:
            before = len(codes)
            codes += (_END, _END, _END)
            for piece in _PIECE.findall(flat):
                code = known.get(piece)
                codes.append(self._learn(known, piece) if code is None else code)
            sizes.append(len(codes) - before)
        codes += (_END, _END, _END)
        every = np.array(codes, np.int64)
        text = np.repeat(np.arange(len(sizes)), sizes)
        kept = np.flatnonzero((every != _BLANK) & (every != _SPACE))
        c = every[kept]
        # A word of more than one letter is marked by its lowest bit, an end is odd too but small.
        word = (c & 1).astype(bool) & (c != _END)
        one = (kept[1:] - kept[:-1] == 2) & (every[np.minimum(kept[:-1] + 1, len(every) - 1)] == _BLANK)
        i = np.flatnonzero(word[:-1] & word[1:] & one)
        self.text = text[kept[i]] if len(i) else i
        #: Number of the window among its text's words, as _places counts them.
        self.first, self.second = c[i], c[i + 1]
        before, after = c[i - 1], c[i + 2]
        before2, after2 = np.where(before == _END, _END, c[i - 2]), np.where(after == _END, _END, c[np.minimum(i + 3, len(c) - 1)])
        kind = np.ones(len(i), np.int64)
        self.patterns = [
            np.where(before != _END, _mixed(kind, before2, before), 0), _mixed(2 * kind, before, after), np.where(after != _END, _mixed(3 * kind, after, after2), 0),
        ]

    @staticmethod
    def _learn(known: dict[str, int], piece: str) -> int:
        if len(known) > 500_000:
            known.clear()
        if piece in _STOP:
            code = _END
        elif piece[0] == "_" or piece.isspace():
            code = _BLANK if len(piece) == 1 else _SPACE
        elif piece[0].isdigit():
            code = _NUMBER_CODE
        else:
            code = code_of(piece) & ~15 | (1 if piece[0].isalpha() and len(piece) > 1 else 4)
        known[piece] = code
        return code


def _word_code(word: str) -> int:
    """The code of a word of more than one letter in windows."""
    return code_of(word) & ~15 | 1


def _window_places(flat: str) -> list[tuple[int, int]]:
    """(start, stop) of the windows of _Windows, in the same order."""
    tokens = list(_TOKEN.finditer(flat))
    return [(x.start(), y.end()) for x, y in zip(tokens, tokens[1:]) if y.start() - x.end() == 1 and all(t.group()[0].isalpha() and t.end() - t.start() > 1 for t in (x, y))]


def _context(flat: str, start: int, stop: int) -> list[int]:
    """The patterns around a span."""
    before = ["^", "^", *("^" if t in _STOP else t for t in _TOKEN.findall(flat[max(0, start - 60) : start]))][-2:]
    after = [*("^" if t in _STOP else t for t in _TOKEN.findall(flat[stop : stop + 60])), "^", "^"][:2]
    if before[1] == "^":
        before[0] = "^"
    if after[0] == "^":
        after[1] = "^"
    shown = [f"{before[0]} {before[1]} _"] * (before[1] != "^") + [f"{before[1]} _ {after[0]}"] * (before[1] != "^" or after[0] != "^") + [f"_ {after[0]} {after[1]}"] * (after[0] != "^")
    return [code_of(p) for p in shown]


#: kind: found (row, hash, start, stop, pii_type), context (the same, first: the instance, pattern), edge (first, pattern, n), pair (first, second, n), given (first).
_FIELDS = {"kind": pa.string(), "row": pa.int64(), "hash": pa.int64(), "start": pa.int32(), "stop": pa.int32(), "pii_type": pa.string(), "first": pa.int64(), "second": pa.int64(), "pattern": pa.int64(), "n": pa.int64()}
_FOUND = "kind string, row long, hash long, start int, stop int, pii_type string, first long, second long, pattern long, n long"


def _batch(rows: int, /, **columns: object) -> pa.RecordBatch:
    """A batch of the given columns, a single value for all rows or nothing at all for the rest."""
    out = []
    for name, kind in _FIELDS.items():
        value = columns.get(name)
        out.append(pa.nulls(rows, kind) if value is None else pa.array([value] * rows, kind) if isinstance(value, str) else pa.array(value, kind))
    return pa.RecordBatch.from_arrays(out, names=list(_FIELDS))


def _read(batch: pa.RecordBatch) -> list[tuple[int, int, str, list[tuple[int, int, str]]]]:
    """row, hash, skeleton and candidates of the texts of a batch."""
    out = []
    for row, code, text in zip(batch.column("row").to_pylist(), batch.column("hash").to_pylist(), batch.column("text").to_pylist()):
        flat = skeleton(text)
        out.append((row, code, flat, candidates(flat)))
    return out


def _sure(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    return [x for x in spans if x[2] in TYPES]


def _scan(texts: DataFrame) -> DataFrame:
    """What has a form of its own and what looks like it, with the patterns around; and the counts of all windows of two words."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        firsts, seconds, patterns = [], [], []
        held = 0

        def counts() -> Iterator[pa.RecordBatch]:
            nonlocal held
            first, second = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (firsts, seconds))
            _, at, n = np.unique(_mixed(first, second), return_index=True, return_counts=True)
            yield _batch(len(at), kind="pair", first=first[at], second=second[at], n=n)
            pattern = np.concatenate([np.concatenate([p[k] for p in patterns]) for k in range(3)]) if patterns else np.zeros(0, np.int64)
            first = np.tile(first, 3)[pattern != 0]
            pattern = pattern[pattern != 0]
            _, at, n = np.unique(_mixed(first, pattern), return_index=True, return_counts=True)
            yield _batch(len(at), kind="edge", first=first[at], pattern=pattern[at], n=n)
            for x in (firsts, seconds, patterns):
                x.clear()
            held = 0

        for batch in batches:
            read = _read(batch)
            found = [(row, code, *span) for row, code, _, spans in read for span in _sure(spans)]
            columns = list(zip(*found)) or [[]] * 5
            yield _batch(len(found), kind="found", row=columns[0], hash=columns[1], start=columns[2], stop=columns[3], pii_type=list(columns[4]))
            around = [(row, code, start, stop, kind, code_of("".join(flat[start:stop].lower().split())), pattern) for row, code, flat, spans in read for start, stop, kind in spans if kind != "name" for pattern in _context(flat, start, stop)]
            columns = list(zip(*around)) or [[]] * 7
            yield _batch(len(around), kind="context", row=columns[0], hash=columns[1], start=columns[2], stop=columns[3], pii_type=list(columns[4]), first=columns[5], pattern=columns[6])
            stated = [_word_code(flat[a:b]) for _, _, flat, spans in read for a, b, _ in [x for x in spans if x[2] == "name"][::2]]
            yield _batch(len(stated), kind="given", first=stated)
            windows = _Windows(known, (flat for _, _, flat, _ in read))
            firsts.append(windows.first)
            seconds.append(windows.second)
            patterns.append(windows.patterns)
            held += len(windows.first)
            if held > FLUSH:
                yield from counts()
        yield from counts()

    return texts.mapInArrow(find, _FOUND)


def _named_windows(texts: DataFrame, given: np.ndarray | None, strong: np.ndarray | None) -> DataFrame:
    """row, hash, start, stop, first, second, pattern of the windows with one of the given names or a strong pattern; of all if these are too many to be sent."""
    broadcast = texts.sparkSession.sparkContext.broadcast((given, strong))

    def within(codes: np.ndarray, of: np.ndarray) -> np.ndarray:
        return of[np.minimum(np.searchsorted(of, codes), len(of) - 1)] == codes if len(of) else np.zeros(len(codes), bool)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given, strong = broadcast.value
        known: dict[str, int] = {}
        for batch in batches:
            rows, codes = batch.column("row").to_numpy(), batch.column("hash").to_numpy()
            flats = [skeleton(t) for t in batch.column("text").to_pylist()]
            windows = _Windows(known, flats)
            picked = np.ones(len(windows.first), bool)
            if given is not None:
                picked = within(windows.first, given)
                for p in windows.patterns:
                    picked |= within(p, strong)
            at = np.flatnonzero(picked)
            begins = np.searchsorted(windows.text, np.arange(len(flats)))
            of = windows.text[at]
            places = {t: _window_places(flats[t]) for t in set(of.tolist())}
            spans = np.array([places[t][k - begins[t]] for k, t in zip(at.tolist(), of.tolist())], np.int32).reshape(-1, 2)
            each = np.repeat(np.arange(len(at)), 3)
            pattern = np.stack([p[at] for p in windows.patterns], 1).reshape(-1)
            yield _batch(len(each), kind="window", row=rows[of][each], hash=codes[of][each], start=spans[each, 0], stop=spans[each, 1], first=windows.first[at][each], second=windows.second[at][each], pattern=pattern)

    return texts.mapInArrow(find, _FOUND)


def score_names(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(given names, patterns) with their confidence after the rounds over the graph of patterns and instances (first, pattern, n).

    A pattern's confidence is the mean one of its distinct first words, and it must hold SUPPORT trusted ones; its share is that of its
    windows that have a trusted one. A word's confidence is
    1 - the product of (1 - confidence) over its trusted patterns, lowered if less than half of its windows have trusted ones.
    Seeds (first) keep 1. The graph has an edge a pattern and first word; counts don't weigh in it, so copies don't matter.
    """
    sizes = edges.groupBy("pattern").agg(F.count("*").alias("words"), F.sum("n").alias("all_n")).where(F.col("words") >= SUPPORT)
    totals = cut(edges.groupBy("first").agg(F.sum("n").alias("windows")))
    # A pattern of a single word can't be trusted; all windows of a word are counted before those are left out.
    edges = cut(edges.join(sizes, "pattern"))
    seeded = seeds.select("first", F.lit(1.0).alias("seed")).distinct()
    given = seeded.withColumnRenamed("seed", "trust")
    patterns = None
    for turn in range(rounds):
        held = edges.join(given, "first").groupBy("pattern").agg(F.sum("trust").alias("weight"), F.count(F.when(F.col("trust") >= TRUST, 1)).alias("trusted"), F.sum(F.when(F.col("trust") >= TRUST, F.col("n"))).alias("n"), F.first("words").alias("words"), F.first("all_n").alias("all_n"))
        patterns = cut(held.where(F.col("trusted") >= SUPPORT).select("pattern", (F.col("weight") / (F.col("words") + 1)).alias("confidence"), "trusted", (F.col("n") / F.col("all_n")).alias("share")))
        # A part of the words suffices in the first round, as most given names aren't seeds.
        usable = patterns.where(F.col("confidence") >= (PATTERN if turn else FIRST_PATTERN))
        scored = edges.join(usable, "pattern").groupBy("first").agg((1 - F.exp(F.sum(F.log1p(-F.least("confidence", F.lit(0.99)))))).alias("support"), F.sum("n").alias("held"))
        scored = scored.join(totals, "first").select("first", (F.col("support") * F.least(F.lit(1.0), 2 * F.col("held") / F.col("windows"))).alias("trust"))
        given = cut(scored.join(seeded, "first", "full").select("first", F.coalesce("seed", "trust").alias("trust")))
    return given.where(F.col("trust") >= TRUST), patterns.where(F.col("confidence") >= PATTERN)


#: What a candidate may turn out to be.
_MAY_BE = {"?number": ("phone", "id_number"), "?place": ("address",), "?mail": ("email",)}


def score_candidates(contexts: DataFrame, rounds: int = CONTEXT_ROUNDS) -> DataFrame:
    """first, pii_type of the instances without a form of their own (pii_type ?...) whose patterns (first, pattern, pii_type) are trusted.

    A pattern's confidence in a type is the share of its distinct instances that have it, one added, and it must hold CONTEXT_SUPPORT of
    them. An instance's is 1 - the product of (1 - confidence) over its patterns; from CANDIDATE on it has the type and counts in the next round.
    """
    edges = cut(contexts.groupBy("first", "pattern").agg(F.min("pii_type").alias("own"), F.max("pii_type").alias("other")).select("first", "pattern", F.when(F.col("own").startswith("?"), F.col("other")).otherwise(F.col("own")).alias("own")))
    told = None
    for _ in range(rounds):
        labelled = edges.withColumn("type", F.when(~F.col("own").startswith("?"), F.col("own")))
        if told is not None:
            labelled = labelled.join(told, "first", "left").withColumn("type", F.coalesce("type", "pii_type")).drop("pii_type")
        sizes = labelled.groupBy("pattern").agg(F.count("*").alias("instances"))
        good = labelled.where(F.col("type").isin(*TYPES)).groupBy("pattern", "type").agg(F.count("*").alias("n")).where(F.col("n") >= CONTEXT_SUPPORT).join(sizes, "pattern")
        good = good.select("pattern", "type", (F.col("n") / (F.col("instances") + 1)).alias("confidence")).where(F.col("confidence") >= CONTEXT)
        fits = F.lit(False)
        for may, types in _MAY_BE.items():
            fits = fits | ((F.col("own") == may) & F.col("type").isin(*types))
        scored = edges.where(F.col("own").startswith("?")).join(good, "pattern").where(fits).groupBy("first", "type").agg((1 - F.exp(F.sum(F.log1p(-F.col("confidence"))))).alias("support"))
        best = scored.groupBy("first").agg(F.max_by("type", F.struct("support", "type")).alias("pii_type"), F.max("support").alias("support"))
        told = cut(best.where(F.col("support") >= CANDIDATE).select("first", "pii_type"))
    return told


def find_personal(df: DataFrame, row: str = "row_ordinal", content: str = "content", seeds: tuple[str, ...] = SEED_NAMES, sent: int = SENT) -> DataFrame:
    """row, hash, start, stop, pii_type of everything found; start and stop count characters of the text's skeleton, hash is of the text.

    Null and empty texts hold nothing; repeated rows have the same finds each. Finds don't overlap but for names that share
    a word. An empty table gives no rows; extra columns are ignored. Texts are searched whole.
    """
    spark = df.sparkSession
    texts = _texts(df, row, content)
    found = spill(_scan(texts))
    place = ["row", "hash", "start", "stop"]

    told = score_candidates(found.where("kind = 'context'").select("first", "pattern", "pii_type"))
    discovered = found.where("kind = 'context' AND pii_type LIKE '?%'").select(*place, "first").distinct().join(told, "first").select(*place, "pii_type")

    seeded = spark.createDataFrame([(_word_code(s),) for s in seeds], "first long").unionByName(found.where("kind = 'given'").select("first"))
    edges = found.where("kind = 'edge'").groupBy("first", "pattern").agg(F.sum("n").alias("n"))
    given, patterns = score_names(edges, seeded)
    given, patterns = cut(given.select("first", F.lit(True).alias("trusted"))), cut(patterns)
    alone = (F.least("confidence", "share") >= ALONE) & (F.col("trusted") >= ALONE_SUPPORT)
    strong = patterns.where(alone).select("pattern")
    # A second word that follows several trusted given names is a family name; else a trusted pattern must speak for it.
    families = found.where("kind = 'pair'").select("first", "second").distinct().join(given, "first")
    families = families.groupBy("second").agg(F.count("*").alias("givens")).where("givens > 1").select("second", F.lit(True).alias("family"))
    codes = None, None
    if given.count() + strong.count() <= sent:
        codes = tuple(np.sort(x.toPandas().iloc[:, 0].to_numpy(np.int64)) for x in (given.select("first"), strong))
    spoken = patterns.select("pattern", F.lit(True).alias("spoken"), alone.alias("alone"))
    named = _named_windows(texts, *codes).join(given, "first", "left").join(spoken, "pattern", "left").join(families, "second", "left").where("alone OR trusted AND (spoken OR family)")
    sure = cut(found.where("kind = 'found'").select(*place, "pii_type").unionByName(discovered))
    # A name inside of something else, or stated as such already, is no find of its own.
    taken = sure.toDF("o_row", "o_hash", "o_start", "o_stop", "o_type")
    inside = (F.col("row") == F.col("o_row")) & (F.col("hash") == F.col("o_hash")) & (F.col("start") < F.col("o_stop")) & (F.col("stop") > F.col("o_start"))
    names = named.select(*place, F.lit("name").alias("pii_type")).distinct().join(taken, inside, "left_anti")
    return sure.unionByName(names)


def redact(df: DataFrame, row: str = "row_ordinal", content: str = "content", seeds: tuple[str, ...] = SEED_NAMES) -> DataFrame:
    """df with every find in content replaced by its type in angle brackets, like <phone>; all else stays as it was, character by character."""
    finds = find_personal(df, row, content, seeds).groupBy("row", "hash").agg(F.array_sort(F.collect_set(F.struct("start", "stop", "pii_type"))))
    # The finds' columns get names that df doesn't have.
    fresh = lambda name: next(n for n in (name + "_" * i for i in range(1, 99)) if n not in df.columns)
    key, code, spans = fresh("row"), fresh("hash"), fresh("finds")
    finds = finds.toDF(key, code, spans)
    joined = df.join(finds, (F.col(row).cast("long") == F.col(key)) & (F.xxhash64(content) == F.col(code)), "left")
    return joined.withColumn(content, F.when(F.col(spans).isNull(), F.col(content)).otherwise(_replace(F.col(content), F.col(spans)))).select(*df.columns)


def _replace(text: Column, finds: Column) -> Column:
    @arrow_udf(T.StringType())
    def replaced(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for t, found in zip(texts.to_pylist(), spans.to_pylist()):
            if t is None or not found:
                out.append(t)
                continue
            places, parts, done = original_places(t), [], 0
            for span in found:
                start = places[span["start"]]
                stop = places[span["stop"] - 1] + 1
                if start < done:
                    continue
                parts += [t[done:start], f"<{span['pii_type']}>"]
                done = stop
            out.append("".join([*parts, t[done:]]))
        return pa.array(out, pa.string())

    return replaced(text, finds)
