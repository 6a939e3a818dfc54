"""Confusables skeletons: texts that look the same get the same form.

The skeleton of a text is made as in Unicode's technical standard 39: decompose, replace every character by the prototype
of its look-alikes, decompose again. Two texts look the same here if their skeletons are equal. What is shown without a
difference is mapped together: full-width, presentation and font forms, the Arabic and Persian code points of one letter or
digit, twins from other scripts, all kinds of blank; characters without width go. What a reader sees stays: the number of
blanks, line breaks, punctuation, emoji, case, and Latin against Persian digits.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.functions import arrow_udf

# Letters of other scripts and the Latin letter that looks the same, one below the other.
_CYRILLIC = "АВЕЅІЈКМНОРСТХаеіјорсухѕԁһԛԝ"
_CYRILLIC_TWINS = "ABESIJKMHOPCTXaeijopcyxsdhqw"
_GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοϳν"
_GREEK_TWINS = "ABEZHIKMNOPTYXojv"
_ARMENIAN = "ՕՏսհօո"
_ARMENIAN_TWINS = "OSuhon"
_COPTIC = "ⲂⲎⲒⲔⲘⲚⲞⲢⲤⲦⲨⲬⲟⲣⲥ"
_COPTIC_TWINS = "BHIKMNOPCTYXopc"
_CHEROKEE = "ᎠᎡᎢᎥᎩᎪᎫᎬᎳᎷᎻᎽᏀᏂᏃᏏᏒᏔᏕᏙᏚᏞᏟᏢᏦᏧᏴ"
_CHEROKEE_TWINS = "DRTiYAJEWMHYGhZbRWSVSLCPKdB"
_LISU = "ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ"
_LISU_TWINS = "BPDTGKJCZFMNLSRVHWXYAEIOU"
_PHONETIC = "ɑɡ"
_PHONETIC_TWINS = "ag"
# Code points of one Arabic letter or digit that a Persian reader takes for the same.
_ARABIC = "يىےېكڪہھەۃ٠١٢٣٤٥٦٧٨٩"
_ARABIC_TWINS = "ییییککهههة۰۱۲۳۴۵۶۷۸۹"

_TWINS = {ord(a): b for s, t in ((_CYRILLIC, _CYRILLIC_TWINS), (_GREEK, _GREEK_TWINS), (_ARMENIAN, _ARMENIAN_TWINS), (_COPTIC, _COPTIC_TWINS), (_CHEROKEE, _CHEROKEE_TWINS), (_LISU, _LISU_TWINS), (_PHONETIC, _PHONETIC_TWINS), (_ARABIC, _ARABIC_TWINS)) for a, b in zip(s, t, strict=True)}
#: Kinds of compatibility form that are drawn like the character itself.
_SAME_LOOK = ("<wide>", "<narrow>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>", "<noBreak>")
#: Fillers and marks without width that are not of category Cf.
_NO_WIDTH = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}


class _Prototypes(dict):
    """Prototype by code point, worked out by rule when it is first asked for."""

    def __missing__(self, point: int) -> str:
        self[point] = out = self._prototype(point)
        return out

    def _prototype(self, point: int) -> str:
        char = chr(point)
        if point in _TWINS:
            return _TWINS[point]
        if point in (0x2028, 0x2029, 0x85, 0x0B, 0x0C):
            return "\n"
        if char in "\n\t":
            return char if char == "\n" else " "
        kind = unicodedata.category(char)
        if kind == "Zs":
            return " "
        if kind in ("Cf", "Cc") or point in _NO_WIDTH:
            return ""
        form = unicodedata.decomposition(char)
        tag = form.split(" ", 1)[0] if form.startswith("<") else ""
        if tag in _SAME_LOOK or (tag == "<compat>" and kind[0] in "LN"):
            # The forms are decomposed step by step, as one may hold another (a font form of a twin, a ligature with an accent).
            return "".join(self[p] for p in map(ord, unicodedata.normalize("NFD", "".join(chr(int(x, 16)) for x in form.split()[1:]))))
        return char


_PROTOTYPES = _Prototypes()
#: Texts of these characters only are their own skeleton, once the non-joiner is gone.
_PLAIN = re.compile("[\n -~آابپتثجچحخدذرزژسشصضطظعغفقکگلمنوهیءأؤئة۰-۹،؛؟«»❤\U0001f300-\U0001faff]*")


def skeleton(text: str | None) -> str | None:
    """The form in which equal-looking texts are equal, composed for reading; null stays null."""
    if text is None:
        return None
    text = text.replace("\u200c", "")
    if _PLAIN.fullmatch(text):
        return text
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    text = unicodedata.normalize("NFD", text).translate(_PROTOTYPES)
    text = unicodedata.normalize("NFC", unicodedata.normalize("NFD", text))
    # These have no composed code point of their own with the Persian letter.
    return text.replace("یٔ", "ئ").replace("هٔ", "ۀ")


@arrow_udf(T.StringType())
def skeleton_of(texts: pa.Array) -> pa.Array:
    """Column function: the skeleton of each text."""
    return pa.array([skeleton(t) for t in texts.to_pylist()], pa.string())


def key_of(col: Column) -> list[Column]:
    """128 bits of a text, as two columns."""
    return [F.xxhash64(col), F.xxhash64(F.lit("kelk"), col)]


def _keyed(df: DataFrame, row: str, fields: list[str]) -> DataFrame:
    """row, field, k1, k2 (the skeleton), o1, o2 (as stored) of each text that isn't null."""
    shown = df.select(F.col(row).alias("row"), *[F.col(f).alias(f"f{i}") for i, f in enumerate(fields)])
    shown = shown.withColumns({f"s{i}": skeleton_of(F.col(f"f{i}")) for i in range(len(fields))})
    one = [
        F.struct(F.lit(f).alias("field"), *[h.alias(n) for n, h in zip(("k1", "k2"), key_of(F.col(f"s{i}")))], F.xxhash64(F.col(f"f{i}")).alias("o"), F.col(f"f{i}").isNotNull().alias("there"))
        for i, f in enumerate(fields)
    ]
    return shown.select("row", F.explode(F.array(*one)).alias("x")).where("x.there").select("row", "x.field", "x.k1", "x.k2", "x.o")


def consistent_form(df: DataFrame, fields: list[str]) -> DataFrame:
    """df with every one of the fields in its consistent form, the other columns unchanged."""
    return df.withColumns({f: skeleton_of(F.col(f)) for f in fields})


def look_alike_groups(df: DataFrame, row: str, fields: list[str]) -> DataFrame:
    """Rows of texts that look like another text stored differently: row, field, k1, k2, o, group_rows, hot.

    Null texts belong to no group; an empty text looks like one of zero-width characters only. Repeated rows stay as many as
    they are. Only groups with at least two stored forms remain. All columns but row and fields are ignored.
    """
    keyed = _keyed(df, row, fields)
    groups = keyed.groupBy("field", "k1", "k2").agg(F.min("o").alias("least"), F.max("o").alias("most"), F.count("*").alias("group_rows")).where("least <> most").drop("least", "most")
    return keyed.join(groups, ["field", "k1", "k2"])


def look_alike_pairs(df: DataFrame, row: str, fields: list[str], salt_rows: int = 2_000) -> DataFrame:
    """field, row_a, row_b: row_a < row_b whose texts look the same but are stored differently; each pair once.

    The pairs are made between the stored forms of a group, never within one. Groups of more than salt_rows rows are
    split on one side into parts of about that size, each of which meets the whole other side in another task.
    """
    rows = look_alike_groups(df, row, fields)
    forms = rows.groupBy("field", "k1", "k2", "o").agg(F.count("*").alias("n"), F.first("group_rows").alias("group_rows"))
    other = forms.select("field", "k1", "k2", F.col("o").alias("o2"))
    # For each two forms the one with the smaller code leads, so that each pair of rows comes up once.
    meets = forms.join(other, ["field", "k1", "k2"]).where("o < o2")
    parts = F.ceil(F.col("group_rows") / F.lit(salt_rows)).cast("int")
    left = rows.select("field", "k1", "k2", "o", F.col("row").alias("x"), F.pmod(F.xxhash64("row"), parts).cast("int").alias("part"))
    right = rows.select("field", "k1", "k2", F.col("o").alias("o2"), F.col("row").alias("y"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    pairs = left.join(meets.select("field", "k1", "k2", "o", "o2"), ["field", "k1", "k2", "o"]).join(right, ["field", "k1", "k2", "o2", "part"])
    return pairs.select("field", F.least("x", "y").alias("row_a"), F.greatest("x", "y").alias("row_b"))
