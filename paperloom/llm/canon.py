"""Problem 5: visually identical text brought to one form.

``canonical`` composes compatibility normalisation (NFKC), maps every white space (tabs and
line ends too) to a plain space and strips it at the ends, removes default-ignorable
characters, and joins radicals to the ideographs they look like. Look-alike letters of other
scripts become Latin only in words that are Latin otherwise: nothing in the word is left
foreign, and it has a Latin letter, or the text has no letter that only those scripts have and
the word is a code of capitals and digits or stands among Latin ones. Else a word made of
look-alikes only stays as it is, as nothing tells it from a word of its own script. Accents are taken apart
before, so a foreign letter with an accent is restored with it.
``folded`` adds full case folding for comparison, repeated until nothing changes. Both run
once per distinct value of an Arrow batch, so a repeated value costs nothing and no shuffle is
needed.

``looks_right_only`` is derived from the same steps: a text is found if they change it in
anything but the exempt characters, which are ordinary signs although NFKC has other forms for
them: full-width punctuation, the ellipsis, letter-like symbols and superscripts in everyday
use, vulgar fractions, enclosed numbers, tab and line ends.

Null stays null, "" stays ""; texts of ignorable characters only become "".
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters of other scripts that look like Latin ones.
LOOKALIKES = str.maketrans(
    "АВЕКМНОРСТУХІЅЈҮԌԚԜӀаеорсухѕіјүһԁԛԝӏѵΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿανορυϲϳ",
    "ABEKMHOPCTYXISJYGQWIaeopcyxsijyhdqwlvABEZHIKMNOPTYXCJavopucj",
)
# Radicals without a compatibility mapping, and their ideographs.
RADICALS = str.maketrans(
    "⺁⺄⺅⺆⺉⺊⺌⺍⺎⺐⺒⺓⺖⺘⺙⺛⺜⺝⺠⺡⺢⺣⺦⺧⺨⺩⺬⺭⺮⺯⺰⺱⺲⺶⺸⺹⺺⺻⺽⺾⺿⻀⻁⻂⻃⻄⻅⻆⻈⻉⻋⻌⻍⻎⻐⻑⻒⻓⻔⻖⻗⻘⻙⻚⻛⻜⻝⻟⻠⻢⻣⻤⻥⻦⻧⻨⻩⻪⻫⻬⻭⻮⻯⻰⻱⻲",
    "厂乙亻冂刂卜小小兀尢巳幺忄扌攵旡日月民氵氺灬丬牛犭王示礻竹糹纟罓罒羊羋耂肀聿臼艹艹艹虎衤覀西见角讠贝车辶辶辶钅長镸长门阝雨青韦页风飞食飠饣马骨鬼鱼鸟卤麦黄黾斉齐歯齿竜龙龜亀",
)

_IGNORABLE = re.compile(
    "[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ￰-￸\U0001bca0-\U0001bca3\U0001d173-\U0001d17a\U000e0000-\U000e0fff]"
)
_SPACE = re.compile(r"[\s\x85]")
_WORD = re.compile(r"[^\W_㐀-䶿一-鿿]+(?:-\d+)*")
_FOREIGN = re.compile("[Ͱ-ϿЀ-ԯ]")
_LATIN = re.compile("[A-Za-zÀ-ɏ]")
_CODE = re.compile("(?=[^0-9]*[0-9])[0-9A-Z]+(?:-[0-9]+)*")
_PLAIN = re.compile(r"[\x20-\x7e]*\Z")
# Signs in everyday use that are themselves, not stand-ins for their compatibility forms.
_EXEMPT = re.compile("[！-／：-＠［-｀｛-･…‥¨¯´¸·℃℉№℡™Ω℮²³¹⁰-₎ªº½¼¾⅐-⅟①-⓿㈠-㋿㍘-㏿\t\r\n]")


def _restore(word: str, foreign: bool, latin: bool) -> str:
    """Latin letters for look-alikes in a word that is Latin otherwise; the flags tell what letters the text has."""
    if not _FOREIGN.search(word):
        return word
    plain = unicodedata.normalize("NFC", unicodedata.normalize("NFD", word).translate(LOOKALIKES))
    if _FOREIGN.search(plain):
        return word
    return plain if _LATIN.search(word) or (not foreign and (latin or _CODE.fullmatch(plain))) else word


def _steps(text: str) -> str:
    text = unicodedata.normalize("NFKC", _IGNORABLE.sub("", text))
    text = unicodedata.normalize("NFC", _IGNORABLE.sub("", text).translate(RADICALS))
    text = _SPACE.sub(" ", text)
    if not _FOREIGN.search(text):
        return text
    foreign = bool(_FOREIGN.search(unicodedata.normalize("NFD", text).translate(LOOKALIKES)))
    latin = bool(_LATIN.search(text))
    return _WORD.sub(lambda m: _restore(m[0], foreign, latin), text)


def canonical(text: str | None) -> str | None:
    if text is None or _PLAIN.match(text):
        return text.strip(" ") if text else text
    return _steps(text).strip(" ")


def folded(text: str | None) -> str | None:
    """``canonical`` in full case folding, for comparisons; a fixed point of itself."""
    if text is None:
        return None
    while (after := canonical(unicodedata.normalize("NFKC", canonical(text).casefold()))) != text:
        text = after
    return text


def looks_right_only(text: str | None) -> bool:
    """True if the steps of ``canonical`` change more than exempt characters and plain spaces at the ends."""
    if not text or _PLAIN.match(text):
        return False
    own = _EXEMPT.sub("\x00", text)
    return _steps(own) != own


def per_distinct(f: Callable, kind: T.DataType) -> Callable:
    """Pandas UDF that applies f once per distinct value of a batch."""

    def run(values: pd.Series) -> pd.Series:
        codes, distinct = pd.factorize(values, use_na_sentinel=True)
        done = [f(v) for v in distinct] + [f(None)]
        return pd.Series([done[c] for c in codes], dtype=object, index=values.index)

    return F.pandas_udf(run, kind)


canonical_udf = per_distinct(canonical, T.StringType())
folded_udf = per_distinct(folded, T.StringType())
_found_udf = per_distinct(looks_right_only, T.BooleanType())


def fields(df: DataFrame, table_name: str, key: str, names: list[str]) -> DataFrame:
    """Long form (table_name, key_id, field_name, value) of the named fields."""
    return df.select(
        F.lit(table_name).alias("table_name"),
        F.col(key).cast("bigint").alias("key_id"),
        F.explode(F.array(*(F.struct(F.lit(n).alias("field_name"), F.col(n).alias("value")) for n in names))).alias("x"),
    ).select("table_name", "key_id", "x.field_name", "x.value")


def find_disguised(values: DataFrame) -> DataFrame:
    """Rows of the long form whose value only looks right; plain ASCII never leaves the JVM."""
    return values.where(F.col("value").rlike(r"[^\x20-\x7e]")).where(_found_udf("value")).select(
        "table_name", "key_id", "field_name"
    )


def normalised(values: DataFrame) -> DataFrame:
    return values.withColumn("canonical", canonical_udf("value")).withColumn("folded", folded_udf("value"))
