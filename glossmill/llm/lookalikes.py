"""Visually identical text with different characters, brought to one consistent form.

Distinct values are exploded to positioned code points, broadcast-joined with the decomposition
table and the look-alike table, combining marks are put in order by class, letters and marks are
recomposed and the values rebuilt. Only values that could change are exploded at all: a value is
passed over if it surely stands in its consistent form whatever the language (``SURE``), or in the
script of its text's language (``sure_in``). The tokens are scanned once: what is left open is
written, its distinct values are judged, and those that change are joined back, the heavy ones
by broadcast.

The consistent form has ordinary spaces only and none at the edges, composed characters, ordinary
widths and hyphens, separate letters for ligatures and letter-like numerals, plain letters for
mathematical letters and for the shapes that letters take inside words, nothing invisible, and in
place of look-alikes the letters of the script of the text's language. A foreign letter is replaced
only if every letter of its script in the same word has a look-alike, and if the word has other
letters or more than one letter; a sign alone (a Greek letter, a letter before a number), a code of
foreign letters and digits and a true foreign word stay. Circled, raised and lowered signs differ to
the eye and stay.

Defined results
---------------
* null and empty values have no form and are left out; a value of blanks only becomes empty.
* without a text, a language or a known script look-alikes stay; all else is done.
* repeated rows give one result; an empty table gives no rows.
* tables broadcast here are derived from the character database, so their size is fixed, or hold the
  changed values of at least 1/200 of the open rows, so at most 200.
* ``read_look_alikes`` takes the rows of a public look-alike file in place of, or beside, the table here.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossmill.context import written

#: The script of a language; languages not listed have none.
SCRIPTS = {
    "Latin": tuple("en es fr de tr it pt nl sv da no nb nn fi pl cs sk sl hr ro hu ca gl eu et lv lt is ga cy sq mt af id ms vi sw az uz la eo".split()),
    "Cyrillic": tuple("ru uk be bg sr mk kk ky mn tg".split()),
    "Greek": ("el",),
}
#: Look-alike letters, one column a script (Latin, Cyrillic, Greek); "-" where a script has none.
LOOK_ALIKES = """
A А Α
B В Β
C С -
E Е Ε
H Н Η
I І Ι
J Ј -
K К Κ
M М Μ
N - Ν
O О Ο
P Р Ρ
S Ѕ -
T Т Τ
X Х Χ
Y У Υ
Z - Ζ
a а α
c с -
e е -
i і ι
j ј -
k к κ
o о ο
p р ρ
s ѕ -
u - υ
v ѵ ν
x х χ
y у -
h һ -
w ԝ -
q ԛ -
d ԁ -
"""
#: Further letters of a script that look like a Latin one.
MORE_LOOK_ALIKES = {
    "Latin": "ɑa ɡg ıi",
    "Cyrillic": "ӏl ӀI үy ҮY ԍG ҽe ɩi",
    "Greek": "ϲc ϹC ϳj ϱp",
    "Armenian": "օo ՕO ոn սu ՍU հh զq ցg յj",
    "Cherokee": "ᎠD ᎡR ᎢT ᎥI ᎪA ᎫJ ᎬE ᎳW ᎷM ᎻH ᎽY ᏀG ᏃZ ᏒR ᏔW ᏕS ᏙV ᏚS ᏞL ᏟC ᏢP ᏦK ᏴB",
    "Coptic": "ⲞO ⲟo ⲢP ⲣp ⲤC ⲥc ⲬX ⲭx ⲀA ⲎH ⲒI ⲔK ⲘM ⲚN ⲦT",
}
SCRIPT_NAMES = ("Latin", "Cyrillic", "Greek")
FIELDS = ("lemma", "wf")


@lru_cache(maxsize=1)
def look_alike_rows() -> list[tuple[str, str, str]]:
    """(script of the text, foreign letter, letter to put in its place)."""
    rows = []
    for line in LOOK_ALIKES.split("\n"):
        letters = line.split()
        for i, home in enumerate(letters):
            rows += [(SCRIPT_NAMES[i], x, home) for j, x in enumerate(letters) if j != i and "-" not in (x, home)]
    same = {line.split()[0]: line.split() for line in LOOK_ALIKES.split("\n") if line}
    for script, pairs in MORE_LOOK_ALIKES.items():
        for foreign, latin in pairs.split():
            for home, letter in zip(SCRIPT_NAMES, same.get(latin, [latin, "-", "-"])):
                if home != script and letter != "-":
                    rows.append((home, foreign, letter))
    return rows


def read_look_alikes(path: str) -> list[tuple[str, str, str]]:
    """Rows as of ``look_alike_rows`` from a public look-alike file: ``0430 ; 0061 ; MA`` lines of single letters.

    The letter of a home script stands for its whole class of look-alikes.
    """
    classes: dict[str, set[str]] = {}
    with open(path, encoding="utf-8-sig") as f:
        for line in f:
            cells = [c.split() for c in line.split("#")[0].split(";")]
            if len(cells) >= 2 and len(cells[0]) == len(cells[1]) == 1:
                a, b = (chr(int(c[0], 16)) for c in cells[:2])
                classes.setdefault(b, {b}).add(a)
    rows = []
    for members in classes.values():
        letters = sorted(x for x in members if x.isalpha())
        for home in SCRIPT_NAMES:
            own = [x for x in letters if unicodedata.name(x, "").startswith(f"{home.upper()} ") and unicodedata.normalize("NFKC", x) == x]
            if own:
                rows += [(home, x, own[0]) for x in letters if not unicodedata.name(x, "").startswith(f"{home.upper()} ")]
    return rows


def _invisible(c: str, category: str) -> bool:
    o = ord(c)
    return (
        category == "Cf"
        or (category == "Cc" and not c.isspace())
        or 0xFE00 <= o <= 0xFE0F
        or 0xE0100 <= o <= 0xE01EF
        or o in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x3164, 0xFFA0)
    )


#: Kinds of decompositions whose sign looks as what it stands for: shapes of letters, widths, mathematical letters.
ALIKE_KINDS = {"<wide>", "<narrow>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>", "<small>", "<vertical>"}


@lru_cache(maxsize=1)
def decomposition_rows() -> list[tuple[str, list[tuple[str, int]]]]:
    """(code point, what stands for it with combining classes), derived from the character database.

    Invisible characters stand for nothing, spaces for the ordinary space, the hyphens that look like
    the ordinary one for it, wide and narrow forms, shapes of letters, mathematical letters,
    ligatures and letter-like numerals for their letters, composed letters for base and marks. Code points that stand
    for themselves with class 0 are not listed; Hangul syllables are left to recomposition.
    """
    rows = []
    for o in range(sys.maxunicode + 1):
        if 0xD800 <= o <= 0xDFFF or 0xAC00 <= o <= 0xD7A3:
            continue
        c = chr(o)
        category = unicodedata.category(c)
        if category in ("Cn", "Co"):
            continue
        kind = unicodedata.decomposition(c).split(" ", 1)[0]
        if _invisible(c, category):
            to = ""
        elif c.isspace() or category in ("Zs", "Zl", "Zp"):
            to = " "
        elif o in (0x2010, 0x2011):
            to = "-"
        elif kind in ALIKE_KINDS:
            to = unicodedata.normalize("NFKD", c)
        elif kind == "<compat>" and (category == "Nl" or category[0] == "L" and len(unicodedata.normalize("NFKD", c)) > 1) and all(unicodedata.category(x)[0] in "LM" for x in unicodedata.normalize("NFKD", c)):
            to = unicodedata.normalize("NFKD", c)
        else:
            to = unicodedata.normalize("NFD", c)
        out = [(x, unicodedata.combining(x)) for x in to]
        if out != [(c, 0)]:
            rows.append((c, out))
    return rows


def _sure() -> str:
    """A pattern of values that are in their consistent form in every language.

    ASCII signs, digits and single inner or outer-free blanks, and words of one script in
    composed letters of which at least one has no look-alike anywhere.
    """
    known = {x for _, x, _ in look_alike_rows()}
    words = []
    for first, last, extra in ((0x41, 0x7A, range(0xC0, 0x180)), (0x410, 0x44F, (0x401, 0x451)), (0x391, 0x3C9, (0x386, *range(0x388, 0x391), *range(0x3CA, 0x3CF)))):
        letters = [c for o in (*range(first, last + 1), *extra) if (c := chr(o)).isalpha() and unicodedata.normalize("NFKC", c) == c]
        shared = "".join(c for c in letters if unicodedata.normalize("NFD", c)[0] in known)
        own = "".join(c for c in letters if unicodedata.normalize("NFD", c)[0] not in known)
        words.append(f"[{shared}]*+[{own}][{shared}{own}]*+(?![{shared}{own}\\p{{L}}\\p{{M}}])")
    return r"\A(?! )(?:[\x20-\x7E&&[^A-Za-z]]|" + "|".join(words) + r")++(?<! )\z"


SURE = _sure()
#: Composed letters of a script, as ranges of a pattern.
LETTERS = {"Latin": "A-Za-zÀ-ÖØ-öø-ıĴ-ľŁ-ňŊ-ž", "Cyrillic": "ЁА-яё", "Greek": "ΆΈ-ΊΌΎ-ΡΣ-ώ"}


def sure_in(script: Column, value: Column) -> Column:
    """Whether a value surely stands in its consistent form in a text of this script: signs, digits and composed letters of the script only."""
    out = F.lit(False)
    for name, letters in LETTERS.items():
        out = F.when(script == name, value.rlike(rf"\A(?! )(?:[\x20-\x7E&&[^A-Za-z]]|[{letters}])++(?<! )\z")).otherwise(out)
    return out


def script_of(lang: Column) -> Column:
    """The script of a language code, as an expression."""
    out = F.lit(None).cast("string")
    for script, langs in SCRIPTS.items():
        out = F.when(F.lower(lang).isin(*langs), script).otherwise(out)
    return out


def consistent_values(values: DataFrame, look_alikes: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """(script, value, form) of distinct ``values(script, value)``; script empty where unknown.

    Groups are single values, so none grows with the number of rows.
    """
    spark: SparkSession = values.sparkSession
    table = spark.createDataFrame(decomposition_rows(), "cp string, parts array<struct<c:string,ccc:int>>")
    alike = spark.createDataFrame(look_alikes or look_alike_rows(), "home string, c string, letter string")
    one = values.select(F.coalesce("script", F.lit("")).alias("script"), "value").distinct()
    points = one.select("script", "value", F.posexplode(F.regexp_extract_all("value", F.lit(r"(?s)."), 0)).alias("pos", "cp"))
    # an invisible sign leaves an empty part, so that a value of nothing else still has a form
    itself = F.array(F.struct(F.when(F.col("listed"), "").otherwise(F.col("cp")).alias("c"), F.lit(0).alias("ccc")))
    listed = points.join(F.broadcast(table.withColumn("listed", F.lit(True))), "cp", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    parts = listed.select("script", "value", "pos", F.posexplode(F.when(F.size("parts") > 0, F.col("parts")).otherwise(itself)).alias("sub", "part")).select(
        "script", "value", "pos", "sub", "part.c", "part.ccc"
    )
    letter = (F.col("c") == "") | F.col("c").rlike(r"[\p{L}\p{M}]")
    own_script = F.lit(None).cast("string")
    for name in MORE_LOOK_ALIKES:
        own_script = F.when(F.col("c").rlike(rf"\p{{Is{name}}}"), name).otherwise(own_script)
    order = Window.partitionBy("script", "value").orderBy("pos", "sub")
    worded = parts.withColumn("own", own_script).withColumn("word", F.sum((~letter).cast("int")).over(order)).withColumn("cluster", F.sum(((F.col("ccc") == 0) & (F.col("c") != "")).cast("int")).over(order))
    matched = worded.join(F.broadcast(alike), (worded.script == alike.home) & (worded.c == alike.c), "left").select(worded["*"], "letter")
    word = Window.partitionBy("script", "value", "word")
    same = Window.partitionBy("script", "value", "word", "own")
    letters = F.col("c").rlike(r"\p{L}").cast("int")
    judged = matched.select(
        "*",
        F.sum(letters).over(word).alias("n_letters"),
        F.sum(letters).over(same).alias("n_own"),
        F.count("letter").over(same).alias("n_alike"),
    )
    code = (F.col("n_own") == F.col("n_letters")) & F.col("value").rlike(r"\p{N}")
    swap = F.col("letter").isNotNull() & (F.col("n_alike") == F.col("n_own")) & (F.col("n_letters") > 1) & ~code
    mapped = judged.select("script", "value", "pos", "sub", "cluster", "ccc", F.when(swap, F.col("letter")).otherwise(F.col("c")).alias("c"))
    sorted_ = F.array_sort(F.collect_list(F.struct("cluster", "ccc", "pos", "sub", "c")))
    rebuilt = mapped.groupBy("script", "value").agg(F.array_join(F.transform(sorted_, lambda x: x["c"]), "").alias("s"))
    form = F.regexp_replace(_recompose("s"), r"\A +| +\z", "")
    return rebuilt.select("script", "value", form.alias("form"))


@F.pandas_udf(T.StringType())
def _recompose(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Compose ordered base letters and marks; values are distinct, so each is composed once."""
    for s in batches:
        yield s.map(lambda x: unicodedata.normalize("NFC", x))


#: A value is heavy from this share of the open rows on; at most its inverse can be.
HEAVY_SHARE = 1 / 200


def inconsistent_values(tokens: DataFrame, texts: DataFrame, fields: tuple[str, ...] = FIELDS, look_alikes: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """(tok_id, field_name, value, form) of the values that are not in their consistent form.

    Only values that may change meet the texts (for the language) and the distinct-value table. A
    token that comes twice has each of its values once.
    """
    pairs = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in fields])
    rows = tokens.select("tok_id", "text_id", F.inline(pairs)).where("tok_id is not null and value is not null and value <> ''")
    open_ = rows.where(~F.col("value").rlike(SURE))
    langs = texts.where("text_id is not null and lang is not null").groupBy("text_id").agg(F.min("lang").alias("lang"))
    spoken = open_.join(langs, "text_id", "left").select("tok_id", "field_name", "value", F.coalesce(script_of(F.col("lang")), F.lit("")).alias("script"))
    spoken = written(spoken.where(~sure_in(F.col("script"), F.col("value"))))
    changed = written(consistent_values(spoken, look_alikes).where("form <> value"))
    row = spoken.agg(F.count("*").alias("rows"), F.expr(f"approx_top_k(value, {int(1 / HEAVY_SHARE)}, {int(10 / HEAVY_SHARE)})").alias("top")).first()
    heavy = [x["item"] for x in row["top"] or [] if x["item"] is not None and x["count"] >= HEAVY_SHARE * row["rows"]]
    much = F.col("value").isin(heavy) if heavy else F.lit(False)
    key = ["script", "value"]
    joined = spoken.where(~much).join(changed.where(~much), key)
    if heavy:
        joined = joined.unionByName(spoken.where(much).join(F.broadcast(changed.where(much)), key))
    return joined.select("tok_id", "field_name", "value", "form").dropDuplicates(["tok_id", "field_name", "value"])
