"""Template residue and error-page text.

Quoted passages are taken out first, since a text may quote a message without being one. Numbers,
dates, addresses and identifiers are masked in the whole text, which is then cut into lines and
sentences. The exact normalised units are grouped by hash over all documents and sources, with the
documents and sources of each group; then each distinct unit is classified once:

* a group is recurring if it stands in at least ``MIN_DOCS`` documents of at least ``MIN_SOURCES``
  sources. Recurrence decides: a recurring unit is residue if it is any kind of message, also one
  that only opens like a message or only speaks to its reader about pages, scripts or sessions;
* a unit that recurs less is residue only if it has an unfilled place of a template, or if the
  unit as a whole reads as a message, filler or notice.

The second rule is needed because a message may stand in a collection only once, which recurrence
cannot find. The classified units are joined back to their documents.

Defined results
---------------
* null, empty and blank texts are never marked; ids that come more than once are marked once;
  rows without id are left out of the marks.
* format marks (``@highlight``, ``# ::id``, special tokens) and sentences that speak of
  placeholders or errors are no residue.
* a text without source counts as of one source of its own, named by null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossmill.context import cut_lineage, written

MIN_DOCS, MIN_SOURCES = 5, 2

#: Names in brackets that are marks of formats, not places of a template.
FORMAT_MARKS = "MASK|CLS|SEP|PAD|UNK|BOS|EOS|NUM|SIC|USER|ASSISTANT|SYSTEM|INST|TABLE|FIGURE|MATH|REF|CITATION|QUOTE"
#: Forms of unfilled places.
PLACEHOLDERS = r"""
\{\{\{?\s*[\p{L}_][\w .:-]{0,40}\s*\}?\}\}
(?<![\\\w}])\{[a-z][a-z_]{2,30}\}
[$#]\{\s*[\p{L}_][\w. -]{0,40}\s*\}
<%=?\s*[\p{L}_][\w. -]{0,40}\s*%>
\{%\s*[\p{L}_][\w. -]{0,40}\s*%\}
%%[\p{L}_][\p{L}_ -]{1,40}%%
@@[\p{L}_][\w-]{1,40}@@
(?<!\w)__[A-Z][A-Z_]{1,40}__(?!\w)
\[\[\s*[a-z][a-z_ ]{1,40}\s*\]\]
\[(?!(?:FORMAT_MARKS)\])[A-Z][A-Z_]{2,40}\]
\[[A-Z][A-Z_ ]{2,40} HERE\]
<<\s*[\p{L}_][\w -]{1,40}\s*>>
(?<![\w%])%[A-Z][A-Z_]{2,40}%(?![\w%])
\[(?i:insert|your|add|enter|put) [^\]\n]{1,50} here\]
\[(?i:your) [^\]\n]{1,40}\]
<(?!(?:FORMAT_MARKS)>)[A-Z][A-Z_]{2,40}>
&lt;\s*[\p{L}_][\w -]{1,40}\s*&gt;
%\([a-z_]{2,40}\)[sd]
\[object Object\]
(?i:\bundefined undefined\b)
(?i:\bon null by undefined\b)
"""
#: Messages, filler and notices as whole units, at the start of a masked, lower-case unit.
PHRASES = r"""
(?:please |you (?:need|have|must) to )?(?:enable|activate|turn on|switch on|allow) (?:java ?scripts?|scripts|cookies)\b
you (?:need|have|must) (?:to )?(?:enable|have|allow) (?:java ?script|scripts|cookies)
this (?:\w+ ){1,2}(?:needs|requires|works only with|does not work without) (?:java ?script|scripts)
(?:java ?script|scripts?) (?:is|are) (?:turned off|switched off|disabled|required|needed|blocked)
your browser (?:does not support|has) (?:java ?script|scripts)
<noscript>
(?:checking|verifying) (?:your|that your) browser
please wait while (?:we (?:check|verify|load|confirm|redirect|prepare|process|connect)|your (?:browser|request|page|content))
(?:please )?(?:confirm|verify|prove) (?:that )?you are (?:a )?human
(?:error|http)[ :/]*9(?=$|\s*[:.!()–—-])
(?:error |http )?9(?:[ :|–—-]+)(?:forbidden|not found|bad gateway|bad request|unauthori[sz]ed|gateway time-?out|service unavailable|internal server error|access denied|error|page not found)
(?:forbidden|bad gateway|bad request|gateway time-?out|service (?:temporarily )?unavailable|internal server error|page not found|access denied|permission denied|too many requests)(?=$|[.:!(\[ ]{1,3}(?:$|9|your|you|slow|the|please|reference|we|\())
access denied(?=$|[.:!(\[–—-]|,? (?:you|your|please)\b)
too many requests(?=$|[.:!(\[]|,? (?:please|slow|try|from this|have been made|were made)\b)
you do not have (?:permission|access) to (?:read|view|see|access|open)
the page you (?:asked for|requested|are looking for|were looking for|tried to).*\b(?:not|no longer|moved|removed|unavailable|gone|can't|cannot)\b
(?:oops|whoops|sorry)[!,.]? (?:that|this|the) page (?:can't|cannot|could not|can not)
that page can't be found
(?:oops|whoops)!$
sorry, something went wrong\b
something went wrong (?:on|at) (?:our|this) (?:side|end|server)\b
the requested (?:page|article|url|resource|document|file) (?:has been|was not|could not|cannot|does not)
the document could not be loaded
nothing here yet[.!…]*$
the link you followed (?:may|might|could|is|was|has|seems|appears)\b
your session (?:has )?(?:expired|timed out|ended)
you have been (?:logged|signed) out(?=$|[.,:;!…]| (?:because|due|for|of your|after)\b)
(?:log|sign) in to (?:read|continue|view|see)
loading (?:article|page|content|data|text)?\s*(?:…|\.\.\.)
if nothing happens, (?:switch|enable|reload|turn)
the server (?:met|encountered|returned) an? (?:unexpected (?:condition|error|problem)|internal|error)
no answer from the upstream server
database connection (?:failed|error|lost)
error establishing a database connection
we are (?:down|offline|closed) for (?:\w+ )?maintenance
(?:this|the|our) (?:site|page|service) is (?:down|offline|under|closed) (?:for )?(?:\w+ )?maintenance
traceback \(most recent call last\)
(?:[a-z]\w*\.)+\w*(?:exception|error)\b
(?:[a-z]+error|[a-z]+exception): 
at (?:[a-z]\w*\.)+\w+\(\w+\.(?:java|kt|scala|js|py):9\)
file \S+, line 9, in 
(?:fatal|uncaught) (?:error|exception)\b
request(?: id)?: 9\b
.*\b(?:dolor sit amet|consectetur adipiscing|sed do eiusmod|incididunt ut labore|dolore magna aliqua|quis nostrud exercitation|ullamco laboris|duis aute irure|excepteur sint|minim veniam)\b
lorem ipsum\b(?! (?:is|was|are|has|means|text is))
(?:the )?(?:title|subtitle|headline|content|body(?: copy| text)?|caption|text|summary|description|your (?:\w+ )?text|your (?:title|content|headline|name)) (?:goes|comes|will go) here\b
(?:your|add|insert|enter|type) (?:\w+ ){0,2}(?:text|title|content|headline|description) here\b
(?:article |body )?(?:text|copy|content) (?:is )?to come\b
click to edit\b
this is (?:a |an |some )?(?:sample|placeholder|dummy|example) (?:paragraph|text|page|post|heading)(?=$|[.,:;!…])
replace (?:it|this|me) with your own
(?:todo|tbd|fixme)\s*[:(]
(\p{L}+)(?: \1){4,}[.!…]*$
(?:text|copy|headline|title) tbd\b
(?:por favor, )?(?:active|habilite|activa|habilita) (?:el )?javascript\b
acceso denegado\b
error 9: página no encontrada
(?:esta|la) página (?:no existe|no se ha encontrado|no está disponible|solicitada)
página no encontrada
su sesión ha (?:caducado|expirado)
lo sentimos, (?:el servicio|la página|ha ocurrido|se ha producido)
aquí va (?:el|la|su) (?:texto|título|contenido)
(?:veuillez |merci d'|vous devez )?activer javascript\b
accès (?:refusé|interdit)\b
erreur (?:serveur|interne|9)\b
une erreur (?:s'est produite|est survenue)
(?:la |cette )?page (?:demandée )?(?:est |reste )?(?:introuvable|indisponible)
(?:(?:essa|esta|a) )?página (?:solicitada )?(?:não (?:foi )?(?:encontrada|existe)|(?:não está disponível|indisponível))
(?:(?:questa|la) )?pagina (?:richiesta )?non (?:è (?:stata )?)?(?:trovata|disponibile)
(?:(?:de|deze) )?pagina (?:is )?niet (?:gevonden|beschikbaar)
votre session a expiré
les scripts sont (?:désactivés|bloqués)
(?:texte|contenu|titre) à venir\b
(?:bitte )?(?:aktivieren sie|schalten sie) (?:bitte )?(?:javascript|skripte)
zugriff verweigert\b
fehler 9\b
interner serverfehler\b
(?:der dienst|die seite|dieser dienst) ist (?:zurzeit|derzeit|momentan) nicht (?:erreichbar|verfügbar)
(?:(?:die|diese) )?(?:angeforderte |gewünschte )?seite (?:\w+ ){0,2}nicht (?:gefunden|verfügbar|erreichbar|vorhanden)
ihre sitzung ist abgelaufen
hier (?:steht|kommt|folgt) (?:später|noch|bald)? ?(?:der|ihr) text
(?:devam etmek için )?(?:lütfen )?javascript'?[iı]? etkinleştirin
hata 9\b
(?:sayfa bulunamadı|erişim engellendi|oturumunuz sona erdi|sunucu hatası)
ενεργοποιήστε (?:τη|την) javascript
σφάλμα 9\b
(?:η σελίδα δεν βρέθηκε|δεν επιτρέπεται η πρόσβαση|η συνεδρία σας έληξε)
请(?:先)?(?:启用|开启|打开) ?javascript
9 ?错误
(?:服务器|系统)(?:繁忙|错误|维护)
(?:此处|这里|在此)(?:填写|输入|插入)
(?:找不到该页面|访问被拒绝|禁止访问|页面不存在|您的会话已过期|请登录后)
.{0,20}javascript ?を有効に
9 ?エラー
(?:ページが見つかりません|アクセスが拒否されました|サーバーエラー|セッションの有効期限|ここに(?:本文|テキスト|文章))
(?:يرجى|الرجاء) (?:تفعيل|تشغيل) (?:جافا ?سكريبت|javascript)
خطأ 9(?!\d)
(?:الصفحة غير موجودة|تم رفض الوصول|انتهت (?:صلاحية )?جلستك)
.{0,30}javascript (?:चालू|सक्षम)
त्रुटि 9
(?:पृष्ठ नहीं मिला|पेज नहीं मिला|पहुँच अस्वीकृत|सत्र समाप्त)
(?:โปรด|กรุณา)(?:เปิด|เปิดใช้).{0,12}javascript
(?:ข้อผิดพลาด ?9|ไม่พบหน้า|การเข้าถึงถูกปฏิเสธ)
(?:включите|пожалуйста, включите) (?:javascript|скрипты)
(?:ошибка 9|страница не найдена|доступ запрещ[её]н|ваша сессия истекла)
"""
#: What only opens like a message; it needs a group that recurs.
OPENINGS = r"""
(?:sorry, )?something went wrong\b
(?:oops|whoops)!
(?:http |status )?(?:error|fehler|erreur|hata|ошибка) (?:code )?9\b
(?:access|permission) denied\b
too many requests\b
nothing here yet\b
the (?:link you followed|page you)\b
(?:please|bitte|veuillez|por favor,?|lütfen) (?:wait|reload|refresh|retry|try again|warten|patienter|espere|bekleyin)\b
(?:un)?subscribe (?:now|today|here|to)\b
(?:all rights reserved|advertisement|skip to (?:main )?content|cookie (?:settings|notice)|accept (?:all )?cookies)\b
"""
#: What a recurring message speaks about, and how it addresses its reader.
SUBJECTS = r"\b(?:javascript|scripts?|browser|cookies?|server|session|captcha|robot|log(?:ged)? (?:in|out)|sign(?:ed)? (?:in|out)|reload|refresh|this (?:page|site|link)|subscription|sitzung|navegador|navigateur|tarayıcı)\b"
ADDRESS = r"\b(?:you|your|please|try again|click|sie|ihre?n?|bitte|votre|vous|veuillez|su|sus|usted|por favor|lütfen)\b"
#: Signs that a unit speaks of a place of a template instead of having one.
SPOKEN_OF = r"(?i)\b(?:such as|(?:is|are) (?:written|replaced)|stands? for|in double braces)\b"
#: Signs that a message is reported by the same sentence.
REPORTED = r"⟦⟧|, (?:the|he|she|they)\b.*\b(?:says|said|explains|explained)\b"
#: Month names that stand in dates.
MONTHS = """
january february march april may june july august september october november december
januar februar märz april mai juni juli august september oktober november dezember
janvier février mars avril mai juin juillet août septembre octobre novembre décembre
enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre
ocak şubat mart nisan mayıs haziran temmuz ağustos eylül ekim kasım aralık
"""
#: Quoted passages without signs of a place of a template; a sentence in quotes may have an unfilled place.
QUOTED = "(?=[\"“„«「『])(?:" + "|".join(
    [r"(?<![^\s(\[—–:,-])\"(?=\S)[^\"\r\n{}%@_<\[#&]++(?<=\S)\""]
    + [rf"{a}[^{a}{b}\r\n{{}}%@_<\[#&]++[{b}]" for a, b in (("“", "”"), ("„", "“”"), ("«", "»"), ("「", "」"), ("『", "』"))]
) + ")"
#: Signs without which a text has no place of a template.
PLACE_SIGNS = r"[{}\[<%@_$&]|undefined"

_MONTH = "(?:" + "|".join(sorted(set(MONTHS.split()), key=lambda m: (-len(m), m))) + ")"
_DATE = rf"(?iu)\b(?=9|\p{{L}}++ 9)(?:9(?:st|nd|rd|th|er|\.)? (?:de |of )?{_MONTH}\b\.?(?:,? (?:de |of )?9)?|{_MONTH} 9(?:st|nd|rd|th)?(?:, 9)?)(?!\w)"
_UNITS = r"[\r\n]++|(?=\s)(?<=[.!?…][)\]]?)(?<!\b(?:Mr|Mrs|Dr|St|No|Prof|Fig|Sec|pp)\.)\s++|(?<=[。！？।؟])"
#: Signs at the edges of a unit that do not tell groups apart.
EDGES = " \t*#>|·•=~_–—-"


def _joined(block: str) -> str:
    return "|".join(x for x in block.replace("FORMAT_MARKS", FORMAT_MARKS).split("\n") if x)


PLACEHOLDER = _joined(PLACEHOLDERS)
#: A place of a template that is all that stands in the quotes is spoken of.
QUOTED_PLACE = rf"[\"“„«「]\s*(?:{PLACEHOLDER})\s*[\"”“»」]"
PHRASE = r"^(?:" + _joined(PHRASES) + ")"
OPENING = r"^(?:" + _joined(OPENINGS) + ")"


def masked(text: Column) -> Column:
    """A text with addresses, identifiers, numbers and dates masked and blanks made one; lines and case stay."""
    some = text.contains("@") | text.contains("://") | text.contains("www.")
    x = F.when(some, F.regexp_replace(text, r"https?://\S++|\bwww\.\S++|(?<![\w.+-])[\w.+-]++@[\w-]++(?:\.[\w-]++)++", "@")).otherwise(text)
    x = F.regexp_replace(x, r"\b(?=[a-f]*+[0-9])(?=[0-9]*+[a-f])[0-9a-f]{6,}+\b|\p{N}++(?:[.,:/-]\p{N}++)*+", "9")
    x = F.regexp_replace(x, _DATE, "9")
    return F.regexp_replace(x, r" [^\S\r\n]++|[^\S\r\n ][^\S\r\n]*+", " ")


def unit_occurrences(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """(id, src, raw_hash, unit_hash, unit): each masked unit of each text once, quoted passages taken out.

    ``unit_hash`` is that of the unit in lower case without edges; ``raw_hash`` tells its spellings
    apart, since places of templates go by case.
    """
    rows = documents.where(F.col(id_column).isNotNull() & (F.trim(text_column) != "")).select(F.col(id_column).alias("id"), F.col(source_column).alias("src"), F.col(text_column).alias("t"))
    open_ = F.when(F.col("t").rlike("[\"“„«「『]"), F.regexp_replace("t", QUOTED, "⟦⟧")).otherwise(F.col("t"))
    bare = rows.select("id", "src", open_.alias("t")).select("id", "src", F.when(F.col("t").rlike(r"[\"“„«「]\s*(?:" + PLACE_SIGNS + "|#)"), F.regexp_replace("t", QUOTED_PLACE, "⟦⟧")).otherwise(F.col("t")).alias("t"))
    units = F.array_distinct(F.transform(F.split(masked(F.col("t")), _UNITS), lambda u: F.trim(u)))
    cut = bare.select("id", "src", F.explode(units).alias("unit")).where(F.length("unit") > 1)
    return cut.select("id", "src", F.xxhash64("unit").alias("raw_hash"), F.xxhash64(F.btrim(F.lower("unit"), F.lit(EDGES))).alias("unit_hash"), "unit")


def group_counts(occurrences: DataFrame) -> DataFrame:
    """(unit_hash, n_docs, n_sources) of every group. Counts are made per source and id first, so a hot group is spread."""
    once = occurrences.select("unit_hash", "src", "id").distinct()
    by_source = once.groupBy("unit_hash", "src").agg(F.count("*").alias("n"))
    return by_source.groupBy("unit_hash").agg(F.sum("n").alias("n_docs"), F.count("*").alias("n_sources"))


def classified_units(occurrences: DataFrame) -> DataFrame:
    """(raw_hash, unit_hash, n_docs, n_sources, kind) of the distinct units that are residue.

    All groups are counted; each distinct unit is tried against the rules once, and those that
    fit one meet the counts of their group, which decide.
    """
    distinct = occurrences.select("unit").distinct()
    # the generator is a barrier: the lower-case unit is worked out once
    named = distinct.select("unit", F.explode(F.array(F.btrim(F.lower("unit"), F.lit(EDGES)))).alias("norm"))
    unit, norm = F.col("unit"), F.col("norm")
    place = unit.rlike(PLACE_SIGNS) & unit.rlike(PLACEHOLDER) & ~unit.rlike(SPOKEN_OF)
    weak = norm.rlike(OPENING) | (norm.rlike(SUBJECTS) & norm.rlike(ADDRESS))
    rule = F.when(place, "placeholder").when(norm.rlike(PHRASE) & ~norm.rlike(REPORTED), "phrase").when(weak & ~norm.rlike(REPORTED), "weak")
    fitting = named.select(F.xxhash64("unit").alias("raw_hash"), F.xxhash64("norm").alias("unit_hash"), rule.alias("rule")).where("rule is not null")
    wide = (F.col("n_docs") >= MIN_DOCS) & (F.col("n_sources") >= MIN_SOURCES)
    kind = F.when(wide, "recurring").when(F.col("rule") != "weak", F.col("rule"))
    judged = fitting.join(group_counts(occurrences), "unit_hash").select("raw_hash", "unit_hash", "n_docs", "n_sources", kind.alias("kind"))
    return judged.where("kind is not null")


def residue_units(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """(id, unit_hash, kind, n_docs, n_sources) of the units that are residue, joined back to their documents.

    The units are masked once and written to the shared folder; the counts and the join read only
    ids and hashes of them, the classification each distinct unit.
    """
    occurrences = written(unit_occurrences(documents, id_column, text_column, source_column))
    found = cut_lineage(classified_units(occurrences))
    return occurrences.select("id", "raw_hash").join(found, "raw_hash").select("id", "unit_hash", "kind", "n_docs", "n_sources")


def residue_documents(documents: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Ids of the documents with residue, once each."""
    return residue_units(documents, id_column).select(F.col("id").alias(id_column)).distinct()


def without_residue(documents: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """The documents that are kept: all rows without residue, null and blank texts included."""
    return documents.join(residue_documents(documents, id_column), id_column, "left_anti")
